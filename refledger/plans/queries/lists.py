"""List-level queries: duplicates, clones, profiles, scores, audits, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.fixtures import view
from refledger.functions.similarity import TOKEN
from refledger.operators import dedupe, document, evaluate, fuzzy, profile, score
from refledger.plans.queries.base import in_sql, jaccard_sql, q, query, refs, results, title_key_sql, tokens_sql, url_key_sql
from refledger.sources import exports

# --- windows -------------------------------------------------------------------------------------------

_KEYS = f"""
WITH s AS (SELECT list_id, ref_id, {title_key_sql('title')} AS sig, url, doi, pmid FROM fx_refs),
keys AS (SELECT * FROM (SELECT list_id, ref_id, 1 AS r, 'url' AS kind, concat({url_key_sql('url')}, '|', sig) AS key FROM s WHERE url IS NOT NULL AND sig <> ''
  UNION ALL SELECT list_id, ref_id, 2, 'doi', concat(lower(doi), '|', sig) FROM s WHERE doi IS NOT NULL AND sig <> ''
  UNION ALL SELECT list_id, ref_id, 3, 'pmid', concat(pmid, '|', sig) FROM s WHERE pmid IS NOT NULL AND sig <> ''))
"""


def _shared_ids(spark, sf):
    """References whose identifiers repeat inside a list, so that duplicates occur."""
    r = refs(spark, sf)
    slot = (F.col("ref_id") % 4).cast("string")
    return r.withColumns({
        "title": F.when(F.col("ref_id") % 3 < 2, F.concat(F.lit("shared title "), slot)).otherwise(F.col("title")),
        "doi": F.when(F.col("ref_id") % 5 < 3, F.concat(F.lit("10.5555/same"), (F.col("ref_id") % 3).cast("string"))).otherwise(F.col("doi")),
        "url": F.when(F.col("ref_id") % 6 < 2, F.concat(F.lit("https://Same.example.org/"), (F.col("ref_id") % 5).cast("string"), F.lit("/?q=1"))).otherwise(F.col("url")),
        "pmid": F.when(F.col("ref_id") % 8 < 3, F.concat(F.lit("900000"), (F.col("ref_id") % 5).cast("string"))).otherwise(F.col("pmid")),
    })


_SHARED = f"""sh AS (SELECT list_id, ref_id, CASE WHEN ref_id % 3 < 2 THEN concat('shared title ', CAST(ref_id % 4 AS VARCHAR)) ELSE title END AS title,
  CASE WHEN ref_id % 5 < 3 THEN concat('10.5555/same', CAST(ref_id % 3 AS VARCHAR)) ELSE doi END AS doi,
  CASE WHEN ref_id % 6 < 2 THEN concat('https://Same.example.org/', CAST(ref_id % 5 AS VARCHAR), '/?q=1') ELSE url END AS url,
  CASE WHEN ref_id % 8 < 3 THEN concat('900000', CAST(ref_id % 5 AS VARCHAR)) ELSE pmid END AS pmid FROM fx_records)"""


@query("w1_mark_duplicates_global", ("WITH " + _SHARED + "," + _KEYS.strip()[5:]).replace("FROM fx_refs)", "FROM sh)") + """
, low AS (SELECT list_id, kind, key, min(ref_id) AS holder FROM keys GROUP BY 1, 2, 3),
h AS (SELECT k.list_id, k.ref_id, r, k.kind, holder FROM keys k JOIN low l ON l.list_id = k.list_id AND l.kind = k.kind AND l.key = k.key AND holder < k.ref_id)
SELECT list_id, ref_id, holder AS duplicate_of, kind AS duplicate_kind FROM (SELECT *, row_number() OVER (PARTITION BY list_id, ref_id ORDER BY r) AS rn FROM h) WHERE rn = 1""")
def w1_global(spark, sf):
    return dedupe.mark_duplicates(_shared_ids(spark, sf), mode="global")


DUPLICATES_SQL = ("WITH RECURSIVE " + _SHARED + "," + _KEYS.strip()[5:]).replace("FROM fx_refs)", "FROM sh)") + """
, flat AS (SELECT s.list_id, s.ref_id, row_number() OVER (PARTITION BY s.list_id ORDER BY s.ref_id) AS pos,
    list(k.key ORDER BY k.r) FILTER (WHERE k.key IS NOT NULL) AS ks, list(k.kind ORDER BY k.r) FILTER (WHERE k.key IS NOT NULL) AS kd
  FROM sh s LEFT JOIN keys k ON k.ref_id = s.ref_id GROUP BY 1, 2),
step AS (SELECT list_id, 0::BIGINT AS pos, NULL::BIGINT AS ref_id, MAP([]::VARCHAR[], []::BIGINT[]) AS seen, NULL::BIGINT AS dup_of, NULL::VARCHAR AS dup_kind FROM (SELECT DISTINCT list_id FROM sh)
  UNION ALL SELECT f.list_id, f.pos, f.ref_id, CASE WHEN h.i IS NULL AND f.ks IS NOT NULL THEN map_concat(s.seen, map_from_entries(list_transform(list_zip(f.kd, f.ks), lambda x: {'k': x[1] || '|' || x[2], 'v': f.ref_id}))) ELSE s.seen END,
    CASE WHEN h.i IS NOT NULL THEN s.seen[f.kd[h.i] || '|' || f.ks[h.i]] END, f.kd[h.i]
  FROM step s JOIN flat f ON f.list_id = s.list_id AND f.pos = s.pos + 1
  CROSS JOIN LATERAL (SELECT min(i) AS i FROM unnest(range(1, coalesce(len(f.ks), 0) + 1)) t(i) WHERE map_contains(s.seen, f.kd[i] || '|' || f.ks[i])) h)
SELECT list_id, ref_id, dup_of AS duplicate_of, dup_kind AS duplicate_kind FROM step WHERE dup_of IS NOT NULL"""


@query("w1_mark_duplicates", DUPLICATES_SQL)
def w1_greedy(spark, sf):
    return dedupe.mark_duplicates(_shared_ids(spark, sf))


@query("w1_apply_duplicates", ("WITH " + _SHARED + "," + _KEYS.strip()[5:]).replace("FROM fx_refs)", "FROM sh)") + """
, low AS (SELECT list_id, kind, key, min(ref_id) AS holder FROM keys GROUP BY 1, 2, 3),
h AS (SELECT DISTINCT k.list_id, k.ref_id FROM keys k JOIN low l ON l.list_id = k.list_id AND l.kind = k.kind AND l.key = k.key AND holder < k.ref_id)
SELECT r.list_id, CASE WHEN h.ref_id IS NOT NULL AND r.verdict = 'verified' THEN 'partial' ELSE r.verdict END AS verdict, count(*) AS n
FROM fx_results r LEFT JOIN h ON h.ref_id = r.ref_id GROUP BY 1, 2""")
def w1_apply(spark, sf):
    dup = dedupe.mark_duplicates(_shared_ids(spark, sf), mode="global")
    return dedupe.apply_duplicates(results(spark, sf), dup).groupBy("list_id", "verdict").agg(F.count("*").alias("n"))


@query("w2_reuse_by_key", f"""
WITH k AS (SELECT list_id, ref_id, coalesce('doi:' || lower(doi), 'url:' || {url_key_sql('url')}, 'pmid:' || pmid,
  CASE WHEN regexp_matches(coalesce(arxiv, ''), {q(fv.ARXIV_NEW)}) THEN 'arxiv:' || arxiv END) AS reuse_key FROM fx_refs)
SELECT *, leader < ref_id AS is_follower FROM (SELECT list_id, ref_id, reuse_key, min(ref_id) OVER (PARTITION BY list_id, reuse_key) AS leader FROM k WHERE reuse_key IS NOT NULL)""")
def w2(spark, sf):
    return dedupe.reuse_by_key(refs(spark, sf))


_SERIAL = f"""
WITH t AS (SELECT list_id, ref_id, regexp_extract(lower(doi), {q(fv.SERIAL_DOI)}, 1) AS prefix, CAST(regexp_extract(lower(doi), {q(fv.SERIAL_DOI)}, 2) AS DECIMAL(38,0)) AS tail
  FROM fx_refs WHERE regexp_matches(lower(coalesce(doi, '')), {q(fv.SERIAL_DOI)})),
b AS (SELECT *, CASE WHEN tail - lag(tail) OVER w > 2 THEN 1 ELSE 0 END AS brk FROM t WINDOW w AS (PARTITION BY list_id, prefix ORDER BY tail, ref_id)),
g AS (SELECT *, sum(brk) OVER (PARTITION BY list_id, prefix ORDER BY tail, ref_id ROWS UNBOUNDED PRECEDING) AS grp FROM b),
r AS (SELECT list_id, prefix, grp, count(*) AS run_length, min(tail) AS lo, max(tail) AS hi FROM g GROUP BY 1, 2, 3),
serial AS (SELECT list_id, prefix, run_length, CAST(lo AS VARCHAR) AS first_tail, CAST(hi AS VARCHAR) AS last_tail
  FROM (SELECT *, row_number() OVER (PARTITION BY list_id, prefix ORDER BY run_length DESC, lo) AS rn FROM r) WHERE rn = 1 AND run_length >= 3)
"""


@query("w3_serial_clusters", _SERIAL + "SELECT * FROM serial")
def w3(spark, sf):
    return profile.serial_clusters(refs(spark, sf))


@query("w3_serial_clusters_merged", _SERIAL.replace("FROM fx_refs WHERE", "FROM (SELECT 0 AS list_id, ref_id, doi FROM fx_refs) WHERE") + "SELECT * FROM serial")
def w3_merged(spark, sf):
    """All references as one list, in narrow slices, so that runs cross slice edges."""
    return profile.serial_clusters(refs(spark, sf).withColumn("list_id", F.lit(0)), width=16)


_RUNS = """
WITH m AS (SELECT host, ts, probe_id, error_kind IS NOT NULL AS bad, row_number() OVER (PARTITION BY host ORDER BY ts, probe_id)
    - row_number() OVER (PARTITION BY host, error_kind IS NOT NULL ORDER BY ts, probe_id) AS grp FROM fx_probes),
runs AS (SELECT host, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS run_length FROM m WHERE bad GROUP BY host, grp)
"""


@query("w4_failure_runs", _RUNS + "SELECT * FROM runs")
def w4(spark, sf):
    return profile.failure_runs(view(spark, sf, "fx_probes"))


_RANK = "CASE verdict WHEN 'verified' THEN 0 WHEN 'partial' THEN 1 WHEN 'unreachable' THEN 2 WHEN 'unverified' THEN 3 ELSE 4 END"


@query("w5_review_order", f"""
SELECT list_id, ref_id, verdict, row_number() OVER (PARTITION BY list_id ORDER BY {_RANK}, ref_id) AS position FROM fx_results""")
def w5(spark, sf):
    return score.review_order(results(spark, sf)).select("list_id", "ref_id", "verdict", "position")


_BASE_KEY = """substr(concat('ledger', CASE WHEN year IS NULL THEN '' ELSE CAST(year AS VARCHAR) END,
  array_to_string(list_slice(regexp_extract_all(replace(replace(CASE WHEN trim(title) = '' THEN 'untitled' ELSE title END, '{', ''), '}', ''), '[A-Za-z0-9一-鿿]+'), 1, 3), '')), 1, 42)"""


@query("w6_unique_cite_keys", f"""
SELECT list_id, ref_id, CASE WHEN n = 1 THEN k ELSE concat(k, '_', CAST(n AS VARCHAR)) END AS cite_key
FROM (SELECT *, row_number() OVER (PARTITION BY list_id, k ORDER BY ref_id) AS n FROM (SELECT list_id % 3 AS list_id, ref_id, {_BASE_KEY} AS k FROM fx_results))""")
def w6(spark, sf):
    df = results(spark, sf).withColumn("list_id", F.col("list_id") % 3)
    return exports.unique_cite_keys(df).select("list_id", "ref_id", "cite_key")


@query("w7_best_candidate", f"""
WITH p AS (SELECT r.ref_id, o.rank_id, {jaccard_sql(tokens_sql('r.title'), tokens_sql('o.display_name'))} AS sim FROM fx_refs r JOIN fx_openalex o ON lower(o.doi) = lower(r.doi)
  AND abs(o.publication_year - r.year) <= 1)
SELECT ref_id, rank_id, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY sim DESC, rank_id) AS rn FROM p) WHERE rn = 1""")
def w7(spark, sf):
    o = view(spark, sf, "fx_openalex").select(F.lower("doi").alias("key"), "rank_id", F.col("display_name").alias("r_title"), F.col("publication_year").alias("r_year"))
    r = refs(spark, sf).select("ref_id", F.lower("doi").alias("key"), "title", "year")
    return fuzzy.best_candidate(r, o, "key", TOKEN).select("ref_id", "rank_id", F.round("sim", 6).alias("sim"))


# --- clones ----------------------------------------------------------------------------------------------

_CLONES = ("WITH " + _SHARED + f""", v AS (SELECT list_id, k, lower(doi) AS doi, min(ref_id) AS first_ref FROM (SELECT *, {title_key_sql("coalesce(title, '')")} AS k FROM sh) WHERE length(k) >= 8 AND coalesce(doi, '') <> '' GROUP BY 1, 2, 3),
l AS (SELECT *, min(first_ref) OVER (PARTITION BY list_id, k) AS lead_ref FROM v)
SELECT list_id, lead_ref AS a, first_ref AS b, 'clone_doi' AS kind, 1.0::DOUBLE AS sim FROM l WHERE first_ref <> lead_ref
UNION ALL SELECT x.list_id, x.first_ref, y.first_ref, 'clone_title', 0.0 FROM v x JOIN v y ON x.list_id = y.list_id AND x.doi = y.doi AND x.first_ref < y.first_ref
  WHERE abs(length(x.k) - length(y.k)) <= greatest(length(x.k), length(y.k)) * 0.35""")


@query("j17_clone_pairs_token", _CLONES)
def j17_token(spark, sf):
    """Clone pairs with whole keys as tokens: equal titles and different titles, no near ones."""
    return dedupe.clone_pairs(_shared_ids(spark, sf), TOKEN)


@query("j17_clone_pairs")
def j17(spark, sf):
    return dedupe.clone_pairs(_shared_ids(spark, sf))


@query("j17_clone_pairs_corpus")
def j17_corpus(spark, sf):
    """The whole corpus as one list: near titles by shared segments."""
    df = view(spark, sf, "fx_refs").withColumn("list_id", F.lit(0).cast("bigint"))
    return dedupe.clone_pairs(df)


_PARTNERS = "WITH " + _SHARED + f""", k AS (SELECT list_id, ref_id, {title_key_sql("coalesce(title, '')")} AS k, lower(doi) AS doi FROM sh),
t AS MATERIALIZED (SELECT *, min(ref_id) OVER (PARTITION BY list_id, k) AS title_group FROM k WHERE length(k) >= 8 AND coalesce(doi, '') <> '')
SELECT a.list_id, a.ref_id, a.title_group, count(*) FILTER (WHERE a.k = b.k AND a.doi <> b.doi) AS clone_doi_partners,
  count(*) FILTER (WHERE a.k <> b.k AND a.doi = b.doi AND abs(length(a.k) - length(b.k)) <= greatest(length(a.k), length(b.k)) * {fv.CLONE_LENGTH_GAP}) AS clone_title_partners
FROM t a JOIN t b ON a.list_id = b.list_id AND (a.k = b.k OR a.doi = b.doi) GROUP BY 1, 2, 3"""


@query("j17_clone_annotations", f"SELECT * FROM ({_PARTNERS}) WHERE clone_doi_partners + clone_title_partners > 0")
def j17_annotations(spark, sf):
    """Partners of every row, whole keys as tokens: equal titles and different ones, no near ones."""
    return dedupe.clone_annotations(dedupe.clone_groups(_shared_ids(spark, sf), TOKEN))


@query("j17_clone_groups", "SELECT list_id, ref_id, title_group FROM (" + _PARTNERS + ")")
def j17_groups(spark, sf):
    return dedupe.clone_groups(_shared_ids(spark, sf)).members.select("list_id", "ref_id", "title_group")


# --- scores ----------------------------------------------------------------------------------------------

_COUNTS = ", ".join(f"count(*) FILTER (WHERE verdict = '{v}') AS n_{v}" for v in fv.VERDICTS)
SCORE_SQL = f"""
WITH c AS (SELECT list_id, count(*) AS total, {_COUNTS}, count(*) FILTER (WHERE retracted) AS n_retracted, count(*) FILTER (WHERE needs_human) AS n_review FROM {{src}} GROUP BY list_id),
sc AS (SELECT *, CAST(round_even(greatest(10 * n_verified + 4 * n_partial - 2 * n_unverified - 8 * n_invalid, 0) * 100.0::DOUBLE / (10 * total), 0) AS INTEGER) AS score FROM c),
card AS (SELECT *, CASE WHEN score >= 85 THEN 'A' WHEN score >= 70 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade FROM sc)
"""
_V = ", ".join(f"n_{v}" for v in fv.VERDICTS)


@query("a1_scorecard", SCORE_SQL.format(src="fx_results") + f"SELECT list_id, total, {_V}, score, grade FROM card")
def a1(spark, sf):
    return score.scorecard(results(spark, sf))


@query("a2_verdict_distribution", "SELECT list_id, " + ", ".join(
    f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in fv.VERDICTS) + " FROM fx_results GROUP BY list_id")
def a2(spark, sf):
    return score.verdict_distribution(results(spark, sf))


@query("a3_bluf", SCORE_SQL.format(src="fx_results") + f"""
, b AS (SELECT *, CASE WHEN n_invalid > 0 THEN 'invalid' WHEN n_unreachable + n_unverified > 0 THEN 'unchecked' WHEN n_partial > 0 THEN 'partial' ELSE 'clean' END AS conclusion FROM card)
SELECT list_id, conclusion, CASE conclusion WHEN 'invalid' THEN n_invalid WHEN 'unchecked' THEN n_unreachable + n_unverified WHEN 'partial' THEN n_partial ELSE 0 END AS n_blocking,
  CASE conclusion WHEN 'invalid' THEN 'remove or replace invalid sources and run again' WHEN 'unchecked' THEN 'compare archived copies or run again online'
    WHEN 'partial' THEN 'state reservations where partial sources are cited' ELSE 'export the bibliography' END AS next_action,
  score, grade, total, {_V}, n_review, n_retracted FROM b""")
def a3(spark, sf):
    return score.bluf(results(spark, sf))


@query("a4_precheck", SCORE_SQL.format(src="fx_results") + """
SELECT list_id, CASE WHEN n_invalid + n_unreachable + n_unverified > 0 THEN 'block' WHEN n_partial > 0 THEN 'partial' ELSE 'clean' END AS submission_class,
  n_invalid, n_unreachable, n_unverified, n_partial FROM card""")
def a4(spark, sf):
    return score.precheck(results(spark, sf))


_TIER = """CASE WHEN verdict = 'invalid' THEN 'P0' WHEN retracted OR verdict = 'unreachable' THEN 'P1' WHEN policy_violation IS NOT NULL OR verdict = 'partial' THEN 'P2' END"""


@query("a5_audit_tiers", f"""
SELECT list_id, audit_tier, count(*) AS n, grouping_id(list_id, audit_tier) AS level FROM (SELECT list_id, {_TIER} AS audit_tier FROM fx_results)
WHERE audit_tier IS NOT NULL GROUP BY ROLLUP (list_id, audit_tier)""")
def a5(spark, sf):
    return score.audit_tiers(results(spark, sf))


@query("a5_audit_rows", f"""
SELECT list_id, ref_id, t AS audit_tier, CASE WHEN t = 'P0' THEN 'invalid' WHEN t = 'P1' AND retracted THEN 'retracted' WHEN t = 'P1' THEN 'unreachable'
  WHEN policy_violation IS NOT NULL THEN 'policy' ELSE 'partial' END AS audit_tag FROM (SELECT *, {_TIER} AS t FROM fx_results) WHERE t IS NOT NULL""")
def a5_rows(spark, sf):
    return score.audit_rows(results(spark, sf)).select("list_id", "ref_id", "audit_tier", "audit_tag")


@query("a6_submission_readiness", f"""
WITH a AS (SELECT list_id, count(*) FILTER (WHERE t = 'P0') AS p0, count(*) FILTER (WHERE t = 'P1') AS p1, count(*) FILTER (WHERE t = 'P2') AS p2,
  count(*) FILTER (WHERE t = 'P1' AND retracted) AS nr, count(*) FILTER (WHERE t = 'P1' AND NOT retracted) AS nu,
  count(*) FILTER (WHERE verdict IN ('unverified', 'unreachable')) AS n_open FROM (SELECT *, {_TIER} AS t FROM fx_results) GROUP BY list_id)
SELECT list_id, p0, p1, p2, n_open, array_to_string(list_filter([CASE WHEN p0 > 0 THEN 'invalid' END, CASE WHEN nr > 0 THEN 'retracted' END, CASE WHEN nu > 0 THEN 'unreachable' END], lambda x: x IS NOT NULL), ',') AS blockers,
  CASE WHEN p2 > 0 THEN 'review' ELSE '' END AS todos, p0 = 0 AND nr = 0 AND nu = 0 AS ready FROM a""")
def a6(spark, sf):
    return score.submission_readiness(results(spark, sf)).withColumns({
        "blockers": F.array_join("blockers", ","), "todos": F.array_join("todos", ",")})


@query("a6_submission_todos", """
WITH d AS (SELECT DISTINCT list_id, list_id % 3 AS n_unbound, list_id % 2 AS n_uncited FROM fx_refs WHERE list_id % 5 > 0),
p AS (SELECT list_id, count(*) FILTER (WHERE t = 'P2') AS p2 FROM (SELECT *, """ + _TIER + """ AS t FROM fx_results) GROUP BY 1)
SELECT p.list_id, array_to_string(list_filter([CASE WHEN p2 > 0 THEN 'review' END, CASE WHEN n_unbound > 0 THEN 'unbound_markers' END,
  CASE WHEN n_uncited > 0 THEN 'uncited_entries' END], lambda x: x IS NOT NULL), ',') AS todos FROM p LEFT JOIN d ON d.list_id = p.list_id""")
def a6_todos(spark, sf):
    """With findings of a document for most lists."""
    found = refs(spark, sf).select("list_id").distinct().filter("list_id % 5 > 0").withColumns({
        "n_unbound": F.col("list_id") % 3, "n_uncited": F.col("list_id") % 2})
    return score.submission_readiness(results(spark, sf), found).select("list_id", F.array_join("todos", ",").alias("todos"))


AS_OF = 2026


@query("a7_profile_bibliography", _SERIAL + f"""
, pb AS (SELECT list_id, count(*) AS n, count(*) FILTER (WHERE doi IS NULL AND pmid IS NULL AND arxiv IS NULL AND url IS NULL) AS n_bare,
  count(*) FILTER (WHERE year > {AS_OF + 1}) AS n_future, min(year) AS year_min, max(year) AS year_max FROM src GROUP BY 1),
y AS (SELECT list_id, sum(c)::BIGINT AS n_years, max_by(year, c * 1000000000000 - f) AS year_mode, max(c) AS yc FROM (SELECT list_id, year, count(*) AS c, min(ref_id) AS f FROM src GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT list_id, sum(c)::BIGINT AS n_sources, max_by(source, c * 1000000000000 - f) AS source_top, max(c) AS sc FROM (SELECT list_id, source, count(*) AS c, min(ref_id) AS f FROM src GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT list_id, count(*) AS n_serial FROM serial GROUP BY 1)
SELECT pb.list_id, n, CASE WHEN n >= 4 THEN array_to_string(list_filter([CASE WHEN n_serial > 0 THEN 'serial_cluster' END, CASE WHEN n_future > 0 THEN 'future_year' END,
    CASE WHEN n_years >= 8 AND yc / n_years::DOUBLE >= 0.8 THEN 'year_concentration' END, CASE WHEN n_sources >= 8 AND sc / n_sources::DOUBLE >= 0.6 THEN 'source_concentration' END,
    CASE WHEN n_bare > 0 AND n_bare / n::DOUBLE >= 0.5 THEN 'bare_refs' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS flags,
  coalesce(n_serial, 0) AS n_serial, n_future, year_min, year_max, year_mode, round(yc / n_years::DOUBLE, 2) AS year_mode_share,
  CASE WHEN n_sources >= 8 THEN source_top END AS source_top, CASE WHEN n_sources >= 8 THEN round(sc / n_sources::DOUBLE, 2) END AS source_top_share,
  n_bare, round(n_bare / n::DOUBLE, 2) AS bare_share
FROM pb JOIN y USING (list_id) JOIN s USING (list_id) LEFT JOIN z USING (list_id)""".replace("FROM src", """FROM (SELECT list_id, ref_id, doi, arxiv,
    CASE WHEN list_id % 7 = 3 AND ref_id % 5 > 0 THEN 2001 ELSE year END AS year, CASE WHEN list_id % 9 = 4 AND ref_id % 5 > 0 THEN 'src1' ELSE source END AS source,
    CASE WHEN list_id % 4 <> 2 THEN pmid END AS pmid, CASE WHEN list_id % 4 <> 2 THEN url END AS url FROM fx_refs)"""))
def a7(spark, sf):
    r = refs(spark, sf)
    skew = r.withColumns({
        "year": F.when((F.col("list_id") % 7 == 3) & (F.col("ref_id") % 5 > 0), 2001).otherwise(F.col("year")),
        "source": F.when((F.col("list_id") % 9 == 4) & (F.col("ref_id") % 5 > 0), "src1").otherwise(F.col("source")),
        "pmid": F.when(F.col("list_id") % 4 != 2, F.col("pmid")), "url": F.when(F.col("list_id") % 4 != 2, F.col("url"))})
    return profile.profile_bibliography(skew, AS_OF).withColumn("flags", F.array_join("flags", ","))


@query("a12_oa_summary", """
SELECT list_id, count(is_oa) AS n_checked, count(*) FILTER (WHERE is_oa) AS n_free FROM fx_results GROUP BY list_id""")
def a12(spark, sf):
    return score.oa_summary(results(spark, sf))


@query("a17_host_health", _RUNS + """
, h AS (SELECT host, count(*) AS n_probes, count(*) FILTER (WHERE error_kind IS NOT NULL) AS n_failures FROM fx_probes GROUP BY 1)
SELECT h.host, n_probes, n_failures, coalesce(m, 0) AS longest_run, coalesce(m, 0) >= 2 AS is_open, (SELECT count(*) FROM h WHERE n_failures = n_probes) >= 3 AS batch_degraded
FROM h LEFT JOIN (SELECT host, max(run_length) AS m FROM runs GROUP BY 1) r ON r.host = h.host""")
def a17(spark, sf):
    return profile.host_health(view(spark, sf, "fx_probes"))


_CLAIMS = """(SELECT concat('claim ', CAST(ref_id % 60 AS VARCHAR)) AS claim, concat('h', CAST(ref_id % 7 AS VARCHAR)) AS host, tier,
  CASE ref_id % 5 WHEN 0 THEN 'contradicted' WHEN 1 THEN 'unclear' ELSE 'supported' END AS support FROM fx_results WHERE list_id % 2 = 0)"""


@query("a18_conclusion_grade", f"""
WITH g AS (SELECT claim, count(DISTINCT CASE WHEN support = 'supported' THEN host END) AS n_hosts,
  bool_or(support = 'supported' AND tier IN {in_sql(fv.TRUSTED_TIERS)}) AS has_trusted, bool_or(support = 'contradicted') AS has_contradiction,
  bool_and(tier IN ('community', 'social')) FILTER (WHERE support = 'supported') AS community_only FROM {_CLAIMS} GROUP BY claim)
SELECT claim, n_hosts, has_trusted, has_contradiction, CASE WHEN has_contradiction AND n_hosts > 0 THEN 'red' WHEN n_hosts = 0 OR coalesce(community_only, false) THEN 'red'
  WHEN n_hosts >= 2 AND has_trusted THEN 'green' WHEN has_trusted OR n_hosts >= 2 THEN 'yellow' ELSE 'red' END AS confidence FROM g""".replace(
    "WHERE list_id % 2 = 0", "").replace("ref_id % 60", "(ref_id // 4)"))
def a18(spark, sf):
    support = F.when(F.col("ref_id") % 5 == 0, "contradicted").when(F.col("ref_id") % 5 == 1, "unclear").otherwise("supported")
    claims = results(spark, sf).select(
        F.concat(F.lit("claim "), F.floor(F.col("ref_id") / 4).cast("string")).alias("claim"),
        F.concat(F.lit("h"), (F.col("ref_id") % 7).cast("string")).alias("host"), "tier", support.alias("support"))
    return score.conclusion_grade(claims)


# --- evaluation --------------------------------------------------------------------------------------------

_METRICS = """
WITH m AS (SELECT count(*) AS n, round(avg(CASE WHEN expected = 'planted' THEN CASE WHEN verdict IS NOT NULL AND verdict <> 'verified' THEN 1.0 ELSE 0.0 END END)::DOUBLE, 4) AS capture_rate,
  round(avg(CASE WHEN expected = 'planted' THEN CASE WHEN verdict = 'invalid' THEN 1.0 ELSE 0.0 END END)::DOUBLE, 4) AS strict_capture,
  round(avg(CASE WHEN expected = 'clean' THEN CASE WHEN verdict = 'invalid' THEN 1.0 ELSE 0.0 END END)::DOUBLE, 4) AS false_kill_rate,
  count(*) FILTER (WHERE verdict = 'verified') AS n_verified, count(*) FILTER (WHERE verdict = 'partial') AS n_partial, count(*) FILTER (WHERE verdict = 'unreachable') AS n_unreachable,
  count(*) FILTER (WHERE verdict = 'unverified') AS n_unverified, count(*) FILTER (WHERE verdict = 'invalid') AS n_invalid, coalesce(bool_or(verdict IN ('verified', 'partial')), false) AS live FROM fx_labels)
"""


@query("a13_holdout_metrics", _METRICS + "SELECT * FROM m")
def a13(spark, sf):
    return evaluate.holdout_metrics(view(spark, sf, "fx_labels"))


_FIDELITY = """
WITH e AS (SELECT doc_id AS ref_id, CASE quality WHEN 1 THEN 'exact' ELSE CASE WHEN doc_id % 2 = 0 THEN 'minor' ELSE 'major' END END AS want,
  CASE doc_id % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'minor' ELSE 'major' END AS got FROM labels)
SELECT count(*) AS n, round(avg(CASE WHEN want = got THEN 1.0 ELSE 0.0 END)::DOUBLE, 4) AS fidelity_hit_rate, count(*) FILTER (WHERE got = 'exact') AS n_exact,
  count(*) FILTER (WHERE got = 'minor') AS n_minor, count(*) FILTER (WHERE got = 'major') AS n_major FROM e"""


@query("a14_fidelity_metrics", _FIDELITY)
def a14(spark, sf):
    lab = view(spark, sf, "labels")
    want = F.when(F.col("quality") == 1, "exact").when(F.col("doc_id") % 2 == 0, "minor").otherwise("major")
    got = F.when(F.col("doc_id") % 3 == 0, "exact").when(F.col("doc_id") % 3 == 1, "minor").otherwise("major")
    return evaluate.fidelity_metrics(
        lab.select(F.col("doc_id").alias("ref_id"), want.alias("expected_fidelity")),
        lab.select(F.col("doc_id").alias("ref_id"), got.alias("doi_fidelity")))


@query("a15_eval_gate", _METRICS + """
SELECT n, array_to_string(list_filter([CASE WHEN capture_rate <> 1 THEN 'capture_rate' END, CASE WHEN false_kill_rate <> 0 THEN 'false_kill_rate' END,
  CASE WHEN capture_rate IS NULL THEN 'no_criterion' END, CASE WHEN NOT live THEN 'no_evidence' END], lambda x: x IS NOT NULL), ',') AS violations,
  capture_rate = 1 AND false_kill_rate = 0 AND live AS passed FROM m""")
def a15(spark, sf):
    g = evaluate.eval_gate(evaluate.holdout_metrics(view(spark, sf, "fx_labels")))
    return g.select("n", F.array_join("violations", ",").alias("violations"), "passed")


@query("a15_eval_gate_passing", (_METRICS + """
SELECT n, '' AS violations, n > 0 AND capture_rate = 1 AND false_kill_rate = 0 AND live AS passed FROM m""").replace(
    "FROM fx_labels", "FROM (SELECT * REPLACE (CASE WHEN expected = 'planted' THEN 'invalid' ELSE 'verified' END AS verdict) FROM fx_labels)"))
def a15_passing(spark, sf):
    """A run that judges every labelled reference as reviewed."""
    right = view(spark, sf, "fx_labels").withColumn("verdict", F.when(F.col("expected") == "planted", "invalid").otherwise("verified"))
    g = evaluate.eval_gate(evaluate.holdout_metrics(right))
    return g.select("n", F.array_join("violations", ",").alias("violations"), "passed")


@query("a16_freeze_holdout_complete", """
WITH d AS (SELECT *, row_number() OVER (PARTITION BY lower(rtrim(rtrim(doi, '.'), '/')) ORDER BY ref_id) AS rn FROM fx_results WHERE doi IS NOT NULL)
SELECT count(*) AS n, 0 AS n_unreviewed, 0 AS n_planted_without_note, 0 AS n_clean_without_identifier, 0 AS n_planted_verified, 0 AS n_repeated_dois,
  count(*) > 0 AS can_freeze FROM d WHERE rn = 1""")
def a16_complete(spark, sf):
    """A draft without open points: one row a DOI, all reviewed, every planted one explained."""
    d = results(spark, sf).filter("doi IS NOT NULL").dropDuplicates(["doi"])
    planted = F.col("verdict") == "invalid"
    return evaluate.freeze_holdout(d.withColumns({
        "reviewed": F.when(planted, "planted").otherwise("clean"), "planted_note": F.when(planted, "why")}))


@query("a16_freeze_holdout", """
WITH d AS (SELECT *, CASE WHEN ref_id % 40 = 0 THEN NULL WHEN verdict = 'invalid' THEN 'planted' ELSE 'clean' END AS reviewed, CASE WHEN ref_id % 3 = 0 THEN 'why' END AS planted_note FROM fx_results)
SELECT count(*) AS n, count(*) FILTER (WHERE reviewed IS NULL) AS n_unreviewed, count(*) FILTER (WHERE reviewed = 'planted' AND planted_note IS NULL) AS n_planted_without_note,
  count(*) FILTER (WHERE reviewed = 'clean' AND doi IS NULL AND pmid IS NULL AND arxiv IS NULL AND url IS NULL) AS n_clean_without_identifier,
  count(*) FILTER (WHERE reviewed = 'planted' AND verdict = 'verified') AS n_planted_verified,
  (SELECT count(*) FROM (SELECT lower(doi) FROM d WHERE doi IS NOT NULL GROUP BY lower(doi) HAVING count(*) > 1)) AS n_repeated_dois, false AS can_freeze FROM d""")
def a16(spark, sf):
    reviewed = F.when(F.col("ref_id") % 40 == 0, None).when(F.col("verdict") == "invalid", "planted").otherwise("clean")
    note = F.when(F.col("ref_id") % 3 == 0, "why")
    return evaluate.freeze_holdout(results(spark, sf).withColumns({"reviewed": reviewed, "planted_note": note}))


# --- documents ---------------------------------------------------------------------------------------------

def _docs(spark, sf):
    return view(spark, sf, "fx_docs_marked")


# the markers each derived document carries, by construction of the view
_MARKS = """
WITH marks AS (SELECT doc_id, list_id, '[' || CAST(1 + doc_id % 30 AS VARCHAR) || ']' AS marker, CAST(1 + doc_id % 30 AS INT) AS lo, CAST(1 + doc_id % 30 AS INT) AS hi FROM documents_l
  UNION ALL SELECT doc_id, list_id, '[' || CAST(1 + doc_id % 5 AS VARCHAR) || '-' || CAST(3 + doc_id % 5 AS VARCHAR) || ']', CAST(1 + doc_id % 5 AS INT), CAST(3 + doc_id % 5 AS INT) FROM documents_l),
targets AS (SELECT doc_id, list_id, marker, unnest(range(lo, hi + 1))::INT AS number FROM marks),
entries AS (SELECT list_id, ref_id, CAST(ref_id % 25 + 1 AS INT) AS position FROM fx_refs),
bound AS (SELECT t.doc_id, t.list_id, t.marker, t.number, e.ref_id FROM targets t LEFT JOIN entries e ON e.list_id = t.list_id AND e.position = t.number)
""".replace("documents_l", "fx_docs_marked")


@query("f16_extract_mentions", _MARKS + """
SELECT doc_id, marker, 'numeric' AS kind, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM targets GROUP BY doc_id, marker""")
def f16(spark, sf):
    m = document.extract_mentions(_docs(spark, sf))
    return m.select("doc_id", "marker", "kind", F.array_join("numbers", ",").alias("numbers"))


@query("j16_bind_citations", _MARKS + "SELECT doc_id, marker, count(*) AS n_targets, count(ref_id) AS n_bound, min(ref_id) AS first_ref, max(ref_id) AS last_ref FROM bound GROUP BY doc_id, marker")
def j16(spark, sf):
    from refledger.plans.queries.base import listed

    b = document.bind_citations(document.extract_mentions(_docs(spark, sf)), listed(spark, sf))
    return b.groupBy("doc_id", "marker").agg(F.count("*").alias("n_targets"), F.count("ref_id").alias("n_bound"),
                                             F.min("ref_id").alias("first_ref"), F.max("ref_id").alias("last_ref"))


@query("j18_uncited_refs", _MARKS + """
SELECT list_id, ref_id, position FROM entries e WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.ref_id = e.ref_id AND b.list_id = e.list_id)""")
def j18(spark, sf):
    from refledger.plans.queries.base import listed

    entries = listed(spark, sf)
    bound = document.bind_citations(document.extract_mentions(_docs(spark, sf)), entries)
    return document.uncited_refs(entries, bound)


@query("j19_unbound_mentions", _MARKS + "SELECT doc_id, list_id, marker FROM bound GROUP BY 1, 2, 3 HAVING count(ref_id) = 0")
def j19(spark, sf):
    from refledger.plans.queries.base import listed

    m = document.extract_mentions(_docs(spark, sf))
    return document.unbound_mentions(m, document.bind_citations(m, listed(spark, sf))).select("doc_id", "list_id", "marker")


@query("g4_key_overlap", _MARKS + "SELECT DISTINCT doc_id, list_id, ref_id FROM bound WHERE ref_id IS NOT NULL")
def g4(spark, sf):
    from refledger.plans.queries.base import listed

    entries, docs = listed(spark, sf), _docs(spark, sf)
    return document.cited_overlap(entries, docs, document.bind_citations(document.extract_mentions(docs), entries))


@query("a10_document_audit", _MARKS + """
, per AS (SELECT doc_id, list_id, count(DISTINCT marker) AS n_citations, count(DISTINCT ref_id) AS n_cited FROM bound GROUP BY 1, 2),
un AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, marker FROM bound GROUP BY 1, 2 HAVING count(ref_id) = 0) GROUP BY 1),
sz AS (SELECT list_id, count(*) AS n_listed FROM entries GROUP BY 1)
SELECT p.doc_id, p.list_id, n_citations, coalesce(un.n, 0) AS n_unbound, n_listed, n_listed - n_cited AS n_uncited, round(n_cited / n_listed::DOUBLE, 2) AS coverage
FROM per p JOIN sz ON sz.list_id = p.list_id LEFT JOIN un ON un.doc_id = p.doc_id""")
def a10(spark, sf):
    from refledger.plans.queries.base import listed

    return document.document_audit(_docs(spark, sf), listed(spark, sf)).drop("n_low_anchor")


@query("a10_document_audit_anchors")
def a10_anchors(spark, sf):
    from refledger.plans.queries.base import listed

    return document.document_audit(_docs(spark, sf), listed(spark, sf)).groupBy("n_low_anchor").agg(F.count("*").alias("n_docs"))


_WORDS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '[a-z0-9一-鿿]{{2,}}'), lambda x: x NOT IN " + in_sql(dict.fromkeys(fv.CONTENT_STOP)) + """),
  lambda w: CASE WHEN length(w) > 4 AND suffix(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND suffix(w, 'ies') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND suffix(w, 'ed') THEN left(w, length(w) - 2)
  WHEN length(w) > 4 AND suffix(w, 'es') THEN left(w, length(w) - 2) WHEN length(w) > 4 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END))"""


@query("a11_anchor_rate", f"""
WITH p AS (SELECT r.ref_id, {_WORDS.format('r.title')} AS tw, {_WORDS.format('d.text')} AS sw FROM fx_refs r JOIN documents d ON d.doc_id = r.ref_id)
SELECT ref_id, round(CASE WHEN len(tw) = 0 THEN 0.0 ELSE len(list_filter(tw, lambda t: len(list_filter(sw, lambda s: s = t OR (least(length(s), length(t)) >= 5 AND (starts_with(s, t) OR starts_with(t, s))))) > 0)) / len(tw)::DOUBLE END, 6) AS rate FROM p""")
def a11(spark, sf):
    from refledger.functions.citations import anchor_rate

    d = view(spark, sf, "documents").select(F.col("doc_id").alias("ref_id"), F.col("text").alias("s"))
    return refs(spark, sf).select("ref_id", "title").join(d, "ref_id").select(
        "ref_id", F.round(anchor_rate(F.col("s"), F.col("title"), F.array().cast("array<string>")), 6).alias("rate"))


def _citations(spark, sf):
    return view(spark, sf, "fx_citations").withColumn("intents", F.array("intent"))


_SAMPLED = """
WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cited_id ORDER BY edge_pos) AS rank FROM fx_citations WHERE coalesce(context, '') <> '') WHERE rank <= 3)
"""


@query("a8_citation_usage", _SAMPLED + """
SELECT c.cited_id, count(*) AS cited_by, round(count(*) FILTER (WHERE coalesce(context, '') <> '') / count(*)::DOUBLE, 2) AS coverage,
  coalesce(max(n_samples), 0) AS n_samples, coalesce(max(n_influential), 0) AS n_influential, coalesce(max(b), 0) AS n_background, coalesce(max(m), 0) AS n_methodology, coalesce(max(r), 0) AS n_result
FROM fx_citations c LEFT JOIN (SELECT cited_id, count(*) AS n_samples, count(*) FILTER (WHERE influential) AS n_influential, count(*) FILTER (WHERE intent = 'background') AS b,
  count(*) FILTER (WHERE intent = 'methodology') AS m, count(*) FILTER (WHERE intent = 'result') AS r FROM s GROUP BY 1) x ON x.cited_id = c.cited_id GROUP BY c.cited_id""")
def a8(spark, sf):
    return document.citation_usage(_citations(spark, sf), "cited_id")


@query("a8_citation_samples", _SAMPLED + "SELECT cited_id, rank, edge_pos, context, influential FROM s")
def a8_samples(spark, sf):
    return document.citation_samples(_citations(spark, sf), "cited_id")


@query("a9_context_divergence", _SAMPLED + """
SELECT cited_id, count(*) AS n_samples, count(*) FILTER (WHERE regexp_matches(context, '(?i)(pas|nicht|ention|una)')) AS n_contrast,
  count(*) FILTER (WHERE regexp_matches(context, '(?i)(pas|nicht|ention|una)')) * 2 >= count(*) AND count(*) FILTER (WHERE regexp_matches(context, '(?i)(pas|nicht|ention|una)')) > 0 AS divergent
FROM s GROUP BY cited_id""")
def a9(spark, sf):
    return document.context_divergence(_citations(spark, sf), "cited_id", pattern=r"(?i)(pas|nicht|ention|una)")


@query("a9_context_divergence_default")
def a9_default(spark, sf):
    return document.context_divergence(_citations(spark, sf), "cited_id")

"""Row-level queries: normal forms, structure, policies, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.fixtures import view
from refledger.functions import citations as ct
from refledger.functions import identifiers as ids
from refledger.functions import people_journals as pj
from refledger.functions import text as tx
from refledger.functions.similarity import bag_bound, length_bound, seq_ratio, title_sim
from refledger.operators import normalise as nz
from refledger.plans.queries.base import (
    NORMAL_SQL, host_sql, in_sql, jaccard_sql, q, query, refs, results, tier_sql, tokens_sql)


@query("p1_normalise_refs", NORMAL_SQL + """
SELECT ref_id, title_key, clean_title, url_key, doi_norm, pmid_norm, arxiv_id, resolved_url, host, tier,
  array_to_string(missing, ',') AS missing FROM norm""")
def p1(spark, sf):
    df = nz.normalise_refs(refs(spark, sf))
    return df.select("ref_id", "title_key", "clean_title", "url_key", "doi_norm", "pmid_norm", "arxiv_id",
                     "resolved_url", "host", "tier", F.array_join("missing", ",").alias("missing"))


@query("p2_missing_fields", NORMAL_SQL + """
SELECT list_id, count(*) FILTER (WHERE len(missing) = 0) AS n_complete,
  count(*) FILTER (WHERE list_contains(missing, 'url')) AS n_no_url,
  count(*) FILTER (WHERE list_contains(missing, 'title')) AS n_no_title FROM norm GROUP BY list_id""")
def p2(spark, sf):
    df = refs(spark, sf)
    m = nz.missing_fields(df)
    return df.select("list_id", m.alias("m")).groupBy("list_id").agg(
        F.count_if(F.size("m") == 0).alias("n_complete"), F.count_if(F.array_contains("m", "url")).alias("n_no_url"),
        F.count_if(F.array_contains("m", "title")).alias("n_no_title"))


STRUCTURAL_SQL = NORMAL_SQL + """, judged AS (SELECT *, CASE WHEN resolved_url IS NULL AND coalesce(arxiv, '') <> '' THEN 'arxiv_malformed'
  WHEN resolved_url IS NULL THEN 'no_identifier' WHEN NOT regexp_matches(resolved_url, '(?i)^https?://') THEN 'url_not_http'
  ELSE 'offline' END AS reason FROM norm)
"""


@query("p3_structural_verdict", STRUCTURAL_SQL + """
SELECT list_id, ref_id, reason, CASE WHEN reason = 'offline' THEN 'partial' ELSE 'invalid' END AS verdict FROM judged""")
def p3(spark, sf):
    return nz.structural_verdict(refs(spark, sf)).select("list_id", "ref_id", "reason", "verdict")


_HTTP_HOST = "lower(regexp_extract(coalesce(url, ''), '(?i)^https?://([^/:?#]+)', 1))"


@query("p4_source_policy", f"""
WITH r AS (SELECT list_id, ref_id, verdict, needs_human, url, {_HTTP_HOST} AS h, {tier_sql(host_sql('url'))} AS t FROM fx_results),
p AS (SELECT *, CASE WHEN h = 'x.com' OR h LIKE '%.x.com' OR h = 'cnki.net' OR h LIKE '%.cnki.net' THEN 'deny_domain'
    WHEN h <> '' AND NOT (h = 'doi.org' OR h LIKE '%.doi.org' OR h = 'nature.com' OR h LIKE '%.nature.com' OR h = 'example.com'
      OR h LIKE '%.example.com') THEN 'not_allowed_domain'
    WHEN h <> '' AND t <> 'journal' THEN 'not_journal' END AS policy_violation FROM r)
SELECT list_id, ref_id, verdict, policy_violation, needs_human OR policy_violation IS NOT NULL AS needs_human FROM p""")
def p4(spark, sf):
    policy = nz.parse_source_policy(
        "journal_only,allow-domain=doi.org|nature.com|example.com,deny-domain=x.com|cnki.net")
    return nz.source_policy(results(spark, sf).drop("policy_violation"), policy).select(
        "list_id", "ref_id", "verdict", "policy_violation", "needs_human")


@query("p5_medical_caveats", """
SELECT medical_caveat, tier, count(*) AS n FROM (SELECT tier, CASE WHEN tier IN ('community', 'social', 'blog') THEN 'medical_weak_source'
  WHEN tier = 'preprint' THEN 'medical_not_peer_reviewed' END AS medical_caveat FROM fx_results) GROUP BY 1, 2""")
def p5(spark, sf):
    return nz.medical_caveats(results(spark, sf)).groupBy("medical_caveat", "tier").agg(F.count("*").alias("n"))


_MEDICAL = "|".join(fv.MEDICAL_JOURNAL_HOSTS)


@query("p6_detect_medical_list", f"""
SELECT list_id, bool_or(s) AS has_pubmed, count(*) FILTER (WHERE h) AS medical_hits,
  bool_or(s) OR count(*) FILTER (WHERE h) >= 2 AS is_medical
FROM (SELECT list_id, pmid IS NOT NULL OR contains(lower(coalesce(url, '')), 'pubmed') AS s,
    regexp_matches(lower(coalesce(url, '')), {q(fv.CN_REGISTRY_HOSTS)})
      OR (regexp_matches({host_sql('url')}, {q(_MEDICAL)}) AND {tier_sql(host_sql('url'))} = 'blog') AS h
  FROM (SELECT list_id, url, CASE WHEN list_id % 2 = 0 THEN pmid END AS pmid FROM fx_refs)) GROUP BY list_id""")
def p6(spark, sf):
    df = refs(spark, sf).withColumn("pmid", F.when(F.col("list_id") % 2 == 0, F.col("pmid")))
    return nz.detect_medical_list(df)


@query("p7_select_unresolved", """
SELECT list_id, ref_id, title, url, doi, pmid, arxiv, source, CAST(year AS VARCHAR) AS year,
  regexp_replace(note, '\\s+', ' ', 'g') AS retry_reason
FROM fx_results WHERE verdict IN ('partial', 'unreachable', 'unverified')""")
def p7(spark, sf):
    return nz.select_unresolved(results(spark, sf))


@query("p8_review_queue", """
SELECT list_id, ref_id, title, verdict, CASE verdict WHEN 'invalid' THEN 'remove or replace the source'
  WHEN 'unreachable' THEN 'open the original link by hand' WHEN 'unverified' THEN 'run again with registries online'
  ELSE 'follow the note' END AS suggested_action
FROM fx_results WHERE needs_human OR verdict IN ('invalid', 'unverified')""")
def p8(spark, sf):
    return nz.review_queue(results(spark, sf))


@query("p9_citable", """
SELECT list_id, ref_id, verdict FROM fx_results WHERE verdict = 'verified'
  OR (verdict = 'partial' AND doi_matched AND doi_adjust = '' AND csl_title IS NOT NULL)""")
def p9(spark, sf):
    return nz.citable(results(spark, sf)).select("list_id", "ref_id", "verdict")


@query("p10_error_codes", """
SELECT list_id, ref_id, array_to_string(list_filter([
  CASE WHEN doi_state = 'not_found' THEN 'E_DOI_NOT_FOUND' END,
  CASE WHEN coalesce(doi_state, '') <> 'not_found' AND doi_adjust = 'invalid' THEN 'E_TITLE_MISMATCH' END,
  CASE WHEN cross_language THEN 'E_CROSS_LANG' END, CASE WHEN stitched THEN 'E_STITCHED' END,
  CASE WHEN arxiv_state IN ('not_found', 'error') THEN 'E_ARXIV_NOT_FOUND' END,
  CASE WHEN pmid_state = 'not_found' THEN 'E_PMID_NOT_FOUND' END, CASE WHEN retracted THEN 'E_RETRACTED' END,
  CASE WHEN retraction_nature = 'expression_of_concern' THEN 'E_EXPRESSION_OF_CONCERN' END,
  CASE WHEN author_mismatch THEN 'E_AUTHOR_MISMATCH' END, CASE WHEN journal_mismatch THEN 'E_JOURNAL_MISMATCH' END,
  CASE WHEN verdict = 'unreachable' THEN 'E_UNREACHABLE' END, CASE WHEN offline THEN 'E_OFFLINE' END], lambda x: x IS NOT NULL), ',') AS codes
FROM fx_results""")
def p10(spark, sf):
    return nz.error_codes(results(spark, sf)).select("list_id", "ref_id", F.array_join("error_codes", ",").alias("codes"))


@query("p11_evidence_steps", """
WITH s AS (SELECT list_id, ref_id, verdict, array_to_string(list_filter([
  CASE WHEN doi_matched THEN 'doi_record_agrees' WHEN coalesce(doi, '') <> '' AND doi_state IS NOT NULL THEN 'doi_record_not_confirmed' END,
  CASE WHEN arxiv_matched THEN 'arxiv_record_agrees' END, CASE WHEN s2_matched THEN 'second_index_confirms' END,
  CASE WHEN retracted THEN 'retraction_found' END, CASE WHEN openalex_confirmed THEN 'openalex_confirms' END,
  CASE WHEN reachable THEN 'page_reachable' END, CASE WHEN archive_url IS NOT NULL THEN 'archive_available' END], lambda x: x IS NOT NULL), ',') AS e
  FROM fx_results)
SELECT list_id, ref_id, CASE WHEN e = '' THEN 'no_check_recorded' ELSE e END AS evidence,
  CASE verdict WHEN 'verified' THEN 'cite it' WHEN 'partial' THEN 'cite with reservations or review first'
    WHEN 'unreachable' THEN 'compare the archived copy' WHEN 'invalid' THEN 'do not cite; replace'
    WHEN 'unverified' THEN 'run again with registries online' END AS action FROM s""")
def p11(spark, sf):
    return nz.evidence_steps(results(spark, sf)).select(
        "list_id", "ref_id", F.array_join("evidence", ",").alias("evidence"), "action")


@query("p12_export_completeness", """
SELECT list_id, ref_id, CASE WHEN verdict = 'verified' AND csl_title IS NOT NULL THEN
    (CASE WHEN csl_families IS NOT NULL THEN 30 ELSE 0 END) + (CASE WHEN coalesce(csl_container, '') <> '' THEN 20 ELSE 0 END)
    + (CASE WHEN csl_year IS NOT NULL THEN 20 ELSE 0 END) + (CASE WHEN coalesce(csl_volume, '') <> '' THEN 10 ELSE 0 END)
    + (CASE WHEN coalesce(csl_issue, '') <> '' THEN 10 ELSE 0 END) + (CASE WHEN coalesce(csl_page, '') <> '' THEN 10 ELSE 0 END) END AS completeness,
  CASE WHEN verdict = 'verified' AND csl_title IS NOT NULL THEN array_to_string(list_filter([
    CASE WHEN csl_families IS NULL THEN 'authors' END, CASE WHEN coalesce(csl_container, '') = '' THEN 'container' END,
    CASE WHEN csl_year IS NULL THEN 'year' END, CASE WHEN coalesce(csl_volume, '') = '' THEN 'volume' END,
    CASE WHEN coalesce(csl_issue, '') = '' THEN 'issue' END, CASE WHEN coalesce(csl_page, '') = '' THEN 'page' END], lambda x: x IS NOT NULL), ',') END AS missing
FROM fx_results""")
def p12(spark, sf):
    return nz.export_completeness(results(spark, sf)).select(
        "list_id", "ref_id", "completeness", F.array_join("completeness_missing", ",").alias("missing"))


def _with_semantic(spark, sf):
    s = F.struct(
        F.concat(F.lit("claim "), F.col("ref_id").cast("string")).alias("claim"), F.col("support").alias("support"),
        F.lit(" ").alias("quote"), F.when(F.col("ref_id") % 4 == 0, F.lit(" own note ")).alias("note"))
    return results(spark, sf).withColumn("semantic", F.when(F.col("ref_id") % 10 != 9, s))


_AUDIT = f"""
WITH a AS (SELECT list_id, ref_id, verdict, needs_human, ref_id % 10 <> 9 AS has_audit, lower(coalesce(support, '')) AS raw,
  CASE WHEN ref_id % 4 = 0 THEN 'own note' END AS own FROM fx_results),
b AS (SELECT *, CASE WHEN has_audit THEN CASE WHEN raw IN {in_sql(fv.SUPPORT_VALUES)} THEN raw ELSE 'unclear' END END AS support,
  CASE WHEN has_audit THEN concat_ws('; ', CASE WHEN raw <> '' AND raw NOT IN {in_sql(fv.SUPPORT_VALUES)} THEN concat('unknown support: ', raw) END, own) END AS note FROM a)
"""


@query("p13_semantic_audit", _AUDIT + """
SELECT list_id, ref_id, CASE WHEN has_audit THEN concat('claim ', CAST(ref_id AS VARCHAR)) END AS claim, support, note FROM b""")
def p13(spark, sf):
    a = F.col("semantic_audit")
    return nz.semantic_audit(_with_semantic(spark, sf)).select(
        "list_id", "ref_id", a["claim"].alias("claim"), a["support"].alias("support"), a["note"].alias("note"))


@query("p14_semantic_cap", _AUDIT + """
, c AS (SELECT *, coalesce(support IN ('not_in_source', 'contradicted'), false) AND verdict <> 'invalid' AS capped FROM b)
SELECT list_id, ref_id, CASE WHEN capped AND verdict = 'verified' THEN 'partial' ELSE verdict END AS verdict,
  needs_human OR capped AS needs_human, capped AS semantic_capped FROM c""")
def p14(spark, sf):
    df = nz.semantic_cap(nz.semantic_audit(_with_semantic(spark, sf)))
    return df.select("list_id", "ref_id", "verdict", "needs_human", "semantic_capped")


# --- scalar functions over whole tables ---------------------------------------------------------------

@query("f3_f5_landing_urls", f"""
SELECT page_id, {host_sql('url')} AS host, {tier_sql(host_sql('url'), True)} AS tier,
  lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)', 1)) || rtrim(substr(u, length(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)', 1)) + 1), '/') AS url_key
FROM (SELECT *, regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '') AS u FROM pages)""")
def f3_f5(spark, sf):
    p = view(spark, sf, "pages")
    return p.select("page_id", ids.host_of(F.col("url")).alias("host"), ids.source_tier(F.col("url"), True).alias("tier"),
                    ids.normalise_url(F.col("url")).alias("url_key"))


#: Texts of other writing systems and the script each one is of.
_SCRIPTS = [("Журнал истории", "cyrillic"), ("深度学习方法", "han"), ("歴史のノート", "kana"), ("1984 - 2001", "none")]
_TIMES = "(doc_id % 9) * (doc_id % 9) * 12"


@query("f8_script_family", f"""
WITH t AS (SELECT doc_id, {_TIMES} AS times, len(regexp_extract_all(coalesce(text, ''), '\\p{{L}}')) AS own,
  CASE doc_id % 5 {" ".join(f"WHEN {i} THEN {sum(c.isalpha() for c in sample)}" for i, (sample, _) in enumerate(_SCRIPTS, 1))} ELSE 0 END AS letters,
  CASE doc_id % 5 {" ".join(f"WHEN {i} THEN {q(name)}" for i, (_, name) in enumerate(_SCRIPTS, 1))} END AS added FROM documents)
SELECT doc_id, CASE WHEN times > 0 AND added = 'kana' THEN 'kana' WHEN own + times * letters = 0 THEN 'none'
  WHEN times * letters > own THEN added ELSE 'latin' END AS script FROM t""")
def f8(spark, sf):
    """Every document's own text, with more or less text of another script behind it."""
    other = F.lit("")
    for i, (sample, _) in enumerate(_SCRIPTS, 1):
        other = F.when(F.col("doc_id") % 5 == i, F.lit(sample)).otherwise(other)
    text = F.concat(F.coalesce("text", F.lit("")), F.expr("repeat(other, cast(" + _TIMES + " as int))"))
    return view(spark, sf, "documents").withColumn("other", other).select("doc_id", tx.script_family(text).alias("script"))


@query("f9_seq_ratio")
def f9(spark, sf):
    """Exact ratio of every claimed title against its DOI record, with both native bounds."""
    r = refs(spark, sf).select("ref_id", F.lower("doi").alias("doi"), F.lower("title").alias("a"))
    w = view(spark, sf, "fx_works").select(F.lower("doi").alias("doi"), F.lower("title").alias("b"))
    j = r.join(w, "doi")
    return j.select("ref_id", F.round(seq_ratio(F.col("a"), F.col("b")), 6).alias("ratio"),
                    F.round(title_sim(F.col("a"), F.col("b")), 6).alias("title_sim"),
                    F.round(length_bound(F.col("a"), F.col("b")), 6).alias("length_bound"),
                    F.round(bag_bound(F.col("a"), F.col("b")), 6).alias("bag_bound"))


@query("f10_ratio_bounds", """
WITH p AS (SELECT r.ref_id, lower(r.title) AS a, lower(w.title) AS b FROM fx_records r JOIN fx_works w ON lower(w.doi) = lower(r.doi)),
ch AS (SELECT ref_id, c, count(*) AS n FROM (SELECT ref_id, unnest(string_split(a, '')) AS c FROM p) WHERE c <> '' GROUP BY 1, 2),
dh AS (SELECT ref_id, c, count(*) AS n FROM (SELECT ref_id, unnest(string_split(b, '')) AS c FROM p) WHERE c <> '' GROUP BY 1, 2),
s AS (SELECT ch.ref_id, sum(least(ch.n, dh.n)) AS m FROM ch JOIN dh ON ch.ref_id = dh.ref_id AND ch.c = dh.c GROUP BY 1)
SELECT p.ref_id, round(CASE WHEN length(a) + length(b) > 0 THEN 2.0::DOUBLE * least(length(a), length(b)) / (length(a) + length(b)) ELSE 1.0 END, 6) AS length_bound,
  round(CASE WHEN length(a) + length(b) > 0 THEN 2.0::DOUBLE * coalesce(m, 0)::DOUBLE / (length(a) + length(b)) ELSE 1.0 END, 6) AS bag_bound
FROM p LEFT JOIN s ON s.ref_id = p.ref_id""")
def f10(spark, sf):
    r = refs(spark, sf).select("ref_id", F.lower("doi").alias("doi"), F.lower("title").alias("a"))
    w = view(spark, sf, "fx_works").select(F.lower("doi").alias("doi"), F.lower("title").alias("b"))
    return r.join(w, "doi").select(
        "ref_id", F.round(length_bound(F.col("a"), F.col("b")), 6).alias("length_bound"),
        F.round(bag_bound(F.col("a"), F.col("b")), 6).alias("bag_bound"))


_TA = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in fv.CN_JOURNAL_TA.items())


@query("f12_f14_journals", f"""
WITH p AS (SELECT r.ref_id, CASE WHEN r.ref_id % 3 = 0 THEN {q(next(iter(fv.CN_JOURNAL_TA)))} WHEN r.ref_id % 3 = 1 THEN {q(list(fv.CN_JOURNAL_TA)[3])} ELSE r.source END AS s, concat('Journal of ', w.container) AS c FROM fx_records r JOIN fx_csl w ON w.doi = r.doi),
t AS (SELECT *, list_transform(regexp_extract_all(lower(s), '[a-z0-9]+|[一-鿿]'), lambda x: x[1]) AS si,
  list_transform(regexp_extract_all(lower(c), '[a-z0-9]+|[一-鿿]'), lambda x: x[1]) AS ci FROM p)
SELECT ref_id, contains(regexp_replace(lower(c), '[^a-z0-9]+', '', 'g'), regexp_replace(lower(s), '[^a-z0-9]+', '', 'g'))
    OR array_to_string(ci, '') LIKE concat('%', array_to_string(si, '%'), '%')
    OR array_to_string(si, '') LIKE concat('%', array_to_string(ci, '%'), '%') AS same_journal,
  CASE s {_TA} ELSE s END AS ta FROM t""")
def f12_f14(spark, sf):
    names = list(fv.CN_JOURNAL_TA)
    source = F.when(F.col("ref_id") % 3 == 0, F.lit(names[0])).when(F.col("ref_id") % 3 == 1, F.lit(names[3])).otherwise(F.col("source"))
    r = refs(spark, sf).select("ref_id", "doi", source.alias("source"))
    w = view(spark, sf, "fx_csl").select("doi", F.concat(F.lit("Journal of "), F.col("container")).alias("c"))
    return r.join(w, "doi").select("ref_id", pj.journal_same(F.col("source"), F.col("c")).alias("same_journal"),
                                   pj.journal_ta(F.col("source")).alias("ta"))


@query("f13_author_consistent", """
WITH p AS (SELECT r.ref_id, list_filter(list_transform(string_split(coalesce(r.authors, ''), ','), lambda x: regexp_extract(trim(x), '^(\\S+)', 1)), lambda x: x <> '') AS a,
  string_split(w.families, '|') AS b FROM fx_records r JOIN fx_csl w ON w.doi = r.doi),
k AS (SELECT ref_id, list_filter(list_transform(a, lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS a,
  list_filter(list_transform(coalesce(b, []), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS b FROM p),
h AS (SELECT DISTINCT ref_id FROM (SELECT ref_id, x, unnest(b) AS y FROM (SELECT ref_id, unnest(a) AS x, b FROM k))
  WHERE x = y OR (length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x))))
SELECT k.ref_id, len(a) = 0 OR len(b) = 0 OR h.ref_id IS NOT NULL AS consistent FROM k LEFT JOIN h ON h.ref_id = k.ref_id""")
def f13(spark, sf):
    r = refs(spark, sf).select("ref_id", "doi", "authors")
    w = view(spark, sf, "fx_csl").select("doi", F.split("families", r"\|").alias("families"))
    return r.join(w, "doi").select(
        "ref_id", pj.author_consistent(pj.surnames(F.col("authors")), F.col("families")).alias("consistent"))


@query("f15_retraction_class", """
SELECT line_no, CASE WHEN t IN ('retraction', 'retraction_notice', 'retract_and_republish', 'retraction_of_publication') THEN 'retraction'
  WHEN t IN ('partial_retraction', 'partial_retraction_notice') THEN 'partial_retraction'
  WHEN t IN ('withdraw', 'withdrawal', 'remove', 'removal') THEN 'withdrawal'
  WHEN t IN ('expression_of_concern', 'expressions_of_concern') THEN 'expression_of_concern'
  WHEN t IN ('correction', 'erratum', 'corrigendum', 'amendment') THEN 'correction' ELSE t END AS class
FROM (SELECT line_no, replace(replace(lower(trim(nature)), '-', '_'), ' ', '_') AS t FROM fx_notices)""")
def f15(spark, sf):
    return view(spark, sf, "fx_notices").select("line_no", ids.retraction_class(F.col("nature")).alias("class"))


_STOP = in_sql(dict.fromkeys(fv.CONTENT_STOP))


@query("f17_content_words", f"""
WITH w AS (SELECT ref_id, unnest(regexp_extract_all(lower(title), '[a-z0-9一-鿿]{{2,}}')) AS w FROM fx_refs),
s AS (SELECT DISTINCT ref_id, CASE WHEN length(w) > 4 AND suffix(w, 'ing') THEN left(w, length(w) - 3) WHEN length(w) > 4 AND suffix(w, 'ies') THEN left(w, length(w) - 3)
  WHEN length(w) > 4 AND suffix(w, 'ed') THEN left(w, length(w) - 2) WHEN length(w) > 4 AND suffix(w, 'es') THEN left(w, length(w) - 2)
  WHEN length(w) > 4 AND suffix(w, 's') THEN left(w, length(w) - 1) ELSE w END AS word FROM w WHERE w NOT IN {_STOP})
SELECT word, count(*) AS n_titles FROM s GROUP BY word""")
def f17(spark, sf):
    words = refs(spark, sf).select(F.explode(ct.content_words(F.col("title"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n_titles"))


@query("f18_doi_normal_form", """
SELECT d AS doi, count(*) AS n FROM (SELECT trim(regexp_replace(regexp_replace(lower(CASE ref_id % 4 WHEN 0 THEN concat('https://doi.org/', doi)
  WHEN 1 THEN concat('DOI:', doi) WHEN 2 THEN concat('doi.org/', upper(doi)) ELSE doi END), '^(https?://)?doi\\.org/', ''), '^doi:', '')) AS d
  FROM fx_refs WHERE doi IS NOT NULL) GROUP BY d""")
def f18(spark, sf):
    raw = F.when(F.col("ref_id") % 4 == 0, F.concat(F.lit("https://doi.org/"), "doi")).when(
        F.col("ref_id") % 4 == 1, F.concat(F.lit("DOI:"), "doi")).when(
        F.col("ref_id") % 4 == 2, F.concat(F.lit("doi.org/"), F.upper("doi"))).otherwise(F.col("doi"))
    return refs(spark, sf).filter("doi is not null").groupBy(ids.doi_normal_form(raw).alias("doi")).agg(F.count("*").alias("n"))


@query("f19_chunks", """
SELECT doc_id, CAST(i AS INTEGER) AS chunk, md5(substr(text, i * 780 + 1, 900)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 780.0)::BIGINT)) AS i FROM documents)""")
def f19(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.posexplode(ct.chunks(F.col("text"))).alias("chunk", "piece"))
    return d.select("doc_id", "chunk", F.md5(F.col("piece").cast("binary")).alias("digest"))


@query("f20_cache_key")
def f20(spark, sf):
    from refledger.streaming.jobs import with_cache_key

    return with_cache_key(refs(spark, sf)).groupBy("cache_key").agg(F.count("*").alias("n"))


@query("f21_safe_cells", """
SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+@\\t\\r-]') THEN concat('''', c) ELSE c END AS csv_cell,
  replace(replace(replace(replace(c, '{', ''), '}', ''), chr(10), ' '), chr(13), ' ') AS bib_value,
  replace(replace(replace(c, chr(10), ' '), chr(13), ' '), '|', chr(92) || '|') AS md_value
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('=', text) WHEN 1 THEN concat('@{', text, '}') ELSE text END AS c FROM documents)""")
def f21(spark, sf):
    c = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("="), "text")).when(
        F.col("doc_id") % 5 == 1, F.concat(F.lit("@{"), "text", F.lit("}"))).otherwise(F.col("text"))
    return view(spark, sf, "documents").select(
        "doc_id", tx.csv_safe(c).alias("csv_cell"), tx.bib_safe(c).alias("bib_value"), tx.md_cell(c).alias("md_value"))


@query("f22_year_of", """
SELECT event_id, TRY_CAST(nullif(regexp_extract(concat('day ', strftime(ts, '%d/%m/%Y')), '((?:19|20)\\d{2})', 1), '') AS INTEGER) AS y FROM events""")
def f22(spark, sf):
    return view(spark, sf, "events").select(
        "event_id", tx.year_of(F.concat(F.lit("day "), F.date_format("ts", "dd/MM/yyyy"))).alias("y"))


@query("f23_non_public_host", f"""
SELECT page_id, regexp_matches(regexp_replace(rtrim({host_sql('u')}, '.'), '[\\[\\]]', '', 'g'), {q(fv.PRIVATE_HOST)}) AS private
FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN concat('http://10.0.', CAST(page_id % 256 AS VARCHAR), '.7/x') WHEN 1 THEN
  concat('http://172.', CAST(page_id % 40 AS VARCHAR), '.0.1/') ELSE url END AS u FROM pages)""")
def f23(spark, sf):
    u = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("http://10.0."), (F.col("page_id") % 256).cast("string"), F.lit(".7/x"))).when(
        F.col("page_id") % 5 == 1, F.concat(F.lit("http://172."), (F.col("page_id") % 40).cast("string"), F.lit(".0.1/"))).otherwise(F.col("url"))
    return view(spark, sf, "pages").select("page_id", ids.non_public_host(u).alias("private"))


@query("g3_jaccard_tokens", f"""
SELECT ref_id, round({jaccard_sql('ta', 'tb')}, 6) AS jaccard FROM (SELECT r.ref_id, {tokens_sql('r.title')} AS ta, {tokens_sql('w.title')} AS tb
  FROM fx_refs r JOIN fx_works w ON w.doi = r.doi)""")
def g3(spark, sf):
    w = view(spark, sf, "fx_works").select("doi", F.col("title").alias("t"))
    return refs(spark, sf).join(w, "doi").select("ref_id", F.round(tx.token_sim(F.col("title"), F.col("t")), 6).alias("jaccard"))


_ALIAS = in_sql(fv.ALIAS_STOP_LANDING)
_ALIAS_API = in_sql(fv.ALIAS_STOP_API)


@query("g2_token_subset", f"""
WITH p AS (SELECT r.ref_id, list_filter({tokens_sql('r.title')}, lambda x: length(x) >= 2 AND x NOT IN {_ALIAS}) AS a,
  list_filter({tokens_sql('w.title')}, lambda x: length(x) >= 2 AND x NOT IN {_ALIAS}) AS b,
  list_filter(list_distinct(regexp_extract_all(lower(r.title), '[0-9a-z]+')), lambda x: x NOT IN {_ALIAS_API}) AS la,
  list_filter(list_distinct(regexp_extract_all(lower(w.title), '[0-9a-z]+')), lambda x: x NOT IN {_ALIAS_API}) AS lb
  FROM fx_refs r JOIN fx_works w ON w.doi = r.doi)
SELECT ref_id, len(a) >= 2 AND len(b) >= 1 AND (list_has_all(b, a) OR list_has_all(a, b)) AS landing_alias,
  len(la) >= 2 AND list_has_all(lb, la) AS api_alias FROM p""")
def g2(spark, sf):
    w = view(spark, sf, "fx_works").select("doi", F.col("title").alias("t"))
    return refs(spark, sf).join(w, "doi").select(
        "ref_id", tx.alias_of_landing(F.col("title"), F.col("t")).alias("landing_alias"),
        tx.alias_of_api(F.col("title"), F.col("t")).alias("api_alias"))

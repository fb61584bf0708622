"""The whole batch as one query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.fixtures import view, written_refs
from refledger.functions.similarity import TOKEN
from refledger.operators import normalise
from refledger.plans.batch import Batch, verify_batch
from refledger.plans.queries.base import in_sql, q, query, registries, title_key_sql, url_key_sql
from refledger.plans.queries.joins import VERIFY_SQL
from refledger.plans.queries.lists import SCORE_SQL

POLICY = "deny-domain=github.com|blog.example.org"


def _batch(spark, sf) -> Batch:
    written = written_refs(spark, sf)
    b = view(spark, sf, "fx_batch", written)
    semantic = F.when(F.col("support").isNotNull(), F.struct(
        F.concat(F.lit("claim "), F.col("ref_id").cast("string")).alias("claim"), "support",
        F.lit("").alias("quote"), F.lit(None).cast("string").alias("note")))
    reg = replace(registries(spark, sf, with_pages=False, written=written), citations=view(spark, sf, "fx_cites", written))
    screen = view(spark, sf, "fx_votes").select(
        "ref_id", F.when(F.col("judge") == "SUPPORTS", "SUPPORTS").otherwise("REFUTES").alias("label"), "prob")
    return verify_batch(b.withColumn("semantic", semantic).drop("support"), reg, view(spark, sf, "fx_votes").filter("ref_id % 2 = 0"),
                        screen, normalise.parse_source_policy(POLICY), model=TOKEN)


_DENIED = " OR ".join(f"h = {q(d)} OR suffix(h, {q('.' + d)})" for d in ("github.com", "blog.example.org"))
_CODES = """array_to_string(list_filter([CASE WHEN doi_state = 'not_found' THEN 'E_DOI_NOT_FOUND' END,
  CASE WHEN coalesce(doi_state, '') <> 'not_found' AND doi_adjust = 'invalid' THEN 'E_TITLE_MISMATCH' END, CASE WHEN stitched THEN 'E_STITCHED' END,
  CASE WHEN arxiv_state IN ('not_found', 'error') THEN 'E_ARXIV_NOT_FOUND' END, CASE WHEN pmid_state = 'not_found' THEN 'E_PMID_NOT_FOUND' END,
  CASE WHEN retracted THEN 'E_RETRACTED' END, CASE WHEN retraction_nature = 'expression_of_concern' THEN 'E_EXPRESSION_OF_CONCERN' END,
  CASE WHEN author_mismatch THEN 'E_AUTHOR_MISMATCH' END, CASE WHEN journal_mismatch THEN 'E_JOURNAL_MISMATCH' END,
  CASE WHEN verdict = 'unreachable' THEN 'E_UNREACHABLE' END], lambda x: x IS NOT NULL), ',')"""

# every stage as SQL over the verdict's own tables
BATCH_SQL = ("WITH RECURSIVE " + VERIFY_SQL.strip()[5:]).replace("FROM fx_records", "FROM fx_batch") + f""",
chk AS (SELECT u.list_id, u.ref_id, v.rule, v.verdict, v.needs_human, u.title, u.resolved_url, u.doi, u.pmid, u.arxiv_id, u.support, u.doi_norm AS wkey,
    doi_state, doi_adjust, stitched, arxiv_state, pmid_state, retracted, retraction_nature, author_mismatch, journal_mismatch
  FROM ru u JOIN va v ON v.ref_id = u.ref_id
  UNION ALL SELECT l.list_id, l.ref_id, v.rule, v.verdict, v.needs_human, l.title, l.resolved_url, CASE WHEN v.rule = 8 THEN coalesce(l.doi, l.anchor) ELSE l.doi END,
    CASE WHEN v.rule = 3 THEN coalesce(l.pmid, l.r_id) WHEN v.rule = 5 THEN coalesce(l.pmid, l.l_pmid) ELSE l.pmid END, l.arxiv_id, l.support, l.anchor,
    doi_state, doi_adjust, false, NULL, NULL, coalesce(c.nature IN ('retraction', 'partial_retraction', 'withdrawal'), false), c.nature, author_mismatch, journal_mismatch
  FROM l4 l JOIN vb v ON v.ref_id = l.ref_id LEFT JOIN notice_class c ON c.doi = l.anchor),
sg AS MATERIALIZED (SELECT list_id, ref_id, {title_key_sql("coalesce(title, '')")} AS sig, resolved_url AS url, lower(coalesce(doi, '')) AS doi, pmid FROM chk),
keys AS MATERIALIZED (SELECT * FROM (SELECT list_id, ref_id, 1 AS r, 'url' AS kind, concat('url|', {url_key_sql('url')}, '|', sig) AS key FROM sg WHERE url IS NOT NULL AND sig <> ''
  UNION ALL SELECT list_id, ref_id, 2, 'doi', concat('doi|', doi, '|', sig) FROM sg WHERE doi <> '' AND sig <> ''
  UNION ALL SELECT list_id, ref_id, 3, 'pmid', concat('pmid|', pmid, '|', sig) FROM sg WHERE pmid IS NOT NULL AND sig <> '')),
flat AS MATERIALIZED (SELECT s.list_id, s.ref_id, row_number() OVER (PARTITION BY s.list_id ORDER BY s.ref_id) AS pos,
    list(k.key ORDER BY k.r) FILTER (WHERE k.key IS NOT NULL) AS ks, list(k.kind ORDER BY k.r) FILTER (WHERE k.key IS NOT NULL) AS kd
  FROM sg s LEFT JOIN keys k ON k.ref_id = s.ref_id GROUP BY 1, 2),
step AS (SELECT list_id, 0::BIGINT AS pos, NULL::BIGINT AS ref_id, MAP([]::VARCHAR[], []::BIGINT[]) AS seen, NULL::BIGINT AS dup_of, NULL::VARCHAR AS dup_kind FROM (SELECT DISTINCT list_id FROM sg)
  UNION ALL SELECT f.list_id, f.pos, f.ref_id, CASE WHEN h.i IS NULL AND f.ks IS NOT NULL THEN map_concat(s.seen, map_from_entries(list_transform(f.ks, lambda x: {{'k': x, 'v': f.ref_id}}))) ELSE s.seen END,
    CASE WHEN h.i IS NOT NULL THEN s.seen[f.ks[h.i]] END, f.kd[h.i]
  FROM step s JOIN flat f ON f.list_id = s.list_id AND f.pos = s.pos + 1
  CROSS JOIN LATERAL (SELECT min(i) AS i FROM unnest(range(1, coalesce(len(f.ks), 0) + 1)) t(i) WHERE map_contains(s.seen, f.ks[i])) h),
tw AS MATERIALIZED (SELECT * FROM sg WHERE length(sig) >= 8 AND doi <> ''),
cl AS (SELECT a.list_id, a.ref_id, count(*) FILTER (WHERE a.sig = b.sig AND a.doi <> b.doi) AS cd,
    count(*) FILTER (WHERE a.doi = b.doi AND a.sig <> b.sig AND abs(length(a.sig) - length(b.sig)) <= greatest(length(a.sig), length(b.sig)) * {fv.CLONE_LENGTH_GAP}) AS ct
  FROM tw a JOIN tw b ON a.list_id = b.list_id AND a.ref_id <> b.ref_id AND (a.sig = b.sig OR a.doi = b.doi) GROUP BY 1, 2),
pub AS (SELECT arxiv_key, doi AS published_doi, row_number() OVER (PARTITION BY arxiv_key ORDER BY paper_id) AS rn FROM fx_s2 WHERE arxiv_key IS NOT NULL AND coalesce(doi, '') <> ''),
b1 AS (SELECT c.*, s.dup_of AS duplicate_of, s.dup_kind AS duplicate_kind, coalesce(cl.cd, 0) AS n_clone_doi, coalesce(cl.ct, 0) AS n_clone_title,
    CASE WHEN s.dup_of IS NOT NULL AND c.verdict = 'verified' THEN 'partial' ELSE c.verdict END AS v1
  FROM chk c LEFT JOIN step s ON s.ref_id = c.ref_id LEFT JOIN cl ON cl.ref_id = c.ref_id),
b2 AS (SELECT b.*, p.published_doi, CASE WHEN v1 = 'verified' AND w.title IS NOT NULL THEN (CASE WHEN coalesce(w.families, '') <> '' THEN 30 ELSE 0 END)
    + (CASE WHEN coalesce(w.container, '') <> '' THEN 20 ELSE 0 END) + (CASE WHEN coalesce(w.year, 0) <> 0 THEN 20 ELSE 0 END) + (CASE WHEN coalesce(w.volume, '') <> '' THEN 10 ELSE 0 END)
    + (CASE WHEN coalesce(w.issue, '') <> '' THEN 10 ELSE 0 END) + (CASE WHEN coalesce(w.page, '') <> '' THEN 10 ELSE 0 END) END AS completeness,
    coalesce(support IN {in_sql(fv.SUPPORT_CAPPED)}, false) AND v1 <> 'invalid' AS semantic_capped
  FROM b1 b LEFT JOIN pub p ON p.rn = 1 AND v1 = 'verified' AND coalesce(b.doi, '') = '' AND p.arxiv_key = lower(regexp_replace(b.arxiv_id, '(?i)v\\d+$', ''))
  LEFT JOIN fx_csl w ON lower(w.doi) = b.wkey AND w.lookup_status = 'hit'),
b3 AS (SELECT * EXCLUDE (verdict, needs_human), CASE WHEN semantic_capped AND v1 = 'verified' THEN 'partial' ELSE v1 END AS verdict, needs_human OR semantic_capped AS nh FROM b2),
b4 AS (SELECT b3.*, {_CODES} AS codes, support IN ('not_in_source', 'unclear') AND verdict <> 'invalid' AS pend,
    v.judge AS vj, CASE v.nli WHEN 'entailment' THEN 'SUPPORTS' WHEN 'contradiction' THEN 'CONTRADICTS' WHEN 'neutral' THEN 'NEI' END AS vn,
    o.label, o.prob, length(trim(coalesce(title, ''))) AS tl,
    lower(regexp_extract(coalesce(resolved_url, ''), '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS h
  FROM b3 LEFT JOIN (SELECT * FROM fx_votes WHERE ref_id % 2 = 0) v ON v.ref_id = b3.ref_id
  LEFT JOIN (SELECT ref_id, CASE judge WHEN 'SUPPORTS' THEN 'SUPPORTS' ELSE 'REFUTES' END AS label, prob FROM fx_votes) o ON o.ref_id = b3.ref_id),
b5 AS (SELECT *, coalesce(pend, false) AND vj IS NOT NULL AND (regexp_matches(coalesce(pmid, ''), {q(fv.PMID)}) OR regexp_matches(coalesce(arxiv_id, ''), '\\d{{4}}\\.\\d{{4,5}}')) AS judged FROM b4),
b6 AS (SELECT *, CASE WHEN judged THEN vj END AS judge, CASE WHEN judged THEN CASE WHEN vn IS NULL THEN 'single' WHEN vn = vj THEN 'high' ELSE 'contested' END END AS confidence,
    CASE WHEN judged THEN CASE WHEN label IS NULL OR tl < 20 THEN 0 WHEN label = 'REFUTES' AND prob >= 0.95 THEN 2 ELSE 1 END END AS priority,
    CASE WHEN coalesce(pend, false) AND tl >= 20 AND NOT judged THEN coalesce(label = 'SUPPORTS' AND prob >= 0.95, false) END AS leans_support,
    CASE WHEN {_DENIED} THEN 'deny_domain' END AS policy_violation FROM b5),
ct AS (SELECT lower(cited_doi) AS cd, count(*) AS cited_by, min_by(citing_title, edge_pos) FILTER (WHERE coalesce(context, '') <> '') AS citing_title FROM fx_cites GROUP BY 1),
batch AS MATERIALIZED (SELECT b6.*, ct.cited_by, ct.citing_title, nh OR coalesce(judged AND (vj = 'CONTRADICTS' OR confidence = 'contested'), false) OR policy_violation IS NOT NULL AS needs_human
  FROM b6 LEFT JOIN ct ON b6.rule IN (18, 19) AND ct.cd = b6.wkey)
"""


@query("v2_verify_batch", BATCH_SQL + """
SELECT list_id, ref_id, rule, verdict, needs_human, duplicate_of, duplicate_kind, n_clone_doi, n_clone_title, published_doi, completeness, semantic_capped,
  codes, judge, confidence, priority, leans_support, policy_violation, cited_by, citing_title FROM batch""")
def v2(spark, sf):
    r = _batch(spark, sf).results
    return r.select(
        "list_id", "ref_id", "rule", "verdict", "needs_human", "duplicate_of", "duplicate_kind",
        F.coalesce("clone_doi_partners", F.lit(0)).cast("bigint").alias("n_clone_doi"),
        F.coalesce("clone_title_partners", F.lit(0)).cast("bigint").alias("n_clone_title"), "published_doi", "completeness",
        "semantic_capped", F.array_join("error_codes", ",").alias("codes"), "judge", "confidence", "priority", "leans_support",
        "policy_violation", "cited_by", "citing_title")


@query("v2_batch_scorecard", BATCH_SQL + SCORE_SQL.format(src="(SELECT * FROM batch)").strip().replace("WITH c AS", ", c AS", 1) + f"""
SELECT list_id, total, {', '.join(f'n_{v}' for v in fv.VERDICTS)}, score, grade FROM card""")
def v2_scorecard(spark, sf):
    return _batch(spark, sf).scorecard

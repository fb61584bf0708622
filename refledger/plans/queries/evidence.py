"""Evidence passages and judgements."""

from __future__ import annotations

from pyspark.sql import functions as F

from refledger.fixtures import view
from refledger.operators import evidence
from refledger.plans.queries.base import query, results

_TOK = "regexp_extract_all(lower({}), '[a-z0-9一-鿿]+')"


_TFIDF = f"""
WITH ch AS (SELECT doc_id, i AS chunk, substr(text, i * 780 + 1, 900) AS p FROM (SELECT doc_id, text, unnest(range(0, ceil(length(text) / 780.0)::BIGINT)) AS i FROM documents)),
nn AS (SELECT doc_id, count(*) AS n FROM ch GROUP BY 1),
tok AS (SELECT doc_id, chunk, t, count(*) AS tf FROM (SELECT doc_id, chunk, unnest({_TOK.format('p')}) AS t FROM ch) GROUP BY 1, 2, 3),
df AS (SELECT doc_id, t, count(*) AS df FROM tok GROUP BY 1, 2),
qt AS (SELECT doc_id, t, count(*) AS qn FROM (SELECT doc_id, unnest({_TOK.format('claim')}) AS t FROM fx_claims) GROUP BY 1, 2),
sc AS (SELECT tok.doc_id, chunk, sum(qn * tf * ln((n + 1)::DOUBLE / (df + 1))) AS score FROM tok JOIN qt ON qt.doc_id = tok.doc_id AND qt.t = tok.t JOIN df ON df.doc_id = tok.doc_id AND df.t = tok.t
  JOIN nn ON nn.doc_id = tok.doc_id GROUP BY 1, 2),
rk AS (SELECT ch.doc_id, ch.chunk, round(coalesce(score, 0.0), 6) AS score FROM ch LEFT JOIN sc ON sc.doc_id = ch.doc_id AND sc.chunk = ch.chunk)
"""


@query("t2_evidence_topk_tfidf", _TFIDF + """
SELECT doc_id AS claim_id, doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(rank AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) AS rank FROM rk) WHERE rank <= 2""")
def t2(spark, sf):
    claims = view(spark, sf, "fx_claims").withColumn("claim_id", F.col("doc_id"))
    return evidence.evidence_topk_tfidf(view(spark, sf, "documents"), claims)


@query("t2_evidence_passages", _TFIDF + """
SELECT b.doc_id AS claim_id, CAST(b.chunk AS INTEGER) AS chunk, md5(ch.p) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk) AS rank FROM rk) b
JOIN ch ON ch.doc_id = b.doc_id AND ch.chunk = b.chunk WHERE b.rank = 1""")
def t2_passages(spark, sf):
    d = view(spark, sf, "documents")
    claims = view(spark, sf, "fx_claims").withColumn("claim_id", F.col("doc_id"))
    return evidence.evidence_passages(d, evidence.evidence_topk_tfidf(d, claims, k=1)).select(
        "claim_id", "chunk", F.md5(F.col("passage").cast("binary")).alias("digest"))


@query("t3_evidence_topk_cosine", """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
q AS (SELECT label, min(vec_id) AS query_id FROM e GROUP BY label),
s AS (SELECT q.query_id, e.label AS group_id, e.vec_id AS chunk_id, round(list_dot_product(e.v, f.v) / (CASE WHEN list_dot_product(e.v, e.v) = 0 THEN 1 ELSE sqrt(list_dot_product(e.v, e.v)) END
   * CASE WHEN list_dot_product(f.v, f.v) = 0 THEN 1 ELSE sqrt(list_dot_product(f.v, f.v)) END), 6) AS score
  FROM e JOIN q ON q.label = e.label JOIN e f ON f.vec_id = q.query_id)
SELECT query_id, group_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 5""")
def t3(spark, sf):
    e = view(spark, sf, "embeddings").select(F.col("label").alias("group_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = e.groupBy("group_id").agg(F.min(F.struct("chunk_id", "vector")).alias("m")).select(
        F.col("m.chunk_id").alias("query_id"), "group_id", F.col("m.vector").alias("vector"))
    return evidence.evidence_topk_cosine(e, queries, 5)


def _judged(spark, sf):
    raw = F.lower(F.coalesce(F.col("support"), F.lit("")))
    known = raw.isin("supported", "partial", "not_in_source", "contradicted", "unclear")
    audit = F.struct(F.concat(F.lit("claim "), F.col("ref_id").cast("string")).alias("claim"),
                     F.when(known, raw).otherwise("unclear").alias("support"))
    return results(spark, sf).withColumn("semantic_audit", audit)


def _screen(spark, sf):
    return view(spark, sf, "fx_votes").filter("ref_id % 3 <> 0").select(
        "ref_id", F.when(F.col("judge") == "SUPPORTS", "SUPPORTS").otherwise("REFUTES").alias("label"), "prob")


_PENDING = """
WITH pend AS (SELECT list_id, ref_id, verdict, needs_human, pmid, arxiv, length(trim(title)) AS tl FROM fx_results
  WHERE (lower(coalesce(support, '')) IN ('not_in_source', 'unclear') OR lower(coalesce(support, '')) NOT IN ('supported', 'partial', 'not_in_source', 'contradicted', 'unclear')) AND verdict <> 'invalid'),
cand AS (SELECT * FROM pend WHERE pmid IS NOT NULL OR regexp_matches(coalesce(arxiv, ''), '\\d{4}\\.\\d{4,5}')),
scr AS (SELECT ref_id, CASE judge WHEN 'SUPPORTS' THEN 'SUPPORTS' ELSE 'REFUTES' END AS label, prob FROM fx_votes WHERE ref_id % 3 <> 0)
"""
_JUDGED = _PENDING + """
, j AS (SELECT c.list_id, c.ref_id, c.verdict, v.judge, CASE v.nli WHEN 'entailment' THEN 'SUPPORTS' WHEN 'contradiction' THEN 'CONTRADICTS' WHEN 'neutral' THEN 'NEI' END AS nli_verdict, c.needs_human AS nh,
  CASE WHEN s.label IS NULL OR tl < 20 THEN 0 WHEN s.label = 'REFUTES' AND s.prob >= 0.95 THEN 2 ELSE 1 END AS priority
  FROM cand c JOIN fx_votes v ON v.ref_id = c.ref_id LEFT JOIN scr s ON s.ref_id = c.ref_id),
k AS (SELECT *, CASE WHEN nli_verdict IS NULL THEN 'single' WHEN nli_verdict = judge THEN 'high' ELSE 'contested' END AS confidence FROM j)
"""


@query("j23_claim_judgements", _JUDGED + """
SELECT list_id, ref_id, verdict, judge, nli_verdict, confidence, priority, nh OR judge = 'CONTRADICTS' OR confidence = 'contested' AS needs_human FROM k""")
def j23(spark, sf):
    return evidence.claim_judgements(_judged(spark, sf), view(spark, sf, "fx_votes"), _screen(spark, sf))


@query("j24_prescreen_notes", _PENDING + """
SELECT p.list_id, p.ref_id, s.label, s.prob, coalesce(s.label = 'SUPPORTS' AND s.prob >= 0.95, false) AS leans_support
FROM pend p LEFT JOIN scr s ON s.ref_id = p.ref_id WHERE tl >= 20 AND NOT EXISTS (SELECT 1 FROM fx_votes v WHERE v.ref_id = p.ref_id AND v.ref_id % 2 = 0)""")
def j24(spark, sf):
    judged = view(spark, sf, "fx_votes").filter("ref_id % 2 = 0")
    return evidence.prescreen_notes(_judged(spark, sf), _screen(spark, sf), judged)


@query("t4_judge_routing", _JUDGED + "SELECT list_id, ref_id, priority, row_number() OVER (PARTITION BY list_id ORDER BY priority DESC, ref_id) AS rank FROM k")
def t4(spark, sf):
    j = evidence.claim_judgements(_judged(spark, sf), view(spark, sf, "fx_votes"), _screen(spark, sf))
    return evidence.judge_routing(j).select("list_id", "ref_id", "priority", "rank")

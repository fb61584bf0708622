"""Registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.llm import (
    ball_codes, decontaminate, divergence, html_main, jaccard, langid, line_dedup, lm, mixing, quality, simhash, token_file, topk)
from refledger.llm.common import table
from refledger.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(configure(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return add


SIZES_SQL = r"""
rows AS (SELECT doc_id, source, md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid
    FROM rows GROUP BY source),
wts AS (SELECT *, [5.0, 2.0, 1.0][(sid % 3 + 1)::INTEGER]::DOUBLE AS w FROM src)"""

# water level: sources are filled in the order of cap / weight, so the level follows from running sums
MIX_SQL = f"""
WITH {SIZES_SQL},
caps AS (SELECT *, 3::DOUBLE * source_size / w AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM wts),
runs AS (SELECT *, coalesce(sum(3::DOUBLE * source_size) OVER (ORDER BY ratio, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(w) OVER (ORDER BY ratio, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM caps),
level AS (SELECT arg_min((total - below) / rest, ratio) FILTER (ratio >= (total - below) / rest) AS level FROM runs),
quo AS (SELECT source, source_size, least(w * level, 3::DOUBLE * source_size) AS target,
    least(floor(least(w * level, 3::DOUBLE * source_size) + 0.3), 3 * source_size)::BIGINT AS quota FROM wts, level),
placed AS (SELECT r.doc_id, r.size, q.source_size, q.target, q.quota,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
    FROM rows r JOIN quo q ON r.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(off + size, quota) - off) + greatest(0, least(off + source_size + size, quota) - off - source_size)
   + greatest(0, least(off + 2 * source_size + size, quota) - off - 2 * source_size))::BIGINT AS taken
FROM placed"""


@query("op1_mix_sources", MIX_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(table(spark, sf_dir, "documents")))


WORDS8 = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

LEAKS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS8} AS ws FROM documents),
items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS8} AS ws FROM benchmark),
wins AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
  SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS i FROM items WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT r, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win FROM (
  SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, lens WHERE len(ws) >= n)),
hits AS (SELECT r, p.n, i, item FROM places p JOIN wins w ON p.n = w.n AND p.win = w.win),
cover AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN cover USING (r) LEFT JOIN found USING (r)"""


@query("op8_decontaminate", LEAKS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "text_hash")


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op4_exact_topk", TOPK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


@query("op10_html_main")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


@query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SETS_SQL = r"""
docs AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT r, doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (
  SELECT r, doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT r, doc_id, count(*) AS n FROM sh GROUP BY ALL)"""

JACCARD_SQL = f"""
WITH RECURSIVE {SETS_SQL},
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.r <> b.r GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
walk AS (SELECT r AS x, r AS y FROM docs UNION SELECT w.x, l.y FROM walk w JOIN links l ON w.y = l.x)
SELECT d.doc_id, coalesce(any_value(s.n), 0)::BIGINT AS n_shingles, min(t.doc_id) AS component_id, count(*)::BIGINT AS members
FROM docs d LEFT JOIN sizes s ON s.r = d.r JOIN walk w ON w.x = d.r JOIN docs t ON t.r = w.y GROUP BY d.r, d.doc_id"""


@query("op3_jaccard_join", JACCARD_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
ln AS (SELECT r, doc_id, i - 1 AS no, raw, regexp_extract_all(
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
    FROM docs WHERE text <> '')),
keyed AS (SELECT *, array_to_string(ws, ' ') AS s, len(ws) AS n FROM ln),
lines AS (SELECT s, any_value(ws) AS ws, any_value(n) AS n, min((doc_id, no)) AS pos FROM keyed WHERE n > 0 GROUP BY s),
vars AS (SELECT s, n, pos, i, array_to_string(list_concat(ws[1:i - 1], ws[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM lines WHERE n >= 8)),
near AS (SELECT DISTINCT a.s FROM vars a JOIN vars b ON a.v = b.v AND a.i = b.i AND a.n = b.n WHERE b.pos < a.pos
  UNION SELECT a.s FROM vars a JOIN lines b ON a.v = b.s AND b.n >= 8 WHERE b.pos < a.pos
  UNION SELECT b.s FROM vars a JOIN lines b ON a.v = b.s AND b.n >= 8 WHERE a.pos < b.pos),
marked AS (SELECT k.r, k.no, k.raw, k.n > 0 AND (m.s IS NOT NULL OR l.pos < (k.doc_id, k.no)) AS gone
  FROM keyed k LEFT JOIN lines l ON k.s = l.s AND k.n > 0 LEFT JOIN near m ON k.s = m.s AND k.n > 0),
per AS (SELECT r, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  coalesce(string_agg(raw, chr(10) ORDER BY no) FILTER (NOT coalesce(gone, false)), '') AS kept FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped,
  length(coalesce(kept, ''))::BIGINT AS n_kept, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN per USING (r)"""


@query("op5_line_dedup", LINES_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.coalesce("text", F.lit(""))
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.length(kept).cast("long").alias("n_kept"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op7_token_file")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digest(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query("op11_simhash_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def codes_sql(rounds: int = 6) -> str:
    """Every part compared with every entry, round by round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (SELECT x.r, x.p, c.j, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{i} c ON x.p = c.p AND x.t = c.t GROUP BY ALL),
a{i} AS MATERIALIZED (SELECT r, p, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{i} GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.p, c.j, c.t, coalesce(((s - ((s % n) + n) % n) // n)::BIGINT, c.v) AS v FROM c{i} c LEFT JOIN (
  SELECT x.p, a.j, x.t, sum(x.v)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} a ON x.r = a.r AND x.p = a.p GROUP BY ALL) m
  ON c.p = m.p AND c.j = m.j AND c.t = m.t)""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS r, vec_id, label, e FROM (
  SELECT vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)),
x AS MATERIALIZED (SELECT r, (i - 1) // w AS p, (i - 1) % w AS t, e[i] AS v FROM (
  SELECT r, e, len(e) // 8 AS w, unnest(range(1, len(e) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS j, t, v FROM x WHERE r <= 16),{",".join(steps)},
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, j, t)) AS sha FROM c{rounds}),
done AS (SELECT r, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256
FROM kept JOIN done USING (r), book"""


@query("op12_ball_codes", codes_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.compressed(spark, table(spark, sf_dir, "embeddings"))


AUDIT_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
occ AS (SELECT r, lang, source, unnest(ts) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS total FROM occ GROUP BY ALL HAVING count(DISTINCT r) >= 3),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0)::HUGEINT AS c FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 1)) // (sum(c) OVER w + count(*) OVER w) AS p,
    1 + (1000000000 * (total + 1)) // (sum(total) OVER w + count(*) OVER w) AS q
  FROM dense WINDOW w AS (PARTITION BY lang, source)),
prices AS MATERIALIZED (SELECT lang, source, term, c, p::HUGEINT AS p, q::HUGEINT AS q FROM sums),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM prices a JOIN prices b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM groups a
    JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM prices WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""


@query("op13_source_divergence", AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))

"""Streaming jobs run to completion over the table files (availableNow)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.fixtures import driver_table, view
from refledger.functions.similarity import TOKEN
from refledger.operators import match
from refledger.plans.queries.base import query, registries, title_key_sql
from refledger.plans.queries.joins import NOTICE_SQL, VERIFY_SQL
from refledger.plans.queries.lists import DUPLICATES_SQL, SCORE_SQL, _V, _shared_ids
from refledger.plans.verify import verify
from refledger.streaming import jobs


def scratch(spark: SparkSession) -> str:
    """Fresh folder in the cluster's shared checkpoint folder; a temporary one in local tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="refledger-stream-")
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as a stream, be it one file or a folder of part files.  As a pattern of one name the path may be
    either; a plain path of a stream must be a folder."""
    return spark.readStream.schema(driver_table(spark, sf, name).schema).parquet(f"{sf.rstrip('/')}/{{{name}.parquet}}")


def stream_refs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a stream of references: the row arithmetic of the batch view."""
    d = stream_table(spark, sf, "documents")
    return d.selectExpr(
        "cast(floor(doc_id / 25.0) as bigint) as list_id", "doc_id as ref_id",
        "trim(regexp_extract(replace(text, chr(10), ' '), '^ *([^.]{1,120})', 1)) as title", "source", "lang",
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, doc_id) as ts")


def drain(query_handle) -> None:
    query_handle.awaitTermination()


def to_table(stream: DataFrame, where: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    drain(stream.writeStream.format("parquet").option("path", f"{where}/out").option(
        "checkpointLocation", f"{where}/checkpoint").outputMode(mode).trigger(availableNow=True).start())
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


@query("st1_verify_stream", VERIFY_SQL + "SELECT list_id, ref_id, rule, verdict, needs_human FROM verdicts")
def st1(spark, sf):
    where = scratch(spark)
    batch_refs = view(spark, sf, "fx_records")
    reg = registries(spark, sf, with_pages=False)
    # the stream carries the row ids; each micro-batch takes its claimed fields from the reference table
    ids = stream_table(spark, sf, "documents").select(F.col("doc_id").alias("ref_id"))
    drain(jobs.verify_stream(
        ids, lambda b: verify(batch_refs.join(b, "ref_id", "left_semi"), reg, model=TOKEN).select(
            "list_id", "ref_id", "rule", "verdict", "needs_human"), f"{where}/out", f"{where}/checkpoint"))
    return spark.read.parquet(f"{where}/out").drop("batch")


@query("st1_registry_stream", "WITH " + NOTICE_SQL + f"""
, r AS (SELECT doc_id AS ref_id, '10.5555/j' || CAST(doc_id * 37 AS VARCHAR) || 'x' AS doi FROM documents)
SELECT r.ref_id, w.lookup_status AS doi_state, c.nature AS retraction_nature FROM r LEFT JOIN fx_works w ON lower(w.doi) = r.doi LEFT JOIN notice_class c ON c.doi = r.doi""")
def st1_static(spark, sf):
    refs = stream_refs(spark, sf).withColumn("doi", F.concat(F.lit("10.5555/j"), (F.col("ref_id") * 37).cast("string"), F.lit("x")))
    index = match.build_retraction_index(view(spark, sf, "fx_notices"))
    out = jobs.registry_stream(refs, view(spark, sf, "fx_works"), index).select("ref_id", "doi_state", "retraction_nature")
    return to_table(out, scratch(spark))


@query("st2_verdict_cache", """
WITH v AS (SELECT ref_id, 'k' || CAST(ref_id % 50 AS VARCHAR) AS cache_key, ref_id::DOUBLE AS ts_hours, ref_id % 97 = 0 AS bypass_read,
  CASE WHEN ref_id % 5 = 0 THEN CASE ref_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'partial' WHEN 2 THEN 'unreachable' ELSE 'invalid' END END AS verdict FROM fx_refs),
s AS (SELECT *, max_by(verdict, ts_hours) FILTER (WHERE verdict IN ('verified', 'partial', 'invalid')) OVER w AS last_v, max(ts_hours) FILTER (WHERE verdict IN ('verified', 'partial', 'invalid')) OVER w AS last_t
  FROM v WINDOW w AS (PARTITION BY cache_key ORDER BY ts_hours ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ref_id, cache_key, CASE WHEN verdict IS NOT NULL THEN verdict WHEN ts_hours - last_t <= 168 AND NOT bypass_read THEN last_v END AS verdict,
  verdict IS NULL AND last_t IS NOT NULL AND ts_hours - last_t <= 168 AND NOT bypass_read AS cached FROM s""")
def st2(spark, sf):
    r = F.col("ref_id")
    fresh = F.when(r % 5 == 0, F.when(r % 4 == 0, "verified").when(r % 4 == 1, "partial").when(r % 4 == 2, "unreachable").otherwise("invalid"))
    rows = stream_table(spark, sf, "documents").select(F.col("doc_id").alias("ref_id")).select(
        F.concat(F.lit("k"), (r % 50).cast("string")).alias("cache_key"), "ref_id",
        F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, cast(ref_id as int))").alias("ts"),
        fresh.alias("verdict"), (r % 97 == 0).alias("bypass_read"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = to_table(jobs.verdict_cache(rows), scratch(spark))
    finally:
        spark.conf.set(provider, before)
    return out.select("ref_id", "cache_key", "verdict", "cached")


_DEDUPE_KEY = f"""CASE WHEN sig <> '' THEN 'url|' || u || '|' || sig ELSE 'row|' || CAST(doc_id AS VARCHAR) END"""


@query("st3_dedupe_stream", f"""
SELECT list_id, key AS dedupe_key, count(DISTINCT key) AS n FROM (SELECT list_id, {_DEDUPE_KEY} AS key FROM (
  SELECT doc_id, doc_id // 250 AS list_id, {title_key_sql("trim(regexp_extract(replace(text, chr(10), ' '), '^ *([^.]{1,120})', 1))")} AS sig,
    'https://example.org/' || CAST(doc_id % 3 AS VARCHAR) AS u FROM documents)) GROUP BY 1, 2""")
def st3(spark, sf):
    s = stream_refs(spark, sf).withColumns({
        "list_id": F.expr("ref_id div 250"), "doi": F.lit(None).cast("string"), "pmid": F.lit(None).cast("string"),
        "url": F.concat(F.lit("https://example.org/"), (F.col("ref_id") % 3).cast("string"), F.lit("/"))})
    out = to_table(jobs.dedupe_stream(s), scratch(spark))
    return out.groupBy("list_id", "dedupe_key").agg(F.count("*").alias("n"))


@query("st3_dedupe_all_keys", DUPLICATES_SQL.replace(
    "SELECT list_id, ref_id, dup_of AS duplicate_of, dup_kind AS duplicate_kind FROM step WHERE dup_of IS NOT NULL",
    "SELECT list_id, ref_id FROM step WHERE ref_id IS NOT NULL AND dup_of IS NULL"))
def st3_all_keys(spark, sf):
    """References with repeated identifiers, in three scheduled runs; the rows that remain are those of the batch rule."""
    where = scratch(spark)
    rows = _shared_ids(spark, sf).select("list_id", "ref_id", "title", "url", "doi", "pmid", F.expr(
        "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, ref_id)").alias("ts"))
    last = rows.agg(F.max("ref_id")).first()[0] or 0
    for i in range(3):
        rows.filter(F.floor(F.col("ref_id") * 3 / (last + 1)) == i).write.mode("append").parquet(f"{where}/in")
        drain(jobs.dedupe_all_keys_stream(spark.readStream.schema(rows.schema).parquet(f"{where}/in"), f"{where}/out", f"{where}/held",
                                          f"{where}/checkpoint", delay="100 days"))
    return spark.read.parquet(f"{where}/out").select("list_id", "ref_id")


def _probe_stream(spark, sf) -> DataFrame:
    return stream_table(spark, sf, "events").select(
        F.col("event_id").alias("probe_id"), F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", F.lit("timeout")).alias("error_kind"))


@query("st4_probe_windows", """
WITH b AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS w, host, error_kind FROM fx_probes)
SELECT w AS window_start, host, count(*) AS n_probes, count(error_kind) AS n_failures FROM b
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM fx_probes) GROUP BY 1, 2""")
def st4_windows(spark, sf):
    return to_table(jobs.probe_windows(_probe_stream(spark, sf)), scratch(spark))


BATCHES = 6
# six batches in the order of time; one probe in fifty comes a batch too late, and counts only if its host has nothing newer
_ARRIVALS = f"""
WITH span AS (SELECT min(ts) AS lo, max(ts) AS hi FROM fx_probes),
arr AS (SELECT p.*, least({BATCHES - 1}, CAST(floor({BATCHES} * date_diff('second', lo, ts) / (date_diff('second', lo, hi) + 1.0)) AS INT)
    + CASE WHEN probe_id % 50 = 7 THEN 1 ELSE 0 END) AS batch FROM fx_probes p, span),
seen AS (SELECT *, max({{'t': ts, 'p': probe_id}}) OVER (PARTITION BY host ORDER BY batch RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM arr),
ok AS (SELECT *, coalesce({{'t': ts, 'p': probe_id}} < last, false) AS late FROM seen),
m AS (SELECT host, error_kind IS NOT NULL AS bad, row_number() OVER (PARTITION BY host ORDER BY ts, probe_id)
    - row_number() OVER (PARTITION BY host, error_kind IS NOT NULL ORDER BY ts, probe_id) AS grp FROM ok WHERE NOT late),
runs AS (SELECT host, max(n) AS m FROM (SELECT host, grp, count(*) AS n FROM m WHERE bad GROUP BY 1, 2) GROUP BY 1),
tails AS (SELECT host, count(*) AS tail FROM (SELECT host, bool_and(error_kind IS NOT NULL) OVER (PARTITION BY host ORDER BY ts DESC, probe_id DESC) AS still
  FROM ok WHERE NOT late) WHERE still GROUP BY 1)
SELECT h.host, coalesce(m, 0) AS longest_run, coalesce(m, 0) >= 2 AS is_open, coalesce(tail, 0) AS tail, n_late
FROM (SELECT host, count(*) FILTER (WHERE late) AS n_late FROM ok GROUP BY 1) h LEFT JOIN runs r ON r.host = h.host LEFT JOIN tails t ON t.host = h.host"""


@query("st4_probe_health", _ARRIVALS)
def st4_health(spark, sf):
    """The probe log as it would arrive, late rows among it."""
    where = scratch(spark)
    probes = view(spark, sf, "fx_probes")
    lo, hi = probes.agg(F.min("ts"), F.max("ts")).first()
    seconds = F.unix_seconds(F.date_trunc("second", F.col("ts")).cast("timestamp")) - F.unix_seconds(F.lit(lo.replace(microsecond=0)).cast("timestamp"))
    place = F.floor(BATCHES * seconds / (int((hi.replace(microsecond=0) - lo.replace(microsecond=0)).total_seconds()) + 1.0)).cast("int")
    batch = F.least(F.lit(BATCHES - 1), place + F.when(F.col("probe_id") % 50 == 7, 1).otherwise(0))
    rows = probes.select("probe_id", "host", F.col("ts").cast("timestamp").alias("ts"), "error_kind", batch.alias("batch"))
    for i in range(BATCHES):  # as a scheduled job runs: what has come since the last run is one micro-batch
        rows.filter(F.col("batch") == i).drop("batch").write.mode("append").parquet(f"{where}/log")
        stream = spark.readStream.schema(rows.drop("batch").schema).parquet(f"{where}/log")
        drain(jobs.probe_health_stream(stream, f"{where}/state", f"{where}/checkpoint"))
    return jobs.probe_health(spark, f"{where}/state").select("host", "longest_run", "is_open", "tail", "n_late")


@query("st5_trace_stream", f"""
WITH v AS (SELECT doc_id // 25 AS list_id, CASE doc_id % 7 WHEN 0 THEN 'invalid' WHEN 1 THEN 'partial' WHEN 2 THEN 'unreachable' WHEN 3 THEN 'unverified' ELSE 'verified' END AS verdict,
  false AS retracted, false AS needs_human FROM documents),""" + SCORE_SQL.format(src="v").strip()[4:] + f"""
SELECT '2026-01-31' AS run_date, list_id, total, score, grade, {_V} FROM card""")
def st5(spark, sf):
    where = scratch(spark)
    m = F.col("doc_id") % 7
    verdict = F.when(m == 0, "invalid").when(m == 1, "partial").when(m == 2, "unreachable").when(m == 3, "unverified").otherwise("verified")
    rows = stream_table(spark, sf, "documents").select(F.expr("doc_id div 25").alias("list_id"), verdict.alias("verdict"))
    drain(jobs.trace_stream(rows, f"{where}/trace", f"{where}/checkpoint", "2026-01-31"))
    return spark.read.parquet(f"{where}/trace").select(
        "run_date", "list_id", "total", "score", "grade", *[c.strip() for c in _V.split(",")])

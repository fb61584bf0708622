"""A third of all rows on one list, DOI, title, host or key: results stay whole and nothing squares."""

import time

import pytest
from pyspark.sql import functions as F

from refledger.functions.similarity import TOKEN
from refledger.operators import dedupe, document, profile, score
from refledger.plans.verify import Registries, verify
from refledger.sources import exports

N = 30_000
HOT = N // 3


@pytest.fixture(scope="module")
def skewed(spark):
    hot = F.col("id") < HOT
    df = spark.range(N).select(
        F.when(hot, 0).otherwise(1 + F.col("id") % 500).cast("bigint").alias("list_id"), F.col("id").alias("ref_id"),
        F.when(hot, F.lit("one shared title of many copies")).otherwise(F.concat(F.lit("distinct heading number "), F.md5(F.col("id").cast("string")))).alias("title"),
        F.when(hot, F.lit("10.5555/hot")).otherwise(F.concat(F.lit("10.5555/x"), F.col("id").cast("string"), F.lit("z"))).alias("doi"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("arxiv"),
        F.lit("Journal").alias("source"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("authors"),
        F.lit("verified").alias("verdict"))
    return df.repartition(8)


def timed(fn, limit=90):
    start = time.time()
    out = fn()
    assert time.time() - start < limit
    return out


def test_duplicates(skewed):
    dup = timed(lambda: dedupe.mark_duplicates(skewed).agg(F.count("*").alias("n"), F.max("duplicate_of").alias("m")).first())
    assert (dup.n, dup.m) == (HOT - 1, 0)


def test_clone_pairs_collapse_copies(skewed):
    assert timed(lambda: dedupe.clone_pairs(skewed.filter(f"ref_id < {HOT}")).count()) == 0


def test_clone_pairs_of_one_title_with_many_dois(skewed):
    df = skewed.filter(f"ref_id < {HOT}").withColumn("doi", F.concat(F.lit("10.5555/v"), F.col("ref_id").cast("string"), F.lit("z")))
    r = timed(lambda: dedupe.clone_pairs(df).agg(F.count("*").alias("n"), F.max("a").alias("a")).first())
    assert (r.n, r.a) == (HOT - 1, 0)


def test_clone_pairs_of_one_doi_with_many_titles(skewed):
    n = 400
    df = skewed.filter(f"ref_id < {n}").withColumn("title", F.md5(F.col("ref_id").cast("string")))
    assert timed(lambda: dedupe.clone_pairs(df).filter("kind = 'clone_title'").count()) == n * (n - 1) // 2


def test_serial_run_of_a_third_of_all_rows(skewed):
    df = skewed.withColumn("doi", F.when(F.col("ref_id") < HOT, F.concat(F.lit("10.5555/s"), (100000 + F.col("ref_id")).cast("string"))).otherwise(F.col("doi")))
    (r,) = timed(lambda: profile.serial_clusters(df).collect())
    assert (r.run_length, r.first_tail, r.last_tail) == (HOT, "100000", str(100000 + HOT - 1))


def test_profile_and_scores(skewed):
    p = timed(lambda: profile.profile_bibliography(skewed, 2026).filter("list_id = 0").first())
    assert p.n == HOT and "source_concentration" in p.flags
    assert score.scorecard(skewed).filter("list_id = 0").first().total == HOT


def test_numbering(skewed):
    keys = timed(lambda: exports.unique_cite_keys(skewed).filter("list_id = 0").agg(
        F.count_distinct("cite_key").alias("n"), F.max(F.regexp_extract("cite_key", r"_(\d+)$", 1).try_cast("int")).alias("m")).first())
    assert (keys.n, keys.m) == (HOT, HOT)
    order = score.review_order(skewed).filter("list_id = 0").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count_distinct("position").alias("n")).first()
    assert (order.a, order.b, order.n) == (1, HOT, HOT)


def test_verify(spark, skewed):
    works = skewed.filter(f"ref_id = 0 or ref_id >= {HOT}").select("doi", "title", F.col("source").alias("container"), "year", F.lit("hit").alias("lookup_status"))
    probes = works.select(F.concat(F.lit("https://doi.org/"), "doi").alias("url"), F.lit(1).alias("probe_id"), F.lit(200).alias("http_status"),
                          F.lit(None).cast("string").alias("error_kind"))
    reg = Registries(works=works, probes=probes, probe_order=("probe_id",))
    got = timed(lambda: verify(skewed.drop("verdict"), reg, model=TOKEN).groupBy("verdict").count().collect(), 180)
    assert {r.verdict: r["count"] for r in got} == {"verified": N}


def test_failure_run_of_a_third_of_all_probes(spark):
    probes = spark.range(N).select(
        F.col("id").alias("probe_id"), F.when(F.col("id") < HOT, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") % 900).cast("string"))).alias("host"),
        F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("ts"),
        F.when(F.col("id") < HOT, "timeout").alias("error_kind"))
    (r,) = timed(lambda: profile.failure_runs(probes).collect())
    assert (r.host, r.run_length) == ("hot", HOT)


def test_mentions_of_one_list(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("list_id"), F.lit("Text says so [1]. Also [2-3] and (Smith, 2020).").alias("text"))
    listed = spark.range(3000).select(
        F.lit(0).cast("bigint").alias("list_id"), F.col("id").alias("ref_id"), (F.col("id") + 1).cast("int").alias("position"),
        F.concat(F.lit("Title by smithson number "), F.col("id").cast("string")).alias("title"), F.lit(None).cast("string").alias("doi"),
        F.lit(2020).alias("year"), F.array().cast("array<string>").alias("authors"))
    m = document.extract_mentions(docs)
    bound = document.bind_citations(m, listed)
    r = timed(lambda: bound.agg(F.count("*").alias("n"), F.count("ref_id").alias("b"), F.max("ref_id").alias("m")).first())
    assert (r.n, r.b, r.m) == (12000, 12000, 2)
    assert document.uncited_refs(listed, bound).count() == 2997

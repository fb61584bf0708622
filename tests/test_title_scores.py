"""Token scores of title pairs: the values, and that the plan computes each once."""

import random
import re

from pyspark.sql import functions as F

from refledger.functions import text as tx
from refledger.functions.similarity import TOKEN
from refledger.operators import fuzzy
from refledger.plans.queries import QUERIES

CLAIMS = "ref_id bigint, clean_title string, year int"
PAPERS = "paper_id bigint, title string, year int"


def sets(a, b):
    x, y = ({*re.findall("[a-z0-9一-鿿]+", t.lower())} for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def test_token_scores(spark):
    rng = random.Random(3)
    words = ["La", "de", "Signal", "signals", "x1", "一二", "--", "é", "", "naive"]
    rows = [tuple(" ".join(rng.choices(words, k=rng.randrange(6))) for _ in "ab") for _ in range(300)] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", tx.token_sim(F.col("a"), F.col("b")).alias("s"), TOKEN.prefix(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        assert r.s == sets(r.a or "", r.b or "")
        if r.a is None or r.b is None:
            assert r.p is None
        else:
            assert r.p == max(sets(r.a, r.b), sets(r.a, r.b[:len(r.a)]) if len(r.b) >= len(r.a) else 0)


def test_a_pair_is_scored_once(spark):
    claims = spark.createDataFrame([(1, "Signal processing of long words", 2000), (2, "Other words about nothing here", 2001)], CLAIMS)
    papers = spark.createDataFrame([(7, "Signal processing of long words and more", 1990), (8, "Unrelated words", 2001)], PAPERS)
    found = fuzzy.confirm_by_title(claims, papers, TOKEN)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 2  # with the title and with its beginning; a filter would double it
    assert [tuple(r) for r in found.collect()] == [(1, True, 1.0)]


def test_documents_are_read_once(spark, sf):
    plan = QUERIES["j8_confirm_by_title"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract(" not in plan and "parquet" not in plan  # titles are taken from the texts before

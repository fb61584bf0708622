"""The verdict cache: times that pandas can't hold, late rows, expired entries, keys of many rows in any order."""

import pytest

from refledger.plans.queries import ORACLES, QUERIES
from refledger.plans.queries.streams import to_table
from refledger.streaming import jobs

ROWS = "cache_key string, ref_id bigint, ts timestamp, verdict string, bypass_read boolean"


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def cached(spark, folder, batches):
    """What the cache gives for each micro-batch of (ref_id, hours, verdict), all of one key."""
    for rows in batches:
        spark.createDataFrame([("k", i, h, v) for i, h, v in rows], "k string, i bigint, h int, v string").selectExpr(
            "k AS cache_key", "i AS ref_id", "timestamp '2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts", "v AS verdict",
            "false AS bypass_read").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        out = to_table(jobs.verdict_cache(spark.readStream.schema(ROWS).parquet(f"{folder}/in")), folder)
    return sorted((r.ref_id, r.verdict, r.cached) for r in out.collect())


@pytest.mark.parametrize("limit, back", [(200_000, 10_000), (7, 3), (8, 50)])
def test_rows_of_a_key_in_order(monkeypatch, limit, back):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(jobs, "RUN", limit)
    monkeypatch.setattr(jobs, "BACK", back)
    frames = [pd.DataFrame({"ts_hours": [float(v) for v in part // 2], "ref_id": part, "verdict": None})
              for part in np.array_split(np.random.default_rng(5).permutation(24), 7)]
    frames[3].loc[0, "ts_hours"] = float("nan")
    got = [(r.ts_hours, r.ref_id) for some in jobs.in_order(iter(frames)) for r in some]
    want = sorted(((t, i) for f in frames for t, i in zip(f.ts_hours, f.ref_id)), key=lambda r: (r[0] != r[0], r))
    assert [i for _, i in got] == [i for _, i in want]
    assert [*jobs.in_order(iter([]))] == []


def test_newest_verdict_of_a_long_key(spark, rocksdb, tmp_path):
    """Of 30,000 rows, three Arrow batches, the newest fresh verdict is kept though it comes first; later its entry expires."""
    n = 30_000
    got = cached(spark, str(tmp_path), [
        [(i, i, "verified" if i == n else "partial") for i in range(n, 0, -1)], [(n + 1, n + 50, None)], [(n + 2, n + 1000, None)],
        [(n + 3, n + 1001, None)]])
    assert got[n - 1:] == [(n, "verified", False), (n + 1, "verified", True), (n + 2, None, False), (n + 3, None, False)]


@pytest.mark.parametrize("year", [0, 1000, 20_000])
def test_cache_at_any_time(spark, rocksdb, tmp_path, year):
    h = year * 8766
    got = cached(spark, str(tmp_path), [
        [(1, h, "verified"), (2, h + 10, None), (3, h + 100, None)],
        [(4, h + 150, None), (5, h + 20, None)],  # the last is late: the watermark is an hour before the newest row
        [(6, h + 400, None)]])
    assert got == [(1, "verified", False), (2, "verified", True), (3, "verified", True), (4, "verified", True), (6, None, False)]


def test_query_with_ids_far_apart(spark, tmp_path):
    import duckdb

    ids = "SELECT id % 60 + (id div 60) * 10000000 AS doc_id, concat('Title ', id, '. More') AS text, 'en' AS lang, 's' AS source FROM range(180)"
    spark.sql(ids).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["st2_verdict_cache"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(ORACLES["st2_verdict_cache"]).fetchall())

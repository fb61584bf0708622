"""Streams over driver tables that are folders of part files, as Spark writes them."""

import pytest

from refledger.plans.queries import QUERIES
from refledger.plans.queries.streams import stream_table, to_table

TABLES = {
    "documents": "SELECT id AS doc_id, concat('Title number ', id, ' of some words. More text') AS text, "
                 "IF(id % 2 = 0, 'en', 'de') AS lang, concat('s', id % 3) AS source, 40L AS n_chars FROM range(60)",
    "events": "SELECT id AS event_id, id % 4 AS user_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts, "
              "IF(id % 3 = 0, 'error', 'view') AS event_type FROM range(60)",
}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    """The same rows twice: tables of several part files, and tables of one file."""
    many, one = tmp_path_factory.mktemp("many"), tmp_path_factory.mktemp("one")
    for name, sql in TABLES.items():
        spark.sql(sql).repartition(3).write.parquet(f"{many}/{name}.parquet")
        spark.sql(sql).toPandas().to_parquet(f"{one}/{name}.parquet", coerce_timestamps="us")
    return str(many), str(one)


def test_every_part_file_is_streamed(spark, folders, tmp_path):
    for i, sf in enumerate(folders):
        rows = to_table(stream_table(spark, sf, "documents").select("doc_id"), f"{tmp_path}/{i}")
        assert sorted(r.doc_id for r in rows.collect()) == list(range(60))


@pytest.mark.parametrize("name, rows", [
    ("st1_verify_stream", 60), ("st1_registry_stream", 60), ("st2_verdict_cache", 60), ("st3_dedupe_stream", 60), ("st5_trace_stream", 3)])
def test_queries_on_folders(spark, folders, name, rows):
    assert QUERIES[name](spark, folders[0]).count() == rows


def test_windows_on_folders(spark, folders):
    many, one = (sorted(map(repr, QUERIES["st4_probe_windows"](spark, sf).collect())) for sf in folders)
    assert many == one and many

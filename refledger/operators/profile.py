"""List-level fingerprints of batch fabrication, and host health from a probe log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions.shipping import ship_by_value
from refledger.session import cut_lineage

ship_by_value(__name__)


# --- serial identifiers --------------------------------------------------------------------------

def serial_clusters(refs: DataFrame, max_gap: int = 2, min_run: int = 3, width: int = 4096) -> DataFrame:
    """Longest run of close trailing numbers per list and DOI prefix (earliest on a tie).

    Runs are found inside slices of the number line; only runs that touch a slice edge are then
    stitched per prefix.  A prefix that holds most rows is sorted in many tasks, never in one.
    """
    doi = F.lower(F.coalesce(F.col("doi"), F.lit("")))
    tails = refs.filter(doi.rlike(fv.SERIAL_DOI)).select(
        "list_id", "ref_id", F.regexp_extract(doi, fv.SERIAL_DOI, 1).alias("prefix"),
        F.regexp_extract(doi, fv.SERIAL_DOI, 2).try_cast("decimal(38,0)").alias("tail")
    ).filter("tail is not null")
    keys = ["list_id", "prefix"]
    # rows with the same tail are one point of the run with their count
    points = tails.groupBy(*keys, "tail").agg(F.count("*").alias("n")).withColumn(
        "slice", F.col("tail") - F.col("tail") % F.lit(width).cast("decimal(10,0)"))
    local = Window.partitionBy(*keys, "slice").orderBy("tail")
    broken = F.coalesce((F.col("tail") - F.lag("tail").over(local) > max_gap).cast("int"), F.lit(0))
    runs = (
        points.withColumn("brk", broken)
        .withColumn("run", F.sum("brk").over(local))
        .groupBy(*keys, "slice", "run")
        .agg(F.min("tail").alias("lo"), F.max("tail").alias("hi"), F.sum("n").alias("n")))
    base = F.col("slice")
    at_edge = (F.col("lo") - base < max_gap) | (base + width - F.col("hi") <= max_gap)
    edge = Window.partitionBy(*keys).orderBy("lo")
    gap = F.coalesce((F.col("lo") - F.lag("hi").over(edge) > max_gap).cast("int"), F.lit(0))
    stitched = (
        runs.filter(at_edge).withColumn("brk", gap).withColumn("grp", F.sum("brk").over(edge))
        .groupBy(*keys, "grp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")))
    every = runs.filter(~at_edge).select(*keys, "lo", "hi", "n").unionByName(stitched.select(*keys, "lo", "hi", "n"))
    best = every.groupBy(*keys).agg(F.min_by(F.struct("lo", "hi", "n"), F.struct(-F.col("n"), F.col("lo"))).alias("m"))
    return best.filter(F.col("m.n") >= min_run).select(
        *keys, F.col("m.n").alias("run_length"), F.col("m.lo").cast("string").alias("first_tail"),
        F.col("m.hi").cast("string").alias("last_tail"))


# --- bibliography profile --------------------------------------------------------------------------

def _mode(df: DataFrame, value: str, n: str, top: str, top_n: str) -> DataFrame:
    """Size and most frequent value per list (first seen on a tie), by two aggregations."""
    per = df.filter(F.col(value).isNotNull()).groupBy("list_id", value).agg(
        F.count("*").alias("c"), F.min("ref_id").alias("f"))
    return per.groupBy("list_id").agg(
        F.sum("c").alias(n), F.max_by(value, F.struct(F.col("c"), -F.col("f"))).alias(top), F.max("c").alias(top_n))


def profile_bibliography(refs: DataFrame, as_of_year: int) -> DataFrame:
    """Distribution statistics and flags per list; lists under four rows carry no flag.

    Flags describe distributions and never touch verdicts."""
    year = F.col("year").try_cast("int")
    source = F.trim(F.coalesce(F.col("source"), F.lit("")))
    ids_blank = F.lit(True)
    for c in ("doi", "pmid", "arxiv", "url"):
        ids_blank = ids_blank & (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    rows = refs.select("list_id", "ref_id", year.alias("y"), F.when(source != "", source).alias("s"),
                       ids_blank.alias("bare"))
    base = rows.groupBy("list_id").agg(
        F.count("*").alias("n"), F.count_if("bare").alias("n_bare"),
        F.count_if(F.col("y") > as_of_year + 1).alias("n_future"),
        F.min("y").alias("year_min"), F.max("y").alias("year_max"))
    years = _mode(rows, "y", "n_years", "year_mode", "year_mode_n")
    sources = _mode(rows, "s", "n_sources", "source_top", "source_top_n")
    serial = serial_clusters(refs).groupBy("list_id").agg(F.count("*").alias("n_serial"))
    j = base.join(years, "list_id", "left").join(sources, "list_id", "left").join(serial, "list_id", "left")
    year_share = F.col("year_mode_n") / F.col("n_years")
    source_share = F.col("source_top_n") / F.col("n_sources")
    bare_share = F.col("n_bare") / F.col("n")
    flags = F.array_compact(F.array(
        F.when(F.col("n_serial") > 0, "serial_cluster"),
        F.when(F.col("n_future") > 0, "future_year"),
        F.when((F.col("n_years") >= 8) & (year_share >= 0.8), "year_concentration"),
        F.when((F.col("n_sources") >= 8) & (source_share >= 0.6), "source_concentration"),
        F.when((F.col("n_bare") > 0) & (bare_share >= 0.5), "bare_refs")))
    enough = F.col("n") >= 4
    return j.select(
        "list_id", "n", F.when(enough, flags).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.coalesce("n_serial", F.lit(0)).alias("n_serial"), "n_future", "year_min", "year_max", "year_mode",
        F.round(year_share, 2).alias("year_mode_share"),
        F.when(F.col("n_sources") >= 8, F.col("source_top")).alias("source_top"),
        F.when(F.col("n_sources") >= 8, F.round(source_share, 2)).alias("source_top_share"),
        "n_bare", F.round(bare_share, 2).alias("bare_share"))


# --- probe log ---------------------------------------------------------------------------------------

def _runs(probes: DataFrame) -> DataFrame:
    """host, first and last (ts, probe_id), n of every run of consecutive transport failures.

    Probes are dealt into ranges of host and time of about equal row counts, whatever the hosts, and each range is read
    once in order.  A range gives its failure runs and its first and last run of any kind; the latter, two a range, are
    all that can go on in the next range, and are put together there.
    """
    order = ["host", "ts", "probe_id"]
    rows = probes.select(*order, F.col("error_kind").isNotNull().alias("bad")).repartitionByRange(*order).sortWithinPartitions(
        *order).select(F.spark_partition_id().alias("part"), *order, "bad")
    kinds = dict(rows.dtypes)
    ends = ", ".join(f"{e}_{c} {kinds[c]}" for e in ("first", "last") for c in ("ts", "probe_id"))
    runs = cut_lineage(rows.mapInArrow(_range_runs, f"part int, host string, bad boolean, n bigint, head boolean, tail boolean, {ends}"))
    first, last = (F.struct(F.col(f"{e}_ts").alias("ts"), F.col(f"{e}_probe_id").alias("probe_id")).alias(e) for e in ("first", "last"))
    runs = runs.select("part", "host", "bad", "n", "head", "tail", first, last)
    inner = runs.filter("bad AND NOT head AND NOT tail").select("host", "first", "last", "n")
    # at most two rows a range: as many as there are tasks
    across = Window.partitionBy(F.lit(0)).orderBy("part", F.col("head").desc())
    goes_on = F.coalesce(F.col("head") & F.col("host").eqNullSafe(F.lag("host").over(across)) & (F.col("bad") == F.lag("bad").over(across)), F.lit(False))
    joined = runs.filter("head OR tail").withColumn("new", (~goes_on).cast("int")).withColumn("run", F.sum("new").over(across)).filter(
        "bad").groupBy("run").agg(F.first("host").alias("host"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return inner.unionByName(joined.drop("run"))


def _range_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal host and kind in sorted rows: failures, and the first (head) and last (tail) run of all."""
    held, names = None, ["part", "host", "bad", "n", "head", "tail", "first_ts", "first_probe_id", "last_ts", "last_probe_id"]
    begun = False

    def finished(run: pa.Table, tail: bool) -> pa.Table:
        nonlocal begun
        head = np.zeros(run.num_rows, bool)
        if run.num_rows and not begun:
            head[0] = begun = True
        at_end = np.zeros(run.num_rows, bool)
        if tail:
            at_end[-1] = True
        out = run.append_column("head", pa.array(head)).append_column("tail", pa.array(at_end)).select(names)
        return out.filter(pa.compute.or_(out["bad"], pa.array(head | at_end)))

    for batch in batches:
        if not batch.num_rows:
            continue
        host, bad = batch["host"].dictionary_encode().indices.fill_null(-1).to_numpy(), batch["bad"].to_numpy(zero_copy_only=False)
        edge = np.flatnonzero(np.concatenate([[True], (host[1:] != host[:-1]) | (bad[1:] != bad[:-1])]))
        stop = np.concatenate([edge[1:], [batch.num_rows]])
        a, b = pa.array(edge), pa.array(stop - 1)
        runs = pa.table({"part": batch["part"].take(a), "host": batch["host"].take(a), "bad": batch["bad"].take(a), "n": pa.array(stop - edge, pa.int64()),
                         "first_ts": batch["ts"].take(a), "first_probe_id": batch["probe_id"].take(a),
                         "last_ts": batch["ts"].take(b), "last_probe_id": batch["probe_id"].take(b)})
        if held is not None:
            one, two = held.to_pylist()[0], runs.slice(0, 1).to_pylist()[0]
            if (one["host"], one["bad"]) == (two["host"], two["bad"]):
                whole = {**one, "n": one["n"] + two["n"], "last_ts": two["last_ts"], "last_probe_id": two["last_probe_id"]}
                runs = pa.concat_tables([pa.Table.from_pylist([whole], runs.schema), runs.slice(1)])
            else:
                runs = pa.concat_tables([held, runs])
        yield from finished(runs.slice(0, runs.num_rows - 1), False).to_batches()
        held = runs.slice(runs.num_rows - 1)
    if held is not None:
        yield from finished(held, True).to_batches()


def failure_runs(probes: DataFrame) -> DataFrame:
    """Runs of consecutive transport failures per host: host, first_ts, last_ts, run_length."""
    return _runs(probes).select(
        "host", F.col("first.ts").alias("first_ts"), F.col("last.ts").alias("last_ts"), F.col("n").alias("run_length"))


def run_summary(probes: DataFrame) -> DataFrame:
    """Per host: failures before the first answer, after the last one, longest run, whether all failed, and the last
    (ts, probe_id).  Two consecutive summaries of a host combine into the summary of both."""
    span = probes.groupBy("host").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "probe_id")).alias("lo"), F.max(F.struct("ts", "probe_id")).alias("hi"))
    runs = span.join(_runs(probes).select("host", "first", "last", F.col("n").alias("len")), "host", "left")
    at = runs.groupBy("host").agg(
        F.coalesce(F.max(F.when(F.col("first") == F.col("lo"), F.col("len"))), F.lit(0)).alias("head"),
        F.coalesce(F.max(F.when(F.col("last") == F.col("hi"), F.col("len"))), F.lit(0)).alias("tail"),
        F.coalesce(F.max("len"), F.lit(0)).alias("longest"), F.max("n").alias("n"), F.max("hi").alias("seen"))
    return at.select("host", "head", "tail", "longest", (F.col("head") == F.col("n")).alias("all_failed"), "seen")


def host_health(probes: DataFrame, threshold: int = 2, degrade_hosts: int = 3) -> DataFrame:
    """Per host: probes, failures, longest failure run, open flag; and whether the batch is degraded.

    A host opens with ``threshold`` consecutive failures.  The batch is degraded when
    ``degrade_hosts`` different hosts failed and never answered."""
    base = probes.groupBy("host").agg(
        F.count("*").alias("n_probes"), F.count_if(F.col("error_kind").isNotNull()).alias("n_failures"))
    longest = failure_runs(probes).groupBy("host").agg(F.max("run_length").alias("longest_run"))
    j = base.join(longest, "host", "left").withColumn("longest_run", F.coalesce("longest_run", F.lit(0)))
    # one row of one number, so the broadcast has a fixed size
    never_ok = base.filter("n_failures = n_probes").agg(F.count("*").alias("never_ok_hosts"))
    return j.join(F.broadcast(never_ok)).select(
        "host", "n_probes", "n_failures", "longest_run", (F.col("longest_run") >= threshold).alias("is_open"),
        (F.col("never_ok_hosts") >= degrade_hosts).alias("batch_degraded"))


def journal_map_coverage(pubmed: DataFrame) -> DataFrame:
    """Mapped journal abbreviations with no record in the registry."""
    spark = pubmed.sparkSession
    table = spark.createDataFrame(list(fv.CN_JOURNAL_TA.items()), "journal string, ta string")
    return unused_mappings(table, pubmed)


def unused_mappings(mapping: DataFrame, pubmed: DataFrame) -> DataFrame:
    counts = pubmed.filter("lookup_status = 'hit'").groupBy("ta").agg(F.count("*").alias("n_records"))
    return mapping.join(counts, "ta", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0))).filter(
        "n_records = 0").select("journal", "ta", "n_records")

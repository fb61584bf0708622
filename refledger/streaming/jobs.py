"""Incremental forms of the batch jobs as Structured Streaming queries."""

from __future__ import annotations

import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from refledger import fixed_values as fv
from refledger.functions import identifiers as ids
from refledger.functions import text as tx
from refledger.functions.shipping import ship_by_value
from refledger.operators import dedupe, profile, score
from refledger.session import cut_lineage
from refledger.sources import exports

ship_by_value(__name__)

# plain values: what the state processor refers to travels with it to the workers
_CACHEABLE = frozenset(fv.CACHEABLE_VERDICTS)
CACHE_INPUTS = ["doi", "url", "pmid", "arxiv", "title", "year", "source", "authors", "tier"]


def verify_stream(refs: DataFrame, verifier, sink_path: str, checkpoint: str, trigger: dict | None = None):
    """Verify each micro-batch against static registry snapshots and append the verdicts.

    ``verifier`` is a function DataFrame -> DataFrame, e.g. ``lambda b: verify(b, registries)``.  The
    title searches aggregate within the batch, which is why the joins run in ``foreachBatch``; the
    batch id keys the output folder, so a replayed batch overwrites itself."""
    def run(batch: DataFrame, batch_id: int) -> None:
        verifier(batch).write.mode("overwrite").parquet(f"{sink_path}/batch={batch_id}")

    return refs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def registry_stream(refs: DataFrame, works: DataFrame, retractions: DataFrame) -> DataFrame:
    """Stream-static left joins in append mode: DOI existence and retraction class per reference."""
    keyed = refs.withColumn("doi_norm", ids.doi_key(F.col("doi")))
    w = works.select(F.lower("doi").alias("wdoi"), F.col("lookup_status").alias("doi_state"))
    n = retractions.select(F.col("doi").alias("ndoi"), ids.retraction_class(F.col("nature")).alias("retraction_nature"))
    return keyed.join(w, F.col("doi_norm") == F.col("wdoi"), "left").join(
        n, F.col("doi_norm") == F.col("ndoi"), "left").drop("wdoi", "ndoi")


# --- verdict cache -----------------------------------------------------------------------------------

def with_cache_key(refs: DataFrame, profile: str = "general") -> DataFrame:
    have = {c: F.col(c) for c in CACHE_INPUTS if c in refs.columns}
    return refs.withColumn("cache_key", ids.cache_key(have, fv.RULES_VERSION, profile))


#: Rows of one key that are sorted in memory, and rows of a run that are read back at once.
RUN, BACK = 200_000, 10_000


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of all frames by ts_hours and ref_id, some at a time; runs of a long key wait on disk."""
    by = ["ts_hours", "ref_id"]

    def rows(frame: pd.DataFrame) -> list[tuple]:
        return [*frame.itertuples(index=False)]

    def run(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held, ignore_index=True).sort_values(by)

    def read_back(file) -> Iterator[tuple]:
        file.seek(0)
        while (frame := pickle.load(file)) is not None:
            yield from rows(frame)

    def place(r: tuple) -> tuple:  # missing values behind the others, as in a run
        return tuple(x for v in (r.ts_hours, r.ref_id) for x in (v != v, 0 if v != v else v))

    files, held, size = [], [], 0
    try:
        for frame in frames:
            held.append(frame)
            size += len(frame)
            if size >= RUN:
                files.append(tempfile.TemporaryFile())
                whole = run(held)
                for lo in range(0, len(whole), BACK):
                    pickle.dump(whole[lo:lo + BACK], files[-1], pickle.HIGHEST_PROTOCOL)
                pickle.dump(None, files[-1])
                held, size = [], 0
        last = run(held) if held else pd.DataFrame()
        parts = (last[lo:lo + BACK] for lo in range(0, len(last), BACK))
        if not files:
            yield from map(rows, parts)
            return
        merged = heapq.merge(*map(read_back, files), (r for part in parts for r in rows(part)), key=place)
        while some := [*itertools.islice(merged, BACK)]:
            yield some
    finally:
        for file in files:
            file.close()


class VerdictCache(StatefulProcessor):
    """Last cacheable verdict per key.

    Input rows: cache_key, ref_id, ts (event time in microseconds), ts_hours (the same clock in hours), verdict
    (null asks the cache) and bypass_read.  Output: cache_key, ref_id, verdict, cached, age_hours.  The age
    is taken from the row clock, so replays give the same answer; an event-time timer clears an entry
    once the watermark has passed its TTL.  The rows of a key come as Arrow batches in any order; they are
    sorted by time in runs, so a hot key needs no more memory than a run and a batch of every run on disk."""

    def __init__(self, ttl_hours: float = fv.CACHE_TTL_HOURS):
        self.ttl_hours = ttl_hours
        self.cacheable = _CACHEABLE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "verdict string, ts_hours double")

    # Spark names the arguments of an expired timer
    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.entry.get() if self.entry.exists() else None
        before = stored
        for some in in_order(rows):
            out = []
            for r in some:
                age = r.ts_hours - stored[1] if stored is not None else None
                if r.verdict is not None:
                    out.append((key[0], r.ref_id, r.verdict, False, None))
                    if r.verdict in self.cacheable:
                        stored = (r.verdict, float(r.ts_hours))
                elif stored is not None and 0 <= age <= self.ttl_hours and not r.bypass_read:
                    out.append((key[0], r.ref_id, stored[0], True, float(age)))
                else:
                    out.append((key[0], r.ref_id, None, False, None))
            yield pd.DataFrame(out, columns=["cache_key", "ref_id", "verdict", "cached", "age_hours"])
        if stored is not None and stored != before:
            self.entry.update((stored[0], float(stored[1])))
            self.handle.registerTimer(self._expiry(stored[1]))

    def _expiry(self, ts_hours: float) -> int:
        return int((ts_hours + self.ttl_hours) * 3_600_000) + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an older entry's timer leaves a newer entry alone
        if self.entry.exists() and self._expiry(self.entry.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


CACHE_OUT = "cache_key string, ref_id bigint, verdict string, cached boolean, age_hours double"


def verdict_cache(rows: DataFrame, ttl_hours: float = fv.CACHE_TTL_HOURS, delay: str = "1 hour") -> DataFrame:
    """Keyed cache over a stream of lookups and fresh verdicts (cache_key, ref_id, ts, verdict, bypass_read)."""
    ts = F.col("ts").cast("timestamp")
    timed = rows.withWatermark("ts", delay)
    # pandas holds no time after the year 2262, so the event time goes on as a number, still marked as what the watermark compares
    event = F.unix_micros(ts).alias("ts", metadata=timed.schema["ts"].metadata)
    keyed = timed.select(
        "cache_key", "ref_id", event, (F.unix_millis(ts) / 3_600_000.0).alias("ts_hours"), "verdict", "bypass_read")
    return keyed.groupBy("cache_key").transformWithStateInPandas(
        statefulProcessor=VerdictCache(ttl_hours), outputStructType=CACHE_OUT, outputMode="Append", timeMode="EventTime")


# --- dedupe, health, trace ---------------------------------------------------------------------------

def dedupe_key() -> Column:
    """First identifier (url, doi, pmid) with the title fingerprint; null without either."""
    sig = tx.title_key(F.coalesce("title", F.lit("")))
    ident = F.coalesce(
        F.concat(F.lit("url|"), ids.normalise_url(tx.blank_to_null(F.coalesce("url", F.lit(""))))),
        F.concat(F.lit("doi|"), F.lower(tx.blank_to_null(F.coalesce("doi", F.lit(""))))),
        F.concat(F.lit("pmid|"), tx.blank_to_null(F.coalesce("pmid", F.lit("")))))
    return F.when(sig != "", F.concat(ident, F.lit("|"), sig))


def dedupe_stream(refs: DataFrame, ts: str = "ts", delay: str = "7 days") -> DataFrame:
    """First row per list and key within the watermark; rows without a key always pass."""
    keyed = refs.withColumn("dedupe_key", F.coalesce(dedupe_key(), F.concat(F.lit("row|"), F.col("ref_id").cast("string"))))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["list_id", "dedupe_key"])


def dedupe_all_keys_stream(refs: DataFrame, out_path: str, state_path: str, checkpoint: str, ts: str = "ts", delay: str = "7 days"):
    """Rows that repeat no earlier row by url, DOI or PMID (each with the title), appended under ``out_path``.

    The batch rule over micro-batches: only rows that are no duplicates themselves hold their keys.  A micro-batch first
    loses the rows whose keys are held, then settles the others among themselves (``mark_duplicates``), and its originals
    become holders.  Holders leave the state when the newest row is more than ``delay`` past them.  Rows without a key
    always pass.  State folders take turns as those of ``probe_health_stream`` do, so a replay finds its input untouched."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut_lineage(batch)
        keys = cut_lineage(dedupe.duplicate_keys(rows))
        row, key = ["list_id", "ref_id"], ["list_id", "kind", "key"]
        held = spark.read.parquet(turn_folder(state_path, batch_id - 1)) if batch_id > 0 else None
        fresh = rows
        if held is not None:
            hit = keys.join(held.select(*key), key, "left_semi").select(*row).distinct()
            fresh = rows.join(hit, row, "left_anti")
        fresh = cut_lineage(fresh)
        originals = cut_lineage(fresh.join(dedupe.mark_duplicates(fresh), row, "left_anti"))
        originals.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        new = keys.join(originals.select(*row, F.col(ts).alias("held_at")), row).select(*key, F.col("ref_id").alias("holder"), "held_at")
        both = new if held is None else held.unionByName(new)
        newest = both.agg(F.max("held_at").alias("newest"))  # one row
        both.join(F.broadcast(newest)).filter(F.col("held_at") >= F.col("newest") - F.expr(f"INTERVAL {delay}")).drop("newest").write.mode(
            "overwrite").parquet(turn_folder(state_path, batch_id))

    return refs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def probe_windows(probes: DataFrame, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Failure rate per host and tumbling event-time window; rows later than the watermark are dropped."""
    return probes.withWatermark("ts", delay).groupBy(F.window("ts", window), "host").agg(
        F.count("*").alias("n_probes"), F.count_if(F.col("error_kind").isNotNull()).alias("n_failures")).select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"), "host", "n_probes", "n_failures")


def probe_health_stream(probes: DataFrame, state_path: str, checkpoint: str, threshold: int = 2):
    """Host health kept over micro-batches: host, tail, longest_run, is_open, seen (last ts and probe), n_late.

    A micro-batch is reduced to one summary per host by the skew-safe batch operator and merged with the state so far.
    A probe older than the last one that the state has of its host is late: it is counted and changes no run.  An open
    host stays open; an answer resets the running count.

    Two folders take turns, so the state exists twice at most: batch n reads what batch n - 1 wrote and replaces what
    batch n - 2 wrote, and a replay of batch n finds its input untouched.  ``probe_health`` reads the last state."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(turn_folder(state_path, batch_id - 1)) if batch_id > 0 else None
        rows = batch.select("host", "ts", "probe_id", "error_kind")
        if before is None:
            timely, late = rows, None
        else:
            placed = rows.join(before.select("host", "seen"), "host", "left").withColumn(
                "late", F.coalesce(F.struct("ts", "probe_id") < F.col("seen"), F.lit(False)))
            timely, late = placed.filter("NOT late"), placed.filter("late").groupBy("host").agg(F.count("*").alias("new_late"))
        new = profile.run_summary(timely)
        if before is None:
            before = new.limit(0).select("host", "tail", F.col("longest").alias("longest_run"), F.lit(False).alias("is_open"), "seen",
                                         F.lit(0).cast("bigint").alias("n_late"))
        old = before.select("host", F.col("tail").alias("old_tail"), "longest_run", "is_open", F.col("seen").alias("old_seen"), "n_late")
        j = new.join(old, "host", "full_outer")
        j = j.join(late, "host", "left") if late is not None else j.withColumn("new_late", F.lit(None).cast("bigint"))
        carried = F.coalesce("old_tail", F.lit(0))
        joined = carried + F.coalesce("head", F.lit(0))
        longest = F.greatest(F.coalesce("longest_run", F.lit(0)), F.coalesce("longest", F.lit(0)),
                             F.when(F.col("head").isNotNull(), joined).otherwise(F.lit(0)))
        tail = F.when(F.col("head").isNull(), carried).when(F.col("all_failed"), joined).otherwise(F.col("tail"))
        j.select("host", tail.cast("bigint").alias("tail"), longest.cast("bigint").alias("longest_run"),
                 (F.coalesce("is_open", F.lit(False)) | (longest >= threshold)).alias("is_open"), F.coalesce("seen", "old_seen").alias("seen"),
                 (F.coalesce("n_late", F.lit(0)) + F.coalesce("new_late", F.lit(0))).cast("bigint").alias("n_late"),
                 F.lit(batch_id).cast("bigint").alias("version")).write.mode("overwrite").parquet(turn_folder(state_path, batch_id))

    return probes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def turn_folder(state_path: str, batch_id: int) -> str:
    return f"{state_path}/turn={batch_id % 2}"


def probe_health(spark: SparkSession, state_path: str) -> DataFrame:
    """The last state that ``probe_health_stream`` wrote."""
    both = spark.read.parquet(state_path).drop("turn")
    return both.join(F.broadcast(both.agg(F.max("version").alias("version"))), "version")


def trace_stream(results: DataFrame, path: str, checkpoint: str, run_date: str):
    """Append one trace row per list and micro-batch."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = exports.trace_rows(batch, score.scorecard(batch), run_date).withColumn("batch_id", F.lit(batch_id))
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return results.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()

"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are laid out in a shuffled order as one stream of words, cut into blocks of equal
size.  The schedule decides what is taken: slot ``i`` has the van der Corput point of ``i``, the cumulative target
weights (in blocks) map it to a source, and its rank among the slots of that source names the block it takes.  A slot
of a source that has given all its blocks is passed over.  The points of ``2 ** m`` slots are evenly spaced, so with as
many slots as blocks or more, each source meets at least its number of blocks, and gives exactly its quota.
A source smaller than its target is streamed again (epochs), at most ``most`` times.

Defined results: a null text has size 0; sizes of 0 take nothing; null is a source of its own, ranked last;
repeated rows are separate rows with equal results up to their place in the stream; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refledger.llm.common import WORD, only, word_count
from refledger.operators.common import number_rows
from refledger.session import cut_lineage

WEIGHTS = (5, 2, 1)
#: Rows of one source whose order is settled in one task, on average.
SLICE = 8192


@dataclass
class Mix:
    """``rows``: one row per document with its place; ``pieces``: what each slot of the schedule takes."""
    rows: DataFrame
    pieces: DataFrame
    slots: int


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """Each document's size and shuffle key.  ``dup`` tells repeated rows apart."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = only(docs, "doc_id", "text", "source").select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    w = Window.partitionBy("key", "source").orderBy("doc_id")
    return cut_lineage(rows.withColumn("dup", F.row_number().over(w)))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source: ``sid`` (rank by code point, null last), source_size, target, quota (whole words it gives).

    Shares follow the repeating weights; what a source may not take (``most`` times its size) is shared
    again among the others by weight, until none is above.  Each round is one aggregate over the sources.
    """
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = cut_lineage(sources.orderBy(F.col("source").asc_nulls_last()).withColumn(
        "__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("__part").agg(F.count("*").alias("__n")).withColumn(  # one row per task
        "__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    ranked = placed.join(offsets, "__part").withColumn(
        "sid", F.col("__off") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("sid", "source", "source_size", weight.alias("weight")))
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, capped = float(total or 0), 0.0, -1
    if total:
        level = total / all_weights
        while True:
            full = F.col("source_size") * most <= F.col("weight") * level
            n, taken, rest = ranked.agg(
                F.count_if(full), F.sum(F.when(full, F.col("source_size") * most)),
                F.sum(F.when(~full, F.col("weight")))).first()
            if n == capped or not rest:
                break
            capped, level = n, (total - (taken or 0.0)) / rest
    target = F.least(F.col("weight") * level, F.col("source_size") * most)
    return ranked.select("sid", "source", "source_size", target.alias("target")).withColumn(
        "quota", F.least(F.floor(F.col("target") + 0.3), F.floor(F.col("source_size") * most)))


def laid_out(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """Rows with ``off``, the words of the same source that come before in its shuffled stream.

    The stream is cut by the leading hex digits of the shuffle key; running sums inside a slice and over the
    slices' totals replace one sort per source.
    """
    n = rows.count()
    digits = max(0, math.ceil(math.log(max(1, n / SLICE), 16)))
    cut = rows.withColumn("__slice", F.substring("key", 1, digits))
    inside = Window.partitionBy("source", "__slice").orderBy("key", "doc_id", "dup").rowsBetween(
        Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("source", "__slice").agg(F.sum("size").alias("__n")).withColumn(
        "__base", F.coalesce(F.sum("__n").over(over), F.lit(0))).select(
        F.col("source").alias("__s"), F.col("__slice").alias("__c"), "__base")
    placed = cut.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        base, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__c")))
    known = by_source.withColumnRenamed("source", "__src")
    return placed.join(known, F.col("source").eqNullSafe(F.col("__src"))).select(
        "doc_id", "source", "size", "key", "dup", "sid", "source_size", "target", "quota",
        (F.col("__base") + F.col("__in")).alias("off"))


def schedule(by_source: DataFrame, block: int) -> tuple[DataFrame, int]:
    """(sid, block, slot, upto), and the number of blocks: the low-discrepancy order in which blocks of the sources are
    taken.  A slot takes the words of its source from ``block * block size`` to ``upto``."""
    spark = by_source.sparkSession
    parts = by_source.filter("quota > 0").select("sid", "quota", F.ceil(F.col("quota") / block).alias("blocks"))
    blocks, sources = parts.agg(F.coalesce(F.sum("blocks"), F.lit(0)), F.count("*")).first()
    bits = max(0, blocks - 1).bit_length()
    cells = max(1024, 1 << max(0, sources - 1).bit_length())
    # cumulative weights; the slots' points meet them cell by cell, so no slot meets all sources
    upto = Window.partitionBy("__one").orderBy("sid")  # one row per source
    cell = lambda at: F.floor(at * cells / max(1, blocks))
    parts = parts.withColumn("__one", F.lit(0)).withColumn("hi", F.sum("blocks").over(upto)).withColumn(
        "lo", F.col("hi") - F.col("blocks")).withColumn("cell", F.explode(F.sequence(
            cell(F.col("lo")), cell(F.col("hi") - 1))))
    # the point of a slot, as a place among the blocks, in whole numbers: every place has a slot
    point = F.conv(F.reverse(F.lpad(F.bin("id"), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")
    points = spark.range(1 << bits if blocks else 0).withColumn("at", F.shiftright(point * blocks, bits)).withColumn(
        "cell", cell(F.col("at")))
    met = points.join(parts.select("sid", "quota", "blocks", "lo", "hi", "cell"), "cell").filter("at >= lo AND at < hi").select(
        F.col("id").alias("slot"), "sid", "quota", "blocks")
    ranked = number_rows(met, ["sid"], "slot", "__rank").withColumn("block", F.col("__rank") - 1).filter("block < blocks")
    return ranked.select("sid", "block", "slot", F.least((F.col("block") + 1) * block, F.col("quota")).alias("upto")), blocks


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int = 128,
        seed: int = 42) -> Mix:
    """Mix of ``docs`` (doc_id, text, source).

    ``pieces``: slot, block, epoch and word range ``[lo, hi)`` of the document row (key, source, dup): what the
    blocks named by the schedule's slots hold of it.
    """
    rows = sized(docs, seed)
    by_source = cut_lineage(targets(rows, weights, most))
    placed = cut_lineage(laid_out(rows, by_source))
    order, slots = schedule(by_source, block)
    size, quota = F.col("size"), F.col("quota")
    epochs = F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))
    # places past the quota are in no block of the schedule
    runs = placed.filter("size > 0").withColumn("epoch", F.explode(epochs)).withColumn(
        "begin", F.col("off") + F.col("epoch") * F.col("source_size")).filter(F.col("begin") < quota).withColumn(
        "end", F.col("begin") + size)
    met = runs.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("begin") / block), F.floor((F.least(F.col("end"), quota) - 1) / block)))).join(order, ["sid", "block"])
    pieces = met.select(
        "doc_id", "key", "source", "dup", "sid", "epoch", "block", "slot",
        (F.greatest(F.col("begin"), F.col("block") * block) - F.col("begin")).alias("lo"),
        (F.least(F.col("end"), F.col("upto")) - F.col("begin")).alias("hi"))
    return Mix(placed, pieces, slots)


def taken_words(mixed: Mix) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, taken (the words that the schedule's slots name)."""
    sums = mixed.pieces.groupBy("key", "sid", "dup").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"))
    return mixed.rows.join(sums, ["key", "sid", "dup"], "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The mix as documents: one row per document and epoch it is taken in, in the order of the first slots that take
    words of them.  A document that is not taken whole keeps the words taken, joined by single blanks, and its new
    length in ``n_chars``."""
    mixed = mix(docs, seed=seed, **options)
    spans = mixed.pieces.groupBy("key", "source", "dup", "epoch").agg(
        F.sum(F.col("hi") - F.col("lo")).alias("__taken"), F.min(F.struct("slot", "lo")).alias("__first"),
        F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__spans")).select(
        F.col("key").alias("__key"), F.col("source").alias("__src"), F.col("dup").alias("__d"), F.col("epoch").alias("__epoch"),
        "__taken", F.col("__first.slot").alias("__slot"), "__spans")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                            F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    rows = docs.withColumn("__k", key).withColumn("__size", word_count(F.col("text"))).withColumn(
        "__n", F.row_number().over(Window.partitionBy("__k", "source").orderBy("doc_id")))
    found = rows.join(spans, (F.col("__k") == F.col("__key")) & F.col("source").eqNullSafe(F.col("__src"))
                      & (F.col("__n") == F.col("__d")))
    whole = F.col("__taken") == F.col("__size")
    part = F.array_join(F.flatten(F.transform("__spans", lambda x: F.slice(
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), (x.lo + 1).cast("int"), (x.hi - x.lo).cast("int")))), " ")
    text = F.when(whole, F.col("text")).otherwise(part)
    # documents that begin in one block follow in the order of their stream
    out = found.withColumn("__text", text).orderBy("__slot", "__k", "__n", "__epoch")
    changed = {"text": F.col("__text"), "n_chars": F.when(whole, F.col("n_chars")).otherwise(
        F.length("__text").cast("long"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])

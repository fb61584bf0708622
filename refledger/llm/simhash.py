"""SimHash near-duplicates: fingerprints of word shingles, linked within a radius by covering hashing.

A document's shingles are its ``n``-word sequences, repeats included (fewer words: the whole sequence).  Bit i of its
64-bit fingerprint is 1 where more than half of the shingles' XXH64 values have it.  Fingerprints link at ``RADIUS``
or fewer differing bits.

Covering hashing: every bit gets a non-zero vector of RADIUS + 1 bits; for each of the 15 non-zero vectors v, a table
compares the bits whose vector has an odd product with v.  The vectors of three differing bits span at most three
dimensions, so some v is orthogonal to all of them, and the pair agrees in that table.  No pair within the radius is
missed, whatever the data.

* Equal fingerprints are one node, so copies never meet in a table.
* Nodes that share a key in a table are compared in a small matrix if they are at most ``CELL``; it gives no more than a
  link a node.  A key with more nodes is split again by 15 tables over the bits that it leaves free.  A pair within the
  radius stays together in one of them at each level, and a key that leaves b bits free has no more than 2**b nodes, so
  splitting ends with every pair compared that can be within the radius.  All pairs of a key are never made.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; a document without id is
linked and counted, and the smallest id of a component is taken without it (null if there is no other); repeated rows
are separate rows of one node; without documents there are no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import arrow_map, no_null_text, only, split_words
from refledger.llm.components import components
from refledger.llm.spread import spread_lookup
from refledger.session import cut_lineage

ship_by_value(__name__)

WORDS, RADIUS, SEED = 3, 3, 42
#: Multipliers of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Vectors of the bits, those of one dimension first: so even four bits span all dimensions and every table splits.
VECTORS = [1, 2, 4, 8, 15, 3, 5, 6, 9, 10, 12, 7, 11, 13, 14]
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 16
#: Nodes of a key that are compared at once.
CELL = 256


def turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def stirred(lane: np.ndarray) -> np.ndarray:
    return turned(lane * P2, 31) * P1


def xxh64(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of ``data`` at once: all ranges take each step together while they have bytes left."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    four = np.lib.stride_tricks.as_strided(padded[:4].view("<u4"), shape=(len(data) + 1,), strides=(1,))
    size, at = hi - lo, lo.copy()
    h = np.full(len(lo), seed, np.uint64) + P5
    rows = np.flatnonzero(size >= 32)
    if len(rows):
        start = np.full(len(rows), seed, np.uint64)
        acc = [(start + P1) + P2, start + P2, start.copy(), start - P1]
        live = np.arange(len(rows))
        while len(live):
            place = at[rows[live]]
            for k in range(4):
                acc[k][live] = turned(acc[k][live] + eight[place + 8 * k] * P2, 31) * P1
            at[rows[live]] += 32
            live = live[hi[rows[live]] - at[rows[live]] >= 32]
        long = turned(acc[0], 1) + turned(acc[1], 7) + turned(acc[2], 12) + turned(acc[3], 18)
        for a in acc:
            long = (long ^ stirred(a)) * P1 + P4
        h[rows] = long
    h += size.astype(np.uint64)
    rows = np.flatnonzero(hi - at >= 8)
    while len(rows):
        h[rows] = turned(h[rows] ^ stirred(eight[at[rows]]), 27) * P1 + P4
        at[rows] += 8
        rows = rows[hi[rows] - at[rows] >= 8]
    rows = np.flatnonzero(hi - at >= 4)
    h[rows] = turned(h[rows] ^ (four[at[rows]].astype(np.uint64) * P1), 23) * P2 + P3
    at[rows] += 4
    rows = np.flatnonzero(hi > at)
    while len(rows):
        h[rows] = turned(h[rows] ^ (data[at[rows]].astype(np.uint64) * P5), 11) * P1
        at[rows] += 1
        rows = rows[hi[rows] > at[rows]]
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def fingerprint_values(column: pa.Array, n: int = WORDS) -> np.ndarray:
    """Fingerprint of each text."""
    data, bounds, counts = split_words(no_null_text(column))
    out = np.zeros(len(counts), np.uint64)
    if not len(bounds):
        return out
    # the words again, each behind the one before it and a space: a shingle is one range of these bytes
    width = bounds[:, 1] - bounds[:, 0]
    end = np.cumsum(width + 1) - 1
    begin = end - width
    joined = np.full(end[-1] + 1, 32, np.uint8)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[bounds[:, 0]] += 1
    mark[bounds[:, 1]] -= 1
    inside = np.ones(len(joined), bool)
    inside[end] = False
    joined[inside] = data[np.cumsum(mark[:-1], dtype=np.int8) > 0]
    first = np.cumsum(counts) - counts
    sizes = np.where(counts > 0, np.maximum(counts - n + 1, 1), 0)
    row = np.repeat(np.arange(len(counts)), sizes)
    at = np.repeat(first, sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    last = np.minimum(at + n, np.repeat(first + counts, sizes)) - 1
    set_bits = np.zeros((len(counts), 64), np.int64)
    for i in range(0, len(row), AT_ONCE):
        part = slice(i, i + AT_ONCE)
        bits = np.unpackbits(xxh64(joined, begin[at[part]], end[last[part]]).astype("<u8").view(np.uint8).reshape(-1, 8),
                             axis=1, bitorder="little")
        here, start = np.unique(row[part], return_index=True)
        set_bits[here] += np.add.reduceat(bits, start, axis=0, dtype=np.int64)
    wins = (2 * set_bits > sizes[:, None]).astype(np.uint8)
    return np.packbits(wins, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every document as a 64-bit pattern."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprint_values(batch.column(1), n).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return arrow_map(only(docs, "doc_id", "text"), one, "doc_id bigint, fp bigint")


@lru_cache(maxsize=1 << 16)
def still_free(free: int) -> tuple[int, ...]:
    """For each table over the ``free`` bits, the bits that stay free in it."""
    places = [i for i in range(64) if free >> i & 1]
    return tuple({
        sum(1 << p for j, p in enumerate(places) if (VECTORS[j % 15] & v).bit_count() % 2 == 0)
        for v in range(1, 1 << (RADIUS + 1))})


def dealt(members: DataFrame) -> DataFrame:
    """(free, key, fp): each (fp, free) in the tables over its free bits; key is what a table compares."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy().view(np.uint64)
        kinds, which = np.unique(batch.column(1).to_numpy().view(np.uint64), return_inverse=True)
        lists = [np.array(still_free(int(k)), np.uint64) for k in kinds]
        size = np.array([len(x) for x in lists], np.int64)
        start = np.cumsum(size) - size
        n = size[which]
        row = np.repeat(np.arange(len(fp)), n)
        place = np.repeat(start[which], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        free = np.concatenate(lists)[place] if len(lists) else np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(x.view(np.int64)) for x in (free, fp[row] & ~free, fp[row])], names=["free", "key", "fp"])

    return arrow_map(members.select("fp", "free"), one, "free bigint, key bigint, fp bigint")


def cell_links(cells: DataFrame) -> DataFrame:
    """(a, b): for each node of a cell (fps: at most ``CELL`` nodes) a link to the smallest node that it reaches there."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for fps in batch.column(0):
            fp = np.sort(fps.values.to_numpy())
            bits = fp.view(np.uint64)
            near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= RADIUS
            least, before = near.argmax(axis=1), None
            while before is None or (least != before).any():
                before = least
                least = np.where(near, before[None, :], len(fp)).min(axis=1)
            linked = least < np.arange(len(fp))
            a.append(fp[linked])
            b.append(fp[least[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

    return arrow_map(cells.select("fps"), one, "a bigint, b bigint")


def near_links(nodes: DataFrame) -> DataFrame:
    """(node, root): components of the distinct fingerprints of ``nodes`` (fp) that have a link."""
    members, found = nodes.select("fp", F.lit(-1).cast("long").alias("free")), []
    while True:
        tables = cut_lineage(dealt(members).distinct() if found else dealt(members))
        groups = cut_lineage(tables.groupBy("free", "key").agg(
            F.min("fp").alias("b"), F.max("fp").alias("a"), F.count("*").alias("n")).filter("n > 1"))
        found.append(groups.filter(F.col("n") == 2).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b"))
        rest = cut_lineage(tables.join(groups.filter("n > 2").select("free", "key", "n"), ["free", "key"]))
        cells = rest.filter(F.col("n") <= CELL).groupBy("free", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(cell_links(cells))
        members = rest.filter(F.col("n") > CELL).select("fp", "free")
        if members.isEmpty():
            return components(reduce(DataFrame.unionByName, found))


def near_duplicates(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, and members: the documents of the component."""
    fps = cut_lineage(fingerprints(docs, n))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = near_links(nodes).withColumnRenamed("node", "fp")
    rooted = cut_lineage(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    whole = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), F.sum("copies").alias("members"), F.count("*").alias("nodes"))
    named = spread_lookup(rooted, whole, "root", "nodes", rooted.count()).select("fp", "copies", "component_id", "members")
    out = spread_lookup(fps, cut_lineage(named), "fp", "copies", fps.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "members")

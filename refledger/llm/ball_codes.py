"""Vector code compression: product codes whose codebooks are learned by exact ball k-means.

Components become integers floor(4096 * x); a vector is cut into ``parts`` equal consecutive parts, and every part
position has a codebook of ``entries`` integer entries.  A round assigns every part to its nearest entry (squared
distance, ties to the lower index) and moves each entry to the componentwise floor of its parts' mean.

Ball k-means: the parts of an entry form a ball around it, with the largest distance of a member as its radius.

* Only entries nearer than two radii are *neighbours*; no other can be nearest to any part of the ball.
* A ball whose entry and neighbours all stayed where they were keeps its parts without any distance (stable ball).
* Within a ball, the neighbour at distance D is compared only with parts at D / 2 or more from their own entry: parts
  nearer than half the nearest neighbour (stable core) meet none, and each ring meets the neighbours up to its own.

All these comparisons are between whole numbers, so the result is that of comparing every part with every entry.
The radius of the next round is at most the present one plus the entry's move; both come out of the round itself.

A round is one pass: tasks read the vectors with their codes, write them with new codes, and put the sums, counts and
radii of their batch beside its first row, so that a lost task repeats its rows and its statistics together.  Spark
adds the statistics; the driver gets parts x entries x (part length + 3) numbers, whatever the rows.  Two folders of
the shared folder take turns, so at most two copies of the codes exist.

Defined results: rows whose vector is null, empty, or holds null or non-finite components are dropped; repeated rows
are separate vectors; rows of equal id start in the order of their vectors, rows without id come last; with fewer rows
than entries the codebooks are smaller; vectors whose length is another than the first one's, or no multiple of
``parts``, keep their row with null code, error and label_error; without vectors there are no rows; a component beyond
+-2**14 (for vectors up to 256 components) stops the job with an error, as squared distances might pass 64 bits when
added; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import only, pieces, shared_folder
from refledger.llm.spread import spread_lookup

ship_by_value(__name__)

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows handled at once.
ROWS = 1 << 14
STATE = "vec_id bigint, label int, x array<int>, code binary, error bigint, stats array<bigint>"


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, every entry compared."""
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for j, entry in enumerate(book):
        d = ((x - entry) ** 2).sum(axis=1)
        closer = d < best
        best[closer], at[closer] = d[closer], j
    return at, best


class Balls:
    """What the entries of one part position tell about where a part can go."""

    def __init__(self, book: np.ndarray, radius2: np.ndarray, moved: np.ndarray) -> None:
        gap2 = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        self.book, self.near, self.stable = book, [], []
        for i in range(len(book)):
            # D <= 2 r; at D = 2 r a part may be equally near to both
            order = sorted((int(gap2[i, j]), j) for j in range(len(book)) if j != i and gap2[i, j] <= 4 * radius2[i])
            self.near.append(order)
            self.stable.append(not moved[i] and not any(moved[j] for _, j in order))

    def reassigned(self, x: np.ndarray, at: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and squared distance to the nearest entry of parts that were nearest to ``at`` at ``error``."""
        new, best = at.copy(), error.copy()
        for i in np.unique(at):
            if self.stable[i]:
                continue
            mine = np.flatnonzero(at == i)
            own = ((x[mine] - self.book[i]) ** 2).sum(axis=1)
            best[mine] = own
            order = np.argsort(own, kind="stable")
            mine, own = mine[order], own[order]
            for gap2, j in self.near[i]:
                ring = mine[np.searchsorted(4 * own, gap2):]  # from half the gap outwards
                if not len(ring):
                    break
                d = ((x[ring] - self.book[j]) ** 2).sum(axis=1)
                closer = (d < best[ring]) | ((d == best[ring]) & (j < new[ring]))
                best[ring[closer]], new[ring[closer]] = d[closer], j
        return new, best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, x): the rows that take part, with integer components."""
    floored = F.transform("embedding", lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    small = F.forall("embedding", lambda v: F.abs(v) < 1 << 14)
    return only(vectors, "vec_id", "embedding", "label").filter(
        "size(embedding) > 0 AND forall(embedding, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity'))"
    ).select("vec_id", "label", F.when(small, floored).otherwise(
        F.raise_error(F.lit("a vector component is beyond +-16384"))).alias("x"))


def assigned(state: DataFrame, books: np.ndarray, balls: list[Balls] | None) -> DataFrame:
    """``state`` with new codes and errors, and the statistics of each batch beside its first row.

    stats holds, for every part and entry, the sums of the components, the count, and the largest squared distance.
    """
    parts, entries, width = books.shape

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        vec_id, label, col, code = (batch.column(i) for i in range(4))
        n = batch.num_rows
        fits = np.array(col.value_lengths().to_numpy(zero_copy_only=False) == parts * width)
        rows = np.flatnonzero(fits)
        x = col.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), parts, width).astype(np.int64)
        if balls is not None:
            old = np.frombuffer(b"".join(code.filter(pa.array(fits)).to_pylist()), np.uint8).reshape(len(rows), 9 * parts)
            old_at, old_error = old[:, :parts].astype(np.int64), old[:, parts:].copy().view("<i8").reshape(len(rows), parts)
        at, error = np.zeros((len(rows), parts), np.int64), np.zeros((len(rows), parts), np.int64)
        stats = np.zeros((parts, entries, width + 2), np.int64)
        for p in range(parts):
            if balls is None:
                at[:, p], error[:, p] = nearest(x[:, p], books[p])
            else:
                at[:, p], error[:, p] = balls[p].reassigned(x[:, p], old_at[:, p], old_error[:, p])
            np.add.at(stats[p, :, :width], at[:, p], x[:, p])
            stats[p, :, width] = np.bincount(at[:, p], minlength=entries)
            np.maximum.at(stats[p, :, width + 1], at[:, p], error[:, p])
        both = np.concatenate([at.astype(np.uint8), np.ascontiguousarray(error).view(np.uint8).reshape(len(rows), 8 * parts)], axis=1)
        codes, errors = [None] * n, [None] * n
        for i, c, e in zip(rows.tolist(), both, error.sum(axis=1).tolist()):
            codes[i], errors[i] = c.tobytes(), e
        return pa.RecordBatch.from_arrays(
            [vec_id, label, col, pa.array(codes, pa.binary()), pa.array(errors, pa.int64()),
             pa.array([stats.ravel().tolist()] + [None] * (n - 1), pa.list_(pa.int64()))],
            names=["vec_id", "label", "x", "code", "error", "stats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, ROWS, 1 << 24):
                yield one(part)

    return state.mapInArrow(run, STATE)


def statistics(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and largest squared distances by part and entry, added up in Spark."""
    parts, entries, width = shape
    rows = state.filter("stats IS NOT NULL").select(F.posexplode("stats").alias("at", "v")).groupBy("at").agg(
        F.when(F.first("at") % (width + 2) == width + 1, F.max("v")).otherwise(F.sum("v")).alias("v")).collect()
    out = np.zeros(parts * entries * (width + 2), np.int64)
    for r in rows:
        out[r["at"]] = r["v"]
    out = out.reshape(parts, entries, width + 2)
    return out[:, :, :width], out[:, :, width], out[:, :, width + 1]


def sum_root(a2: int, b2: int) -> int:
    """At least the square of a + b, from their squares, in whole numbers."""
    return (isqrt(a2) + isqrt(b2) + 2) ** 2 if b2 else a2


def coded(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code binary, error) of every vector that takes part, and the codebooks (parts, entries, length)."""
    ints = usable(vectors)
    first = ints.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    width = len(first[0]["x"]) // parts if first and len(first[0]["x"]) % parts == 0 else 0
    seeds = [r["x"] for r in first if width and len(r["x"]) == parts * width]
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    state = ints.select("*", *[F.lit(None).cast(t).alias(n) for n, t in (("code", "binary"), ("error", "bigint"), ("stats", "array<bigint>"))])
    if not seeds:
        return state.drop("x", "stats"), books
    folders, balls, settled = [shared_folder(spark, f"codes{i}") for i in range(2)], None, False
    for i in range(rounds + 1):
        assigned(state, books, balls).write.mode("overwrite").parquet(folders[i % 2])
        state = spark.read.schema(STATE).parquet(folders[i % 2])
        if i == rounds or settled:
            break
        sums, counts, far2 = statistics(state, books.shape)
        new = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
        step2 = ((new - books) ** 2).sum(axis=2)
        balls = [Balls(new[p], np.array([sum_root(int(a), int(b)) for a, b in zip(far2[p], step2[p])], np.int64), step2[p] > 0)
                 for p in range(parts)]
        books, settled = new, not step2.any()
        if settled:  # all balls are stable: the codes are final
            break
    return state.drop("x", "stats").withColumn("code", F.substring("code", 1, parts)), books


def compressed(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
               rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (hex), error, label_error, codebooks_sha256 of every vector that takes part."""
    rows, books = coded(spark, vectors, parts, entries, rounds)
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = rows.groupBy("label").agg(F.sum("error").alias("sum"), F.count("*").alias("n"))
    out = spread_lookup(rows, by_label, "label", "n", rows.count())
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error",
                      F.when(F.col("error").isNotNull(), F.col("sum")).alias("label_error"), F.lit(sha).alias("codebooks_sha256"))

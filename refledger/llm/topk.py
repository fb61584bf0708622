"""Exact top-k inner-product search over norm buckets.

Vectors are grouped by length (logarithmic classes, cut into blocks of bounded size).  Every query first meets
the block of the longest vectors; its k-th best product there is its threshold.  A block whose longest vector
cannot reach any threshold of a query block is left out.  Inside a block the threshold becomes a cosine
threshold: a steep one is met by coordinate pruning (intervals that the query's largest coordinates leave to
any vector within that cosine), a flat one by length pruning (the sorted lengths), and what is left is verified by the
integer products.  Queries and candidates meet block by block in bounded tasks.

Defined results: rows with a null id, a null vector, or a null or non-finite component take no part; repeated rows
are separate queries and candidates, and only the query's own row is left out; vectors meet only vectors of
their own dimension; ties go to the smaller id; products are exact below 2**63.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import only
from refledger.operators.common import top_k
from refledger.session import cut_lineage

ship_by_value(__name__)

#: Rows of a block of candidates and of queries, on average; classes of squared length per factor of two.
ROWS, QUERY_ROWS, CLASSES = 8192, 1024, 8
#: Local cosine threshold from which coordinates prune, and the number of coordinates looked at.
STEEP, FOCUS = 0.7, 3

RESULT = "query_id long, qkey long, qcopies long, vec_id long, score long, n int"


def scaled(embedding: Column, factor: float) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(factor) * x.cast("double")))


def usable(embedding: Column) -> Column:
    big = F.lit(float("inf"))
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products; through floating point where every partial sum is below 2**53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def within(unit: np.ndarray, cosine: float, others: np.ndarray) -> np.ndarray:
    """Rows of unit vectors that the largest coordinates of ``unit`` don't exclude at that cosine."""
    keep = np.ones(len(others), bool)
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        spread = math.sqrt(max(0.0, 1 - cosine * cosine) * max(0.0, 1 - unit[f] * unit[f]))
        hi = 1.0 if unit[f] >= cosine else cosine * unit[f] + spread
        lo = -1.0 if unit[f] <= -cosine else cosine * unit[f] - spread
        keep &= (others[:, f] >= lo - 1e-9) & (others[:, f] <= hi + 1e-9)
    return keep


def tile(k: int):
    """Best ``k`` candidates of a block for each query of a query block."""
    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, c = matrix(left["ints"]), matrix(right["c_ints"])
            ids, copies = right["c_vec_id"].to_numpy(), right["c_copies"].to_numpy()
            lengths = np.sqrt((c.astype(np.float64) ** 2).sum(1))
            order = np.argsort(-lengths, kind="stable")
            c, ids, copies, lengths = c[order], ids[order], copies[order], lengths[order]
            units = c / np.maximum(lengths, 1e-300)[:, None]
            q_len = np.sqrt((q.astype(np.float64) ** 2).sum(1))
            theta = left["theta"].to_numpy(zero_copy_only=False).astype(np.float64)
            top = np.maximum(q_len * lengths[0], 1e-300)
            cosine = np.where(theta > 0, theta / top, -1.0)
            names, keys, own = left["vec_id"].to_numpy(), left["qkey"].to_numpy(), left["copies"].to_numpy()

            def take(i: int, places: np.ndarray, scores: np.ndarray) -> None:
                """The k best places of query i, its own row left out."""
                if len(scores) > k + 1:
                    kth = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    near = np.flatnonzero(scores >= kth)
                    places, scores = places[near], scores[near]
                left_over = k
                for j in np.lexsort((ids[places], -scores)):
                    p = places[j]
                    n = int(copies[p]) - int(ids[p] == names[i] and np.array_equal(c[p], q[i]))
                    n = min(n, left_over)
                    if n > 0:
                        out.append((int(names[i]), int(keys[i]), int(own[i]), int(ids[p]), int(scores[j]), n))
                        left_over -= n
                    if not left_over:
                        break

            reach = cosine <= 1 + 1e-9
            steep = reach & (cosine >= STEEP)
            for i in np.flatnonzero(steep):
                places = np.flatnonzero(within(q[i] / max(q_len[i], 1e-300), cosine[i], units))
                if len(places):
                    take(i, places, products(q[i:i + 1], c[places])[0])
            flat = np.flatnonzero(reach & ~steep)
            for part in np.array_split(flat, max(1, len(flat) // 256)):
                if len(part):
                    needed = np.where(theta[part] > 0, theta[part] / np.maximum(q_len[part], 1e-300), -1.0).min()
                    upto = int(np.searchsorted(-lengths, -(needed * (1 - 1e-9)), side="right"))
                    places, scores = np.arange(upto), products(q[part], c[:upto])
                    for i, row in zip(part, scores):
                        take(i, places, row)
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.int32()]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(
            ["query_id", "qkey", "qcopies", "vec_id", "score", "n"], columns, kinds)})

    return best


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, factor: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest products of each row whose id is divisible by ``every``."""
    rows = only(vectors, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select("vec_id", scaled(F.col("embedding"), factor).alias("ints")).groupBy("vec_id", "ints").agg(
        F.count("*").alias("copies"))
    squared = F.aggregate("ints", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = cut_lineage(rows.withColumns({
        "dim": F.size("ints"), "norm": F.sqrt(squared), "qkey": F.xxhash64("vec_id", "ints")}).withColumn(
        "class", F.floor(F.log2(F.col("norm") * F.col("norm") + 1) * CLASSES)))

    sizes = rows.groupBy("dim", "class").agg(F.ceil(F.count("*") / ROWS).alias("parts"))  # a row per length class
    wanted = rows.filter(F.col("vec_id") % every == 0)
    q_parts = wanted.groupBy("dim", "class").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    blocks = rows.join(sizes, ["dim", "class"]).withColumn("part", F.pmod("qkey", F.col("parts")))
    asked = wanted.join(q_parts, ["dim", "class"]).withColumn("qpart", F.pmod("qkey", F.col("parts"))).select(
        "dim", F.col("class").alias("qclass"), "qpart", "vec_id", "ints", "copies", "qkey", "norm")
    keys, q_keys = ["dim", "class", "part"], ["dim", "qclass", "qpart"]
    per_block = blocks.groupBy(*keys).agg(F.max("norm").alias("longest"))
    head = top_k(per_block, ["dim"], [F.desc("class"), F.asc("part")], 1).drop("rank", "longest")

    def met(tiles: DataFrame, queries: DataFrame) -> DataFrame:
        left = queries.join(tiles, q_keys).select(*q_keys, "class", "part", "vec_id", "ints", "copies", "qkey", "theta")
        by = [*q_keys, "class", "part"]
        right = blocks.join(tiles, keys).select(
            *[F.col(c).alias(f"c_{c}") for c in by], *[F.col(c).alias(f"c_{c}") for c in ("vec_id", "ints", "copies")])
        return left.groupBy(*by).cogroup(right.groupBy(*[f"c_{c}" for c in by])).applyInArrow(tile(k), RESULT)

    q_blocks = asked.groupBy(*q_keys).agg(F.max("norm").alias("q_longest"))
    unknown = asked.withColumn("theta", F.lit(None).cast("double"))
    first = cut_lineage(met(q_blocks.join(head, "dim").drop("q_longest"), unknown.fillna(0.0, ["theta"])))
    down = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    bounds = first.withColumn("upto", F.sum("n").over(down)).filter(F.col("upto") >= k).groupBy("query_id", "qkey").agg(
        F.max("score").cast("double").alias("theta")).select(F.col("qkey").alias("__k"), F.col("query_id").alias("__q"), "theta")
    known = asked.join(bounds, (F.col("qkey") == F.col("__k")) & (F.col("vec_id") == F.col("__q")), "left").drop(
        "__k", "__q").fillna(0.0, ["theta"])
    reach = known.groupBy(*q_keys).agg(F.max("norm").alias("q_longest"), F.min("theta").alias("least"))
    rest = per_block.join(head, keys, "left_anti")
    tiles = reach.join(rest, "dim").filter(
        (F.col("least") <= 0) | (F.col("q_longest") * F.col("longest") * (1 + 1e-9) >= F.col("least"))).select(
        *q_keys, "class", "part")
    found = first.unionByName(met(tiles, known)).withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("n"))))
    best = top_k(found, ["query_id", "qkey"], [F.desc("score"), F.asc("vec_id")], k)
    return best.withColumn("__q", F.explode(F.sequence(F.lit(1).cast("long"), F.col("qcopies")))).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

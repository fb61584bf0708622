"""Building blocks shared by the operators: skew-safe lookups, firsts, numbering and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_SPREAD = 1024


def lookup(left: DataFrame, table: DataFrame, key: Column, table_key: str, row_id: str,
           keep: dict[str, Column]) -> DataFrame:
    """Left join to a table that holds at most one row per key.

    Rows without a key would all hash to one partition, so their join key is spread by row id
    (a leading NUL keeps it apart from real keys).  A key shared by many left rows is split by the
    adaptive skew join, which replicates only the matching slice of ``table``.
    """
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(F.col(row_id)), F.lit(NULL_SPREAD)).cast("string"))
    right = table.select(F.col(table_key).alias("__rkey"), *[c.alias(n) for n, c in keep.items()])
    return left.join(right, F.coalesce(key, spread) == F.col("__rkey"), "left").drop("__rkey")


def first_row_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key under ``order``, as an aggregation with a map-side part (no window)."""
    fields = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in fields])
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in fields])


def best_row_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Row with the largest ``order`` per key."""
    fields = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in fields])
    picked = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in fields])


def number_rows(df: DataFrame, keys: list[str], order_id: str, out: str, rank: str | None = None,
                width: int = 65536) -> DataFrame:
    """``row_number`` within ``keys`` by (``rank``, ``order_id``) without one task per key.

    ``order_id`` is an integer.  Rows are numbered inside slices of ``width`` consecutive ids; a
    key's slices get their offsets from a running sum over slice counts, which are ``width`` times
    fewer than the rows.
    """
    level = F.col(rank) if rank else F.lit(0)
    sliced = df.withColumn("__lv", level).withColumn("__sl", F.floor(F.col(order_id) / width))
    part = [*keys, "__lv", "__sl"]
    within = Window.partitionBy(*part).orderBy(order_id)
    across = Window.partitionBy(*keys).orderBy("__lv", "__sl").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*part).agg(F.count("*").alias("__n"))
        .withColumn("__off", F.coalesce(F.sum("__n").over(across), F.lit(0)))
        .select(*[F.col(k).alias(f"__o_{k}") for k in part], "__off")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in part]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return (
        sliced.withColumn("__rn", F.row_number().over(within))
        .join(offsets, cond)
        .withColumn(out, F.col("__rn") + F.col("__off"))
        .select(*df.columns, out)
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key.  The filter on row_number lets Spark keep k rows per key and map
    task before the shuffle (window group limit), so a large key never reaches one task whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)

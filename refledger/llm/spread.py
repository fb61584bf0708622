"""Lookup by a key that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least one in so many rows is heavy; so there are never more heavy keys than this.
SHARE = 1000


def spread_lookup(rows: DataFrame, keyed: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row per ``key`` (null is a key) and in ``n`` how many of
    the ``total`` rows carry it.

    Heavy keys, at most ``SHARE`` by their definition, are broadcast and their rows stay where they are; the rows of
    all other keys, each less than one in ``SHARE``, are shuffled by key.  ``rows`` is read twice.
    """
    heavy = F.col(n) * SHARE >= F.lit(total)
    named = [F.col(c).alias(f"__{c}") for c in keyed.columns]
    added = [F.col(f"__{c}").alias(c) for c in keyed.columns if c not in (key, n)]
    hot, rest = F.broadcast(keyed.filter(heavy).select(*named)), keyed.filter(~heavy).select(*named)
    same = F.col(key).eqNullSafe(F.col(f"__{key}"))
    kept = [F.col(c) for c in rows.columns]
    out = rows.join(hot, same).select(*kept, *added)
    return out.unionByName(rows.join(hot, same, "left_anti").join(rest, same).select(*kept, *added))

"""Sequence similarity.

``seq_ratio`` is the exact Ratcliff/Obershelp ratio.  It has no native form, so it is the one Arrow
UDF here; the native bounds below cut the candidate rows before any of them leave the JVM.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refledger.functions.shipping import ship_by_value
from refledger.functions.text import title_key, token_or_prefix_sim, token_sim

ship_by_value(__name__)

Similarity = Callable[[Column, Column], Column]


def _ratio(a: str, b: str) -> float:
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(T.DoubleType())
def seq_ratio(claimed: pd.Series, registered: pd.Series) -> pd.Series:
    """Ratio of claimed against registered; argument order matters. Null when either is null."""
    seen: dict[tuple, float] = {}
    out = []
    for pair in zip(claimed, registered):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else _ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the two lengths alone."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(F.lit(1.0))


def bag_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the shared character multiset."""
    la, lb = F.length(a), F.length(b)

    def count(s, ch):
        return F.length(s) - F.length(F.replace(s, ch, F.lit("")))

    shared = F.aggregate(
        F.array_distinct(F.split(a, "")),
        F.lit(0),
        lambda acc, ch: acc + F.least(count(a, ch), count(b, ch)),
    )
    return F.when(la + lb > 0, 2.0 * shared / (la + lb)).otherwise(F.lit(1.0))


def _ratio_unless_equal(a: Column, b: Column) -> Column:
    """Equal strings score 1 natively and reach the UDF as nulls."""
    differ = a != b
    return F.when(a == b, F.lit(1.0)).otherwise(seq_ratio(F.when(differ, a), F.when(differ, b)))


def lower_ratio(claimed: Column, registered: Column) -> Column:
    """Sequence ratio of the lower-cased titles; null when either is null."""
    return _ratio_unless_equal(F.lower(claimed), F.lower(registered))


def key_ratio(a: Column, b: Column) -> Column:
    return _ratio_unless_equal(title_key(a), title_key(b))


def title_sim(a: Column, b: Column) -> Column:
    """Larger of the sequence ratio on title keys and the token Jaccard; null when either is null."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.greatest(key_ratio(a, b), token_sim(a, b)))


def token_only(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), token_sim(a, b))


def ratio_or_prefix(a: Column, b: Column) -> Column:
    """``lower_ratio`` of the first text with the second, or with as long a beginning of it, whichever is larger."""
    head = F.when(F.length(b) >= F.length(a), F.substr(b, F.lit(1), F.length(a)))
    return F.greatest(lower_ratio(a, b), lower_ratio(a, head))


def token_or_prefix(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), token_or_prefix_sim(a, b))


class SimilarityModel:
    """The measures the matchers use: on plain titles, on title keys, the two-channel one, and on titles or their beginnings.

    ``sequence`` is the default; ``token`` replaces the sequence ratio by the token Jaccard, which
    stays inside the JVM and has an SQL equivalent.
    """

    def __init__(self, name: str, plain: Similarity, key: Similarity, title: Similarity, prefix: Similarity):
        self.name, self.plain, self.key, self.title, self.prefix = name, plain, key, title, prefix


SEQUENCE = SimilarityModel("sequence", lower_ratio, key_ratio, title_sim, ratio_or_prefix)
TOKEN = SimilarityModel("token", token_only, token_only, token_only, token_or_prefix)

"""Signatures of title keys: they never differ by more than the edits, and unrelated titles of shared words leave by them."""

import random

import pytest
from pyspark.sql import functions as F

from refledger.operators import dedupe

ALPHABET = "aaeeiinnrstßéж一丁字0189xyz"


def edits(a, b):
    """Fewest insertions and deletions from one key to the other."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return row[-1]


def test_signatures_differ_by_no_more_than_the_edits(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        a = [rng.choice(ALPHABET) for _ in range(rng.randint(8, 60))]
        b = list(a) if rng.random() < 0.7 else [rng.choice(ALPHABET) for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(b))
            b[at:at + 1] = rng.choice([[], [b[at], rng.choice(ALPHABET)], [rng.choice(ALPHABET)]])
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").withColumns({x: dedupe._signature(F.col(x[-1])) for x in ("sa", "sb")})
    far = 0
    for r in df.collect():
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(r.sa, r.sb))
        assert bits <= edits(r.a, r.b)
        far += bits > 10
    assert far > 30


@pytest.mark.parametrize("small", [0, 256])
def test_unrelated_titles_of_one_beginning_are_no_candidates(spark, monkeypatch, small):
    """300 titles of equal length that begin alike share segments at the same places, but nothing else."""
    monkeypatch.setattr(dedupe, "SMALL_LIST", small)
    rng = random.Random(4)
    rows = [(1, "proceedingsof" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40))) for _ in range(300)]
    near = [(1, rows[0][1][:-1] + "0"), (1, rows[1][1][:20] + rows[1][1][21:])]
    nodes = spark.createDataFrame(rows + near, "list_id bigint, title_key string")
    found = {(r.title_key_a, r.title_key_b) for r in dedupe._near_candidates(nodes).collect()}
    assert len(found) < 1000  # it was all 45,000 and more
    for (_, a), (_, b) in zip(rows, near):
        assert tuple(sorted((a, b), key=lambda t: (len(t), t))) in found

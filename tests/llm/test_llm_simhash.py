"""Covering SimHash against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_rows import ODD

from refledger.llm import simhash
from refledger.llm.spread import spread_lookup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    values = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(max(len(words) - 2, 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_roots(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    return {f: find(f) for f in root}


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    roots = brute_roots(set(fps))
    out = []
    for (i, _), f in zip(rows, fps):
        same = [j for (j, _), g in zip(rows, fps) if roots[g] == roots[f]]
        out.append((i, f"{f:016x}", min((j for j in same if j is not None), default=None), len(same)))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id", "members").collect()), key=repr)


def test_xxh64_of_ranges():
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(4000)), np.uint8)
    lo = np.array([rng.randrange(0, 3700) for _ in range(2000)] + [4000])
    hi = lo + np.array([rng.randrange(0, 200) for _ in range(2000)] + [0])
    got = simhash.xxh64(data, lo, hi)
    assert all(int(g) == xxhash.xxh64_intdigest(bytes(data[a:b]), 42) for g, a, b in zip(got, lo, hi))


def test_fingerprints_of_odd_texts(monkeypatch):
    texts = [t for _, t in ODD] + ["a b", "A  B\tc", "é Ü ß x y 中文 " * 50]
    want = [brute_fingerprint(t) for t in texts]
    assert [int(v) for v in simhash.fingerprint_values(pa.array(texts))] == want
    monkeypatch.setattr(simhash, "AT_ONCE", 7)  # a text longer than what is counted at once
    short = [t for t in texts if not t or len(t) < 2000]
    assert [int(v) for v in simhash.fingerprint_values(pa.array(short))] == [w for w, t in zip(want, texts) if not t or len(t) < 2000]


def test_odd_rows(odd_docs):
    assert found(simhash.near_duplicates(odd_docs)) == brute_components(ODD)


def test_no_rows(no_docs):
    assert found(simhash.near_duplicates(no_docs)) == []


def test_ids_of_a_component(make_docs):
    rows = [(None, "x y z"), (None, "x y z"), (7, "p q r"), (None, "p q r"), (3, "p Q r"), (None, None), (9, " \n")]
    assert found(simhash.near_duplicates(make_docs(rows))) == brute_components(rows)


def test_every_table_splits_and_covers():
    free = (1 << 64) - 1
    while free.bit_count() > 3:
        rng = random.Random(free & 1023)
        places = [i for i in range(64) if free >> i & 1]
        tables = simhash.still_free(free)
        for _ in range(300):
            differing = sum(1 << p for p in rng.sample(places, 3))
            assert any(differing & ~t == 0 for t in tables)
        assert all(t.bit_count() < free.bit_count() for t in tables)
        free = max(tables, key=int.bit_count)


@pytest.mark.parametrize("seed, cell", [(1, 256), (2, 64), (1, 12)])
def test_dense_groups_lose_no_link(spark, monkeypatch, seed, cell):
    """Clouds of fingerprints around few centres: keys with many nodes, most of them further apart than the radius."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(seed)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum({1 << rng.randrange(10 + 54 * (i % 2)) for _ in range(rng.randrange(9))}) for i in range(120 if cell < 64 else 250)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    got = {}
    for r in roots.collect():
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    want = {}
    for f, root in brute_roots(fps).items():
        want.setdefault(root, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_lookup_of_heavy_and_null_keys(spark):
    rows = spark.createDataFrame([(k,) for k in [None] * 5 + [1] * 3000 + list(range(2, 1500))], "k int")
    keyed = rows.groupBy("k").count().selectExpr("k", "count AS n", "coalesce(k, -1) * 10 AS v")
    got = spread_lookup(rows, keyed, "k", "n", rows.count())
    assert got.columns == ["k", "v"] and got.count() == rows.count()
    assert got.filter("v = coalesce(k, -1) * 10").count() == rows.count()

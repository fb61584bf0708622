"""Divergence audit against direct counting."""

import re
from collections import Counter

import pytest
from llm_rows import ODD

from refledger.llm import divergence

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(FOLD)))
            for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        count[None] = sum(count.values(), Counter())

        def p(s, t):
            return 1 + 10**9 * (count[s][t] + 1) // (sum(count[s][k] for k in kept) + len(kept))

        price = {s: {t: p(s, t) for t in kept} for s in count}
        for s in count.keys() - {None}:
            pairs = [(-sum((price[s][t] - price[o][t]) ** 2 // price[o][t] for t in kept), o) for o in count.keys() - {None, s}]
            terms = [(-((price[s][t] - price[None][t]) ** 2 // price[None][t]), t) for t in kept
                     if count[s][t] and price[s][t] > price[None][t]]
            for part, found in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))),
                                ("term", sorted(terms, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_odd_rows(make_docs):
    rows = [(i, t, "en" if i and i % 2 else None, ["b", None, "a", "Z"][(i or 0) % 4]) for i, t in ODD]
    rows += [(50, None, "xx", "a"), (51, "", "xx", "b"), (52, "one two", "xx", None), (53, "alone", "yy", "a")]
    got = found(divergence.audit(make_docs(rows)))
    assert got == brute(rows) and ("xx", "a", "pair", "b", 0, 2) in got


def test_no_rows(no_docs):
    assert found(divergence.audit(no_docs)) == []


@pytest.mark.parametrize("terms, size, tile", [(256, 32, 1024), (4, 2, 3)])
def test_blocks_sets_and_tiles(make_docs, monkeypatch, terms, size, tile):
    for name, value in (("TERMS", terms), ("SET", size), ("TILE", tile)):
        monkeypatch.setattr(divergence, name, value)
    rows = []
    for d in range(120):
        words = [f"w{chr(97 + (d * k * k + k) % 23)}" for k in range(1 + d % 17)] + ["Hot"] * (d % 40) + ["été"] * (d % 3)
        rows.append((d, " ".join(words), ["en", "fr"][d % 5 == 0], f"s{d % 7}"))
    assert found(divergence.audit(make_docs(rows), top=3)) == brute(rows, top=3)

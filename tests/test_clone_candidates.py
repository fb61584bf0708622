"""Candidates of near titles: the same as by comparing all pairs, with few rows between tasks."""

import difflib
import random

from pyspark.sql import functions as F

from refledger.operators import dedupe


def _titles():
    rng = random.Random(5)
    words = ["model", "river", "network", "theory", "of", "cells", "deep", "and", "graph", "soil", "light", "map"]
    out = []
    for i in range(60):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(3, 12)))
        chars = list(title)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice([[], ["x"], [chars[at], "y"]])
        out += [(i % 2, title), (i % 2, "".join(chars)), ((i + 1) % 2, title)]
    return sorted({(a, t) for a, t in out if len(t) >= 8})


def test_no_near_pair_is_lost_and_none_crosses_lists(spark):
    rows = _titles() + [(None, "a title of no list"), (None, "a title of no listx")]
    nodes = spark.createDataFrame(rows, "list_id bigint, title_key string").withColumn("name", F.col("title_key"))
    got = {(r.list_id, r.title_key_a, r.title_key_b) for r in dedupe._near_candidates(nodes).collect()}
    assert all(len(a) < len(b) or (len(a) == len(b) and a < b) for _, a, b in got)
    assert {lst for lst, _, _ in got} <= {0, 1}
    by_list = [[t for lst, t in rows if lst == k] for k in (0, 1)]
    for k, titles in enumerate(by_list):
        for i, a in enumerate(titles):
            for b in titles[i + 1:]:
                a2, b2 = (a, b) if (len(a), a) < (len(b), b) else (b, a)
                if difflib.SequenceMatcher(None, a2, b2).ratio() >= 0.92:
                    assert (k, a2, b2) in got
    assert got


def test_lengths_that_no_other_title_has_are_not_looked_up(spark, caplog):
    """Lists of titles too different in length make no pieces at all, and no broadcast is made of pieces."""
    nodes = spark.range(200).select((F.col("id") % 100).alias("list_id"), F.when(F.col("id") < 100, F.lit("short title one")).otherwise(
        F.lit("a title that is more than half as long again")).alias("title_key"))
    cand = dedupe._near_candidates(nodes)
    plan = cand._jdf.queryExecution().executedPlan().toString()
    join = [line for line in plan.splitlines() if "place" in line and "Join" in line]
    assert join and not any("Broadcast" in line for line in join)
    assert cand.count() == 0


def _near_pairs(nodes):
    return {(r.list_id, r.title_key_a, r.title_key_b) for r in dedupe._near_candidates(nodes).collect()
            if difflib.SequenceMatcher(None, r.title_key_a, r.title_key_b).ratio() >= 0.92}


def _edited_titles():
    """Titles of all lengths from 8 on, each beside copies with as many deletions, insertions and exchanges as 0.92 allows."""
    rng = random.Random(11)
    rows = set()
    for i in range(120):
        title = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8 + i % 90))
        rows.add((i % 2, title))
        for _ in range(3):
            chars = list(title)
            for _ in range(rng.randint(1, max(1, int(0.1 * len(title))))):
                at = rng.choice([0, len(chars) - 1, rng.randrange(len(chars))])
                chars[at:at + 1] = rng.choice([[], ["9"], [chars[at], "9"], ["9", chars[at]]])
            if len(chars) >= 8:
                rows.add((i % 2, "".join(chars)))
    return sorted(rows)


def test_small_lists_and_lookups_find_the_same_near_titles(spark, monkeypatch):
    """Lists up to ``SMALL_LIST`` meet pair by pair, larger ones by lookups; both find what a comparison of all pairs finds."""
    rows = _edited_titles()
    nodes = spark.createDataFrame(rows, "list_id bigint, title_key string")
    want = set()
    for k in (0, 1):
        titles = sorted((t for lst, t in rows if lst == k), key=lambda t: (len(t), t))
        for i, a in enumerate(titles):
            want |= {(k, a, b) for b in titles[i + 1:] if len(b) * 0.92 <= len(a) * 1.08 + 1
                     and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert len(want) > 100
    monkeypatch.setattr(dedupe, "SMALL_LIST", 0)
    assert _near_pairs(nodes) == want
    monkeypatch.setattr(dedupe, "SMALL_LIST", 10_000)
    assert _near_pairs(nodes) == want


def test_small_lists_make_no_lookups(spark, monkeypatch):
    """Lists as the queries have them, of two dozen titles: none of their titles is cut into pieces."""
    written = []
    monkeypatch.setattr(dedupe, "cut_lineage", lambda df: written.append(df) or df)
    rows = [(i // 24, f"a title that many lists nearly have, {i}") for i in range(240)]
    nodes = spark.createDataFrame(rows, "list_id bigint, title_key string")
    found = dedupe._near_candidates(nodes)
    assert written[1].count() == 0
    assert found.count() == 10 * 24 * 23 // 2

"""Text operators against brute force on odd rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from llm_rows import ODD
from pyspark.sql import functions as F

from refledger.llm import decontaminate, jaccard, langid, line_dedup, lm, mixing, quality
from refledger.llm.common import sifted, sifted_out


def words(t):
    return (t or "").encode().lower().split()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- mixing ----------------------------------------------------------------------------------------

def fill(sizes):
    """Targets by repeated sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        rest = sum(w[s] for s in order if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else left * w[s] / rest for s in order}
        more = {s for s in order if s not in capped and out[s] >= 3 * sizes[s]}
        if not more:
            return out
        capped |= more


def test_mixing(odd_docs):
    got = mixing.taken_words(mixing.mix(odd_docs)).collect()
    assert len(got) == len(ODD)
    sizes, taken = collections.Counter(), collections.Counter()
    source = lambda i: ["b", None, "a"][(i or 0) % 3]
    for i, t in ODD:
        sizes[source(i)] += len(words(t))
    want = fill(dict(sizes))
    for r in got:
        taken[source(r.doc_id)] += r.taken
        assert r.source_size == sizes[source(r.doc_id)] and math.isclose(r.target, want[source(r.doc_id)], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t in ODD)


def test_mixing_schedule_is_spread(make_docs):
    docs = make_docs([(i, "w " * 100, None, "ab"[i % 2]) for i in range(400)])
    mixed = mixing.mix(docs, weights=(3, 1), block=16)
    slots = sorted((r.slot, r.sid) for r in mixed.pieces.select("slot", "sid").distinct().collect() if r.slot is not None)
    assert len(slots) == len({s for s, _ in slots}) > 2000
    for lo in range(0, len(slots) - 400, 400):  # every stretch of the schedule is near the weights
        share = sum(sid == 0 for _, sid in slots[lo:lo + 400]) / 400
        assert abs(share - 0.75) < 0.03
    assert rows(mixing.taken_words(mixing.mix(docs)), "doc_id", "taken") == rows(
        mixing.taken_words(mixing.mix(docs.repartition(7))), "doc_id", "taken")


def test_mixed_documents(odd_docs):
    got = mixing.mixed_documents(odd_docs)
    assert got.columns == odd_docs.columns
    by_id = collections.defaultdict(int)
    for r in got.collect():
        by_id[r.doc_id] += len(words(r.text))
    want = collections.defaultdict(int)
    for r in mixing.taken_words(mixing.mix(odd_docs)).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in by_id.items() if v} == {k: v for k, v in want.items() if v}


def test_schedule_decides_what_is_taken(make_docs, monkeypatch):
    docs = make_docs([(i, " ".join(f"w{j}" for j in range(20 + i % 7)), None, "abcdefg"[min(i % 40, 6)]) for i in range(300)])
    mixed = mixing.mix(docs, block=16)
    pieces = mixed.pieces.collect()
    blocks = collections.defaultdict(set)
    for r in pieces:
        assert r.slot is not None and 0 <= r.lo < r.hi
        blocks[r.sid].add((r.block, r.slot))
    quota = {r.sid: r.quota for r in mixed.rows.collect()}
    for sid, found in blocks.items():  # each source has the slots of its blocks, taken in their order
        assert sorted(b for b, _ in found) == list(range(-(-quota[sid] // 16)))
        assert [s for _, s in sorted(found)] == sorted(s for _, s in found)
    # what is written is in the order of the slots
    first = {}
    for r in pieces:
        first[r.doc_id, r.epoch] = min(first.get((r.doc_id, r.epoch), r.slot), r.slot)
    left = collections.defaultdict(list)
    for (d, _), slot in sorted(first.items(), key=lambda x: x[0][1]):
        left[d].append(slot)
    order = [left[r.doc_id].pop(0) for r in mixing.mixed_documents(docs, block=16).collect()]
    assert len(order) == len(first) and order == sorted(order)
    # a schedule without some slots takes less, here too within a document
    full = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: (lambda o: (o[0].filter("block % 3 <> 1"), o[1]))(full(*a)))
    less = sum(r.hi - r.lo for r in pieces if r.block % 3 != 1)
    assert sum(r.taken for r in mixing.taken_words(mixing.mix(docs, block=16)).collect()) == less
    assert sum(len(words(r.text)) for r in mixing.mixed_documents(docs, block=16).collect()) == less


# --- near duplicates -------------------------------------------------------------------------------

def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(docs):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(((d, len(s), min(ids[find(i)]) if ids[find(i)] else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def test_jaccard_odd_rows(odd_docs):
    assert rows(jaccard.near_duplicates(odd_docs), "doc_id", "n_shingles", "component_id") == brute_components(ODD)


def test_jaccard_near_copies_of_one_text(make_docs, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        text = list(base[: 120 - int(rng.integers(0, 30))])
        for _ in range(int(rng.integers(0, 12))):
            text[int(rng.integers(0, len(text)))] = f"z{rng.integers(0, 40)}"
        docs.append((i, " ".join(text)))
    docs += [(200 + i, " ".join(["Common passage"] * 1 + base[:6] + [f"q{i}_{j}" for j in range(20)])) for i in range(40)]
    assert rows(jaccard.near_duplicates(make_docs(docs)), "doc_id", "n_shingles", "component_id") == brute_components(docs)
    monkeypatch.setattr(jaccard, "FREQUENT", 8)  # most postings take the way of frequent shingles
    assert rows(jaccard.near_duplicates(make_docs(docs)), "doc_id", "n_shingles", "component_id") == brute_components(docs)


def test_one_of_each(make_docs):
    docs = make_docs([(3, "a b c d e f g h"), (3, "a b c d e f g h"), (7, "A b c d e f g h"), (9, "x y"), (10, None), (11, "")])
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns and rows(got, "doc_id") == [(10,), (11,), (3,), (9,)]


# --- decontamination -------------------------------------------------------------------------------

def test_decontamination_odd_rows(spark, odd_docs):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "beta gamma delta epsilon zeta eta theta iota kappa LAMBDA"),
             (3, None), (4, ""), (5, "one"), (None, "same id"), (5, "few things"), (6, "word " * 12), (7, "!!!")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(odd_docs, bench)

    def parts(t):
        import re
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    want = []
    for d, t in ODD:
        w, hit, found = parts(t), set(), set()
        for i, x in items:
            v = parts(x)
            n = min(10, len(v))
            grams = {tuple(v[j:j + n]) for j in range(len(v) - n + 1)} if n else set()
            for j in range(len(w) - n + 1 if n else 0):
                if tuple(w[j:j + n]) in grams:
                    hit.update(range(j, j + n))
                    found.add("" if i is None else str(i))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((d, len(w), len(hit), len(found), sha, bool(hit)))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(got, *names) == sorted(want, key=repr)
    kept = decontaminate.decontaminated(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not w[-1] for w in want)
    assert decontaminate.contamination(odd_docs, bench.filter("false")).filter("contaminated OR n_hit > 0").count() == 0


def test_every_shared_span_is_found(spark, make_docs):
    rng = np.random.default_rng(1)
    word = lambda: f"v{rng.integers(0, 3000)}"
    item = [word() for _ in range(60)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")
    docs = []
    for i in range(51):  # one window of the item each, anywhere in a text
        before = [word() for _ in range(int(rng.integers(0, 40)))]
        docs.append((i, " ".join(before + item[i:i + 10] + [word() for _ in range(20)])))
    got = decontaminate.contamination(make_docs(docs), bench)
    assert got.filter("contaminated").count() == 51 and got.filter("n_hit = 10").count() >= 45


# --- lines -----------------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)):] == b[i + (len(b) >= len(a)):]


def brute_lines(docs):
    lines = [(d, no, x, words(x)) for d, t in docs for no, x in enumerate(t.split("\n")) if t]
    out = []
    for d, t in docs:
        if not t:
            out.append((d, t, 0, 0))
            continue
        kept, gone = [], 0
        for no, x in enumerate(t.split("\n")):
            w = words(x)
            drop = bool(w) and any((d2, no2) < (d, no) and v and (v == w or min(len(v), len(w)) >= 8 and one_edit(v, w))
                                   for d2, no2, _, v in lines)
            gone += drop
            if not drop:
                kept.append(x)
        out.append((d, "\n".join(kept), len(t.split("\n")), gone))
    return sorted(out, key=repr)


def test_lines(make_docs):
    rng = np.random.default_rng(2)
    base = [f"a{i}" for i in range(12)]
    docs = [(1, "Same line.\n\nother"), (2, "same LINE.\nother thing\n \n"), (3, ""), (4, "x y\nx z\nx y")]
    for i in range(5, 60):
        w = list(base)
        for _ in range(int(rng.integers(0, 3))):
            kind, at = rng.integers(0, 3), int(rng.integers(0, len(w)))
            if kind == 0:
                w[at] = f"b{rng.integers(0, 5)}"
            elif kind == 1:
                w.insert(at, f"b{rng.integers(0, 5)}")
            else:
                del w[at]
        docs.append((i, f"own line {i}\n" + " ".join(w) + "\ntail"))
    got = line_dedup.deduplicated(make_docs(docs))
    assert rows(got, "doc_id", "text", "n_lines", "n_dropped") == brute_lines(docs)


def test_one_of_each_shuffles_the_texts_once(make_docs, capsys):
    same = " ".join(f"w{k}" for k in range(20))
    docs = [(3, same), (1, same), (1, same), (2, "other words"), (None, "no id"), (None, "no id"), (None, "nor here"), (7, None)]
    got = jaccard.one_of_each(make_docs(docs))
    got.explain()
    shuffles = [x for x in capsys.readouterr().out.splitlines() if "Exchange hashpartitioning(" in x]
    assert sum("(__k#" in x for x in shuffles) == 1 and not any("_w0" in x for x in shuffles)
    assert rows(got, "doc_id", "text") == sorted([(1, same), (2, "other words"), (None, "no id"), (None, "nor here"), (7, None)], key=repr)


def test_only_texts_that_lose_lines_are_shuffled(make_docs, capsys):
    docs = [(i, f"own line {i}\n" + " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)]
    docs += [(-1, "own line 3\nmine"), (52, "mine"), (50, "last"), (51, "")]
    table = make_docs([(None if i == -1 else i, t) for i, t in docs])  # a null id comes first, as -1 does
    got = line_dedup.deduplicated(table)
    got.explain()
    plan = capsys.readouterr().out
    assert "Union" in plan and sum("Exchange" in x and "hashpartitioning(__key" in x for x in plan.splitlines()) <= 1
    assert rows(got.fillna({"doc_id": -1}), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(docs)
    wanted = table.filter("doc_id IS NULL OR doc_id < 5").select(F.struct("doc_id").alias("__w"))
    both = [{r.doc_id for r in f(table, F.struct("doc_id"), wanted, F.col("__w")).collect()} for f in (sifted, sifted_out)]
    assert both == [{None, *range(5)}, {50, 51, 52, *range(5, 40)}]


def test_lines_odd_rows(odd_docs):
    got = line_dedup.deduplicated(odd_docs)
    assert got.count() == len(ODD) and got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    by_id = collections.Counter((r.doc_id, r.n_dropped) for r in got.collect())
    assert by_id[(8, 1)] == 2 and by_id[(6, 1)] == 1 and by_id[(1, 0)] == 1 and by_id[(3, 0)] == 1


# --- language model --------------------------------------------------------------------------------

def brute_base(docs):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    c = collections.Counter(w for d, t in docs if not held(d) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    return sorted(((d, held(d), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n,
                    round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for d, t in docs), key=repr)


def scored(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


def test_lm_odd_rows(odd_docs):
    got = lm.score_documents(odd_docs)
    assert scored(got) == brute_base(ODD)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got.collect())


def test_lm_learns(make_docs):
    rng = np.random.default_rng(3)
    vocab = ["".join(rng.choice(list("abcde"), int(rng.integers(2, 7)))) for _ in range(200)]
    docs = [(i, " ".join(rng.choice(vocab, 150))) for i in range(300)]
    noise = [(1000, " ".join("".join(rng.choice(list("vwxyz"), 6)) for _ in range(150)))]
    got = {r.doc_id: r for r in lm.score_documents(make_docs(docs + noise)).collect()}
    per_token = [got[i].score / got[i].n_tokens for i in range(300) if got[i].held_out]
    assert len(per_token) > 20 and max(per_token) < 0
    assert got[1000].score / got[1000].n_tokens < min(per_token) - 1  # unlike what was learned
    again = {r.doc_id: r.score for r in lm.score_documents(make_docs(docs + noise).repartition(5)).collect()}
    assert all(math.isclose(again[i], got[i].score, rel_tol=1e-4) for i in again)


def test_lm_knows_the_order_of_words(make_docs):
    """All words are frequent and each follows from the one before, so shuffled texts must score far less."""
    rng = np.random.default_rng(5)
    follow = rng.permutation(60)
    docs = []
    for i in range(160):
        at, text = int(rng.integers(60)), []
        for _ in range(60):
            text.append(f"w{at:02d}{'abc'[at % 3]}")
            at = int(follow[at]) if rng.random() < 0.9 else int(rng.integers(60))
        docs.append((i, " ".join(text)))
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 7 == 2]
    ids = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    mixed = [(ids[k], " ".join(rng.permutation(docs[i][1].split()))) for k, i in enumerate(held)]
    got = {r.doc_id: r for r in lm.score_documents(make_docs(docs + mixed)).collect()}
    straight, shuffled = sum(got[i].score for i in held), sum(got[i].score for i, _ in mixed)
    assert straight > 0.75 * shuffled and straight > 0.8 * sum(got[i].base_score for i in held)


def test_spelling_is_a_distribution():
    """Probabilities of all bytes after any beginning add up to one."""
    data = np.frombuffer(b"ab abc abd ", np.uint8)
    bounds = np.array([[0, 3], [3, 7], [7, 11]])
    tables = [(np.zeros(1 << b, np.float32), np.zeros(1 << b, np.float32)) for b in lm.TABLE_BITS]
    _, bits, at = lm.slots(data, bounds, lm.Hasher(data))
    for k, s in enumerate(at):
        np.add.at(tables[k][1], s[bits == 1], 1)
        np.add.at(tables[k][0], s[bits == 0], 1)
    weights, maps = lm.train(data, bounds, tables)
    model = lm.Model([np.where(z + o > 0, lm.stretched(z, o), 0) for z, o in tables], [lm.levels(z + o) for z, o in tables], weights, maps)
    for head in (b"", b"ab"):
        every = np.frombuffer(b"".join(head + bytes([x]) for x in range(256)), np.uint8)
        size = len(head) + 1
        scores = lm.unit_scores(model, every, np.stack([np.arange(256) * size, (np.arange(256) + 1) * size], 1))
        alone = lm.unit_scores(model, np.frombuffer(head, np.uint8), np.array([[0, len(head)]]))[0] if head else 0.0
        assert math.isclose((10 ** (scores - alone)).sum(), 1, rel_tol=1e-3)


# --- language and quality --------------------------------------------------------------------------

def test_language(make_docs, odd_docs):
    rng = np.random.default_rng(4)
    sound = {"aa": ["ka", "lo", "mi"], "bb": ["ste", "urk", "pfo"], "cc": ["zé", "çu", "ñi"]}
    docs = [(i, " ".join("".join(rng.choice(sound[k], 3)) for _ in range(40)), k) for i in range(240) for k in [list(sound)[i % 3]]]
    net = langid.learn(make_docs(docs), steps=150)
    got = langid.identify(make_docs([(d, t) for d, t, _ in docs]), net).collect()
    held = [(r.lang_pred, list(sound)[r.doc_id % 3]) for r in got if r.held_out]
    assert len(held) > 40 and np.mean([a == b for a, b in held]) > 0.98
    odd = {}
    for r in langid.identify(odd_docs, net).collect():
        odd.setdefault(r.doc_id, []).append(r)
    for i in (1, 2, 3, 10):
        assert [(r.lang_pred, r.score) for r in odd[i]] == [("und", 0.0)]
    assert all(r.lang_pred in sound and 0 <= r.score <= 1 for i in (4, 5, 7, 11) for r in odd[i])
    assert all(r.lang_pred == "und" for r in langid.identify(odd_docs, None).collect())


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    emb, rec = rng.normal(size=(256, 9)), rng.normal(size=(3, 9))
    codes, mask = langid.padded([b"abc", b"de"])
    goal = rng.normal(size=(3, 2, 3))
    loss = lambda e, r: float((langid.direction(e, r, codes, mask)[0] * goal).sum())
    _, tape = langid.direction(emb, rec, codes, mask, True)
    d_emb, d_rec = langid.backward(emb, rec, codes, mask, tape, goal)
    for grad, which, at in ((d_rec, 1, (1, 2)), (d_rec, 1, (0, 7)), (d_emb, 0, (ord("b"), 4)), (d_emb, 0, (ord("d"), 8))):
        moved = [emb.copy(), rec.copy()]
        moved[which][at] += 1e-3
        up = loss(*moved)
        moved[which][at] -= 2e-3
        assert math.isclose((up - loss(*moved)) / 2e-3, grad[at], rel_tol=2e-2, abs_tol=2e-3)


@pytest.fixture(scope="module")
def scorer_data(spark, make_docs):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghijklmno"), int(rng.integers(2, 9)))) for _ in range(800)]
    docs, labels = [], []
    for i in range(600):
        w = list(rng.choice(vocab, 120))
        if i % 6 == 0:
            w = [x.upper() + "!!" for x in w]
        elif i % 6 == 1:
            w = [x + "###" for x in w]
        elif i % 6 == 2:
            w[10] = "idiot" if i % 12 == 2 else "vequnord" + str(i % 3)
        docs.append((i, " ".join(w)))
        if i % 2:
            labels.append((i, int(i % 6 > 1), 0))
        elif i % 4 == 0 or i % 12 == 8 or i % 24 == 2:
            labels.append((i, 1, int(i % 6 == 2)))
    return make_docs(docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_quality(scorer_data):
    docs, labels = scorer_data
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    bad = [i for i in got if i % 6 in (0, 1)]
    assert sum(not got[i].accepted for i in bad) >= 0.98 * len(bad)
    good = [i for i in got if i % 6 > 2]
    assert sum(got[i].accepted for i in good) >= 0.98 * len(good)
    toxic = [i for i in got if i % 12 == 2]
    assert sum(not got[i].accepted for i in toxic) >= 0.9 * len(toxic)


def test_quality_odd_rows(spark, scorer_data, odd_docs, no_docs):
    _, labels = scorer_data
    got = quality.classify(odd_docs, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert all(not r.accepted and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert quality.accepted(odd_docs, labels.filter("false")).columns == odd_docs.columns
    assert quality.classify(no_docs, labels).count() == 0


def test_accepted_keeps_columns_of_any_name(scorer_data):
    docs, labels = scorer_data
    named = docs.selectExpr("*", "'a' AS accepted", "'b' AS p_low", "'c' AS p_toxic", "'e' AS toxic", "1 AS h", "2 AS `odd name`")
    kept = quality.accepted(named, labels)
    assert kept.columns == named.columns
    assert {tuple(r)[-6:] for r in kept.collect()} == {("a", "b", "c", "e", 1, 2)}
    assert kept.count() == quality.classify(docs, labels).filter("accepted").count()


def test_em_finds_the_labellers():
    rng = np.random.default_rng(7)
    truth = rng.random(20000) < 0.2
    votes = np.stack([np.where(rng.random(20000) < 0.5, 0, np.where((rng.random(20000) < a) == truth, -1, 1)) for a in (0.95, 0.9, 0.7)], 1)
    keys, n = np.unique(quality.packed(votes), return_counts=True)
    table, prior = quality.estimate(quality.unpacked(keys, 3), n.astype(float), 0.3)
    accuracy = table[:, 1, 0] / (table[:, 1, 0] + table[:, 1, 2])
    assert abs(prior - 0.2) < 0.05 and np.allclose(accuracy, [0.95, 0.9, 0.7], atol=0.05)


def test_empty_tables(spark, no_docs):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    for df in (mixing.taken_words(mixing.mix(no_docs)), mixing.mixed_documents(no_docs), jaccard.near_duplicates(no_docs),
               jaccard.one_of_each(no_docs), decontaminate.contamination(no_docs, bench), line_dedup.deduplicated(no_docs),
               lm.score_documents(no_docs), langid.identify(no_docs, langid.learn(no_docs))):
        assert df.count() == 0

"""Operators without an SQL twin against plain Python on small inputs."""

import hashlib
import difflib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refledger.fixtures import view
from refledger.functions import text as tx
from refledger.functions.similarity import bag_bound, length_bound, seq_ratio
from refledger.operators import dedupe, fuzzy, profile
from refledger.operators.common import number_rows
from refledger.plans.queries import QUERIES


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def test_ratio_and_bounds_equal_difflib(spark):
    rng = random.Random(7)
    words = ["deep", "learning", "for", "protein", "folding", "氢键", "Ünïcode", "", "aaaa", "abcabc"]
    pairs = [(" ".join(rng.choices(words, k=rng.randint(0, 8))), " ".join(rng.choices(words, k=rng.randint(0, 8)))) for _ in range(300)]
    pairs.append(("x" * 300 + "abc", "x" * 250 + "abd"))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", seq_ratio("a", "b").alias("r"), length_bound(F.col("a"), F.col("b")).alias("l"),
                    bag_bound(F.col("a"), F.col("b")).alias("g")).collect()
    for r in got:
        m = difflib.SequenceMatcher(None, r.a, r.b)
        assert r.r == pytest.approx(m.ratio())
        assert r.l == pytest.approx(m.real_quick_ratio())
        assert r.g == pytest.approx(m.quick_ratio())
        assert r.r <= r.g + 1e-9 and r.g <= r.l + 1e-9


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcd", min_size=8, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abcd-")), max_size=4))
def test_segment_rule_keeps_every_near_pair(a, edits):
    """The shared-segment rule in Python: any pair at ratio 0.92 has an intact segment in its window."""
    chars = list(a)
    for at, ch in edits:
        at = min(at, len(chars))
        if ch == "-":
            del chars[at:at + 1]
        else:
            chars.insert(at, ch)
    b = "".join(chars)
    short, long = sorted((a, b), key=len)
    if len(short) < 8 or ratio(short, long) < 0.92:
        return
    n, gap = len(short), len(long) - len(short)
    d = int((n + int(n * 1.08 / 0.92)) * 0.08 + 1e-9)
    assert any(
        long[p + sh:p + sh + w] == short[p:p + w]
        for i in range(d + 1)
        for p, w in [(i * n // (d + 1), (i + 1) * n // (d + 1) - i * n // (d + 1))]
        for sh in range(max(-i, gap - (d - i), -p), min(i, gap + d - i, len(long) - w - p) + 1))


def brute_clones(rows):
    out = set()
    for (i, ta, da), (j, tb, db) in itertools.combinations(rows, 2):
        if min(len(ta), len(tb)) < 8 or abs(len(ta) - len(tb)) > max(len(ta), len(tb)) * 0.35 or not da or not db:
            continue
        r = ratio(ta, tb)
        if r >= 0.92 and da != db:
            out.add((i, j, "clone_doi"))
        elif da == db and r < 0.92:
            out.add((i, j, "clone_title"))
    return out


def variants(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abcdefgh", k=rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(1, n + 1):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(t))
            if rng.random() < 0.5:
                t[at] = rng.choice("abcdefgh")
            else:
                t.insert(at, rng.choice("abcdefgh"))
        rows.append((i, "".join(t), f"10.1000/{rng.randint(1, 60)}"))
    return rows


def test_clone_pairs_link_what_pairwise_comparison_links(make_refs):
    """Distinct titles with distinct DOIs: the links are exactly the pairs."""
    rows = [(i, t, f"10.1000/{i}") for i, t, _ in variants(3)]
    rows = list({t: (i, t, d) for i, t, d in reversed(rows)}.values())
    df = make_refs([{"ref_id": i, "title": t, "doi": d} for i, t, d in rows])
    got = {(r.a, r.b, r.kind) for r in dedupe.clone_pairs(df).collect()}
    assert got == brute_clones(sorted(rows))


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def test_clone_components_with_repeated_titles_and_dois(make_refs):
    rows = variants(11)
    # one row per (title, DOI): copies are the business of the duplicate marker
    rows = sorted({(t, d): (i, t, d) for i, t, d in reversed(rows)}.values())
    df = make_refs([{"ref_id": i, "title": t, "doi": d} for i, t, d in rows])
    got = dedupe.clone_pairs(df).collect()
    want = brute_clones(rows)
    for kind in ("clone_doi", "clone_title"):
        assert components((r.a, r.b) for r in got if r.kind == kind) == components((a, b) for a, b, k in want if k == kind)
    assert {(r.a, r.b) for r in got if r.kind == "clone_title"} == {(a, b) for a, b, k in want if k == "clone_title"}
    assert {(r.a, r.b) for r in got} <= {(a, b) for a, b, _ in want}


@pytest.mark.parametrize("n", [10, 65, 500])
def test_every_pair_of_titles_of_one_doi(make_refs, n):
    """No size of a group changes what is found."""
    df = make_refs([{"title": hashlib.md5(str(i).encode()).hexdigest(), "doi": "10.1000/one"} for i in range(n)])
    got = {(r.a, r.b) for r in dedupe.clone_pairs(df).filter("kind = 'clone_title'").collect()}
    assert got == {(a, b) for a in range(1, n + 1) for b in range(a + 1, n + 1)}


def brute_duplicates(rows):
    seen, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["list_id"], r["ref_id"])):
        keys = [(r["list_id"], k, r[k], r["title"]) for k in ("url", "doi", "pmid") if r[k]]
        hit = next((k for k in keys if k in seen), None)
        if hit:
            out[r["ref_id"]] = (seen[hit], hit[1])
        else:
            seen.update({k: r["ref_id"] for k in keys})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_duplicates(make_refs, seed):
    rng = random.Random(seed)
    rows = [{
        "list_id": rng.randint(1, 3), "ref_id": i, "title": rng.choice(["one title", "two titles"]),
        "url": rng.choice([None, "https://a.org/x", "https://a.org/y"]), "doi": rng.choice([None, "10.1/a", "10.1/b", "10.1/c"]),
        "pmid": rng.choice([None, "1", "2", "3"])} for i in range(1, 61)]
    got = {r.ref_id: (r.duplicate_of, r.duplicate_kind) for r in dedupe.mark_duplicates(make_refs(rows)).collect()}
    assert got == brute_duplicates(rows)


@pytest.mark.parametrize("width", [4, 4096])
def test_serial_clusters_across_slices(make_refs, width):
    rng = random.Random(5)
    tails = sorted(rng.sample(range(1000, 1400), 150)) + [1100, 1100]
    df = make_refs([{"title": "t", "doi": f"10.5555/p{t}"} for t in tails])
    (got,) = profile.serial_clusters(df, width=width).collect()
    runs, run = [], [sorted(tails)[0]]
    for a, b in itertools.pairwise(sorted(tails)):
        if b - a <= 2:
            run.append(b)
        else:
            runs.append(run)
            run = [b]
    best = max([*runs, run], key=len)
    # the shortest matched prefix leaves the longest digit tail
    assert (got.run_length, got.first_tail, got.last_tail) == (len(best), str(best[0]), str(best[-1]))


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_failure_runs_across_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice(["a", "b", None]) if i < 60 else "h", i // 3, None if rng.random() < (0.02 if i > 250 else 0.4) else "timeout") for i in range(400)]
    df = spark.createDataFrame(rows, "probe_id bigint, host string, m bigint, error_kind string").withColumn(
        "ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(m * 20 as int))"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((str(r.host), r.first_ts, r.run_length) for r in profile.failure_runs(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    times = {r.probe_id: r.ts for r in df.collect()}
    want = []
    for host in ("a", "b", None, "h"):
        for bad, g in itertools.groupby([r for r in rows if r[1] == host], key=lambda r: r[3] is not None):
            g = list(g)
            want += [(str(host), times[g[0][0]], len(g))] if bad else []
    assert got == sorted(want)


def test_a_hot_host_is_dealt_evenly(spark):
    """One host with nine tenths of the probes of one day: the ranges hold about the same number of rows."""
    rows = spark.range(40_000).selectExpr(
        "id AS probe_id", "CASE WHEN id % 10 > 0 THEN 'hot' ELSE concat('h', id % 200) END AS host",
        "timestamp '2024-01-01' + make_dt_interval(0, 0, 0, cast(id % 86400 as int)) AS ts", "CASE WHEN id % 7 > 0 THEN 'timeout' END AS error_kind")
    sizes = [r["count"] for r in rows.repartitionByRange(16, "host", "ts", "probe_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]
    assert profile.failure_runs(rows).agg(F.sum("run_length")).first()[0] == rows.filter("error_kind IS NOT NULL").count()


def test_number_rows_equals_row_number(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, k string, rank int")
    got = {r.id: r.n for r in number_rows(df, ["k"], "id", "n", rank="rank", width=16).collect()}
    for key in "ab":
        ordered = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        assert [got[r[0]] for r in ordered] == list(range(1, len(ordered) + 1))


def test_title_search_finds_the_best_record(spark, sf):
    """Sequence model on the small tables, against scoring every pair that shares the two words."""
    refs = view(spark, sf, "fx_refs").withColumn("clean_title", tx.clean_title(F.col("title")))
    pubmed = view(spark, sf, "fx_pubmed")
    got = {r.ref_id: r for r in fuzzy.reverse_title_lookup(refs, pubmed).collect()}
    q = refs.select("ref_id", "clean_title", "year", tx.title_key(F.col("clean_title")).alias("k"),
                    tx.token_set(F.col("clean_title")).alias("t"), fuzzy.search_words(F.col("clean_title")).alias("w")).collect()
    p = pubmed.filter("lookup_status = 'hit'").select(
        "pmid", "year", tx.title_key(F.col("title")).alias("k"), tx.token_set(F.col("title")).alias("t"),
        fuzzy.search_words(F.col("title")).alias("w")).collect()
    checked = 0
    for a in q:
        if len(a.clean_title.strip()) < 20 or len(a.w) < 2:
            assert a.ref_id not in got
            continue
        top = sorted(a.w, key=lambda w: (-len(w), a.w.index(w)))[:2]
        best = 0.0
        for b in p:
            if abs(a.year - b.year) <= 1 and (set(top) <= set(b.w) or a.k == b.k):
                jac = len(set(a.t) & set(b.t)) / len(set(a.t) | set(b.t))
                best = max(best, ratio(a.k, b.k), jac)
        if best >= 0.5:
            assert got[a.ref_id].reverse_sim == pytest.approx(best)
            checked += 1
        else:
            assert a.ref_id not in got
    assert checked


def test_verify_sequence_never_condemns_by_search(spark, sf):
    """Laws: search misses are unverified, failed lookups never make invalid, signals leave verdicts alone."""
    rows = QUERIES["v1_verify_sequence"](spark, sf).collect()
    assert {r.rule for r in rows if r.verdict == "unverified"} <= {10}
    assert all(r.rule in (1, 2, 6, 11, 12, 13, 15, 16) for r in rows if r.verdict == "invalid")


# --- chains, clone counts, hot word pairs ----------------------------------------------------------

def test_chain_of_duplicates_takes_few_rounds(make_refs, monkeypatch):
    """Each row shares its url with the one before or its DOI with the one after: only a walk of the whole chain decides."""
    rows = [{"list_id": 1, "ref_id": i, "title": "one title", "url": f"https://a.org/{i // 2}", "doi": f"10.1/{(i + 1) // 2}"}
            for i in range(1, 1001)]
    cuts = []
    monkeypatch.setattr(dedupe, "cut_lineage", lambda df, cut=dedupe.cut_lineage: cuts.append(1) or cut(df))
    got = {r.ref_id: (r.duplicate_of, r.duplicate_kind) for r in dedupe.mark_duplicates(make_refs(rows)).collect()}
    assert got == brute_duplicates([{"pmid": None, **r} for r in rows])
    assert len(cuts) < 15


@pytest.mark.parametrize("seed", range(3))
def test_greedy_duplicates_with_long_dependencies(make_refs, seed):
    rng = random.Random(seed)
    rows = [{"list_id": 1, "ref_id": i, "title": "one title", "url": f"https://a.org/{rng.randrange(90)}" if rng.random() < 0.8 else None,
             "doi": f"10.1/{rng.randrange(90)}" if rng.random() < 0.8 else None, "pmid": str(rng.randrange(200))} for i in range(1, 201)]
    got = {r.ref_id: (r.duplicate_of, r.duplicate_kind) for r in dedupe.mark_duplicates(make_refs(rows)).collect()}
    assert got == brute_duplicates(rows)


def brute_partners(rows):
    """Titles are compared in the order of their first rows; the ratio depends on the order a little."""
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)

    def alike(t, u):
        return t == u or ratio(*sorted((t, u), key=first.get)) >= 0.92

    out = {}
    for i, t, d in rows:
        doi = sum(1 for j, u, e in rows if j != i and e != d and alike(t, u))
        title = sum(1 for j, u, e in rows if e == d and abs(len(t) - len(u)) <= max(len(t), len(u)) * 0.35 and not alike(t, u))
        if doi or title:
            out[i] = (doi, title)
    return out


def partners(make_refs, rows):
    groups = dedupe.clone_groups(make_refs([{"ref_id": i, "title": t, "doi": d} for i, t, d in rows]))
    return {r.ref_id: (r.clone_doi_partners, r.clone_title_partners) for r in dedupe.clone_annotations(groups).collect()}


@pytest.mark.parametrize("n", [2, 10, 65, 500])
def test_clone_partners_of_a_group(make_refs, n):
    """A group of n equal titles with n DOIs: every row has n - 1 partners, and no pair of rows is made."""
    rows = [(i, "one title of a whole group", f"10.1000/{i}") for i in range(1, n + 1)]
    assert partners(make_refs, rows) == {i: (n - 1, 0) for i in range(1, n + 1)}
    rows = [(i, hashlib.md5(str(i).encode()).hexdigest(), "10.1000/one") for i in range(1, n + 1)]
    assert partners(make_refs, rows) == {i: (0, n - 1) for i in range(1, n + 1)}


@pytest.mark.parametrize("seed", [3, 11])
def test_clone_partners_of_variants(make_refs, seed):
    rows = variants(seed)
    rows += [(1000 + i, t, d) for i, (_, t, d) in enumerate(rows[:20])]  # copies count as rows
    assert partners(make_refs, rows) == brute_partners(rows)


def test_claims_stand_in_for_missing_titles(make_refs):
    df = make_refs([{"title": None, "doi": "10.1/a"}, {"title": " ", "doi": "10.1/a"}, {"title": None, "doi": "10.1/b"}])
    df = df.withColumn("claim", F.lit("the claim of a row without title"))
    assert {(r.ref_id, r.duplicate_of) for r in dedupe.mark_duplicates(df).collect()} == {(2, 1)}
    assert {r.ref_id: r.clone_doi_partners for r in dedupe.clone_annotations(dedupe.clone_groups(df)).collect()} == {1: 1, 2: 1, 3: 2}
    assert dedupe.mark_duplicates(df.drop("claim")).count() == 0


def test_title_search_on_one_word_pair(spark):
    """50,000 titles with one pair of longest words: a claim meets those of its years, and pairs nobody asks for none."""
    records = spark.range(50_000).select(
        F.lit("pubmed").alias("source"), F.lit(None).cast("bigint").alias("r_ord"), F.col("id").cast("string").alias("r_id"),
        F.concat(F.lit("hypercalcaemia thrombocytopenia case "), F.col("id").cast("string")).alias("r_title"),
        (1950 + F.col("id") % 100).cast("int").alias("r_year"), F.lit(None).cast("string").alias("r_doi"))
    claims = spark.range(40).select(
        F.col("id").alias("q_id"), F.concat(F.lit("hypercalcaemia thrombocytopenia case "), F.col("id").cast("string"), F.lit(" seen")).alias("q_title"),
        (1950 + F.col("id") % 100).cast("int").alias("q_year"))
    q = claims.select(F.lit("pubmed").alias("source"), "q_id", "q_year", F.lit("hypercalcaemia thrombocytopenia").alias("pair"))
    assert fuzzy.word_hits(q, records, F.lit(True)).count() == 40 * 3 * 500 - 500  # the first year has no year before it
    assert fuzzy.word_hits(q.withColumn("pair", F.lit("case seen")), records, F.lit(True)).count() == 0
    found = {r.q_id: r.r_id for r in fuzzy.title_search(claims, records, [fuzzy.PUBMED]).collect()}
    assert found == {i: str(i) for i in range(40)}


def test_title_search_years(spark):
    rows = [("a", 2000), ("b", 2001), ("c", 2003), ("d", None)]
    records = spark.createDataFrame([("pubmed", None, i, "hypercalcaemia thrombocytopenia " + i * 3, y, None) for i, y in rows],
                                    "source string, r_ord bigint, r_id string, r_title string, r_year int, r_doi string")
    for year, want in ((2002, "bcd"), (2000, "abd"), (None, "abcd"), (0, "d")):
        q = spark.createDataFrame([("pubmed", -1 if year is None else year, "hypercalcaemia thrombocytopenia")], "source string, q_year int, pair string")
        assert {r.r_id for r in fuzzy.word_hits(q, records, F.lit(True)).collect()} == set(want)
        assert {r.r_id for r in fuzzy.word_hits(q, records, F.lit(False)).collect()} == set("abcd")

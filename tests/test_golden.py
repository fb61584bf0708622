"""Small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import citations as ct
from refledger.functions import identifiers as ids
from refledger.functions import people_journals as pj
from refledger.functions import text as tx
from refledger.operators import dedupe, document, evaluate, match, normalise, profile, score
from refledger.plans.verify import Registries, verify, with_notes

DEMO = [
    dict(title="Equipping agents for the real world", url="https://www.anthropic.com/engineering/x", source="Eng", year=2025),
    dict(title="A curated list of skills", url="https://github.com/a/b", source="GitHub", year=2026),
    dict(title="Citations are polluting the literature", url="https://www.nature.com/articles/x", source="Nature", year=2026),
    dict(title="Registry and trending tracker", url="https://skills.example", source="skills", year=2026),
    dict(title="Best skills to try", url="https://www.firecrawl.dev/blog/x", source="Blog", year=2026),
    dict(title="A longitudinal study of integrity", doi="10.1038/s41586-026-99999-x", source="Nature", year=2026),
    dict(title="Adoption survey", url="https://www.anthropic.com/engineering/none", source="Eng", year=2026),
    dict(title="Meta-analysis of grounding", source="Journal of AI Verification", year=2026),
]


def one(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("ref_id").collect()]


def results(spark, rows, extra=""):
    return spark.createDataFrame(rows, "list_id bigint, ref_id bigint, verdict string" + extra)


def test_demo_list_offline(make_refs):
    df = normalise.structural_verdict(make_refs(DEMO))
    assert [v for (v,) in one(df, "verdict")] == ["partial"] * 7 + ["invalid"]
    (card,) = score.scorecard(df).collect()
    assert (card.score, card.grade, card.total) == (25, "D", 8)


def test_scorecard_extremes(spark):
    rows = [(1, i, "verified") for i in range(9)] + [(2, i, "invalid") for i in range(5)]
    got = {r.list_id: (r.score, r.grade) for r in score.scorecard(results(spark, rows)).collect()}
    assert got == {1: (100, "A"), 2: (0, "D")}
    # 4 verified, 4 partial: 56/80 = 70; one more half case rounds to even
    half = [(1, i, "verified") for i in range(1)] + [(1, i, "partial") for i in range(10, 13)] + [(1, 20 + i, "unreachable") for i in range(4)]
    assert score.scorecard(results(spark, half)).collect()[0].score == 28  # 27.5
    assert score.scorecard(results(spark, [])).collect() == []


def test_duplicates_by_three_keys(make_refs):
    rows = [
        dict(title="Alpha Paper", url="https://x.com/", doi="10.1000/a", pmid="36443570"),
        dict(title="alpha  paper!", url="https://x.com"),
        dict(title="Alpha Paper", url="https://y.com", doi="10.1000/A"),
        dict(title="Alpha Paper", url="https://z.com", pmid="36443570"),
        dict(title="Beta Paper", url="https://x.com"),
    ]
    got = one(dedupe.mark_duplicates(make_refs(rows)), "ref_id", "duplicate_of", "duplicate_kind")
    assert got == [(2, 1, "url"), (3, 1, "doi"), (4, 1, "pmid")]


def test_missing_fields(make_refs):
    df = make_refs([
        dict(title="t", source="s", year=2024, doi="10.1000/abc"), dict(title="t", source="s", year=2024, pmid="36443570"),
        dict(title="t", source="s", year=2024), dict(url="https://a.org")])
    got = [m for (m,) in one(df.withColumn("m", normalise.missing_fields(df)), "m")]
    assert got == [[], [], ["url"], ["title", "source", "year"]]


CLONES = [
    ([("Attention Is All You Need", "10.1234/real"), ("Attention  Is All You Need!", "10.9999/fake")], ["clone_doi"]),
    ([("深度学习在医学影像中的应用研究", "10.2222/same"), ("深度学习在医学影像中的进展研究", "10.2222/same")], ["clone_title"]),
    ([("Quantum Computing Supremacy", "10.3333/q1"), ("Deep Learning for Protein Folding", "10.3333/q2"), ("胃肠道间质瘤的靶向治疗进展", "10.4444/z1")], []),
    ([("Same Paper Title Here", "10.5555/dup"), ("Same Paper Title Here", "10.5555/dup")], []),
    ([("Short one", "10.1/a"), ("Short two", "10.1/b")], []),
]


@pytest.mark.parametrize("rows,kinds", CLONES)
def test_clone_pairs(make_refs, rows, kinds):
    got = dedupe.clone_pairs(make_refs([dict(title=t, doi=d) for t, d in rows])).collect()
    assert [r.kind for r in got] == kinds


def test_profile_flags(make_refs, spark):
    def flags(rows):
        (r,) = profile.profile_bibliography(make_refs(rows), 2026).collect()
        return r.flags

    serial = [dict(title="p", doi=f"10.9999/batch{n}") for n in (2024001, 2024002, 2024004)] + [
        dict(title="r", doi="10.1111/j.1234-5678.2010.01234.x")]
    assert "serial_cluster" in flags(serial)
    years = [dict(title="p", doi=f"10.2/x{i}", year=2031 if i == 1 else 2024) for i in range(1, 10)]
    assert set(flags(years)) >= {"future_year", "year_concentration"}
    bare = [dict(title="p", source="Journal X" if i <= 6 else f"J{i}") for i in range(1, 11)]
    assert set(flags(bare)) == {"source_concentration", "bare_refs"}
    mixed = [dict(title="p", doi=f"10.4{i % 9}/d{i:04d}7", year=2026 - i % 7, source=f"Journal {i % 5}") for i in range(1, 10)]
    assert flags(mixed) == []
    assert flags([dict(title="p", doi="10.1/x")]) == []


def test_completeness(spark):
    schema = ("list_id bigint, ref_id bigint, verdict string, csl_title string, csl_authors array<string>, csl_container string,"
              " csl_year int, csl_volume string, csl_issue string, csl_page string")
    df = spark.createDataFrame([
        (1, 1, "verified", "T", ["A B"], "Nature", 2020, "500", "1", "54-58"), (1, 2, "verified", "T", ["X Y"], "", None, None, None, None),
        (1, 3, "verified", None, None, None, None, None, None, None), (1, 4, "partial", "T", ["A"], "C", 2020, "1", "1", "1")], schema)
    assert [c for (c,) in one(normalise.export_completeness(df), "completeness")] == [100, 30, None, None]


def test_preprint_upgrades(spark):
    res = spark.createDataFrame([(1, 1, "verified", "", "2401.00001"), (1, 2, "verified", "10.1/has", "2401.00002"),
                                 (1, 3, "partial", "", "2401.00003")], "list_id bigint, ref_id bigint, verdict string, doi string, arxiv_id string")
    s2 = spark.createDataFrame([(i, "t", 2025, f"10.5555/j{i}", f"2401.0000{i}", "Nature") for i in (1, 2, 3)],
                               "paper_id bigint, title string, year int, doi string, arxiv_key string, venue string")
    (hit,) = match.preprint_upgrades(res, s2).collect()
    assert (hit.ref_id, hit.published_doi, hit.venue, hit.published_year) == (1, "10.5555/j1", "Nature", 2025)


def test_journal_abbreviations(spark):
    df = spark.createDataFrame([("中华儿科杂志",), ("《中华儿科杂志》",), ("Pediatrics",), ("",)], "s string")
    got = [r.ta for r in df.select(pj.journal_ta(F.col("s")).alias("ta")).collect()]
    assert got == ["Zhonghua Er Ke Za Zhi", "Zhonghua Er Ke Za Zhi", "Pediatrics", ""]


def test_journal_comparison(spark):
    rows = [("N Engl J Med", "New England Journal of Medicine", True, True), ("Nature", "Science", False, False),
            ("JAMA", "Journal of the American Medical Association", True, True), ("中华儿科杂志", "Pediatrics", True, True),
            ("", "Nature", True, True), ("Nature Medicine", "Nature", True, True)]
    df = spark.createDataFrame(rows, "a string, b string, lenient boolean, strict boolean")
    for r in df.select("*", pj.journal_same(F.col("a"), F.col("b")).alias("x"), pj.journal_consistent(F.col("a"), F.col("b")).alias("y")).collect():
        assert (r.x, r.y) == (r.lenient, r.strict), r


def test_authors(spark):
    rows = [("Smith J, Zhang W", ["smith"], True), ("Smith J", ["jones", "lee"], False), ("王五", ["Wang"], True), ("", ["a"], True),
            ("L", ["Lincoln"], False), ("Smi", ["Smith"], True)]
    df = spark.createDataFrame(rows, "a string, r array<string>, ok boolean")
    for r in df.select("*", pj.author_consistent(pj.surnames(F.col("a")), F.col("r")).alias("got")).collect():
        assert r.got == r.ok, r


SCALARS = [
    (lambda c: tx.title_key(c), "Ｆｕｌｌ　Width: Test-Case!", "fullwidthtestcase"),
    (lambda c: tx.clean_title(c), "[12] A title about things. 2020;5:1", "A title about things"),
    (lambda c: tx.clean_title(c), "3. Title here doi: 10.1/x", "Title here"),
    (lambda c: ids.normalise_url(c), "HTTPS://Ex.org/Path/?a=1#f", "https://ex.org/Path"),
    (lambda c: tx.script_family(c), "深度学习 model", "latin"),
    (lambda c: tx.script_family(c), "Глубокое обучение", "cyrillic"),
    (lambda c: tx.script_family(c), "深い学習", "kana"),
    (lambda c: tx.script_family(c), "123 !", "none"),
    (lambda c: tx.script_family(c), "العربية", "latin"),
    (lambda c: ids.arxiv_id(c, F.lit(None).cast("string")), "arXiv: 2401.12345v2", "2401.12345v2"),
    (lambda c: ids.arxiv_id(c, F.lit(None).cast("string")), "2413.12345", None),
    (lambda c: ids.arxiv_id(F.lit(None).cast("string"), c), "https://arxiv.org/pdf/hep-th/9901001v3", "hep-th/9901001v3"),
    (lambda c: ids.source_tier(c), "https://arxiv.org/abs/1", "official"),
    (lambda c: ids.source_tier(c), "https://sub.x.com/a", "social"),
    (lambda c: ids.source_tier(c), "nohost", "unknown"),
    (lambda c: ids.source_tier(c, True), "https://www.bmj.com/a", "journal"),
    (lambda c: ids.retraction_class(c), "Expression of Concern", "expression_of_concern"),
    (lambda c: ids.doi_normal_form(c), "https://doi.org/10.1/A", "10.1/a"),
    (lambda c: tx.csv_safe(c), "=1+1", "'=1+1"),
    (lambda c: tx.bib_safe(c), "a{b}\nc", "ab c"),
    (lambda c: tx.year_of(c).cast("string"), "2019 Jan-Feb", "2019"),
    (lambda c: tx.year_of(c).cast("string"), "no year", None),
    (lambda c: ids.non_public_host(c).cast("string"), "http://192.168.1.1/x", "true"),
    (lambda c: ids.non_public_host(c).cast("string"), "https://a.internal/x", "true"),
    (lambda c: ids.non_public_host(c).cast("string"), "https://doi.org/x", "false"),
]


@pytest.mark.parametrize("case", range(len(SCALARS)))
def test_scalars(spark, case):
    fn, given, want = SCALARS[case]
    (row,) = spark.createDataFrame([(given,)], "c string").select(fn(F.col("c")).alias("got")).collect()
    assert row.got == want


CONTRAST = [("However, the method fails to generalize.", True), ("In contrast, estimates are inconsistent.", True), ("we adopt it", False),
            ("not unlike previous work", False), ("unlikely to generalize", False), ("indisputable evidence", False), ("irrefutable proof", False),
            ("a questionnaire was sent", False), ("不但高效而且稳定", False), ("极具挑战性", False), ("然而该结论并不一致", True), ("failed to generalize", True)]


@pytest.mark.parametrize("text,hit", CONTRAST)
def test_contrast_pattern(spark, text, hit):
    (r,) = spark.createDataFrame([(text,)], "c string").select(F.col("c").rlike(fv.CONTRAST).alias("h")).collect()
    assert r.h is hit


def test_divergence_threshold(spark):
    rows = [("a", 1, "However, x."), ("a", 2, "In contrast, y."), ("a", 3, "we adopt"), ("b", 1, "However, x."), ("b", 2, "use"), ("b", 3, "use"),
            ("c", 1, "plain")]
    df = spark.createDataFrame(rows, "cited_doi string, edge_pos bigint, context string")
    assert {r.cited_doi: r.divergent for r in document.context_divergence(df).collect()} == {"a": True, "b": False, "c": False}


DOC = """# Report

## Body

Management follows the guideline[1]。The use of steroids is disputed[2]。
Long-term data show a good outcome[1]。

#### 参考文献

[1] A. First title of the list (2024)[J]. Journal, 2024.
[2] B. Second[J]. Journal, 2014.
[3] C. Third[J]. Journal, 2020.
"""


def _listed(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "First guideline of the list", "10.1/a", 2024, ["Smith J"]), (1, 2, 2, "Second bronchiolitis paper", "10.1/b", 2014, ["Lee K"]),
         (1, 3, 3, "Third title", None, 2020, [])],
        "list_id bigint, ref_id bigint, position int, title string, doi string, year int, authors array<string>")


@pytest.mark.parametrize("old,new,cites,uncited,unbound,coverage", [
    ("", "", 3, [3], 0, 0.67),
    ("outcome[1]", "outcome[1-3]", 3, [], 0, 1.0),
    ("outcome[1]", "outcome[1], others too[9]", 4, [3], 1, 0.67),
    ("outcome[1]", "outcome[3]", 3, [], 0, 1.0),
    ("outcome[1]", "outcome (Lee, 2014) and Smith et al. (2024), https://doi.org/10.1/A ", 5, [3], 0, 0.67),
])
def test_document_audit(spark, old, new, cites, uncited, unbound, coverage):
    docs = spark.createDataFrame([(7, 1, DOC.replace(old, new) if old else DOC)], "doc_id bigint, list_id bigint, text string")
    listed = _listed(spark)
    (a,) = document.document_audit(docs, listed).collect()
    bound = document.bind_citations(document.extract_mentions(docs), listed)
    assert sorted(r.ref_id for r in document.uncited_refs(listed, bound).collect()) == uncited
    assert (a.n_citations, a.n_unbound, a.n_listed, a.n_uncited, a.coverage) == (cites, unbound, 3, len(uncited), coverage)


def test_author_year_by_title_substring(spark):
    docs = spark.createDataFrame([(1, 1, "As shown (Bronch, 1999). Nothing (Absent, 2020).")], "doc_id bigint, list_id bigint, text string")
    m = document.extract_mentions(docs)
    got = {r.marker: r.ref_id for r in document.bind_citations(m, _listed(spark)).collect()}
    assert got == {"(Bronch, 1999)": 2, "(Absent, 2020)": None}


def test_retraction_index(spark):
    rows = [("10.1/A", "Correction", "2020-01-01", "minor", 1), ("10.1/A", "Retraction", "2021-06-01", "data", 2),
            ("10.1/B", "Expression of Concern", "2022-03-03", "concern", 3), ("", "Retraction", "2020", "no doi", 4), ("10.1/c", "", "2020", "r" * 300, 5)]
    df = spark.createDataFrame(rows, "doi string, nature string, date string, reason string, line_no bigint")
    got = {r.doi: (r.nature, r.date, len(r.reason)) for r in match.build_retraction_index(df).collect()}
    assert got == {"10.1/a": ("Retraction", "2021-06-01", 4), "10.1/b": ("Expression of Concern", "2022-03-03", 7), "10.1/c": ("Retraction", "2020", 300)}


def test_eval_gate(spark):
    rows = [(i, "planted", "invalid") for i in range(15)] + [(20 + i, "clean", "partial") for i in range(21)]
    df = spark.createDataFrame(rows, "ref_id bigint, expected string, verdict string")
    (m,) = evaluate.eval_gate(evaluate.holdout_metrics(df)).collect()
    assert (m.capture_rate, m.strict_capture, m.false_kill_rate, m.violations, m.passed) == (1.0, 1.0, 0.0, [], True)
    bad = df.withColumn("verdict", F.when(F.col("ref_id") == 20, "invalid").when(F.col("ref_id") == 0, "verified").otherwise(F.col("verdict")))
    (m,) = evaluate.eval_gate(evaluate.holdout_metrics(bad)).collect()
    assert m.violations == ["capture_rate", "false_kill_rate"] and not m.passed


def test_semantic_audit_and_cap(spark):
    schema = ("list_id bigint, ref_id bigint, verdict string, needs_human boolean,"
              " semantic struct<claim:string,support:string,quote:string,note:string>")
    rows = [(1, 1, "verified", False, ("c", "contradicted", "q", "")), (1, 2, "invalid", False, ("c", "not_in_source", "", "")),
            (1, 3, "verified", False, ("c", "Bogus", "", "n")), (1, 4, "verified", False, None)]
    df = normalise.semantic_cap(normalise.semantic_audit(spark.createDataFrame(rows, schema)))
    assert one(df, "verdict", "needs_human") == [("partial", True), ("invalid", False), ("verified", False), ("verified", False)]
    assert df.filter("ref_id = 3").first().semantic_audit.support == "unclear"


def test_policy_spec():
    assert normalise.parse_source_policy("journal_only,allow-domain=a.org|b.org") == {"journal_only": True, "allow": ["a.org", "b.org"], "deny": []}
    assert normalise.parse_source_policy("deny-domain=") is None
    assert normalise.parse_source_policy("nonsense") is None
    assert normalise.parse_source_policy("") is None


# --- the verdict --------------------------------------------------------------------------------------------

W = "doi string, title string, original_title string, container string, year int, volume string, issue string, page string, authors array<struct<family:string,given:string,name:string>>, landing_url string, lookup_status string"


@pytest.fixture(scope="module")
def verdicts(spark, make_refs):
    works = spark.createDataFrame([
        ("10.1000/good", "A perfectly ordinary title", None, "Nature", 2020, "1", "2", "3-4", [("Smith", "John", None)], None, "hit"),
        ("10.1000/other", "Completely different work on bees", None, "Nature", 2020, None, None, None, [], None, "hit"),
        ("10.1000/gone", None, None, None, None, None, None, None, None, None, "not_found"),
        ("10.1000/net", None, None, None, None, None, None, None, None, None, "transport_failed"),
        ("10.1000/cjk", "Deep learning in medical imaging", "深度学习在医学影像中的应用研究", "Radiology", 2020, None, None, None, [], None, "hit"),
        ("10.1000/cjk2", "Deep learning in medical imaging", None, "Radiology", 2020, None, None, None, [], None, "hit"),
        ("10.1000/ret", "A retracted paper about rats", None, "Nature", 2020, None, None, None, [], None, "hit")], W)
    pubmed = spark.createDataFrame([
        ("36443570", "A stitched record of something", "Nature", 2020, "5", "1", "10", "10.1000/else", "hit"),
        ("11111111", None, None, None, None, None, None, None, "not_found"),
        ("22222222", "The effect of honey on coughing in small children", "Honey J", 2019, "7", "2", "9", None, "hit")],
        "pmid string, title string, ta string, year int, volume string, issue string, page string, doi string, lookup_status string")
    arxiv = spark.createDataFrame([("2401.00001", "Self-Taught Optimizer (STOP): Recursively Self-Improving Code Generation", 2024, 3, "hit"),
                                   ("2401.00002", None, None, None, "not_found")],
                                  "arxiv_key string, title string, year int, latest_version int, lookup_status string")
    retractions = spark.createDataFrame([("10.1000/ret", "Retraction", None, None)], "doi string, nature string, date string, reason string")
    base = dict(source="Nature", year=2020)
    rows = [
        dict(base, title="A perfectly ordinary title", doi="10.1000/good", authors="Smith J"),          # 1 verified
        dict(base, title="A perfectly ordinary title", doi="10.1000/other"),                              # 2 invalid: another paper
        dict(base, title="Whatever it is", doi="10.1000/gone"),                                           # 3 invalid: absent
        dict(base, title="Whatever it is", doi="10.1000/net"),                                            # 4 lookup failed: not invalid
        dict(base, title="深度学习在医学影像中的应用研究", doi="10.1000/cjk", source="Radiology"),          # 5 bridged
        dict(base, title="深度学习在医学影像中的应用研究", doi="10.1000/cjk2", source="Radiology"),         # 6 cross language
        dict(base, title="A retracted paper about rats", doi="10.1000/ret"),                              # 7 retracted
        dict(base, title="A perfectly ordinary title", doi="10.1000/good", pmid="36443570"),              # 8 stitched
        dict(base, title="Unknown", pmid="11111111"),                                                      # 9 absent PMID
        dict(base, title="STOP: Self-Taught Optimizer", arxiv="2401.00001", source="arXiv"),              # 10 alias
        dict(base, title="Anything", arxiv="2401.00002", source="arXiv"),                                 # 11 absent arXiv
        dict(base, title="The effect of honey on coughing in small children", source="Honey J", year=2019),  # 12 title search
        dict(base, title="Completely unfindable statement of fact"),                                       # 13 unverified
        dict(base, title="x", url="ftp://a.org/x"),                                                        # 14 not http
        dict(base, title="x", arxiv="9999"),                                                               # 15 malformed
        dict(base, title="Page", url="https://www.nature.com/a"),                                          # 16 unreachable
        dict(base, title="Wrong words", source="Honey J", year=2019, volume="7", issue="2", pages="9"),    # 17 locator, same script, contradicted
        dict(base, title="蜂蜜对儿童咳嗽的影响研究", source="Honey J", year=2019, volume="7", issue="2", pages="9"),  # 18 locator across scripts
        dict(base, title="A perfectly ordinary title", doi="10.1000/good", url="https://www.nature.com/403"),  # 19 blocked page
        dict(base, title="A perfectly ordinary title", doi="10.1000/good", authors="Jones K"),             # 20 author mismatch
    ]
    refs = make_refs(rows)
    known = [f"https://doi.org/10.1000/{d}" for d in ("good", "other", "gone", "net", "cjk", "cjk2", "ret")] + [
        "https://arxiv.org/abs/2401.00001", "https://arxiv.org/abs/2401.00002", "https://pubmed.ncbi.nlm.nih.gov/11111111/"]
    probes = spark.createDataFrame([(u, i, 200, None) for i, u in enumerate(known)] + [
        ("https://www.nature.com/a", 90, None, "timeout"), ("https://www.nature.com/403", 91, 403, None)],
        "url string, probe_id bigint, http_status int, error_kind string")
    reg = Registries(works=works, pubmed=pubmed, arxiv=arxiv, retractions=retractions, probes=probes, probe_order=("probe_id",))
    out = with_notes(verify(refs, reg)).collect()
    return {r.ref_id: r for r in out}


VERDICTS = {1: ("verified", 18), 2: ("invalid", 12), 3: ("invalid", 12), 4: ("verified", 18), 5: ("verified", 18), 6: ("partial", 19),
            7: ("partial", 19), 8: ("invalid", 13), 9: ("invalid", 16), 10: ("partial", 19), 11: ("invalid", 12), 12: ("verified", 3),
            13: ("unverified", 10), 14: ("invalid", 11), 15: ("invalid", 1), 16: ("unreachable", 17), 17: ("unverified", 10), 18: ("verified", 5),
            19: ("verified", 14), 20: ("partial", 19)}


@pytest.mark.parametrize("ref_id", list(VERDICTS))
def test_verdict(verdicts, ref_id):
    r = verdicts[ref_id]
    assert (r.verdict, r.rule) == VERDICTS[ref_id]


def test_verdict_details(verdicts):
    assert verdicts[12].pmid_filled == "22222222" and verdicts[18].pmid_filled == "22222222"
    assert verdicts[7].needs_human and verdicts[10].needs_human and not verdicts[1].needs_human
    assert verdicts[5].doi_bridge == "original_title" and verdicts[6].cross_language
    assert verdicts[1].csl_authors == ["SMITH J"]
    assert "author_mismatch" in verdicts[20].note

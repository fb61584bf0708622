"""Readers, exports and streaming jobs on real files."""

import json

import pytest
from pyspark.sql import functions as F

from refledger.functions.similarity import TOKEN
from refledger.operators import match, score
from refledger.plans.queries.base import listed, refs, registries, results
from refledger.plans.verify import verify
from refledger.session import cut_lineage
from refledger.sources import bibtex, exports, readers

GB_T = """## Report

Words before the list.

参考文献

[1] 林晓青,周远. 山区茶园土壤酸化的长期监测与改良(2021版)[J]. 园艺土壤通讯, 2021, 18(3): 204-219. PMID: 31110001.
[2] Okafor BT，Lindqvist M，Arce PJ, et al. Acoustic monitoring of harbour seals: a field protocol for cold estuaries[J]. Coastal Methods, 2016, 27(4): e88-93. PMID: 27770002.
[3] Haverkamp D，Sato N. What the Lichens Remember: Slow Growth, Old Walls, City Air and Other Stories[J]. Urban Bot, 2018, 5: 61. PMID: 29990003.
[7] 北方湿地学会. 苔草沼泽春季水位调控技术要点[J]. 湿地与水文, 2019, 41(2). (内部题录)
[9] [A survey of bell founding in river towns (revised 2022)][J]. Zhong Yu Cheng Shi, 2022, 33(6): 77-90. PMID: 35550004.
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("refs")
    (d / "a.json").write_text(json.dumps([
        {"title": "First", "year": 2020, "doi": "10.1/a", "extra": [1], "semantic": "supports"},
        "not an object",
        {"title": "Second", "semantic": {"claim": "c", "support": "supported", "quote": "q"}, "volume": 7,
         "triples": [{"subject": "s", "relation": "r", "object": "o", "span": "x"}]}]), encoding="utf-8")
    (d / "b.bib").write_text("""
@comment{this is not an entry}
@preamble{"\\newcommand"}
@string{bg = "Bridges and Gorges"}
@article{oslo7,
  title = {Cable {Sag {II}}: wind, ice and
           patience},
  author = {Moreau, Ines and Tak, Oren},
  journal = {Bridges {and} Gorges},
  year = {2019}, doi = {10.5555/sag}
}
@book{plain2, title = "On Ferries, Slowly", year = 1987, doi = 10.5555/ferry}
@misc{pre3, title = {Counting Gulls from Above}, eprint = {2203.01010}, archivePrefix = {arXiv}, year = {2022}}
@misc{page4, title = {Tide Tables Explained}, howpublished = {\\url{https://tides.example/why}}, year = {2023}}
@article{bare5, title = {Nothing Else Is Known}}
""", encoding="utf-8")
    (d / "c.md").write_text(GB_T, encoding="utf-8")
    (d / "d.json").write_text("{broken", encoding="utf-8")
    (d / "README.md").write_text("## References\n\n1. Someone A. A title that must not be read here. Journal. 2020.\n", encoding="utf-8")
    return str(d)


def test_json(spark, folder):
    rows = readers.read_refs_json(spark, folder).orderBy("ref_id").collect()
    assert [(r.title, r.malformed) for r in rows] == [("First", False), ("not an object", True), ("Second", False)]
    assert rows[0].year == 2020 and rows[0].semantic is None
    assert rows[2].semantic.support == "supported" and rows[2].volume == "7" and rows[2].triples[0].object == "o"


def test_bibtex(spark, folder):
    rows = readers.ingest_bibtex(spark, folder).orderBy("ref_id").collect()
    assert [r.title for r in rows] == ["Cable Sag II: wind, ice and patience", "On Ferries, Slowly", "Counting Gulls from Above",
                                       "Tide Tables Explained", "Nothing Else Is Known"]
    assert (rows[0].source, rows[0].authors, rows[0].doi) == ("Bridges and Gorges", "Moreau, Ines, Tak, Oren", "10.5555/sag")
    assert (rows[1].year, rows[1].doi) == (1987, "10.5555/ferry")
    assert rows[2].arxiv == "2203.01010" and rows[3].url == "https://tides.example/why" and rows[3].source is None
    split = readers.ingest_bibtex(spark, folder, split_entries=True).orderBy("ref_id").collect()
    assert [r.title for r in split] == [r.title for r in rows]


def test_bibtex_odd_texts(spark):
    texts = ["", "@", "@article{", "@article{k,", "@article{k, title = {open", '@a{k, t = "open', "no records at all", None,
             "@article(k, title = {x})\n@misc{z, title = {y, {w}}, note = {}}", "@book{q, Title = {first}, title = {second}, year = {c. 1999}}",
             "  @misc{e, title = {50\\% of \\{all\\}}, author = {A and B}}", "@misc{deep, title = {" + "{" * 40 + "in" + "}" * 40 + "}}"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string").selectExpr("cast(n as string) AS path", "text")
    got = {}
    for r in bibtex.parse_bibtex(df).orderBy("path", "pos").collect():
        got.setdefault(int(r.path), []).append(r.title)
    assert got[8] == ["x", "y, w"] and got[9] == ["second"] and got[10] == ["50% of all"] and got[11] == ["in"]
    assert set(got) <= {4, 5, 8, 9, 10, 11} and got[4] == ["open"]


def test_markdown(spark, folder):
    rows = readers.ingest_markdown_refs(spark, folder).orderBy("ref_id").collect()
    assert len(rows) == 5
    assert (rows[0].pmid, rows[0].source, rows[0].volume, rows[0].issue, rows[0].pages) == ("31110001", "园艺土壤通讯", "18", "3", "204")
    assert (rows[1].pmid, rows[1].pages) == ("27770002", "e88")
    assert (rows[2].volume, rows[2].issue or "", rows[2].pages) == ("5", "", "61")
    assert rows[4].title.startswith("[A survey") and rows[4].source == "Zhong Yu Cheng Shi"


LINES = [
    ("1. **de la Cruz M, et al.** 2009 scale for the age of driftwood. *Shore Notes*. 2009;14(2):310-322.",
     "2009 scale for the age of driftwood", "Shore Notes", "2009"),
    ("[1] Harbour Board of the North. Rules for small jetties[EB/OL]. (2020)[2025-03-04]. https://www.harbours.example/j.",
     "Rules for small jetties", "", "2020"),
    ("[2] PETROV A.A. Dew on slate roofs at dawn[J]. Roof Journal, 2011, 3(1): 5.", "Dew on slate roofs at dawn", "Roof Journal", "2011"),
]


@pytest.mark.parametrize("line,title,source,year", LINES)
def test_markdown_variants(spark, line, title, source, year):
    from refledger.sources.markdown import parse_markdown

    df = spark.createDataFrame([("p", "### Heading\n\n" + line + "\n")], "path string, text string")
    (r,) = parse_markdown(df).collect()
    assert (r.title, r.source, r.year) == (title, source, year)


def test_directory_in_name_order(spark, folder):
    rows = readers.read_refs_dir(spark, folder).orderBy("ref_id").collect()
    assert [r.ref_id for r in rows] == list(range(1, 14))
    assert [r.path.rsplit("/", 1)[1] for r in rows] == ["a.json"] * 3 + ["b.bib"] * 5 + ["c.md"] * 5


def test_retraction_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text('OriginalPaperDOI,RetractionNature,RetractionDate,Reason\n10.1/A,Correction,2020-01-01,"a, ""b"""\n10.1/a,Retraction,2021-06-01,x\n')
    index = match.build_retraction_index(readers.read_retraction_csv(spark, str(p)))
    assert [(r.doi, r.nature) for r in index.collect()] == [("10.1/a", "Retraction")]


def test_registry_reader_keeps_one_row_per_key(spark, tmp_path):
    rows = [("10.1/A", "x", "transport_failed"), ("10.1/a", "y", "hit"), (None, "z", "hit")]
    spark.createDataFrame(rows, "doi string, title string, lookup_status string").write.parquet(f"{tmp_path}/w")
    (r,) = readers.read_registry(spark, "works", f"{tmp_path}/w").collect()
    assert (r.doi, r.title) == ("10.1/a", "y")


def test_writers(spark, sf, tmp_path):
    r = results(spark, sf)
    exports.export_bibtex(r, f"{tmp_path}/bib")
    exports.export_gbt7714(r, f"{tmp_path}/gbt", "2026-01-31")
    exports.export_ris(r, f"{tmp_path}/ris")
    exports.export_ledger_csv(r, f"{tmp_path}/csv")
    exports.export_workpaper(r, f"{tmp_path}/work")
    n_verified = r.filter("verdict = 'verified'").count()
    text = "\n".join(x.value for x in spark.read.text(f"{tmp_path}/bib").collect())
    assert text.count("@misc{") == n_verified
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").count() == r.count()
    assert spark.read.json(f"{tmp_path}/work").filter("checks.doi_metadata is not null").count() == r.count()
    # bibliographies round-trip through the reader
    back = bibtex.parse_bibtex(spark.createDataFrame([("p", text)], "path string, text string"))
    assert back.select("title").exceptAll(r.filter("verdict = 'verified'").select(
        F.trim(F.regexp_replace(F.translate("title", "{}\\", ""), r"\s+", " ")).alias("title"))).count() == 0


def test_trace_appends(spark, sf, tmp_path):
    r = results(spark, sf)
    for day in ("2026-01-30", "2026-01-31"):
        exports.append_trace(exports.trace_rows(r, score.scorecard(r), day), f"{tmp_path}/trace")
    assert spark.read.parquet(f"{tmp_path}/trace").groupBy("run_date").count().count() == 2


def test_health_stream_over_several_batches_equals_batch(spark, tmp_path):
    from refledger.operators import profile
    from refledger.streaming import jobs

    rows = spark.range(400).selectExpr(
        "id as probe_id", "concat('h', id % 3) as host", "timestamp '2024-01-01' + make_dt_interval(0, 0, cast(id * 37 as int)) as ts",
        "case when pmod(xxhash64(id), 3) < 2 then 'timeout' end as error_kind")
    for part in range(4):  # arrival order is event order
        rows.filter(f"probe_id div 100 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    jobs.probe_health_stream(stream, f"{tmp_path}/state", f"{tmp_path}/cp").awaitTermination()
    last = jobs.probe_health(spark, f"{tmp_path}/state")
    assert last.first().version == 3 and len(list((tmp_path / "state").glob("turn=*"))) == 2
    want = {r.host: (r.longest_run, r.is_open) for r in profile.host_health(rows).collect()}
    assert {r.host: (r.longest_run, r.is_open) for r in last.collect()} == want


def test_checkpoint_dir_is_respected(spark):
    before = spark.sparkContext.getCheckpointDir()
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    assert before is None or spark.sparkContext.getCheckpointDir() == before


def test_plan_shape(spark, sf):
    """No Cartesian product or nested-loop join over data, pruned scans, and one registry pass."""
    df = verify(refs(spark, sf), registries(spark, sf, with_pages=False), model=TOKEN)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    assert listed(spark, sf).columns


def test_stream_dedupe_by_any_key(spark, tmp_path):
    """Equal DOIs with different urls are one row, also across micro-batches; old holders are forgotten."""
    from refledger.streaming import jobs

    schema = "list_id bigint, ref_id bigint, title string, url string, doi string, pmid string, day int"
    runs = [[(1, 1, "one title", "https://a.org/1", "10.1/x", None, 1), (1, 2, "one title", "https://a.org/2", "10.1/X", None, 1),
             (1, 3, "other title", "https://a.org/1", None, None, 1), (1, 4, None, None, None, None, 1)],
            [(1, 5, "one title", "https://a.org/5", "10.1/x", "7", 2), (1, 6, "one title", "https://a.org/6", None, "7", 2), (2, 7, "one title", None, "10.1/x", None, 2)],
            [(1, 8, "one title", "https://a.org/6", None, None, 3)], [(1, 9, "last", None, "10.1/z", None, 40)], [(1, 10, "one title", None, "10.1/x", None, 41)]]
    for rows in runs:
        df = spark.createDataFrame(rows, schema).withColumn("ts", F.expr("timestamp '2024-01-01' + make_dt_interval(day)"))
        df.write.mode("append").parquet(f"{tmp_path}/in")
        jobs.dedupe_all_keys_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/held",
                                    f"{tmp_path}/cp").awaitTermination()
    kept = sorted(r.ref_id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert kept == [1, 3, 4, 6, 7, 9, 10]  # 5 repeats 1 and holds nothing, so 6 is kept and 8 repeats it; 10 comes after 1 has left
    assert len(list((tmp_path / "held").glob("turn=*"))) == 2

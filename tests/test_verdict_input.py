"""What the verdict reads and searches: texts once, and a title once where years do not matter."""

from pyspark.sql import functions as F

from refledger.fixtures import VIEWS, view, written_refs
from refledger.operators import fuzzy
from refledger.plans.queries import QUERIES


def test_verdict_queries_read_the_texts_once(spark, sf):
    for name in ("v1_verify_sequence", "v1_notes"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "text#" not in plan


def test_views_are_the_same_from_written_references(spark, sf):
    written = written_refs(spark, sf)
    for name in ("fx_records", "fx_csl", "fx_pubmed", "fx_arxiv", "fx_openalex", "fx_s2", "fx_notices", "fx_oa", "fx_url_probes",
                 "fx_archives", "fx_batch", "fx_cites"):
        assert name in VIEWS
        before, after = view(spark, sf, name), view(spark, sf, name, written)
        assert before.schema.simpleString() == after.schema.simpleString()
        assert before.exceptAll(after).isEmpty() and after.exceptAll(before).isEmpty()


def test_a_title_of_many_years_is_searched_once_where_years_do_not_matter(spark, monkeypatch):
    claims = spark.range(6).select(F.col("id").alias("q_id"), F.lit("wandering rivers of the northern plains").alias("q_title"),
                                   (F.col("id") + 2000).cast("int").alias("q_year"))
    records = spark.range(5).select(
        F.lit("s2").alias("source"), (9 - F.col("id")).alias("r_ord"), F.col("id").cast("string").alias("r_id"),
        F.lit("wandering rivers of the northern plain").alias("r_title"), (F.col("id") + 1990).cast("int").alias("r_year"),
        F.lit(None).cast("string").alias("r_doi"))
    counts, hits_of = [], fuzzy.word_hits

    def counted(questions, recs, gated):
        counts.append((questions.count(), recs.count()))
        return hits_of(questions, recs, gated)

    monkeypatch.setattr(fuzzy, "word_hits", counted)
    got = fuzzy.title_search(claims, records, [fuzzy.S2]).collect()
    assert counts == [(1, 1)]
    assert sorted((r.q_id, r.r_id, r.r_year) for r in got) == [(i, "4", 1994) for i in range(6)]

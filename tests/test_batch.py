"""The batch: stages in order, title confirmation without identifiers, citations of verified rows."""

import pytest
from pyspark.sql import functions as F

from refledger.functions.similarity import TOKEN
from refledger.operators import normalise
from refledger.plans.batch import finish, verify_batch
from refledger.plans.verify import Registries, verify, with_notes

TITLE = "Bronchiolitis guideline for general hospitals"


@pytest.fixture(scope="module")
def world(spark):
    works = spark.createDataFrame([
        ("10.1000/ok", TITLE, "Pediatrics", 2020, "1", "2", "3-4", None, "hit"),
        ("10.1000/other", TITLE, "Pediatrics", 2020, "1", "2", "3-4", None, "hit")],
        "doi string, title string, container string, year int, volume string, issue string, page string, "
        "authors array<struct<family:string,given:string,name:string>>, lookup_status string")
    probes = spark.createDataFrame([(u, i, 200 if "down" not in u else 503, None) for i, u in enumerate(
        ["https://doi.org/10.1000/ok", "https://doi.org/10.1000/other", "https://a.edu/page", "https://a.edu/down"])],
        "url string, probe_id bigint, http_status int, error_kind string")
    openalex = spark.createDataFrame([(1, TITLE, 2020, "10.1000/ok", 3, "journal")],
                                     "rank_id bigint, display_name string, publication_year int, doi string, cited_by_count bigint, source_type string")
    s2 = spark.createDataFrame([(1, TITLE, 2020, "10.1000/pub", "2401.00001", "Pediatrics")],
                               "paper_id bigint, title string, year int, doi string, arxiv_key string, venue string")
    cites = spark.createDataFrame([("10.1000/OK", 2, "however", "Later paper"), ("10.1000/ok", 1, None, "First paper"), ("10.1000/ok", 3, "we use", "Last")],
                                  "cited_doi string, edge_pos bigint, context string, citing_title string")
    return Registries(works=works, probes=probes, openalex=openalex, s2_papers=s2, citations=cites, probe_order=("probe_id",))


def rows(make_refs, *refs):
    return make_refs([{"source": "Pediatrics", "year": 2020, "title": TITLE, **r} for r in refs])


def test_a_page_without_identifier_is_confirmed_by_title(make_refs, world):
    refs = rows(make_refs, {"url": "https://a.edu/page"}, {"url": "https://a.edu/down"}, {"url": "https://a.edu/page", "title": "Something else entirely different here"},
                {"doi": "10.1000/ok"})
    got = {r.ref_id: r for r in with_notes(verify(refs, world, model=TOKEN)).collect()}
    assert (got[1].openalex_confirmed, got[1].s2_title_matched) == (True, True) and "open_index_has_title" in got[1].note
    assert got[2].verdict == "unreachable" and got[2].openalex_confirmed is None and got[2].s2_title_matched is None
    assert not got[3].openalex_confirmed and not got[3].s2_title_matched
    assert got[4].openalex_confirmed is None and got[4].verdict == "verified"
    # confirmation never changes a verdict, and lends no DOI to a row that has a page
    assert got[1].anchor_doi is None and got[1].verdict == got[3].verdict


def test_citations_of_rows_that_pass_every_check(make_refs, world):
    got = {r.ref_id: r for r in verify(rows(make_refs, {"doi": "10.1000/ok"}, {"doi": "10.1000/other"}, {"url": "https://a.edu/page"}), world, model=TOKEN).collect()}
    assert (got[1].cited_by, got[1].citation_coverage, got[1].citing_title) == (3, 0.67, "Later paper")
    assert got[2].cited_by is None and got[3].cited_by is None


def test_stages_act_in_their_order(spark, make_refs, world):
    refs = rows(make_refs, {"doi": "10.1000/ok"}, {"doi": "10.1000/ok"}, {"doi": "10.1000/other"}, {"title": None, "url": "https://a.edu/down"})
    support = F.when(F.col("ref_id") == 3, "contradicted").otherwise("supported")
    refs = refs.withColumn("semantic", F.struct(F.lit("a claim").alias("claim"), support.alias("support"), F.lit("").alias("quote"), F.lit("").alias("note")))
    batch = verify_batch(refs, world, policy=normalise.parse_source_policy("deny-domain=a.edu"), model=TOKEN)
    got = {r.ref_id: r for r in batch.results.collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["verified", "partial", "partial"]
    assert (got[2].duplicate_of, got[2].duplicate_kind) == (1, "url") and got[1].duplicate_of is None
    # rows 1 and 2 have one partner with another DOI, row 3 has two
    assert [got[i].clone_doi_partners for i in (1, 2, 3)] == [1, 1, 2]
    # completeness comes after duplicates and before the cap; the policy raises the flag only
    assert got[1].completeness == 70 and got[2].completeness is None and got[3].completeness == 70
    assert got[3].semantic_capped and got[3].needs_human
    assert got[4].policy_violation == "deny_domain" and got[4].verdict == "unreachable" and "E_UNREACHABLE" in got[4].error_codes
    assert "duplicate: 1 url" in got[2].note and "clone_doi: 2" in got[3].note and "semantic_cap: contradicted" in got[3].note
    card = batch.scorecard.first()
    assert (card.total, card.n_verified, card.n_partial, card.n_unreachable) == (4, 1, 2, 1)


def test_offline_and_empty(make_refs, world):
    refs = rows(make_refs, {"doi": "10.1000/ok"}, {"doi": "10.1000/ok"})
    off = {r.ref_id: r for r in verify_batch(refs, world, offline=True).results.collect()}
    assert off[2].verdict == "partial" and off[2].duplicate_of == 1 and "E_OFFLINE" in off[2].error_codes
    none = finish(verify(refs.filter("false"), world, model=TOKEN), world.s2_papers, model=TOKEN)
    assert none.results.count() == 0 and none.scorecard.count() == 0

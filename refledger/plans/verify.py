"""The verdict operator: registry joins, then one ordered decision."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import identifiers as ids
from refledger.functions import text as tx
from refledger.functions.similarity import SEQUENCE, SimilarityModel
from refledger.operators import fuzzy, match, normalise


@dataclass(frozen=True)
class Registries:
    """Snapshot tables; an absent one switches its checks off and never counts against a row."""

    works: DataFrame | None = None
    pubmed: DataFrame | None = None
    arxiv: DataFrame | None = None
    openalex: DataFrame | None = None
    s2_papers: DataFrame | None = None
    retractions: DataFrame | None = None
    oa_status: DataFrame | None = None
    probes: DataFrame | None = None
    archives: DataFrame | None = None
    pages: DataFrame | None = None
    citations: DataFrame | None = None
    complete: frozenset = frozenset()
    probe_order: tuple = ("ts",)
    archive_order: str = "ts"


_ABSENT = {
    "works": "doi string, title string, container string, year int, lookup_status string",
    "pubmed": "pmid string, title string, ta string, year int, volume string, issue string, page string, "
              "doi string, lookup_status string",
    "arxiv": "arxiv_key string, title string, year int, latest_version int, lookup_status string",
    "openalex": "rank_id bigint, display_name string, publication_year int, doi string, cited_by_count bigint, "
                "source_type string",
    "s2_papers": "paper_id bigint, title string, year int, doi string, arxiv_key string, venue string",
    "retractions": "doi string, nature string, date string, reason string",
    "probes": "url string, ts timestamp_ntz, http_status int, error_kind string",
}


def _fill(reg: Registries, spark) -> Registries:
    empty = {n: spark.createDataFrame([], s) for n, s in _ABSENT.items() if getattr(reg, n) is None}
    if "probes" in empty:
        empty["probes"] = empty["probes"].select("*", *[
            F.lit(None).cast("bigint").alias(c) for c in reg.probe_order if c not in ("ts",)])
    return replace(reg, **empty)


def _b(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def verify(refs: DataFrame, registries: Registries, medical: bool = False, offline: bool = False,
           model: SimilarityModel = SEQUENCE, require_version: bool = False) -> DataFrame:
    """Verdict, human flag, rule number and every check column per reference.

    References without a resolvable URL are searched by title first; a confirmed anchor DOI then
    takes the same registry path as a claimed one, so every registry is joined once.  ``ref_id`` must
    be unique.
    """
    base = normalise.normalise_refs(refs, medical)
    if offline:
        return _offline(base)
    reg = _fill(registries, refs.sparkSession)
    landing = match.landing_titles(reg.pages) if reg.pages is not None else None
    df = _search(base, reg, model)
    df = _checks(df, reg, landing, model, require_version)
    df = _decide(df, reg, landing, model)
    if reg.citations is not None:
        # later papers' contexts, for rows that came through every check to the end
        df = match.join_citations(df, reg.citations, when=F.col("rule").isin(18, 19))
    if reg.oa_status is not None:
        df = match.join_open_access(df.withColumn("claimed_doi", F.col("doi")).withColumn(
            "doi", F.col("doi_filled")), reg.oa_status).withColumn("doi", F.col("claimed_doi")).drop("claimed_doi")
    return df.withColumn("offline", F.lit(False))


def _offline(base: DataFrame) -> DataFrame:
    unresolved = F.col("resolved_url").isNull()
    bad = unresolved | ~ids.is_http(F.col("resolved_url"))
    return base.withColumns({
        "verdict": F.when(bad, "invalid").otherwise("partial"),
        "needs_human": F.lit(False),
        "rule": F.when(unresolved & (tx.strip(F.coalesce("arxiv", F.lit(""))) != ""), 1)
        .when(unresolved, 2).when(bad, 11).otherwise(19),
        "offline": F.lit(True),
    })


def _search(base: DataFrame, reg: Registries, model: SimilarityModel) -> DataFrame:
    """Title search: for references that resolve to nothing, and to confirm those that have a page but no identifier.

    The first kind asks PubMed and the open index, the second the open index and the second index; both are one
    search, each reference in its own registries.
    """
    def blank(name):
        return tx.strip(F.coalesce(F.col(name), F.lit(""))) == "" if name in base.columns else F.lit(True)

    titled = F.coalesce(F.col("clean_title"), F.lit("")) != ""
    loose = F.col("resolved_url").isNull()
    lost = loose & titled & blank("arxiv")
    url_only = ~loose & titled & blank("doi") & blank("pmid") & F.col("arxiv_id").isNull()
    asked = F.when(lost, F.array(F.lit(fuzzy.PUBMED.name), F.lit(fuzzy.OPENALEX.name))).otherwise(
        F.array(F.lit(fuzzy.OPENALEX.name), F.lit(fuzzy.S2.name)))
    open_rows = base.filter(lost | url_only).select("ref_id", "clean_title", "year", asked.alias("q_sources"))
    found = fuzzy.search_all(open_rows, reg.pubmed, reg.openalex, reg.s2_papers, model)
    df = base.join(found, "ref_id", "left")
    anchor = F.when(loose & F.col("reverse_adjust").isNull(), ids.doi_key(F.col("openalex_doi")))
    return df.withColumns({"anchor_doi": anchor, "titled": titled, "arxiv_malformed": loose & ~blank("arxiv")})


def _checks(df: DataFrame, reg: Registries, landing, model, require_version) -> DataFrame:
    """Every registry once, by the claimed identifier or the anchor."""
    key = F.coalesce(F.col("doi_norm"), F.col("anchor_doi"))
    df = match.match_doi(df, reg.works, model, "works" in reg.complete, landing, reg.openalex, key=key)
    df = match.confirm_secondary(df, reg.s2_papers, model)
    df = match.join_retractions(df, reg.retractions, key=key)
    df = match.match_arxiv(df, reg.arxiv, model, "arxiv" in reg.complete, require_version, landing,
                           when=F.col("doi_norm").isNull())
    df = match.crosscheck_doi_pmid(df, reg.pubmed)
    df = match.match_pmid(df, reg.pubmed, model, "pubmed" in reg.complete, landing, reg.openalex)
    df = match.join_reachability(df, reg.probes, list(reg.probe_order))
    # the locator serves two cases: references without any match so far, and a foreign-language
    # PubMed title that the locator of the same record can corroborate
    untitled = F.col("resolved_url").isNull() & F.col("titled") & ~F.col("arxiv_malformed") & F.col("reverse_adjust").isNull()
    df = match.locator_lookup(df, match.locator_index(reg.pubmed), model,
                              when=untitled | (F.col("pmid_cross_language") & _b("reachable")))
    corroborated = F.col("pmid_cross_language") & F.col("locator_matched") & (
        F.col("locator_pmid") == F.col("pmid_norm"))
    return df.withColumn("pmid_corroborated", F.coalesce(corroborated, F.lit(False)))


def _decide(df: DataFrame, reg: Registries, landing, model) -> DataFrame:
    """One ordered decision over the check columns; the first rule that holds wins."""
    loose = F.col("resolved_url").isNull()
    anchored = F.col("anchor_doi").isNotNull()
    concern = F.coalesce(F.col("retraction_nature") == "expression_of_concern", F.lit(False))
    noticed = F.col("retracted") | concern
    trusted = F.coalesce(F.col("tier").isin(*fv.TRUSTED_TIERS), F.lit(False))
    whole = F.size("missing") == 0
    doi_partial = F.coalesce(F.col("doi_adjust") == "partial", F.lit(False))
    ax_partial = F.coalesce(F.col("arxiv_adjust") == "partial", F.lit(False))
    pm_partial = F.coalesce(F.col("pmid_adjust") == "partial", F.lit(False)) & ~F.col("pmid_corroborated")
    reachable = F.col("reachable")
    status = F.col("http_status")
    known = F.col("doi_matched") | F.col("arxiv_matched") | F.col("s2_matched")
    resolver_404 = (status == 404) & ~(F.col("doi_matched") | F.col("arxiv_matched")) & F.col(
        "resolved_url").rlike(fv.ARXIV_RESOLVER)
    sound = trusted & whole & ~doi_partial & ~ax_partial
    rule = (
        # no resolvable URL
        F.when(loose & F.col("arxiv_malformed"), 1)
        .when(loose & ~F.col("titled"), 2)
        .when(loose & (F.col("reverse_adjust") == ""), 3)
        .when(loose & (F.col("reverse_adjust") == "partial"), 4)
        .when(loose & F.col("locator_matched"), 5)
        .when(loose & anchored & (F.col("doi_adjust") == "invalid"), 6)
        .when(loose & anchored & (~F.col("doi_matched") | doi_partial | noticed), 7)
        .when(loose & anchored, 8)
        .when(loose & _b("openalex_confirmed"), 9)
        .when(loose, 10)
        # resolvable
        .when(~ids.is_http(F.col("resolved_url")), 11)
        .when((F.col("doi_adjust") == "invalid") | (F.col("arxiv_adjust") == "invalid"), 12)
        .when(F.col("stitched"), 13)
        .when(~reachable & known & (status == 403), 14)
        .when(~reachable & resolver_404, 15)
        .when(F.coalesce(F.col("pmid_state") == "not_found", F.lit(False)) | (
            reachable & (F.col("pmid_adjust") == "invalid")), 16)
        .when(~reachable, 17)
        .when(sound & ~pm_partial & ~noticed, 18)
        .otherwise(19)
    )
    df = df.withColumn("rule", rule)
    if landing is not None:
        # looked up only where a weak tier or a gap makes the row partial anyway
        weak = (F.col("rule") == 19) & ~(trusted & whole) & ~F.col("retracted")
        df = match.landing_title_check(df, landing, model, when=weak)
    else:
        df = df.withColumns({"landing_sim": F.lit(None).cast("double"), "landing_confirmed": F.lit(False),
                             "landing_near": F.lit(False)})
    r = F.col("rule")
    verdict = (
        F.when(r.isin(1, 2, 6, 11, 12, 13, 15, 16), "invalid")
        .when(r.isin(3, 5, 8, 18) | ((r == 14) & sound & ~noticed), "verified")
        .when(r == 10, "unverified")
        .when(r == 17, "unreachable")
        .otherwise("partial"))
    human = (
        F.when(r.isin(1, 2, 3, 5, 8, 11, 18), False)
        .when(r.isin(4, 6, 7, 9, 10, 12, 13, 15, 16, 17), True)
        .when(r == 14, F.col("retracted") | (sound & noticed))
        .otherwise(noticed | ax_partial | pm_partial | F.col("landing_confirmed")))
    given = tx.blank_to_null(F.coalesce(F.col("pmid"), F.lit("")))
    df = df.withColumns({
        "verdict": verdict, "needs_human": human,
        "pmid_filled": F.when(r == 3, F.coalesce(given, F.col("reverse_pmid"))).when(
            r == 5, F.coalesce(given, F.col("locator_pmid"))).otherwise(F.col("pmid")),
        "doi_filled": F.when(r == 8, F.coalesce(tx.blank_to_null(F.coalesce(F.col("doi"), F.lit(""))), F.col(
            "anchor_doi"))).otherwise(F.col("doi")),
        "reachable": F.when(r > 13, reachable),
        # a page that could not be read, or an earlier finding, leaves no room for confirmation by title
        **{c: F.when(loose | r.isin(18, 19), F.col(c)) for c in ("openalex_confirmed", "openalex_near", "s2_title_matched")},
    })
    if reg.archives is not None:
        df = match.latest_archive(df, reg.archives, reg.archive_order)
    return df.drop("titled", "arxiv_malformed")


NOTES = {
    1: "arxiv_malformed", 2: "no_identifier", 3: "pubmed_title_match", 4: "pubmed_title_near",
    5: "locator_match", 6: "anchor_mismatch", 7: "anchor_unconfirmed", 8: "anchor_confirmed",
    9: "openalex_only", 10: "not_found_by_search", 11: "url_not_http", 12: "registry_mismatch",
    13: "stitched_identifiers", 14: "blocked_page_registry_confirmed", 15: "arxiv_resolver_404",
    16: "pmid_absent_or_mismatched", 17: "unreachable", 18: "verified", 19: "weakened",
}


def with_notes(results: DataFrame) -> DataFrame:
    """Coded notes: the rule, then every annotation that applies, as array<struct<code,detail>>."""
    def note(cond, code, detail=None):
        d = F.lit(None).cast("string") if detail is None else detail.cast("string")
        return F.when(cond, F.struct(F.lit(code).alias("code"), d.alias("detail")))

    cols = results.columns

    def on(name):
        return _b(name) if name in cols else F.lit(False)

    def got(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")

    rule_code = F.lit("unknown")
    for n, code in NOTES.items():
        rule_code = F.when(F.col("rule") == n, code).otherwise(rule_code)
    notes = F.array_compact(F.array(
        F.struct(rule_code.alias("code"), F.lit(None).cast("string").alias("detail")),
        note(on("doi_year_gap"), "doi_year_gap", got("csl_year")),
        note(on("journal_mismatch"), "journal_mismatch", got("csl_container")),
        note(on("author_mismatch"), "author_mismatch"),
        note(F.coalesce(got("doi_fidelity").isin("minor", "major"), F.lit(False)), "metadata_drift", got("doi_fidelity")),
        note(on("cross_language"), "cross_language", got("doi_bridge")),
        note(on("arxiv_year_gap"), "arxiv_year_gap"),
        note(got("arxiv_version_note").isNotNull(), "arxiv_version", got("arxiv_version_note")),
        note(got("retraction_nature").isNotNull(), "notice", got("retraction_nature")),
        note(on("retraction_check_failed"), "retraction_check_incomplete"),
        note(got("archive_url").isNotNull(), "archive", got("archive_url")),
        note(on("landing_near"), "landing_title_near"),
        note(on("openalex_confirmed"), "open_index_has_title"),
        note(on("openalex_near"), "open_index_title_near"),
        note(on("s2_title_matched"), "second_index_has_title"),
        note(got("cited_by").isNotNull(), "cited_by", F.concat_ws(" ", got("cited_by").cast("string"), F.concat(
            F.lit("("), got("citation_coverage").cast("string"), F.lit(")")), got("citing_title"))),
        note(F.size(F.coalesce(got("missing"), F.array().cast("array<string>"))) > 0 if "missing" in cols else F.lit(False),
             "missing_fields", F.array_join(F.col("missing"), ",") if "missing" in cols else None),
        note(F.coalesce(~got("tier").isin(*fv.TRUSTED_TIERS), F.lit(False)), "weak_tier", got("tier")),
    ))
    return results.withColumn("notes", notes).withColumn("note", F.array_join(F.transform(
        "notes", lambda x: F.concat_ws(": ", x["code"], x["detail"])), "; "))

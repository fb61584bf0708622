"""Registry matchers: each one adds check columns by a left join to a registry snapshot.

A snapshot holds at most one row per key and carries ``lookup_status``.  A key that is missing from
a snapshot only counts as ``not_found`` when the snapshot is declared complete; otherwise it is
``unknown`` and, like a failed lookup, is never held against the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import identifiers as ids
from refledger.functions import people_journals as pj
from refledger.functions import text as tx
from refledger.functions.similarity import SEQUENCE, SimilarityModel
from refledger.operators.common import best_row_by, first_row_by, lookup


def _state(key: Column, status: Column, complete: bool) -> Column:
    return F.when(key.isNotNull(), F.coalesce(status, F.lit("not_found" if complete else "unknown")))


def _text(c: Column) -> Column:
    return tx.strip(F.coalesce(c.cast("string"), F.lit("")))


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


# --- landing pages and the cross-language bridge ---------------------------------------------

def landing_titles(pages: DataFrame) -> DataFrame:
    """One row per normalised URL with the titles a page declares."""
    html = F.col("html")

    def first_group(pattern):
        got = tx.squeeze(F.regexp_extract(html, pattern, 1))
        return F.when(got != "", got)

    titled = pages.select(
        ids.normalise_url(F.col("url")).alias("page_key"),
        F.coalesce(
            first_group(r'(?is)<meta[^>]+name="citation_title"[^>]+content="([^"]+)"'),
            first_group(r'(?is)<meta[^>]+content="([^"]+)"[^>]+name="citation_title"'),
        ).alias("citation_title"),
        first_group(r'(?is)<meta[^>]+property="og:title"[^>]+content="([^"]+)"').alias("og_title"),
        first_group(r"(?is)<title[^>]*>(.*?)</title>").alias("page_title"),
        tx.title_key(F.concat(
            F.regexp_extract(html, r"(?is)<head[^>]*>(.*?)</head>", 1),
            F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))).alias("head_key"),
    )
    return first_row_by(titled, ["page_key"], [F.col("page_title"), F.col("head_key")])


def cross_lingual_bridge(df: DataFrame, need: Column, claimed: Column, doi: Column,
                         original_title: Column, landing_url: Column,
                         landing: DataFrame | None = None, openalex: DataFrame | None = None,
                         out: str = "bridge", model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Second opinions for titles in different writing systems; can only raise.

    Tries the registry's original-language title, the declared title of the landing page, the
    claimed title inside the page head, and the open index's name for the same DOI.  The first hit
    names itself in ``out``.
    """
    key = tx.title_key(claimed)
    df = df.withColumn("__bneed", F.coalesce(need, F.lit(False)) & (F.length(key) >= 6))
    wanted = F.when(F.col("__bneed"), claimed)

    def near(title):
        return F.coalesce(model.key(wanted, F.when(F.col("__bneed"), title)) >= fv.SIM_BRIDGE, F.lit(False))

    hit = F.when(near(original_title), "original_title")
    extra = []
    if landing is not None:
        page = F.coalesce(landing_url, F.concat(F.lit("https://doi.org/"), doi))
        df = lookup(df, landing, F.when(F.col("__bneed"), ids.normalise_url(page)), "page_key", "ref_id", {
            "__btitle": F.coalesce("citation_title", "og_title"), "__bhead": F.col("head_key")})
        hit = hit.when(near(F.col("__btitle")), "landing_title").when(
            F.col("__bneed") & F.contains(F.col("__bhead"), key), "landing_head")
        extra += ["__btitle", "__bhead"]
    if openalex is not None:
        named = first_row_by(
            openalex.select(ids.doi_key(F.col("doi")).alias("__odoi"), "rank_id", "display_name")
            .filter("__odoi is not null"), ["__odoi"], [F.col("rank_id")])
        df = lookup(df, named, F.when(F.col("__bneed") & (F.length(key) >= 12), F.lower(doi)), "__odoi",
                    "ref_id", {"__bname": F.col("display_name")})
        hit = hit.when(near(F.col("__bname")), "openalex_name")
        extra.append("__bname")
    return df.withColumn(out, hit).drop("__bneed", *extra)


# --- DOI ---------------------------------------------------------------------------------------

def match_doi(refs: DataFrame, works: DataFrame, model: SimilarityModel = SEQUENCE,
              complete: bool = False, landing: DataFrame | None = None,
              openalex: DataFrame | None = None, key: Column | None = None) -> DataFrame:
    """Compare title, year, journal and authors with the DOI record."""
    key = F.col("doi_norm") if key is None else key
    table = works.withColumn("__wkey", F.lower(F.col("doi")))
    df = lookup(refs, table, key, "__wkey", "ref_id", {
        "__w_status": F.col("lookup_status"), "__w_title": F.coalesce("title", F.lit("")),
        "__w_original": _optional(works, "original_title"), "__w_url": _optional(works, "landing_url"),
        "__w_container": F.col("container"), "__w_year": F.col("year"),
        "__w_volume": _optional(works, "volume"), "__w_issue": _optional(works, "issue"),
        "__w_page": _optional(works, "page"),
        "__w_authors": _optional(works, "authors",
                                 "array<struct<family:string,given:string,name:string>>"),
    })
    df = df.withColumn("doi_state", _state(key, F.col("__w_status"), complete))
    hit = F.col("doi_state") == "hit"
    title = F.coalesce(F.col("clean_title"), F.lit(""))
    compare = hit & (title != "")
    df = df.withColumn("doi_sim", model.plain(F.when(compare, title), F.when(compare, F.col("__w_title"))))
    sim = F.col("doi_sim")
    df = df.withColumn("cross_language", F.coalesce(
        compare & (sim < fv.SIM_MISMATCH) & tx.scripts_differ(title, F.col("__w_title")), F.lit(False)))
    df = cross_lingual_bridge(df, F.col("cross_language"), title, key, F.col("__w_original"),
                              F.col("__w_url"), landing, openalex, "doi_bridge", model)
    source = _text(F.col("source"))
    journal_off = hit & (_text(F.col("__w_container")) != "") & (source != "") & ~pj.journal_same(
        source, F.col("__w_container"))
    author_off = hit & ~pj.author_consistent(
        pj.surnames(_optional(refs, "authors")), pj.registered_name_parts(F.col("__w_authors")))
    df = df.withColumns({
        "journal_mismatch": F.coalesce(journal_off, F.lit(False)),
        "author_mismatch": F.coalesce(author_off, F.lit(False)),
    })
    fields = F.when(F.col("journal_mismatch") | F.col("author_mismatch"), "partial").otherwise("")
    adjust = (
        F.when(F.col("doi_state") == "not_found", "invalid")
        .when(~F.coalesce(hit, F.lit(False)), "")
        .when(title == "", fields)
        .when(F.col("cross_language") & F.col("doi_bridge").isNotNull(), fields)
        .when(F.col("cross_language"), "partial")
        .when(sim < fv.SIM_MISMATCH, "invalid")
        .when(sim < fv.SIM_CONSISTENT, "partial")
        .otherwise(fields)
    )
    # the drift label exists inside the partial band only
    fidelity = (
        F.when(~compare | F.col("cross_language") | (sim < fv.SIM_MISMATCH), "exact")
        .when(sim < fv.SIM_MINOR, "major")
        .when(sim < fv.SIM_CONSISTENT, "minor")
        .when(fields == "partial", "minor")
        .otherwise("exact")
    )

    def recorded(c):
        return F.when(hit, c)

    year = F.col("year").try_cast("int")
    return df.withColumns({
        "doi_matched": F.coalesce(hit, F.lit(False)),
        "doi_adjust": adjust,
        "doi_fidelity": F.when(hit, fidelity),
        "doi_year_gap": F.coalesce(recorded(F.abs(year - F.col("__w_year")) >= 2), F.lit(False)),
        "csl_title": recorded(F.col("__w_title")),
        "csl_authors": recorded(pj.gbt_authors(F.col("__w_authors"))),
        "csl_container": recorded(F.col("__w_container")),
        "csl_year": recorded(F.col("__w_year")),
        "csl_volume": recorded(F.col("__w_volume")),
        "csl_issue": recorded(F.col("__w_issue")),
        "csl_page": recorded(F.col("__w_page")),
    }).drop("__w_status", "__w_title", "__w_original", "__w_url", "__w_container", "__w_year",
            "__w_volume", "__w_issue", "__w_page", "__w_authors")


# --- PubMed ------------------------------------------------------------------------------------

def match_pmid(refs: DataFrame, pubmed: DataFrame, model: SimilarityModel = SEQUENCE,
               complete: bool = False, landing: DataFrame | None = None,
               openalex: DataFrame | None = None) -> DataFrame:
    """Existence, title tiers and journal of the PubMed page a reference resolves to."""
    key = ids.pubmed_url_pmid(F.col("resolved_url"))
    df = lookup(refs, pubmed, key, "pmid", "ref_id", {
        "__p_status": F.col("lookup_status"), "__p_title": F.coalesce("title", F.lit("")),
        "__p_doi": F.col("doi"), "__p_journal": F.coalesce(_optional(pubmed, "journal"), F.col("ta")),
    })
    df = df.withColumn("pmid_state", _state(key, F.col("__p_status"), complete))
    hit = F.coalesce(F.col("pmid_state") == "hit", F.lit(False))
    title, source = F.coalesce(F.col("clean_title"), F.lit("")), _text(F.col("source"))
    registered = tx.squeeze(F.col("__p_title"))
    compare = hit & (title != "")
    df = df.withColumn("pmid_sim", model.plain(F.when(compare, tx.strip(title)), F.when(compare, registered)))
    sim = F.col("pmid_sim")
    low = compare & (sim < fv.SIM_MISMATCH)
    reg_doi = ids.doi_key(F.col("__p_doi"))
    df = cross_lingual_bridge(df, low & reg_doi.isNotNull(), title, reg_doi, F.lit(None).cast("string"),
                              F.lit(None).cast("string"), landing, openalex, "pmid_bridge", model)
    foreign = tx.scripts_differ(title, F.col("__p_title"))
    journal_off = (source != "") & (_text(F.col("__p_journal")) != "") & ~pj.journal_consistent(
        source, F.col("__p_journal"))
    adjust = (
        F.when(F.col("pmid_state") == "not_found", "invalid")
        .when(~hit, "")
        .when(low & F.col("pmid_bridge").isNotNull(), "")
        .when(low & foreign, "partial")
        .when(low, "invalid")
        .when(compare & (sim < fv.SIM_CONSISTENT), "partial")
        .when(journal_off, "partial")
        .otherwise("")
    )
    return df.withColumns({
        "pmid_adjust": adjust,
        "pmid_matched": compare & F.coalesce(
            (sim >= fv.SIM_CONSISTENT) | F.col("pmid_bridge").isNotNull(), F.lit(False)),
        "pmid_cross_language": F.coalesce(low & foreign & F.col("pmid_bridge").isNull(), F.lit(False)),
    }).drop("__p_status", "__p_title", "__p_doi", "__p_journal")


def crosscheck_doi_pmid(refs: DataFrame, pubmed: DataFrame) -> DataFrame:
    """Both identifiers valid but the PMID is registered with another DOI: stitched."""
    key = F.when(F.col("doi_norm").isNotNull(), F.col("pmid_norm"))
    df = lookup(refs, pubmed, key, "pmid", "ref_id", {
        "__x_status": F.col("lookup_status"), "__x_doi": F.col("doi")})
    known = (F.col("__x_status") == "hit") & (_text(F.col("__x_doi")) != "")
    off = known & (ids.doi_compare_form(F.col("__x_doi")) != ids.doi_compare_form(F.col("doi_norm")))
    return df.withColumns({
        "stitched": F.coalesce(off, F.lit(False)),
        "pair_checked": F.coalesce(known, F.lit(False)),
    }).drop("__x_status", "__x_doi")


def locator_index(pubmed: DataFrame) -> DataFrame:
    """Record counts for every locator granularity, keyed by (ta, year, volume[, issue][, page]).

    Grouping sets answer the optional parts with one aggregation, so a reference meets a single
    counted row instead of all records of its journal volume.
    """
    ok = pubmed.filter(F.col("lookup_status") == "hit").select(
        F.lower(F.col("ta")).alias("l_ta"), F.col("year").alias("l_year"),
        _text(F.col("volume")).alias("l_volume"), _text(F.col("issue")).alias("l_issue"),
        _text(F.col("page")).alias("l_page"), "pmid", "title")
    sets = ok.groupingSets(
        [[F.col("l_ta"), F.col("l_year"), F.col("l_volume")],
         [F.col("l_ta"), F.col("l_year"), F.col("l_volume"), F.col("l_issue")],
         [F.col("l_ta"), F.col("l_year"), F.col("l_volume"), F.col("l_page")],
         [F.col("l_ta"), F.col("l_year"), F.col("l_volume"), F.col("l_issue"), F.col("l_page")]],
        F.col("l_ta"), F.col("l_year"), F.col("l_volume"), F.col("l_issue"), F.col("l_page"))
    counted = sets.agg(
        F.count("*").alias("l_count"), F.min("pmid").alias("l_pmid"),
        F.min_by("title", "pmid").alias("l_title"), F.grouping("l_issue").alias("__gi"),
        F.grouping("l_page").alias("__gp"))
    return counted.select(
        locator_key(F.col("l_ta"), F.col("l_year"), F.col("l_volume"),
                    F.when(F.col("__gi") == 0, F.col("l_issue")),
                    F.when(F.col("__gp") == 0, F.col("l_page"))).alias("l_key"),
        "l_count", "l_pmid", "l_title")


def locator_key(ta: Column, year: Column, volume: Column, issue: Column, page: Column) -> Column:
    bar = F.lit("\u0001")
    return F.concat(ta, bar, year.cast("string"), bar, volume, bar, F.coalesce(issue, F.lit("*")), bar,
                    F.coalesce(page, F.lit("*")))


def locator_lookup(refs: DataFrame, index: DataFrame, model: SimilarityModel = SEQUENCE,
                   when: Column | None = None) -> DataFrame:
    """Journal, year, volume and optional issue and page must single out one record."""
    def part(name):
        return tx.blank_to_null(F.coalesce(_optional(refs, name).cast("string"), F.lit("")))

    page = F.coalesce(part("pages"), part("page"))
    ta = F.lower(pj.journal_ta(F.col("source")))
    key = F.when(ta != "", locator_key(ta, F.col("year").try_cast("int"), part("volume"), part("issue"), page))
    if when is not None:
        key = F.when(when, key)
    df = lookup(refs, index, key, "l_key", "ref_id", {
        "locator_hits": F.col("l_count"), "__l_pmid": F.col("l_pmid"), "__l_title": F.col("l_title")})
    df = df.withColumn("locator_hits", F.when(key.isNotNull(), F.coalesce("locator_hits", F.lit(0))))
    unique = F.coalesce(F.col("locator_hits") == 1, F.lit(False))
    title = _text(F.col("clean_title"))
    compare = unique & (title != "") & (_text(F.col("__l_title")) != "")
    df = df.withColumn("locator_sim", model.plain(
        F.when(compare, title), F.when(compare, tx.squeeze(F.col("__l_title")))))
    families = F.transform(F.array(title, F.col("__l_title")), tx.script_family)
    fc, fr = F.get(families, F.lit(0)), F.get(families, F.lit(1))
    contradicted = compare & (F.col("locator_sim") < fv.SIM_MISMATCH) & (fc != "none") & (fc == fr)
    matched = unique & ~F.coalesce(contradicted, F.lit(False))
    return df.withColumns({
        "locator_matched": matched,
        "locator_contradicted": F.coalesce(contradicted, F.lit(False)),
        "locator_pmid": F.when(matched, F.col("__l_pmid")),
    }).drop("__l_pmid", "__l_title")


# --- arXiv ---------------------------------------------------------------------------------------

def match_arxiv(refs: DataFrame, arxiv: DataFrame, model: SimilarityModel = SEQUENCE,
                complete: bool = False, require_version: bool = False,
                landing: DataFrame | None = None, when: Column | None = None) -> DataFrame:
    """Title tiers, alias rule and version advice against the preprint registry.

    A failed lookup falls back to the title of the abstract page when ``landing`` is given.
    """
    key = ids.arxiv_base(F.col("arxiv_id"))
    if when is not None:
        key = F.when(when, key)
    df = lookup(refs, arxiv, key, "arxiv_key", "ref_id", {
        "__a_status": F.col("lookup_status"), "__a_title": tx.squeeze(F.coalesce("title", F.lit(""))),
        "__a_year": F.col("year"), "__a_latest": F.col("latest_version"),
        "__a_error": _optional(arxiv, "error")})
    failed = F.coalesce(F.col("__a_status").isin("transport_failed", "rate_limited"), F.lit(False))
    page_title = F.lit(None).cast("string")
    if landing is not None:
        page = F.concat(F.lit("https://arxiv.org/abs/"), F.col("arxiv_id"))
        df = lookup(df, landing, F.when(failed, ids.normalise_url(page)), "page_key", "ref_id", {
            "__a_page": F.col("page_title")})
        page_title = F.regexp_replace(F.col("__a_page"), r"^\[[^\]]*\]\s*", "")
    from_page = failed & page_title.isNotNull()
    state = F.when(from_page, "landing").when(
        _text(F.col("__a_error")) != "", "error").otherwise(_state(key, F.col("__a_status"), complete))
    df = df.withColumn("arxiv_state", state)
    known = F.coalesce(F.col("arxiv_state").isin("hit", "landing"), F.lit(False))
    registered = F.when(from_page, page_title).otherwise(F.col("__a_title"))
    title = F.coalesce(F.col("clean_title"), F.lit(""))
    compare = known & (title != "")
    df = df.withColumn("arxiv_sim", model.plain(F.when(compare, title), F.when(compare, registered)))
    sim = F.col("arxiv_sim")
    version = ids.arxiv_version(F.col("arxiv_id"))
    many = (F.col("arxiv_state") == "hit") & (F.col("__a_latest") > 1)
    unpinned = F.coalesce(many & version.isNull(), F.lit(False))
    # only a claim without letters is exempt from the script rule here
    families = F.transform(F.array(title, registered), tx.script_family)
    foreign = (F.col("arxiv_state") == "hit") & (F.get(families, F.lit(0)) != "none") & (
        F.get(families, F.lit(0)) != F.get(families, F.lit(1)))
    alias = F.when(from_page, tx.alias_of_landing(title, registered)).otherwise(
        tx.alias_of_api(title, registered))
    adjust = (
        F.when(F.col("arxiv_state").isin("not_found", "error"), "invalid")
        .when(~known, "")
        .when(unpinned & F.lit(require_version), "partial")
        .when(title == "", "")
        .when((sim < fv.SIM_MISMATCH) & foreign, "partial")
        .when((sim < fv.SIM_MISMATCH) & alias, "partial")
        .when(sim < fv.SIM_MISMATCH, "invalid")
        .when(sim < fv.SIM_CONSISTENT, "partial")
        .otherwise("")
    )
    year = F.col("year").try_cast("int")
    advice = F.when(unpinned, "version_unpinned").when(many & (version < F.col("__a_latest")), "version_outdated")
    return df.withColumns({
        "arxiv_adjust": adjust,
        "arxiv_matched": known,
        "arxiv_version_note": advice,
        "arxiv_year_gap": F.coalesce((F.col("arxiv_state") == "hit") & (
            F.abs(year - F.col("__a_year")) >= 2), F.lit(False)),
    }).drop("__a_status", "__a_title", "__a_year", "__a_latest", "__a_error", "__a_page")


# --- confirmation-only index ---------------------------------------------------------------------

def _with_prefix_ratio(model: SimilarityModel, title: Column, registered: Column, need: Column) -> Column:
    t, r = F.when(need, title), F.when(need, registered)
    head = F.when(F.length(r) >= F.length(t), F.substr(r, F.lit(1), F.length(t)))
    return F.when(need, F.greatest(model.plain(t, r), F.coalesce(model.plain(t, head), F.lit(0.0))))


def confirm_secondary(refs: DataFrame, s2_papers: DataFrame, model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Second index by DOI, only where the DOI registry gave no record; a mismatch stays silent."""
    papers = first_row_by(
        s2_papers.select(ids.doi_key(F.col("doi")).alias("__sdoi"), "paper_id", "title")
        .filter("__sdoi is not null"), ["__sdoi"], [F.col("paper_id")])
    title = F.coalesce(F.col("clean_title"), F.lit(""))
    key = F.when(~F.col("doi_matched") & (title != ""), F.col("doi_norm"))
    df = lookup(refs, papers, key, "__sdoi", "ref_id", {"__s_title": tx.squeeze(F.col("title"))})
    need = F.coalesce(F.col("__s_title") != "", F.lit(False))
    df = df.withColumn("s2_sim", _with_prefix_ratio(model, title, F.col("__s_title"), need))
    return df.withColumn("s2_matched", F.coalesce(
        F.col("s2_sim") >= fv.SIM_CONSISTENT, F.lit(False))).drop("__s_title")


# --- retractions, open access, reachability, archives, upgrades ----------------------------------

def build_retraction_index(notices: DataFrame, order: str = "line_no") -> DataFrame:
    """One notice per lower-case DOI: highest priority, then file order."""
    cols = notices.columns
    nature = F.trim(F.coalesce(F.col("nature"), F.lit("")))
    stored = F.when(nature != "", nature).otherwise(F.lit("Retraction"))
    rows = notices.select(
        F.lower(F.trim("doi")).alias("doi"), stored.alias("nature"),
        (F.trim("date") if "date" in cols else F.lit(None).cast("string")).alias("date"),
        (F.trim("reason") if "reason" in cols else F.lit(None).cast("string")).alias("reason"),
        F.col(order).alias("__line")).filter(F.coalesce(F.col("doi"), F.lit("")) != "")
    priority = F.lit(1)
    for name, value in fv.NOTICE_PRIORITY.items():
        priority = F.when(F.lower("nature") == name, value).otherwise(priority)
    return first_row_by(rows, ["doi"], [-priority, F.col("__line")]).drop("__line")


def join_retractions(refs: DataFrame, index: DataFrame, key: Column | None = None) -> DataFrame:
    """Notice class of the DOI; the retraction family and concerns weigh on the verdict."""
    key = F.col("doi_norm") if key is None else key
    df = lookup(refs, index, key, "doi", "ref_id", {
        "__n_nature": F.col("nature"), "__n_status": _optional(index, "lookup_status")})
    nature = F.when(F.col("__n_nature").isNotNull(), ids.retraction_class(F.col("__n_nature")))
    return df.withColumns({
        "retraction_nature": nature,
        "retracted": F.coalesce(nature.isin(*fv.RETRACTED_FAMILY), F.lit(False)),
        "retraction_check_failed": F.coalesce(F.col("__n_status") == "transport_failed", F.lit(False)),
    }).drop("__n_nature", "__n_status")


def join_open_access(results: DataFrame, oa: DataFrame) -> DataFrame:
    """Open-access facts for verified rows with a valid DOI."""
    key = F.when(F.col("verdict") == "verified", ids.doi_key(F.col("doi")))
    table = oa.withColumn("__odoi", F.lower(F.col("doi")))
    return lookup(results, table, key, "__odoi", "ref_id", {
        "is_oa": F.col("is_oa"),
        "oa_license": F.when(F.col("is_oa"), F.coalesce("license", F.lit(""))),
        "oa_url": F.when(F.col("is_oa"), F.coalesce("oa_url", F.lit(""))),
    })


def latest_probes(probes: DataFrame, order: list[str]) -> DataFrame:
    """Last outcome per URL."""
    return best_row_by(probes.select("url", "http_status", "error_kind", *order), ["url"],
                       [F.col(c) for c in order])


def join_reachability(refs: DataFrame, probes: DataFrame, order: list[str]) -> DataFrame:
    """Latest probe of the resolved URL.  2xx, 3xx and 429 are reachable; private hosts never are."""
    private = ids.non_public_host(F.col("resolved_url"))
    key = F.when(~private, F.col("resolved_url"))
    df = lookup(refs, latest_probes(probes, order), key, "url", "ref_id", {
        "http_status": F.col("http_status"), "__error": F.col("error_kind")})
    status = F.col("http_status")
    cause = F.when(private, "private_host").when(
        status.isNull() & F.col("__error").isNull(), "not_probed").otherwise(F.col("__error"))
    return df.withColumns({
        "reachable": F.coalesce(status.between(200, 399) | (status == 429), F.lit(False)),
        "probe_cause": F.when(F.col("resolved_url").isNotNull(), cause),
    }).drop("__error")


def latest_archive(results: DataFrame, archives: DataFrame, order: str = "ts") -> DataFrame:
    """Newest archived copy, for unreachable rows only."""
    newest = archives.groupBy("url").agg(F.max_by("archive_url", order).alias("archive_url"))
    key = F.when((F.col("verdict") == "unreachable") & ~ids.non_public_host(F.col("resolved_url")),
                 F.col("resolved_url"))
    return lookup(results, newest, key, "url", "ref_id", {"archive_url": F.col("archive_url")})


def join_citations(results: DataFrame, citations: DataFrame, when: Column) -> DataFrame:
    """How often the DOI is cited, the share of citations with a context, and the first citing title with one.

    ``citations``: cited_doi, edge_pos, context (or contexts), citing_title."""
    cols = citations.columns
    context = F.array_join("contexts", " ") if "contexts" in cols else F.col("context")
    has = F.coalesce(context, F.lit("")) != ""
    used = citations.filter("cited_doi is not null").groupBy(F.lower("cited_doi").alias("__cited")).agg(
        F.count("*").alias("cited_by"), F.round(F.count_if(has) / F.count("*"), 2).alias("citation_coverage"),
        F.min_by(F.when(has, F.col("citing_title")), F.when(has, F.col("edge_pos"))).alias("citing_title"))
    key = F.when(when, ids.doi_key(F.col("doi")))
    return lookup(results, used, key, "__cited", "ref_id", {c: F.col(c) for c in ("cited_by", "citation_coverage", "citing_title")})


def preprint_upgrades(results: DataFrame, s2_papers: DataFrame) -> DataFrame:
    """Verified arXiv references without a DOI whose paper has since been published."""
    papers = first_row_by(
        s2_papers.filter(_text(F.col("doi")) != "").select(
            ids.arxiv_base(F.col("arxiv_key")).alias("__key"), "paper_id", F.col("doi").alias("published_doi"),
            F.trim(F.coalesce("venue", F.lit(""))).alias("venue"),
            F.col("year").alias("published_year")).filter("__key is not null"),
        ["__key"], [F.col("paper_id")]).drop("paper_id")
    wanted = results.filter(
        (F.col("verdict") == "verified") & (_text(F.col("doi")) == "") & F.col("arxiv_id").isNotNull())
    return (
        wanted.join(papers, ids.arxiv_base(F.col("arxiv_id")) == F.col("__key"))
        .select("list_id", "ref_id", "arxiv_id", "published_doi", "venue", "published_year"))


def landing_title_check(refs: DataFrame, landing: DataFrame, model: SimilarityModel = SEQUENCE,
                        when: Column | None = None) -> DataFrame:
    """Does the page at the URL carry the claimed title?"""
    key = ids.normalise_url(F.col("resolved_url"))
    if when is not None:
        key = F.when(when, key)
    df = lookup(refs, landing, key, "page_key", "ref_id", {
        f"__{n}": F.col(n) for n in ("citation_title", "og_title", "page_title")})
    title = F.col("title")
    words = tx.token_set(title)
    sims, subset = [], F.lit(False)
    for n in ("citation_title", "og_title", "page_title"):
        cand = tx.strip(F.regexp_replace(F.col(f"__{n}"), r"\s+[-|–—]\s+.*$", ""))
        cand = F.when(cand != "", cand)
        sims.append(F.coalesce(model.title(F.when(cand.isNotNull(), F.coalesce(title, F.lit(""))), cand), F.lit(0.0)))
        page_words = tx.token_set(cand)
        subset = subset | (cand.isNotNull() & (F.size(page_words) >= 3) & tx.is_subset(page_words, words))
    df = df.withColumn("landing_sim", F.greatest(*sims)).withColumn("__sub", F.coalesce(subset, F.lit(False)))
    best = F.col("landing_sim")
    return df.withColumns({
        "landing_confirmed": (best >= fv.SIM_LANDING) | F.col("__sub"),
        "landing_near": ~((best >= fv.SIM_LANDING) | F.col("__sub")) & (best >= fv.SIM_NEAR),
    }).drop("__sub", "__citation_title", "__og_title", "__page_title")

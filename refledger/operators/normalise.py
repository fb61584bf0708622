"""Row-level operators on claimed references: normal forms, structure checks, admission rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import identifiers as ids
from refledger.functions import people_journals as pj
from refledger.functions import text as tx

REQUIRED = ["title", "url", "source", "year"]


def _col(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def missing_fields(df: DataFrame) -> Column:
    """Required fields without a value; a valid DOI, PMID or arXiv id stands in for the url."""
    def empty(name):
        c = _col(df, name).cast("string")
        blank = F.coalesce(c, F.lit("")) == ""
        return (blank | (c == "0")) if name == "year" else blank

    has_id = (
        ids.valid_doi(_col(df, "doi")) | ids.valid_pmid(_col(df, "pmid"))
        | ids.arxiv_id(_col(df, "arxiv"), _col(df, "url")).isNotNull()
    )
    flags = [
        F.when(empty(n) & (~has_id if n == "url" else F.lit(True)), F.lit(n)) for n in REQUIRED
    ]
    return F.array_compact(F.array(*flags))


def normalise_refs(refs: DataFrame, medical: bool = False) -> DataFrame:
    """Add the normal forms every later operator joins or decides on; one projection."""
    c = {n: _col(refs, n) for n in ("title", "url", "doi", "pmid", "arxiv", "source", "authors", "tier")}
    aid = ids.arxiv_id(c["arxiv"], c["url"])
    url = ids.resolve_url(c["url"], c["doi"], aid, c["pmid"])
    given_tier = tx.blank_to_null(c["tier"])
    return refs.withColumns({
        "arxiv_id": aid,
        "resolved_url": url,
        "missing": missing_fields(refs),
    }).withColumns({
        "title_key": tx.title_key(F.coalesce(c["title"], F.lit(""))),
        "clean_title": tx.clean_title(F.coalesce(c["title"], F.lit(""))),
        "url_key": ids.normalise_url(c["url"]),
        "doi_norm": ids.doi_key(c["doi"]),
        "pmid_norm": ids.pmid_key(c["pmid"]),
        "host": ids.host_of(F.col("resolved_url")),
        "tier": F.coalesce(given_tier, ids.source_tier(F.col("resolved_url"), medical)),
        "script": tx.script_family(c["title"]),
        "surnames": pj.surnames(c["authors"]),
    })


def structural_verdict(refs: DataFrame, medical: bool = False) -> DataFrame:
    """Offline verdict from structure alone; never better than partial."""
    df = normalise_refs(refs, medical)
    unresolved = F.col("resolved_url").isNull()
    bad_arxiv = (F.coalesce(F.trim(_col(refs, "arxiv")), F.lit("")) != "") & F.col("arxiv_id").isNull()
    reason = (
        F.when(unresolved & bad_arxiv, "arxiv_malformed")
        .when(unresolved, "no_identifier")
        .when(~ids.is_http(F.col("resolved_url")), "url_not_http")
        .otherwise("offline")
    )
    return df.withColumn("reason", reason).withColumn(
        "verdict", F.when(F.col("reason") == "offline", "partial").otherwise("invalid"))


def medical_caveats(results: DataFrame, medical: bool = True) -> DataFrame:
    """Caveat code for weak tiers under the medical profile."""
    tier = F.col("tier")
    note = (
        F.when(tier.isin("community", "social", "blog"), "medical_weak_source")
        .when(tier == "preprint", "medical_not_peer_reviewed")
    ) if medical else F.lit(None).cast("string")
    return results.withColumn("medical_caveat", note)


def parse_source_policy(spec: str) -> dict | None:
    """``journal_only``, ``allow-domain=a|b``, ``deny-domain=x`` joined by commas; None when bad."""
    policy = {"journal_only": False, "allow": [], "deny": []}
    for seg in filter(None, (s.strip() for s in (spec or "").split(","))):
        name, _, value = seg.partition("=")
        domains = [d.strip().lower() for d in value.split("|") if d.strip()]
        if seg == "journal_only":
            policy["journal_only"] = True
        elif name in ("allow-domain", "deny-domain") and domains:
            policy["allow" if name == "allow-domain" else "deny"] += domains
        else:
            return None
    return policy if any(policy.values()) else None


def source_policy(results: DataFrame, policy: dict, medical: bool = False) -> DataFrame:
    """Annotate rows that break a source policy; the verdict stays, the human flag is raised."""
    if not policy:
        raise ValueError("source policy is empty or malformed")
    url = F.coalesce(_col(results, "url"), F.lit(""))
    host = ids.http_host_of(url)

    def within(domains):
        cond = F.lit(False)
        for d in domains:
            cond = cond | (host == d) | host.endswith("." + d)
        return cond

    rule = F.when(within(policy["deny"]), "deny_domain")
    if policy["allow"]:
        rule = rule.when((host != "") & ~within(policy["allow"]), "not_allowed_domain")
    if policy["journal_only"]:
        rule = rule.when((host != "") & (ids.source_tier(url, medical) != "journal"), "not_journal")
    return results.withColumn("policy_violation", rule).withColumn(
        "needs_human", F.coalesce(F.col("needs_human"), F.lit(False)) | F.col("policy_violation").isNotNull())


def detect_medical_list(refs: DataFrame) -> DataFrame:
    """One row per list: any PubMed signal, or two medical-host hits."""
    url = F.lower(F.coalesce(_col(refs, "url"), F.lit("")))
    host = ids.host_of(_col(refs, "url"))
    signal = (F.coalesce(F.trim(_col(refs, "pmid")), F.lit("")) != "") | url.contains("pubmed")
    # journal only once the medical hosts join the rules, blog without them
    medical_host = host.rlike(ids.any_of(fv.MEDICAL_JOURNAL_HOSTS)) & (ids.tier_of_host(host) == "blog")
    hit = url.rlike(fv.CN_REGISTRY_HOSTS) | medical_host
    agg = refs.groupBy("list_id").agg(
        F.bool_or(signal).alias("has_pubmed"), F.count_if(hit).alias("medical_hits"))
    return agg.withColumn("is_medical", F.col("has_pubmed") | (F.col("medical_hits") >= 2))


def select_unresolved(results: DataFrame) -> DataFrame:
    """Seed rows of the next round: still open verdicts with at least one usable field."""
    fields = ["title", "url", "doi", "pmid", "arxiv", "source", "year"]
    kept = [F.nullif(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields]
    note = F.regexp_replace(F.coalesce(F.col("note"), F.lit("")), r"\s+", " ")
    out = results.filter(F.col("verdict").isin("partial", "unreachable", "unverified")).select(
        "list_id", "ref_id", *kept, note.alias("retry_reason"))
    return out.filter(F.coalesce(*[F.col(f) for f in fields]).isNotNull())


ACTIONS = {
    "invalid": "remove or replace the source",
    "unreachable": "open the original link by hand",
    "unverified": "run again with registries online",
}


def review_queue(results: DataFrame) -> DataFrame:
    """Rows a person must look at, with the suggested action."""
    verdict = F.col("verdict")
    action = F.lit("follow the note")
    for v, text in ACTIONS.items():
        action = F.when(verdict == v, text).otherwise(action)
    return results.filter(F.col("needs_human") | verdict.isin("invalid", "unverified")).select(
        "list_id", "ref_id", "title", "verdict", action.alias("suggested_action"))


def is_citable() -> Column:
    """Export admission: verified, or partial whose DOI record is consistent and present."""
    return (F.col("verdict") == "verified") | (
        (F.col("verdict") == "partial") & F.coalesce(F.col("doi_matched"), F.lit(False))
        & (F.coalesce(F.col("doi_adjust"), F.lit("")) == "") & F.col("csl_title").isNotNull())


def citable(results: DataFrame) -> DataFrame:
    return results.filter(is_citable())


ERROR_CODES = [
    "E_DOI_NOT_FOUND", "E_TITLE_MISMATCH", "E_CROSS_LANG", "E_STITCHED", "E_ARXIV_NOT_FOUND",
    "E_PMID_NOT_FOUND", "E_RETRACTED", "E_EXPRESSION_OF_CONCERN", "E_AUTHOR_MISMATCH",
    "E_JOURNAL_MISMATCH", "E_UNREACHABLE", "E_OFFLINE",
]


def error_codes(results: DataFrame) -> DataFrame:
    """Machine-readable codes from the structured check columns, in a fixed order."""
    def flag(name):
        return F.coalesce(_col(results, name, "boolean"), F.lit(False))

    def text(name):
        return F.coalesce(_col(results, name), F.lit(""))

    conditions = [
        text("doi_state") == "not_found",
        (text("doi_state") != "not_found") & (text("doi_adjust") == "invalid"),
        flag("cross_language"),
        flag("stitched"),
        text("arxiv_state").isin("not_found", "error"),
        text("pmid_state") == "not_found",
        flag("retracted"),
        text("retraction_nature") == "expression_of_concern",
        flag("author_mismatch"),
        flag("journal_mismatch"),
        F.col("verdict") == "unreachable",
        flag("offline"),
    ]
    codes = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in zip(ERROR_CODES, conditions)]))
    return results.withColumn("error_codes", codes)


MEANING = {
    "verified": ("exists, trusted tier, complete, agrees with the registries", "cite it"),
    "partial": ("reachable but weakened", "cite with reservations or review first"),
    "unreachable": ("could not be fetched; not proof of absence", "compare the archived copy"),
    "invalid": ("identifier absent, mismatched or stitched together", "do not cite; replace"),
    "unverified": ("not checked or unknown", "run again with registries online"),
}


def evidence_steps(results: DataFrame) -> DataFrame:
    """Ordered passed checks with the meaning of the verdict and the next action."""
    def flag(name):
        return F.coalesce(_col(results, name, "boolean"), F.lit(False))

    has_doi = F.coalesce(_col(results, "doi"), F.lit("")) != ""
    looked = _col(results, "doi_state").isNotNull()
    steps = F.array_compact(F.array(
        F.when(flag("doi_matched"), F.lit("doi_record_agrees"))
        .when(has_doi & looked, F.lit("doi_record_not_confirmed")),
        F.when(flag("arxiv_matched"), F.lit("arxiv_record_agrees")),
        F.when(flag("s2_matched"), F.lit("second_index_confirms")),
        F.when(flag("retracted"), F.lit("retraction_found")),
        F.when(flag("openalex_confirmed"), F.lit("openalex_confirms")),
        F.when(flag("reachable"), F.lit("page_reachable")),
        F.when(_col(results, "archive_url").isNotNull(), F.lit("archive_available")),
    ))
    meaning, action = F.lit("unknown verdict"), F.lit(None).cast("string")
    for v, (m, a) in MEANING.items():
        meaning = F.when(F.col("verdict") == v, m).otherwise(meaning)
        action = F.when(F.col("verdict") == v, a).otherwise(action)
    return results.withColumns({
        "evidence": F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit("no_check_recorded"))),
        "meaning": meaning, "action": action})


def export_completeness(results: DataFrame) -> DataFrame:
    """Score of the registry fields an export can fill; null without a registry record."""
    present = {
        "authors": F.size(F.coalesce(F.col("csl_authors"), F.array().cast("array<string>"))) > 0,
        "year": F.coalesce(F.col("csl_year"), F.lit(0)) != 0,
        **{n: F.coalesce(F.col(f"csl_{n}"), F.lit("")) != "" for n in ("container", "volume", "issue", "page")},
    }
    scored = (F.col("verdict") == "verified") & F.col("csl_title").isNotNull()
    total = sum((F.when(present[n], F.lit(w)).otherwise(F.lit(0)) for n, w in fv.COMPLETENESS.items()), F.lit(0))
    gaps = F.array_compact(F.array(*[F.when(~present[n], F.lit(n)) for n in fv.COMPLETENESS]))
    return results.withColumns({
        "completeness": F.when(scored, total), "completeness_missing": F.when(scored, gaps)})


def semantic_audit(refs: DataFrame) -> DataFrame:
    """Checked copy of the ``semantic`` struct; unknown support becomes unclear with a note."""
    s = F.col("semantic")
    support = F.lower(tx.strip(F.coalesce(s["support"], F.lit(""))))
    known = support.isin(*fv.SUPPORT_VALUES)
    odd = F.when(~known & (support != ""), F.concat(F.lit("unknown support: "), support))
    note = F.concat_ws("; ", odd, tx.blank_to_null(F.coalesce(s["note"], F.lit(""))))
    audit = F.struct(
        tx.strip(F.coalesce(s["claim"], F.lit(""))).alias("claim"),
        F.when(known, support).otherwise(F.lit("unclear")).alias("support"),
        tx.strip(F.coalesce(s["quote"], F.lit(""))).alias("quote"),
        note.alias("note"))
    return refs.withColumn("semantic_audit", F.when(s.isNotNull(), audit))


def semantic_cap(results: DataFrame) -> DataFrame:
    """A negative semantic judgement caps verified at partial and raises the human flag."""
    capped = F.coalesce(F.col("semantic_audit.support").isin(*fv.SUPPORT_CAPPED), F.lit(False)) & (
        F.col("verdict") != "invalid")
    return results.withColumns({
        "verdict": F.when(capped & (F.col("verdict") == "verified"), "partial").otherwise(F.col("verdict")),
        "needs_human": F.coalesce(F.col("needs_human"), F.lit(False)) | capped,
        "semantic_capped": capped,
    })

"""Identifier, URL and source-tier Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions.text import strip

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^/:?#]+)"


def _text(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def valid_doi(c: Column) -> Column:
    return _text(c).rlike(fv.DOI)


def valid_pmid(c: Column) -> Column:
    return _text(c).rlike(fv.PMID)


def doi_key(c: Column) -> Column:
    """Join key: stripped, lower case; null unless well formed."""
    t = _text(c)
    return F.when(t.rlike(fv.DOI), F.lower(t))


def pmid_key(c: Column) -> Column:
    t = _text(c)
    return F.when(t.rlike(fv.PMID), t)


def doi_normal_form(c: Column) -> Column:
    """Lower case without resolver or scheme prefix."""
    t = F.lower(_text(c))
    for prefix in (r"^https://doi\.org/", r"^http://doi\.org/", r"^doi\.org/", r"^doi:"):
        t = F.regexp_replace(t, prefix, "")
    return strip(t)


def doi_compare_form(c: Column) -> Column:
    """Lower case without trailing dots, then without trailing slashes."""
    return F.rtrim(F.rtrim(F.lower(_text(c)), F.lit(".")), F.lit("/"))


def arxiv_id(arxiv: Column, url: Column) -> Column:
    """Valid arXiv id from the field, else from an abs/pdf/format URL; null otherwise."""
    given = _text(arxiv)
    raw = F.when(given != "", given).otherwise(F.regexp_extract(_text(url), fv.ARXIV_URL, 1))
    raw = strip(F.regexp_replace(raw, r"(?i)^arxiv\s*:\s*", ""))
    ok = raw.rlike("(?i)" + fv.ARXIV_NEW) | raw.rlike("(?i)" + fv.ARXIV_OLD)
    return F.when(ok, raw)


def arxiv_base(c: Column) -> Column:
    """arXiv id without its version, lower case: the registry key."""
    return F.lower(F.regexp_replace(c, r"(?i)v\d+$", ""))


def arxiv_version(c: Column) -> Column:
    return F.regexp_extract(c, r"v(\d+)$", 1).try_cast("int")


def resolve_url(url: Column, doi: Column, arxiv: Column, pmid: Column) -> Column:
    """url, else DOI, arXiv or PubMed page; null when nothing resolves. ``arxiv`` is a valid id."""
    u = _text(url)
    return F.coalesce(
        F.when(u != "", u),
        F.when(valid_doi(doi), F.concat(F.lit("https://doi.org/"), _text(doi))),
        F.concat(F.lit("https://arxiv.org/abs/"), arxiv),
        F.when(
            valid_pmid(pmid),
            F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), _text(pmid), F.lit("/")),
        ),
    )


def is_http(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://")


def pubmed_url_pmid(url: Column) -> Column:
    got = F.regexp_extract(url, fv.PUBMED_URL, 1)
    return F.when(got != "", got)


def normalise_url(c: Column) -> Column:
    """Scheme and host lower case; no query, parameters, fragment or trailing slash."""
    u = F.regexp_replace(strip(c), r"[?#].*$", "")
    u = F.regexp_replace(u, r";[^/]*$", "")
    head = F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:(?://[^/]*)?)", 1)
    tail = F.substr(u, F.length(head) + 1)
    return F.concat(F.lower(head), F.rtrim(tail, F.lit("/")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def http_host_of(url: Column) -> Column:
    """Host of an http(s) URL only, as the source policy sees it."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://([^/:?#]+)", 1))


def non_public_host(url: Column) -> Column:
    """Loopback, private, reserved or multicast literals and local-only names."""
    host = F.regexp_replace(F.rtrim(host_of(url), F.lit(".")), r"[\[\]]", "")
    return host.rlike(fv.PRIVATE_HOST)


def any_of(patterns: list[str]) -> str:
    return "(?:" + "|".join(patterns) + ")"


def tier_of_host(host: Column, medical: bool = False) -> Column:
    out = F.when(host == "", F.lit("unknown"))
    for tier, patterns in fv.TIER_RULES:
        out = out.when(host.rlike(any_of(patterns)), F.lit(tier))
    if medical:
        out = out.when(host.rlike(any_of(fv.MEDICAL_JOURNAL_HOSTS)), F.lit("journal"))
    return out.otherwise(F.lit("blog"))


def source_tier(url: Column, medical: bool = False) -> Column:
    return tier_of_host(host_of(url), medical)


def retraction_class(nature: Column) -> Column:
    """Six-way class of a notice; an unknown kind keeps its own normalised name."""
    t = F.translate(F.lower(F.trim(F.coalesce(nature, F.lit("")))), "- ", "__")
    out = None
    for cls, names in fv.NOTICE_CLASSES.items():
        out = (out.when if out is not None else F.when)(t.isin(names), F.lit(cls))
    return out.otherwise(t)


def cache_key(columns: dict[str, Column], version: str, profile: str) -> Column:
    """SHA-1 over every verdict-relevant input plus rule version and profile."""
    parts = [columns[k].cast("string").alias(k) for k in sorted(columns)]
    body = F.struct(*parts, F.lit(version).alias("rules"), F.lit(profile).alias("profile"))
    return F.sha1(F.to_json(body, {"ignoreNullFields": "false"}))

"""Explicit schemas of every table the jobs read."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D, B = (T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


AUTHOR = _struct(("family", S), ("given", S), ("name", S))
SEMANTIC = _struct(("claim", S), ("support", S), ("quote", S), ("note", S))
TRIPLE = _struct(("subject", S), ("relation", S), ("object", S), ("span", S))

CLAIM_FIELDS = [
    "title", "url", "doi", "pmid", "arxiv", "source", "year", "authors", "volume", "issue",
    "pages", "claim", "tier", "found_via",
]

REFS = _struct(
    ("list_id", L), ("ref_id", L), ("title", S), ("url", S), ("doi", S), ("pmid", S), ("arxiv", S),
    ("source", S), ("year", I), ("authors", S), ("volume", S), ("issue", S), ("pages", S),
    ("claim", S), ("tier", S), ("found_via", S), ("semantic", SEMANTIC),
    ("triples", T.ArrayType(TRIPLE)),
)

REGISTRIES: dict[str, T.StructType] = {
    "works": _struct(
        ("doi", S), ("title", S), ("original_title", S), ("container", S), ("year", I),
        ("volume", S), ("issue", S), ("page", S), ("authors", T.ArrayType(AUTHOR)),
        ("landing_url", S), ("lookup_status", S)),
    "pubmed": _struct(
        ("pmid", S), ("title", S), ("ta", S), ("journal", S), ("year", I), ("volume", S),
        ("issue", S), ("page", S), ("doi", S), ("lookup_status", S)),
    "arxiv": _struct(
        ("arxiv_key", S), ("title", S), ("year", I), ("latest_version", I), ("error", S),
        ("lookup_status", S)),
    "openalex": _struct(
        ("rank_id", L), ("display_name", S), ("publication_year", I), ("doi", S),
        ("cited_by_count", L), ("source_name", S), ("source_type", S)),
    "s2_papers": _struct(
        ("paper_id", L), ("title", S), ("year", I), ("doi", S), ("arxiv_key", S), ("venue", S)),
    "citations": _struct(
        ("cited_doi", S), ("edge_pos", L), ("contexts", T.ArrayType(S)),
        ("intents", T.ArrayType(S)), ("influential", B), ("citing_title", S)),
    "retractions": _struct(("doi", S), ("nature", S), ("date", S), ("reason", S)),
    "oa_status": _struct(("doi", S), ("is_oa", B), ("license", S), ("oa_url", S)),
    "url_probes": _struct(
        ("url", S), ("host", S), ("ts", T.TimestampNTZType()), ("http_status", I), ("error_kind", S)),
    "archives": _struct(("url", S), ("ts", T.TimestampNTZType()), ("archive_url", S)),
    "pages": _struct(("url", S), ("html", S)),
}
REGISTRY_KEYS = {
    "works": "doi", "pubmed": "pmid", "arxiv": "arxiv_key", "oa_status": "doi",
    "retractions": "doi",
}

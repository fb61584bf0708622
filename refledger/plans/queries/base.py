"""Registry, inputs in the shape the operators expect, and SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.fixtures import view, with_views
from refledger.operators import match
from refledger.plans.verify import Registries
from refledger.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its twin over the driver tables."""
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


# --- inputs ----------------------------------------------------------------------------------------

def refs(spark: SparkSession, sf: str, written: str | None = None) -> DataFrame:
    return view(spark, sf, "fx_records", written)


def works(spark: SparkSession, sf: str, written: str | None = None) -> DataFrame:
    names = F.transform(F.split(F.col("families"), r"\|"), lambda f: F.struct(
        f.alias("family"), F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("name")))
    return view(spark, sf, "fx_csl", written).withColumn("authors", names).drop("families")


def registries(spark: SparkSession, sf: str, with_pages: bool = True, written: str | None = None) -> Registries:
    return Registries(
        works=works(spark, sf, written), pubmed=view(spark, sf, "fx_pubmed", written), arxiv=view(spark, sf, "fx_arxiv", written),
        openalex=view(spark, sf, "fx_openalex", written), s2_papers=view(spark, sf, "fx_s2", written),
        retractions=match.build_retraction_index(view(spark, sf, "fx_notices", written)),
        oa_status=view(spark, sf, "fx_oa", written), probes=view(spark, sf, "fx_url_probes", written),
        archives=view(spark, sf, "fx_archives", written),
        pages=view(spark, sf, "pages") if with_pages else None,
        probe_order=("probe_id",), archive_order="snapshot_id")


def results(spark: SparkSession, sf: str) -> DataFrame:
    df = view(spark, sf, "fx_results")
    return df.withColumns({
        "csl_authors": F.when(F.col("csl_families").isNotNull(), F.split(F.upper("csl_families"), r"\|")),
        "arxiv_id": F.col("arxiv"),
        "resolved_url": F.col("url"),
    }).drop("csl_families")


def listed(spark: SparkSession, sf: str) -> DataFrame:
    """Reference lists with positions, as the document operators take them."""
    return view(spark, sf, "fx_refs").select(
        "list_id", "ref_id", (F.col("ref_id") % 25 + 1).cast("int").alias("position"), "title", "doi", "year",
        F.array().cast("array<string>").alias("authors"))


# --- SQL fragments -----------------------------------------------------------------------------------

BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def title_key_sql(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def clean_title_sql(x: str) -> str:
    raw = strip_sql(x)
    t = f"regexp_replace({raw}, '^(?:\\[\\d+\\]|\\d+[.)])\\s*', '')"
    t = f"regexp_replace({t}, '(?is)\\s+(?:doi|pmid|arxiv)\\s*[:：].*$', '')"
    t = (f"regexp_replace({t}, '(?:,|\\.\\s)\\s*(?:et al\\.?|and\\s+[A-Z][a-z]+)[^0-9]{{0,40}}(?:19|20)\\d{{2}}', '')")
    t = f"regexp_replace({t}, '[.。]\\s*(?:19|20)\\d{{2}}.*$', '')"
    t = strip_sql(t)
    return f"CASE WHEN {t} <> '' THEN {t} ELSE {raw} END"


def tokens_sql(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9一-鿿]+'))"


def jaccard_sql(a: str, b: str) -> str:
    """Jaccard of two token lists without repeats."""
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0.0 ELSE {both} / (len({a}) + len({b}) - {both})::DOUBLE END"


def arxiv_sql(field: str, url: str) -> str:
    raw = (f"CASE WHEN coalesce({strip_sql(field)}, '') <> '' THEN {strip_sql(field)} "
           f"ELSE regexp_extract(coalesce({url}, ''), {q(fv.ARXIV_URL)}, 1) END")
    raw = f"trim(regexp_replace({raw}, '(?i)^arxiv\\s*:\\s*', ''))"
    ok = f"regexp_matches({raw}, {q('(?i)' + fv.ARXIV_NEW)}) OR regexp_matches({raw}, {q('(?i)' + fv.ARXIV_OLD)})"
    return f"CASE WHEN {ok} THEN {raw} END"


def doi_ok_sql(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {q(fv.DOI)})"


def pmid_ok_sql(x: str) -> str:
    return f"regexp_matches(coalesce({x}, ''), {q(fv.PMID)})"


def host_sql(url: str) -> str:
    return f"lower(regexp_extract(coalesce({url}, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"


def url_key_sql(url: str) -> str:
    u = f"regexp_replace(regexp_replace({url}, '[?#].*$', ''), ';[^/]*$', '')"
    head = f"regexp_extract({u}, '^([a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?)', 1)"
    return f"lower({head}) || rtrim(substr({u}, length({head}) + 1), '/')"


def tier_sql(host: str, medical: bool = False) -> str:
    out = f"CASE WHEN {host} = '' THEN 'unknown'"
    for tier, patterns in fv.TIER_RULES:
        out += f" WHEN regexp_matches({host}, {q('|'.join(patterns))}) THEN '{tier}'"
    if medical:
        out += f" WHEN regexp_matches({host}, {q('|'.join(fv.MEDICAL_JOURNAL_HOSTS))}) THEN 'journal'"
    return out + " ELSE 'blog' END"


def in_sql(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


NORMAL_SQL = f"""
WITH base AS (SELECT *, {arxiv_sql('arxiv', 'url')} AS arxiv_id FROM fx_records),
res AS (SELECT *, coalesce(url, CASE WHEN {doi_ok_sql('doi')} THEN concat('https://doi.org/', doi) END,
    CASE WHEN arxiv_id IS NOT NULL THEN concat('https://arxiv.org/abs/', arxiv_id) END,
    CASE WHEN {pmid_ok_sql('pmid')} THEN concat('https://pubmed.ncbi.nlm.nih.gov/', pmid, '/') END) AS resolved_url,
  CASE WHEN {doi_ok_sql('doi')} THEN lower(doi) END AS doi_norm,
  CASE WHEN {pmid_ok_sql('pmid')} THEN pmid END AS pmid_norm FROM base),
norm AS (SELECT *, {title_key_sql('title')} AS title_key, {clean_title_sql('title')} AS clean_title,
  CASE WHEN url IS NOT NULL THEN {url_key_sql('url')} END AS url_key, {host_sql('resolved_url')} AS host,
  {tier_sql(host_sql('resolved_url'))} AS tier,
  list_filter([CASE WHEN coalesce(title, '') = '' THEN 'title' END,
    CASE WHEN url IS NULL AND doi_norm IS NULL AND pmid_norm IS NULL AND arxiv_id IS NULL THEN 'url' END,
    CASE WHEN coalesce(source, '') = '' THEN 'source' END,
    CASE WHEN coalesce(year, 0) = 0 THEN 'year' END], lambda x: x IS NOT NULL) AS missing FROM res)
"""

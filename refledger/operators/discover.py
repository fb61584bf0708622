"""Topic search over registry snapshots and the merge of its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions import identifiers as ids
from refledger.functions import text as tx
from refledger.operators.common import first_row_by
from refledger.operators.fuzzy import search_words


def _relevance(title: Column, topic: str) -> Column:
    """Share of the topic's words found in the title."""
    words = search_words(F.lit(topic))
    return F.size(F.array_intersect(search_words(title), words)) / F.greatest(F.size(words), F.lit(1))


def discover(pubmed: DataFrame, openalex: DataFrame, topic: str, limit: int = 10, sort: str = "relevance",
             since: int | None = None, journal_only: bool = False) -> DataFrame:
    """Top rows of both sources by relevance, citations or year, merged into one candidate list.

    ``limit`` (per source) is the size of the requested result page."""
    limit = max(1, int(limit or 10))
    sort = sort if sort in ("relevance", "cited", "newest") else "relevance"
    p = pubmed.filter("lookup_status = 'hit'").select(
        F.lit(0).alias("source_rank"), F.col("pmid"), F.col("doi"), "title", F.col("ta").alias("source"), "year",
        F.lit(None).cast("bigint").alias("cited_by"), F.lit(None).cast("string").alias("src_type"),
        F.col("pmid").cast("bigint").alias("row_order"))
    o = openalex.select(
        F.lit(1).alias("source_rank"), F.lit(None).cast("string").alias("pmid"), "doi",
        F.col("display_name").alias("title"),
        (F.col("source_name") if "source_name" in openalex.columns else F.lit("")).alias("source"),
        F.col("publication_year").alias("year"), F.col("cited_by_count").alias("cited_by"),
        F.col("source_type").alias("src_type"), F.col("rank_id").alias("row_order"))

    def page(df, by_citations):
        rel = _relevance(F.col("title"), topic)
        first = F.col("cited_by").desc_nulls_last() if by_citations else (
            F.col("year").desc_nulls_last() if sort == "newest" else F.col("relevance").desc())
        return df.withColumn("relevance", F.round(rel, 6)).filter("relevance > 0").orderBy(
            first, F.col("relevance").desc(), "row_order").limit(limit)

    both = page(p, False).unionByName(page(o, sort == "cited"))
    merged = merge_sources(both, sort)
    if since and int(since) >= 1900:
        merged = merged.filter(F.col("year").isNull() | (F.col("year") >= int(since)))
    if journal_only:
        merged = merged.filter(F.col("pmid").isNotNull() | (F.col("src_type") == "journal"))
    return merged


def merge_sources(candidates: DataFrame, sort: str = "relevance") -> DataFrame:
    """Drop repeats by identifier, then fuse rows of one title whose years agree.

    ``candidates``: source_rank, row_order, title, doi, pmid, source, year, cited_by, src_type.  The
    first row wins; later ones fill its gaps.  A same-title row whose year differs by two or more
    stays a row of its own.
    """
    title = tx.squeeze(F.coalesce("title", F.lit("")))
    short = tx.name_key(title)
    doi = F.trim(F.regexp_replace(F.coalesce("doi", F.lit("")), r"^https://doi\.org/", ""))
    pmid = F.trim(F.coalesce("pmid", F.lit("")))
    key = F.when(doi != "", F.concat(F.lit("doi:"), F.lower(doi))).when(
        pmid != "", F.concat(F.lit("pmid:"), pmid)).when(short != "", F.concat(F.lit("t:"), short))
    rows = candidates.select(
        "source_rank", "row_order", title.alias("title"), short.alias("title60"), key.alias("key"),
        F.when(ids.valid_doi(doi), doi).alias("doi"), F.when(ids.valid_pmid(pmid), pmid).alias("pmid"),
        F.coalesce("source", F.lit("")).alias("source"), F.nullif(F.col("year"), F.lit(0)).alias("year"),
        F.when(F.col("cited_by") >= 0, F.col("cited_by")).alias("cited_by"), "src_type",
    ).filter((F.length("title") >= 15) & F.col("key").isNotNull())
    order = F.struct("source_rank", "row_order")
    unique = first_row_by(rows, ["key"], [F.col("source_rank"), F.col("row_order")]).withColumn("ord", order)
    # the first row's year, or the first known one, decides which others may fuse
    lead = unique.groupBy("title60").agg(
        F.min("ord").alias("lead"),
        F.coalesce(F.min_by("year", "ord"), F.min_by("year", F.when(F.col("year").isNotNull(), F.col("ord")))).alias("anchor"))
    j = unique.join(lead, "title60")
    fits = (F.col("ord") == F.col("lead")) | F.col("year").isNull() | F.col("anchor").isNull() | (
        F.abs(F.col("year") - F.col("anchor")) <= 1)
    grouped = j.withColumn("slot", F.when(fits, F.col("lead")).otherwise(F.col("ord")))

    def first_known(name, blank=None):
        c = F.col(name)
        known = c.isNotNull() if blank is None else (c.isNotNull() & (c != blank))
        return F.min_by(c, F.when(known, F.col("ord"))).alias(name)

    fused = grouped.groupBy("title60", "slot").agg(
        F.min_by("title", "ord").alias("title"), first_known("doi"), first_known("pmid"), first_known("source", ""),
        first_known("year"), first_known("cited_by"), first_known("src_type"), F.count("*").alias("n_merged"))
    return fused.select("title", "doi", "pmid", F.coalesce("source", F.lit("")).alias("source"), "year", "cited_by",
                        "src_type", "n_merged", F.col("slot.source_rank").alias("source_rank"),
                        F.col("slot.row_order").alias("row_order"))

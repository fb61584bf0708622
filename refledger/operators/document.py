"""In-text citations of documents against their reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import citations as ct
from refledger.operators.common import top_k
from refledger.session import cut_lineage


def extract_mentions(documents: DataFrame) -> DataFrame:
    """One row per marker and sentence: doc_id, list_id, sent, pos, marker, kind, sentence and targets.

    ``documents``: doc_id, list_id, text.  The reference section itself is not searched.
    """
    body = ct.body_before_references(F.col("text"))
    sent = documents.select("doc_id", "list_id", F.posexplode(ct.sentences(body)).alias("sent", "sentence"))
    # the cheap test keeps sentences without any marker out of the marker extraction
    likely = F.col("sentence").rlike(r"(?i)[\[(]|doi\.org/")
    rows = sent.filter(likely).select("*", F.posexplode(ct.sentence_markers(F.col("sentence"))).alias("pos", "m"))
    return rows.select("doc_id", "list_id", "sent", "pos", "sentence", "m.*")


def mention_targets(mentions: DataFrame) -> DataFrame:
    """One row per target of a mention: number, DOI, or surname with year."""
    base = ["doc_id", "list_id", "sent", "pos", "marker", "kind"]
    numeric = mentions.filter("kind = 'numeric'").select(
        *base, F.posexplode("numbers").alias("part", "number"))
    return numeric.select(
        *base, "part", "number", F.lit(None).cast("string").alias("surname"),
        F.lit(None).cast("string").alias("year"), F.lit(None).cast("string").alias("doi")
    ).unionByName(mentions.filter("kind <> 'numeric'").select(
        *base, F.lit(0).alias("part"), F.lit(None).cast("int").alias("number"), "surname", "year", "doi"))


def bind_citations(mentions: DataFrame, listed: DataFrame) -> DataFrame:
    """Bind every target to a list entry; ``ref_id`` stays null for an unbound one.

    ``listed``: list_id, ref_id, position (1-based), title, doi, year, authors (array, registry names).
    Numbers and DOIs are equality joins.  An author-year target takes the first entry whose year and
    registered authors agree, or whose title contains the surname.
    """
    targets = mention_targets(mentions)
    keys = ["doc_id", "list_id", "sent", "pos", "marker", "kind", "part"]
    numeric = targets.filter("kind = 'numeric'").join(
        listed.groupBy("list_id", F.col("position").alias("number")).agg(F.min("ref_id").alias("ref_id")),
        ["list_id", "number"], "left").select(*keys, "ref_id")
    by_doi = listed.filter(F.coalesce("doi", F.lit("")) != "").groupBy(
        "list_id", F.lower("doi").alias("doi_l")).agg(F.min_by("ref_id", "position").alias("ref_id"))
    doi = targets.filter("kind = 'doi'").withColumn("doi_l", F.lower("doi")).join(
        by_doi, ["list_id", "doi_l"], "left").select(*keys, "ref_id")
    authored = targets.filter("kind = 'author-year'").withColumn("s", F.lower("surname"))
    names = authored.select("list_id", "s", "year").distinct()
    first = _author_year_entries(names, listed)
    author = authored.join(first, ["list_id", "s", "year"], "left").select(*keys, "ref_id")
    return numeric.unionByName(doi).unionByName(author)


def _author_year_entries(names: DataFrame, listed: DataFrame) -> DataFrame:
    """First entry per (list, surname, year): equality on author words, containment in titles.

    Containment meets only titles that hold the surname's first characters, and the first position
    is an aggregate, so a long list is never gathered for one surname."""
    authors = F.coalesce(F.col("authors"), F.array().cast("array<string>"))
    by_name = listed.filter(F.col("year").isNotNull()).select(
        "list_id", "position", "ref_id", F.col("year").cast("string").alias("year"),
        F.explode(ct.content_words(F.array_join(authors, " "))).alias("s"))
    named = names.join(by_name, ["list_id", "s", "year"]).select("list_id", "s", "year", "position", "ref_id")
    title = F.lower(F.coalesce(F.col("title"), F.lit("")))

    def gram_of(c: Column) -> Column:
        return F.substring(c, 1, 4)

    surnames = names.select("list_id", "s").distinct().withColumn("gram", gram_of(F.col("s")))
    starts = F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(
        F.array(*[F.lit(n) for n in (2, 3, 4)]),
        lambda n: F.filter(F.transform(starts, lambda i: F.substr(F.col("t"), i, n)), lambda g: F.length(g) == n))))
    # only lists that are cited by name are cut into grams
    titles = listed.select("list_id", "position", "ref_id", title.alias("t")).join(
        names.select("list_id").distinct(), "list_id", "left_semi")
    inside = (
        titles.select("*", F.explode(grams).alias("gram"))
        .join(surnames, ["list_id", "gram"]).filter(F.contains("t", "s"))
        .groupBy("list_id", "s").agg(F.min(F.struct("position", "ref_id")).alias("m")))
    contained = names.join(inside, ["list_id", "s"]).select("list_id", "s", "year", "m.position", "m.ref_id")
    return named.unionByName(contained).groupBy("list_id", "s", "year").agg(
        F.min(F.struct("position", "ref_id")).alias("m")).select("list_id", "s", "year", F.col("m.ref_id").alias("ref_id"))


def unbound_mentions(mentions: DataFrame, bound: DataFrame) -> DataFrame:
    """Markers without any bound entry."""
    keys = ["doc_id", "sent", "pos"]
    hit = bound.filter("ref_id is not null").select(*keys)
    return mentions.join(hit, keys, "left_anti").select("doc_id", "list_id", "sent", "pos", "marker", "kind")


def uncited_refs(listed: DataFrame, bound: DataFrame) -> DataFrame:
    """List entries that no part of any marker refers to, in any document of the list."""
    cited = bound.filter("ref_id is not null").select("list_id", "ref_id")
    return listed.select("list_id", "ref_id", "position").join(cited, ["list_id", "ref_id"], "left_anti")


def cited_overlap(listed: DataFrame, documents: DataFrame, bound: DataFrame) -> DataFrame:
    """Distinct listed entries a document cites: the numerator of coverage."""
    cited = bound.filter("ref_id is not null").select("doc_id", "ref_id").distinct()
    return cited.join(documents.select("doc_id", "list_id"), "doc_id").join(
        listed.select("list_id", "ref_id"), ["list_id", "ref_id"], "left_semi").select("doc_id", "list_id", "ref_id")


def anchor_rates(mentions: DataFrame, bound: DataFrame, listed: DataFrame,
                 threshold: float = fv.ANCHOR_THRESHOLD) -> DataFrame:
    """Word overlap of each bound marker's sentence with the title of its first bound entry."""
    keys = ["doc_id", "sent", "pos"]
    first = bound.filter("ref_id is not null").groupBy(*keys).agg(F.min_by("ref_id", "part").alias("ref_id"))
    j = mentions.join(first, keys).join(listed.select("ref_id", "title", "authors"), "ref_id")
    rate = F.round(ct.anchor_rate(F.col("sentence"), F.col("title"), F.col("authors")), 3)
    raw = ct.anchor_rate(F.col("sentence"), F.col("title"), F.col("authors"))
    return j.select(*keys, "list_id", "marker", "kind", "ref_id", rate.alias("anchor_rate"),
                    F.when(raw >= threshold, "ok").otherwise("low").alias("anchor"))


def document_audit(documents: DataFrame, listed: DataFrame, threshold: float = fv.ANCHOR_THRESHOLD) -> DataFrame:
    """Counts and coverage per document.  The uncited entries themselves are ``uncited_refs``."""
    # the texts are read once; what follows works on markers
    mentions = cut_lineage(extract_mentions(documents))
    bound = cut_lineage(bind_citations(mentions, listed))
    rates = anchor_rates(mentions, bound, listed, threshold)
    per_marker = mentions.select("doc_id", F.lit(1).alias("n"), F.lit(0).alias("low"), F.lit(0).alias("bound")).unionByName(
        rates.select("doc_id", F.lit(0).alias("n"), (F.col("anchor") == "low").cast("int").alias("low"), F.lit(1).alias("bound")))
    # a marker has a rate exactly if one of its targets is bound
    counts = per_marker.groupBy("doc_id").agg(
        F.sum("n").alias("n_citations"), (F.sum("n") - F.sum("bound")).alias("n_unbound"), F.sum("low").alias("n_low_anchor"))
    cited = bound.groupBy("doc_id").agg(F.count_distinct("ref_id").alias("n_cited"))
    sizes = listed.groupBy("list_id").agg(F.count("*").alias("n_listed"))
    out = documents.select("doc_id", "list_id").join(sizes, "list_id", "left").join(counts, "doc_id", "left").join(cited, "doc_id", "left")
    filled = out.na.fill(0, ["n_listed", "n_citations", "n_unbound", "n_low_anchor", "n_cited"])
    coverage = F.when(F.col("n_listed") > 0, F.round(F.col("n_cited") / F.col("n_listed"), 2)).otherwise(F.lit(0.0))
    return filled.select("doc_id", "list_id", "n_citations", "n_unbound", "n_low_anchor", "n_listed",
                         (F.col("n_listed") - F.col("n_cited")).alias("n_uncited"), coverage.alias("coverage"))


# --- how later papers cite a work ------------------------------------------------------------------

def citation_usage(citations: DataFrame, key: str = "cited_doi", samples: int = 3) -> DataFrame:
    """Citations, share with context, and intents and influence of the first contextual samples.

    ``citations``: key, edge_pos, context, intents (array), influential."""
    has = F.coalesce("context", F.lit("")) != ""
    total = citations.groupBy(key).agg(F.count("*").alias("cited_by"), F.count_if(has).alias("n_context"))
    first = top_k(citations.filter(has), [key], [F.col("edge_pos")], samples)
    per = first.groupBy(key).agg(
        F.count("*").alias("n_samples"), F.count_if("influential").alias("n_influential"),
        *[F.count_if(F.array_contains("intents", i)).alias(f"n_{i}") for i in ("background", "methodology", "result")])
    out = total.join(per, key, "left").na.fill(0)
    return out.withColumn("coverage", F.round(F.col("n_context") / F.col("cited_by"), 2)).drop("n_context")


def citation_samples(citations: DataFrame, key: str = "cited_doi", samples: int = 3) -> DataFrame:
    """The sampled contexts themselves."""
    first = top_k(citations.filter(F.coalesce("context", F.lit("")) != ""), [key], [F.col("edge_pos")], samples)
    return first.select(key, "rank", "edge_pos", "context", "influential")


def context_divergence(citations: DataFrame, key: str = "cited_doi", samples: int = 3,
                       pattern: str = fv.CONTRAST) -> DataFrame:
    """Advisory: at least half of the sampled contexts contrast with or question the work."""
    first = top_k(citations.filter(F.coalesce("context", F.lit("")) != ""), [key], [F.col("edge_pos")], samples)
    per = first.groupBy(key).agg(
        F.count("*").alias("n_samples"), F.count_if(F.col("context").rlike(pattern)).alias("n_contrast"))
    return per.withColumn("divergent", (F.col("n_contrast") > 0) & (F.col("n_contrast") * 2 >= F.col("n_samples")))

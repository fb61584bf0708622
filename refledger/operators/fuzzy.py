"""Title search against a registry: candidates by shared words, then exact rescoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import text as tx
from refledger.functions.similarity import SEQUENCE, SimilarityModel, length_bound
from refledger.operators.common import first_row_by


def search_words(title: Column) -> Column:
    """Distinct lower-case words of two characters or more without stop words, in title order."""
    stop = tx.words_literal(fv.REVERSE_LOOKUP_STOP)
    words = F.regexp_extract_all(
        F.lower(F.coalesce(title, F.lit(""))), F.lit(r"([a-z一-鿿0-9]{2,})"), 1)
    return F.filter(F.array_distinct(words), lambda w: ~F.array_contains(stop, w))


def two_longest(words: Column) -> Column:
    """The two longest words; equal lengths keep title order."""
    ranked = F.array_sort(F.transform(words, lambda w, i: F.named_struct(
        F.lit("n"), -F.length(w), F.lit("i"), i, F.lit("w"), w)))
    return F.transform(F.slice(ranked, 1, 2), lambda s: s["w"])


def _pair(a: Column, b: Column) -> Column:
    return F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b))


def word_pairs(words: Column) -> Column:
    """Every unordered pair of the words of one title."""
    return F.flatten(F.transform(words, lambda a, i: F.transform(
        F.slice(words, i + 2, F.size(words)), lambda b: _pair(a, b))))


@dataclass(frozen=True)
class TitleSource:
    """How titles are searched in one registry."""

    name: str
    min_length: int
    floor: float = fv.SIM_MISMATCH
    year_gate: bool = True
    prefix: bool = False  # plain and prefix ratio instead of the two-channel title measure


PUBMED = TitleSource("pubmed", 20)
OPENALEX = TitleSource("openalex", 18)
S2 = TitleSource("s2", 18, floor=fv.SIM_CONSISTENT, year_gate=False, prefix=True)

_ROW = ["r_ord", "r_id", "r_title", "r_year", "r_doi"]
#: Stand-ins for a missing year, and for any year.
NO_YEAR, ANY_YEAR = -1, -2


def word_hits(questions: DataFrame, records: DataFrame, gated: Column) -> DataFrame:
    """Questions (source, pair, q_year, ...) with the ids of the records that have the pair, of a fitting year where
    ``gated``.

    A title has dozens of word pairs: only its id travels with them, and only the pairs that are asked for.  A
    question of a known year looks under the year itself, those beside it and none; records stand under their year
    and under any year, where questions without a year and sources without the rule look.
    """
    wanted = questions.select("source", "pair").distinct()
    asked = records.select("source", "r_id", "r_year", F.explode(word_pairs(search_words(F.col("r_title")))).alias("pair")).join(
        wanted, ["source", "pair"], "left_semi")
    any_year = F.lit(ANY_YEAR)
    under = F.when(gated, F.array(F.coalesce("r_year", F.lit(NO_YEAR)), any_year)).otherwise(F.array(any_year))
    y = F.col("q_year")
    look = F.when(gated & (y != NO_YEAR), F.array(y - 1, y, y + 1, F.lit(NO_YEAR))).otherwise(F.array(any_year))
    return questions.withColumn("slot", F.explode(look)).join(
        asked.select("source", "pair", "r_id", F.explode(under).alias("slot")), ["source", "pair", "slot"]).drop("pair", "slot")


def title_search(claims: DataFrame, records: DataFrame, sources: list[TitleSource],
                 model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Best record per claim and source.

    ``claims``: q_id, q_title, q_year, and q_sources where a claim asks some of the sources only.
    ``records``: source, r_ord, r_id, r_title, r_year, r_doi (ties go to the smallest r_ord, r_id).
    Returns q_id, source, r_id, r_title, r_year, r_doi, sim for scores of at least the source's floor.

    * Copies collapse first on both sides, so a title repeated a billion times is matched once (once a year
      where years must agree).
    * An equal title key with a compatible year scores 1 and needs no search.
    * The others meet the records that contain their two longest words, keyed by the *pair* of
      words; one frequent word alone never forms a group, and there is no cap on candidates.  Pairs
      that no claim asks for leave before anything is joined, and where years must agree they are part
      of the key: of the records on one frequent pair, a claim meets those of three years.  Only ids
      travel with the pairs; texts are fetched for the hits.
    * Rows that cannot reach the floor are dropped by exact native bounds before the ratio UDF.
    * The best row is an aggregate with a map-side part, not a sort of a group.
    """
    def per_source(field, default):
        out = F.lit(default)
        for s in sources:
            out = F.when(F.col("source") == s.name, F.lit(getattr(s, field))).otherwise(out)
        return out

    every = F.array(*[F.lit(s.name) for s in sources])
    gated = per_source("year_gate", True)
    # where years need not agree, a title is one question and one record, whatever its years
    q_year = F.when(gated, F.col("q_year")).otherwise(F.lit(ANY_YEAR)).alias("q_year")
    text = claims.select(
        "q_id", F.col("q_title"), F.coalesce("q_year", F.lit(NO_YEAR)).alias("q_year"),
        F.length(tx.strip(F.col("q_title"))).alias("q_len"),
        (F.col("q_sources") if "q_sources" in claims.columns else every).alias("q_sources")).filter(
            F.col("q_len") >= min(s.min_length for s in sources))
    questions = text.select("q_id", "q_title", "q_year", F.explode("q_sources").alias("source")).withColumn("q_year", q_year)
    distinct_q = (
        text.select("q_title", "q_year", "q_len", F.explode("q_sources").alias("source")).withColumn("q_year", q_year).distinct()
        .filter(F.col("q_len") >= per_source("min_length", 0))
        .withColumn("q_words", search_words(F.col("q_title"))).filter(F.size("q_words") >= 2)
        .select("q_title", "q_year", two_longest(F.col("q_words")).alias("top"),
                tx.title_key(F.col("q_title")).alias("q_key"), "source"))
    distinct_r = (
        records.filter(F.coalesce(F.trim("r_title"), F.lit("")) != "")
        .groupBy("source", "r_title", F.when(gated, F.col("r_year")).alias("y")).agg(F.min(F.struct("r_ord", "r_id", "r_doi", "r_year")).alias("r"))
        .select("source", "r_title", "r.*", tx.title_key(F.col("r_title")).alias("r_key")))
    year_ok = ~gated | tx.years_compatible(F.nullif(F.col("q_year"), F.lit(NO_YEAR)), F.col("r_year"))
    keys = ["source", "q_title", "q_year"]
    row = F.struct(*_ROW, "sim")
    plain_sources = [s for s in sources if not s.prefix]
    open_q, exact = distinct_q, None
    if plain_sources and model.name == "sequence":
        names = [s.name for s in plain_sources]
        by_key = distinct_r.filter(F.col("source").isin(*names)).groupBy("source", "r_key", "r_year").agg(
            F.min(F.struct("r_ord", "r_id", "r_title", "r_doi")).alias("r")).select(
                "source", F.col("r_key").alias("q_key"), "r_year", "r.*")
        equal = distinct_q.filter(F.col("q_key") != "").join(by_key, ["source", "q_key"]).filter(year_ok)
        exact = equal.withColumn("sim", F.lit(1.0)).groupBy(*keys).agg(
            F.min_by(row, F.struct("r_ord", "r_id")).alias("m"))
        open_q = distinct_q.join(exact.select(*keys), keys, "left_anti")
    keyed_q = open_q.select(*keys, "q_key", _pair(
        F.try_element_at("top", F.lit(1)), F.try_element_at("top", F.lit(2))).alias("pair"))
    hits = word_hits(keyed_q, distinct_r, gated)
    pairs = hits.join(distinct_r, ["source", "r_id"])
    floor = per_source("floor", 0.0)
    by_title, by_prefix = F.lit(None).cast("double"), F.lit(None).cast("double")
    use_prefix = per_source("prefix", False)
    if plain_sources:
        possible = (length_bound(F.col("q_key"), F.col("r_key")) >= floor) | (
            tx.token_sim(F.col("q_title"), F.col("r_title")) >= floor)
        pairs = pairs.filter(use_prefix | possible)
        by_title = model.title(F.when(~use_prefix, F.col("q_title")), F.when(~use_prefix, F.col("r_title")))
    if len(plain_sources) < len(sources):
        hyphens = r"[\-‐-―]+"
        pairs = pairs.withColumns({
            "q_plain": F.when(use_prefix, F.regexp_replace("q_title", hyphens, " ")),
            "r_plain": F.when(use_prefix, F.regexp_replace("r_title", hyphens, " "))})
        by_prefix = model.prefix(F.col("q_plain"), F.col("r_plain"))
    sim = F.coalesce(by_title, by_prefix)
    if model.name == "sequence":
        scored = pairs.withColumn("sim", sim).filter(F.col("sim") >= floor)
    else:  # a filter would compute a native score twice
        scored = pairs.select("*", F.explode(F.filter(F.array(sim), lambda s: s >= floor)).alias("sim"))
    near = scored.groupBy(*keys).agg(F.min_by(row, F.struct(-F.col("sim"), "r_ord", "r_id")).alias("m"))
    found = near if exact is None else exact.unionByName(near)
    return questions.join(found, keys).select(
        "q_id", "source", "m.r_id", "m.r_title", "m.r_year", "m.r_doi", "m.sim")


def best_candidate(claims: DataFrame, records: DataFrame, key: str, model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Of the records that share ``key`` with a claim and fit its year, the most alike by title; ties to the first.

    ``claims``: ref_id, key, title, year.  ``records``: rank_id, key, r_title, r_year.  Returns ref_id, rank_id, sim."""
    met = claims.join(records, key).filter(tx.years_compatible(F.col("year"), F.col("r_year")))
    scored = met.select("ref_id", "rank_id", model.plain(F.col("title"), F.col("r_title")).alias("sim"))
    return first_row_by(scored, ["ref_id"], [-F.col("sim"), F.col("rank_id")])


# --- the registries as search records ------------------------------------------------------------

def _claims(refs: DataFrame) -> DataFrame:
    return refs.select(F.col("ref_id").alias("q_id"), F.col("clean_title").alias("q_title"),
                       F.col("year").try_cast("int").alias("q_year"), *(["q_sources"] if "q_sources" in refs.columns else []))


def pubmed_records(pubmed: DataFrame) -> DataFrame:
    return pubmed.filter(F.col("lookup_status") == "hit").select(
        F.lit(PUBMED.name).alias("source"), F.lit(None).cast("bigint").alias("r_ord"), F.col("pmid").alias("r_id"),
        tx.squeeze(F.col("title")).alias("r_title"), F.col("year").alias("r_year"), F.lit(None).cast("string").alias("r_doi"))


def openalex_records(openalex: DataFrame) -> DataFrame:
    doi = F.trim(F.regexp_replace(F.coalesce("doi", F.lit("")), r"^https://doi\.org/", ""))
    return openalex.select(
        F.lit(OPENALEX.name).alias("source"), F.col("rank_id").alias("r_ord"), F.col("rank_id").cast("string").alias("r_id"),
        tx.squeeze(F.col("display_name")).alias("r_title"), F.col("publication_year").alias("r_year"), doi.alias("r_doi"))


def s2_records(s2_papers: DataFrame) -> DataFrame:
    return s2_papers.select(
        F.lit(S2.name).alias("source"), F.col("paper_id").alias("r_ord"), F.col("paper_id").cast("string").alias("r_id"),
        tx.squeeze(F.col("title")).alias("r_title"), F.col("year").alias("r_year"), F.lit(None).cast("string").alias("r_doi"))


def _reading(source: str) -> dict[str, Column]:
    """What a hit of each source means for the reference."""
    sim = F.col("sim")
    sure = sim >= fv.SIM_CONSISTENT
    return {
        PUBMED.name: {
            "reverse_pmid": F.col("r_id"), "reverse_sim": sim,
            "reverse_adjust": F.when(sure, "").otherwise("partial")},
        OPENALEX.name: {
            "openalex_sim": sim, "openalex_confirmed": sure, "openalex_near": ~sure & (sim >= fv.SIM_NEAR),
            "openalex_doi": F.when(sure, F.lower(F.col("r_doi")))},
        S2.name: {"s2_title_matched": F.lit(True), "s2_title_sim": sim},
    }[source]


def _read(hits: DataFrame, source: str) -> DataFrame:
    return hits.select(F.col("q_id").alias("ref_id"), *[c.alias(n) for n, c in _reading(source).items()])


def reverse_title_lookup(refs: DataFrame, pubmed: DataFrame, model: SimilarityModel = SEQUENCE) -> DataFrame:
    """PubMed record of a reference without identifiers, by title.  One row per hit."""
    return _read(title_search(_claims(refs), pubmed_records(pubmed), [PUBMED], model), PUBMED.name)


def anchor_openalex(refs: DataFrame, openalex: DataFrame, model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Open-index record by title; a confirmed one yields a DOI for the registry check."""
    return _read(title_search(_claims(refs), openalex_records(openalex), [OPENALEX], model), OPENALEX.name)


def confirm_by_title(refs: DataFrame, s2_papers: DataFrame, model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Second index by title: full or prefix ratio of at least 0.82; silent otherwise."""
    return _read(title_search(_claims(refs), s2_records(s2_papers), [S2], model), S2.name)


def search_all(refs: DataFrame, pubmed: DataFrame, openalex: DataFrame, s2_papers: DataFrame,
               model: SimilarityModel = SEQUENCE) -> DataFrame:
    """The three title searches as one search over the united registries; one row per reference.

    ``q_sources`` of ``refs``, if there, names the registries a reference is looked up in."""
    records = pubmed_records(pubmed).unionByName(openalex_records(openalex)).unionByName(s2_records(s2_papers))
    hits = title_search(_claims(refs), records, [PUBMED, OPENALEX, S2], model)
    cols = [F.max(F.when(F.col("source") == s.name, c)).alias(n)
            for s in (PUBMED, OPENALEX, S2) for n, c in _reading(s.name).items()]
    return hits.groupBy(F.col("q_id").alias("ref_id")).agg(*cols)


def cross_registry_consistency(works: DataFrame, openalex: DataFrame, pubmed: DataFrame,
                               model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Titles of one paper in three registries, pairwise; only papers present in all three."""
    def plain(c):
        return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))

    w = works.filter("lookup_status = 'hit'").select(F.lower("doi").alias("doi"), plain(F.col("title")).alias("tw"))
    o = openalex.filter("doi is not null").groupBy(F.lower("doi").alias("doi")).agg(
        F.min_by(plain(F.col("display_name")), "rank_id").alias("to"))
    p = pubmed.filter("lookup_status = 'hit' and doi is not null").groupBy(F.lower("doi").alias("doi")).agg(
        F.min("pmid").alias("pmid"), F.min_by(plain(F.col("title")), "pmid").alias("tp"))
    j = w.join(o, "doi").join(p, "doi").filter("tw <> '' and to <> '' and tp <> ''")
    j = j.withColumns({
        "works_openalex": model.plain(F.col("tw"), F.col("to")),
        "works_pubmed": model.plain(F.col("tw"), F.col("tp")),
        "openalex_pubmed": model.plain(F.col("to"), F.col("tp"))})
    worst = F.least("works_openalex", "works_pubmed", "openalex_pubmed")
    return j.select("doi", "pmid", "works_openalex", "works_pubmed", "openalex_pubmed",
                    (worst >= fv.CROSS_REGISTRY_MIN).alias("consistent"))

"""Benchmark decontamination by winnowing, with SQL functions only.

A window is ``span`` consecutive words of an item; an item with fewer words (but not none) is one window.  The
fingerprint of ``span`` words is the smallest of their k-gram hashes.  Equal windows have equal fingerprints,
and neighbouring windows mostly share theirs, so a document needs about two fingerprints in seven words and
every shared span of ``span`` words is found.  Fingerprints of documents and items are joined, and around each
hit the windows themselves are compared.  Items shorter than ``span`` words take their only gram as fingerprint.

Words, grams and windows are compared by 64-bit hashes.  Defined results: a null or empty text has no words;
an item without words occurs nowhere; items of one id count once; a null item_id counts as the empty id;
repeated documents are separate rows; without items or documents nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.llm.common import lower_ascii, only
from refledger.session import cut_lineage

#: Everything in ASCII but digits and lower-case letters parts words.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 10, 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), PARTING), "")


def grams(ws: Column, n: int) -> Column:
    """Hash of every ``n`` consecutive words, by position."""
    starts = F.slice(ws, F.lit(1), F.greatest(F.size(ws) - (n - 1), F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, n)]))


def window_minima(hashes: Column, width: int) -> Column:
    """Smallest of every ``width`` consecutive hashes, by position."""
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (width - 1), F.lit(0)))
    if width == 1:
        return starts
    return F.transform(starts, lambda h, i: F.least(h, *[F.get(hashes, i + j) for j in range(1, width)]))


def fingerprinted(texts: DataFrame, short: list[int], span: int, k: int) -> DataFrame:
    """Adds ``ws`` (words), ``marks`` (fingerprint by position) and ``g<n>`` for the short lengths."""
    out = texts.withColumn("ws", words(F.col("text"))).withColumn("__g", grams(F.col("ws"), k))
    out = out.withColumn("marks", window_minima(F.col("__g"), span - k + 1)).drop("__g")
    for n in short:
        out = out.withColumn(f"g{n}", grams(F.col("ws"), n))
    return out


def items_and_windows(items: DataFrame, span: int, k: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """(fingerprints, windows, short lengths).  The short lengths are at most ``span - 1`` numbers."""
    texts = only(items, "item_id", "text").select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    n = F.size("ws")
    short = sorted(r[0] for r in texts.select(words(F.col("text")).alias("ws")).select(n.alias("n")).filter(
        f"n BETWEEN 1 AND {span - 1}").distinct().collect())
    known = fingerprinted(texts, short, span, k)
    marks, windows = F.when(n >= span, F.col("marks")), F.when(n >= span, grams(F.col("ws"), span))
    for s in short:
        marks = F.when(n == s, F.col(f"g{s}")).otherwise(marks)
        windows = F.when(n == s, F.col(f"g{s}")).otherwise(windows)
    fingerprints = known.select(F.explode(marks).alias("mark")).distinct()
    lengths = F.least(n, F.lit(span)).alias("len")
    return fingerprints, known.select("item", lengths, F.explode(windows).alias("window")).distinct(), short


def contamination(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside occurring windows), n_items, items_sha256,
    contaminated, and ``spans`` (start, length) of the windows found, from word 0."""
    fingerprints, windows, short = items_and_windows(items, span, k)
    # rows of one id and text have one result: they are counted, and told apart by a hash of the text
    texts = only(docs, "doc_id", "text").withColumn("__text", F.xxhash64("text"))
    known = fingerprinted(texts, short, span, k)
    every = F.array_distinct(F.concat(F.col("marks"), *[F.col(f"g{s}") for s in short]))
    marked = known.select("doc_id", "__text", F.size("ws").cast("long").alias("n_words"), every.alias("__every"))
    single = marked.select("doc_id", "__text", "n_words", F.posexplode_outer("__every").alias("__i", "mark"))
    found = single.join(fingerprints.withColumn("__hit", F.col("mark")), "mark", "left")
    rows = cut_lineage(found.groupBy("doc_id", "__text").agg(
        F.first("n_words").alias("n_words"), F.count_if(F.coalesce(F.col("__i"), F.lit(0)) == 0).alias("__copies"),
        F.collect_set("__hit").alias("__hits")))

    suspects = rows.filter(F.size("__hits") > 0).select(
        F.col("doc_id").alias("__d"), F.col("__text").alias("__t"), "__hits")
    again = texts.join(suspects, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t"))
                       ).dropDuplicates(["doc_id", "__text"])
    close = fingerprinted(again.select("doc_id", "__text", "text", "__hits"), short, span, k).drop("text")

    def at(marks: str, n: int) -> Column:
        """(start, length, hash) of the windows whose fingerprint was hit."""
        here = F.filter(F.transform(F.col(marks), lambda m, i: F.struct(
            i.alias("pos"), F.array_contains("__hits", m).alias("hit"))), lambda x: x.hit)
        return F.transform(here, lambda x: F.struct(
            x.pos.alias("pos"), F.lit(n).alias("len"),
            F.xxhash64(*[F.get("ws", x.pos + j) for j in range(n)]).alias("window")))

    places = F.concat(at("marks", span), *[at(f"g{s}", s) for s in short])
    hits = close.select("doc_id", "__text", F.explode(places).alias("p")).select(
        "doc_id", "__text", "p.pos", "p.len", "p.window").join(windows, ["len", "window"])
    covered = F.array_distinct(F.flatten(F.transform(
        "spans", lambda s: F.sequence(s.pos, s.pos + s.len - 1))))
    result = hits.groupBy("doc_id", "__text").agg(
        F.collect_set(F.struct("pos", "len")).alias("spans"),
        F.array_sort(F.collect_set("item")).alias("__items")).select(
        F.col("doc_id").alias("__d"), F.col("__text").alias("__t"), "spans", "__items",
        F.size(covered).cast("long").alias("__n_hit"))
    joined = rows.join(result, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__text") == F.col("__t")), "left")
    none = F.array().cast("array<string>")
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(
        "doc_id", "n_words", F.coalesce("__n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("__items", none)).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("__items", none)), 256).alias("items_sha256"),
        F.col("__n_hit").isNotNull().alias("contaminated"), "spans", F.col("__text").alias("text_hash"))


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    bad = contamination(docs, items, **options).filter("contaminated").select(
        F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"))
    same = docs["doc_id"].eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"]) == F.col("__t"))
    return docs.join(bad, same, "left_anti")

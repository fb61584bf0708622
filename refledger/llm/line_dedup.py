"""Line deduplication within one word edit, by deletion neighbourhoods.

A line is its sequence of words (ASCII-lower-cased).  It is dropped where an earlier line of the corpus, by (doc_id,
line number), has the same words, or differs in one word put in, left out or exchanged while both have at least
``NEAR`` words.  Variants are the line without one of its words: an exchange at word i leaves equal variants at i, and
a word put in leaves the other line whole.  So equal keys, not pairs, tell a line's earliest partner; the edit
distance of that pair is then verified on the texts.

Variants are emitted only for lines with a possible partner: a single edit leaves the first or the second half of
the words as they were, so lines none of whose halves occur in another line have none.

Keys are 64-bit hashes.  Defined results: a null or empty text has no lines; lines without words are kept; repeated rows
of one id and text keep the same lines, as the same line is not earlier than itself; null ids come first;
without documents there are no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import (
    BASE, BASE_INVERSE, arrow_map, mixed, no_null_text, only, powers, range_hashes, sifted, sifted_out, split_words)
from refledger.session import cut_lineage

ship_by_value(__name__)

#: Lines of at least so many words may differ by one.
NEAR = 8


def line_words(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix sums, first word of each line, words of each line).  ``sums[k]`` adds word hash * BASE**k upto word k."""
    data, bounds, counts = split_words(no_null_text(pa.array(lines, pa.large_string())))
    h = range_hashes(data, bounds)
    first = np.cumsum(counts) - counts
    nth = np.arange(len(h)) - np.repeat(first, counts)
    by_place = powers(BASE, int(counts.max(initial=0)) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * by_place[nth])])
    return sums, first, counts


def piece(sums: np.ndarray, first: np.ndarray, lo: np.ndarray, hi: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Polynomial hash of words [lo, hi) of each line, as if they began at place 0."""
    return (sums[first + hi] - sums[first + lo]) * back[lo]


def named(value: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mixed(value + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)


def half_keys(sums: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys (line, 4) that lines within one edit share at least one of, for lines of at least NEAR words.

    For a pair with m words at most, the first h = m // 2 words or the last m - h words agree; a line may be the
    longer (m = n) or the shorter (m = n + 1) one.
    """
    back = powers(BASE_INVERSE, int(counts.max(initial=0)) + 2)
    out = []
    for longer in (0, 1):
        m = counts + longer
        h = np.minimum(m // 2, counts)
        zero = np.zeros_like(h)
        lo = np.maximum(counts - (m - h), 0)
        out.append(named(piece(sums, first, zero, h, back), m * 4))
        out.append(named(piece(sums, first, lo, counts, back), m * 4 + 1))
    return np.stack(out, 1)


def occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, no, line, n, keys): every line with words; keys only from NEAR words on."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = [(t or "").split("\n") for t in batch["text"].to_pylist()]
        flat = [x for part in lines for x in part]
        per = np.array([len(part) for part in lines], np.int64)
        row = np.repeat(np.arange(len(lines)), per)
        no = np.arange(len(flat)) - np.repeat(np.cumsum(per) - per, per)
        sums, first, counts = line_words(flat)
        back = powers(BASE_INVERSE, 1)
        zero = np.zeros_like(counts)
        name = named(piece(sums, first, zero, counts, back), counts) if len(flat) else np.zeros(0, np.int64)
        keys = half_keys(sums, first, counts) if len(flat) else np.zeros((0, 4), np.int64)
        use = np.flatnonzero(counts > 0)
        near = counts[use] >= NEAR
        lists = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(near * 4)]).astype(np.int32)), pa.array(keys[use][near].reshape(-1)))
        at = pa.array(row[use])
        return pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(at), batch["text_hash"].take(at), pa.array(no[use]), pa.array(name[use]),
             pa.array(counts[use].astype(np.int64)), lists],
            names=["doc_id", "text_hash", "no", "line", "n", "keys"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = only(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    return arrow_map(rows, cut, f"doc_id {kind}, text_hash long, no long, line long, n long, keys array<long>", rows=1024)


def variants(lines: DataFrame) -> DataFrame:
    """(left, i, n, line): the name of the line without its word i, for every word."""
    def emit(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums, first, counts = line_words(batch["words"].to_pylist())
        row = np.repeat(np.arange(len(counts)), counts)
        i = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        start, n = first[row], counts[row]
        left = sums[start + i] - sums[start] + (sums[start + n] - sums[start + i + 1]) * np.uint64(BASE_INVERSE)
        return pa.RecordBatch.from_arrays(
            [pa.array(named(left, n - 1)), pa.array(i), pa.array(n.astype(np.int64)), batch["line"].take(pa.array(row))],
            names=["left", "i", "n", "line"])

    return arrow_map(lines.select("line", "words"), emit, "left long, i long, n long, line long", rows=2048)


def one_edit(a: list[str], b: list[str]) -> bool:
    """True where the word sequences differ by at most one word put in, left out or exchanged."""
    if abs(len(a) - len(b)) > 1:
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest_a, rest_b = len(a) - same, len(b) - same
    if rest_a == rest_b:
        return a[same + 1:] == b[same + 1:]
    return a[same + 1:] == b[same:] if rest_a > rest_b else a[same:] == b[same + 1:]


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(line, partner): lines of which an earlier line is one edit away, with the earliest such line."""
    exploded = distinct.filter(F.col("n") >= NEAR).select("line", F.explode("keys").alias("key"))
    shared = cut_lineage(exploded.groupBy("key").agg(F.count("*").alias("__n")).filter("__n > 1").select(F.col("key").alias("__k")))
    hopeful = exploded.join(shared, F.col("key") == F.col("__k"), "left_semi").select(F.col("line").alias("__l")).distinct()
    chosen = cut_lineage(distinct.join(hopeful, F.col("line") == F.col("__l"), "left_semi").select("line", "n", "at"))
    # each line is read at its first place only, so these lines are shuffled, not the texts
    split = F.split("text", "\n", -1)
    places = only(docs, "doc_id", "text").select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split).alias("no", "words")).select(
        F.struct("doc_id", "text_hash", F.col("no").cast("long").alias("no")).alias("__place"), "words")
    picked = sifted(places, F.col("__place"), chosen, F.col("at")).join(chosen, F.col("__place") == F.col("at"))
    lines = cut_lineage(picked.select("line", "n", "words", "at").dropDuplicates(["line"]))

    place = lines.select(F.col("line").alias("__l"), "at")
    every = cut_lineage(variants(lines))
    # exchanges: lines of one length that agree without word i; a key's lines are all one edit apart
    dense = every.groupBy("left", "i", "n").agg(F.count("*").alias("__n")).filter("__n > 1").select(
        F.col("left").alias("__v"), F.col("i").alias("__i"), F.col("n").alias("__m"))
    meeting = every.join(dense, (F.col("left") == F.col("__v")) & (F.col("i") == F.col("__i")) & (F.col("n") == F.col("__m")),
                         "left_semi").join(place, F.col("line") == F.col("__l")).drop("__l")
    earliest = F.min(F.struct("at", "line"))
    heads = meeting.groupBy("left", "i", "n").agg(earliest.alias("first")).select(
        F.col("left").alias("__v"), F.col("i").alias("__i"), F.col("n").alias("__m"), "first")
    exchanged = meeting.join(heads, (F.col("left") == F.col("__v")) & (F.col("i") == F.col("__i")) & (F.col("n") == F.col("__m"))).select(
        "line", "at", "first").filter("first.at < at")
    # a word put in: the shorter line is a variant of the longer one
    short = lines.select(F.col("line").alias("__s"), F.col("at").alias("short_at"))
    pairs = every.select("left", "line").distinct().join(short, F.col("left") == F.col("__s")).join(
        place, F.col("line") == F.col("__l")).select("line", "at", "__s", "short_at")
    grown = pairs.filter("short_at < at").select("line", "at", F.struct(
        F.col("short_at").alias("at"), F.col("__s").alias("line")).alias("first"))
    shrunk = pairs.filter("at < short_at").select(F.col("__s").alias("line"), F.col("short_at").alias("__at"), F.struct(
        F.col("at").alias("at"), F.col("line").alias("line")).alias("first")).withColumnRenamed("__at", "at")
    best = exchanged.unionByName(grown).unionByName(shrunk).groupBy("line").agg(F.min("first").alias("first"))
    best = best.select("line", F.col("first.line").alias("partner"))

    def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = [one_edit(a.encode().lower().split(), b.encode().lower().split())
              for a, b in zip(batch["words"].to_pylist(), batch["partner_words"].to_pylist())]
        return pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok, pa.bool_())) for c in ("line", "partner")],
                                          names=["line", "partner"])

    own = lines.select(F.col("line").alias("__a"), "words")
    other = lines.select(F.col("line").alias("__b"), F.col("words").alias("partner_words"))
    checked = best.join(own, F.col("line") == F.col("__a")).join(other, F.col("partner") == F.col("__b"))
    return arrow_map(checked.select("line", "partner", "words", "partner_words"), verify, "line long, partner long")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` cut to the kept lines, n_lines, n_dropped."""
    found = cut_lineage(occurrences(docs))
    at = F.struct("doc_id", "text_hash", "no")
    distinct = cut_lineage(found.groupBy("line").agg(
        F.min(at).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    near = near_lines(docs, distinct).select(F.col("line").alias("__x"))
    known = cut_lineage(distinct.join(near, F.col("line") == F.col("__x"), "left").select(
        F.col("line").alias("__l"), F.col("at").alias("__first"), F.col("__x").isNotNull().alias("__near")))
    gone = found.join(known, F.col("line") == F.col("__l")).filter(F.col("__near") | (F.col("__first") < at))
    per_text = cut_lineage(gone.groupBy(F.struct("doc_id", "text_hash").alias("__d")).agg(
        F.collect_set("no").alias("__gone")))  # at most the lines of one text
    # only texts that lose lines are shuffled; a key of a null id equals its like
    key = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    keyed = docs.withColumn("__key", key)
    rows = sifted(keyed, F.col("__key"), per_text, F.col("__d")).join(per_text, F.col("__key") == F.col("__d"), "left").drop(
        "__key", "__d").unionByName(sifted_out(keyed, F.col("__key"), per_text, F.col("__d")).drop("__key").withColumn(
            "__gone", F.lit(None).cast("array<bigint>")))
    lines = F.split("text", "\n", -1)
    rows = rows.withColumn("__all", F.when(F.length("text") > 0, lines).otherwise(F.array().cast("array<string>")))
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        "__all", lambda x, i: ~F.array_contains("__gone", i.cast("long"))), "\n"))
    changed = {"text": kept}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns],
                       F.size("__all").cast("long").alias("n_lines"),
                       F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))

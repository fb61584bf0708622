"""Quality classifier from weak labels.

Heuristic labellers look at a text (symbols, capitals, repetition, markup, ...) and vote good, bad or abstain; a second set
votes on toxicity (annotations where a document has them, insults, terms that annotated toxic documents share).
Expectation-maximisation over the counts of vote patterns of all documents estimates how each labeller votes
given the hidden class, without trusting any of them.  The posterior labels of a bounded sample train a hashed
linear scorer (words, word beginnings, binned measures), which scores every document; the labels of a
document are never inputs of its score.

``SAMPLE``: documents the scorer is fitted on, ``ANNOTATED`` of them from the annotated ones if there are as many
(smallest hashes first, whole texts).

Defined results: a null or empty text, or one without words, has no measures and is rejected (score 0); repeated rows are
separate rows with equal scores; several annotations of one document count as their maximum; annotations may
be missing, and null ones abstain; without documents there are no rows; other columns are kept by ``accepted``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import arrow_map, hash_share, no_null_text, only, pieces, range_hashes, split_words
from refledger.session import cut_lineage

ship_by_value(__name__)

SAMPLE, ANNOTATED = 16000, 12000
#: Bytes of text that are turned into arrays at once: these take some fifty times as much.
AT_ONCE = 500_000
BITS = 22
#: Lengths of word beginnings that are features beside the whole word.
STEMS = (4, 5, 6)
#: Common English insults; the terms of other languages come from the annotations.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown")

#: measure -> (name, bad from, good upto); a measure in between abstains.  Negated measures are bad when low.
MEASURES = [("symbols", 0.10, 0.06), ("capitals", 0.30, 0.15), ("marked_words", 0.25, 0.08), ("shouts", 0.30, 0.05),
            ("markup", 0.02, 0.002), ("repeated_words", 0.65, 0.45), ("repeated_pairs", 0.50, 0.25),
            ("wordless", 0.25, 0.08), ("few_words", 0.9, 0.5)]
EDGES = np.array([0.002, 0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


PROSE = byte_class(".,;:'\"()-?")
MARKUP = byte_class("|<>{}[]#*%$&=\\~^_@")
LOWER = byte_class("abcdefghijklmnopqrstuvwxyz")
UPPER = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
DIGIT = byte_class("0123456789")
BLANK = byte_class(" \t\n\v\f\r")


@dataclass
class Texts:
    """A batch of texts as arrays: measures by row, distinct words, and the distinct words of each row."""
    n_words: np.ndarray
    measures: np.ndarray
    word_hash: np.ndarray
    stems: np.ndarray
    pair_row: np.ndarray
    pair_word: np.ndarray


def read(column: pa.Array) -> Texts:
    """A batch, read in parts of ``AT_ONCE`` bytes; what comes out is the same as in one part."""
    parts, before = [], None
    for part in pieces(pa.RecordBatch.from_arrays([column], names=["text"]), 4096, AT_ONCE):
        t, before = read_part(part["text"], before)
        parts.append(t)
    if len(parts) < 2:
        return parts[0] if parts else read_part(column, None)[0]
    word_hash, first, same = np.unique(np.concatenate([t.word_hash for t in parts]), return_index=True, return_inverse=True)
    rows = np.cumsum([0, *[len(t.n_words) for t in parts]])
    words = np.cumsum([0, *[len(t.word_hash) for t in parts]])
    # words are in the order of their hashes in each part as in all, so the pairs stay in order
    return Texts(np.concatenate([t.n_words for t in parts]), np.concatenate([t.measures for t in parts]), word_hash,
                 np.concatenate([t.stems for t in parts])[first],
                 np.concatenate([t.pair_row + lo for t, lo in zip(parts, rows)]),
                 np.concatenate([same[lo + t.pair_word] for t, lo in zip(parts, words)]))


def read_part(column: pa.Array, before: np.uint64 | None) -> tuple[Texts, np.uint64 | None]:
    """``before``: hash of the last word of the parts before; comes back as that of this one."""
    text = no_null_text(column)
    rows = len(text)
    data, bounds, counts = split_words(text)
    raw = np.frombuffer(text.buffers()[2], np.uint8)[:len(data)] if len(data) else data
    sizes = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[ends] - total[ends - sizes]).astype(float)

    upper, letters = UPPER[raw], (LOWER | UPPER)[raw] | (raw >= 128)
    alnum = letters | DIGIT[raw]
    solid = per_row(~BLANK[raw])
    symbol = ~(alnum | BLANK[raw] | PROSE[raw])
    row_of = np.repeat(np.arange(rows), counts)
    n = np.maximum(counts, 1)
    last = raw[bounds[:, 1] - 1] if len(bounds) else np.zeros(0, np.uint8)
    marked = np.bincount(row_of, symbol[bounds[:, 1] - 1] if len(bounds) else None, rows) if len(bounds) else np.zeros(rows)
    shouts = np.bincount(row_of, last == 33, rows) if len(bounds) else np.zeros(rows)
    seen = np.concatenate([[0], np.cumsum(alnum)])
    wordless = np.bincount(row_of, seen[bounds[:, 1]] == seen[bounds[:, 0]], rows) if len(bounds) else np.zeros(rows)
    # letters and digits only, so that a word is the same before a comma, a full stop or a bracket
    trimmed = trim(bounds, alnum)
    hashes = range_hashes(data, trimmed)
    word_hash, first, same = np.unique(hashes, return_index=True, return_inverse=True)
    pairs = np.unique(row_of * max(1, len(word_hash)) + same)
    pair_row, pair_word = pairs // max(1, len(word_hash)), pairs % max(1, len(word_hash))
    # distinct (row, word, next word); a batch is small enough for the product to fit 63 bits
    base = len(word_hash) + 1
    square = base ** 2
    ahead = same[:-1]
    if before is not None and len(same):
        at = np.searchsorted(word_hash, before)
        known = at < len(word_hash) and word_hash[at] == before
        ahead = np.concatenate([[at if known else len(word_hash)], ahead])
    n_pairs = len(ahead)
    follow = np.unique(row_of[len(same) - n_pairs:] * square + ahead * base + same[len(same) - n_pairs:])
    inside = np.bincount(follow // max(1, square), minlength=rows)
    distinct = np.bincount(pair_row, minlength=rows)
    enough = counts >= 30
    measures = np.stack([
        per_row(symbol) / np.maximum(solid, 1), per_row(upper) / np.maximum(per_row(letters), 1), marked / n, shouts / n,
        per_row(MARKUP[raw]) / np.maximum(solid, 1), np.where(enough, 1 - distinct / n, 0.44),
        np.where(enough, np.maximum(0, 1 - (inside + 1) / n), 0.24), wordless / n, 1 / n], 1)
    spans = trimmed[first]
    stems = np.stack([range_hashes(data, np.stack([spans[:, 0], np.minimum(spans[:, 0] + s, spans[:, 1])], 1))
                      ^ np.uint64(s) for s in STEMS], 1) if len(first) else np.zeros((0, len(STEMS)), np.uint64)
    return Texts(counts, measures, word_hash, stems, pair_row, pair_word), hashes[-1] if len(hashes) else before


def trim(bounds: np.ndarray, solid: np.ndarray) -> np.ndarray:
    """Byte ranges from the first to the last solid byte; ranges without any stay as they are."""
    if not len(bounds):
        return bounds
    size = len(solid)
    at = np.where(solid, np.arange(size), size)
    following = np.minimum.accumulate(at[::-1])[::-1][bounds[:, 0]]
    back = np.maximum.accumulate(np.where(solid, np.arange(size), -1))[bounds[:, 1] - 1] + 1
    ok = following < bounds[:, 1]
    return np.where(ok[:, None], np.stack([following, back], 1), bounds)


def slots(t: Texts) -> np.ndarray:
    """Feature slots of each distinct word: the word and its beginnings."""
    every = np.concatenate([t.word_hash[:, None], t.stems], 1)
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


def bin_slots(t: Texts) -> np.ndarray:
    """Slots of the binned measures, by row, behind the hashed ones."""
    return (1 << BITS) + np.arange(len(MEASURES)) * (len(EDGES) + 1) + np.searchsorted(EDGES, t.measures, side="right")


WIDTH = (1 << BITS) + len(MEASURES) * (len(EDGES) + 1)


def votes(t: Texts) -> np.ndarray:
    """-1 bad, 1 good, 0 abstains; by row and labeller.

    The absence of one fault says little, so each measure votes bad or abstains; the last labeller votes good
    where every measure is low.
    """
    bad = np.array([m[1] for m in MEASURES])
    good = np.array([m[2] for m in MEASURES])
    sound = (t.measures <= good).all(1)
    return np.concatenate([-(t.measures >= bad).astype(np.int8), sound.astype(np.int8)[:, None]], 1)


LABELLERS = len(MEASURES) + 1


def row_features(t: Texts, rows: int) -> list[np.ndarray]:
    words = slots(t)
    cut = np.searchsorted(t.pair_row, np.arange(rows + 1))
    bins = bin_slots(t)
    return [np.concatenate([words[t.pair_word[a:b]].reshape(-1), bins[i]]).astype(np.int32)
            for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]


# --- weak labels -----------------------------------------------------------------------------------

def estimate(patterns: np.ndarray, n: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, float]:
    """EM for one hidden class.  Returns the labellers' tables [labeller, class (0 good, 1 bad), vote + 1] and the
    share of class 1.  Starts from labellers that are right in three of four votes."""
    labellers = patterns.shape[1]
    table = np.tile(np.array([[0.15, 0.2, 0.65], [0.65, 0.2, 0.15]]), (labellers, 1, 1))
    for _ in range(rounds):
        p = posterior(patterns, table, prior)
        prior = float(np.clip((p * n).sum() / max(n.sum(), 1), 1e-4, 0.5))
        for y, weight in enumerate(((1 - p) * n, p * n)):
            for v in (-1, 0, 1):
                # the smoothing keeps -1 a sign of class 1 where the data say nothing
                table[:, y, v + 1] = ((patterns == v) * weight[:, None]).sum(0) + (2.0 if (v == -1) == (y == 1) else 0.5)
            table[:, y] /= table[:, y].sum(1, keepdims=True)
    return table, prior


def posterior(patterns: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """Probability of class 1 given the votes."""
    logs = np.log(table)
    index = np.arange(patterns.shape[1])
    good = np.log(1 - prior) + logs[index, 0, patterns + 1].sum(1)
    bad = np.log(prior) + logs[index, 1, patterns + 1].sum(1)
    return 1 / (1 + np.exp(np.clip(good - bad, -500, 500)))


def packed(v: np.ndarray) -> np.ndarray:
    """Vote rows as base-3 numbers, the keys that Spark counts (at most 3**labellers of them)."""
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def unpacked(keys: np.ndarray, labellers: int) -> np.ndarray:
    return (keys[:, None] // 3 ** np.arange(labellers)) % 3 - 1


def shared_terms(rows: DataFrame, weight: str) -> np.ndarray:
    """Word slots that the rows of class 1 have and others hardly ever: at least 4 rows and 20 times the share.

    ``weight`` says how far a row of ``rows`` (features, ...) belongs to class 1 (0 to 1, null: unknown).  Spark counts
    in millionths, so that sums do not depend on their order; what comes back are the chosen slots.
    """
    known = rows.filter(F.col(weight).isNotNull()).select("features", F.round(F.col(weight) * 1e6).cast("long").alias("yes"))
    sums = known.agg(F.sum("yes"), F.count("*")).first()
    n_yes, n_no = max(1.0, (sums[0] or 0) / 1e6), max(1.0, sums[1] - (sums[0] or 0) / 1e6)
    words = F.array_distinct(F.filter("features", lambda f: f < (1 << BITS)))
    of_slot = known.select("yes", F.explode(words).alias("slot")).groupBy("slot").agg(
        (F.sum("yes") / 1e6).alias("yes"), (F.sum(1_000_000 - F.col("yes")) / 1e6).alias("no"))
    chosen = of_slot.filter((F.col("yes") >= 4) & ((F.col("yes") + 0.1) / n_yes > 20 * (F.col("no") + 0.5) / n_no))
    out = np.zeros(WIDTH, bool)
    out[chosen.select("slot").toArrow()["slot"].to_numpy()] = True
    return out


def insult_slots() -> np.ndarray:
    data, bounds, _ = split_words(pa.array(list(INSULTS), pa.large_string()))
    out = np.zeros(WIDTH, bool)
    out[(range_hashes(data, bounds) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return out


def toxic_votes(hit_terms: np.ndarray, hit_insults: np.ndarray, annotation: np.ndarray) -> np.ndarray:
    """-1 toxic, 1 not, 0 abstains."""
    noted = np.where(annotation < 0, 0, np.where(annotation == 1, -1, 1))
    return np.stack([np.where(hit_terms, -1, 1), np.where(hit_insults, -1, 0), noted], 1)


# --- scorer ----------------------------------------------------------------------------------------

def fit(features: list[np.ndarray], target: np.ndarray, used: np.ndarray, epochs: int = 12, size: int = 256,
        rate: float = 0.3, decay: float = 1e-5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with adaptive steps; classes weigh the same, slots not ``used`` nothing."""
    places = np.flatnonzero(used)
    features = [np.searchsorted(places, f[used[f]]) for f in features]
    width = len(places)
    w, bias, seen = np.zeros(width), 0.0, np.full(width, 1e-6)
    rng = np.random.default_rng(seed)
    share = float(np.clip(target.mean(), 0.02, 0.98)) if len(target) else 0.5
    weight = np.where(target > 0.5, 0.5 / share, 0.5 / (1 - share))
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for lo in range(0, len(order), size):
            part = order[lo:lo + size]
            flat = np.concatenate([features[i] for i in part])
            row = np.repeat(np.arange(len(part)), [len(features[i]) for i in part])
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(part)) + bias, -30, 30)))
            g = (p - target[part]) * weight[part] / len(part)
            grad = np.bincount(flat, g[row], width)
            seen += grad * grad
            touched = np.flatnonzero(grad)
            w[touched] -= rate * (grad[touched] / np.sqrt(seen[touched]) + decay * w[touched])
            bias -= rate * 0.1 * g.sum()
    out = np.zeros(WIDTH, np.float32)
    out[places] = w
    return out, bias


@dataclass
class Scorer:
    """Weights and biases of the two heads (low quality, toxic), and what the labellers were found to do."""
    weights: np.ndarray
    bias: np.ndarray
    quality_table: np.ndarray
    toxic_table: np.ndarray


def sampled(docs: DataFrame, labels: DataFrame, sample: int, annotated: int) -> DataFrame:
    """(h, th, features, votes, toxic) of the sample's documents, toxic -1 where nothing is known; stays in Spark."""
    # both sides are cut by the hash of the id before they meet, so only about the sample's texts are moved
    texts = only(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    notes = only(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL")
    n_docs, n_notes = max(1, texts.count()), max(1, notes.select("doc_id").distinct().count())
    share_noted = 1.2 * annotated / n_notes
    share_rest = 1.2 * (sample - annotated) / max(1, n_docs - n_notes, n_docs // 10)

    def within(share: float) -> tuple[DataFrame, DataFrame]:
        near = notes.filter(hash_share(F.col("doc_id"), share)).groupBy(F.col("doc_id").alias("__d")).agg(
            F.max("toxic").alias("toxic"))
        return texts.filter(hash_share(F.col("doc_id"), share)).withColumns(
            {"h": F.xxhash64("doc_id"), "th": F.xxhash64("text")}), near

    def first(rows: DataFrame, most: int) -> DataFrame:
        """The rows with the smallest hashes; only hashes are sorted, the texts stay in their tasks."""
        rows = rows.select("h", "th", "text", F.col("toxic").cast("long").alias("toxic"))
        key = F.struct("h", "th")
        last = rows.select("h", "th").distinct().orderBy("h", "th").limit(most).agg(F.max(key).alias("m")).first()["m"]
        if last is None:
            return rows.filter("false")
        cut = F.struct(F.lit(last["h"]).alias("h"), F.lit(last["th"]).alias("th"))
        return rows.filter(key <= cut).dropDuplicates(["h", "th"])

    rows, near = within(share_noted)
    noted = first(rows.join(near, F.col("doc_id") == F.col("__d")).filter("toxic IS NOT NULL"), annotated)
    rows, near = within(share_rest)
    rest = first(rows.join(near, F.col("doc_id") == F.col("__d"), "left").filter("toxic IS NULL"), sample - annotated)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = read(batch["text"])
        return pa.RecordBatch.from_arrays(
            [batch["h"], batch["th"], pa.array(row_features(t, batch.num_rows), pa.list_(pa.int32())), pa.array(packed(votes(t)), pa.int64()),
             batch["toxic"].fill_null(-1)], names=["h", "th", "features", "votes", "toxic"])

    return arrow_map(noted.unionByName(rest), features, "h long, th long, features array<int>, votes long, toxic long")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, annotated: int = ANNOTATED) -> Scorer | None:
    """None where there is no document.

    The sample's features stay in Spark, which counts how often classes have a slot; the driver gets a few numbers a
    document and, of the features, those in slots that a head uses.
    """
    rows = cut_lineage(sampled(docs, labels, sample, annotated))
    if rows.isEmpty():
        return None
    context = docs.sparkSession.sparkContext
    terms = shared_terms(rows.withColumn("w", F.when(F.col("toxic") >= 0, F.col("toxic"))), "w")
    insults = insult_slots()
    sent = context.broadcast((terms, insults))  # fixed size

    def patterns(batch: pa.RecordBatch) -> pa.RecordBatch:
        known_terms, known_insults = sent.value
        t = read(batch["text"])
        words = slots(t)
        hit = [np.bincount(t.pair_row, known[words].any(1)[t.pair_word], batch.num_rows) > 0
               for known in (known_terms, known_insults)]
        toxic = np.where(hit[0], 1, 0) + np.where(hit[1], 2, 0)
        keys, n = np.unique(packed(votes(t)) * 4 + toxic, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    every = arrow_map(only(docs, "text"), patterns, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = every["key"].to_numpy(), every["n"].to_numpy().astype(float)
    table, prior = estimate(unpacked(keys // 4, LABELLERS), n, 0.2)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        """What the votes on toxicity see of a row: 1 a shared term, 2 an insult."""
        flat, size = batch["features"].flatten().to_numpy(), batch["features"].value_lengths().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        hit = [np.bincount(row, known[flat] & (flat < (1 << BITS)), len(size)) > 0 for known in sent.value]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit[0] + 2 * hit[1], pa.int64())], names=[*batch.schema.names, "hit"])

    rows = cut_lineage(arrow_map(rows, found, "h long, th long, features array<int>, votes long, toxic long, hit long"))
    few = rows.groupBy("votes", "toxic", "hit").agg(F.count("*").alias("n")).toArrow()  # bounded by the sample's rows
    kind, noted, code, times = (few[c].to_numpy() for c in ("votes", "toxic", "hit", "n"))
    bad = posterior(unpacked(kind, LABELLERS), table, prior)
    # all documents by their terms and insults, the sample also by its annotations
    corpus = toxic_votes(keys % 4 % 2 == 1, keys % 4 // 2 == 1, np.full(len(keys), -1))
    own = toxic_votes(code % 2 == 1, code // 2 == 1, noted)
    t_table, t_prior = estimate(np.concatenate([corpus, own]), np.concatenate([n, times.astype(float)]), 0.1)
    toxic = posterior(own, t_table, t_prior)

    of_kind = docs.sparkSession.createDataFrame(
        pa.table({"votes": kind, "toxic": noted, "hit": code, "bad": bad, "harm": toxic, "harmful": np.round(toxic)}))
    marked = rows.join(F.broadcast(of_kind), ["votes", "toxic", "hit"])
    # low quality shows in the measures and in words of their own kind; toxicity in terms alone
    used = [(np.arange(WIDTH) >= (1 << BITS)) | shared_terms(marked, "bad"), insults | shared_terms(marked, "harmful")]
    slim = context.broadcast(used[0] | used[1])

    def needed(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [f[slim.value[f]] for f in (x.values.to_numpy() for x in batch["features"])]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(kept, pa.list_(pa.int32()))], names=["h", "th", "bad", "harm", "features"])

    got = arrow_map(marked.select("h", "th", "bad", "harm", "features"), needed, "h long, th long, bad double, harm double, features array<int>").toArrow()
    got = got.sort_by([("h", "ascending"), ("th", "ascending")])
    features = [x.values.to_numpy() for x in got["features"]]
    heads = [fit(features, got[c].to_numpy(), u) for c, u in zip(("bad", "harm"), used)]
    return Scorer(np.stack([h[0] for h in heads], 1), np.array([h[1] for h in heads]), table, t_table)


def weights_at(places: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rows of ``weights`` at the wanted slots; ``places`` are their slots in order, others weigh nothing."""
    if not len(places):
        return np.zeros((*wanted.shape, weights.shape[1]), weights.dtype)
    at = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
    return np.where((places[at] == wanted)[..., None], weights[at], weights.dtype.type(0))


def score(docs: DataFrame, scorer: Scorer | None) -> DataFrame:
    """``docs`` as struct ``row`` beside p_low, p_toxic and ``accepted`` (neither above one half)."""
    # few slots have weights, and only those are sent
    places = np.flatnonzero(scorer.weights.any(1)) if scorer else None
    sent = docs.sparkSession.sparkContext.broadcast(scorer and (places, scorer.weights[places], scorer.bias))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = sent.value
        rows = batch.num_rows
        t = read(pa.compute.struct_field(batch["row"], "text"))
        z = np.zeros((rows, 2))
        if known is not None and rows:
            places, weights, bias = known
            # each distinct word brings its slots once
            of_word = weights_at(places, weights, slots(t)).sum(1)
            z = weights_at(places, weights, bin_slots(t)).sum(1) + bias
            for head in (0, 1):
                z[:, head] += np.bincount(t.pair_row, of_word[t.pair_word, head], rows)
        p = np.where((t.n_words > 0)[:, None], 1 / (1 + np.exp(-np.clip(z, -500, 500))), [[1.0, 0.0]])
        more = [pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p <= 0.5).all(1))]
        return pa.RecordBatch.from_arrays([batch["row"], *more], names=["row", "p_low", "p_toxic", "accepted"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scores = T.StructType([*rows.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("p_low", "p_toxic")],
                           T.StructField("accepted", T.BooleanType())])
    return arrow_map(rows, judge, scores)


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score (of being good), p_low, p_toxic, accepted of every document."""
    scored = score(only(docs, "doc_id", "text"), learn(docs, labels, **options))
    return scored.select("row.doc_id", ((1 - F.col("p_low")) * (1 - F.col("p_toxic"))).alias("score"), "p_low", "p_toxic",
                         "accepted")


def accepted(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    return score(docs, learn(docs, labels, **options)).filter("accepted").select(*[F.col(f"row.`{c}`") for c in docs.columns])

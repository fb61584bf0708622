"""Near-duplicate join: grouped prefix join on word shingles, with exact verification.

A document's set is its distinct ``words``-word shingles (fewer words: the whole sequence as one).  Two sets link
when 100 * intersection >= 75 * union.  Shingles are put in one global order, rare ones first (a bounded
count sketch of the corpus supplies the frequencies; any order gives right results, a good one gives few
candidates).  Linked sets must share a shingle among the first 25 % of the larger and 14.3 % of the smaller
in that order (prefix rule).

* Documents with equal sets are one node, nodes with equal size and prefix are one group; postings hold groups.
* Every group is first paired with one representative per shared shingle (the group that reaches the shingle
  earliest), which is linear in the postings, and the members are verified on their texts.
* Pairs of a posting whose ends are still in different components are then joined under the prefix, size and
  position rules, expanded to members and verified.  Pairs inside one component can't change the result, so the
  dense inside of a large group of copies is never enumerated.

Postings of a shingle that the sketch calls frequent take an aggregation and a splittable join; the others are
bounded by that frequency.  Shingles and sets are compared by 64-bit hashes.

Defined results: null, empty and blank texts have the empty set and link with nothing; a document without id links
and is counted, and ids of a component are compared without it; repeated rows are separate rows of one node;
without documents there are no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import BASE, arrow_map, mixed, no_null_text, only, pieces, range_hashes, sifted, split_words
from refledger.llm.components import components
from refledger.session import cut_lineage

ship_by_value(__name__)

WORDS = 5
#: Similarity as a fraction; sizes of an overlap follow from NUM / DEN in whole numbers.
NUM, DEN = 3, 4
#: Counters of the frequency sketch, counters per row of it, and the count from which a shingle is frequent.
SKETCH_BITS, SLAB, FREQUENT = 22, 1 << 13, 4096


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, sorted by row."""
    data, bounds, counts = split_words(no_null_text(column))
    words = range_hashes(data, bounds)
    first = np.cumsum(counts) - counts
    long = np.maximum(counts - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), long)
    at = np.repeat(first, long) + np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long)
    h = np.zeros(len(at), np.uint64)
    for j in range(n):
        h = h * np.uint64(BASE) + words[at + j] if len(at) else h
    h = mixed(h)
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):  # the whole sequence, told apart by its length
        short = np.zeros(len(few), np.uint64)
        for j in range(n - 1):
            has = counts[few] > j
            short[has] = short[has] * np.uint64(BASE) + words[first[few[has]] + j]
        row, h = np.concatenate([row, few]), np.concatenate([h, mixed(short + counts[few].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def frequency_sketch(docs: DataFrame, n: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each bucket of shingle hashes, in how many documents its shingles occur (saturating at 65535, and
    at 255 within a task).

    Tasks add up their own buckets and emit slabs of counters; slabs are added by a streaming sum.  The result
    has a fixed size, whatever the corpus.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, any_row = np.zeros(1 << bits, np.uint16), False
        for batch in batches:
            for part in pieces(batch, 1024):
                _, h = shingles(part["text"], n)
                buckets, more = np.unique(h >> np.uint64(64 - bits), return_counts=True)
                at = buckets.astype(np.int64)
                mine[at] = np.minimum(mine[at] + more, 65535)
                any_row = any_row or len(at) > 0
        if any_row:
            slabs = mine.reshape(-1, SLAB)
            for lo in range(0, len(slabs), 64):
                part = slabs[lo:lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(lo, lo + len(part))),
                     pa.array([np.minimum(s, 255).astype(np.uint8).tobytes() for s in part], pa.binary())],
                    names=["slab", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slab, raw in zip(batch["slab"].to_pylist(), batch["counts"].to_pylist()):
                part = np.frombuffer(raw, np.uint8).astype(np.uint32)
                sums[slab] = sums[slab] + part if slab in sums else part
        for slab, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([slab]), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())],
                names=["slab", "counts"])

    spark = docs.sparkSession
    parts = only(docs, "text").mapInArrow(count, "slab long, counts binary")
    sums = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slab").mapInArrow(add, "slab long, counts binary")
    out = np.zeros((1 << bits) // SLAB * SLAB, np.uint16).reshape(-1, SLAB)
    for slab, raw in sums.collect():
        out[slab] = np.frombuffer(raw, np.uint16)
    return out.reshape(-1)


def prefixed(docs: DataFrame, n: int, sketch: np.ndarray, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, size, node (hash of the set), grp (hash of size and prefix), prefix (shingles in global order), n_rare
    (the shingles of the prefix before the first whose sketch count reaches ``FREQUENT``)."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        row, h = shingles(batch["text"], n)
        size = np.bincount(row, minlength=rows)
        starts = np.cumsum(size) - size
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(MARK)))])
            node = mixed(total[starts + size] - total[starts] + size.astype(np.uint64))
        count = sent.value[(h >> np.uint64(64 - bits)).astype(np.int64)]
        order = np.lexsort((h, count, row))
        h, count = h[order], count[order]
        length = np.where(size > 0, size - (NUM * size + DEN - 1) // DEN + 1, 0)
        keep = np.arange(len(h)) - starts[row] < length[row]
        h, count = h[keep], count[keep]
        ends = np.cumsum(length)
        with np.errstate(over="ignore"):
            place = (np.arange(len(h)) - np.repeat(ends - length, length)).astype(np.uint64)
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h + place * np.uint64(BASE)))])
            grp = mixed(total[ends] - total[ends - length] + size.astype(np.uint64) * np.uint64(MARK))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(size.astype(np.int64)), pa.array(node.view(np.int64)), pa.array(grp.view(np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(h.view(np.int64))),
            pa.array(np.bincount(row[keep], count < FREQUENT, rows).astype(np.int64))],
            names=["doc_id", "size", "node", "grp", "prefix", "n_rare"])

    kind = dict(docs.dtypes)["doc_id"]
    return arrow_map(only(docs, "doc_id", "text"), build,
                     f"doc_id {kind}, size long, node long, grp long, prefix array<long>, n_rare long", rows=2048)


MARK = 0xD6E8FEB86659FD93


def least_overlap(a: Column, b: Column) -> Column:
    """Smallest intersection of two sets of these sizes that link: ceil(NUM (a + b) / (NUM + DEN))."""
    return F.floor((NUM * (a + b) + NUM + DEN - 1) / (NUM + DEN))


def may_link(size: Column, pos: Column, other: Column, other_pos: Column) -> Column:
    """Size and position rules for a pair that shares a shingle at these places (from 0)."""
    sizes = (DEN * F.least(size, other) >= NUM * F.greatest(size, other))
    return sizes & (1 + F.least(size - pos, other - other_pos) - 1 >= least_overlap(size, other))


def postings(made: DataFrame) -> DataFrame:
    """(token, grp, size, pos, rep, rep_size, rep_pos) of tokens that more than one group has.

    The representative of a token is the group in which it stands earliest.  ``made`` may hold a group several times.
    """
    def spelled(groups: DataFrame) -> DataFrame:
        return groups.select("grp", "size", "n_rare", F.posexplode("prefix").alias("pos", "token")).select(
            "token", "grp", "size", F.col("pos").cast("long").alias("pos"), (F.col("pos") >= F.col("n_rare")).alias("frequent"))

    each = spelled(made.groupBy("grp").agg(*[F.first(c).alias(c) for c in ("size", "prefix", "n_rare")]))
    first = F.struct("pos", "size", "grp")
    w = Window.partitionBy("token")  # at most FREQUENT rows share a token here
    rare = each.filter("NOT frequent").withColumn("__n", F.count("*").over(w)).filter("__n > 1").withColumn(
        "rep", F.min(first).over(w)).drop("__n", "frequent")
    often = each.filter("frequent").drop("frequent")
    # copies of a group don't change who is first, so the prefixes need not be shuffled to find that
    heads = spelled(made).filter("frequent").groupBy("token").agg(
        F.min(first).alias("rep"), F.min("grp").alias("__lo"), F.max("grp").alias("__hi")).filter("__lo <> __hi").select("token", "rep")
    spread = often.join(cut_lineage(heads).withColumnRenamed("token", "__t"), F.col("token") == F.col("__t")).drop("__t")
    return cut_lineage(rare.unionByName(spread).select(
        "token", "grp", "size", "pos", F.col("rep.grp").alias("rep"), F.col("rep.size").alias("rep_size"),
        F.col("rep.pos").alias("rep_pos")))


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """Pairs of nodes (a, b) whose sets link.  ``texts`` has one text per node that occurs in ``pairs``."""
    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        if batch.num_rows:
            ra, ha = shingles(batch["text_a"], n)
            rb, hb = shingles(batch["text_b"], n)
            ca, cb = np.bincount(ra, minlength=batch.num_rows), np.bincount(rb, minlength=batch.num_rows)
            # shingles of both sides of a row, sorted: an equal neighbour is a shared one
            row, h = np.concatenate([ra, rb]), np.concatenate([ha, hb])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            same = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
            both = np.bincount(row[1:][same], minlength=batch.num_rows)
            keep = (both > 0) & (DEN * both >= NUM * (ca + cb - both))
        return pa.RecordBatch.from_arrays(
            [batch["a"].filter(pa.array(keep)), batch["b"].filter(pa.array(keep))], names=["a", "b"])

    a = texts.select(F.col("node").alias("__a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("__b"), F.col("text").alias("text_b"))
    joined = pairs.join(b, F.col("b") == F.col("__b")).drop("__b").join(a, F.col("a") == F.col("__a")).drop("__a")
    return arrow_map(joined.select("a", "b", "text_a", "text_b"), check, "a long, b long", rows=256)


def near_duplicates(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies of every row."""
    # the prefixes are made again for the groups: a second pass over the texts costs less than keeping them for all rows
    made = prefixed(docs, n, frequency_sketch(docs, n))
    rows = cut_lineage(made.select("doc_id", "size", "node", "grp"))
    real = rows.filter("size > 0")
    nodes = cut_lineage(real.groupBy("node").agg(F.first("grp").alias("grp"), F.first("size").alias("size"),
                                                 F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies")))
    heads = nodes.groupBy("grp").agg(F.min("node").alias("head"), F.count("*").alias("members"))
    posts = postings(made.filter("size > 0"))

    def expanded(pairs: DataFrame) -> DataFrame:
        """Pairs of groups (g, h) to pairs of a group's first node and every member of the other."""
        head = heads.select(F.col("grp").alias("__g"), F.col("head").alias("a"))
        member = nodes.select(F.col("grp").alias("__h"), F.col("node").alias("b"))
        return pairs.join(head, F.col("g") == F.col("__g")).join(member, F.col("h") == F.col("__h")).select("a", "b")

    stars = posts.filter((F.col("grp") != F.col("rep")) & may_link(
        F.col("size"), F.col("pos"), F.col("rep_size"), F.col("rep_pos"))).select(
        F.col("rep").alias("g"), F.col("grp").alias("h")).distinct()
    inside = heads.filter("members > 1").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    pairs = cut_lineage(expanded(stars.unionByName(inside)).filter("a <> b"))

    links = cut_lineage(verified(pairs, texts_of_nodes(docs, nodes, pairs, n), n))
    first = cut_lineage(components(links))

    root = first.select(F.col("node").alias("__n"), F.col("root"))
    placed = nodes.join(root, F.col("node") == F.col("__n"), "left").select(
        "node", "grp", "size", F.coalesce("root", "node").alias("root"))
    span = placed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).withColumnRenamed("grp", "__g")
    rooted = posts.join(span, F.col("grp") == F.col("__g")).drop("__g")
    open_tokens = rooted.groupBy("token").agg(F.min("lo").alias("__lo"), F.max("hi").alias("__hi")).filter("__lo <> __hi")
    left = cut_lineage(rooted.join(open_tokens.select(F.col("token").alias("__t")), F.col("token") == F.col("__t"), "left_semi"))
    x = left.select("token", F.col("grp").alias("g"), F.col("size").alias("gs"), F.col("pos").alias("gp"),
                    F.col("lo").alias("glo"), F.col("hi").alias("ghi"))
    y = left.select(F.col("token").alias("__t"), F.col("grp").alias("h"), F.col("size").alias("hs"),
                    F.col("pos").alias("hp"), F.col("lo").alias("hlo"), F.col("hi").alias("hhi"))
    shorter = F.col("gs") - F.floor((2 * NUM * F.col("gs") + NUM + DEN - 1) / (NUM + DEN)) + 1  # prefix of the smaller set
    open_pairs = x.join(y, F.col("token") == F.col("__t")).filter(
        ((F.col("gs") < F.col("hs")) | ((F.col("gs") == F.col("hs")) & (F.col("g") < F.col("h"))))
        & (F.col("gp") < shorter) & may_link(F.col("gs"), F.col("gp"), F.col("hs"), F.col("hp"))
        & ~((F.col("glo") == F.col("ghi")) & (F.col("hlo") == F.col("hhi")) & (F.col("glo") == F.col("hlo"))))
    open_groups = open_pairs.select("g", "h").distinct().unionByName(
        span.filter("lo <> hi").select(F.col("__g").alias("g"), F.col("__g").alias("h")))
    one = placed.select(F.col("grp").alias("__g"), F.col("node").alias("a"), F.col("root").alias("ra"))
    two = placed.select(F.col("grp").alias("__h"), F.col("node").alias("b"), F.col("root").alias("rb"))
    rest = open_groups.join(one, F.col("g") == F.col("__g")).join(two, F.col("h") == F.col("__h")).filter(
        (F.col("ra") != F.col("rb")) & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    rest = cut_lineage(rest)
    more = cut_lineage(verified(rest, texts_of_nodes(docs, nodes, rest, n), n))
    roots = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    joined = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.sum("n_copies").alias("members"))
    of_node = joined.join(named, "root").select(F.col("node").alias("__n"), "component_id", "members")
    many = of_node.filter("members > 1")  # a node alone is its own component
    found = rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("node")).alias("node")).join(
        many, F.col("node") == F.col("__n"), "left")
    return found.select("doc_id", F.col("size").alias("n_shingles"),
                        F.coalesce("component_id", "doc_id").alias("component_id"),
                        F.coalesce("members", F.lit(1).cast("long")).alias("members"))


def texts_of_nodes(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(node, text) of the nodes in ``pairs``, one text per node.  The node is computed from the text again, as an
    id may have several texts."""
    wanted = pairs.select(F.col("a").alias("__n")).unionByName(pairs.select(F.col("b").alias("__n"))).distinct()
    keyed = cut_lineage(nodes.join(wanted, F.col("node") == F.col("__n")).select("node", F.col("doc_id").alias("__d")))
    ids = keyed.select(F.coalesce(F.col("__d").cast("string"), F.lit("")).alias("__k"))
    rows = only(docs, "doc_id", "text").withColumn("__key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    texts = sifted(rows, F.col("__key"), ids, F.col("__k")).drop("__key")

    def name(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.num_rows
        row, h = shingles(batch["text"], n)
        size = np.bincount(row, minlength=rows)
        ends = np.cumsum(size)
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(h ^ np.uint64(MARK)))])
            node = mixed(total[ends] - total[ends - size] + size.astype(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch["text"]], names=["node", "text"])

    found = arrow_map(texts.select("text"), name, "node long, text string")
    return cut_lineage(found.join(keyed.select(F.col("node").alias("__n")), F.col("node") == F.col("__n"), "left_semi").dropDuplicates(["node"]))


def one_of_each(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """One row of each group of near duplicates (the one with the smallest id; of repeated rows, one), all columns."""
    ids = near_duplicates(docs, n).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__d")).distinct()
    # one key for the lookup and the numbering, so the texts are shuffled once; a pair of a null id equals its like
    pair = F.struct("doc_id", F.xxhash64("text").alias("text_hash"))
    kept = only(docs, "doc_id", "text").select("doc_id", pair.alias("__p")).join(
        ids, F.col("doc_id").eqNullSafe(F.col("__d")), "left_semi").select("__p").distinct()
    kinds = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.withColumn("__k", pair).join(kept, F.col("__k") == F.col("__p"), "left_semi")
    w = Window.partitionBy("__k").orderBy(F.lit(0))
    return single.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*kinds)

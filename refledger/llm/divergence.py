"""Source divergence audit: how unlike the sources of a language use its terms, in exact whole numbers.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps the V terms that at least
``LEAST`` of its documents have.  A group (language, source), and the language as a whole, gives every kept term with
``count`` occurrences p = 1 + floor(10**9 * (count + 1) / (N + V)), N the group's sum of counts.  The divergence of
two groups is the sum of floor((p - q)**2 / q) over all kept terms.

A group's p depends on the count alone, so a divergence follows from the joint table of two groups: how many terms
have count a in the one and count b in the other.  All joint tables come from one-hot level products: a block of terms
is a matrix of 0 and 1 with a column for every (group, count level), and the product of its transpose with itself
counts the terms that each two columns share.  Blocks hold terms of like total count, so that they have few levels,
and groups in sets of about ``SET``; every pair of sets is a product of its own, in tiles of ``TILE`` columns, so a task's
memory is bounded whatever the terms, groups or levels.  Spark adds up the products of all blocks and prices the
tables.  Level 0 has no column: its cells are the marginal counts less what the table holds.

Defined results: null text, lang and source are ''; a group without kept terms is listed with N = 0; in a language
without kept terms all values of ``pair`` are 0 and there are no ``term`` rows; a language with one source has no
``pair`` rows; repeated rows count as documents of their own; without documents there are no rows; doc_id and other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger.functions.shipping import ship_by_value
from refledger.llm.common import BASE, mixed, no_null_text, only, pieces, range_hashes
from refledger.llm.spread import spread_lookup
from refledger.operators.common import top_k
from refledger.session import cut_lineage

ship_by_value(__name__)

LEAST, TOP = 3, 200
#: Terms of a block, groups of a set, columns of a tile.
TERMS, SET, TILE = 256, 32, 1024
#: Entries that a task holds before it passes them on.
MOST = 500_000
IN_TERM = np.zeros(256, bool)
IN_TERM[128:] = True
IN_TERM[list(range(65, 91)) + list(range(97, 123))] = True
COUNTS = "lang string, source string, term string, c bigint, df bigint"
CELL = "lang string, v bigint, s1 int, n1 bigint, l1 bigint, s2 int, n2 bigint, l2 bigint, terms bigint"


def kept_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, c, total, lead): occurrences of each kept term in each group and in its language; ``lead``
    marks one row of each (lang, term).

    Tasks count whole batches at a time and add up what they have until it is ``MOST`` entries; Spark adds the rest.
    All rows of a term in a language meet in one place, at most one a group and task, so one shuffle serves the group's
    sums and the language's.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for part in pieces(batch, 1 << 14, 8_000_000):
                held.append(batch_counts(part))
                if sum(t.num_rows for t in held) > 2 * MOST:
                    held = [added(held)]
                    if held[0].num_rows > MOST:
                        yield from released(held)
                        held = []
        if held:
            yield from released([added(held)])

    rows = named(docs, "text").select("text", "lang", "source").mapInArrow(run, COUNTS).repartition("lang", "term")
    counts = rows.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))
    of_term = Window.partitionBy("lang", "term")
    return counts.select(
        "lang", "source", "term", "c", F.sum("c").over(of_term).alias("total"), F.sum("df").over(of_term).alias("df"),
        (F.min("source").over(of_term) == F.col("source")).alias("lead")).filter(F.col("df") >= LEAST).drop("df")


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """The terms of a batch with their groups and counts; ``key`` is a hash of both."""
    text = pa.compute.ascii_lower(no_null_text(batch["text"]))
    sizes = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    data = np.frombuffer(text.buffers()[2], np.uint8)[:ends[-1]] if len(ends) and ends[-1] else np.zeros(0, np.uint8)
    solid = IN_TERM[data]
    step = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    cut = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]
    cut = np.unique(cut[solid[cut] & solid[cut - 1]]) if len(data) else cut  # a term over a row's end is two
    lo = np.sort(np.concatenate([np.flatnonzero(step == 1), cut]))
    hi = np.sort(np.concatenate([np.flatnonzero(step == -1), cut]))
    row = np.searchsorted(ends, lo, side="right")
    pair = pa.StructArray.from_arrays([batch["lang"], batch["source"]], names=["lang", "source"])
    group, groups = encoded(pair)
    key = mixed(range_hashes(data, np.stack([lo, hi], 1)) + group_keys(groups)[group[row]])
    # terms stand in the order of rows, and so do equal keys after a stable sort
    order = np.argsort(key, kind="stable")
    key, by_row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    fresh = new.copy()
    fresh[1:] |= by_row[1:] != by_row[:-1]
    c = np.diff(np.concatenate([first, [len(key)]]))
    df = np.add.reduceat(fresh.astype(np.int64), first) if len(first) else c
    at = order[first]
    return pa.table({"key": key[first], "lang": groups.field("lang").take(pa.array(group[row[at]])),
                     "source": groups.field("source").take(pa.array(group[row[at]])),
                     "term": ranges(data, lo[at], hi[at]), "c": c.astype(np.int64), "df": df})


def encoded(pair: pa.StructArray) -> tuple[np.ndarray, pa.StructArray]:
    """Index of each (lang, source) among the distinct ones."""
    codes = [pair.field(i).dictionary_encode() for i in (0, 1)]
    both = [c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in codes]
    _, first, index = np.unique(both[0] * max(1, len(codes[1].dictionary)) + both[1], return_index=True, return_inverse=True)
    return index, pair.take(pa.array(first))


def group_keys(groups: pa.StructArray) -> np.ndarray:
    """Hash of each (lang, source)."""
    out = np.zeros(len(groups), np.uint64)
    for name in ("lang", "source"):
        text = no_null_text(groups.field(name))
        size = pa.compute.binary_length(text).to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        data = np.frombuffer(text.buffers()[2], np.uint8) if len(end) and end[-1] else np.zeros(0, np.uint8)
        out = mixed(out * np.uint64(BASE) + range_hashes(data, np.stack([end - size, end], 1)))
    return out


def ranges(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
    """Byte ranges of ``data`` as strings."""
    size = hi - lo
    offsets = np.concatenate([[0], np.cumsum(size)])
    place = np.repeat(lo - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[place]))


def added(tables: list[pa.Table]) -> pa.Table:
    """Counts of equal keys added up."""
    whole = pa.concat_tables(tables)
    key = whole["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.flatnonzero(new)
    out = whole.take(pa.array(order[first])).drop_columns(["c", "df"])
    for name in ("c", "df"):
        out = out.append_column(name, pa.array(np.add.reduceat(whole[name].to_numpy()[order], first) if len(first) else first))
    return out


def released(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    for table in tables:
        yield from table.drop_columns(["key"]).combine_chunks().to_batches(max_chunksize=1 << 16)


def named(docs: DataFrame, *more: str) -> DataFrame:
    return only(docs, "lang", "source", *more).select(
        *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in ("lang", "source")], *more)


def p_of(count: str, n: str, v: str) -> str:
    """SQL of the smoothed frequency in billionths."""
    return f"(1 + (1000000000BD * ({count} + 1)) div ({n} + {v}))"


def f_of(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div {q})"


def products(lang: str, group: pa.Table, x: int, y: int) -> pa.Table:
    """Joint counts of the levels of each two groups, one of set ``x`` and one of set ``y``, over one block of terms.

    Rows without term name the groups (s, n, set; v and the block's size are the same in all); the others say that a
    term has a level above 0 in a group.
    """
    has = group["term"].is_valid()
    names, rows = group.filter(pa.compute.invert(has)), group.filter(has)
    s, n, own = (names[k].to_numpy().astype(np.int64) for k in ("s", "n", "set"))
    v, size = names["v"][0].as_py(), names["c"][0].as_py()
    at = pa.compute.index_in(rows["source"], names["source"]).to_numpy().astype(np.int64)
    t = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()  # terms that none of these groups has come last
    level = rows["c"].to_numpy().astype(np.int64)
    # columns: by group, then level, 0 first
    columns, col = np.unique(np.concatenate([np.stack([np.arange(len(s)), np.zeros(len(s), np.int64)], 1), np.stack([at, level], 1)]),
                             axis=0, return_inverse=True)
    zero, col = col.ravel()[:len(s)], col.ravel()[len(s):]
    absent = [np.setdiff1d(np.arange(size), t[at == g]) for g in range(len(s))]

    def tile(picked: np.ndarray) -> np.ndarray:
        out = np.zeros((size, len(picked)), np.float32)
        where = np.full(len(columns), -1)
        where[picked] = np.arange(len(picked))
        mine = where[col] >= 0
        out[t[mine], where[col[mine]]] = 1
        for g, i in enumerate(zero):
            if where[i] >= 0:
                out[absent[g], where[i]] = 1
        return out

    of = columns[:, 0]
    left, right = (np.flatnonzero(own[of] == k) for k in (x, y))
    found = []
    for i in range(0, len(left), TILE):
        a = tile(left[i:i + TILE])
        for j in range(i if x == y else 0, len(right), TILE):
            joint = a.T @ tile(right[j:j + TILE])  # exact: counts of at most a block's terms
            p, q = np.nonzero(joint)
            c1, c2 = left[i + p], right[j + q]
            other = (of[c1] < of[c2]) if x == y else np.ones(len(p), bool)
            found.append((c1[other], c2[other], joint[p[other], q[other]].astype(np.int64)))
    c1, c2, k = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 3
    flip = s[of[c1]] > s[of[c2]]
    c1, c2 = np.where(flip, c2, c1), np.where(flip, c1, c2)
    cols = [s[of[c1]].astype(np.int32), n[of[c1]], columns[c1, 1], s[of[c2]].astype(np.int32), n[of[c2]], columns[c2, 1], k]
    return pa.Table.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array([v] * len(k), pa.int64()), *map(pa.array, cols)],
                                names=["lang", "v", "s1", "n1", "l1", "s2", "n2", "l2", "terms"])


def set_of(source: str = "source", sets: str = "sets") -> Column:
    """The set of a group among those of its language, by hash."""
    return F.pmod(F.xxhash64(source), F.col(sets)).cast("int")


def joint_tables(known: DataFrame, groups: DataFrame, rows: int) -> DataFrame:
    """(lang, v, s1, n1, l1, s2, n2, l2, terms): for groups s1 < s2, how many kept terms have count l1 in the one and
    l2 in the other.  ``rows``: those of ``known``."""
    banded = known.withColumn("b", F.struct("lang", F.floor(F.log2("total")).alias("band")))
    bands = banded.groupBy("b").agg(F.count("*").alias("n"), F.ceil(F.count_if("lead") / TERMS).alias("blocks")).join(
        groups.select("lang", "sets").distinct(), F.col("b.lang") == F.col("lang")).drop("lang")
    placed = spread_lookup(banded, bands, "b", "n", rows).select(
        "lang", "b.band", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "c", "lead", "sets", set_of().alias("set"))
    names = placed.filter("lead").groupBy("lang", "band", "block").agg(F.count("*").alias("c")).join(
        groups.select("lang", "source", "s", "n", "v", "sets", set_of().alias("set")), "lang")
    dealt = placed.drop("lead").unionByName(names, allowMissingColumns=True)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sets") - 1))).withColumn(
        "x", F.least("set", "other")).withColumn("y", F.greatest("set", "other")).drop("other", "sets")

    def one(key: tuple, group: pa.Table) -> pa.Table:
        lang, _, _, x, y = (k.as_py() for k in key)
        return products(lang, group, x, y)

    cells = dealt.groupBy("lang", "band", "block", "x", "y").applyInArrow(one, CELL)
    return cells.groupBy("lang", "v", "s1", "n1", "l1", "s2", "n2", "l2").agg(F.sum("terms").alias("terms"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    known = cut_lineage(kept_counts(docs))
    sums = known.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("rows"))
    langs = known.filter("lead").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    by_lang = Window.partitionBy("lang")
    groups = cut_lineage(named(docs).distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", (F.row_number().over(by_lang.orderBy("source")) - 1).alias("s"),
        F.ceil(F.count("*").over(by_lang) / SET).cast("int").alias("sets"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n", "v", "n_lang", "rows")]))
    rows = groups.agg(F.sum("rows")).first()[0] or 0

    cells = joint_tables(known, groups, rows)
    p, q = p_of("l1", "n1", "v"), p_of("l2", "n2", "v")
    priced = cells.withColumn("p", F.expr(p)).withColumn("q", F.expr(q)).groupBy("lang", "s1", "s2").agg(
        F.expr(f"sum(cast(terms as decimal(20, 0)) * {f_of('p', 'q')})").alias("there"),
        F.expr(f"sum(cast(terms as decimal(20, 0)) * {f_of('q', 'p')})").alias("back"))
    both = cut_lineage(priced).select("lang", F.inline(F.array(
        F.struct(F.col("s1").alias("s"), F.col("s2").alias("t"), F.col("there").alias("sum")),
        F.struct(F.col("s2").alias("s"), F.col("s1").alias("t"), F.col("back").alias("sum")))))
    others = groups.select("lang", F.col("s").alias("t"), F.col("source").alias("item"))
    pairs = groups.select("lang", "source", "s").join(others, "lang").filter("s <> t").join(both, ["lang", "s", "t"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("sum", F.lit(0)).cast("bigint").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))

    keyed = groups.filter("rows > 0").select(F.struct("lang", "source").alias("g"), "n", "v", "n_lang", "rows")
    entries = spread_lookup(known.withColumn("g", F.struct("lang", "source")), keyed, "g", "rows", rows)
    terms = entries.withColumn("p", F.expr(p_of("c", "n", "v"))).withColumn("q", F.expr(p_of("total", "n_lang", "v"))).filter(
        "p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f_of("p", "q")).alias("value"))
    return pairs.unionByName(top_k(terms, ["lang", "source"], order, top))

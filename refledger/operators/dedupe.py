"""Duplicates, clone pairs and copy-of-key reuse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import identifiers as ids
from refledger.functions import text as tx
from refledger.functions.similarity import SEQUENCE, SimilarityModel, bag_bound, length_bound
from refledger.operators.common import first_row_by
from refledger.session import cut_lineage

KINDS = ["url", "doi", "pmid"]


def named_title(refs: DataFrame) -> Column:
    """The title, or the claim of a row that has none."""
    title = tx.blank_to_null(F.coalesce(F.col("title"), F.lit("")))
    return F.coalesce(title, F.col("claim")) if "claim" in refs.columns else title


def duplicate_keys(refs: DataFrame) -> DataFrame:
    """list_id, ref_id, kind, key: identifier plus fingerprint of title or claim; rows without both form no key."""
    sig = tx.title_key(named_title(refs))
    bar = F.lit("|")

    def keyed(value):
        v = tx.blank_to_null(F.coalesce(value.cast("string"), F.lit("")))
        return F.when(F.coalesce(sig, F.lit("")) != "", F.concat(v, bar, sig))

    keys = F.array(
        F.struct(F.lit("url").alias("kind"), keyed(ids.normalise_url(F.col("url"))).alias("key")),
        F.struct(F.lit("doi").alias("kind"), keyed(F.lower("doi")).alias("key")),
        F.struct(F.lit("pmid").alias("kind"), keyed(F.col("pmid")).alias("key")))
    return refs.select("list_id", "ref_id", F.inline(keys)).filter("key is not null")


def _pick(kind_prefix: str) -> Column:
    return F.coalesce(*[F.col(f"{kind_prefix}_{k}") for k in KINDS])


def mark_duplicates(refs: DataFrame, mode: str = "greedy") -> DataFrame:
    """list_id, ref_id, duplicate_of, duplicate_kind for every duplicate.

    ``global``: a row is a duplicate when an earlier row of its list holds one of its keys.
    ``greedy`` (the reference rule): only rows that are no duplicates themselves hold keys.

    Both work on per-key minima (aggregations with a map-side part), so a key shared by most rows
    never gathers in one task.  The greedy rule is the first-come independent set over shared keys.
    It is settled in rounds; a round decides every row whose keys have no undecided earlier row, and
    every row that hangs on such a row by a path of single earlier partners, however long (``_settle``).
    """
    keys = duplicate_keys(refs)
    if mode == "global":
        return _point_to(keys, keys)
    if mode != "greedy":
        raise ValueError(f"unknown mode {mode}")
    shared = keys.groupBy(*KEY).agg(F.min("ref_id").alias("first"), F.max("ref_id").alias("last")).filter("first < last")
    open_keys = cut_lineage(keys.join(shared.select(*KEY), KEY))
    holders = None
    while not open_keys.isEmpty():
        held = cut_lineage(open_keys.join(_settle(open_keys), ROW).select(*KEY, F.col("ref_id").alias("holder")))
        holders = held if holders is None else holders.unionByName(held)
        settled = open_keys.join(held.select(*KEY), KEY).select(*ROW).distinct()
        open_keys = cut_lineage(open_keys.join(settled, ROW, "left_anti"))
    if holders is None:
        return _point_to(keys, keys.limit(0))
    return _point_to(keys, holders.select(*KEY, F.col("holder").alias("ref_id")))


KEY, ROW = ["list_id", "kind", "key"], ["list_id", "ref_id"]


def _settle(open_keys: DataFrame) -> DataFrame:
    """(list_id, ref_id): rows of ``open_keys`` that are certain to be originals.

    A row that is the lowest of all its keys is one.  A row that is not the lowest of a single key, and the second
    lowest of that, is an original exactly if the lowest is none: it points to that row with one flip.  Pointers are
    followed by doubling, so a path of n rows takes log2(n) joins; a path that ends at an undecided row waits for the
    next round.  (Greedy sets have no parallel form for all inputs: rounds grow with the rows on a path that have
    several undecided earlier partners.)
    """
    low = open_keys.groupBy(*KEY).agg(F.min("ref_id").alias("low"))
    marked = open_keys.join(low, KEY)
    second = marked.filter("ref_id > low").groupBy(*KEY).agg(F.min("ref_id").alias("second"))
    rows = marked.join(second, KEY, "left").groupBy(*ROW).agg(
        F.count_if(F.col("ref_id") > F.col("low")).alias("later"),
        F.max(F.when(F.col("ref_id") == F.col("second"), F.col("low"))).alias("low"))
    done = F.col("later") == 0
    paths = cut_lineage(rows.filter(done | ((F.col("later") == 1) & F.col("low").isNotNull())).select(
        *ROW, F.when(done, F.col("ref_id")).otherwise(F.col("low")).alias("end"), F.when(done, 0).otherwise(1).alias("flips"),
        done.alias("done"), F.lit(False).alias("stuck")))
    while not paths.filter("NOT done AND NOT stuck").isEmpty():
        paths = cut_lineage(_doubled(_doubled(paths)))
    return paths.filter("done AND flips = 0").select(*ROW)


def _doubled(paths: DataFrame) -> DataFrame:
    """Paths as long again: each takes on the path of the row it ends at."""
    going = ~F.col("done") & ~F.col("stuck")
    ends = paths.select("list_id", F.col("ref_id").alias("end"), F.col("end").alias("e"), F.col("flips").alias("f"), F.col("done").alias("d"))
    on = F.col("e").isNotNull()
    longer = paths.filter(going).join(ends, ["list_id", "end"], "left").select(
        *ROW, F.coalesce("e", "end").alias("end"), ((F.col("flips") + F.coalesce("f", F.lit(0))) % 2).alias("flips"),
        F.coalesce("d", F.lit(False)).alias("done"), (~on).alias("stuck"))
    return paths.filter(~going).unionByName(longer)


def _point_to(keys: DataFrame, holders: DataFrame) -> DataFrame:
    """Earlier holder of each row, by url, then DOI, then PMID."""
    low = holders.groupBy("list_id", "kind", "key").agg(F.min("ref_id").alias("holder"))
    hits = keys.join(low, ["list_id", "kind", "key"]).filter("holder < ref_id")
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = hits.groupBy("list_id", "ref_id").agg(F.min(F.struct(rank.alias("r"), "holder", "kind")).alias("m"))
    return best.select("list_id", "ref_id", F.col("m.holder").alias("duplicate_of"),
                       F.col("m.kind").alias("duplicate_kind"))


def apply_duplicates(results: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Verified duplicates become partial and point to the row they repeat."""
    df = results.join(duplicates, ["list_id", "ref_id"], "left")
    return df.withColumn("verdict", F.when(
        F.col("duplicate_of").isNotNull() & (F.col("verdict") == "verified"), "partial").otherwise(F.col("verdict")))


def reuse_by_key(refs: DataFrame) -> DataFrame:
    """First row of the list with the same DOI, else URL, PMID or arXiv id."""
    doi, url, pmid = (tx.blank_to_null(F.coalesce(F.col(c), F.lit(""))) for c in ("doi", "url", "pmid"))
    arxiv = ids.arxiv_id(F.col("arxiv"), F.col("url"))
    key = F.coalesce(
        F.concat(F.lit("doi:"), F.lower(doi)), F.concat(F.lit("url:"), ids.normalise_url(url)),
        F.concat(F.lit("pmid:"), pmid), F.concat(F.lit("arxiv:"), arxiv))
    keyed = refs.select("list_id", "ref_id", key.alias("reuse_key")).filter("reuse_key is not null")
    leaders = keyed.groupBy("list_id", "reuse_key").agg(F.min("ref_id").alias("leader"))
    return keyed.join(leaders, ["list_id", "reuse_key"]).select(
        "list_id", "ref_id", "reuse_key", "leader", (F.col("leader") < F.col("ref_id")).alias("is_follower"))


# --- clone pairs ---------------------------------------------------------------------------------

def _segments(key: Column) -> Column:
    """Equal cut of a key into budget + 1 pieces: (piece number, start, text)."""
    n = F.length(key)
    pieces = _budget_col(n) + 1
    return F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(
        i.alias("seg"), F.floor(i * n / pieces).cast("int").alias("start"),
        F.substr(key, (F.floor(i * n / pieces) + 1).cast("int"),
                 (F.floor((i + 1) * n / pieces) - F.floor(i * n / pieces)).cast("int")).alias("piece")))


def _budget_col(n: Column) -> Column:
    """Most insertions plus deletions a partner of an n-character key can need at ratio 0.92.

    ratio = 2M/(a+b) >= 0.92 leaves at most 0.08(a+b) unmatched characters, and the longest partner
    has n*1.08/0.92 characters."""
    longest = F.floor(n * (2 - fv.SIM_CLONE) / fv.SIM_CLONE)
    return F.floor((n + longest) * (1 - fv.SIM_CLONE) + 1e-9).cast("int")


#: Neighbours on this wheel of eight differ in one bit.
WHEEL = (0, 1, 3, 7, 15, 14, 12, 8)


def _signature(key: Column) -> Column:
    """Two numbers (lo, hi) that differ in as many bits as there are insertions and deletions between two keys, or fewer: the
    characters are of 32 kinds, and the count of a kind is a place on ``WHEEL``."""
    wheel = F.array(*[F.lit(x).cast("bigint") for x in WHEEL])

    def half(kinds: Column, first: int) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(first + 15)), F.lit(0).cast("bigint"), lambda bits, k: F.shiftleft(bits, 4).bitwiseOR(
            F.get(wheel, (F.size(kinds) - F.size(F.array_remove(kinds, k))) % len(WHEEL))))

    return tx.once(F.transform(F.split(key, ""), lambda c: F.ascii(c).bitwiseAND(F.lit(31))),
                   lambda kinds: F.struct(half(kinds, 0).alias("lo"), half(kinds, 16).alias("hi")))


#: Lists of so many titles are compared pair by pair: one title meets fewer others than it has substrings to look up.
SMALL_LIST = 256


def _near_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs of title nodes of one list that can reach ratio 0.92: exact, by length in small lists, else by shared segments.

    ``nodes``: list_id, title_key (once per list) and others; returns list_id and the other columns of both, by the
    suffixes _a (the shorter key; of equal lengths the smaller) and _b.

    With at most e edits, the first segment of the shorter key before whose end there are no more edits than segments
    before it (one of the first e + 1) survives whole in the longer one: segment i after exactly i edits, so shifted by
    -i, -i + 2, ... or i, and by no more than the e - i edits behind it allow.  The longer key therefore looks up its own
    substrings at these positions; no pair is formed without a shared segment.  Only lengths that another key
    of the list has are looked up, and only hashes, numbers of nodes and signatures travel: pairs whose signatures differ
    in more bits than edits are left leave where they meet; texts are fetched for the others.
    A list of at most ``SMALL_LIST`` titles needs no lookups: its titles meet by list and are told apart by length.
    """
    spark = nodes.sparkSession
    # numbered once written, so the numbers are read back as they are
    nodes = cut_lineage(nodes.filter("list_id IS NOT NULL").withColumns(
        {"node": F.monotonically_increasing_id(), "m": F.length("title_key")}))
    lengths = nodes.groupBy("list_id", "m").agg(F.count("*").alias("k")).groupBy("list_id").agg(
        F.collect_list(F.struct(F.col("m").alias("n"), "k")).alias("lengths"), F.sum("k").alias("titles"))

    def lowest(m: Column) -> Column:
        return F.greatest(F.ceil(m * fv.SIM_CLONE / (2 - fv.SIM_CLONE) - 1e-9).cast("int"), F.lit(8))

    m = F.col("m")
    shorter = F.transform(F.filter("lengths", lambda x: (x["n"] >= lowest(m)) & ((x["n"] < m) | ((x["n"] == m) & (x["k"] > 1)))), lambda x: x["n"])
    met = F.exists("lengths", lambda x: (m >= lowest(x["n"])) & ((x["n"] > m) | ((x["n"] == m) & (x["k"] > 1))))
    # one key makes hundreds of rows, so the keys are dealt evenly before they do, whatever their bytes; written, as a
    # filter by ``met`` would else move into the join, whose generated code can't take functions over arrays of one side
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    open_nodes = cut_lineage(nodes.join(lengths.filter(F.col("titles") > SMALL_LIST), "list_id").select(
        "list_id", "node", "title_key", "m", shorter.alias("shorter"), met.alias("met")).repartition(tasks, "node").withColumn(
        "sign", _signature(F.col("title_key"))))

    def place(n, seg, piece):
        return F.xxhash64("list_id", n, seg, piece).alias("place")

    short = open_nodes.filter("met").select("list_id", "node", "m", "sign.*", F.explode(_segments(F.col("title_key"))).alias("s")).select(
        place("m", "s.seg", "s.piece"), F.col("node").alias("node_a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    probe = open_nodes.select("list_id", "node", "title_key", "m", F.col("sign.lo").alias("lo_b"), F.col("sign.hi").alias("hi_b"),
                              F.explode("shorter").alias("n"))
    # edits that keep the ratio at these two lengths: as many more than the gap as come in pairs (one deleted, one inserted)
    gap = F.col("m") - F.col("n")
    most = F.floor((F.col("n") + F.col("m")) * (1 - fv.SIM_CLONE) + 1e-9).cast("int")
    probe = probe.withColumns({"d": _budget_col(F.col("n")), "most": most}).withColumn("e", F.least(F.col("d"), most - (most - gap) % 2)).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("seg"))
    start = F.floor(F.col("seg") * F.col("n") / (F.col("d") + 1)).cast("int")
    width = (F.floor((F.col("seg") + 1) * F.col("n") / (F.col("d") + 1)) - F.floor(
        F.col("seg") * F.col("n") / (F.col("d") + 1))).cast("int")
    lo = F.greatest(-F.col("seg"), gap - (F.col("e") - F.col("seg")), -start)
    lo = lo + F.pmod(lo - F.col("seg"), F.lit(2))
    hi = F.least(F.col("seg"), gap + (F.col("e") - F.col("seg")), F.col("m") - width - start)
    probe = probe.withColumns({"start": start, "width": width, "lo": lo, "hi": hi}).filter("lo <= hi").select(
        "list_id", "node", "title_key", "n", "seg", "start", "width", "most", "lo_b", "hi_b",
        F.explode(F.sequence("lo", "hi", F.lit(2))).alias("sh")).select(
        place("n", "seg", F.substr(F.col("title_key"), F.col("start") + F.col("sh") + 1, F.col("width"))), F.col("node").alias("node_b"),
        "most", "lo_b", "hi_b")
    # rows made by explode look as small as the keys that they come from, so a broadcast is ruled out by name
    differ = F.bit_count(F.col("lo_a").bitwiseXOR(F.col("lo_b"))) + F.bit_count(F.col("hi_a").bitwiseXOR(F.col("hi_b")))
    pairs = probe.join(short.hint("merge"), "place").filter((F.col("node_a") != F.col("node_b")) & (differ <= F.col("most"))).select(
        "node_a", "node_b").distinct()

    def side(s):
        return nodes.select(*[F.col(c).alias(f"{c}_{s}") for c in nodes.columns])

    # places of two lists or lengths may share a hash
    looked_up = pairs.join(side("a"), "node_a").join(side("b"), "node_b").filter(F.col("list_id_a") == F.col("list_id_b"))
    # dealt by lists, as here too one key makes many rows, whatever its bytes
    few = nodes.join(lengths.filter(F.col("titles") <= SMALL_LIST).select("list_id"), "list_id").repartition(tasks, "list_id")
    met_all = few.select(*[F.col(c).alias(f"{c}_a") for c in nodes.columns]).join(
        few.select(*[F.col(c).alias(f"{c}_b") for c in nodes.columns]), F.col("list_id_a") == F.col("list_id_b")).filter(
        F.col("m_a") >= lowest(F.col("m_b")))
    return looked_up.unionByName(met_all).filter((F.col("m_a") < F.col("m_b")) | (
        (F.col("m_a") == F.col("m_b")) & (F.col("title_key_a") < F.col("title_key_b")))).withColumnRenamed(
        "list_id_a", "list_id").drop("list_id_b", "node_a", "node_b", "m_a", "m_b")


def _near(nodes: DataFrame) -> DataFrame:
    """``_near_candidates`` that exact native bounds let reach the ratio."""
    ka, kb = F.col("title_key_a"), F.col("title_key_b")
    return _near_candidates(nodes).filter(length_bound(ka, kb) >= fv.SIM_CLONE).filter(bag_bound(ka, kb) >= fv.SIM_CLONE)


def clone_pairs(refs: DataFrame, model: SimilarityModel = SEQUENCE) -> DataFrame:
    """Same title under different DOIs, or one DOI under different titles, within a list.

    list_id, a, b, kind, sim with a < b.  Works on *variants* (distinct DOI and title key per list,
    named by their first row), so copies never multiply.

    * ``clone_doi``, equal titles: every variant is linked to the title's first variant.  Equality
      is transitive, so the links carry the whole group without its square (``clone_groups`` has the numbers).
    * ``clone_doi``, near titles (0.92): candidates come from shared segments, which lose nothing.
    * ``clone_title``: every pair of different titles of one DOI within the length gap is a finding of its own,
      so the output is as large as the findings are many.
    """
    key = tx.title_key(F.coalesce(named_title(refs), F.lit("")))
    variants = cut_lineage(  # read by every part below
        refs.select("list_id", "ref_id", key.alias("title_key"),
                    F.lower(F.coalesce(F.col("doi"), F.lit(""))).alias("doi"))
        .filter((F.length("title_key") >= 8) & (F.col("doi") != ""))
        .groupBy("list_id", "title_key", "doi").agg(F.min("ref_id").alias("first_ref")))
    # titles: first variant, and the first variant with another DOI
    lead = first_row_by(variants, ["list_id", "title_key"], [F.col("first_ref")]).select(
        "list_id", "title_key", F.col("doi").alias("lead_doi"), F.col("first_ref").alias("lead_ref"))
    with_lead = variants.join(lead, ["list_id", "title_key"])
    equal = with_lead.filter("first_ref <> lead_ref").select(
        "list_id", F.col("lead_ref").alias("a"), F.col("first_ref").alias("b"),
        F.lit("clone_doi").alias("kind"), F.lit(1.0).alias("sim"))
    second = with_lead.filter("doi <> lead_doi").groupBy("list_id", "title_key").agg(
        F.min("first_ref").alias("other_ref"))
    nodes = lead.join(second, ["list_id", "title_key"], "left")
    near = _near_titles(nodes, model)
    titles = _different_titles(variants, model)
    return equal.unionByName(near).unionByName(titles)


def _near_titles(nodes: DataFrame, model: SimilarityModel) -> DataFrame:
    j = _near(nodes)
    same = F.col("lead_doi_a") == F.col("lead_doi_b")
    # leading variants when their DOIs differ, otherwise the next variant with another DOI
    ra = F.when(~same | F.col("other_ref_b").isNotNull(), F.col("lead_ref_a")).otherwise(F.col("other_ref_a"))
    rb = F.when(same & F.col("other_ref_b").isNotNull(), F.col("other_ref_b")).otherwise(F.col("lead_ref_b"))
    j = j.withColumns({"ra": ra, "rb": rb}).filter("ra is not null and rb is not null")
    # the ratio takes the earlier row first
    ordered, ka, kb = F.col("ra") < F.col("rb"), F.col("title_key_a"), F.col("title_key_b")
    first, second = F.when(ordered, ka).otherwise(kb), F.when(ordered, kb).otherwise(ka)
    scored = j.withColumn("sim", model.plain(first, second)).filter(F.col("sim") >= fv.SIM_CLONE)
    return scored.select(
        "list_id", F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"),
        F.lit("clone_doi").alias("kind"), F.round("sim", 2).alias("sim"))


def _different_titles(variants: DataFrame, model: SimilarityModel) -> DataFrame:
    a = variants.select("list_id", "doi", F.col("first_ref").alias("a"), F.col("title_key").alias("ka"))
    b = variants.select("list_id", "doi", F.col("first_ref").alias("b"), F.col("title_key").alias("kb"))
    la, lb = F.length("ka"), F.length("kb")
    every = a.join(b, ["list_id", "doi"]).filter(
        (F.col("a") < F.col("b")) & (F.abs(la - lb) <= F.greatest(la, lb) * fv.CLONE_LENGTH_GAP))
    scored = every.withColumn("sim", model.plain(F.col("ka"), F.col("kb"))).filter(F.col("sim") < fv.SIM_CLONE)
    return scored.select("list_id", "a", "b", F.lit("clone_title").alias("kind"), F.round("sim", 2).alias("sim"))


@dataclass(frozen=True)
class CloneGroups:
    """Rows by equal title within a list, and the links between titles.

    ``members``: list_id, ref_id, title_group (first row with the title), length (of the title key), doi.
    ``links``: list_id, a, b, sim: groups a < b whose different titles reach the clone ratio.
    Together they say everything that pairs of rows would, in as many rows as there are rows and links.
    """

    members: DataFrame
    links: DataFrame


def clone_groups(refs: DataFrame, model: SimilarityModel = SEQUENCE) -> CloneGroups:
    """Rows with a DOI and a title (or claim) of eight characters or more, grouped by title."""
    rows = cut_lineage(refs.select(
        "list_id", "ref_id", tx.title_key(F.coalesce(named_title(refs), F.lit(""))).alias("title_key"),
        F.lower(F.coalesce(F.col("doi"), F.lit(""))).alias("doi")).filter((F.length("title_key") >= 8) & (F.col("doi") != "")))
    titles = rows.groupBy("list_id", "title_key").agg(F.min("ref_id").alias("title_group"))
    members = rows.join(titles, ["list_id", "title_key"]).select(
        "list_id", "ref_id", "title_group", F.length("title_key").alias("length"), "doi")
    cand = _near(titles).select("list_id", F.col("title_key_a").alias("ka"), F.col("title_key_b").alias("kb"),
                                F.col("title_group_a").alias("a"), F.col("title_group_b").alias("b"))
    # the ratio takes the earlier title first
    ordered = F.col("a") < F.col("b")
    first, second = (F.when(ordered, F.col(x)).otherwise(F.col(y)) for x, y in (("ka", "kb"), ("kb", "ka")))
    links = cand.withColumn("sim", model.plain(first, second)).filter(F.col("sim") >= fv.SIM_CLONE).select(
        "list_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("sim", 2).alias("sim"))
    return CloneGroups(cut_lineage(members), cut_lineage(links))


def clone_annotations(groups: CloneGroups) -> DataFrame:
    """list_id, ref_id, title_group, clone_doi_partners, clone_title_partners of every row that has a partner.

    ``clone_doi``: rows whose title is the same or linked, with another DOI.  ``clone_title``: rows of the same DOI
    whose title is neither, within the length gap.  Both are sums over group sizes; no pair of rows is made.
    """
    by_doi = groups.members.groupBy("list_id", "title_group", "length", "doi").agg(F.count("*").alias("n"))
    ends = groups.links.select("list_id", F.col("a").alias("title_group"), F.col("b").alias("other")).unionByName(
        groups.links.select("list_id", F.col("b").alias("title_group"), F.col("a").alias("other")))
    near = ends.join(by_doi.select("list_id", F.col("title_group").alias("other"), "doi", "n"), ["list_id", "other"])
    # rows of this title and the linked ones: of all DOIs, and of the row's own
    whole = near.select("list_id", "title_group", "n").unionByName(by_doi.select("list_id", "title_group", "n")).groupBy(
        "list_id", "title_group").agg(F.sum("n").alias("alike"))
    own = near.select("list_id", "title_group", "doi", "n").unionByName(by_doi.select("list_id", "title_group", "doi", "n")).groupBy(
        "list_id", "title_group", "doi").agg(F.sum("n").alias("alike_own"))
    # rows of the DOI by title length: lengths are few, whatever the titles
    lengths = by_doi.groupBy("list_id", "doi", "length").agg(F.sum("n").alias("n"))
    other = lengths.select("list_id", "doi", F.col("length").alias("l2"), "n")
    gap = F.abs(F.col("length") - F.col("l2")) <= F.greatest("length", "l2") * fv.CLONE_LENGTH_GAP
    close = lengths.drop("n").join(other, ["list_id", "doi"]).filter(gap).groupBy("list_id", "doi", "length").agg(F.sum("n").alias("close"))
    counted = by_doi.drop("n").join(whole, ["list_id", "title_group"]).join(own, ["list_id", "title_group", "doi"]).join(
        close, ["list_id", "doi", "length"]).select("list_id", "title_group", "doi",
        (F.col("alike") - F.col("alike_own")).alias("clone_doi_partners"), (F.col("close") - F.col("alike_own")).alias("clone_title_partners"))
    return groups.members.drop("length").join(
        counted.filter("clone_doi_partners + clone_title_partners > 0"), ["list_id", "title_group", "doi"]).select(
        "list_id", "ref_id", "title_group", "clone_doi_partners", "clone_title_partners")

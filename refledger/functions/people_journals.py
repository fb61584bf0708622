"""Journal-name and author-name comparison, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions.text import name_key, script_family, strip, words_literal

_TOKEN = r"([a-z0-9]+|[一-鿿])"


def _map(d: dict[str, str]) -> Column:
    keys, values = words_literal(d), words_literal(d.values())
    return F.map_from_arrays(keys, values)


def journal_ta(source: Column) -> Column:
    """Chinese journal name to NLM title abbreviation; other names pass through."""
    bare = F.regexp_replace(F.coalesce(source, F.lit("")), r"[\s《》*]+", "")
    return F.coalesce(
        F.try_element_at(_map(fv.CN_JOURNAL_TA), bare), strip(F.coalesce(source, F.lit("")))
    )


def journal_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), 1)


def _initials_in_order(short: Column, long: Column) -> Column:
    """First letters of ``short`` form a subsequence of those of ``long`` (a LIKE pattern)."""
    def initials(t):
        return F.transform(t, lambda w: F.substring(w, 1, 1))

    pattern = F.concat(F.lit("%"), F.array_join(initials(short), "%"), F.lit("%"))
    return F.like(F.array_join(initials(long), ""), pattern)


def journal_same(claimed: Column, registered: Column) -> Column:
    """Lenient comparison used with DOI records: containment or ordered initials."""
    a, b = name_key(claimed), name_key(registered)
    ta, tb = journal_tokens(claimed), journal_tokens(registered)
    families = F.transform(F.array(a, b), script_family)
    fa, fb = F.get(families, F.lit(0)), F.get(families, F.lit(1))
    return (
        (a == "") | (b == "")
        | ((fa != "none") & (fa != fb))
        | a.contains(b) | b.contains(a)
        | _initials_in_order(ta, tb) | _initials_in_order(tb, ta)
    )


def _prefixes_in_order(x: Column, y: Column) -> Column:
    """Content words of the shorter name are, in order, prefixes of words of the longer one."""
    stop = words_literal(fv.JOURNAL_STOP)

    def content(t):
        return F.filter(t, lambda w: ~F.array_contains(stop, w))

    x_short = F.size(x) <= F.size(y)
    short = content(F.when(x_short, x).otherwise(y))
    long = content(F.when(x_short, y).otherwise(x))
    text = F.concat(F.lit(" "), F.array_join(long, " "))
    pattern = F.concat(F.lit("% "), F.array_join(short, "% "), F.lit("%"))
    return (F.size(short) > 0) & F.like(text, pattern)


def _expand(c: Column) -> Column:
    key = strip(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""))
    return F.coalesce(F.try_element_at(_map(fv.JOURNAL_ACRONYMS), key), c)


def journal_consistent(claimed: Column, registered: Column) -> Column:
    """Stricter comparison used with PubMed records: containment, acronym table, ordered prefixes."""
    c = F.lower(strip(F.coalesce(claimed, F.lit(""))))
    r = F.lower(strip(F.coalesce(registered, F.lit(""))))
    cn, rn = name_key(c), name_key(r)
    cjk = r"[一-鿿]"
    ec, er = _expand(c), _expand(r)
    ascii_c, ascii_r = (F.regexp_replace(v, r"[^a-z0-9]+", "") for v in (ec, er))
    expanded = ((ec != c) | (er != r)) & (
        ascii_r.contains(ascii_c) | ascii_c.contains(ascii_r)
        | _prefixes_in_order(journal_tokens(ec), journal_tokens(er))
    )
    return (
        (cn == "") | (rn == "")
        | (c.rlike(cjk) != r.rlike(cjk))
        | rn.contains(cn) | cn.contains(rn)
        | expanded
        | _prefixes_in_order(journal_tokens(c), journal_tokens(r))
    )


def author_parts(authors: Column) -> Column:
    """Separated author names, stripped, without empty parts."""
    parts = F.transform(F.split(F.coalesce(authors, F.lit("")), "[,，;；、]"), strip)
    return F.filter(parts, lambda p: p != "")


def surnames(authors: Column) -> Column:
    """First token of every separated part."""
    return F.transform(author_parts(authors), lambda p: F.regexp_extract(p, r"^(\S+)", 1))


def author_consistent(claimed: Column, registered: Column) -> Column:
    """Any claimed surname meets any registered name part.

    ``claimed`` and ``registered`` are arrays of names.  Nothing to compare, or different writing
    systems, counts as consistent; one-letter names must be equal.
    """
    def keys(a):
        return F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), name_key), lambda x: x != "")

    c, r = keys(claimed), keys(registered)
    family = script_family(F.get(c, F.lit(0)))
    foreign = (family != "none") & F.forall(r, lambda x: script_family(x) != family)
    hit = F.exists(c, lambda x: F.exists(r, lambda y: (x == y) | (
        (F.length(x) >= 2) & (F.length(y) >= 2) & (x.contains(y) | y.contains(x)))))
    return (F.size(c) == 0) | (F.size(r) == 0) | foreign | hit


def registered_name_parts(authors: Column) -> Column:
    """family, given and literal names of an ``array<struct<family,given,name>>``."""
    return F.flatten(F.transform(
        F.coalesce(authors, F.expr("cast(array() as array<struct<family:string,given:string,name:string>>)")),
        lambda a: F.array_compact(F.array(a["family"], a["given"], a["name"])),
    ))


def gbt_authors(authors: Column) -> Column:
    """Export form: CJK names whole, Latin ones as SURNAME I I."""
    def one(a):
        fam, giv = strip(F.coalesce(a["family"], F.lit(""))), strip(F.coalesce(a["given"], F.lit("")))
        whole = F.concat(fam, giv)
        initials = F.array_join(F.transform(
            F.filter(F.split(giv, r"[\s\-]+"), lambda t: t != ""),
            lambda t: F.upper(F.substring(t, 1, 1))), " ")
        latin = strip(F.concat_ws(" ", F.upper(fam), F.when(initials != "", initials)))
        return F.when(whole.rlike(r"[一-鿿]"), whole).otherwise(latin)

    empty = F.expr("cast(array() as array<struct<family:string,given:string,name:string>>)")
    return F.filter(F.transform(F.coalesce(authors, empty), one), lambda x: x != "")

"""In-text citation markers, content words and text chunks, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions.text import strip, words_literal


def body_before_references(text: Column) -> Column:
    """Text up to the first reference heading; the whole text when there is none."""
    return F.element_at(F.split(text, fv.REFERENCE_HEADING, 2), 1)


def reference_section(text: Column) -> Column:
    parts = F.split(text, fv.REFERENCE_HEADING, 2)
    return F.element_at(parts, -1)


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, fv.SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: F.length(s) > 2)


def content_words(c: Column) -> Column:
    """Distinct words of two characters or more, stop words out, one light suffix stripped."""
    stop = words_literal(dict.fromkeys(fv.CONTENT_STOP))
    words = F.regexp_extract_all(
        F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9一-鿿]{2,})"), 1
    )

    def stem(w):
        out = None
        for suffix in fv.CONTENT_SUFFIXES:
            cond = (F.length(w) > 4) & w.endswith(suffix)
            cut = F.substr(w, F.lit(1), F.length(w) - len(suffix))
            out = (out.when if out is not None else F.when)(cond, cut)
        return out.otherwise(w)

    return F.array_distinct(F.transform(
        F.filter(words, lambda w: ~F.array_contains(stop, w)), stem))


def anchor_rate(sentence: Column, title: Column, authors: Column) -> Column:
    """Share of the title's content words met in the sentence; an author surname adds one word."""
    tw, sw = content_words(title), content_words(sentence)

    def close(t):
        return F.exists(sw, lambda s: (s == t) | (
            (F.least(F.length(s), F.length(t)) >= 5) & (s.startswith(t) | t.startswith(s))))

    names = F.transform(
        F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: strip(a) != ""),
        lambda a: F.lower(F.regexp_extract(strip(a), r"^(\S+)", 1)))
    hits = F.size(F.filter(tw, close)) + F.when(F.arrays_overlap(names, sw), 1).otherwise(0)
    return F.when(F.size(tw) > 0, F.least(hits, F.size(tw)) / F.size(tw)).otherwise(F.lit(0.0))


_MARKER = "struct<marker:string,kind:string,numbers:array<int>,surname:string,year:string,doi:string>"


def sentence_markers(sentence: Column) -> Column:
    """Citation markers of one sentence as an array of structs, each distinct marker once."""
    none_ints = F.expr("cast(null as array<int>)")
    no_text = F.lit(None).cast("string")

    def found(pattern):
        return F.array_distinct(F.regexp_extract_all(sentence, F.lit(f"({pattern})"), 1))

    def marker(m, kind, numbers=none_ints, surname=no_text, year=no_text, doi=no_text):
        return F.struct(
            m.alias("marker"), F.lit(kind).alias("kind"), numbers.alias("numbers"),
            surname.alias("surname"), year.alias("year"), doi.alias("doi")).cast(_MARKER)

    def range_marker(m):
        lo = F.regexp_extract(m, r"\[(\d{1,3})\s*-\s*(\d{1,3})\]", 1).cast("int")
        hi = F.regexp_extract(m, r"\[(\d{1,3})\s*-\s*(\d{1,3})\]", 2).cast("int")
        ok = (lo >= 1) & (lo <= hi)
        return marker(m, "numeric", F.when(ok, F.sequence(F.when(ok, lo), F.when(ok, hi))))

    def list_marker(m):
        nums = F.transform(
            F.regexp_extract_all(m, F.lit(r"(\d{1,3})"), 1), lambda x: x.cast("int"))
        return marker(m, "numeric", F.when(F.forall(nums, lambda x: x >= 1), nums))

    def author_marker(m):
        surname = F.regexp_extract(m, r"([A-Z][A-Za-z\-]+)", 1)
        return marker(m, "author-year", surname=surname, year=F.regexp_extract(m, r"(\d{4})\)$", 1))

    def doi_marker(m):
        return marker(m, "doi", doi=F.regexp_extract(m, r"(?i)doi\.org/(10\..*)$", 1))

    numeric = F.filter(
        F.concat(F.transform(found(fv.CITE_RANGE), range_marker),
                 F.transform(found(fv.CITE_LIST), list_marker)),
        lambda s: s["numbers"].isNotNull())
    return F.concat(
        numeric,
        F.transform(found(fv.CITE_AUTHOR_YEAR), author_marker),
        F.transform(found(fv.CITE_DOI), doi_marker),
    )


def chunks(text: Column, size: int = 900, overlap: int = 120) -> Column:
    """Fixed-size overlapping substrings; empty array for empty text."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    pieces = F.transform(starts, lambda i: F.substr(text, i + 1, F.lit(size)))
    return F.when(F.length(text) > 0, pieces).otherwise(F.array().cast("array<string>"))

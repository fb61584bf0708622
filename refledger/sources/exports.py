"""Exports: text columns built in the plan, written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions import people_journals as pj
from refledger.functions import text as tx
from refledger.operators.common import number_rows
from refledger.operators.normalise import citable

KEY_PREFIX = "ledger"


def _s(name: str) -> Column:
    return tx.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _line(cond: Column, *parts) -> Column:
    return F.when(cond, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))


def unique_cite_keys(results: DataFrame) -> DataFrame:
    """Citation key per row: prefix, year digits and the first three title words, cut at 42; repeats
    of a key within a list get _2, _3, ... in row order."""
    title = F.coalesce(tx.blank_to_null(tx.bib_safe(F.col("title"))), F.lit("untitled"))
    words = F.slice(F.regexp_extract_all(title, F.lit(r"([A-Za-z0-9一-鿿]+)"), 1), 1, 3)
    year = F.substring(F.regexp_replace(F.coalesce(F.col("year").cast("string"), F.lit("")), r"[^0-9]", ""), 1, 4)
    base = F.substring(F.concat(F.lit(KEY_PREFIX), year, F.array_join(words, "")), 1, 42)
    numbered = number_rows(results.withColumn("base_key", base), ["list_id", "base_key"], "ref_id", "__n")
    return numbered.withColumn("cite_key", F.when(F.col("__n") == 1, F.col("base_key")).otherwise(
        F.concat("base_key", F.lit("_"), F.col("__n").cast("string")))).drop("base_key", "__n")


def bibtex_entries(results: DataFrame) -> DataFrame:
    """list_id, ref_id, cite_key, entry of the verified rows."""
    df = unique_cite_keys(results.filter("verdict = 'verified'"))
    title = F.coalesce(tx.blank_to_null(tx.bib_safe(F.col("title"))), F.lit("untitled"))
    year = F.substring(F.regexp_replace(_s("year"), r"[^0-9]", ""), 1, 4)

    def field(name, col):
        return F.when(_s(col) != "", F.concat(F.lit(f"  {name} = {{"), tx.bib_safe(F.col(col)), F.lit("}")))

    fields = F.array_compact(F.array(
        F.concat(F.lit("  title = {"), title, F.lit("}")),
        field("journal", "source"),
        F.when(_s("year") != "", F.concat(F.lit("  year = {"), F.when(year != "", year).otherwise("n.d."), F.lit("}"))),
        field("url", "url"), field("doi", "doi"), field("eprint", "arxiv"),
        F.when(_s("arxiv") != "", F.lit("  archivePrefix = {arXiv}")),
        F.concat(F.lit("  note = {verified"), F.when(_s("pmid") != "", F.concat(
            F.lit("; PMID: "), tx.bib_safe(F.col("pmid")))).otherwise(""), F.lit("}"))))
    entry = F.concat(F.lit("@misc{"), F.col("cite_key"), F.lit(",\n"), F.array_join(fields, ",\n"), F.lit("}\n"))
    return df.select("list_id", "ref_id", "cite_key", entry.alias("entry"))


def _names(results: DataFrame) -> Column:
    csl = F.coalesce(F.col("csl_authors"), F.array().cast("array<string>"))
    given = pj.author_parts(F.col("authors")) if "authors" in results.columns else F.array().cast("array<string>")
    return F.when(F.size(csl) > 0, csl).otherwise(given)


def _best(csl: str, own: str) -> Column:
    return F.coalesce(F.nullif(_s(csl), F.lit("")), _s(own))


def gbt7714_lines(results: DataFrame, cite_date: str) -> DataFrame:
    """list_id, ref_id, line: GB/T 7714 entries of the citable rows."""
    df = citable(results)
    title = F.coalesce(F.nullif(_best("csl_title", "title"), F.lit("")), F.lit("untitled"))
    year = _best("csl_year", "year")
    names = _names(df)
    more = F.when(title.rlike(r"[一-鿿]"), F.lit("等")).otherwise(F.lit("et al"))
    shown = F.when(F.size(names) > 3, F.concat(F.slice(names, 1, 3), F.array(more))).otherwise(names)
    authors = F.array_join(shown, ", ")
    journal_article = (_s("arxiv") == "") & (_s("csl_container") != "")
    code = F.when(journal_article, F.lit("J")).otherwise(F.lit("EB/OL"))
    volume, issue, page = _s("csl_volume"), _s("csl_issue"), _s("csl_page")
    place = F.concat(
        _s("csl_container"), F.lit(", "), F.when(year != "", year).otherwise("s.d."),
        F.when(volume != "", F.concat(F.lit(", "), volume, F.when(issue != "", F.concat(
            F.lit("("), issue, F.lit(")"))).otherwise(""))).otherwise(""),
        F.when(page != "", F.concat(F.lit(": "), page)).otherwise(""), F.lit("."))
    url, doi = _s("url"), _s("doi")
    line = F.concat_ws(
        " ",
        F.when(authors != "", F.concat(authors, F.lit("."))),
        F.concat(title, F.lit("["), code, F.lit("].")),
        F.when(journal_article, place),
        F.when(~journal_article & (year != ""), F.concat(F.lit("("), year, F.lit(").")),),
        F.when(~journal_article, F.lit(f"[{cite_date}].")),
        F.when((doi != "") & ~F.lower(url).startswith("https://doi.org/"), F.concat(F.lit("DOI: "), doi, F.lit("."))),
        F.when(url != "", F.concat(url, F.lit("."))))
    return df.select("list_id", "ref_id", line.alias("line"))


def ris_records(results: DataFrame) -> DataFrame:
    """list_id, ref_id, record: RIS records of the citable rows."""
    df = citable(results)
    title = F.coalesce(F.nullif(_best("csl_title", "title"), F.lit("")), F.lit("untitled"))
    page, container, year = _s("csl_page"), _s("csl_container"), _best("csl_year", "year")
    dash = F.instr(page, "-") > 0
    first_page = F.when(dash, tx.strip(F.regexp_extract(page, r"^([^-]*)-", 1))).otherwise(page)
    last_page = tx.strip(F.regexp_extract(page, r"^[^-]*-(.*)$", 1))
    head = F.array(
        F.concat(F.lit("TY  - "), F.when(container != "", F.lit("JOUR")).otherwise(F.lit("GEN"))),
        F.concat(F.lit("TI  - "), title))
    people = F.transform(_names(df), lambda a: F.concat(F.lit("AU  - "), a))
    tail = F.array_compact(F.array(
        _line(container != "", "JO  - ", container),
        _line(_s("source") != "", "PB  - ", _s("source")),
        _line(year != "", "PY  - ", year),
        _line(_s("csl_volume") != "", "VL  - ", _s("csl_volume")),
        _line(_s("csl_issue") != "", "IS  - ", _s("csl_issue")),
        _line(page != "", "SP  - ", first_page),
        _line(dash, "EP  - ", last_page),
        _line(_s("doi") != "", "DO  - ", _s("doi")),
        _line(_s("url") != "", "UR  - ", _s("url")),
        F.concat(F.lit("N1  - registry check: "), F.col("verdict")), F.lit("ER  - ")))
    return df.select("list_id", "ref_id", F.concat(
        F.array_join(F.concat(head, people, tail), "\n"), F.lit("\n")).alias("record"))


LEDGER = ["index", "title", "verdict", "tier", "http_status", "needs_human_check", "year", "source", "url", "doi",
          "pmid", "arxiv", "note"]


def ledger_rows(results: DataFrame) -> DataFrame:
    """Audit ledger, one row per reference, cells guarded against spreadsheet formulas."""
    named = {"index": F.col("ref_id"), "needs_human_check": F.col("needs_human")}
    return results.select("list_id", *[tx.csv_safe(named.get(c, F.col(c) if c not in named else None)).alias(c) for c in LEDGER])


CHECK_GROUPS = {
    "doi_metadata": ["doi_state", "doi_matched", "doi_adjust", "doi_sim", "doi_fidelity", "doi_bridge", "doi_year_gap",
                     "journal_mismatch", "author_mismatch", "csl_title", "csl_authors", "csl_container", "csl_year",
                     "csl_volume", "csl_issue", "csl_page"],
    "retraction": ["retracted", "retraction_nature", "retraction_check_failed"],
    "s2": ["s2_matched", "s2_sim"],
    "s2_title": ["s2_title_matched", "s2_title_sim"],
    "arxiv_metadata": ["arxiv_state", "arxiv_matched", "arxiv_adjust", "arxiv_sim", "arxiv_version_note", "arxiv_year_gap"],
    "url": ["reachable", "http_status", "probe_cause"],
    "openalex": ["openalex_confirmed", "openalex_near", "openalex_sim", "openalex_doi"],
    "wayback": ["archive_url"],
    "doi_pmid_crosscheck": ["pair_checked", "stitched"],
    "pmid_metadata": ["pmid_state", "pmid_matched", "pmid_adjust", "pmid_sim", "pmid_corroborated"],
    "pubmed_reverse": ["reverse_pmid", "reverse_sim", "reverse_adjust"],
    "pubmed_locator": ["locator_hits", "locator_matched", "locator_pmid"],
    "landing": ["landing_confirmed", "landing_near", "landing_sim"],
    "open_access": ["is_oa", "oa_license", "oa_url"],
    "source_policy": ["policy_violation"],
}


def pack_checks(results: DataFrame) -> DataFrame:
    """Fold the flat check columns into one struct per check."""
    groups = []
    for name, cols in CHECK_GROUPS.items():
        have = [c for c in cols if c in results.columns]
        if have:
            groups.append(F.struct(*have).alias(name))
    return results.withColumn("checks", F.struct(*groups))


def workpaper(results: DataFrame) -> DataFrame:
    """list_id, ref_id, record: one JSON document per reference with its nested checks."""
    packed = pack_checks(results)
    cols = [c for c in ("title", "verdict", "tier", "http_status", "needs_human", "checks", "semantic_audit", "triples",
                        "error_codes", "note") if c in packed.columns]
    return packed.select("list_id", "ref_id", F.to_json(F.struct(F.col("ref_id").alias("index"), *cols)).alias("record"))


def batch_report(results: DataFrame, profile: DataFrame, scorecard: DataFrame, bluf: DataFrame,
                 rows_per_part: int = 5000, audit: DataFrame | None = None) -> DataFrame:
    """JSON report per list, in parts of bounded size.

    Part 0 carries scorecard, bottom line, profile and document audit; the results follow in parts of
    consecutive rows, so a very long list never becomes one record."""
    numbered = number_rows(pack_checks(results), ["list_id"], "ref_id", "position")
    part = (F.floor((F.col("position") - 1) / rows_per_part) + 1).cast("int")
    cols = [c for c in ("title", "verdict", "tier", "needs_human", "checks", "note") if c in numbered.columns]
    bodies = numbered.withColumn("part", part).groupBy("list_id", "part").agg(F.sort_array(F.collect_list(F.struct(
        F.col("position").alias("index"), F.to_json(F.struct("ref_id", *cols)).alias("row")))).alias("rows"))
    bodies = bodies.select("list_id", "part", F.concat(
        F.lit('{"results":['), F.array_join(F.transform("rows", lambda r: r["row"]), ","), F.lit("]}")).alias("record"))

    def packed(df, name):
        return df.select("list_id", F.struct(*[c for c in df.columns if c != "list_id"]).alias(name))

    head = packed(scorecard, "scorecard").join(packed(bluf, "bluf"), "list_id", "left").join(
        packed(profile, "bibliography_profile"), "list_id", "left")
    if audit is not None:
        head = head.join(packed(audit, "context_check"), "list_id", "left")
    heads = head.select("list_id", F.lit(0).alias("part"), F.to_json(F.struct(
        *[c for c in head.columns if c != "list_id"])).alias("record"))
    return heads.unionByName(bodies)


def trace_rows(results: DataFrame, scorecard: DataFrame, run_date: str, mode: str = "verify") -> DataFrame:
    """One ledger row per list and round."""
    policy = (F.count_if(F.col("policy_violation").isNotNull()) if "policy_violation" in results.columns
              else F.lit(0)).alias("n_policy")
    hits = results.groupBy("list_id").agg(policy)
    return scorecard.join(hits, "list_id").select(
        F.lit(run_date).alias("run_date"), F.lit(mode).alias("mode"), "list_id", "total", "score", "grade",
        *[c for c in scorecard.columns if c.startswith("n_")], "n_policy")


# --- writers ---------------------------------------------------------------------------------------

def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Text files ordered by list and row across and within files."""
    df.repartitionByRange("list_id", "ref_id").sortWithinPartitions("list_id", "ref_id").select(column).write.mode(
        "overwrite").text(path)


def export_bibtex(results: DataFrame, path: str) -> None:
    write_lines(bibtex_entries(results), "entry", path)


def export_gbt7714(results: DataFrame, path: str, cite_date: str) -> None:
    write_lines(gbt7714_lines(results, cite_date), "line", path)


def export_ris(results: DataFrame, path: str) -> None:
    write_lines(ris_records(results), "record", path)


def export_ledger_csv(results: DataFrame, path: str) -> None:
    ordered = results.repartitionByRange("list_id", "ref_id").sortWithinPartitions("list_id", "ref_id")
    ledger_rows(ordered).drop("list_id").write.mode("overwrite").option("header", True).option("quoteAll", True).option(
        "escape", '"').csv(path)


def export_workpaper(results: DataFrame, path: str) -> None:
    write_lines(workpaper(results), "record", path)


def write_batch_report(report: DataFrame, path: str) -> None:
    report.repartitionByRange("list_id", "part").sortWithinPartitions("list_id", "part").write.mode("overwrite").json(path)


def append_trace(trace: DataFrame, path: str) -> None:
    trace.write.mode("append").partitionBy("run_date").parquet(path)

"""Parsers over texts derived from the tables, and export texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger.fixtures import view
from refledger.operators import document, profile, score
from refledger.plans.queries.base import listed, query, refs, results
from refledger.plans.queries.lists import _BASE_KEY, SCORE_SQL, _V
from refledger.sources import exports, readers
from refledger.sources.bibtex import parse_bibtex
from refledger.sources.markdown import parse_markdown

# --- parsers: one text per reference, so that no group of rows has to be gathered -----------------------


def _json_texts(spark, sf) -> DataFrame:
    body = F.to_json(F.struct("title", "source", "year", "doi", "pmid", "arxiv", "url", "volume", "issue"))
    name = F.format_string("%012d.json", "ref_id")
    text = F.concat(F.lit("["), body, F.when(F.col("ref_id") % 10 == 0, F.lit(', "loose text"')).otherwise(""), F.lit("]"))
    return refs(spark, sf).select(name.alias("path"), text.alias("text"))


@query("s1_read_refs_json", """
SELECT ref_id AS file, 0 AS pos, title, source, CAST(year AS VARCHAR) AS year, doi, pmid, url, CAST(volume AS VARCHAR) AS volume, false AS malformed FROM fx_refs
UNION ALL SELECT ref_id, 1, 'loose text', NULL, NULL, NULL, NULL, NULL, NULL, true FROM fx_refs WHERE ref_id % 10 = 0""")
def s1(spark, sf):
    p = readers.parse_refs_json(_json_texts(spark, sf))
    return p.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("file"), F.col("pos").cast("int").alias("pos"),
                    "title", "source", "year", "doi", "pmid", "url", "volume", "malformed")


def _bib_texts(spark, sf) -> DataFrame:
    def field(name, value, quote=False):
        return F.when(value.isNotNull(), F.concat(
            F.lit(f"  {name} = "), F.lit('"' if quote else "{"), value, F.lit('",\n' if quote else "},\n")))

    safe = F.regexp_replace("title", r"[{}\"\\]", "")
    year = F.when(F.col("ref_id") % 2 == 0, F.concat(F.lit("  year = "), F.col("year").cast("string"), F.lit(",\n"))).otherwise(
        field("year", F.col("year").cast("string")))
    text = F.concat(
        F.lit("@comment{ignored, here}\n@article{k"), F.col("ref_id").cast("string"), F.lit(",\n"),
        F.concat_ws("", F.concat(F.lit("  title = {{"), safe, F.lit("}},\n")),
                    field("author", F.lit("Kim, Sun and Park, Ji")), field("journal", F.col("source"), True), year,
                    field("doi", F.col("doi")), field("eprint", F.col("arxiv")),
                    F.when(F.col("url").isNotNull(), F.concat(F.lit("  howpublished = {\\url{"), "url", F.lit("}},\n")))),
        F.lit("}\n"))
    return refs(spark, sf).select(F.format_string("%012d.bib", "ref_id").alias("path"), text.alias("text"))


@query("s2_ingest_bibtex", """
SELECT ref_id AS file, nullif(trim(regexp_replace(regexp_replace(title, '[{}"\\\\]', '', 'g'), '\\s+', ' ', 'g')), '') AS title, 'Kim, Sun, Park, Ji' AS authors, source,
  CAST(year AS VARCHAR) AS year, doi, arxiv, url FROM fx_refs""")
def s2(spark, sf):
    p = parse_bibtex(_bib_texts(spark, sf))
    return p.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("file"), "title", "authors", "source", "year",
                    "doi", "arxiv", "url")


def _md_texts(spark, sf) -> DataFrame:
    title = F.trim(F.regexp_replace(F.col("title"), r"[^\p{L}\p{N}]+", " "))
    line = F.concat(
        F.lit("[1] Kim S, Park J, et al. "), title, F.lit("[J]. Journal of "), "source", F.lit(", "), F.col("year").cast("string"),
        F.lit(", "), F.col("volume").cast("string"), F.lit("("), F.col("issue").cast("string"), F.lit("): 10-20."),
        F.when(F.col("pmid").isNotNull(), F.concat(F.lit(" PMID: "), "pmid", F.lit("."))).otherwise(""))
    text = F.concat(F.lit("# Body\n\nSome text [1].\n\n## References\n\n"), line, F.lit("\n"))
    return refs(spark, sf).select(F.format_string("%012d.md", "ref_id").alias("path"), text.alias("text"))


@query("s3_ingest_markdown_refs", """
SELECT ref_id AS file, t AS title, 'Journal of ' || source AS source, CAST(year AS VARCHAR) AS year, pmid, CAST(volume AS VARCHAR) AS volume, CAST(issue AS VARCHAR) AS issue, '10' AS pages
FROM (SELECT *, trim(regexp_replace(title, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM fx_refs) WHERE length(t) + 3 >= 15""")
def s3(spark, sf):
    p = parse_markdown(_md_texts(spark, sf))
    return p.select(F.regexp_extract("path", r"(\d+)", 1).cast("bigint").alias("file"), "title", "source", "year", "pmid",
                    "volume", "issue", "pages")


@query("s4_read_refs_dir", """
WITH f AS (SELECT printf('%012d.bib', ref_id) AS p, ref_id AS file, 0 AS k, nullif(trim(regexp_replace(regexp_replace(title, '[{}"\\\\]', '', 'g'), '\\s+', ' ', 'g')), '') AS title FROM fx_refs
  UNION ALL SELECT printf('%012d.json', ref_id), ref_id, 0, title FROM fx_refs UNION ALL SELECT printf('%012d.json', ref_id), ref_id, 1, 'loose text' FROM fx_refs WHERE ref_id % 10 = 0
  UNION ALL SELECT printf('%012d.md', ref_id), ref_id, 0, t FROM (SELECT ref_id, trim(regexp_replace(title, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM fx_refs) WHERE length(t) + 3 >= 15)
SELECT p AS path, row_number() OVER (ORDER BY p, k) AS ref_id, title FROM f""")
def s4(spark, sf):
    df = readers.combine_parts(readers.parse_refs_json(_json_texts(spark, sf)), parse_bibtex(_bib_texts(spark, sf)), parse_markdown(_md_texts(spark, sf)))
    return df.select("path", "ref_id", "title")


# --- exports --------------------------------------------------------------------------------------------------

_BIB_SAFE = "replace(replace(replace(replace({}, '{{', ''), '}}', ''), chr(13), ' '), chr(10), ' ')"


@query("k1_export_bibtex", f"""
WITH b AS (SELECT *, {_BASE_KEY} AS k FROM fx_results WHERE verdict = 'verified'),
n AS (SELECT *, row_number() OVER (PARTITION BY list_id, k ORDER BY ref_id) AS i FROM b),
c AS (SELECT *, CASE WHEN i = 1 THEN k ELSE concat(k, '_', CAST(i AS VARCHAR)) END AS cite_key, CASE WHEN trim({_BIB_SAFE.format('title')}) = '' THEN 'untitled' ELSE trim({_BIB_SAFE.format('title')}) END AS t FROM n)
SELECT list_id, ref_id, cite_key, '@misc{{' || cite_key || ',' || chr(10) || array_to_string(list_filter(['  title = {{' || t || '}}',
  CASE WHEN source <> '' THEN '  journal = {{' || source || '}}' END, CASE WHEN year IS NOT NULL THEN '  year = {{' || CAST(year AS VARCHAR) || '}}' END,
  CASE WHEN coalesce(url, '') <> '' THEN '  url = {{' || url || '}}' END, CASE WHEN coalesce(doi, '') <> '' THEN '  doi = {{' || doi || '}}' END,
  CASE WHEN arxiv IS NOT NULL THEN '  eprint = {{' || arxiv || '}}' END, CASE WHEN arxiv IS NOT NULL THEN '  archivePrefix = {{arXiv}}' END,
  '  note = {{verified' || CASE WHEN pmid IS NOT NULL THEN '; PMID: ' || pmid ELSE '' END || '}}'], lambda x: x IS NOT NULL), ',' || chr(10)) || '}}' || chr(10) AS entry FROM c""")
def k1(spark, sf):
    return exports.bibtex_entries(results(spark, sf))


_CITABLE = "verdict = 'verified' OR (verdict = 'partial' AND doi_matched AND doi_adjust = '' AND csl_title IS NOT NULL)"
_CSL = """b AS (SELECT *, CASE WHEN trim(coalesce(nullif(trim(csl_title), ''), title)) = '' THEN 'untitled' ELSE trim(coalesce(nullif(trim(csl_title), ''), title)) END AS t,
  CAST(coalesce(csl_year, year) AS VARCHAR) AS y, CASE WHEN csl_families IS NOT NULL THEN string_split(upper(csl_families), '|')
    ELSE list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: trim(x)), lambda x: x <> '') END AS names,
  arxiv IS NULL AND coalesce(csl_container, '') <> '' AS article FROM fx_results WHERE """ + _CITABLE + ")"


@query("k2_export_gbt7714", f"""
WITH {_CSL}, c AS (SELECT *, array_to_string(CASE WHEN len(names) > 3 THEN list_concat(list_slice(names, 1, 3), ['et al']) ELSE names END, ', ') AS who FROM b)
SELECT list_id, ref_id, concat_ws(' ', CASE WHEN who <> '' THEN who || '.' END, t || '[' || CASE WHEN article THEN 'J' ELSE 'EB/OL' END || '].',
  CASE WHEN article THEN csl_container || ', ' || y || CASE WHEN coalesce(csl_volume, '') <> '' THEN ', ' || csl_volume || CASE WHEN coalesce(csl_issue, '') <> '' THEN '(' || csl_issue || ')' ELSE '' END ELSE '' END
    || CASE WHEN coalesce(csl_page, '') <> '' THEN ': ' || csl_page ELSE '' END || '.' END,
  CASE WHEN NOT article THEN '(' || y || ').' END, CASE WHEN NOT article THEN '[2026-01-31].' END,
  CASE WHEN coalesce(doi, '') <> '' AND NOT starts_with(lower(coalesce(url, '')), 'https://doi.org/') THEN 'DOI: ' || doi || '.' END,
  CASE WHEN coalesce(url, '') <> '' THEN url || '.' END) AS line FROM c""")
def k2(spark, sf):
    return exports.gbt7714_lines(results(spark, sf), "2026-01-31")


@query("k3_export_ris", f"""
WITH {_CSL}
SELECT list_id, ref_id, array_to_string(list_filter(list_concat(['TY  - ' || CASE WHEN coalesce(csl_container, '') <> '' THEN 'JOUR' ELSE 'GEN' END, 'TI  - ' || t],
  list_transform(names, lambda x: 'AU  - ' || x), [CASE WHEN coalesce(csl_container, '') <> '' THEN 'JO  - ' || csl_container END, CASE WHEN source <> '' THEN 'PB  - ' || source END, 'PY  - ' || y,
  CASE WHEN coalesce(csl_volume, '') <> '' THEN 'VL  - ' || csl_volume END, CASE WHEN coalesce(csl_issue, '') <> '' THEN 'IS  - ' || csl_issue END,
  CASE WHEN coalesce(csl_page, '') <> '' THEN 'SP  - ' || split_part(csl_page, '-', 1) END, CASE WHEN contains(coalesce(csl_page, ''), '-') THEN 'EP  - ' || split_part(csl_page, '-', 2) END,
  CASE WHEN coalesce(doi, '') <> '' THEN 'DO  - ' || doi END, CASE WHEN coalesce(url, '') <> '' THEN 'UR  - ' || url END, 'N1  - registry check: ' || verdict, 'ER  - ']), lambda x: x IS NOT NULL), chr(10)) || chr(10) AS record FROM b""")
def k3(spark, sf):
    return exports.ris_records(results(spark, sf))


def _safe(c: str) -> str:
    v = f"coalesce(CAST({c} AS VARCHAR), '')"
    return f"CASE WHEN regexp_matches({v}, '^[=+@\\t\\r-]') THEN '''' || {v} ELSE {v} END AS {{}}"


@query("k4_export_ledger_csv", "SELECT list_id, " + ", ".join(
    _safe({"index": "ref_id", "needs_human_check": "needs_human"}.get(c, c)).format(c) for c in exports.LEDGER) + " FROM fx_results")
def k4(spark, sf):
    return exports.ledger_rows(results(spark, sf))


@query("k5_export_workpaper")
def k5(spark, sf):
    return exports.workpaper(results(spark, sf)).select("list_id", "ref_id", F.md5(F.col("record").cast("binary")).alias("digest"))


@query("k6_write_batch_report", """
SELECT list_id, 0 AS part, 0::BIGINT AS n_rows FROM fx_results GROUP BY list_id
UNION ALL SELECT list_id, CAST((p - 1) // 10 + 1 AS INTEGER), count(*) FROM (SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY ref_id) AS p FROM fx_results) GROUP BY 1, 2""")
def k6(spark, sf):
    r = results(spark, sf)
    prof = profile.profile_bibliography(refs(spark, sf), 2026)
    docs = view(spark, sf, "fx_docs_marked")
    entries = listed(spark, sf)
    audit = document.document_audit(docs, entries).groupBy("list_id").agg(
        F.sum("n_citations").alias("n_citations"), F.sum("n_unbound").alias("n_unbound"))
    rep = exports.batch_report(r, prof, score.scorecard(r), score.bluf(r), rows_per_part=10, audit=audit)
    n = F.size(F.from_json("record", "struct<results:array<struct<ref_id:bigint>>>")["results"])
    return rep.select("list_id", "part", F.when(F.col("part") == 0, F.lit(0)).otherwise(n).cast("bigint").alias("n_rows"))


@query("k7_append_trace", SCORE_SQL.format(src="fx_results") + f"""
SELECT '2026-01-31' AS run_date, 'verify' AS mode, c.list_id, total, score, grade, {_V}, p.n AS n_policy
FROM card c JOIN (SELECT list_id, count(policy_violation) AS n FROM fx_results GROUP BY 1) p ON p.list_id = c.list_id""")
def k7(spark, sf):
    r = results(spark, sf)
    return exports.trace_rows(r, score.scorecard(r), "2026-01-31")

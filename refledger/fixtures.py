"""Derived input tables.

The driver tables hold no bibliographic data, so these views derive it from them with integer
arithmetic.  One SQL text per view serves both engines: Spark reads it here, DuckDB in the oracles.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from refledger.session import cut_lineage

DRIVER_TABLES = ["benchmark", "conversations", "documents", "embeddings", "events", "labels", "pages"]

VIEWS: dict[str, str] = {}

VIEWS["fx_refs"] = """
WITH b AS (
 SELECT doc_id, source, lang, text,
   CAST(floor(doc_id / 25.0) AS BIGINT) AS list_id,
   trim(regexp_extract(replace(text, chr(10), ' '), '^ *([^.]{1,120})', 1)) AS title
 FROM documents)
SELECT list_id, doc_id AS ref_id, title, source, CAST(1985 + doc_id % 45 AS INT) AS year,
  CASE WHEN doc_id % 7 = 0 THEN NULL
       WHEN doc_id % 31 = 0 THEN concat('doi:bad/', CAST(doc_id AS STRING))
       WHEN list_id % 5 = 0 THEN concat('10.5555/batch', lpad(CAST(list_id AS STRING),4,'0'), lpad(CAST(doc_id AS STRING),7,'0'))
       WHEN doc_id % 29 = 1 THEN concat('10.5555/j', CAST((doc_id - 1) * 37 AS STRING), 'x')
       ELSE concat('10.5555/j', CAST(doc_id * 37 AS STRING), 'x') END AS doi,
  CASE WHEN doc_id % 3 = 0 THEN CAST(1000000 + doc_id AS STRING) END AS pmid,
  CASE WHEN doc_id % 10 = 4 THEN concat('24', lpad(CAST(1 + doc_id % 14 AS STRING),2,'0'), '.', lpad(CAST(doc_id % 100000 AS STRING),5,'0')) END AS arxiv,
  CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 2 THEN NULL
       ELSE concat('https://', CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'arxiv.org' WHEN 1 THEN 'www.nature.com' WHEN 2 THEN 'github.com'
         WHEN 3 THEN 'x.com' WHEN 4 THEN 'www.reuters.com' WHEN 5 THEN 'blog.example.org' WHEN 6 THEN 'cs.stanford.edu'
         WHEN 7 THEN 'www.cnki.net' ELSE 'journals.example.com' END, '/p/', CAST(doc_id AS STRING), '/') END AS url,
  1 + doc_id % 40 AS volume, 1 + doc_id % 12 AS issue,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 7 END AS page
FROM b
"""

VIEWS["fx_works"] = """
SELECT doi, CASE WHEN ref_id % 13 = 0 THEN concat('unrelated registered record ', CAST(ref_id AS STRING))
    WHEN ref_id % 11 = 0 THEN concat(title, ' revised edition') ELSE title END AS title,
  source AS container, year + CASE WHEN ref_id % 4 = 0 THEN 2 ELSE 0 END AS year,
  CASE WHEN ref_id % 23 = 0 THEN 'transport_failed' WHEN ref_id % 17 = 0 THEN 'not_found' ELSE 'hit' END AS lookup_status
FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY ref_id) AS rn FROM fx_refs WHERE doi LIKE '10.%') t WHERE rn = 1
"""

VIEWS["fx_pubmed"] = """
SELECT pmid, title, source AS ta, year, volume, issue, coalesce(page, ref_id % 7) AS page,
  CASE WHEN ref_id % 5 = 0 THEN concat('10.9999/other', CAST(ref_id AS STRING)) WHEN ref_id % 8 = 0 THEN NULL ELSE doi END AS doi,
  CASE WHEN ref_id % 21 = 0 THEN 'not_found' ELSE 'hit' END AS lookup_status
FROM fx_refs WHERE pmid IS NOT NULL
"""

VIEWS["fx_openalex"] = """
SELECT ref_id AS rank_id, title AS display_name, year + CASE WHEN ref_id % 6 = 0 THEN 3 ELSE 0 END AS publication_year,
  CASE WHEN ref_id % 8 = 0 THEN NULL ELSE doi END AS doi, ref_id * 7 % 500 AS cited_by_count,
  CASE WHEN ref_id % 3 = 0 THEN 'repository' ELSE 'journal' END AS source_type FROM fx_refs
"""

_NOTICE = """SELECT lower(doi) AS doi, ref_id * 2 + {k} AS line_no, CASE CAST((ref_id + {k} * 3) % 6 AS INT) WHEN 0 THEN 'Retraction' WHEN 1 THEN 'Expression of concern'
   WHEN 2 THEN 'Correction' WHEN 3 THEN 'Partial Retraction' WHEN 4 THEN 'Withdrawal' ELSE '' END AS nature
FROM fx_refs WHERE doi IS NOT NULL AND ref_id % 9 = 2"""
VIEWS["fx_notices"] = " UNION ALL ".join(_NOTICE.format(k=k) for k in (0, 1))

VIEWS["fx_probes"] = """
SELECT event_id AS probe_id, concat('h', CAST(user_id AS STRING)) AS host, ts,
  CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 200 WHEN 'click' THEN 403 WHEN 'signup' THEN 404 ELSE 429 END AS http_status,
  CASE WHEN event_type = 'error' THEN 'timeout' END AS error_kind FROM events
"""

VIEWS["fx_citations"] = """
SELECT conv_id AS cited_id, turn AS edge_pos, CASE WHEN length(text) > 400 THEN text END AS context,
  CASE CAST(turn % 3 AS INT) WHEN 0 THEN 'background' WHEN 1 THEN 'methodology' ELSE 'result' END AS intent, turn % 5 = 0 AS influential
FROM conversations
"""

VIEWS["fx_docs_marked"] = """
SELECT doc_id, CAST(floor(doc_id / 25.0) AS BIGINT) AS list_id,
  concat(text, ' [', CAST(1 + doc_id % 30 AS STRING), ']. See [', CAST(1 + doc_id % 5 AS STRING), '-', CAST(3 + doc_id % 5 AS STRING), '].') AS text FROM documents
"""

VIEWS["fx_labels"] = """
SELECT doc_id AS ref_id, CASE WHEN toxic = 1 THEN 'planted' ELSE 'clean' END AS expected,
  CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'invalid' WHEN 1 THEN 'partial' WHEN 2 THEN 'verified' WHEN 3 THEN 'unreachable' ELSE 'unverified' END AS verdict FROM labels
"""

VIEWS["fx_votes"] = """
SELECT doc_id AS ref_id, CASE WHEN quality = 1 THEN 'SUPPORTS' ELSE 'CONTRADICTS' END AS judge,
  CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'entailment' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'neutral' END AS nli,
  CAST(doc_id % 100 AS DOUBLE) / 100.0 AS prob FROM labels
"""

VIEWS["fx_landing"] = """
SELECT page_id, url, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '/+$', '') AS url_key,
  regexp_extract(html, '<title>([^<]*)</title>', 1) AS page_title FROM pages
"""

# --- registries the base views do not cover -------------------------------------------------
VIEWS["fx_records"] = """
SELECT *, CASE WHEN ref_id % 6 = 0 THEN NULL
    ELSE concat('Smith', CAST(ref_id % 17 AS STRING), ' J, Zhang', CAST(ref_id % 5 AS STRING), ' W') END AS authors
FROM fx_refs
"""

VIEWS["fx_csl"] = """
SELECT w.doi, w.title, CASE WHEN r.ref_id % 10 = 3 THEN 'Annals of Nothing' ELSE w.container END AS container,
  w.year, CASE WHEN r.ref_id % 4 = 1 THEN NULL ELSE CAST(r.volume AS STRING) END AS volume,
  CASE WHEN r.ref_id % 3 = 1 THEN NULL ELSE CAST(r.issue AS STRING) END AS issue,
  CASE WHEN r.page IS NULL THEN NULL ELSE concat(CAST(r.page AS STRING), '-', CAST(r.page + 9 AS STRING)) END AS page,
  CASE WHEN r.ref_id % 14 = 5 THEN 'Nobody' WHEN r.ref_id % 12 = 7 THEN NULL
    WHEN r.ref_id % 5 = 0 THEN concat('Smith', CAST(r.ref_id % 17 AS STRING), '|Lee|Kim|Wu')
    ELSE concat('Smith', CAST(r.ref_id % 17 AS STRING), '|Lee') END AS families,
  w.lookup_status
FROM fx_works w JOIN (
  SELECT *, row_number() OVER (PARTITION BY doi ORDER BY ref_id) AS rn FROM fx_refs WHERE doi LIKE '10.%') r
  ON r.doi = w.doi AND r.rn = 1
"""

VIEWS["fx_arxiv"] = """
SELECT arxiv AS arxiv_key,
  CASE WHEN ref_id % 8 = 2 THEN concat('another registered preprint ', CAST(ref_id AS STRING)) ELSE title END AS title,
  CAST(year + CASE WHEN ref_id % 3 = 0 THEN 2 ELSE 0 END AS INT) AS year, CAST(1 + ref_id % 4 AS INT) AS latest_version,
  CASE WHEN ref_id % 9 = 1 THEN 'not_found' WHEN ref_id % 9 = 5 THEN 'transport_failed' ELSE 'hit' END AS lookup_status
FROM (SELECT *, row_number() OVER (PARTITION BY arxiv ORDER BY ref_id) AS rn FROM fx_refs WHERE arxiv IS NOT NULL) t
WHERE rn = 1
"""

VIEWS["fx_s2"] = """
SELECT ref_id AS paper_id, CASE WHEN ref_id % 5 = 0 THEN concat(title, ' extended') ELSE title END AS title, year,
  CASE WHEN ref_id % 2 = 0 THEN concat('10.7777/pub', CAST(ref_id AS STRING)) ELSE doi END AS doi, arxiv AS arxiv_key,
  concat('Venue of ', source) AS venue
FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(doi, concat('row ', CAST(ref_id AS STRING))) ORDER BY ref_id) AS rn,
        row_number() OVER (PARTITION BY coalesce(arxiv, concat('row ', CAST(ref_id AS STRING))) ORDER BY ref_id) AS ra FROM fx_refs) t
WHERE rn = 1 AND ra = 1
"""

VIEWS["fx_oa"] = """
SELECT doi, year % 2 = 0 AS is_oa, CASE WHEN year % 2 = 0 THEN 'cc-by' END AS license,
  CASE WHEN year % 2 = 0 THEN concat('https://oa.example.org/', doi) END AS oa_url
FROM fx_works WHERE year % 3 < 2
"""

VIEWS["fx_resolved"] = """
SELECT ref_id, list_id, coalesce(url, CASE WHEN doi LIKE '10.%' THEN concat('https://doi.org/', doi) END,
    CASE WHEN CAST(substr(arxiv, 3, 2) AS INT) BETWEEN 1 AND 12 THEN concat('https://arxiv.org/abs/', arxiv) END,
    CASE WHEN pmid IS NOT NULL THEN concat('https://pubmed.ncbi.nlm.nih.gov/', pmid, '/') END) AS resolved_url
FROM fx_refs
"""

_PROBE = """SELECT resolved_url AS url, ref_id * 2 + {k} AS probe_id,
  CASE WHEN (ref_id + {k}) % 20 = 0 THEN NULL WHEN (ref_id + {k}) % 20 = 1 THEN 404 WHEN (ref_id + {k}) % 20 < 5 THEN 403
    WHEN (ref_id + {k}) % 20 = 5 THEN 429 WHEN (ref_id + {k}) % 20 = 6 THEN 500 ELSE 200 END AS http_status,
  CASE WHEN (ref_id + {k}) % 20 = 0 THEN 'timeout' END AS error_kind
FROM fx_resolved WHERE resolved_url IS NOT NULL AND ref_id % 50 <> 49"""
VIEWS["fx_url_probes"] = " UNION ALL ".join(_PROBE.format(k=k) for k in (0, 1))

VIEWS["fx_archives"] = """
SELECT url, probe_id AS snapshot_id, concat('https://web.archive.example/', CAST(probe_id AS STRING)) AS archive_url
FROM fx_url_probes WHERE probe_id % 3 <> 0
"""

VIEWS["fx_claims"] = """
SELECT d.doc_id, b.text AS claim
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
"""

# --- one verified batch, for the operators that work on results -----------------------------
VIEWS["fx_results"] = """
SELECT r.list_id, r.ref_id, r.title, r.source, r.year, r.doi, r.pmid, r.arxiv, r.authors,
  coalesce(r.url, CASE WHEN r.doi LIKE '10.%' THEN concat('https://doi.org/', r.doi) END) AS url,
  r.verdict, CASE r.ref_id % 8 WHEN 0 THEN 'official' WHEN 1 THEN 'journal' WHEN 2 THEN 'preprint' WHEN 3 THEN 'media'
    WHEN 4 THEN 'community' WHEN 5 THEN 'social' WHEN 6 THEN 'blog' ELSE 'unknown' END AS tier,
  CASE WHEN r.ref_id % 9 = 0 THEN NULL WHEN r.verdict = 'unreachable' THEN 404 ELSE 200 END AS http_status,
  r.verdict IN ('unreachable', 'unverified') OR r.ref_id % 10 = 0 AS needs_human,
  concat('note  ', CAST(r.ref_id AS STRING)) AS note,
  CASE WHEN r.verdict = 'invalid' AND r.ref_id % 2 = 0 THEN 'not_found' WHEN c.doi IS NOT NULL THEN c.lookup_status END AS doi_state,
  c.lookup_status IS NOT NULL AND c.lookup_status = 'hit' AS doi_matched,
  CASE WHEN r.verdict = 'invalid' THEN 'invalid' WHEN r.ref_id % 5 = 1 THEN 'partial' ELSE '' END AS doi_adjust,
  r.ref_id % 25 = 3 AS cross_language, r.verdict = 'invalid' AND r.ref_id % 3 = 0 AS stitched,
  CASE WHEN r.verdict = 'invalid' AND r.arxiv IS NOT NULL THEN 'not_found' END AS arxiv_state,
  r.arxiv IS NOT NULL AND r.verdict = 'verified' AS arxiv_matched,
  CASE WHEN r.verdict = 'invalid' AND r.pmid IS NOT NULL THEN 'not_found' END AS pmid_state,
  r.ref_id % 13 = 2 AND r.verdict <> 'verified' AS retracted,
  CASE WHEN r.ref_id % 13 = 2 AND r.verdict <> 'verified' THEN 'retraction' WHEN r.ref_id % 17 = 4 THEN 'expression_of_concern' END AS retraction_nature,
  r.ref_id % 19 = 5 AS author_mismatch, r.ref_id % 23 = 6 AS journal_mismatch,
  r.ref_id % 7 = 0 AS openalex_confirmed, r.ref_id % 11 = 0 AS s2_matched,
  r.verdict <> 'unreachable' AS reachable, r.ref_id % 31 = 0 AS offline,
  CASE WHEN r.verdict = 'unreachable' AND r.ref_id % 2 = 0 THEN concat('https://web.archive.example/', CAST(r.ref_id AS STRING)) END AS archive_url,
  CASE WHEN c.lookup_status = 'hit' THEN c.title END AS csl_title, CASE WHEN c.lookup_status = 'hit' THEN c.container END AS csl_container,
  CASE WHEN c.lookup_status = 'hit' THEN c.year END AS csl_year, CASE WHEN c.lookup_status = 'hit' THEN c.volume END AS csl_volume,
  CASE WHEN c.lookup_status = 'hit' THEN c.issue END AS csl_issue, CASE WHEN c.lookup_status = 'hit' THEN c.page END AS csl_page,
  CASE WHEN c.lookup_status = 'hit' THEN c.families END AS csl_families,
  CASE WHEN r.ref_id % 21 = 0 THEN 'deny_domain' END AS policy_violation,
  CASE WHEN c.lookup_status = 'hit' AND r.ref_id % 4 < 3 THEN r.ref_id % 4 = 0 END AS is_oa,
  CASE r.ref_id % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'NOT_in_source' WHEN 2 THEN 'contradicted' WHEN 3 THEN 'maybe'
    WHEN 4 THEN 'unclear' END AS support
FROM (SELECT *, CASE WHEN list_id % 4 = 0 THEN 'verified' WHEN list_id % 4 = 1 AND ref_id % 3 > 0 THEN 'verified'
    WHEN list_id % 4 = 1 THEN 'partial' WHEN ref_id % 11 < 5 THEN 'verified' WHEN ref_id % 11 < 7 THEN 'partial'
    WHEN ref_id % 11 < 8 THEN 'unreachable' WHEN ref_id % 11 < 9 AND list_id % 4 = 2 THEN 'invalid' ELSE 'unverified' END AS verdict
  FROM fx_records) r
LEFT JOIN fx_csl c ON c.doi = r.doi
"""

# references of which some repeat the one before, its title or its DOI, with semantic findings
VIEWS["fx_batch"] = """
SELECT a.list_id, a.ref_id, CASE WHEN b.ref_id IS NOT NULL AND a.ref_id % 8 IN (3, 5) THEN b.title ELSE a.title END AS title, a.source, a.year,
  CASE WHEN b.ref_id IS NOT NULL AND a.ref_id % 8 IN (5, 7) THEN b.doi ELSE a.doi END AS doi,
  CASE WHEN b.ref_id IS NOT NULL AND a.ref_id % 8 = 5 THEN b.pmid ELSE a.pmid END AS pmid, a.arxiv,
  CASE WHEN b.ref_id IS NOT NULL AND a.ref_id % 8 = 5 THEN b.url ELSE a.url END AS url, a.volume, a.issue, a.page, a.authors,
  CASE CAST(a.ref_id % 6 AS INT) WHEN 0 THEN 'supported' WHEN 1 THEN 'not_in_source' WHEN 2 THEN 'contradicted' WHEN 4 THEN 'unclear' END AS support
FROM fx_records a LEFT JOIN fx_records b ON b.list_id = a.list_id AND b.ref_id = a.ref_id - 1
"""

VIEWS["fx_cites"] = """
SELECT r.doi AS cited_doi, c.edge_pos, c.context, concat('citing paper ', CAST(c.edge_pos AS STRING)) AS citing_title
FROM fx_citations c JOIN fx_refs r ON r.ref_id = c.cited_id WHERE r.doi IS NOT NULL
"""

_NAME = re.compile(r"\b(fx_\w+|" + "|".join(DRIVER_TABLES) + r")\b")


def required(sql: str) -> list[str]:
    """Views ``sql`` needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs (driver tables stay external)."""
    body = sql.strip()
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in required(body)]
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body.startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written_refs(spark: SparkSession, sf_dir: str) -> str:
    """Name of a temporary view with the rows of ``fx_refs``, written once: nearly every other view begins with them, and
    each would read all texts for the titles again."""
    name = f"written_{uuid.uuid4().hex}"
    cut_lineage(view(spark, sf_dir, "fx_refs")).createOrReplaceTempView(name)
    return name


def view(spark: SparkSession, sf_dir: str, name: str, written: str | None = None) -> DataFrame:
    """A derived view (or driver table) as a DataFrame.  ``written``: where the rows of ``fx_refs`` are already."""
    if name not in VIEWS:
        return driver_table(spark, sf_dir, name)
    text = with_views(f"SELECT * FROM {name}")
    if written is not None:
        text = text.replace(f"fx_refs AS ({VIEWS['fx_refs'].strip()})", f"fx_refs AS (SELECT * FROM {written})")
    for table in dict.fromkeys(t for t in _NAME.findall(text) if t in DRIVER_TABLES):
        text = re.sub(rf"\b(FROM|JOIN) {table}\b", rf"\1 parquet.`{sf_dir}/{table}.parquet`", text)
    return spark.sql(text)

"""Registry joins and the verdict operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.fixtures import view, written_refs
from refledger.functions.similarity import TOKEN
from refledger.operators import discover as dc
from refledger.operators import fuzzy, match, normalise, profile, score
from refledger.plans.queries.base import (
    NORMAL_SQL, in_sql, jaccard_sql, q, query, refs, registries, results, title_key_sql, tokens_sql,
    url_key_sql, works)
from refledger.plans.verify import verify, with_notes
from refledger.session import cut_lineage
from refledger.sources import readers


def _norm(spark, sf) -> DataFrame:
    return normalise.normalise_refs(refs(spark, sf))


# --- registry snapshots --------------------------------------------------------------------------------

@query("s5_read_registry", """
SELECT 'works' AS registry, lookup_status, count(*) AS n FROM fx_works GROUP BY 2
UNION ALL SELECT 'pubmed', lookup_status, count(*) FROM fx_pubmed GROUP BY 2
UNION ALL SELECT 'arxiv', lookup_status, count(*) FROM fx_arxiv GROUP BY 2""")
def s5(spark, sf):
    out = None
    for name, fx in (("works", "fx_works"), ("pubmed", "fx_pubmed"), ("arxiv", "fx_arxiv")):
        df = readers.registry_states(readers.unique_registry(view(spark, sf, fx), name)).withColumn("registry", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


_PRIO = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in fv.NOTICE_PRIORITY.items())
NOTICE_SQL = f"""notice AS (SELECT doi, nature FROM (SELECT doi, CASE WHEN trim(nature) = '' THEN 'Retraction' ELSE trim(nature) END AS nature, line_no,
  row_number() OVER (PARTITION BY doi ORDER BY CASE lower(CASE WHEN trim(nature) = '' THEN 'Retraction' ELSE trim(nature) END) {_PRIO} ELSE 1 END DESC, line_no) AS rn
  FROM fx_notices WHERE doi <> '') WHERE rn = 1),
notice_class AS (SELECT doi, CASE replace(lower(nature), ' ', '_') WHEN 'retraction' THEN 'retraction' WHEN 'partial_retraction' THEN 'partial_retraction'
  WHEN 'withdrawal' THEN 'withdrawal' WHEN 'expression_of_concern' THEN 'expression_of_concern' WHEN 'correction' THEN 'correction' END AS nature FROM notice)
"""


@query("s6_build_retraction_index", "WITH " + NOTICE_SQL + "SELECT doi, nature FROM notice")
def s6(spark, sf):
    return match.build_retraction_index(view(spark, sf, "fx_notices")).select("doi", "nature")


# --- DOI record -------------------------------------------------------------------------------------------

def _doi_sql(src: str, key: str, name: str) -> str:
    """Columns of the DOI check (token similarity) for rows of ``src`` keyed by ``key``."""
    letters = "[a-z0-9]+|[一-鿿]"
    return f"""
{name}_j AS (SELECT n.*, w.title AS w_title, w.container AS w_container, w.year AS w_year, w.families,
  CASE WHEN {key} IS NOT NULL THEN coalesce(w.lookup_status, 'unknown') END AS doi_state
  FROM {src} n LEFT JOIN fx_csl w ON lower(w.doi) = {key}),
{name}_k AS (SELECT *, CASE WHEN doi_state = 'hit' AND clean_title <> '' THEN {jaccard_sql(tokens_sql('clean_title'), tokens_sql('w_title'))} END AS doi_sim,
  list_transform(regexp_extract_all(lower(source), '{letters}'), lambda x: x[1]) AS si,
  list_transform(regexp_extract_all(lower(w_container), '{letters}'), lambda x: x[1]) AS wi,
  regexp_replace(lower(source), '[^a-z0-9一-鿿]+', '', 'g') AS sk, regexp_replace(lower(w_container), '[^a-z0-9一-鿿]+', '', 'g') AS wk,
  list_filter(list_transform(string_split(coalesce(authors, ''), ','), lambda x: regexp_replace(lower(regexp_extract(trim(x), '^(\\S+)', 1)), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS ca,
  list_filter(list_transform(string_split(coalesce(families, ''), '|'), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')), lambda x: x <> '') AS ra
  FROM {name}_j),
{name}_m AS (SELECT *, coalesce(doi_state = 'hit', false) AS doi_matched,
  coalesce(doi_state = 'hit' AND coalesce(w_container, '') <> '' AND coalesce(source, '') <> '' AND NOT (sk = '' OR wk = '' OR contains(sk, wk) OR contains(wk, sk)
    OR array_to_string(wi, '') LIKE concat('%', array_to_string(si, '%'), '%') OR array_to_string(si, '') LIKE concat('%', array_to_string(wi, '%'), '%')), false) AS journal_mismatch,
  coalesce(doi_state = 'hit' AND len(ca) > 0 AND len(ra) > 0 AND len(list_filter(ca, lambda x: len(list_filter(ra, lambda y: x = y
    OR (length(x) >= 2 AND length(y) >= 2 AND (contains(x, y) OR contains(y, x))))) > 0)) = 0, false) AS author_mismatch,
  coalesce(doi_state = 'hit' AND abs(year - w_year) >= 2, false) AS doi_year_gap FROM {name}_k),
{name} AS (SELECT *, CASE WHEN doi_state = 'not_found' THEN 'invalid' WHEN NOT doi_matched THEN ''
    WHEN clean_title = '' THEN CASE WHEN journal_mismatch OR author_mismatch THEN 'partial' ELSE '' END
    WHEN doi_sim < 0.5 THEN 'invalid' WHEN doi_sim < 0.82 THEN 'partial'
    WHEN journal_mismatch OR author_mismatch THEN 'partial' ELSE '' END AS doi_adjust,
  CASE WHEN doi_matched THEN CASE WHEN clean_title = '' OR doi_sim < 0.5 THEN 'exact' WHEN doi_sim < 0.68 THEN 'major' WHEN doi_sim < 0.82 THEN 'minor'
    WHEN journal_mismatch OR author_mismatch THEN 'minor' ELSE 'exact' END END AS doi_fidelity FROM {name}_m)"""


DOI_COLUMNS = ["ref_id", "doi_state", "doi_sim", "doi_matched", "doi_adjust", "doi_fidelity", "doi_year_gap",
               "journal_mismatch", "author_mismatch"]


@query("j1_match_doi", NORMAL_SQL + "," + _doi_sql("norm", "doi_norm", "d") + " SELECT " + ", ".join(
    f"round({c}, 6) AS {c}" if c == "doi_sim" else c for c in DOI_COLUMNS) + " FROM d")
def j1(spark, sf):
    df = match.match_doi(_norm(spark, sf), works(spark, sf), TOKEN)
    return df.withColumn("doi_sim", F.round("doi_sim", 6)).select(*DOI_COLUMNS)


@query("j1_match_doi_sequence")
def j1_sequence(spark, sf):
    landing = match.landing_titles(view(spark, sf, "pages"))
    df = match.match_doi(_norm(spark, sf), works(spark, sf), landing=landing, openalex=view(spark, sf, "fx_openalex"))
    return df.withColumn("doi_sim", F.round("doi_sim", 6)).select(*DOI_COLUMNS, "cross_language", "doi_bridge")


# --- PubMed -------------------------------------------------------------------------------------------------

def _prefixed(short: str, long: str) -> str:
    return f"len({short}) > 0 AND (' ' || array_to_string({long}, ' ')) LIKE ('% ' || array_to_string({short}, '% ') || '%')"


def _pmid_sql(src: str, name: str) -> str:
    stop = in_sql(fv.JOURNAL_STOP)
    toks = "regexp_extract_all(lower({}), '[a-z0-9]+|[一-鿿]')"
    a, b = toks.format("source"), toks.format("p_ta")
    short = f"list_filter(CASE WHEN len({a}) <= len({b}) THEN {a} ELSE {b} END, lambda x: x NOT IN {stop})"
    long = f"list_filter(CASE WHEN len({a}) <= len({b}) THEN {b} ELSE {a} END, lambda x: x NOT IN {stop})"
    bare = "regexp_replace(lower({}), '[^a-z0-9一-鿿]+', '', 'g')"
    sk, pk = bare.format("source"), bare.format("p_ta")
    return f"""
{name}_j AS (SELECT n.*, p.title AS p_title, p.ta AS p_ta,
  CASE WHEN n.pm_key <> '' THEN coalesce(p.lookup_status, 'unknown') END AS pmid_state
  FROM (SELECT *, coalesce(regexp_extract(resolved_url, {q(fv.PUBMED_URL)}, 1), '') AS pm_key FROM {src}) n LEFT JOIN fx_pubmed p ON p.pmid = n.pm_key),
{name}_k AS (SELECT *, CASE WHEN pmid_state = 'hit' AND clean_title <> '' THEN {jaccard_sql(tokens_sql('clean_title'), tokens_sql('p_title'))} END AS pmid_sim,
  coalesce(source, '') <> '' AND coalesce(p_ta, '') <> '' AND NOT ({sk} = '' OR {pk} = '' OR contains({sk}, {pk}) OR contains({pk}, {sk}) OR ({_prefixed(short, long)})) AS p_journal_off FROM {name}_j),
{name} AS (SELECT *, CASE WHEN pmid_state = 'not_found' THEN 'invalid' WHEN coalesce(pmid_state, '') <> 'hit' THEN '' WHEN pmid_sim < 0.5 THEN 'invalid'
  WHEN pmid_sim < 0.82 THEN 'partial' WHEN p_journal_off THEN 'partial' ELSE '' END AS pmid_adjust,
  coalesce(pmid_state = 'hit' AND pmid_sim >= 0.82, false) AS pmid_matched FROM {name}_k)"""


@query("j2_match_pmid", NORMAL_SQL + "," + _pmid_sql("norm", "m") + """
SELECT ref_id, pmid_state, round(pmid_sim, 6) AS pmid_sim, pmid_adjust, pmid_matched FROM m WHERE pmid_state IS NOT NULL""")
def j2(spark, sf):
    df = match.match_pmid(_norm(spark, sf), view(spark, sf, "fx_pubmed"), TOKEN).filter("pmid_state is not null")
    return df.select("ref_id", "pmid_state", F.round("pmid_sim", 6).alias("pmid_sim"), "pmid_adjust", "pmid_matched")


@query("j2_match_pmid_sequence")
def j2_sequence(spark, sf):
    landing = match.landing_titles(view(spark, sf, "pages"))
    df = match.match_pmid(_norm(spark, sf), view(spark, sf, "fx_pubmed"), landing=landing,
                          openalex=view(spark, sf, "fx_openalex")).filter("pmid_state is not null")
    return df.select("ref_id", "pmid_state", F.round("pmid_sim", 6).alias("pmid_sim"), "pmid_adjust", "pmid_matched")


def _arxiv_sql(src: str, name: str, when: str) -> str:
    lat = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[0-9a-z]+')), lambda x: x NOT IN " + in_sql(fv.ALIAS_STOP_API) + ")"
    u, r = lat.format("clean_title"), lat.format("a_title")
    return f"""
{name}_j AS (SELECT n.*, trim(regexp_replace(a.title, '\\s+', ' ', 'g')) AS a_title, a.year AS a_year, a.latest_version,
  CASE WHEN n.arxiv_id IS NOT NULL AND {when} THEN coalesce(a.lookup_status, 'unknown') END AS arxiv_state
  FROM {src} n LEFT JOIN fx_arxiv a ON a.arxiv_key = lower(regexp_replace(n.arxiv_id, '(?i)v\\d+$', '')) AND {when}),
{name}_k AS (SELECT *, CASE WHEN arxiv_state = 'hit' AND clean_title <> '' THEN {jaccard_sql(tokens_sql('clean_title'), tokens_sql('a_title'))} END AS arxiv_sim FROM {name}_j),
{name} AS (SELECT *, coalesce(arxiv_state = 'hit', false) AS arxiv_matched, CASE WHEN arxiv_state = 'not_found' THEN 'invalid' WHEN coalesce(arxiv_state, '') <> 'hit' OR clean_title = '' THEN ''
  WHEN arxiv_sim < 0.5 AND len({u}) >= 2 AND list_has_all({r}, {u}) THEN 'partial'
  WHEN arxiv_sim < 0.5 THEN 'invalid' WHEN arxiv_sim < 0.82 THEN 'partial' ELSE '' END AS arxiv_adjust FROM {name}_k)"""


@query("j3_match_arxiv", NORMAL_SQL + "," + _arxiv_sql("norm", "x", "true") + """
SELECT ref_id, arxiv_state, round(arxiv_sim, 6) AS arxiv_sim, arxiv_adjust, arxiv_matched,
  CASE WHEN arxiv_state = 'hit' AND latest_version > 1 THEN 'version_unpinned' END AS arxiv_version_note,
  coalesce(arxiv_state = 'hit' AND abs(year - a_year) >= 2, false) AS arxiv_year_gap FROM x WHERE arxiv_state IS NOT NULL""")
def j3(spark, sf):
    df = match.match_arxiv(_norm(spark, sf), view(spark, sf, "fx_arxiv"), TOKEN).filter("arxiv_state is not null")
    return df.select("ref_id", "arxiv_state", F.round("arxiv_sim", 6).alias("arxiv_sim"), "arxiv_adjust", "arxiv_matched",
                     "arxiv_version_note", "arxiv_year_gap")


@query("j3_match_arxiv_sequence")
def j3_sequence(spark, sf):
    df = match.match_arxiv(_norm(spark, sf), view(spark, sf, "fx_arxiv"), require_version=True,
                           landing=match.landing_titles(view(spark, sf, "pages"))).filter("arxiv_state is not null")
    return df.select("ref_id", "arxiv_state", F.round("arxiv_sim", 6).alias("arxiv_sim"), "arxiv_adjust", "arxiv_matched")


STITCH_SQL = """coalesce(x.lookup_status = 'hit' AND coalesce(x.doi, '') <> '' AND rtrim(rtrim(lower(x.doi), '.'), '/') <> rtrim(rtrim(doi_norm, '.'), '/'), false)"""


@query("j4_crosscheck_doi_pmid", NORMAL_SQL + f"""
SELECT ref_id, {STITCH_SQL} AS stitched, coalesce(x.lookup_status = 'hit' AND coalesce(x.doi, '') <> '', false) AS pair_checked
FROM norm n LEFT JOIN (SELECT pmid AS xp, doi, lookup_status FROM fx_pubmed) x ON x.xp = n.pmid_norm AND n.doi_norm IS NOT NULL""".replace("ref_id,", "n.ref_id,", 1))
def j4(spark, sf):
    return match.crosscheck_doi_pmid(_norm(spark, sf), view(spark, sf, "fx_pubmed")).select("ref_id", "stitched", "pair_checked")


# --- title search ----------------------------------------------------------------------------------------------

_STOP = in_sql(fv.REVERSE_LOOKUP_STOP)


def _search_sql(name: str, claims: str, records: str, min_len: int, floor: float, prefix: bool = False, gate: bool = True) -> str:
    """Best record per claim (token similarity): ``claims`` q_id, q_title, q_year; ``records`` r_id, r_title, r_year, r_doi."""
    words = "list_filter(list_distinct(regexp_extract_all(lower({}), '[a-z一-鿿0-9]{{2,}}')), lambda x: x NOT IN " + _STOP + ")"
    sim = jaccard_sql(tokens_sql("q_title"), tokens_sql("r_title"))
    if prefix:
        head = jaccard_sql(tokens_sql("q_title"), tokens_sql("substr(r_title, 1, length(q_title))"))
        sim = f"greatest({sim}, CASE WHEN length(r_title) >= length(q_title) THEN {head} ELSE 0.0 END)"
    year = "(q_year IS NULL OR r_year IS NULL OR abs(q_year - r_year) <= 1)" if gate else "true"
    # list_distinct does not keep order, so the words are numbered from the raw match list
    return f"""
{name}_c AS (SELECT q_id, q_title, q_year FROM ({claims}) WHERE length(trim(q_title, ' ' || chr(9) || chr(10) || chr(13))) >= {min_len}),
{name}_w AS (SELECT q_id, w, min(i) AS i FROM (SELECT q_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT q_id,
  list_filter(regexp_extract_all(lower(q_title), '[a-z一-鿿0-9]{{2,}}'), lambda x: x NOT IN {_STOP}) AS ws FROM {name}_c)) GROUP BY 1, 2),
{name}_2 AS (SELECT q_id, max(w) FILTER (WHERE rn = 1) AS w1, max(w) FILTER (WHERE rn = 2) AS w2 FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY length(w) DESC, i) AS rn FROM {name}_w) GROUP BY 1),
{name}_r AS (SELECT *, {words.format('r_title')} AS rw FROM ({records}) WHERE trim(r_title) <> ''),
{name}_x AS (SELECT r_id, unnest(rw) AS w FROM {name}_r),
{name}_h AS (SELECT t.q_id, a.r_id FROM {name}_2 t JOIN {name}_x a ON a.w = t.w1 JOIN {name}_x b ON b.w = t.w2 AND b.r_id = a.r_id),
{name}_p AS (SELECT h.q_id, h.r_id, r_doi, {sim} AS sim FROM {name}_h h JOIN {name}_c c ON c.q_id = h.q_id JOIN {name}_r r ON r.r_id = h.r_id WHERE {year}),
{name} AS (SELECT q_id, r_id, r_doi, sim FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, r_id) AS rn FROM {name}_p WHERE sim >= {floor}) WHERE rn = 1)"""


_SQUEEZE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _reverse_sql(src: str) -> str:
    return _search_sql(
        "rev", f"SELECT ref_id AS q_id, clean_title AS q_title, year AS q_year FROM {src}",
        f"SELECT pmid AS r_id, {_SQUEEZE.format('title')} AS r_title, year AS r_year, NULL AS r_doi FROM fx_pubmed WHERE lookup_status = 'hit'",
        20, 0.5)


def _anchor_sql(src: str) -> str:
    return _search_sql(
        "oax", f"SELECT ref_id AS q_id, clean_title AS q_title, year AS q_year FROM {src}",
        f"SELECT rank_id AS r_id, {_SQUEEZE.format('display_name')} AS r_title, publication_year AS r_year, doi AS r_doi FROM fx_openalex",
        18, 0.5)


@query("j5_reverse_title_lookup", NORMAL_SQL + "," + _reverse_sql("norm") + """
SELECT q_id AS ref_id, r_id AS reverse_pmid, round(sim, 6) AS reverse_sim, CASE WHEN sim >= 0.82 THEN '' ELSE 'partial' END AS reverse_adjust FROM rev""")
def j5(spark, sf):
    df = fuzzy.reverse_title_lookup(_norm(spark, sf), view(spark, sf, "fx_pubmed"), TOKEN)
    return df.withColumn("reverse_sim", F.round("reverse_sim", 6))


@query("j5_reverse_title_lookup_sequence")
def j5_sequence(spark, sf):
    df = fuzzy.reverse_title_lookup(_norm(spark, sf), view(spark, sf, "fx_pubmed"))
    return df.withColumn("reverse_sim", F.round("reverse_sim", 6))


LOCATOR_SQL = """
loc_r AS (SELECT pmid, title, lower(ta) AS ta, year, CAST(volume AS VARCHAR) AS volume, CAST(issue AS VARCHAR) AS issue, CAST(page AS VARCHAR) AS page
  FROM fx_pubmed WHERE lookup_status = 'hit'),
loc AS (SELECT n.ref_id, count(r.pmid) AS hits, min(r.pmid) AS l_pmid, min_by(r.title, r.pmid) AS l_title FROM {src} n LEFT JOIN loc_r r
  ON r.ta = lower(n.source) AND r.year = n.year AND r.volume = CAST(n.volume AS VARCHAR) AND (n.issue IS NULL OR r.issue = CAST(n.issue AS VARCHAR))
  AND (n.page IS NULL OR r.page = CAST(n.page AS VARCHAR)) GROUP BY n.ref_id)"""


@query("j6_locator_lookup", NORMAL_SQL + "," + LOCATOR_SQL.format(src="norm") + f"""
, t AS (SELECT n.ref_id, hits, l_pmid, CASE WHEN hits = 1 AND clean_title <> '' THEN {jaccard_sql(tokens_sql('clean_title'), tokens_sql('l_title'))} END AS sim,
  regexp_matches(clean_title, '\\p{{L}}') AND regexp_matches(l_title, '\\p{{L}}') AS same_script FROM norm n JOIN loc ON loc.ref_id = n.ref_id)
SELECT ref_id, hits AS locator_hits, hits = 1 AND NOT coalesce(sim < 0.5 AND same_script, false) AS locator_matched,
  coalesce(sim < 0.5 AND same_script, false) AS locator_contradicted,
  CASE WHEN hits = 1 AND NOT coalesce(sim < 0.5 AND same_script, false) THEN l_pmid END AS locator_pmid FROM t""")
def j6(spark, sf):
    index = match.locator_index(view(spark, sf, "fx_pubmed"))
    return match.locator_lookup(_norm(spark, sf), index, TOKEN).select(
        "ref_id", "locator_hits", "locator_matched", "locator_contradicted", "locator_pmid")


@query("j7_anchor_openalex", NORMAL_SQL + "," + _anchor_sql("norm") + """
SELECT q_id AS ref_id, round(sim, 6) AS openalex_sim, sim >= 0.82 AS openalex_confirmed, sim < 0.82 AND sim >= 0.6 AS openalex_near,
  CASE WHEN sim >= 0.82 THEN lower(coalesce(r_doi, '')) END AS openalex_doi FROM oax""")
def j7(spark, sf):
    df = fuzzy.anchor_openalex(_norm(spark, sf), view(spark, sf, "fx_openalex"), TOKEN)
    return df.withColumn("openalex_sim", F.round("openalex_sim", 6))


@query("j7_anchor_openalex_sequence")
def j7_sequence(spark, sf):
    df = fuzzy.anchor_openalex(_norm(spark, sf), view(spark, sf, "fx_openalex"))
    return df.withColumn("openalex_sim", F.round("openalex_sim", 6))


def _s2_sql(src: str, name: str) -> str:
    t = _SQUEEZE.format("s.title")
    full = jaccard_sql(tokens_sql("clean_title"), tokens_sql("s_title"))
    head = jaccard_sql(tokens_sql("clean_title"), tokens_sql("substr(s_title, 1, length(clean_title))"))
    return f"""
{name}_p AS (SELECT doi_l, s_title FROM (SELECT lower(s.doi) AS doi_l, {t} AS s_title, row_number() OVER (PARTITION BY lower(s.doi) ORDER BY paper_id) AS rn
  FROM fx_s2 s WHERE regexp_matches(coalesce(s.doi, ''), {q(fv.DOI)})) WHERE rn = 1),
{name} AS (SELECT d.*, CASE WHEN coalesce(s_title, '') <> '' THEN greatest({full}, CASE WHEN length(s_title) >= length(clean_title) THEN {head} ELSE 0.0 END) END AS s2_sim,
  coalesce(CASE WHEN coalesce(s_title, '') <> '' THEN greatest({full}, CASE WHEN length(s_title) >= length(clean_title) THEN {head} ELSE 0.0 END) END >= 0.82, false) AS s2_matched
  FROM {src} d LEFT JOIN {name}_p p ON p.doi_l = d.doi_norm AND NOT d.doi_matched AND d.clean_title <> '')"""


@query("j8_confirm_secondary", NORMAL_SQL + "," + _doi_sql("norm", "doi_norm", "d") + "," + _s2_sql("d", "s2") + """
SELECT ref_id, round(s2_sim, 6) AS s2_sim, s2_matched FROM s2""")
def j8(spark, sf):
    df = match.match_doi(_norm(spark, sf), works(spark, sf), TOKEN)
    return match.confirm_secondary(df, view(spark, sf, "fx_s2"), TOKEN).select(
        "ref_id", F.round("s2_sim", 6).alias("s2_sim"), "s2_matched")


@query("j8_confirm_by_title", NORMAL_SQL + "," + _search_sql(
    "st", "SELECT ref_id AS q_id, regexp_replace(clean_title, '[-‐-―]+', ' ', 'g') AS q_title, NULL::INT AS q_year FROM norm",
    f"SELECT paper_id AS r_id, regexp_replace({_SQUEEZE.format('title')}, '[-‐-―]+', ' ', 'g') AS r_title, year AS r_year, NULL AS r_doi FROM fx_s2",
    18, 0.82, prefix=True, gate=False) + """
SELECT q_id AS ref_id, true AS s2_title_matched, round(sim, 6) AS s2_title_sim FROM st""")
def j8_title(spark, sf):
    """Claims and papers are both read off the references, and the claims are asked for twice, so both are written once."""
    written = written_refs(spark, sf)
    claims = cut_lineage(normalise.normalise_refs(refs(spark, sf, written)).select("ref_id", "clean_title", "year"))
    df = fuzzy.confirm_by_title(claims, view(spark, sf, "fx_s2", written), TOKEN)
    return df.withColumn("s2_title_sim", F.round("s2_title_sim", 6))


@query("j9_cross_lingual_bridge")
def j9(spark, sf):
    """Bridge for every DOI record whose title does not match, whatever the scripts."""
    df = match.match_doi(_norm(spark, sf), works(spark, sf), TOKEN)
    out = match.cross_lingual_bridge(
        df, F.col("doi_sim") < fv.SIM_MISMATCH, F.col("clean_title"), F.col("doi_norm"), F.lit(None).cast("string"),
        F.lit(None).cast("string"), match.landing_titles(view(spark, sf, "pages")), view(spark, sf, "fx_openalex"))
    return out.filter("doi_sim < 0.5").select("ref_id", "bridge")


@query("j10_join_retractions", NORMAL_SQL + "," + NOTICE_SQL + """
SELECT n.ref_id, c.nature AS retraction_nature, coalesce(c.nature IN ('retraction', 'partial_retraction', 'withdrawal'), false) AS retracted
FROM norm n LEFT JOIN notice_class c ON c.doi = n.doi_norm""")
def j10(spark, sf):
    index = match.build_retraction_index(view(spark, sf, "fx_notices"))
    return match.join_retractions(_norm(spark, sf), index).select("ref_id", "retraction_nature", "retracted")


@query("j11_join_open_access", """
SELECT r.ref_id, o.is_oa, CASE WHEN o.is_oa THEN coalesce(o.license, '') END AS oa_license, CASE WHEN o.is_oa THEN coalesce(o.oa_url, '') END AS oa_url
FROM fx_results r LEFT JOIN fx_oa o ON lower(o.doi) = lower(r.doi) AND r.verdict = 'verified'""")
def j11(spark, sf):
    return match.join_open_access(results(spark, sf).drop("is_oa"), view(spark, sf, "fx_oa")).select(
        "ref_id", "is_oa", "oa_license", "oa_url")


PROBE_SQL = """last_probe AS (SELECT url, arg_max(http_status, probe_id) FILTER (WHERE true) AS _x, max(probe_id) AS mp FROM fx_url_probes GROUP BY url),
probe AS (SELECT p.url AS p_url, p.http_status, p.error_kind FROM fx_url_probes p JOIN last_probe l ON l.url = p.url AND l.mp = p.probe_id)"""


@query("j12_join_reachability", NORMAL_SQL + "," + PROBE_SQL + """
SELECT n.ref_id, p.http_status, coalesce(p.http_status BETWEEN 200 AND 399 OR p.http_status = 429, false) AS reachable,
  CASE WHEN n.resolved_url IS NOT NULL THEN CASE WHEN p.http_status IS NULL AND p.error_kind IS NULL THEN 'not_probed' ELSE p.error_kind END END AS probe_cause
FROM norm n LEFT JOIN probe p ON p.p_url = n.resolved_url""")
def j12(spark, sf):
    return match.join_reachability(_norm(spark, sf), view(spark, sf, "fx_url_probes"), ["probe_id"]).select(
        "ref_id", "http_status", "reachable", "probe_cause")


@query("j13_latest_archive", """
SELECT r.ref_id, a.archive_url FROM fx_results r LEFT JOIN (SELECT url, max_by(archive_url, snapshot_id) AS archive_url FROM fx_archives GROUP BY url) a
  ON a.url = r.url AND r.verdict = 'unreachable'""")
def j13(spark, sf):
    return match.latest_archive(results(spark, sf).drop("archive_url"), view(spark, sf, "fx_archives"), "snapshot_id").select(
        "ref_id", "archive_url")


@query("j14_preprint_upgrades", """
WITH p AS (SELECT arxiv_key, doi AS published_doi, venue, year AS published_year, row_number() OVER (PARTITION BY arxiv_key ORDER BY paper_id) AS rn
  FROM fx_s2 WHERE arxiv_key IS NOT NULL AND coalesce(doi, '') <> '')
SELECT r.list_id, r.ref_id, r.arxiv AS arxiv_id, published_doi, p.venue, published_year FROM fx_results r JOIN p ON p.arxiv_key = r.arxiv AND p.rn = 1
WHERE r.verdict = 'verified' AND r.doi IS NULL""")
def j14(spark, sf):
    return match.preprint_upgrades(results(spark, sf), view(spark, sf, "fx_s2"))


_LANDING = f"""
WITH pg AS (SELECT * FROM (SELECT page_id, url_key, trim(regexp_replace(page_title, '\\s+', ' ', 'g')) AS page_title, row_number() OVER (PARTITION BY url_key ORDER BY page_title, page_id) AS rn
  FROM fx_landing) WHERE rn = 1),
c AS (SELECT page_id AS ref_id, url_key, CASE page_id % 3 WHEN 0 THEN page_title WHEN 1 THEN concat(page_title, ' and further words beside') ELSE 'Something else entirely here' END AS title FROM pg),
s AS (SELECT c.ref_id, c.title, trim(regexp_replace(pg.page_title, '\\s+[-|–—]\\s+.*$', '')) AS cand FROM c JOIN pg ON pg.url_key = c.url_key),
m AS (SELECT ref_id, CASE WHEN cand <> '' THEN {jaccard_sql(tokens_sql('title'), tokens_sql('cand'))} ELSE 0.0 END AS sim,
  cand <> '' AND len({tokens_sql('cand')}) >= 3 AND list_has_all({tokens_sql('title')}, {tokens_sql('cand')}) AS sub FROM s)
SELECT ref_id, round(sim, 6) AS landing_sim, sim >= 0.75 OR sub AS landing_confirmed, NOT (sim >= 0.75 OR sub) AND sim >= 0.6 AS landing_near FROM m"""


@query("j15_landing_title_check", _LANDING)
def j15(spark, sf):
    fx = view(spark, sf, "fx_landing").withColumn("page_title", F.trim(F.regexp_replace("page_title", r"\s+", " ")))
    pages = view(spark, sf, "fx_landing").groupBy("url_key").agg(
        F.min(F.struct(F.trim(F.regexp_replace("page_title", r"\s+", " ")).alias("t"), "page_id")).alias("m"))
    claims = pages.select(
        F.col("m.page_id").alias("ref_id"), F.col("url_key").alias("resolved_url"),
        F.when(F.col("m.page_id") % 3 == 0, F.col("m.t")).when(
            F.col("m.page_id") % 3 == 1, F.concat(F.col("m.t"), F.lit(" and further words beside"))).otherwise(
            F.lit("Something else entirely here")).alias("title"))
    titled = fx.groupBy("url_key").agg(F.min("page_title").alias("page_title")).select(
        F.col("url_key").alias("page_key"), F.lit(None).cast("string").alias("citation_title"),
        F.lit(None).cast("string").alias("og_title"), "page_title")
    return match.landing_title_check(claims, titled, TOKEN).select(
        "ref_id", F.round("landing_sim", 6).alias("landing_sim"), "landing_confirmed", "landing_near")


@query("j15_landing_titles", f"""
WITH p AS (SELECT {url_key_sql('url')} AS page_key, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS page_title,
  {title_key_sql("concat(regexp_extract(html, '(?is)<head[^>]*>(.*?)</head>', 1), regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS head_key FROM pages)
SELECT page_key, NULL::VARCHAR AS citation_title, NULL::VARCHAR AS og_title, page_title, head_key FROM (SELECT *, row_number() OVER (PARTITION BY page_key ORDER BY page_title NULLS FIRST, head_key) AS rn FROM p) WHERE rn = 1""")
def j15_titles(spark, sf):
    return match.landing_titles(view(spark, sf, "pages"))


@query("j20_cross_registry_consistency", f"""
WITH w AS (SELECT lower(doi) AS doi, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS tw FROM fx_works WHERE lookup_status = 'hit'),
o AS (SELECT lower(doi) AS doi, min_by(trim(regexp_replace(lower(display_name), '[^a-z0-9]+', ' ', 'g')), rank_id) AS tt FROM fx_openalex WHERE doi IS NOT NULL GROUP BY 1),
p AS (SELECT lower(doi) AS doi, min(pmid) AS pmid, min_by(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), pmid) AS tp FROM fx_pubmed
  WHERE lookup_status = 'hit' AND doi IS NOT NULL GROUP BY 1),
s AS (SELECT w.doi, pmid, {jaccard_sql(tokens_sql('tw'), tokens_sql('tt'))} AS a, {jaccard_sql(tokens_sql('tw'), tokens_sql('tp'))} AS b, {jaccard_sql(tokens_sql('tt'), tokens_sql('tp'))} AS c
  FROM w JOIN o ON o.doi = w.doi JOIN p ON p.doi = w.doi WHERE tw <> '' AND tt <> '' AND tp <> '')
SELECT doi, pmid, round(a, 6) AS works_openalex, round(b, 6) AS works_pubmed, round(c, 6) AS openalex_pubmed, least(a, b, c) >= 0.85 AS consistent FROM s""")
def j20(spark, sf):
    df = fuzzy.cross_registry_consistency(view(spark, sf, "fx_works"), view(spark, sf, "fx_openalex"), view(spark, sf, "fx_pubmed"), TOKEN)
    return df.select("doi", "pmid", *[F.round(c, 6).alias(c) for c in ("works_openalex", "works_pubmed", "openalex_pubmed")], "consistent")


@query("j20_cross_registry_sequence")
def j20_sequence(spark, sf):
    return fuzzy.cross_registry_consistency(view(spark, sf, "fx_works"), view(spark, sf, "fx_openalex"), view(spark, sf, "fx_pubmed"))


@query("j21_journal_map_coverage", """
WITH m AS (SELECT DISTINCT source AS journal, CASE WHEN suffix(source, '7') THEN concat('Dead ', source) ELSE source END AS ta FROM documents)
SELECT m.journal, m.ta, 0::BIGINT AS n_records FROM m LEFT JOIN (SELECT ta, count(*) AS n FROM fx_pubmed WHERE lookup_status = 'hit' GROUP BY ta) p ON p.ta = m.ta WHERE coalesce(n, 0) = 0""")
def j21(spark, sf):
    mapping = view(spark, sf, "documents").select(F.col("source").alias("journal")).distinct().withColumn(
        "ta", F.when(F.col("journal").endswith("7"), F.concat(F.lit("Dead "), "journal")).otherwise(F.col("journal")))
    return profile.unused_mappings(mapping, view(spark, sf, "fx_pubmed"))


@query("j22_review_questions", f"""
WITH bank(verdict, question) AS (VALUES {', '.join(f"({q(v)}, {q(k)})" for v, k, _ in score.QUESTIONS)})
SELECT list_id, ref_id, r.verdict, question FROM fx_results r JOIN bank b ON b.verdict = r.verdict
UNION ALL SELECT list_id, ref_id, verdict, 'same_paper_across_languages' FROM fx_results WHERE cross_language
UNION ALL SELECT list_id, ref_id, verdict, 'which_clone_is_real' FROM fx_results WHERE ref_id % 30 = 7
UNION ALL SELECT list_id, NULL, NULL, unnest({[k for k, _ in score.LIST_QUESTIONS]}) FROM (SELECT DISTINCT list_id FROM fx_results)""")
def j22(spark, sf):
    return score.review_questions(results(spark, sf).withColumn("in_clone_pair", F.col("ref_id") % 30 == 7))


# --- discovery ---------------------------------------------------------------------------------------------------

_MERGE = """
, r AS (SELECT source_rank, row_order, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, doi, pmid, coalesce(source, '') AS source, year, cited_by, src_type FROM cand),
k AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9一-鿿]+', '', 'g') AS t60 FROM r WHERE length(title) >= 15),
u AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, row_order) AS rn FROM (SELECT *, CASE WHEN doi IS NOT NULL THEN concat('doi:', lower(doi))
  WHEN pmid IS NOT NULL THEN concat('pmid:', pmid) WHEN t60 <> '' THEN concat('t:', t60) END AS key FROM k) WHERE key IS NOT NULL),
v AS (SELECT *, row_number() OVER (PARTITION BY t60 ORDER BY source_rank, row_order) AS n, source_rank * 1000000000000 + row_order AS ord FROM u WHERE rn = 1),
a AS (SELECT *, min(ord) OVER (PARTITION BY t60) AS lead, coalesce(max(CASE WHEN n = 1 THEN year END) OVER (PARTITION BY t60),
  (SELECT min_by(x.year, x.ord) FROM v x WHERE x.t60 = v.t60 AND x.year IS NOT NULL)) AS anchor FROM v),
s AS (SELECT *, CASE WHEN ord = lead OR year IS NULL OR anchor IS NULL OR abs(year - anchor) <= 1 THEN lead ELSE ord END AS slot FROM a)
SELECT min_by(title, ord) AS title, min_by(doi, ord) FILTER (WHERE regexp_matches(coalesce(doi, ''), '^10\\.\\d{4,9}/\\S+$')) AS doi, min_by(pmid, ord) FILTER (WHERE pmid IS NOT NULL) AS pmid,
  coalesce(min_by(source, ord) FILTER (WHERE source <> ''), '') AS source, min_by(year, ord) FILTER (WHERE year IS NOT NULL) AS year,
  min_by(cited_by, ord) FILTER (WHERE cited_by IS NOT NULL) AS cited_by, min_by(src_type, ord) FILTER (WHERE src_type IS NOT NULL) AS src_type, count(*) AS n_merged
FROM s GROUP BY t60, slot"""
_CAND = """
p AS (SELECT 0 AS source_rank, pmid, doi, title, ta AS source, year, NULL::BIGINT AS cited_by, NULL::VARCHAR AS src_type, CAST(pmid AS BIGINT) AS row_order FROM fx_pubmed WHERE lookup_status = 'hit'),
o AS (SELECT 1 AS source_rank, NULL::VARCHAR AS pmid, doi, display_name AS title, '' AS source, publication_year AS year, cited_by_count AS cited_by, source_type AS src_type, rank_id AS row_order FROM fx_openalex)"""


def _candidates(spark, sf) -> DataFrame:
    p = view(spark, sf, "fx_pubmed").filter("lookup_status = 'hit'").select(
        F.lit(0).alias("source_rank"), "pmid", "doi", "title", F.col("ta").alias("source"), "year",
        F.lit(None).cast("bigint").alias("cited_by"), F.lit(None).cast("string").alias("src_type"), F.col("pmid").cast("bigint").alias("row_order"))
    o = view(spark, sf, "fx_openalex").select(
        F.lit(1).alias("source_rank"), F.lit(None).cast("string").alias("pmid"), "doi", F.col("display_name").alias("title"),
        F.lit("").alias("source"), F.col("publication_year").alias("year"), F.col("cited_by_count").alias("cited_by"),
        F.col("source_type").alias("src_type"), F.col("rank_id").alias("row_order"))
    return p.unionByName(o)


@query("g1_merge_sources", "WITH " + _CAND + ", cand AS (SELECT * FROM p UNION ALL BY NAME SELECT * FROM o)" + _MERGE)
def g1(spark, sf):
    return dc.merge_sources(_candidates(spark, sf)).drop("source_rank", "row_order")


_TOPIC = "retion thsher eronth ention"
_TOPIC_WORDS = [w for w in _TOPIC.split() if w not in fv.REVERSE_LOOKUP_STOP]
_REL = ("len(list_intersect(list_filter(list_distinct(regexp_extract_all(lower(title), '[a-z一-鿿0-9]{2,}')), lambda x: x NOT IN " + _STOP + f"), {_TOPIC_WORDS})) / {len(_TOPIC_WORDS)}.0::DOUBLE")


def _discover_sql(order_p: str, order_o: str, tail: str = "") -> str:
    return ("WITH " + _CAND + f""", pr AS (SELECT * FROM (SELECT *, round({_REL}, 6) AS relevance FROM p) WHERE relevance > 0 ORDER BY {order_p}, relevance DESC, row_order LIMIT 20),
orr AS (SELECT * FROM (SELECT *, round({_REL}, 6) AS relevance FROM o) WHERE relevance > 0 ORDER BY {order_o}, relevance DESC, row_order LIMIT 20),
cand AS (SELECT * FROM pr UNION ALL BY NAME SELECT * FROM orr)""" + _MERGE.replace("SELECT min_by(title, ord) AS title", "SELECT * FROM (SELECT min_by(title, ord) AS title") + f") {tail}")


@query("t1_discover_relevance", _discover_sql("relevance DESC", "relevance DESC"))
def t1_relevance(spark, sf):
    return dc.discover(view(spark, sf, "fx_pubmed"), view(spark, sf, "fx_openalex"), _TOPIC, 20).drop("source_rank", "row_order")


@query("t1_discover_cited", _discover_sql("relevance DESC", "cited_by DESC NULLS LAST", "WHERE (year IS NULL OR year >= 1995) AND (pmid IS NOT NULL OR src_type = 'journal')"))
def t1_cited(spark, sf):
    return dc.discover(view(spark, sf, "fx_pubmed"), view(spark, sf, "fx_openalex"), _TOPIC, 20, "cited", 1995, True).drop("source_rank", "row_order")


@query("t1_discover_newest", _discover_sql("year DESC NULLS LAST", "year DESC NULLS LAST"))
def t1_newest(spark, sf):
    return dc.discover(view(spark, sf, "fx_pubmed"), view(spark, sf, "fx_openalex"), _TOPIC, 20, "newest").drop("source_rank", "row_order")


# --- the verdict ---------------------------------------------------------------------------------------------------

VERIFY_SQL = NORMAL_SQL + f""",
rsv AS (SELECT * FROM norm WHERE resolved_url IS NOT NULL),
lse AS (SELECT * FROM norm WHERE resolved_url IS NULL),
{_doi_sql('rsv', 'doi_norm', 'd')},{_s2_sql('d', 's2')},{_arxiv_sql('s2', 'x', 'n.doi_norm IS NULL')},{_pmid_sql('x', 'm')},
{NOTICE_SQL},{PROBE_SQL},
j AS (SELECT m.*, {STITCH_SQL} AS stitched, c.nature AS retraction_nature, coalesce(c.nature IN ('retraction', 'partial_retraction', 'withdrawal'), false) AS retracted,
  coalesce(c.nature = 'expression_of_concern', false) AS concern, p.http_status, coalesce(p.http_status BETWEEN 200 AND 399 OR p.http_status = 429, false) AS reachable,
  m.tier IN {in_sql(fv.TRUSTED_TIERS)} AS trusted, len(missing) = 0 AS whole
  FROM m LEFT JOIN (SELECT pmid AS xp, doi, lookup_status FROM fx_pubmed) x ON x.xp = m.pmid_norm AND m.doi_norm IS NOT NULL
  LEFT JOIN notice_class c ON c.doi = m.doi_norm LEFT JOIN probe p ON p.p_url = m.resolved_url),
k AS (SELECT *, trusted AND whole AND doi_adjust <> 'partial' AND arxiv_adjust <> 'partial' AS sound, retracted OR concern AS noticed FROM j),
ru AS (SELECT *, CASE WHEN NOT regexp_matches(resolved_url, '(?i)^https?://') THEN 11 WHEN doi_adjust = 'invalid' OR arxiv_adjust = 'invalid' THEN 12 WHEN stitched THEN 13
  WHEN NOT reachable AND (doi_matched OR arxiv_matched OR s2_matched) AND http_status = 403 THEN 14
  WHEN NOT reachable AND http_status = 404 AND NOT (doi_matched OR arxiv_matched) AND regexp_matches(resolved_url, {q(fv.ARXIV_RESOLVER)}) THEN 15
  WHEN coalesce(pmid_state = 'not_found', false) OR (reachable AND pmid_adjust = 'invalid') THEN 16 WHEN NOT reachable THEN 17
  WHEN sound AND pmid_adjust <> 'partial' AND NOT noticed THEN 18 ELSE 19 END AS rule FROM k),
va AS (SELECT list_id, ref_id, rule, CASE WHEN rule IN (11, 12, 13, 15, 16) THEN 'invalid' WHEN (rule = 14 AND sound AND NOT noticed) OR rule = 18 THEN 'verified' WHEN rule = 17 THEN 'unreachable' ELSE 'partial' END AS verdict,
  CASE WHEN rule IN (11, 18) THEN false WHEN rule IN (12, 13, 15, 16, 17) THEN true WHEN rule = 14 THEN retracted OR (sound AND noticed)
    ELSE noticed OR arxiv_adjust = 'partial' OR pmid_adjust = 'partial' END AS needs_human FROM ru),
opn AS (SELECT * FROM lse WHERE clean_title <> '' AND coalesce(arxiv, '') = ''),{_reverse_sql('opn')},{_anchor_sql('opn')},{LOCATOR_SQL.format(src='opn')},
l1 AS (SELECT n.*, r.sim AS rsim, r.r_id, o.sim AS osim, o.r_doi, loc.hits, loc.l_pmid, CASE WHEN loc.hits = 1 THEN {jaccard_sql(tokens_sql('clean_title'), tokens_sql('l_title'))} END AS lsim,
  regexp_matches(coalesce(l_title, ''), '\\p{{L}}') AND regexp_matches(clean_title, '\\p{{L}}') AS same_script
  FROM lse n LEFT JOIN rev r ON r.q_id = n.ref_id LEFT JOIN oax o ON o.q_id = n.ref_id LEFT JOIN loc ON loc.ref_id = n.ref_id),
l2 AS (SELECT *, rsim IS NULL AND coalesce(hits = 1, false) AND NOT coalesce(lsim < 0.5 AND same_script, false) AS lmatch FROM l1),
l3 AS (SELECT *, CASE WHEN rsim IS NULL AND NOT lmatch AND osim >= 0.82 AND regexp_matches(coalesce(r_doi, ''), {q(fv.DOI)}) THEN lower(r_doi) END AS anchor FROM l2),
{_doi_sql('l3', 'anchor', 'ld')},
l4 AS (SELECT ld.*, coalesce(c.nature IN ('retraction', 'partial_retraction', 'withdrawal', 'expression_of_concern'), false) AS noticed FROM ld LEFT JOIN notice_class c ON c.doi = ld.anchor),
l5 AS (SELECT list_id, ref_id, CASE WHEN coalesce(arxiv, '') <> '' THEN 1 WHEN clean_title = '' THEN 2 WHEN rsim >= 0.82 THEN 3 WHEN rsim IS NOT NULL THEN 4 WHEN lmatch THEN 5
  WHEN anchor IS NOT NULL AND doi_adjust = 'invalid' THEN 6 WHEN anchor IS NOT NULL AND (NOT doi_matched OR doi_adjust = 'partial' OR noticed) THEN 7 WHEN anchor IS NOT NULL THEN 8
  WHEN osim >= 0.82 THEN 9 ELSE 10 END AS rule FROM l4),
vb AS (SELECT list_id, ref_id, rule, CASE WHEN rule IN (1, 2, 6) THEN 'invalid' WHEN rule IN (3, 5, 8) THEN 'verified' WHEN rule IN (4, 7, 9) THEN 'partial' ELSE 'unverified' END AS verdict,
  rule IN (4, 6, 7, 9, 10) AS needs_human FROM l5),
verdicts AS (SELECT * FROM va UNION ALL SELECT * FROM vb)
"""


@query("v1_verify", VERIFY_SQL + "SELECT list_id, ref_id, rule, verdict, needs_human FROM verdicts")
def v1(spark, sf):
    written = written_refs(spark, sf)
    reg = registries(spark, sf, with_pages=False, written=written)
    return verify(refs(spark, sf, written), reg, model=TOKEN).select("list_id", "ref_id", "rule", "verdict", "needs_human")


@query("v1_verify_sequence")
def v1_sequence(spark, sf):
    """The default model with every registry, including landing pages."""
    written = written_refs(spark, sf)
    return verify(refs(spark, sf, written), registries(spark, sf, written=written)).select(
        "list_id", "ref_id", "rule", "verdict", "needs_human", "landing_confirmed", "archive_url", "is_oa", "pmid_filled", "doi_filled")


@query("v1_verify_offline", NORMAL_SQL + """
SELECT list_id, ref_id, CASE WHEN resolved_url IS NULL OR NOT regexp_matches(resolved_url, '(?i)^https?://') THEN 'invalid' ELSE 'partial' END AS verdict FROM norm""")
def v1_offline(spark, sf):
    return verify(refs(spark, sf), registries(spark, sf), offline=True).select("list_id", "ref_id", "verdict")


@query("v1_notes")
def v1_notes(spark, sf):
    written = written_refs(spark, sf)
    return with_notes(verify(refs(spark, sf, written), registries(spark, sf, written=written))).select("list_id", "ref_id", "note")

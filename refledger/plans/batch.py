"""A whole batch: the verdict, then every list-level stage in its fixed order, then the scorecard.

duplicates, clone notes, preprint hints, completeness, semantic cap, error codes, judge, prescreen, policy, scorecard.

Only duplicates, the semantic cap, the judge and the policy change a verdict or the human flag; the others annotate.
The verdicts are written once.  Stages that look at several rows or at another table (duplicates, clones, hints, judge,
prescreen) read a few of their columns and give back a few rows by reference; these are put together by reference and
meet the verdicts in one join.  The stages that look at one row alone are expressions on the joined rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger.functions.similarity import SEQUENCE, SimilarityModel
from refledger.operators import dedupe, evidence, match, normalise, score
from refledger.plans.verify import Registries, verify, with_notes
from refledger.session import cut_lineage

ROW = ["list_id", "ref_id"]


@dataclass(frozen=True)
class Batch:
    """``results``: every reference with verdict and annotations; ``scorecard``: one row per list."""

    results: DataFrame
    scorecard: DataFrame


def verify_batch(refs: DataFrame, registries: Registries, votes: DataFrame | None = None, prescreen: DataFrame | None = None,
                 policy: dict | None = None, medical: bool = False, offline: bool = False, model: SimilarityModel = SEQUENCE,
                 require_version: bool = False) -> Batch:
    """Verify ``refs`` and run all later stages.

    ``votes`` (ref_id, judge, nli) and ``prescreen`` (ref_id, label, prob) are judgements made elsewhere; without them
    their stages are left out, as preprint hints are offline.  ``policy`` is what ``parse_source_policy`` returns.
    """
    checked = verify(refs, registries, medical, offline, model, require_version)
    return finish(checked, None if offline else registries.s2_papers, votes, prescreen, policy, medical, model)


def finish(checked: DataFrame, s2_papers: DataFrame | None = None, votes: DataFrame | None = None,
           prescreen: DataFrame | None = None, policy: dict | None = None, medical: bool = False,
           model: SimilarityModel = SEQUENCE) -> Batch:
    """The stages behind the verdict, for rows that ``verify`` has checked."""
    if "semantic" in checked.columns:
        checked = normalise.semantic_audit(checked)
    checked = cut_lineage(checked)
    # identifiers as the verdict left them: the resolved address, and numbers it filled in
    keys = checked.select(*ROW, "title", *(["claim"] if "claim" in checked.columns else []),
                          F.col("resolved_url").alias("url"), _filled(checked, "doi"), _filled(checked, "pmid"))
    repeats = dedupe.mark_duplicates(keys)
    clones = dedupe.clone_annotations(dedupe.clone_groups(keys, model))
    own = _by_row([repeats, clones])

    narrow = cut_lineage(checked.select(
        *ROW, "title", "verdict", "needs_human", "arxiv_id", _filled(checked, "doi"), _filled(checked, "pmid"),
        *(["semantic_audit"] if "semantic_audit" in checked.columns else [])).join(own, ROW, "left"))
    repeated = narrow.withColumn("verdict", _after_duplicates())
    later = []
    if s2_papers is not None:
        later.append(match.preprint_upgrades(repeated, s2_papers).drop("arxiv_id"))
    if "semantic_audit" in checked.columns and votes is not None:
        capped = normalise.semantic_cap(repeated)
        judged = evidence.claim_judgements(capped, votes, prescreen).drop("verdict")
        later.append(judged.withColumnRenamed("needs_human", "judge_human"))
        if prescreen is not None:
            later.append(evidence.prescreen_notes(capped, prescreen, judged).select(*ROW, "leans_support"))
    added = [c for c in own.columns if c not in ROW]
    notes = narrow.select(*ROW, *added) if not later else narrow.select(*ROW, *added).join(_by_row(later), ROW, "left")

    df = checked.join(notes, ROW).withColumn("verdict", _after_duplicates())
    if "csl_title" in df.columns:
        df = normalise.export_completeness(df)
    if "semantic_audit" in df.columns:
        df = normalise.semantic_cap(df)
    df = normalise.error_codes(df)
    if "judge_human" in df.columns:
        df = df.withColumn("needs_human", F.col("needs_human") | F.coalesce("judge_human", F.lit(False))).drop("judge_human")
    if policy:
        df = normalise.source_policy(df.withColumns({"given_url": F.col("url"), "url": F.col("resolved_url")}), policy, medical).withColumn(
            "url", F.col("given_url")).drop("given_url")
    results = cut_lineage(_with_batch_notes(df))
    return Batch(results, score.scorecard(results))


def _filled(df: DataFrame, name: str) -> Column:
    full = f"{name}_filled"
    return (F.coalesce(F.col(full), F.col(name)) if full in df.columns else F.col(name)).alias(name)


def _after_duplicates() -> Column:
    return F.when(F.col("duplicate_of").isNotNull() & (F.col("verdict") == "verified"), "partial").otherwise(F.col("verdict"))


def _by_row(tables: list[DataFrame]) -> DataFrame:
    """Tables of at most one row per reference as one, by an aggregation instead of a chain of joins."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.groupBy(*ROW).agg(*[F.max(c).alias(c) for c in out.columns if c not in ROW])


def _with_batch_notes(df: DataFrame) -> DataFrame:
    """The verdict's notes, then those of the stages, in stage order."""
    cols = df.columns

    def note(name, when, code, detail):
        if name not in cols:
            return []
        return [F.when(F.expr(when), F.struct(F.lit(code).alias("code"), F.expr(detail).cast("string").alias("detail")))]

    late = F.array_compact(F.array(
        *note("duplicate_of", "duplicate_of IS NOT NULL", "duplicate", "concat_ws(' ', duplicate_of, duplicate_kind)"),
        *note("clone_doi_partners", "clone_doi_partners > 0", "clone_doi", "clone_doi_partners"),
        *note("clone_title_partners", "clone_title_partners > 0", "clone_title", "clone_title_partners"),
        *note("published_doi", "published_doi IS NOT NULL", "published_version", "published_doi"),
        *note("semantic_capped", "semantic_capped", "semantic_cap", "semantic_audit.support"),
        *note("judge", "judge IS NOT NULL", "judge", "concat_ws(' ', judge, confidence)"),
        *note("leans_support", "leans_support", "prescreen", "'leans to support'"),
        *note("policy_violation", "policy_violation IS NOT NULL", "policy", "policy_violation")))
    noted = with_notes(df).withColumn("notes", F.concat("notes", late))
    return noted.withColumn("note", F.array_join(F.transform("notes", lambda x: F.concat_ws(": ", x["code"], x["detail"])), "; "))

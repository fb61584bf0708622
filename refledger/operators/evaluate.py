"""Metrics on labelled reference sets and the checks before a set is frozen."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import identifiers as ids


def holdout_metrics(labels: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Capture, strict capture and false kill over ref_id, expected and verdict; null without samples."""
    rows = labels if results is None else labels.join(results.select("ref_id", "verdict"), "ref_id", "left")
    planted, clean = F.col("expected") == "planted", F.col("expected") == "clean"
    v = F.col("verdict")

    def rate(side, hit):
        return F.round(F.avg(F.when(side, F.when(hit, 1.0).otherwise(0.0))), 4)

    return rows.agg(
        F.count("*").alias("n"),
        rate(planted, v.isNotNull() & (v != "verified")).alias("capture_rate"),
        rate(planted, F.coalesce(v == "invalid", F.lit(False))).alias("strict_capture"),
        rate(clean, F.coalesce(v == "invalid", F.lit(False))).alias("false_kill_rate"),
        *[F.count_if(v == x).alias(f"n_{x}") for x in fv.VERDICTS],
        F.coalesce(F.bool_or(v.isin("verified", "partial")), F.lit(False)).alias("live"))


def fidelity_metrics(expected: DataFrame, results: DataFrame) -> DataFrame:
    """Drift label observed against the expected one (ref_id, expected_fidelity)."""
    j = expected.join(results.select("ref_id", F.coalesce("doi_fidelity", F.lit("exact")).alias("observed")),
                      "ref_id", "left")
    hit = F.when(F.col("observed") == F.col("expected_fidelity"), 1.0).otherwise(0.0)
    return j.agg(F.count("*").alias("n"), F.round(F.avg(hit), 4).alias("fidelity_hit_rate"),
                 *[F.count_if(F.col("observed") == x).alias(f"n_{x}") for x in ("exact", "minor", "major")])


def eval_gate(metrics: DataFrame) -> DataFrame:
    """Violations as an array; an empty one passes.  Needs capture or fidelity figures."""
    cols = metrics.columns

    def got(name, kind="double"):
        return F.col(name) if name in cols else F.lit(None).cast(kind)

    bad = F.array_compact(F.array(
        F.when(got("capture_rate") != 1.0, "capture_rate"),
        F.when(got("false_kill_rate") != 0.0, "false_kill_rate"),
        F.when(got("fidelity_hit_rate") != 1.0, "fidelity_hit_rate"),
        F.when(got("capture_rate").isNull() & got("fidelity_hit_rate").isNull(), "no_criterion"),
        F.when(~got("live", "boolean"), "no_evidence")))
    return metrics.withColumn("violations", bad).withColumn("passed", F.size("violations") == 0)


def freeze_holdout(draft: DataFrame) -> DataFrame:
    """Problem counts of a draft set; it may be frozen when all are zero.

    ``draft``: ref_id, doi, pmid, arxiv, url, verdict, reviewed (clean, planted or null), planted_note.
    """
    blank = F.lit(True)
    for c in ("doi", "pmid", "arxiv", "url"):
        blank = blank & (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    checks = draft.agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(~F.col("reviewed").isin("clean", "planted"), F.lit(True))).alias("n_unreviewed"),
        F.count_if((F.col("reviewed") == "planted") & (F.trim(F.coalesce("planted_note", F.lit(""))) == "")).alias("n_planted_without_note"),
        F.count_if((F.col("reviewed") == "clean") & blank).alias("n_clean_without_identifier"),
        F.count_if((F.col("reviewed") == "planted") & (F.col("verdict") == "verified")).alias("n_planted_verified"))
    doi = ids.doi_normal_form(F.col("doi"))
    repeated = draft.filter(doi != "").groupBy(doi.alias("d")).agg(F.count("*").alias("c")).filter("c > 1").agg(
        F.count("*").alias("n_repeated_dois"))
    # both sides are one row of counts
    out = checks.join(F.broadcast(repeated))
    problems = F.col("n_unreviewed") + F.col("n_planted_without_note") + F.col("n_clean_without_identifier") + F.col("n_repeated_dois")
    return out.withColumn("can_freeze", (F.col("n") > 0) & (problems == 0))


def suggest_labels(results: DataFrame) -> DataFrame:
    """Label suggestion for drafts: verified and partial lean clean, everything else needs review."""
    return results.select("list_id", "ref_id", "verdict", F.when(
        F.col("verdict").isin("verified", "partial"), "clean").otherwise("review").alias("suggested"))

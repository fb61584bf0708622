"""Per-list scores, conclusions and audit tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refledger import fixed_values as fv


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def _counts() -> list[Column]:
    return [F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in fv.VERDICTS]


def grade(score: Column) -> Column:
    out = None
    for letter, cut in fv.GRADE_CUTS:
        out = (out.when if out is not None else F.when)(score >= cut, letter)
    return out.otherwise("D")


def _score(total: Column) -> Column:
    """100 * max(weighted sum, 0) / (10 n), rounded half to even; no rows score 0."""
    raw = sum((F.col(f"n_{v}") * w for v, w in fv.SCORE_WEIGHTS.items()), F.lit(0))
    exact = F.greatest(raw, F.lit(0)) * 100 / (total * 10)
    return F.when(total > 0, F.bround(exact, 0)).otherwise(F.lit(0)).cast("int")


def scorecard(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per list with verdict counts, score and grade."""
    by = ["list_id"] if by is None else by
    agg = results.groupBy(*by).agg(F.count("*").alias("total"), *_counts())
    return agg.withColumn("score", _score(F.col("total"))).withColumn("grade", grade(F.col("score")))


def verdict_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("list_id").pivot("verdict", fv.VERDICTS).count().na.fill(0, fv.VERDICTS)


def bluf(results: DataFrame) -> DataFrame:
    """Bottom line per list: worst actionable conclusion, blocker count and next action."""
    agg = results.groupBy("list_id").agg(
        F.count("*").alias("total"), *_counts(),
        F.count_if(_flag(results, "retracted")).alias("n_retracted"),
        F.count_if(_flag(results, "needs_human")).alias("n_review"))
    scored = agg.withColumn("score", _score(F.col("total"))).withColumn("grade", grade(F.col("score")))
    unsure = F.col("n_unreachable") + F.col("n_unverified")
    worst = (
        F.when(F.col("n_invalid") > 0, "invalid").when(unsure > 0, "unchecked")
        .when(F.col("n_partial") > 0, "partial").otherwise("clean"))
    actions = {
        "invalid": "remove or replace invalid sources and run again",
        "unchecked": "compare archived copies or run again online",
        "partial": "state reservations where partial sources are cited",
        "clean": "export the bibliography",
    }
    action = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    return scored.withColumn("conclusion", worst).select(
        "list_id", "conclusion",
        F.when(F.col("conclusion") == "invalid", F.col("n_invalid"))
        .when(F.col("conclusion") == "unchecked", unsure)
        .when(F.col("conclusion") == "partial", F.col("n_partial")).otherwise(0).alias("n_blocking"),
        action[F.col("conclusion")].alias("next_action"),
        "score", "grade", "total", *[f"n_{v}" for v in fv.VERDICTS], "n_review", "n_retracted")


def precheck(results: DataFrame) -> DataFrame:
    """Submission class per list: block, partial or clean."""
    sc = scorecard(results)
    blocked = F.col("n_invalid") + F.col("n_unreachable") + F.col("n_unverified") > 0
    return sc.select("list_id", F.when(blocked, "block").when(F.col("n_partial") > 0, "partial")
                     .otherwise("clean").alias("submission_class"), "n_invalid", "n_unreachable",
                     "n_unverified", "n_partial")


def audit_tier(results: DataFrame) -> Column:
    """P0 invalid; P1 retracted or unreachable; P2 policy hit or partial; null otherwise."""
    policy = F.col("policy_violation").isNotNull() if "policy_violation" in results.columns else F.lit(False)
    return (
        F.when(F.col("verdict") == "invalid", "P0")
        .when(_flag(results, "retracted") | (F.col("verdict") == "unreachable"), "P1")
        .when(policy | (F.col("verdict") == "partial"), "P2"))


def audit_rows(results: DataFrame) -> DataFrame:
    """Every row that belongs to a tier, with its tag."""
    retracted = _flag(results, "retracted")
    policy = F.col("policy_violation").isNotNull() if "policy_violation" in results.columns else F.lit(False)
    tag = (
        F.when(F.col("audit_tier") == "P0", "invalid")
        .when((F.col("audit_tier") == "P1") & retracted, "retracted")
        .when(F.col("audit_tier") == "P1", "unreachable")
        .when(policy, "policy").otherwise("partial"))
    return results.withColumn("audit_tier", audit_tier(results)).filter("audit_tier is not null").withColumn(
        "audit_tag", tag)


def audit_tiers(results: DataFrame) -> DataFrame:
    """Tier counts per list with subtotals per list and a grand total (rollup)."""
    rows = audit_rows(results)
    return rows.rollup("list_id", "audit_tier").agg(
        F.count("*").alias("n"), F.grouping_id().alias("level"))


def submission_readiness(results: DataFrame, document: DataFrame | None = None) -> DataFrame:
    """Ready when nothing is invalid, retracted or unreachable; open points as code arrays.

    ``document`` (list_id, n_unbound, n_uncited) adds citation findings as to-dos."""
    tier = audit_tier(results)
    retracted = _flag(results, "retracted")
    agg = results.withColumn("__t", tier).groupBy("list_id").agg(
        F.count_if(F.col("__t") == "P0").alias("p0"),
        F.count_if(F.col("__t") == "P1").alias("p1"),
        F.count_if(F.col("__t") == "P2").alias("p2"),
        F.count_if((F.col("__t") == "P1") & retracted).alias("n_retracted"),
        F.count_if((F.col("__t") == "P1") & ~retracted).alias("n_unreachable"),
        F.count_if(F.col("verdict").isin("unverified", "unreachable")).alias("n_open"))
    if document is not None:
        agg = agg.join(document.select("list_id", "n_unbound", "n_uncited"), "list_id", "left")
    else:
        agg = agg.withColumns({"n_unbound": F.lit(0), "n_uncited": F.lit(0)})
    blockers = F.array_compact(F.array(
        F.when(F.col("p0") > 0, "invalid"), F.when(F.col("n_retracted") > 0, "retracted"),
        F.when(F.col("n_unreachable") > 0, "unreachable")))
    todos = F.array_compact(F.array(
        F.when(F.col("p2") > 0, "review"), F.when(F.coalesce("n_unbound", F.lit(0)) > 0, "unbound_markers"),
        F.when(F.coalesce("n_uncited", F.lit(0)) > 0, "uncited_entries")))
    return agg.select("list_id", "p0", "p1", "p2", "n_open", blockers.alias("blockers"), todos.alias("todos"),
                      (F.size(blockers) == 0).alias("ready"))


def oa_summary(results: DataFrame) -> DataFrame:
    """Free-to-read among the references with a known status."""
    return results.groupBy("list_id").agg(
        F.count("is_oa").alias("n_checked"), F.count_if(F.col("is_oa")).alias("n_free"))


def conclusion_grade(claims: DataFrame) -> DataFrame:
    """Confidence of each claim from its sources: claim, host, tier, support.

    green: two independent supporting hosts, one of a trusted tier; yellow: one trusted host or two
    secondary ones; red: contradicted as well as supported, community level only, or unsupported.
    """
    supported = F.col("support") == "supported"
    trusted = F.col("tier").isin(*fv.TRUSTED_TIERS)
    agg = claims.groupBy("claim").agg(
        F.count_distinct(F.when(supported, F.col("host"))).alias("n_hosts"),
        F.bool_or(supported & trusted).alias("has_trusted"),
        F.bool_or(F.col("support") == "contradicted").alias("has_contradiction"),
        F.bool_and(F.when(supported, F.col("tier").isin("community", "social"))).alias("community_only"))
    colour = (
        F.when(F.col("has_contradiction") & (F.col("n_hosts") > 0), "red")
        .when((F.col("n_hosts") == 0) | F.coalesce("community_only", F.lit(False)), "red")
        .when((F.col("n_hosts") >= 2) & F.col("has_trusted"), "green")
        .when(F.col("has_trusted") | (F.col("n_hosts") >= 2), "yellow")
        .otherwise("red"))
    return agg.select("claim", "n_hosts", "has_trusted", "has_contradiction", colour.alias("confidence"))


def review_order(results: DataFrame) -> DataFrame:
    """Position of each row in the review order: verified first, invalid last, then by row."""
    from refledger.operators.common import number_rows

    rank = F.lit(9)
    for v, n in fv.REVIEW_RANK.items():
        rank = F.when(F.col("verdict") == v, n).otherwise(rank)
    ranked = results.select("list_id", "ref_id", "verdict", rank.alias("verdict_rank"))
    return number_rows(ranked, ["list_id"], "ref_id", "position", rank="verdict_rank")


QUESTIONS = [
    ("verified", "retracted_since", "Could it have been retracted or corrected after this run?"),
    ("verified", "strength", "Does the sentence claim more than the source supports?"),
    ("verified", "same_paper", "Is it this paper and not a near namesake of the same year?"),
    ("partial", "affects_claim", "Does the reason for the downgrade touch the cited sentence?"),
    ("partial", "stronger_source", "Is there a stronger source to replace it?"),
    ("unreachable", "archive_agrees", "Does the archived copy say what is claimed?"),
    ("unreachable", "second_run", "Is it still unreachable from another network?"),
    ("invalid", "typo", "Is the identifier one character off?"),
    ("invalid", "origin", "Which sentence produced it, and what else stands there?"),
    ("unverified", "what_blocks", "What keeps the online run from happening?"),
]
LIST_QUESTIONS = [
    ("flags_answered", "Has every list-level flag been answered?"),
    ("run_age", "Is the run recent enough for the submission?"),
    ("queue_empty", "Does every row of the review queue have a decision?"),
]


def review_questions(results: DataFrame) -> DataFrame:
    """Questions per reference, with the conditional ones, plus the list-level ones (ref_id null).

    The bank is a fixed table of a few rows, so its broadcast cannot grow with the data."""
    spark = results.sparkSession
    bank = spark.createDataFrame([(v, q) for v, q, _ in QUESTIONS], "verdict string, question string")
    base = results.join(F.broadcast(bank), "verdict").select("list_id", "ref_id", "verdict", "question")
    extra = F.array_compact(F.array(
        F.when(_flag(results, "in_clone_pair"), F.lit("which_clone_is_real")),
        F.when(_flag(results, "has_published_version"), F.lit("cite_published_version")),
        F.when(_flag(results, "cross_language"), F.lit("same_paper_across_languages"))))
    conditional = results.select("list_id", "ref_id", "verdict", F.explode(extra).alias("question"))
    lists = results.select("list_id").distinct().select(
        "list_id", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("string").alias("verdict"),
        F.explode(F.array(*[F.lit(q) for q, _ in LIST_QUESTIONS])).alias("question"))
    return base.unionByName(conditional).unionByName(lists)

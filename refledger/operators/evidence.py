"""Evidence passages and the combination of external judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refledger import fixed_values as fv
from refledger.functions import citations as ct
from refledger.functions import identifiers as ids
from refledger.operators.common import number_rows, top_k


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9一-鿿]+)"), 1)


def evidence_topk_tfidf(documents: DataFrame, claims: DataFrame, k: int = 2, size: int = 900,
                        overlap: int = 120) -> DataFrame:
    """Best ``k`` chunks of each claim's own document.

    Score: sum over the claim's tokens (repeats count) of tf * ln((N+1)/(df+1)), N and df within the
    document; ties keep chunk order, chunks without any token included.  A text meets the tokens of all its
    claims together and leaves as counts per chunk and token, which the single claims then join.  A chunk without
    a score can only be among the best ``k`` if it is one of the first ``k``, so those alone are added for each claim.
    """
    step = size - overlap
    query = claims.select("claim_id", "doc_id", _tokens(F.col("claim")).alias("q"))
    wanted = query.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("words"))
    counted = documents.select("doc_id", "text", F.floor((F.length("text") + step - 1) / step).alias("n_chunks"))
    texts = counted.join(wanted, "doc_id").select("doc_id", "words", F.posexplode(ct.chunks(F.col("text"), size, overlap)).alias("chunk", "passage"))
    tf = texts.select("doc_id", "chunk", F.explode(F.filter(
        _tokens(F.col("passage")), lambda t: F.array_contains("words", t))).alias("token")).groupBy("doc_id", "chunk", "token").agg(
        F.count("*").alias("tf"))
    df = tf.withColumn("df", F.count("*").over(Window.partitionBy("doc_id", "token")))
    asked = query.select("claim_id", "doc_id", F.explode("q").alias("token")).groupBy("claim_id", "doc_id", "token").agg(F.count("*").alias("qn"))
    sized = query.select("claim_id", "doc_id").join(counted.select("doc_id", "n_chunks"), "doc_id")
    weight = F.col("qn") * F.col("tf") * F.log((F.col("n_chunks") + 1) / (F.col("df") + 1))
    scored = asked.join(df, ["doc_id", "token"]).join(sized, ["claim_id", "doc_id"]).select("claim_id", "doc_id", "chunk", weight.alias("w"))
    first = sized.filter("n_chunks > 0").select("claim_id", "doc_id", F.explode(F.sequence(
        F.lit(0), (F.least(F.lit(k), F.col("n_chunks")) - 1).cast("int"))).alias("chunk"), F.lit(0.0).alias("w"))
    ranked = scored.unionByName(first).groupBy("claim_id", "doc_id", "chunk").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(ranked, ["claim_id"], [F.col("score").desc(), F.col("chunk")], k).select(
        "claim_id", "doc_id", "chunk", "rank", "score")


def evidence_passages(documents: DataFrame, ranked: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    """Text of the ranked chunks."""
    start = (F.col("chunk") * (size - overlap) + 1).cast("int")
    return ranked.join(documents.select("doc_id", "text"), "doc_id").withColumn(
        "passage", F.substr("text", start, F.lit(size))).drop("text")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def evidence_topk_cosine(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best ``k`` chunks per query inside its group by cosine; a zero norm counts as 1.

    ``chunks``: group_id, chunk_id, vector.  ``queries``: query_id, group_id, vector."""
    def norm(v):
        n = F.sqrt(_dot(v, v))
        return F.when(n == 0, F.lit(1.0)).otherwise(n)

    c = chunks.select("group_id", "chunk_id", F.col("vector").alias("cv"), norm(F.col("vector")).alias("cn"))
    q = queries.select("query_id", "group_id", F.col("vector").alias("qv"), norm(F.col("vector")).alias("qn"))
    j = c.join(q, "group_id").withColumn("score", F.round(_dot(F.col("cv"), F.col("qv")) / (F.col("cn") * F.col("qn")), 6))
    return top_k(j.select("query_id", "group_id", "chunk_id", "score"), ["query_id"],
                 [F.col("score").desc(), F.col("chunk_id")], k)


# --- judgements ------------------------------------------------------------------------------------

def _pending(results: DataFrame) -> DataFrame:
    """Rows whose semantic layer is open and which are not invalid."""
    a = F.col("semantic_audit")
    return results.filter(
        a["support"].isin("not_in_source", "unclear") & (F.coalesce(a["claim"], F.lit("")) != "")
        & (F.col("verdict") != "invalid"))


def judge_candidates(results: DataFrame) -> DataFrame:
    """Pending rows with an official text: a PMID or a new-style arXiv id."""
    has_text = ids.valid_pmid(F.col("pmid")) | F.coalesce(F.col("arxiv_id").rlike(r"\d{4}\.\d{4,5}"), F.lit(False))
    return _pending(results).filter(has_text)


def claim_judgements(results: DataFrame, votes: DataFrame, prescreen: DataFrame | None = None) -> DataFrame:
    """Judge and entailment votes combined; annotates, never turns a verdict.

    ``votes``: ref_id, judge (SUPPORTS, CONTRADICTS, NEI), nli (entailment, ...; null abstains).
    ``prescreen``: ref_id, label, prob.  Priority 2: confident refutation, 1: screened, 0: not screened.
    """
    cand = judge_candidates(results).select("list_id", "ref_id", F.col("verdict"), F.col("needs_human"),
                                            F.length(F.coalesce(F.trim("title"), F.lit(""))).alias("title_len"))
    if prescreen is not None:
        cand = cand.join(prescreen.select("ref_id", "label", "prob"), "ref_id", "left")
    else:
        cand = cand.withColumns({"label": F.lit(None).cast("string"), "prob": F.lit(None).cast("double")})
    screened = F.col("label").isNotNull() & (F.col("title_len") >= 20)
    priority = F.when(screened & (F.col("label") == "REFUTES") & (F.col("prob") >= 0.95), 2).when(screened, 1).otherwise(0)
    mapped = F.lit(None).cast("string")
    for label, v in fv.NLI_TO_VERDICT.items():
        mapped = F.when(F.col("nli") == label, v).otherwise(mapped)
    j = cand.join(votes.select("ref_id", "judge", "nli"), "ref_id").withColumn("nli_verdict", mapped)
    confidence = F.when(F.col("nli_verdict").isNull(), "single").when(
        F.col("nli_verdict") == F.col("judge"), "high").otherwise("contested")
    human = F.coalesce("needs_human", F.lit(False)) | (F.col("judge") == "CONTRADICTS") | (F.col("confidence") == "contested")
    return j.withColumn("confidence", confidence).select(
        "list_id", "ref_id", "verdict", "judge", "nli_verdict", "confidence", priority.alias("priority"),
        human.alias("needs_human"))


def judge_routing(judgements: DataFrame) -> DataFrame:
    """Order in which the expensive check should run, as ``rank`` within the list: priority, then row."""
    first = judgements.withColumn("__level", -F.col("priority"))
    return number_rows(first, ["list_id"], "ref_id", "rank", rank="__level").drop("__level")


def prescreen_notes(results: DataFrame, prescreen: DataFrame, judged: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Note-only support hints for pending rows that no judge has decided."""
    pending = _pending(results).filter(F.length(F.trim(F.coalesce("title", F.lit("")))) >= 20)
    open_rows = pending.join(judged.filter("judge is not null").select("ref_id"), "ref_id", "left_anti")
    return open_rows.join(prescreen.select("ref_id", "label", "prob"), "ref_id", "left").select(
        "list_id", "ref_id", "label", "prob",
        F.coalesce((F.col("label") == "SUPPORTS") & (F.col("prob") >= threshold), F.lit(False)).alias("leans_support"))

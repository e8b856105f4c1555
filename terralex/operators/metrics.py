"""Retrieval quality, decision quality and latency summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.numeric import finite
from terralex.operators.quantiles import require_latencies, summarize
from terralex.operators.ranking import surviving


def _quality_aggregates() -> list:
    recalls = [F.avg(f"hit_at_{k}").alias(f"recall_at_{k}") for k in fv.RECALL_KS]
    return [F.count("*").alias("cases"), F.avg("reciprocal_rank").alias("mrr"), *recalls]


def quality(evidence: DataFrame) -> DataFrame:
    """MRR and Recall@K over answerable cases, as one row."""
    return evidence.where("answerable").agg(*_quality_aggregates())


def recall_at(marked: DataFrame, cases: DataFrame, ks: Sequence[int]) -> DataFrame:
    """MRR and Recall@K for any K set from marked results."""
    if not ks or any(not isinstance(k, int) or k < 1 for k in ks):
        raise ValueError("k must be a positive integer")
    first = marked.where("is_expected").groupBy("case_id").agg(F.min("rank").alias("_rank"))
    rows = cases.select(F.col("id").alias("case_id")).join(first, "case_id", "left")
    hits = [F.avg(F.coalesce(F.col("_rank") <= k, F.lit(False)).cast("int")).alias(f"recall_at_{k}") for k in ks]
    return rows.agg(F.avg(F.coalesce(F.lit(1.0) / F.col("_rank"), F.lit(0.0))).alias("mrr"), *hits)


def quality_by_group(evidence: DataFrame) -> DataFrame:
    """Quality by language, category, challenge and language x category in one pass; null keys are dropped.

    `scope` names the grouping; columns outside it are null.
    """
    rows = evidence.where("answerable")
    sets = [["language"], ["category"], ["challenge"], ["language", "category"]]
    grouped = rows.groupingSets(sets, "language", "category", "challenge").agg(
        F.grouping_id().alias("_g"), *_quality_aggregates()
    )
    scope = (
        F.when(F.col("_g") == 3, "language").when(F.col("_g") == 5, "category")
        .when(F.col("_g") == 6, "challenge").otherwise("language_category")
    )
    named = (
        (F.col("scope") == "language") & F.col("language").isNotNull()
        | (F.col("scope") == "category") & F.col("category").isNotNull()
        | (F.col("scope") == "challenge") & F.col("challenge").isNotNull()
        | (F.col("scope") == "language_category") & F.col("language").isNotNull() & F.col("category").isNotNull()
    )
    return grouped.withColumn("scope", scope).where(named).drop("_g").select(
        "scope", "language", "category", "challenge", "cases", "mrr", *[f"recall_at_{k}" for k in fv.RECALL_KS]
    )


def decision_quality(evidence: DataFrame, threshold: float) -> DataFrame:
    """Accuracy of answering at a threshold: top-1 must survive and be expected, or nothing may survive."""
    if not 0 <= threshold <= 1:
        raise ValueError("decision threshold must be between 0 and 1")
    answered = F.coalesce(F.col("top1_score") >= threshold, F.lit(False))
    correct = F.when(F.col("answerable"), answered & (F.col("hit_at_1") == 1)).otherwise(~answered).cast("int")
    return evidence.agg(
        F.lit(float(threshold)).alias("threshold"), F.avg(correct).alias("accuracy"),
        F.avg(F.when(F.col("answerable"), correct)).alias("answerable_top1_accuracy"),
        F.avg(F.when(~F.col("answerable"), correct)).alias("no_answer_accuracy"),
    )


def latency_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return summarize(require_latencies(df, value), keys, value)


def component_latencies(rows: DataFrame, components: Sequence[str] = ("embedding", "search", "total", "client")) -> DataFrame:
    """(component, count, min, ..., max); timings that are not finite and non-negative are ignored."""
    pairs = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"{c}_ms").alias("ms")) for c in components])
    long = rows.select(F.explode(pairs).alias("t")).select("t.*")
    clean = long.withColumn("ms", F.when(finite(F.col("ms")) & (F.col("ms") >= 0), F.col("ms")))
    return summarize(clean, ["component"], "ms")


def margin_summary(evidence: DataFrame) -> DataFrame:
    return summarize(evidence.where(F.col("top1_top2_margin").isNotNull()), [], "top1_top2_margin")


def reason_counts(rejected: DataFrame, reasons: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rejection reasons counted overall or per query."""
    return rejected.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(
        F.count("*").alias("rejections")
    )


def survivors_per_case(results: DataFrame, threshold: float) -> DataFrame:
    return surviving(results, threshold).groupBy("case_id").agg(F.count("*").alias("survivors"))

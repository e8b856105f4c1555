"""Paired comparison of two evaluated variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.numeric import round_half_up
from terralex.operators.metrics import quality, quality_by_group
from terralex.session import require

METRICS = ("mrr", *[f"recall_at_{k}" for k in fv.RECALL_KS])
EVIDENCE = ("expected_rank", "top1_top2_margin", "target_margin", "top1_id", "top1_score")


def paired_cases(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per case with both variants' evidence; a case missing on either side fails the job."""
    left = before.select(
        "case_id", *[F.col(c).alias(f"before_{c}") for c in EVIDENCE], F.col("challenge").alias("_bc"),
        F.col("language").alias("_bl"), F.col("query").alias("_bq"), F.col("answerable").alias("_ba"), F.lit(True).alias("_left"),
    )
    right = after.select(
        "case_id", *[F.col(c).alias(f"after_{c}") for c in EVIDENCE], F.col("challenge").alias("_ac"), F.lit(True).alias("_right"),
    )
    missing = F.concat(F.lit("missing paired row for "), F.col("case_id"))
    joined = left.join(right, "case_id", "full_outer").where(require(F.col("_left") & F.col("_right"), missing))

    def gain(column: str) -> Column:
        return round_half_up(F.col(f"after_{column}") - F.col(f"before_{column}"))

    return joined.select(
        "case_id", F.col("_bl").alias("language"), F.col("_bq").alias("query"), F.col("_ba").alias("answerable"),
        F.coalesce("_ac", "_bc").alias("challenge"),
        *[F.col(f"{side}_{c}") for c in EVIDENCE for side in ("before", "after")],
        (F.col("before_expected_rank") - F.col("after_expected_rank")).alias("rank_gain"),
        gain("top1_top2_margin").alias("margin_delta"), gain("target_margin").alias("target_margin_delta"),
        gain("top1_score").alias("top1_score_delta"),
    )


def select_cases(paired: DataFrame, case_ids: Sequence[str]) -> DataFrame:
    """Named cases, all of which must be present."""
    found = paired.where(F.col("case_id").isin(*case_ids))
    missing = set(case_ids) - {r["case_id"] for r in found.select("case_id").distinct().collect()}
    if missing:
        raise ValueError(f"missing paired rows for {sorted(missing)}")
    return found


def no_answer_score_changes(paired: DataFrame) -> DataFrame:
    return paired.where(~F.col("answerable")).select(
        "case_id", "language", "query", "before_top1_score", "after_top1_score", "top1_score_delta"
    )


def grouped_quality(evidence: DataFrame) -> DataFrame:
    """Overall quality (scope `overall`) and every grouping in one long table."""
    none = F.lit(None).cast("string")
    overall = quality(evidence).select(
        F.lit("overall").alias("scope"), none.alias("language"), none.alias("category"), none.alias("challenge"), "cases", *METRICS
    )
    return overall.unionByName(quality_by_group(evidence))


def quality_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metric deltas overall and per group; a group missing on one side has a null delta."""
    keys = ("scope", "language", "category", "challenge")
    left = grouped_quality(before).select(*keys, *[F.col(m).alias(f"before_{m}") for m in METRICS])
    right = grouped_quality(after).select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[F.col(m).alias(f"after_{m}") for m in METRICS]
    )
    same = None
    for key in keys:
        part = left[key].eqNullSafe(right[f"_{key}"])
        same = part if same is None else same & part
    joined = left.join(right, same, "full_outer")
    return joined.select(
        *[F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) for k in keys],
        *[F.col(f"{side}_{m}") for m in METRICS for side in ("before", "after")],
        *[round_half_up(F.col(f"after_{m}") - F.col(f"before_{m}")).alias(f"delta_{m}") for m in METRICS],
    )


def rank1_regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Answerable cases at rank 1 before that are not at rank 1 after."""
    first = before.where(F.col("answerable") & (F.col("expected_rank") == 1)).select("case_id")
    kept = after.where(F.col("expected_rank") == 1).select("case_id")
    lost = first.join(kept, "case_id", "left_anti")
    ranks = after.select("case_id", F.col("expected_rank").alias("after_rank"))
    return lost.join(ranks, "case_id", "left")


def top5_misses(evidence: DataFrame) -> DataFrame:
    missed = F.col("expected_rank").isNull() | (F.col("expected_rank") > 5)
    return evidence.where(F.col("answerable") & missed).select("case_id", "expected_rank", "expected_rank_lower_bound")


def set_difference(observed: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """(key, side): ids outside the envelope (`unexpected`) and envelope ids not observed (`absent`)."""
    left, right = observed.select(key).distinct(), allowed.select(key).distinct()
    unexpected = left.join(right, key, "left_anti").withColumn("side", F.lit("unexpected"))
    absent = right.join(left, key, "left_anti").withColumn("side", F.lit("absent"))
    return unexpected.unionByName(absent)

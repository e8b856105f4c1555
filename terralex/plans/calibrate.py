"""Threshold calibration reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.operators import calibrate as ops


def _require_both_classes(evidence: DataFrame) -> None:
    seen = evidence.agg(
        F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no")
    ).first()
    if not seen["yes"]:
        raise ValueError("threshold calibration requires at least one answerable row")
    if not seen["no"]:
        raise ValueError("threshold calibration requires at least one no-answer row")


def _require_top1(evidence: DataFrame) -> None:
    bad = evidence.where(F.col("top1_score").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"calibration row {bad[0]['case_id']} is missing a finite top-1 score")


def plain(evidence: DataFrame, thresholds: Sequence[float] = fv.DEFAULT_THRESHOLDS) -> dict[str, DataFrame]:
    _require_both_classes(evidence)
    candidates = ops.sweep(evidence, thresholds)
    return {"candidates": candidates, "recommended": ops.recommended(candidates)}


def robust(evidence: DataFrame, thresholds: Sequence[float], current: float = fv.CURRENT_THRESHOLD) -> dict[str, DataFrame]:
    _require_both_classes(evidence)
    _require_top1(evidence)
    guarded = ops.with_guard_band(ops.sweep(evidence, thresholds), evidence)
    return {
        "candidates": guarded, "recommended": ops.robust_recommended(guarded, current),
        "plain_recommended": ops.recommended(guarded), "distribution": ops.top1_distribution(evidence),
        "separation": ops.separation(evidence), "errors": ops.error_cases(evidence, thresholds),
        "top1_errors": evidence.where(F.col("answerable") & (F.col("hit_at_1") == 0)),
    }


def no_answer(
    evidence: DataFrame, thresholds: Sequence[float], current: float = fv.CURRENT_THRESHOLD, lower: float = fv.LOWER_THRESHOLD
) -> dict[str, DataFrame]:
    _require_both_classes(evidence)
    _require_top1(evidence)
    candidates = ops.with_false_positive_rate(ops.sweep(evidence, thresholds))
    return {
        "candidates": candidates, "errors": ops.error_cases(evidence, thresholds),
        "by_challenge": ops.false_positives_by_challenge(evidence, thresholds),
        "distribution": ops.top1_distribution(evidence),
        "recommendation": ops.recommend_policy(candidates, current, lower),
    }

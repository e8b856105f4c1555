"""Threshold sweeps, score separation, guard bands and recommendations.

Results are ranked by score, so what survives a threshold is a prefix of each case's list. A case therefore
contributes to a sweep through three scores only (its top score, the same if the top result is expected,
and its best expected score in the first five), each turned into the number of thresholds it passes. Cases
are counted per combination of those numbers - at most a few thousand groups - before thresholds appear,
so the sweep never multiplies cases by thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.numeric import finite, round_half_up, safe_divide
from terralex.operators.quantiles import summarize


def normalise_thresholds(thresholds: Sequence[float]) -> list[float]:
    if not thresholds:
        raise ValueError("thresholds must not be empty")
    if any(not math.isfinite(t) or t < 0 or t > 1 for t in thresholds):
        raise ValueError("thresholds must be finite numbers between 0 and 1")
    return sorted({math.floor(t * 1e6 + 0.5) / 1e6 for t in thresholds})


def _passed(score: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds a score reaches."""
    literal = F.array(*[F.lit(t) for t in thresholds])
    return F.coalesce(F.when(finite(score), F.size(F.filter(literal, lambda t: t <= score))), F.lit(0))


def sweep(evidence: DataFrame, thresholds: Sequence[float] = fv.DEFAULT_THRESHOLDS, keys: Sequence[str] = ()) -> DataFrame:
    """One row per threshold (and key): confusion counts and the derived rates."""
    levels = normalise_thresholds(thresholds)
    keys = list(keys)
    top = _passed(F.col("top1_score"), levels)
    counted = evidence.select(
        *keys, "answerable", top.alias("answered"),
        F.when(F.col("answerable") & (F.col("hit_at_1") == 1), top).otherwise(F.lit(0)).alias("correct"),
        F.when(F.col("answerable"), _passed(F.col("best_expected_score_at_5"), levels)).otherwise(F.lit(0)).alias("recalled"),
    ).groupBy(*keys, "answerable", "answered", "correct", "recalled").agg(F.count("*").alias("n"))
    numbered = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(levels)])
    grid = counted.select("*", F.explode(numbered).alias("level"))
    position = F.col("level.i")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    answerable, answered = F.col("answerable"), F.col("answered") >= position
    table = grid.groupBy(*keys, F.col("level.threshold").alias("threshold")).agg(
        total(answerable & answered).alias("tp"), total(~answerable & answered).alias("fp"),
        total(answerable & ~answered).alias("fn"), total(~answerable & ~answered).alias("tn"),
        total(F.col("correct") >= position).alias("_correct"), total(F.col("recalled") >= position).alias("_recalled"),
    )
    precision = safe_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    table = table.withColumns({"precision": precision, "recall": recall})
    positives, negatives = F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return table.select(
        *keys, "threshold", "tp", "fp", "fn", "tn", "precision", "recall",
        safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        safe_divide(F.col("_correct"), positives).alias("answerable_top1_accuracy"),
        safe_divide(F.col("_recalled"), positives).alias("recall_at_5"),
        safe_divide(F.col("tn"), negatives).alias("no_answer_accuracy"),
        safe_divide(F.col("_correct") + F.col("tn"), positives + negatives).alias("decision_accuracy"),
    )


_BASE_ORDER = ("decision_accuracy", "f1", "answerable_top1_accuracy", "no_answer_accuracy")


def recommended(candidates: DataFrame) -> DataFrame:
    """Best decision accuracy, then F1, top-1, no-answer accuracy; the lower threshold wins ties."""
    return candidates.orderBy(*[F.desc(c) for c in _BASE_ORDER], F.asc("threshold")).limit(1)


def top1_distribution(evidence: DataFrame) -> DataFrame:
    """Top-1 score summary per answerability."""
    return summarize(evidence, ["answerable"], "top1_score").withColumn("mean", round_half_up(F.col("mean")))


def separation(evidence: DataFrame) -> DataFrame:
    """Lowest answerable and highest no-answer top score, their gap, and whether they overlap."""
    low = F.min(F.when(F.col("answerable"), F.col("top1_score")))
    high = F.max(F.when(~F.col("answerable"), F.col("top1_score")))
    return evidence.agg(low.alias("min_answerable_top1"), high.alias("max_no_answer_top1")).select(
        "*", round_half_up(F.col("min_answerable_top1") - F.col("max_no_answer_top1")).alias("gap"),
        (F.col("max_no_answer_top1") >= F.col("min_answerable_top1")).alias("overlap"),
    )


def with_guard_band(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Headroom of each threshold to both score populations, and the smaller of the two."""
    gap = separation(evidence).first()
    above = round_half_up(F.lit(gap["min_answerable_top1"]).cast("double") - F.col("threshold"))
    below = round_half_up(F.col("threshold") - F.lit(gap["max_no_answer_top1"]).cast("double"))
    return candidates.withColumns({
        "answerable_headroom": above, "no_answer_headroom": below,
        "guard_band": round_half_up(F.least(above, below)),
    })


def robust_recommended(guarded: DataFrame, current: float = fv.CURRENT_THRESHOLD) -> DataFrame:
    """As `recommended`, then the widest guard band, then nearest to the current threshold."""
    if not 0 <= current <= 1:
        raise ValueError("current threshold must be between 0 and 1")
    return guarded.orderBy(
        *[F.desc(c) for c in _BASE_ORDER], F.desc("guard_band"), F.abs(F.col("threshold") - current), F.asc("threshold")
    ).limit(1)


def with_false_positive_rate(candidates: DataFrame) -> DataFrame:
    """False-positive rate with its Wilson 95% interval; no negatives means no interval."""
    n = (F.col("fp") + F.col("tn")).cast("double")
    p, z2 = F.col("fp") / F.nullif(n, F.lit(0.0)), F.lit(fv.WILSON_Z**2)
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    margin = F.lit(fv.WILSON_Z) * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / scale
    some = n > 0
    return candidates.withColumns({
        "fp_rate": safe_divide(F.col("fp"), n),
        "fp_rate_lower": F.when(some, F.greatest(F.lit(0.0), centre - margin)),
        "fp_rate_upper": F.when(some, F.least(F.lit(1.0), centre + margin)),
    })


def error_cases(evidence: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, error, case columns) of every false positive and false negative; the size of the output is the work."""
    levels = normalise_thresholds(thresholds)
    values = F.array(*[F.lit(t) for t in levels])
    passed = _passed(F.col("top1_score"), levels)
    wrong = F.when(F.col("answerable"), F.slice(values, passed + 1, F.lit(len(levels)))).otherwise(
        F.slice(values, F.lit(1), passed)
    )
    error = F.when(F.col("answerable"), "false_negative").otherwise("false_positive")
    return evidence.select(
        F.explode(wrong).alias("threshold"), error.alias("error"), "case_id", "language", "challenge", "query",
        "expected_rank", "top1_id", "top1_score",
    )


def false_positives_by_challenge(evidence: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, challenge, false_positives) from counts per challenge, without listing cases."""
    named = evidence.where(~F.col("answerable")).withColumn("challenge", F.coalesce("challenge", F.lit(fv.DEFAULT_CATEGORY)))
    return sweep(named, thresholds, ["challenge"]).where("fp > 0").select(
        "threshold", "challenge", F.col("fp").alias("false_positives")
    )


def recommend_policy(
    candidates: DataFrame, current: float = fv.CURRENT_THRESHOLD, lower: float = fv.LOWER_THRESHOLD
) -> DataFrame:
    """Keep the current threshold, or lower it when that recovers answers at no cost in false positives."""
    def at(threshold: float, column: str) -> Column:
        return F.max(F.when(F.abs(F.col("threshold") - threshold) < 5e-7, F.col(column)))

    seen = candidates.agg(
        at(current, "fp").alias("fp"), at(lower, "fp").alias("lower_fp"),
        at(current, "fn").alias("fn"), at(lower, "fn").alias("lower_fn"),
    )
    names = fv.RECOMMENDATIONS
    outcome = (
        F.when(F.col("fp").isNull() | F.col("lower_fp").isNull(), F.raise_error(F.lit("threshold was not evaluated")).cast("string"))
        .when(F.col("fp") > 0, "false_positives")
        .when((F.col("lower_fp") <= F.col("fp")) & (F.col("lower_fn") < F.col("fn")), "promote")
        .when(F.col("lower_fp") > F.col("fp"), "more_false_positives").otherwise("no_gain")
    )
    seen = seen.withColumn("_outcome", outcome)

    def pick(index: int) -> Column:
        table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v[index])])
        return table[F.col("_outcome")]

    return seen.select(
        pick(0).alias("status"), pick(1).alias("reason_code"),
        F.when(F.col("_outcome") == "promote", F.lit(lower)).otherwise(F.lit(current)).alias("threshold"),
        (F.col("_outcome") == "false_positives").alias("threshold_alone_insufficient"),
        F.col("fp").alias("current_fp"), F.col("fn").alias("current_fn"), "lower_fp", "lower_fn",
    )

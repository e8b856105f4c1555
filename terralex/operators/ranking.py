"""Ranked results against expectations: hits, first expected rank, margins, per-case evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.numeric import finite, round_half_up
from terralex.session import require


def mark_expected(results: DataFrame, cases: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Add is_expected: the result id is one of the case's expected ids (any-of). Results meet their case once; its
    ids stay one array.

    Where many cases expect the same many ids, `sets` holds them once, as rows (expected_set, id), and a case names its
    set in `expected_set` (null: nothing is expected); no case then carries the ids.
    """
    if sets is not None:
        named = cases.select(F.col("id").alias("case_id"), "expected_set")
        members = sets.select("expected_set", "id").distinct().withColumn("is_expected", F.lit(True))
        marked = results.join(named, "case_id", "left").join(members, ["expected_set", "id"], "left")
        return marked.select(*[results[c] for c in results.columns], F.coalesce("is_expected", F.lit(False)).alias("is_expected"))
    wanted = cases.select(F.col("id").alias("case_id"), F.col("expected_ids").alias("_wanted"))
    hit = F.array_contains("_wanted", F.col("id"))
    return results.join(wanted, "case_id", "left").withColumn("is_expected", F.coalesce(hit, F.lit(False))).drop("_wanted")


def surviving(results: DataFrame, threshold: float) -> DataFrame:
    """Inclusive threshold; scores that are not finite never survive."""
    return results.where(finite(F.col("score")) & (F.col("score") >= F.lit(threshold)))


def answerable(column: str = "answerable") -> Column:
    return F.coalesce(F.col(column), F.lit(True))


def case_evidence(
    cases: DataFrame, marked: DataFrame, result_limit: int = fv.EVALUATION_LIMIT, clamp_margin: bool = False
) -> DataFrame:
    """One row per case from its ranked results (which may reach past `result_limit` as a rank probe).

    Margins use the raw difference unless `clamp_margin`; ranks and target margins exist for answerable
    cases only; a case whose expected rows were not found gets a lower bound of probe size + 1.
    """
    score, rank = F.col("score"), F.col("rank")
    expected = F.col("is_expected")
    first = marked.groupBy("case_id").agg(
        F.count("*").alias("probe_count"),
        F.count_if(rank <= result_limit).alias("result_count"),
        F.min(F.when(expected, rank)).alias("_rank"),
        F.max(F.when(rank == 1, F.col("id"))).alias("top1_id"),
        F.max(F.when((rank == 1) & finite(score), score)).alias("top1_score"),
        F.max(F.when((rank == 2) & finite(score), score)).alias("_second"),
        F.max(F.when(expected & finite(score), score)).alias("_target"),
        F.max(F.when(~expected & finite(score), score)).alias("_distractor"),
        F.max(F.when(expected & finite(score) & (rank <= 5), score)).alias("best_expected_score_at_5"),
    )
    gap = F.col("top1_score") - F.col("_second")
    margin = round_half_up(F.greatest(F.lit(0.0), gap) if clamp_margin else gap)
    rows = cases.withColumn("answerable", answerable()).withColumnRenamed("id", "case_id").join(
        first, "case_id", "left"
    )
    can_hit = F.col("answerable")
    hits = [
        F.coalesce(can_hit & (F.col("_rank") <= k), F.lit(False)).cast("int").alias(f"hit_at_{k}")
        for k in fv.RECALL_KS
    ]
    in_results = F.when(can_hit & (F.col("_rank") <= result_limit), F.col("_rank"))
    return rows.select(
        "case_id", "language", F.coalesce("category", F.lit(fv.DEFAULT_CATEGORY)).alias("category"), "challenge",
        "query", "answerable",
        F.when(can_hit, F.col("_rank")).alias("expected_rank"),
        F.when(can_hit & F.col("_rank").isNull(), F.coalesce("probe_count", F.lit(0)) + 1).alias(
            "expected_rank_lower_bound"
        ),
        F.coalesce(F.lit(1.0) / in_results, F.lit(0.0)).alias("reciprocal_rank"),
        *hits,
        F.coalesce("result_count", F.lit(0)).alias("result_count"), "top1_id", "top1_score",
        margin.alias("top1_top2_margin"),
        F.when(can_hit, round_half_up(F.col("_target") - F.col("_distractor"))).alias("target_margin"),
        F.when(can_hit, F.col("best_expected_score_at_5")).alias("best_expected_score_at_5"),
    )


def require_results(cases: DataFrame, results: DataFrame, key: str = "case_id") -> DataFrame:
    """Every case must have been run; a case with no result rows at all is an error."""
    seen = results.select(key).distinct().withColumn("_seen", F.lit(True))
    joined = cases.join(seen, cases["id"] == seen[key], "left")
    missing = F.concat(F.lit("missing results for "), F.col("id"))
    return joined.where(require(F.col("_seen"), missing)).select(cases["*"])


def trim_results(results: DataFrame, limits: DataFrame, key: str = "case_id") -> DataFrame:
    """Re-rank survivors and keep each query's own limit (the over-fetched rows go)."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc("id"))
    ranked = results.drop("rank").withColumn("rank", F.row_number().over(order))
    return ranked.join(limits.select(key, F.col("limit").alias("_limit")), key).where(
        F.col("rank") <= F.col("_limit")
    ).drop("_limit")

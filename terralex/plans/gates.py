"""Pass/fail gates: each returns a table of checks (check, observed, bound, passed)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.numeric import finite, round_half_up
from terralex.functions.query_intent import non_geographic_intent
from terralex.functions.text import display_name, fold, same_name
from terralex.operators import compare
from terralex.operators.metrics import quality
from terralex.operators.ranking import surviving


def accepted(checks: DataFrame) -> bool:
    return bool(checks.agg(F.min("passed").alias("ok")).first()["ok"])


def _check(df: DataFrame, name: str, observed: Column, bound: float | None, passed: Column) -> DataFrame:
    return df.select(
        F.lit(name).alias("check"), observed.cast("double").alias("observed"),
        F.lit(bound).cast("double").alias("bound"), F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _group_recall(evidence: DataFrame, name: str) -> DataFrame:
    """Recall@1 of one group as one row (null when the group has no cases)."""
    return evidence.where(F.col("answerable")).agg(F.avg("hit_at_1").alias(name))


def _in(scope: str, key: str) -> Column:
    return F.coalesce(F.col(scope) == key, F.lit(False))


def _count_check(df: DataFrame, name: str, maximum: int) -> DataFrame:
    return _check(df.agg(F.count("*").alias("n")), name, F.col("n"), maximum, F.col("n") <= maximum)


def focused_gate(before: DataFrame, after: DataFrame, rules=fv.FOCUSED_GATE, max_regressions: int = 0) -> DataFrame:
    """Minimum Recall@1 per group and no lost rank-1 cases."""
    parts = [
        _check(_group_recall(after.where(_in(scope, key)), "r"), name, F.col("r"), bound, F.col("r") >= bound)
        for name, scope, key, bound in rules
    ]
    parts.append(_count_check(compare.rank1_regressions(before, after), "rank1_regressions", max_regressions))
    return _union(parts)


def _recall_pair(before: DataFrame, after: DataFrame) -> DataFrame:
    """Recall@1 of both variants (b, a) in one aggregate; null for a side without cases."""
    sides = [
        df.where(F.col("answerable")).select(F.lit(side).alias("side"), "hit_at_1") for side, df in (("b", before), ("a", after))
    ]
    return _union(sides).agg(*[F.avg(F.when(F.col("side") == s, F.col("hit_at_1"))).alias(s) for s in ("b", "a")])


def _gain(before: DataFrame, after: DataFrame, name: str, minimum: float) -> DataFrame:
    pair = _recall_pair(before, after)
    gain = round_half_up(F.col("a") - F.col("b"))
    return _check(pair, name, gain, minimum, gain >= minimum)


def _no_regression(before: DataFrame, after: DataFrame, scope: str, key: str) -> DataFrame:
    pair = _recall_pair(before.where(_in(scope, key)), after.where(_in(scope, key)))
    name = f"{key.replace('-', '_')}_no_regression"
    return _check(pair, name, round_half_up(F.col("a") - F.col("b")), 0.0, F.col("a") >= F.col("b"))


def _gain_checks(before: DataFrame, after: DataFrame, rules: dict) -> list[DataFrame]:
    keep = ~_in("challenge", rules["challenge"])
    return [
        _gain(before, after, "overall_recall_gain", rules["overall"]),
        _gain(before.where(keep), after.where(keep), "recall_gain_without_challenge", rules["without_challenge"]),
    ]


def stress_gate(before: DataFrame, after: DataFrame, rules: dict = fv.GAIN_GATE, max_regressions: int = 0) -> DataFrame:
    """Minimum gain, a floor for hard negatives, and no group or rank-1 regression."""
    scope, key, bound = fv.HARD_NEGATIVE
    parts = _gain_checks(before, after, rules)
    parts.append(_check(_group_recall(after.where(_in(scope, key)), "r"), "hard_negative_recall", F.col("r"), bound, F.col("r") >= bound))
    parts += [_no_regression(before, after, s, k) for s, k in fv.NO_REGRESSION_GROUPS]
    parts.append(_count_check(compare.rank1_regressions(before, after), "rank1_regressions", max_regressions))
    return _union(parts)


def collection_gate(
    before: DataFrame, after: DataFrame, sentinel_ids: Sequence[str], rules: dict = fv.GAIN_GATE,
    max_regressions: int = 0, max_top5_misses: int = 0,
) -> DataFrame:
    """Gain and no regression over a full collection, all targets in the top five, sentinels at rank 1."""
    groups = (fv.HARD_NEGATIVE[:2], *fv.NO_REGRESSION_GROUPS)
    parts = _gain_checks(before, after, rules) + [_no_regression(before, after, s, k) for s, k in groups]
    parts.append(_count_check(compare.rank1_regressions(before, after), "rank1_regressions", max_regressions))
    parts.append(_count_check(compare.top5_misses(after), "top5_misses", max_top5_misses))
    at_one = after.where(F.col("case_id").isin(*sentinel_ids) & (F.col("expected_rank") == 1)) if sentinel_ids else after.limit(0)
    wanted = len(set(sentinel_ids))
    parts.append(_check(at_one.agg(F.count("*").alias("n")), "sentinels_at_rank1", F.col("n"), wanted, F.col("n") == wanted))
    return _union(parts)


def rank_gate(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """Per-case maximum rank: rules(case_id, role, max_rank); a missing case or rank fails."""
    joined = rules.join(evidence.select("case_id", "expected_rank"), "case_id", "left")
    return joined.select(
        F.concat_ws(":", "role", "case_id").alias("check"), F.col("expected_rank").cast("double").alias("observed"),
        F.col("max_rank").cast("double").alias("bound"),
        F.coalesce(F.col("expected_rank").between(1, F.col("max_rank")), F.lit(False)).alias("passed"),
    )


def execution_gate(
    evidence: DataFrame, timings: DataFrame, known_rank2: Sequence[str], max_rank: int = 5, timing_columns: Sequence[str] = ("embedding_ms", "search_ms", "total_ms", "client_ms")
) -> DataFrame:
    """Every case answered with a finite score and timings; targets kept in the top five; known rank-2 cases no worse."""
    rows = evidence.join(timings, "case_id", "left")
    known = F.col("case_id").isin(*known_rank2) if known_rank2 else F.lit(False)
    rank, answerable = F.col("expected_rank"), F.col("answerable")
    in_top = F.coalesce(rank.between(1, max_rank), F.lit(False))
    timed = reduce(lambda a, b: a & b, [finite(F.col(c)) & (F.col(c) >= 0) for c in timing_columns])
    failures = {
        "responses_present": ~((F.col("result_count") >= 1) & F.col("top1_id").isNotNull() & finite(F.col("top1_score"))),
        "timings_present": ~F.coalesce(timed, F.lit(False)),
        "answerable_in_top5": answerable & ~in_top,
        "no_new_rank1_regression": answerable & in_top & (rank > 1) & ~known,
        "known_rank2_not_worse": answerable & in_top & known & (rank > 2),
    }
    return _failure_table(rows, failures)


def _failure_table(rows: DataFrame, failures: dict[str, Column]) -> DataFrame:
    """All failure counts in one pass, one check per row."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in failures.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("observed")) for n in failures])
    return counts.select(F.explode(pairs).alias("p")).select(
        "p.check", F.col("p.observed").cast("double").alias("observed"), F.lit(0.0).alias("bound"), (F.col("p.observed") == 0).alias("passed")
    )


def production_gate(
    evidence: DataFrame, results: DataFrame, threshold: float, allowed_false_positives: Sequence[str],
    known_rank2: Sequence[str] = (), floors: dict = fv.PRODUCTION_FLOORS, limit: int = fv.EVALUATION_LIMIT,
) -> DataFrame:
    """No score below the threshold leaks, quality stays above its floors, false positives stay in their envelope."""
    wrong = evidence.where(~F.col("answerable") & (F.col("result_count") > 0))
    allowed = F.col("case_id").isin(*allowed_false_positives) if allowed_false_positives else F.lit(False)
    known = F.col("case_id").isin(*known_rank2) if known_rank2 else F.lit(False)
    leaked = results.where(finite(F.col("score")) & (F.col("score") < threshold))
    rank = F.col("expected_rank")
    contract = {
        "answerable_found": F.col("answerable") & ~F.coalesce(rank.between(1, limit), F.lit(False)),
        "rank1_kept": F.coalesce(F.col("answerable") & (F.when(known, rank > 2).otherwise(rank > 1)), F.lit(False)),
        "result_count_valid": ~F.col("result_count").between(0, limit),
        "result_contract": F.when(F.col("result_count") == 0, F.col("top1_id").isNotNull()).otherwise(
            F.col("top1_id").isNull() | F.col("top1_score").isNull()
        ),
    }
    measured = quality(evidence)
    parts = [_count_check(leaked, "threshold_leaks", 0), _failure_table(evidence, contract)]
    parts += [_check(measured, f"{m}_floor", F.col(m), bound, F.col(m) >= bound) for m, bound in floors.items()]
    parts.append(_count_check(wrong, "false_positives", len(set(allowed_false_positives))))
    parts.append(_count_check(wrong.where(~allowed), "unexpected_false_positives", 0))
    parts += [_count_check(wrong.where(_in("challenge", c)), f"{c.replace('-', '_')}_false_positives", 0) for c in fv.TARGETED_CHALLENGES]
    return _union(parts)


def intent_gate_acceptance(
    evidence: DataFrame, meta: DataFrame, target_ids: Sequence[str], expected_intent_cases: int | None = None
) -> DataFrame:
    """The recorded intent of every case equals the rule's, no false positives remain, named targets are fixed.

    `meta` is the search meta table keyed by case_id.
    """
    rule = non_geographic_intent(fold(F.col("query")))
    recorded = meta.select("case_id", "intent_applied", "intent_domain", "intent_reason", "intent_rejected")
    rows = evidence.join(recorded, "case_id", "left").withColumn("_rule", rule)
    applied = F.coalesce("intent_applied", F.lit(False))
    same = (applied == F.col("_rule").isNotNull()) & F.col("intent_domain").eqNullSafe(F.col("_rule.domain")) & F.col(
        "intent_reason"
    ).eqNullSafe(F.col("_rule.reason"))
    target = F.col("case_id").isin(*target_ids) if target_ids else F.lit(False)
    fixed = ~F.col("answerable") & (F.col("result_count") == 0) & applied & (F.col("intent_rejected") >= 1)
    parts = [
        _failure_table(rows, {
            "application_matches_rule": ~same,
            "zero_false_positives": ~F.col("answerable") & (F.col("result_count") > 0),
            "never_applied_to_answerable": F.col("answerable") & applied,
        }),
    ]
    hits = rows.where(target & fixed).agg(F.count("*").alias("n"))
    wanted = len(set(target_ids))
    parts.append(_check(hits, "targets_fixed", F.col("n"), wanted, F.col("n") == wanted))
    if expected_intent_cases is not None:
        seen = rows.where(F.col("_rule").isNotNull()).agg(F.count("*").alias("n"))
        parts.append(_check(seen, "intent_cases", F.col("n"), expected_intent_cases, F.col("n") == expected_intent_cases))
    return _union(parts)


def verification_experiment(raw: DataFrame, verified: DataFrame, cases: DataFrame, threshold: float = fv.CURRENT_THRESHOLD) -> DataFrame:
    """Before/after consistency verification. Both inputs are marked results (case_id, rank, score, is_expected)."""
    base = cases.select(F.col("id").alias("case_id"), F.coalesce("answerable", F.lit(True)).alias("answerable"), "challenge")

    def seen(marked: DataFrame, side: str) -> DataFrame:
        alive = finite(F.col("score")) & (F.col("score") >= threshold)
        return marked.groupBy("case_id").agg(
            F.min(F.when(F.col("is_expected"), F.col("rank"))).alias(f"{side}_rank"),
            F.count_if(alive).alias(f"{side}_alive"), F.count_if(alive & F.col("is_expected")).alias(f"{side}_hits"),
        )

    rows = base.join(seen(raw, "raw"), "case_id", "left").join(seen(verified, "ver"), "case_id", "left")
    zero = F.lit(0)
    yes, no = F.col("answerable"), ~F.col("answerable")
    raw_fp, ver_fp = no & (F.coalesce("raw_alive", zero) > 0), no & (F.coalesce("ver_alive", zero) > 0)
    regress = yes & F.col("raw_rank").isNotNull() & F.coalesce(F.col("ver_rank") > F.col("raw_rank"), F.lit(True))
    first, second = fv.TARGETED_CHALLENGES
    totals = rows.agg(
        F.count_if(regress).alias("regressions"), F.count_if(yes & (F.coalesce("ver_hits", zero) == 0)).alias("misses"),
        F.count_if(raw_fp).alias("raw_fp"), F.count_if(ver_fp).alias("ver_fp"),
        F.count_if(raw_fp & _in("challenge", first)).alias("raw_first"), F.count_if(ver_fp & _in("challenge", first)).alias("ver_first"),
        F.count_if(raw_fp & _in("challenge", second)).alias("raw_second"), F.count_if(ver_fp & _in("challenge", second)).alias("ver_second"),
    )
    table = F.array(
        _row("answerable_rank_regressions", F.col("regressions"), zero, F.col("regressions") == 0),
        _row("answerable_threshold_misses", F.col("misses"), zero, F.col("misses") == 0),
        _row("false_positives_reduced", F.col("ver_fp"), F.col("raw_fp"), F.col("ver_fp") < F.col("raw_fp")),
        _row("contradictory_geography_improved", F.col("ver_first"), F.col("raw_first"), F.col("ver_first") < F.col("raw_first")),
        _row("plausible_absent_not_worse", F.col("ver_second"), F.col("raw_second"), F.col("ver_second") <= F.col("raw_second")),
    )
    return totals.select(F.explode(table).alias("c")).select("c.*")


def _row(name: str, observed: Column, bound: Column, passed: Column) -> Column:
    return F.struct(
        F.lit(name).alias("check"), observed.cast("double").alias("observed"), bound.cast("double").alias("bound"), passed.alias("passed")
    )


def intent_experiment(
    raw_evidence: DataFrame, gated_evidence: DataFrame, intents: DataFrame, residual_ids: Sequence[str] | None = None
) -> DataFrame:
    """Before/after the intent gate: answerable quality kept, false positives gone, known residuals eliminated.

    `intents` has case_id and intent_applied.
    """
    joined = raw_evidence.select(
        "case_id", "answerable", F.col("expected_rank").alias("raw_rank"), F.col("result_count").alias("raw_count"),
        F.col("reciprocal_rank").alias("raw_rr"), *[F.col(f"hit_at_{k}").alias(f"raw_hit_{k}") for k in fv.RECALL_KS],
    ).join(gated_evidence.select(
        "case_id", F.col("expected_rank").alias("gated_rank"), F.col("result_count").alias("gated_count"),
        F.col("reciprocal_rank").alias("gated_rr"), *[F.col(f"hit_at_{k}").alias(f"gated_hit_{k}") for k in fv.RECALL_KS],
    ), "case_id").join(intents.select("case_id", "intent_applied"), "case_id", "left")
    yes, no = F.col("answerable"), ~F.col("answerable")
    before, after = no & (F.col("raw_count") > 0), no & (F.col("gated_count") > 0)
    residual = F.col("case_id").isin(*residual_ids) if residual_ids else F.lit(False)
    kept = F.coalesce(F.col("gated_rank") <= F.col("raw_rank"), F.lit(False))
    pairs = [("rr", "raw_rr", "gated_rr"), *[(f"h{k}", f"raw_hit_{k}", f"gated_hit_{k}") for k in fv.RECALL_KS]]
    totals = joined.agg(
        F.count_if(yes & ~kept).alias("regressions"), F.count_if(yes & F.coalesce("intent_applied", F.lit(False))).alias("applied"),
        F.count_if(before).alias("before"), F.count_if(after).alias("after"),
        F.count_if(before & residual & ~after).alias("fixed"), F.count_if(before & ~residual).alias("outside"),
        *[F.avg(F.when(yes, F.col(b) - F.col(a))).alias(n) for n, a, b in pairs],
    )
    zero, lost = F.lit(0), F.least(*[F.col(n) for n, _, _ in pairs])
    table = [
        _row("zero_answerable_regressions", F.col("regressions"), zero, F.col("regressions") == 0),
        _row("zero_answerable_applications", F.col("applied"), zero, F.col("applied") == 0),
        _row("false_positives_reduced", F.col("after"), F.col("before"), F.col("after") < F.col("before")),
        _row("zero_gated_false_positives", F.col("after"), zero, F.col("after") == 0),
        _row("answerable_quality_kept", lost, zero, lost >= 0),
    ]
    if residual_ids is not None:
        wanted = F.lit(len(set(residual_ids)))
        table.append(_row("residuals_eliminated", F.col("fixed"), wanted, F.col("fixed") == wanted))
        table.append(_row("baseline_envelope", F.col("outside"), zero, (F.col("outside") == 0) & (F.col("before") == wanted)))
    return totals.select(F.explode(F.array(*table)).alias("c")).select("c.*")


def sentinel_checks(results: DataFrame, sentinels: DataFrame) -> DataFrame:
    """sentinels(query_id, expected, negative): the expected name must be on top, or absent when negative."""
    rows = results.select(
        "query_id", "rank", display_name(F.col("name_en"), F.col("name_vi")).alias("shown"),
        F.lower(F.coalesce("type", F.lit(""))).alias("kind"),
    )
    joined = sentinels.join(rows, "query_id", "left")
    geographic = reduce(lambda a, b: a | b, [F.col("kind").contains(t) for t in fv.SENTINEL_TYPE_TOKENS])
    named = F.coalesce(same_name(F.col("shown"), F.col("expected")), F.lit(False))
    seen = joined.groupBy("query_id", "expected", "negative").agg(
        F.count_if((F.col("rank") == 1) & named).alias("_top"), F.count_if(named & geographic).alias("_bad"),
    )
    return seen.select("query_id", "expected", "negative", F.when(F.col("negative"), F.col("_bad") == 0).otherwise(F.col("_top") > 0).alias("passed"))


def no_survivors(results: DataFrame, threshold: float) -> DataFrame:
    return surviving(results, threshold).select("case_id").distinct()

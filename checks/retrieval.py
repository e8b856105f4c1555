"""Similarity search and evaluation queries over the whole vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks.inputs import sql_evidence, sql_ranked
from checks.registry import Tables, r6, register, rounded
from terralex import fixed_values as fv
from terralex.functions.numeric import round_half_up, safe_divide
from terralex.functions.vectors import cosine, l2_normalised, valid_vector
from terralex.operators import calibrate, compare, metrics, ranking
from terralex.operators.filters import compile_filter
from terralex.operators.knn import top_k
from terralex.plans import calibrate as calibration
from terralex.plans import evaluate, gates
from terralex.session import materialise

SWEEP = tuple(round(0.30 + i * 0.01, 6) for i in range(21))
SWEEP_SQL = "(SELECT CAST(round(0.30 + i * 0.01, 6) AS DOUBLE) AS threshold FROM range(21) g(i))"


@register("J7_T2_similarity_join", "SELECT case_id AS query_id, id, rank, round(score, 6) AS score FROM top", then=sql_ranked())
def similarity_join(t: Tables):
    return rounded(inputs.ranked(t), "score").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


@register(
    "J7_grid_similarity_join", "SELECT case_id AS query_id, id, rank, round(score, 6) AS score FROM top", then=sql_ranked(3))
def grid_similarity_join(t: Tables):
    """The form used when the query side is too large to broadcast."""
    found = top_k(inputs.query_vectors(t), inputs.collection(t).select("id", "embedding"), 3, digits=inputs.DIGITS,
                  broadcast_bytes=0, cell_bytes=64 * 1024)
    return rounded(found, "score").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


@register(
    "J7_P5_filtered_search",
    "SELECT case_id AS query_id, id, r AS rank, round(score, 6) AS score FROM kept",
    then=sql_ranked() | {
        "flt": "SELECT vec_id AS qid, CASE WHEN vec_id % 4 = 0 THEN 'kind' || CAST(label % 3 AS STRING) END AS kind, "
               "CASE WHEN vec_id % 4 IN (1, 2) THEN vec_id * 10 END AS low, 1 + vec_id % 6 AS k FROM embeddings",
        "okp": "SELECT p.*, f.k FROM pairs p JOIN flt f ON f.qid = p.case_id JOIN embeddings e ON e.vec_id = p.id "
               "WHERE (f.kind IS NULL OR f.kind = 'kind' || CAST(e.label % 3 AS STRING)) AND (f.low IS NULL OR p.id * 7 >= f.low) AND p.score >= 0.1",
        "num": "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS r FROM okp",
        "kept": "SELECT * FROM num WHERE r <= k",
    })
def filtered_search(t: Tables):
    """Per-query filters, limits and threshold inside the kernel."""
    kind = F.concat(F.lit("kind"), (F.col("label") % 3).cast("string"))
    mod = F.col("query_id") % 4
    queries = inputs.query_vectors(t).select(
        "query_id", "embedding", F.when(mod == 0, kind).alias("filter_type"),
        F.when(mod.isin(1, 2), (F.col("query_id") * 10).cast("double")).alias("filter_population_gte"),
        (F.col("query_id") % 6 + 1).cast("int").alias("k"),
    )
    rows = inputs.collection(t).select("id", "embedding", kind.alias("type"), (F.col("id") * 7).alias("population"))
    found = top_k(queries, rows, score_threshold=0.1, digits=inputs.DIGITS)
    return rounded(found, "score").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


@register(
    "P5_structured_filter",
    "SELECT id, population FROM ent WHERE type = 'city' AND continent = 'Asia' AND population >= 100000 AND population < 600000", "ent")
def structured_filter(t: Tables):
    condition = compile_filter({"type": "city", "continent": " Asia ", "population": {"gte": 100000, "lt": 600000}})
    return inputs.entities(t).where(condition).select("id", "population")


@register("P6_threshold", "SELECT case_id, count(*) AS survivors FROM top WHERE score >= 0.36 GROUP BY case_id", then=sql_ranked())
def threshold(t: Tables):
    return metrics.survivors_per_case(inputs.ranked(t).withColumnRenamed("query_id", "case_id"), 0.36)


@register(
    "T3_overfetch_trim",
    "SELECT case_id, id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS r "
    "FROM top WHERE id % 3 <> 0) x WHERE r <= 1 + case_id % 4", then=sql_ranked(20))
def overfetch_trim(t: Tables):
    kept = inputs.ranked(t, 20).where("id % 3 <> 0").withColumnRenamed("query_id", "case_id")
    limits = t.view("cases").select(F.col("id").alias("case_id"), (F.col("id") % 4 + 1).alias("limit"))
    return ranking.trim_results(kept, limits).select("case_id", "id", F.col("rank").cast("bigint").alias("rank"))


@register(
    "J8_mark_expected",
    "SELECT case_id, sum(CASE WHEN is_expected THEN 1 ELSE 0 END)::BIGINT AS hits, count(*) AS results FROM top GROUP BY case_id", "cases",
    then=sql_ranked())
def mark_expected(t: Tables):
    """Any-of expectation against sets of ids: those that share the case's label."""
    found = ranking.mark_expected(inputs.ranked(t).withColumnRenamed("query_id", "case_id"), inputs.expecting_cases(t), inputs.expected_sets(t))
    return found.groupBy("case_id").agg(F.count_if("is_expected").alias("hits"), F.count("*").alias("results"))


_EVIDENCE_SQL = f"""
    SELECT case_id, answerable, expected_rank, expected_rank_lower_bound, {r6('reciprocal_rank', 'reciprocal_rank')},
           hit_at_1::BIGINT AS hit_at_1, hit_at_3::BIGINT AS hit_at_3, hit_at_5::BIGINT AS hit_at_5, result_count, top1_id,
           {r6('top1_score', 'top1_score')}, {r6('top1_top2_margin', 'margin')}, {r6('target_margin', 'target_margin')} FROM evidence"""


def _shown(evidence):
    hits = [F.col(f"hit_at_{k}").cast("bigint").alias(f"hit_at_{k}") for k in fv.RECALL_KS]
    return rounded(evidence.withColumnRenamed("top1_top2_margin", "margin"), "reciprocal_rank", "top1_score", "margin", "target_margin").select(
        "case_id", "answerable", F.col("expected_rank").cast("bigint").alias("expected_rank"), "expected_rank_lower_bound", "reciprocal_rank",
        *hits, "result_count", "top1_id", "top1_score", "margin", "target_margin")


@register("C10_W2_W3_case_evidence", _EVIDENCE_SQL, "cases", then=sql_evidence(clamp=True))
def case_evidence(t: Tables):
    """Through the public report."""
    results = inputs.ranked(t).withColumnRenamed("query_id", "case_id")
    return _shown(evaluate.evaluate_cases(inputs.expecting_cases(t), results, expected_sets=inputs.expected_sets(t))["evidence"])


@register("C12_W4_rank_probe_evidence", _EVIDENCE_SQL, "cases", then=sql_evidence(50, 5))
def rank_probe_evidence(t: Tables):
    """Through the public evaluation of a whole collection; scores below 0 are not results there."""
    found = evaluate.evaluate_collection(inputs.expecting_cases(t), inputs.query_vectors(t).drop("label"), inputs.collection(t).select("id", "embedding"), 5, 50, inputs.DIGITS, inputs.expected_sets(t))
    return _shown(found)


_QUALITY = ", ".join(f"round(avg(hit_at_{k}), 6) AS recall_at_{k}" for k in fv.RECALL_KS)


@register("A5_quality", f"SELECT count(*) AS cases, round(avg(reciprocal_rank), 6) AS mrr, {_QUALITY} FROM evidence WHERE answerable", "cases", then=sql_evidence())
def quality(t: Tables):
    return rounded(metrics.quality(inputs.evidence(t)), "mrr", "recall_at_1", "recall_at_3", "recall_at_5")


@register(
    "A5_recall_any_k",
    "SELECT round(avg(CASE WHEN r IS NULL THEN 0.0 ELSE 1.0 / r END), 6) AS mrr, round(avg(CASE WHEN r <= 2 THEN 1 ELSE 0 END), 6) AS recall_at_2, "
    "round(avg(CASE WHEN r <= 10 THEN 1 ELSE 0 END), 6) AS recall_at_10 FROM cases c LEFT JOIN seen ON seen.case_id = c.id", "cases", then=sql_evidence(10, 10))
def recall_any_k(t: Tables):
    return rounded(metrics.recall_at(inputs.marked(t, 10), t.view("cases"), [2, 10]), "mrr", "recall_at_2", "recall_at_10")


@register(
    "A6_quality_by_group",
    f"""SELECT scope, language, category, challenge, count(*) AS cases, round(avg(reciprocal_rank), 6) AS mrr, {_QUALITY} FROM (
        SELECT 'language' AS scope, language, NULL AS category, NULL AS challenge, * EXCLUDE (language, category, challenge) FROM evidence
        UNION ALL SELECT 'category', NULL, category, NULL, * EXCLUDE (language, category, challenge) FROM evidence
        UNION ALL SELECT 'challenge', NULL, NULL, challenge, * EXCLUDE (language, category, challenge) FROM evidence WHERE challenge IS NOT NULL
        UNION ALL SELECT 'language_category', language, category, NULL, * EXCLUDE (language, category, challenge) FROM evidence) x
        WHERE answerable GROUP BY 1, 2, 3, 4""", "cases", then=sql_evidence())
def quality_by_group(t: Tables):
    return rounded(metrics.quality_by_group(inputs.evidence(t)), "mrr", "recall_at_1", "recall_at_3", "recall_at_5")


def _nearest_rank(source: str, value: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    ps = ", ".join(f"round(max(CASE WHEN rn = greatest(1, CAST(ceil({p / 100} * n) AS BIGINT)) THEN v END), 6) AS p{p}" for p in fv.PERCENTILES)
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {lead}max(n)::BIGINT AS count, round(min(v), 6) AS min, round(avg(v), 6) AS mean, {ps}, round(max(v), 6) AS max
        FROM (SELECT {lead}{value} AS v, row_number() OVER ({part} ORDER BY {value}) AS rn, count(*) OVER ({part}) AS n FROM {source}
              WHERE {value} IS NOT NULL) x {group}"""


_SUMMARY = ("min", "mean", "p50", "p90", "p95", "p99", "max")


@register("A7_latency_summary", _nearest_rank("events", "value", "event_type"))
def latency_summary(t: Tables):
    return rounded(metrics.latency_summary(t.table("events"), "value", ["event_type"]), *_SUMMARY)


@register("A7_latency_total", _nearest_rank("events", "value"))
def latency_total(t: Tables):
    return rounded(metrics.latency_summary(t.table("events"), "value"), *_SUMMARY)


@register("A7_component_latencies", _nearest_rank(
    "(SELECT 'embedding' AS component, value AS ms FROM events UNION ALL SELECT 'search', value * 2 FROM events "
    "UNION ALL SELECT 'total', value * 3 FROM events UNION ALL SELECT 'client', CASE WHEN event_id % 2 = 0 THEN value END FROM events) t", "ms", "component"))
def component_latencies(t: Tables):
    value = F.col("value")
    rows = t.table("events").select(
        value.alias("embedding_ms"), (value * 2).alias("search_ms"), (value * 3).alias("total_ms"),
        F.when(F.col("event_id") % 2 == 0, value).otherwise(-value - 1).alias("client_ms"))
    return rounded(metrics.component_latencies(rows), *_SUMMARY)


@register("C10_ranking_margins", _nearest_rank("evidence", "top1_top2_margin"), "cases", then=sql_evidence(clamp=True))
def ranking_margins(t: Tables):
    return rounded(metrics.margin_summary(inputs.stored_evidence(t, clamp=True)), *_SUMMARY)


@register(
    "A8_decision_quality",
    """SELECT CAST(0.37 AS DOUBLE) AS threshold, round(avg(ok), 6) AS accuracy, round(avg(CASE WHEN answerable THEN ok END), 6) AS answerable_top1_accuracy,
       round(avg(CASE WHEN NOT answerable THEN ok END), 6) AS no_answer_accuracy
       FROM (SELECT answerable, CASE WHEN answerable THEN CASE WHEN top1_score >= 0.37 AND hit_at_1 = 1 THEN 1 ELSE 0 END
             ELSE CASE WHEN top1_score >= 0.37 THEN 0 ELSE 1 END END AS ok FROM evidence) x""", "cases", then=sql_evidence())
def decision_quality(t: Tables):
    return rounded(metrics.decision_quality(inputs.evidence(t), 0.37), "accuracy", "answerable_top1_accuracy", "no_answer_accuracy")


_SWEEP_CTES = {
    "counts": f"""
        SELECT threshold, sum(CASE WHEN answerable AND top1_score >= threshold THEN 1 ELSE 0 END)::BIGINT AS tp,
               sum(CASE WHEN NOT answerable AND top1_score >= threshold THEN 1 ELSE 0 END)::BIGINT AS fp,
               sum(CASE WHEN answerable AND top1_score < threshold THEN 1 ELSE 0 END)::BIGINT AS fn,
               sum(CASE WHEN NOT answerable AND top1_score < threshold THEN 1 ELSE 0 END)::BIGINT AS tn,
               sum(CASE WHEN hit_at_1 = 1 AND top1_score >= threshold THEN 1 ELSE 0 END) AS correct,
               sum(CASE WHEN best5 >= threshold THEN 1 ELSE 0 END) AS recalled
        FROM evidence, {SWEEP_SQL} s GROUP BY threshold""",
    "rates": """
        SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r,
               correct / (tp + fn) AS answerable_top1_accuracy, recalled / (tp + fn) AS recall_at_5, tn / (fp + tn) AS no_answer_accuracy,
               (correct + tn) / (tp + fp + fn + tn) AS decision_accuracy FROM counts""",
    "swept": "SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM rates",
}
_SWEEP_SELECT = ", ".join(["threshold", "tp", "fp", "fn", "tn", r6("p", "precision"), r6("r", "recall"), *[
    r6(c, c) for c in ("f1", "answerable_top1_accuracy", "recall_at_5", "no_answer_accuracy", "decision_accuracy")]])
_RATES = ("precision", "recall", "f1", "answerable_top1_accuracy", "recall_at_5", "no_answer_accuracy", "decision_accuracy")


@register("A9_threshold_sweep", f"SELECT {_SWEEP_SELECT} FROM swept", "cases", then=sql_evidence() | _SWEEP_CTES)
def threshold_sweep(t: Tables):
    return rounded(calibrate.sweep(inputs.evidence(t), SWEEP), *_RATES)


@register(
    "A10_C15_recommended_threshold",
    f"SELECT {_SWEEP_SELECT} FROM swept ORDER BY round(decision_accuracy, 9) DESC, round(f1, 9) DESC, round(answerable_top1_accuracy, 9) DESC, "
    "round(no_answer_accuracy, 9) DESC, threshold LIMIT 1", "cases", then=sql_evidence() | _SWEEP_CTES)
def recommended_threshold(t: Tables):
    return rounded(calibration.plain(inputs.evidence(t), SWEEP)["recommended"], *_RATES)


@register("A11_score_distribution", _nearest_rank("evidence", "top1_score", "answerable"), "cases", then=sql_evidence())
def score_distribution(t: Tables):
    return rounded(calibrate.top1_distribution(inputs.stored_evidence(t)), *_SUMMARY)


_GAP = {"gap": "SELECT min(CASE WHEN answerable THEN top1_score END) AS lo, max(CASE WHEN NOT answerable THEN top1_score END) AS hi FROM evidence"}


@register("A11_separation", "SELECT round(lo, 6) AS lo, round(hi, 6) AS hi, round(lo - hi, 6) AS gap, hi >= lo AS overlap FROM gap", "cases", then=sql_evidence() | _GAP)
def separation(t: Tables):
    return rounded(calibrate.separation(inputs.evidence(t)), "gap", "min_answerable_top1", "max_no_answer_top1").select(
        F.col("min_answerable_top1").alias("lo"), F.col("max_no_answer_top1").alias("hi"), "gap", "overlap")


@register(
    "A12_guard_band",
    "SELECT threshold, round(lo - threshold, 6) AS answerable_headroom, round(threshold - hi, 6) AS no_answer_headroom, "
    "round(least(lo - threshold, threshold - hi), 6) AS guard_band FROM swept, gap", "cases", then=sql_evidence() | _SWEEP_CTES | _GAP)
def guard_band(t: Tables):
    evidence = inputs.stored_evidence(t)
    guarded = calibrate.with_guard_band(calibrate.sweep(evidence, SWEEP), evidence)
    return rounded(guarded, "answerable_headroom", "no_answer_headroom", "guard_band").select(
        "threshold", "answerable_headroom", "no_answer_headroom", "guard_band")


@register(
    "A12_C15_robust_threshold",
    "SELECT threshold, tp, fp, fn, tn FROM swept, gap ORDER BY round(decision_accuracy, 9) DESC, round(f1, 9) DESC, "
    "round(answerable_top1_accuracy, 9) DESC, round(no_answer_accuracy, 9) DESC, round(least(lo - threshold, threshold - hi), 9) DESC, "
    "abs(threshold - 0.4), threshold LIMIT 1", "cases", then=sql_evidence() | _SWEEP_CTES | _GAP)
def robust_threshold(t: Tables):
    return calibration.robust(inputs.stored_evidence(t), SWEEP, 0.4)["recommended"].select("threshold", "tp", "fp", "fn", "tn")


_Z = fv.WILSON_Z


@register(
    "A13_false_positive_rate",
    f"""SELECT threshold, {r6('p', 'fp_rate')}, {r6('greatest(0, centre - margin)', 'fp_rate_lower')}, {r6('least(1, centre + margin)', 'fp_rate_upper')} FROM (
        SELECT threshold, fp / n AS p, (fp / n + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS centre,
               {_Z} * sqrt((fp / n * (1 - fp / n) + {_Z} * {_Z} / (4 * n)) / n) / (1 + {_Z} * {_Z} / n) AS margin
        FROM (SELECT threshold, fp, CAST(fp + tn AS DOUBLE) AS n FROM swept) y) x""", "cases", then=sql_evidence() | _SWEEP_CTES)
def false_positive_rate(t: Tables):
    rates = calibrate.with_false_positive_rate(calibrate.sweep(inputs.evidence(t), SWEEP))
    return rounded(rates, "fp_rate", "fp_rate_lower", "fp_rate_upper").select("threshold", "fp_rate", "fp_rate_lower", "fp_rate_upper")


@register(
    "A14_error_cases",
    f"SELECT threshold, CASE WHEN answerable THEN 'false_negative' ELSE 'false_positive' END AS error, case_id FROM evidence, {SWEEP_SQL} s "
    "WHERE answerable = (top1_score < threshold)", "cases", then=sql_evidence())
def error_cases(t: Tables):
    return calibrate.error_cases(inputs.evidence(t), SWEEP).select("threshold", "error", "case_id")


@register(
    "A14_false_positives_by_challenge",
    f"SELECT threshold, coalesce(challenge, 'uncategorized') AS challenge, count(*) AS false_positives FROM evidence, {SWEEP_SQL} s "
    "WHERE NOT answerable AND top1_score >= threshold GROUP BY 1, 2", "cases", then=sql_evidence())
def false_positives_by_challenge(t: Tables):
    return calibrate.false_positives_by_challenge(inputs.evidence(t), SWEEP)


@register(
    "A25_C15_recommendation_policy",
    """SELECT CASE WHEN c.fp > 0 THEN 'retain-production-investigate-false-positives' WHEN l.fp <= c.fp AND l.fn < c.fn THEN 'promote-candidate'
              ELSE 'retain-production' END AS status, c.fp AS current_fp, c.fn AS current_fn, l.fp AS lower_fp, l.fn AS lower_fn
       FROM swept c, swept l WHERE c.threshold = 0.46 AND l.threshold = 0.42""", "cases", then=sql_evidence() | _SWEEP_CTES)
def recommendation_policy(t: Tables):
    table = calibration.no_answer(inputs.stored_evidence(t), SWEEP, 0.46, 0.42)["recommendation"]
    return table.select("status", "current_fp", "current_fn", "lower_fp", "lower_fn")


# ---------------------------------------------------------------- paired comparison: reversed queries, then the vectors themselves

_BOTH = sql_evidence(prefix="b_") | sql_evidence(variant="self", prefix="a_")


def _variants(t: Tables):
    return inputs.stored_evidence(t), inputs.stored_evidence(t, variant="self")


@register(
    "J9_paired_cases",
    "SELECT b.case_id, b.expected_rank AS before_rank, a.expected_rank AS after_rank, b.expected_rank - a.expected_rank AS rank_gain, "
    "round(a.top1_top2_margin - b.top1_top2_margin, 6) AS margin_delta, round(a.target_margin - b.target_margin, 6) AS target_margin_delta "
    "FROM b_evidence b JOIN a_evidence a USING (case_id)", "cases", then=_BOTH)
def paired_cases(t: Tables):
    paired = compare.paired_cases(*_variants(t))
    return rounded(paired, "margin_delta", "target_margin_delta").select(
        "case_id", F.col("before_expected_rank").cast("bigint").alias("before_rank"), F.col("after_expected_rank").cast("bigint").alias("after_rank"),
        F.col("rank_gain").cast("bigint").alias("rank_gain"), "margin_delta", "target_margin_delta")


def _group_sql(name: str) -> str:
    return f"""SELECT scope, k, avg(reciprocal_rank) AS mrr, avg(hit_at_1) AS r1, avg(hit_at_5) AS r5 FROM (
        SELECT 'overall' AS scope, '' AS k, * FROM {name} UNION ALL SELECT 'language', language, * FROM {name}
        UNION ALL SELECT 'category', category, * FROM {name} UNION ALL SELECT 'challenge', challenge, * FROM {name} WHERE challenge IS NOT NULL
        UNION ALL SELECT 'language_category', language || category, * FROM {name}) x WHERE answerable GROUP BY 1, 2"""


@register(
    "A24_C13_metric_deltas",
    f"SELECT b.scope, b.k, round(a.mrr - b.mrr, 6) AS d_mrr, round(a.r1 - b.r1, 6) AS d_r1, round(a.r5 - b.r5, 6) AS d_r5 "
    f"FROM ({_group_sql('b_evidence')}) b JOIN ({_group_sql('a_evidence')}) a USING (scope, k)", "cases", then=_BOTH)
def metric_deltas(t: Tables):
    deltas = compare.quality_deltas(*_variants(t))
    key = F.concat_ws("", "language", "category", "challenge")
    return rounded(deltas.select("scope", key.alias("k"), F.col("delta_mrr").alias("d_mrr"), F.col("delta_recall_at_1").alias("d_r1"),
                                 F.col("delta_recall_at_5").alias("d_r5")), "d_mrr", "d_r1", "d_r5")


@register(
    "U3_rank1_regressions",
    "SELECT a.case_id, b.expected_rank AS after_rank FROM a_evidence a JOIN b_evidence b USING (case_id) "
    "WHERE a.answerable AND a.expected_rank = 1 AND (b.expected_rank IS NULL OR b.expected_rank <> 1)", "cases", then=_BOTH)
def rank1_regressions(t: Tables):
    before, after = _variants(t)
    return compare.rank1_regressions(after, before).select("case_id", F.col("after_rank").cast("bigint").alias("after_rank"))


@register(
    "C13_no_answer_changes",
    "SELECT b.case_id, round(a.top1_score - b.top1_score, 6) AS delta FROM b_evidence b JOIN a_evidence a USING (case_id) WHERE NOT b.answerable",
    "cases", then=_BOTH)
def no_answer_changes(t: Tables):
    changes = evaluate.compare_variants(*_variants(t))["no_answer"]
    return rounded(changes.select("case_id", F.col("top1_score_delta").alias("delta")), "delta")


@register(
    "U4_set_difference",
    "SELECT id, 'unexpected' AS side FROM (SELECT DISTINCT id FROM top WHERE id NOT IN (SELECT id FROM cases WHERE answerable)) x UNION ALL "
    "SELECT id, 'absent' FROM cases WHERE answerable AND id NOT IN (SELECT id FROM top)", "cases", then=sql_ranked())
def set_difference(t: Tables):
    return compare.set_difference(inputs.ranked(t), t.view("cases").where("answerable"), "id")


# ---------------------------------------------------------------- gates

_RECALL = "SELECT avg(CASE WHEN {c} THEN hit_at_1 END) AS v FROM {e} WHERE answerable"
_REGRESSED = ("SELECT count(*) AS v FROM b_evidence b JOIN a_evidence a USING (case_id) WHERE b.answerable AND b.expected_rank = 1 "
              "AND (a.expected_rank IS NULL OR a.expected_rank <> 1)")


def _floor_check(name: str, scope: str, key: str, bound: float, e: str = "a_evidence") -> str:
    inner = _RECALL.format(c=f"{scope} = '{key}'", e=e)
    return f"SELECT '{name}' AS \"check\", round(v, 6) AS observed, coalesce(v >= {bound}, FALSE) AS passed FROM ({inner}) x"


def _gain_check(name: str, condition: str, bound: float) -> str:
    a, b = (_RECALL.format(c=condition, e=e) for e in ("a_evidence", "b_evidence"))
    return f"SELECT '{name}', round(a.v - b.v, 6), coalesce(a.v - b.v >= {bound}, FALSE) FROM ({a}) a, ({b}) b"


_REGRESSION_CHECK = f"SELECT 'rank1_regressions', CAST(v AS DOUBLE), v <= 0 FROM ({_REGRESSED}) x"


def _table(checks):
    return rounded(checks, "observed").select("check", "observed", "passed")


@register("C16_focused_gate", " UNION ALL ".join([*[_floor_check(*rule) for rule in fv.FOCUSED_GATE], _REGRESSION_CHECK]), "cases", then=_BOTH)
def focused_gate(t: Tables):
    return _table(gates.focused_gate(*_variants(t)))


_GAINS = [
    _gain_check("overall_recall_gain", "TRUE", 0.025),
    _gain_check("recall_gain_without_challenge", "coalesce(challenge, '') <> 'no-diacritics'", 0.02),
]


def _no_regression_sql(scope: str, key: str) -> str:
    return _gain_check(f"{key.replace('-', '_')}_no_regression", f"{scope} = '{key}'", 0.0)


@register(
    "C17_stress_gate",
    " UNION ALL ".join([_floor_check("hard_negative_recall", *fv.HARD_NEGATIVE), *_GAINS, *[_no_regression_sql(s, k) for s, k in fv.NO_REGRESSION_GROUPS], _REGRESSION_CHECK]),
    "cases", then=_BOTH)
def stress_gate(t: Tables):
    return _table(gates.stress_gate(*_variants(t)))


@register(
    "C18_collection_gate",
    " UNION ALL ".join([
        _floor_check("unused", "category", "none", 2) + " WHERE FALSE", *_GAINS,
        *[_no_regression_sql(s, k) for s, k in (fv.HARD_NEGATIVE[:2], *fv.NO_REGRESSION_GROUPS)], _REGRESSION_CHECK,
        "SELECT 'top5_misses', CAST(count(*) AS DOUBLE), count(*) = 0 FROM a_evidence WHERE answerable AND (expected_rank IS NULL OR expected_rank > 5)",
        "SELECT 'sentinels_at_rank1', CAST(count(*) AS DOUBLE), count(*) = 3 FROM a_evidence WHERE case_id IN (1, 2, 4) AND expected_rank = 1",
    ]), "cases", then=_BOTH)
def collection_gate(t: Tables):
    return _table(gates.collection_gate(*_variants(t), sentinel_ids=[1, 2, 4]))


@register(
    "C19_rank_gate",
    "SELECT case_id, CAST(expected_rank AS DOUBLE) AS observed, coalesce(expected_rank <= 1 + case_id % 3, FALSE) AS passed FROM evidence",
    "cases", then=sql_evidence())
def rank_gate(t: Tables):
    rules = t.view("cases").select(F.col("id").alias("case_id"), F.lit("case").alias("role"), (F.col("id") % 3 + 1).alias("max_rank"))
    checks = gates.rank_gate(inputs.evidence(t), rules)
    return checks.select(F.split("check", ":")[1].cast("bigint").alias("case_id"), "observed", "passed")


@register(
    "C20_execution_gate",
    """SELECT x."check", x.observed, x.observed = 0 AS passed FROM (
       SELECT 'responses_present' AS "check", CAST(count(CASE WHEN result_count < 1 THEN 1 END) AS DOUBLE) AS observed FROM evidence
       UNION ALL SELECT 'timings_present', CAST(count(CASE WHEN case_id % 10 = 0 THEN 1 END) AS DOUBLE) FROM evidence
       UNION ALL SELECT 'answerable_in_top5', CAST(count(CASE WHEN answerable AND expected_rank IS NULL THEN 1 END) AS DOUBLE) FROM evidence
       UNION ALL SELECT 'no_new_rank1_regression', CAST(count(CASE WHEN expected_rank > 1 AND case_id NOT IN (1, 2) THEN 1 END) AS DOUBLE) FROM evidence
       UNION ALL SELECT 'known_rank2_not_worse', CAST(count(CASE WHEN expected_rank > 2 AND case_id IN (1, 2) THEN 1 END) AS DOUBLE) FROM evidence) x""",
    "cases", then=sql_evidence())
def execution_gate(t: Tables):
    value = F.lit(1.5)
    timings = t.view("cases").select(
        F.col("id").alias("case_id"), value.alias("embedding_ms"), value.alias("search_ms"), value.alias("total_ms"),
        F.when(F.col("id") % 10 != 0, value).alias("client_ms"))
    return gates.execution_gate(inputs.stored_evidence(t), timings, [1, 2]).select("check", "observed", "passed")


_PRODUCTION = {
    "alive": "SELECT * FROM ranked WHERE score >= 0.4 AND rank <= 5",
    "seen2": "SELECT case_id, min(CASE WHEN is_expected THEN rank END) AS r, count(*) AS n FROM alive GROUP BY case_id",
    "ev2": "SELECT c.*, r, coalesce(n, 0) AS n FROM cases c LEFT JOIN seen2 ON seen2.case_id = c.id",
}


@register(
    "C21_production_gate",
    """SELECT x."check", x.observed, CASE WHEN x."check" LIKE '%floor' THEN x.observed >= x.bound ELSE x.observed <= x.bound END AS passed FROM (
       SELECT 'threshold_leaks' AS "check", CAST(0 AS DOUBLE) AS observed, CAST(0 AS DOUBLE) AS bound
       UNION ALL SELECT 'false_positives', CAST(count(*) AS DOUBLE), 3 FROM ev2 WHERE NOT answerable AND n > 0
       UNION ALL SELECT 'unexpected_false_positives', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE NOT answerable AND n > 0 AND id NOT IN (3, 6, 9)
       UNION ALL SELECT 'contradictory_geography_false_positives', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE NOT answerable AND n > 0 AND challenge = 'contradictory-geography'
       UNION ALL SELECT 'plausible_absent_entity_false_positives', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE NOT answerable AND n > 0 AND challenge = 'plausible-absent-entity'
       UNION ALL SELECT 'answerable_found', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE answerable AND r IS NULL
       UNION ALL SELECT 'mrr_floor', round(avg(CASE WHEN r IS NULL THEN 0 ELSE 1.0 / r END), 6), 0.99375 FROM ev2 WHERE answerable
       UNION ALL SELECT 'recall_at_1_floor', round(avg(CASE WHEN r = 1 THEN 1 ELSE 0 END), 6), 0.9875 FROM ev2 WHERE answerable
       UNION ALL SELECT 'recall_at_3_floor', round(avg(CASE WHEN r <= 3 THEN 1 ELSE 0 END), 6), 1 FROM ev2 WHERE answerable
       UNION ALL SELECT 'recall_at_5_floor', round(avg(CASE WHEN r <= 5 THEN 1 ELSE 0 END), 6), 1 FROM ev2 WHERE answerable
       UNION ALL SELECT 'rank1_kept', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE answerable AND r > 1
       UNION ALL SELECT 'result_count_valid', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE n > 5
       UNION ALL SELECT 'result_contract', CAST(count(*) AS DOUBLE), 0 FROM ev2 WHERE n < 0) x""", "cases",
    then=sql_ranked() | _PRODUCTION)
def production_gate(t: Tables):
    results = materialise(inputs.marked(t, threshold=0.4))
    evidence = materialise(ranking.case_evidence(t.view("cases").drop("label"), results))
    checks = gates.production_gate(evidence, results, 0.4, [3, 6, 9])
    return rounded(checks, "observed").select("check", "observed", "passed")


# ---------------------------------------------------------------- vectors

@register(
    "F14_cosine",
    "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS score FROM embeddings")
def cosine_similarity(t: Tables):
    value = round_half_up(cosine(F.col("embedding"), F.reverse("embedding")), 12)
    return t.table("embeddings").select("vec_id", F.round(value, 6).alias("score"))


@register(
    "F15_F16_normalised_vectors",
    "SELECT vec_id, TRUE AS valid, CAST(1 AS DOUBLE) AS norm, round(embedding[1] / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS first FROM embeddings")
def normalised_vectors(t: Tables):
    scaled = F.transform("embedding", lambda x: x * F.lit(3.0).cast("float"))
    rows = t.table("embeddings").select("vec_id", valid_vector(F.col("embedding"), 64).alias("valid"), l2_normalised(scaled).alias("u"))
    norm = F.aggregate("u", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.select("vec_id", "valid", F.round(F.sqrt(norm), 5).alias("norm"), F.round(F.col("u")[0].cast("double"), 5).alias("first"))


@register(
    "F17_rounding",
    "SELECT c_custkey, floor(c_acctbal / 7 * 1000 + 0.5) / 1000 AS rounded, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE round(c_acctbal / (c_custkey % 5), 6) END AS ratio FROM customer")
def rounding(t: Tables):
    mod = F.col("c_custkey") % 5
    return t.table("customer").select(
        "c_custkey", round_half_up(F.col("c_acctbal") / 7, 3).alias("rounded"), F.round(safe_divide(F.col("c_acctbal"), mod), 6).alias("ratio"))

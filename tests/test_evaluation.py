"""Metrics, sweeps, comparison and gates."""

import random

import pytest
from pyspark.sql import functions as F

from terralex import schema
from terralex.operators import calibrate, compare, metrics
from terralex.operators.quantiles import exact_percentiles, summarize
from terralex.operators.ranking import case_evidence, mark_expected, require_results
from terralex.plans import calibrate as plans
from terralex.plans import gates
from terralex.plans.evaluate import evaluate_cases

CASES = "id string, language string, query string, expected_ids array<string>, category string, challenge string, answerable boolean"


def make(spark, rows):
    """rows: (id, expected, answerable, [(result id, score), ...])"""
    cases = spark.createDataFrame([(i, "en", f"q {i}", e, "country-factual", None, a) for i, e, a, _ in rows], CASES)
    results = [(i, n + 1, r, s) for i, _, _, found in rows for n, (r, s) in enumerate(found)]
    return cases, spark.createDataFrame(results, schema.RESULT)


def test_summary_golden(spark):
    row = summarize(spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double"), [], "v").first()
    assert (row["min"], row["mean"], row["p50"], row["p90"], row["p95"], row["p99"], row["max"]) == (1, 2.5, 2, 4, 4, 4, 4)
    empty = summarize(spark.createDataFrame([], "v double"), [], "v").first()
    assert (empty["count"], empty["p50"], empty["max"]) == (0, 0, 0)


def test_percentiles_stay_exact_beyond_the_sketch(spark):
    """A coarse sketch on skewed, repetitive groups still brackets the exact nearest-rank value."""
    random.seed(3)
    data = [("hot", float(int(random.expovariate(0.01)))) for _ in range(6000)] + [("cold", random.random()) for _ in range(37)] + [("one", 5.0)]
    found = exact_percentiles(spark.createDataFrame(data, "k string, v double").repartition(5), ["k"], "v", [1, 50, 95, 99, 100], accuracy=50)
    for r in found.collect():
        values = sorted(v for k, v in data if k == r["k"])
        assert r["value"] == values[max(0, -(-int(r["percentile"]) * len(values) // 100) - 1)], r


def test_quality_golden(spark):
    cases, results = make(spark, [("a", ["x"], None, [("x", 0.9), ("y", 0.8)]), ("b", ["y"], True, [("x", 0.9), ("y", 0.8)])])
    row = metrics.recall_at(mark_expected(results, cases), cases, [1, 2]).first()
    assert (row["mrr"], row["recall_at_1"], row["recall_at_2"]) == (0.75, 0.5, 1.0)
    with pytest.raises(ValueError):
        metrics.recall_at(mark_expected(results, cases), cases, [0])


def test_any_expected_id_counts_and_margins(spark):
    cases, results = make(spark, [
        ("a", ["x", "z"], True, [("y", 0.9), ("z", 0.9), ("x", 0.1)]), ("n", [], False, [("y", 0.7)]), ("m", ["q"], True, [("y", 0.7), ("z", 0.6)])])
    rows = {r["case_id"]: r for r in case_evidence(cases, mark_expected(results, cases)).collect()}
    assert (rows["a"]["expected_rank"], rows["a"]["hit_at_1"], rows["a"]["hit_at_3"], rows["a"]["top1_top2_margin"], rows["a"]["target_margin"]) == (2, 0, 1, 0.0, 0.0)
    assert (rows["n"]["expected_rank"], rows["n"]["top1_top2_margin"], rows["n"]["target_margin"]) == (None, None, None)
    assert (rows["m"]["expected_rank"], rows["m"]["expected_rank_lower_bound"], rows["m"]["reciprocal_rank"]) == (None, 3, 0.0)


def random_rows(n=60):
    random.seed(11)
    out = []
    for i in range(n):
        found = sorted(((f"r{random.randrange(8)}{j}", round(random.uniform(0.2, 0.8), 3)) for j in range(random.randrange(0, 8))), key=lambda x: (-x[1], x[0]))
        yes = i % 3 != 0
        out.append((f"c{i:02d}", [f[0] for f in random.sample(found, min(len(found), 2))] if yes else [], yes, found))
    return out


def test_sweep_matches_brute_force(spark):
    rows = random_rows()
    cases, results = make(spark, rows)
    evidence = case_evidence(cases, mark_expected(results, cases), 8)
    swept = {round(r["threshold"], 6): r for r in calibrate.sweep(evidence).collect()}
    assert len(swept) == 41
    for threshold, got in swept.items():
        alive = {i: [f for f in found if f[1] >= threshold] for i, _, _, found in rows}
        tp = sum(bool(alive[i]) for i, _, yes, _ in rows if yes)
        fp = sum(bool(alive[i]) for i, _, yes, _ in rows if not yes)
        top = sum(bool(alive[i]) and alive[i][0][0] in e for i, e, yes, _ in rows if yes)
        five = sum(any(f[0] in e for f in alive[i][:5]) for i, e, yes, _ in rows if yes)
        positives = sum(yes for _, _, yes, _ in rows)
        tn = len(rows) - positives - fp
        assert (got["tp"], got["fp"], got["fn"], got["tn"]) == (tp, fp, positives - tp, tn)
        assert got["answerable_top1_accuracy"] == pytest.approx(top / positives)
        assert got["recall_at_5"] == pytest.approx(five / positives)
        assert got["decision_accuracy"] == pytest.approx((top + tn) / len(rows))


def test_lower_threshold_wins_ties(spark):
    cases, results = make(spark, [("a", ["x"], True, [("x", 0.9)]), ("n", [], False, [("y", 0.1)])])
    evidence = case_evidence(cases, mark_expected(results, cases))
    assert plans.plain(evidence)["recommended"].first()["threshold"] == pytest.approx(0.30)
    assert plans.robust(evidence, [0.3, 0.5, 0.55])["recommended"].first()["threshold"] == pytest.approx(0.5)


def test_calibration_refuses_one_sided_input(spark):
    cases, results = make(spark, [("a", ["x"], True, [("x", 0.9)])])
    evidence = case_evidence(cases, mark_expected(results, cases))
    with pytest.raises(ValueError, match="no-answer"):
        plans.plain(evidence)
    with pytest.raises(ValueError):
        calibrate.normalise_thresholds([1.5])


@pytest.mark.parametrize("scores,status", [
    (((0.54,), (0.1,)), "promote-candidate"), (((0.9,), (0.6,)), "retain-production-investigate-false-positives"),
    (((0.9,), (0.54,)), "retain-production"), (((0.9,), (0.1,)), "retain-production")])
def test_recommendation_policy(spark, scores, status):
    yes, no = scores
    cases, results = make(spark, [("a", ["x"], True, [("x", yes[0])]), ("n", [], False, [("y", no[0])])])
    table = plans.no_answer(case_evidence(cases, mark_expected(results, cases)), [0.5, 0.53, 0.55])
    assert table["recommendation"].first()["status"] == status


def test_false_positive_interval(spark):
    frame = spark.createDataFrame([(0.5, 3, 117), (0.6, 0, 0)], "threshold double, fp bigint, tn bigint")
    first, none = calibrate.with_false_positive_rate(frame).orderBy("threshold").collect()
    assert first["fp_rate"] == pytest.approx(0.025) and first["fp_rate_lower"] == pytest.approx(0.00853, abs=1e-4) and first["fp_rate_upper"] == pytest.approx(0.07093, abs=1e-4)
    assert none["fp_rate"] == 0 and none["fp_rate_lower"] is None


def test_missing_pairs_and_results_fail(spark):
    cases, results = make(spark, [("a", ["x"], True, [("x", 0.9)]), ("b", ["x"], True, [("x", 0.9)])])
    evidence = case_evidence(cases, mark_expected(results, cases))
    with pytest.raises(Exception, match="missing paired row"):
        compare.paired_cases(evidence, evidence.where("case_id = 'a'")).collect()
    with pytest.raises(Exception, match="missing results for b"):
        require_results(cases, results.where("case_id = 'a'")).collect()


def test_gates(spark):
    good, results = make(spark, [(f"c{i}", ["x"], True, [("x", 0.9), ("y", 0.5)]) for i in range(4)])
    worse = [(f"c{i}", ["x"], True, [("y", 0.9), ("x", 0.5)] if i == 0 else [("x", 0.9), ("y", 0.5)]) for i in range(4)]
    after = case_evidence(good, mark_expected(results, good))
    _, slipped = make(spark, worse)
    before = case_evidence(good, mark_expected(slipped, good))
    table = {r["check"]: r for r in gates.collection_gate(before, after, ["c0"]).collect()}
    assert table["overall_recall_gain"]["passed"] and table["rank1_regressions"]["passed"] and table["sentinels_at_rank1"]["passed"]
    assert not table["city_capital_no_regression"]["passed"]  # a group without cases cannot prove anything
    back = {r["check"]: r for r in gates.focused_gate(after, before).collect()}
    assert back["rank1_regressions"]["observed"] == 1 and not back["rank1_regressions"]["passed"]
    assert not gates.accepted(gates.focused_gate(after, before))
    rules = spark.createDataFrame([("c0", "known", 2), ("absent", "easy", 1)], "case_id string, role string, max_rank int")
    assert {r["check"]: r["passed"] for r in gates.rank_gate(before, rules).collect()} == {"known:c0": True, "easy:absent": False}


def test_production_gate_envelope(spark):
    cases, results = make(spark, [("a", ["x"], True, [("x", 0.9)]), ("n1", [], False, [("y", 0.6)]), ("n2", [], False, [])])
    evidence = case_evidence(cases, mark_expected(results, cases))
    assert gates.accepted(gates.production_gate(evidence, results, 0.55, ["n1"]))
    refused = {r["check"]: r["passed"] for r in gates.production_gate(evidence, results, 0.7, []).collect()}
    assert not refused["threshold_leaks"] and not refused["unexpected_false_positives"]


def test_report_tables(spark):
    cases, results = make(spark, random_rows(12))
    timings = cases.select(F.col("id").alias("case_id"), *[F.lit(2.0).alias(f"{c}_ms") for c in ("embedding", "search", "total", "client")])
    report = evaluate_cases(cases, results, timings, 0.5)
    assert report["latency"].first()["p99"] == 2.0 and report["latency_by_component"].count() == 4
    assert report["decision_quality"].first()["threshold"] == 0.5
    with pytest.raises(Exception, match="latencies"):
        metrics.latency_summary(timings.withColumn("total_ms", F.lit(-1.0)), "total_ms").collect()


def test_rates_count_what_passes_the_total(spark):
    """Twelve points a second for 300 s, of a total that was stated as 1,000."""
    from terralex.operators.stats import progress_snapshots, running_progress

    rows = spark.createDataFrame([("r", b, 1000, 12, 12, 0, 1000.0, 500.0, 250.0) for b in range(1, 301)],
                                 "run_id string, batch long, total long, embedded long, upserted long, skipped_existing long, elapsed_ms double, embedding_ms double, upsert_ms double")
    last = progress_snapshots(rows, 50).orderBy("batch").collect()
    assert [r["rate_per_second"] for r in last] == [12.0] * 7 and [r["upsert_docs_per_second"] for r in last] == [48.0] * 7
    assert (last[-1]["upserted"], last[-1]["percent"], last[-1]["eta_ms"]) == (3600, 100.0, 0.0)
    assert [r["eta_ms"] > 0 for r in last] == [True, True] + [False] * 5
    one = running_progress(rows).first()
    assert (one["rate_per_second"], one["percent"], one["eta_ms"]) == (12.0, 100.0, 0.0)


def test_cases_share_sets_of_expected_ids(spark):
    """Marks are those of the arrays, though no case carries its ids; repeated members and unknown cases change nothing."""
    cases = spark.createDataFrame([("a", ["x", "y"]), ("b", []), ("c", ["x", "y"]), ("d", ["z"])], "id string, expected_ids array<string>")
    named = spark.createDataFrame([("a", 1), ("b", None), ("c", 1), ("d", 2)], "id string, expected_set int")
    sets = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "z")], "expected_set int, id string")
    results = spark.createDataFrame([(c, i, n) for c in "abcde" for n, i in enumerate("xyz")], "case_id string, id string, rank int")
    want = sorted(map(tuple, mark_expected(results, cases).select("case_id", "id", "rank", "is_expected").collect()))
    assert sorted(map(tuple, mark_expected(results, named, sets).select("case_id", "id", "rank", "is_expected").collect())) == want


@pytest.mark.parametrize("name", ["verification_experiment", "intent_experiment"])
def test_experiments_prepare_their_requests_once(spark, monkeypatch, name):
    """The search and the checks read the requests in many passes: they are given a stored table."""
    from checks import text
    from checks.registry import Tables

    class Seen(Exception):
        pass

    def search(requests, *rest):
        raise Seen(requests._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(text, "search_candidates", search)
    with pytest.raises(Seen) as seen:
        getattr(text, name)(Tables(spark, "/root/testdata/sf0.001"))
    assert "Join" not in str(seen.value)

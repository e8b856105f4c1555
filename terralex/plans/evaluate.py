"""Evaluation of search results and text experiments."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.document_text import document_text
from terralex.operators import compare
from terralex.operators.embed import Embedder, embed_by_columns, embed_distinct, embed_texts
from terralex.operators.knn import top_k
from terralex.operators.metrics import (
    component_latencies,
    decision_quality,
    latency_summary,
    margin_summary,
    quality,
    quality_by_group,
)
from terralex.operators.ranking import case_evidence, mark_expected, require_results
from terralex.session import materialise


def evaluate_cases(
    cases: DataFrame, results: DataFrame, timings: DataFrame | None = None, decision_threshold: float | None = None,
    result_limit: int = fv.EVALUATION_LIMIT, expected_sets: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables of a report: evidence, quality, groups, margins, and decision quality / latency when asked for.

    Cases carry `expected_ids`, or name a set of `expected_sets` (see `mark_expected`).
    """
    marked = mark_expected(results, cases, expected_sets)
    evidence = case_evidence(cases, marked, result_limit, clamp_margin=True)
    report = {
        "evidence": evidence, "quality": quality(evidence), "quality_by_group": quality_by_group(evidence),
        "ranking_margins": margin_summary(evidence),
    }
    if decision_threshold is not None:
        report["decision_quality"] = decision_quality(evidence, decision_threshold)
    if timings is not None:
        report["latency"] = latency_summary(timings, "total_ms")
        report["latency_by_component"] = component_latencies(timings)
    return report


def evaluate_collection(
    cases: DataFrame, query_vectors: DataFrame, collection: DataFrame, result_limit: int = fv.EVALUATION_LIMIT,
    rank_probe: int = 100, digits: int = 12, expected_sets: DataFrame | None = None,
) -> DataFrame:
    """Evidence against a whole collection, looking `rank_probe` results deep for expected ids."""
    if rank_probe < result_limit:
        raise ValueError("rank probe must be at least the result limit")
    found = materialise(top_k(query_vectors, collection, rank_probe, 0.0, digits=digits).withColumnRenamed("query_id", "case_id"))
    complete = require_results(cases, found)
    return case_evidence(complete, mark_expected(found, cases, expected_sets), result_limit)


def evaluate_candidates(
    cases: DataFrame, query_vectors: DataFrame, candidates: DataFrame, candidate_count: int,
    result_limit: int = fv.EVALUATION_LIMIT, digits: int = 12,
) -> DataFrame:
    """Evidence on a bounded candidate set, where every candidate keeps its rank."""
    found = top_k(query_vectors, candidates, candidate_count, digits=digits).withColumnRenamed("query_id", "case_id")
    complete = require_results(cases, found)
    return case_evidence(complete, mark_expected(found, cases), result_limit)


def no_answer_scores(evidence: DataFrame) -> DataFrame:
    return latency_summary(evidence.where(~F.col("answerable")), "top1_score")


def compare_variants(before: DataFrame, after: DataFrame, excluded_challenge: str = fv.GAIN_GATE["challenge"]) -> dict[str, DataFrame]:
    """Deltas overall and per group, the same without one challenge, paired cases and no-answer changes."""
    paired = compare.paired_cases(before, after)
    keep = ~F.coalesce(F.col("challenge") == excluded_challenge, F.lit(False))
    return {
        "deltas": compare.quality_deltas(before, after),
        "deltas_without_challenge": compare.quality_deltas(before.where(keep), after.where(keep)).where("scope = 'overall'"),
        "paired": paired, "no_answer": compare.no_answer_score_changes(paired),
        "regressions": compare.rank1_regressions(before, after),
    }


def text_experiment(
    cases: DataFrame, entities: DataFrame, selection: DataFrame, make_embedder: Callable[[], Embedder] | None = None,
    versions: tuple[str, str] = ("v1", "v2.1"), batch_size: int = 128, result_limit: int = fv.EVALUATION_LIMIT, digits: int = 12,
    embedding: Callable[[Column], Column] | None = None,
) -> Mapping[str, DataFrame]:
    """One candidate set, two document texts, one set of query vectors; from a model, or from an embedder stated as
    a Column of the text."""
    if (make_embedder is None) == (embedding is None):
        raise ValueError("give either a model or a column embedder")
    answerable = cases.where(F.coalesce("answerable", F.lit(True)))
    chosen = entities.join(F.broadcast(selection.select("id")), "id")  # a selection has a bounded target size
    size = selection.count()
    asked = answerable.select(F.col("id").alias("query_id"), "query")
    queries = embed_by_columns(asked, "query", embedding) if embedding else embed_distinct(asked, "query", make_embedder)
    queries = materialise(queries.select("query_id", "embedding"))
    variants = {}
    for version in versions:
        texts = chosen.select("id", document_text(version).alias("text"))
        embedded = embed_by_columns(texts, "text", embedding) if embedding else embed_texts(texts, "text", make_embedder, batch_size)
        vectors = materialise(embedded.select("id", "embedding"))  # the search scans them more than once
        variants[version] = materialise(evaluate_candidates(answerable, queries, vectors, size, result_limit, digits))
    before, after = (variants[v] for v in versions)
    return {"before": before, "after": after, **compare_variants(before, after)}

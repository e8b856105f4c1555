"""Search: validate, read constraints, over-fetch, verify, gate, trim, count."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.query_intent import (
    constrained,
    constraints,
    geographic_type,
    non_geographic_intent,
    rejection_reasons,
)
from terralex.functions.text import fold
from terralex.operators.embed import Embedder, embed_distinct
from terralex.operators.knn import top_k
from terralex.operators.payload import attach_payload
from terralex.operators.ranking import trim_results
from terralex.operators.validate import validate_requests
from terralex.session import materialise


@dataclass(frozen=True)
class SearchOptions:
    verify_consistency: bool = True
    gate_intent: bool = True
    candidate_multiplier: int = fv.DEFAULT_CANDIDATE_MULTIPLIER
    default_limit: int = fv.DEFAULT_LIMIT
    max_limit: int = fv.MAX_LIMIT
    default_threshold: float = fv.DEFAULT_SCORE_THRESHOLD
    digits: int = 12


def prepare_requests(requests: DataFrame, options: SearchOptions = SearchOptions()) -> tuple[DataFrame, DataFrame]:
    """(valid requests with constraints, intent and candidate limit; rejected requests with `_error`)."""
    checked = validate_requests(requests, options.default_limit, options.max_limit, options.default_threshold)
    rejected = checked.where(F.col("_error").isNotNull())
    rows = checked.where(F.col("_error").isNull()).drop("_error").withColumn("_folded", fold(F.col("query")))
    empty = F.struct(*[F.lit(None).cast("string").alias(n) for n in ("entity_type", "continent", "capital")])
    wanted = constraints(F.col("query"), F.col("_folded")) if options.verify_consistency else empty
    none = F.lit(None).cast("struct<domain:string,reason:string>")
    intent = non_geographic_intent(F.col("_folded")) if options.gate_intent else none
    rows = rows.withColumns({"constraints": wanted, "intent": intent}).drop("_folded")
    applied = constrained(F.col("constraints"))
    widened = F.least(F.lit(options.max_limit), F.col("limit") * options.candidate_multiplier)
    return rows.withColumns({
        "consistency_applied": applied, "candidate_limit": F.when(applied, widened).otherwise(F.col("limit")).cast("int"),
    }), rejected


def verify_results(results: DataFrame, result_type: str = "type", continent: str = "continent", capital: str = "capital",
                   wanted: str = "constraints") -> DataFrame:
    """Add consistency_reasons; empty means accepted."""
    return results.withColumn("consistency_reasons", rejection_reasons(
        F.col(result_type), F.col(continent), F.col(capital), F.col(wanted)
    ))


def gate_results(results: DataFrame, result_type: str = "type", intent: str = "intent") -> DataFrame:
    """Add intent_reasons to rows that passed verification: cities and countries of a non-geographic query."""
    rejected = F.col(intent).isNotNull() & geographic_type(F.col(result_type)) & (F.size("consistency_reasons") == 0)
    return results.withColumn("intent_reasons", F.when(rejected, F.array(F.lit(fv.REASON_INTENT))).otherwise(
        F.array().cast("array<string>")
    ))


def search_candidates(
    requests: DataFrame, collection: DataFrame, options: SearchOptions = SearchOptions(),
    make_embedder: Callable[[], Embedder] | None = None, keep: Callable[[DataFrame], DataFrame] = materialise,
) -> DataFrame:
    """Prepared requests -> judged candidates with payload (before the final trim).

    Requests carry `embedding`, or an embedder is applied once per distinct query text. `keep` stores a step.
    """
    if "embedding" not in requests.columns:
        if make_embedder is None:
            raise ValueError("requests need an embedding column or an embedder")
        requests = keep(embed_distinct(requests, "query", make_embedder))  # read by several passes below
    key = "entity_id" if "entity_id" in collection.columns else "id"
    searchable = collection if key == "id" else collection.withColumn("id", F.col("entity_id"))
    filters = [c for c in requests.columns if c.startswith("filter_")]
    queries = requests.select("query_id", "embedding", F.col("candidate_limit").alias("k"), "score_threshold", *filters)
    found = keep(top_k(queries, searchable, digits=options.digits).withColumnRenamed("rank", "candidate_rank"))
    context = requests.select("query_id", "constraints", "intent")
    judged = attach_payload(found, searchable).join(context, "query_id")
    capital = F.col("facts.capital") if "facts" in judged.columns else F.lit(None).cast("string")
    judged = verify_results(judged.withColumn("_capital", capital), capital="_capital").drop("_capital")
    return gate_results(judged).drop("constraints", "intent")


def accepted_rows(judged: DataFrame) -> DataFrame:
    return judged.where((F.size("consistency_reasons") == 0) & (F.size("intent_reasons") == 0))


def search(
    requests: DataFrame, collection: DataFrame, options: SearchOptions = SearchOptions(),
    make_embedder: Callable[[], Embedder] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, meta). Results are ranked rows per query; meta is one row per valid request."""
    valid = materialise(prepare_requests(requests, options)[0])
    judged = materialise(search_candidates(valid, collection, options, make_embedder))
    return search_results(valid, judged), search_meta(valid, judged)


def search_results(valid: DataFrame, judged: DataFrame) -> DataFrame:
    """The accepted candidates, cut to each request's limit."""
    kept = trim_results(accepted_rows(judged), valid, "query_id")
    return kept.drop("consistency_reasons", "intent_reasons", "candidate_rank")


def search_meta(valid: DataFrame, judged: DataFrame) -> DataFrame:
    """Counters per request: candidates, rejections by reason, returned rows."""
    def reason(column: str, name: str):
        return F.count_if(F.array_contains(column, name))

    counts = judged.groupBy("query_id").agg(
        F.count("*").alias("candidate_count"),
        F.count_if(F.size("consistency_reasons") > 0).alias("consistency_rejected"),
        F.count_if(F.size("intent_reasons") > 0).alias("intent_rejected"),
        reason("consistency_reasons", fv.REASON_TYPE).alias("rejected_type"),
        reason("consistency_reasons", fv.REASON_CONTINENT).alias("rejected_continent"),
        reason("consistency_reasons", fv.REASON_CAPITAL).alias("rejected_capital"),
    )
    rows = valid.select(
        "query_id", "query", "language", "limit", "candidate_limit", "consistency_applied",
        F.col("constraints.entity_type").alias("constraint_entity_type"),
        F.col("constraints.continent").alias("constraint_continent"), F.col("constraints.capital").alias("constraint_capital"),
        F.col("intent").isNotNull().alias("intent_applied"), F.col("intent.domain").alias("intent_domain"),
        F.col("intent.reason").alias("intent_reason"),
    ).join(counts, "query_id", "left")
    numbers = [c for c in counts.columns if c != "query_id"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    kept = F.col("candidate_count") - F.col("consistency_rejected") - F.col("intent_rejected")
    return rows.withColumn("count", F.least(kept, F.col("limit").cast("bigint")))

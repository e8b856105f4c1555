"""Candidate sets for the cases of all continents and all results, and searches that ask every text, at once and as a
stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks.collections import _CAND, _FOCUS, _FOCUSED, _STRESS, _candidate_inputs, scratch
from checks.registry import Tables, register, rounded
from checks.text import _SEARCH, OPTIONS, _payload
from terralex import fixed_values as fv
from terralex.operators import candidates
from terralex.plans.search import search
from terralex.session import materialise, resident
from terralex.streaming import jobs

_ALL = {name: text.replace(" AND continent IN ('Africa', 'Asia')", "").replace(" AND k.continent IN ('Africa', 'Asia')", "") for name, text in _CAND.items()}
_ALL_FOCUSED = _FOCUSED | _ALL | {"fill": _FOCUSED["fill"].replace("LIMIT (SELECT 75 -", "LIMIT (SELECT 120 -")}
_ALL_STRESS = _STRESS | _ALL | {"kept": _STRESS["kept"].replace("pos <= 140", "pos <= 400")}


@register("J14_all_distractors", "SELECT id, min(case_id) AS first_case, min(rank) AS best_rank FROM res GROUP BY id", "ent", then=_ALL)
def all_distractors(t: Tables):
    """Every result of every case."""
    cases, results, _ = _candidate_inputs(t, "true", None)
    return candidates.mine_distractors(results, cases).select("id", F.col("seq.a").alias("first_case"), F.col("seq.b").cast("bigint").alias("best_rank"))


@register("T4_F20_U2_all_focused", "SELECT id, reason FROM need UNION ALL SELECT id, reason FROM fill", "ent", then=_ALL_FOCUSED)
def all_focused(t: Tables):
    return candidates.focused_candidates(*_candidate_inputs(t, "true"), focus_case_ids=_FOCUS, target_size=120).select("id", "reason")


def _stress(t: Tables):
    return candidates.stress_candidates(*_candidate_inputs(t, "true"), target_size=400, max_size=600)


def _tier():
    return (F.array_position(F.array(*[F.lit(x) for x in fv.STRESS_TIERS]), F.col("tier")) - 1).alias("tier")


@register("T5_W8_F21_all_stress", "SELECT id, reasons, tier FROM kept", "ent", then=_ALL_STRESS)
def all_stress(t: Tables):
    selection, _ = _stress(t)
    return selection.select("id", F.array_join("reasons", "|").alias("reasons"), _tier())


@register("A19_all_tier_counts", "SELECT tier, count(*) AS selected FROM kept GROUP BY tier", "ent", then=_ALL_STRESS)
def all_tier_counts(t: Tables):
    selection, _ = _stress(t)
    return candidates.tier_counts(selection).select(_tier(), "selected")


_FLAGS = ("all-country", "all-capital-city", "expected", "hard-report-distractor", "capital-locality", "related-major-city", "global-major-city")


@register(
    "A19_F21_all_pool_sizes",
    " UNION ALL ".join(f"SELECT '{name}' AS tier, count(CASE WHEN f{i} THEN 1 END) AS candidates FROM flags" for i, name in enumerate(_FLAGS)), "ent", then=_ALL_STRESS)
def all_pool_sizes(t: Tables):
    return _stress(t)[1]


# ---------------------------------------------------------------- every text is asked, with a vector by its number

_EVERY = _SEARCH | {
    "req": """SELECT k.query_id AS case_id, k.query_id % (SELECT count(*) FROM embeddings) AS vec, k.entity_type, k.continent, k.capital, k.domain, 3 AS lim,
              CASE WHEN k.entity_type IS NOT NULL OR k.continent IS NOT NULL OR k.capital IS NOT NULL THEN 15 ELSE 3 END AS cand
              FROM keyed k WHERE length(k.query) <= 1000 AND trim(k.query) <> ''""",
    "prs": """SELECT r.case_id, d.vec_id AS id,
              floor(list_cosine_similarity(list_reverse(CAST(q.embedding AS DOUBLE[])), CAST(d.embedding AS DOUBLE[])) * 1e9 + 0.5) / 1e9 AS score
              FROM req r JOIN embeddings q ON q.vec_id = r.vec, embeddings d""",
}


def _every_request(t: Tables):
    vectors = inputs.query_vectors(t).select(F.col("query_id").alias("vec"), "embedding")
    number = t.table("embeddings").count()
    return t.view("query_text").withColumn("vec", F.col("query_id") % number).join(vectors, "vec").select("query_id", "query", "embedding")


def _shown(results):
    return rounded(results, "score").select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), "score")


@register("C1_every_text", "SELECT case_id AS query_id, id, rank, round(score, 6) AS score FROM fin", "query_text", then=_EVERY)
def every_text(t: Tables):
    return _shown(search(_every_request(t), _payload(t), OPTIONS)[0])


@register(
    "C2_C3_A15_every_text_meta",
    """SELECT r.case_id AS query_id, r.cand AS candidate_limit, r.domain IS NOT NULL AS intent_applied, count(j.id) AS candidate_count,
              count(CASE WHEN inconsistent THEN 1 END) AS consistency_rejected, count(CASE WHEN NOT inconsistent AND j.domain IS NOT NULL THEN 1 END) AS intent_rejected,
              least(3, count(CASE WHEN NOT inconsistent AND j.domain IS NULL THEN 1 END)) AS count
       FROM req r LEFT JOIN jd j USING (case_id) GROUP BY 1, 2, 3""", "query_text", then=_EVERY)
def every_text_meta(t: Tables):
    _, meta = search(_every_request(t), _payload(t), OPTIONS)
    return meta.select("query_id", F.col("candidate_limit").cast("bigint").alias("candidate_limit"), "intent_applied", "candidate_count", "consistency_rejected", "intent_rejected", "count")


@register(
    "R4_every_request",
    """SELECT 'answer' AS kind, case_id AS query_id, id, rank FROM fin UNION ALL
       SELECT 'rejected', query_id, NULL, NULL FROM keyed WHERE length(query) > 1000 OR trim(query) = ''""", "query_text", then=_EVERY)
def every_request_streamed(t: Tables):
    """All texts as a stream of requests: constraints, intents and rejected requests included."""
    source, output = scratch(t), scratch(t)
    rows = _every_request(t)
    rows.repartition(3).write.parquet(source)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    with resident(materialise(_payload(t))) as collection:
        jobs.search_stream(stream, collection, output, scratch(t), OPTIONS).awaitTermination()
    answers = t.spark.read.parquet(f"{output}/results").select(F.lit("answer").alias("kind"), "query_id", "id", F.col("rank").cast("bigint").alias("rank"))
    none = F.lit(None).cast("bigint")
    return answers.unionByName(t.spark.read.parquet(f"{output}/rejected").select(F.lit("rejected").alias("kind"), "query_id", none.alias("id"), none.alias("rank")))

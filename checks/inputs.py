"""Spark tables built from the views: entities, cases, vectors and marked results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Tables
from terralex.operators.knn import top_k
from terralex.operators.normalize import city_entities, country_entities
from terralex.operators.ranking import case_evidence
from terralex.session import fail_on_errors, materialise

DIGITS = 9


def countries(t: Tables) -> DataFrame:
    return t.view("country_src").withColumn("languages", F.array(F.lit("en"), F.lower("iso3")))


def cities(t: Tables) -> DataFrame:
    absent = ("timezone", "admin2_code", "admin3_code", "admin4_code", "modification_date")
    return t.view("city_src").withColumns({
        **{c: F.lit(None).cast("string") for c in absent},
        "latitude": F.lit(None).cast("double"), "longitude": F.lit(None).cast("double"),
        "elevation": F.lit(None).cast("int"), "dem": F.lit(None).cast("int"),
    })


def city_rows(t: Tables) -> DataFrame:
    return fail_on_errors(city_entities(cities(t), countries(t), t.view("admin1_src")))


def country_rows(t: Tables) -> DataFrame:
    return fail_on_errors(country_entities(countries(t)))


def entities(t: Tables) -> DataFrame:
    return city_rows(t).unionByName(country_rows(t))


def stored_entities(t: Tables) -> DataFrame:
    """The entities as a stored table, which is how jobs after the dataset build receive them."""
    return materialise(entities(t))


def stored_evidence(t: Tables, **options) -> DataFrame:
    return materialise(evidence(t, **options))


def collection(t: Tables) -> DataFrame:
    return t.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def query_vectors(t: Tables, variant: str = "reversed") -> DataFrame:
    """Every vector asks: with its values in reverse order, or as it is (which finds itself)."""
    vector = F.reverse("embedding") if variant == "reversed" else F.col("embedding")
    return t.table("embeddings").select(F.col("vec_id").alias("query_id"), vector.alias("embedding"), "label")


def ranked(t: Tables, k: int = 5, variant: str = "reversed", threshold: float | None = None) -> DataFrame:
    return top_k(query_vectors(t, variant), collection(t).select("id", "embedding"), k, threshold, digits=DIGITS)


def marked(t: Tables, k: int = 5, variant: str = "reversed", threshold: float | None = None) -> DataFrame:
    """Ranked results with is_expected: the result has the query's label and the query is answerable."""
    found = ranked(t, k, variant, threshold).withColumnRenamed("query_id", "case_id")
    cases = t.view("cases").select(F.col("id").alias("case_id"), F.col("label").alias("_want"), "answerable")
    labels = collection(t).select("id", F.col("label").alias("_have"))
    return found.join(cases, "case_id").join(labels, "id").withColumn(
        "is_expected", F.col("answerable") & (F.col("_want") == F.col("_have"))
    ).drop("_want", "_have", "answerable")


def expecting_cases(t: Tables) -> DataFrame:
    """Cases that name the set of ids they expect: those of their label, none for a case without an answer."""
    return t.view("cases").withColumn("expected_set", F.when(F.col("answerable"), F.col("label"))).drop("label")


def expected_sets(t: Tables) -> DataFrame:
    """The ids of every label, once each."""
    return collection(t).select(F.col("label").alias("expected_set"), "id")


def evidence(t: Tables, k: int = 5, limit: int = 5, variant: str = "reversed", clamp: bool = False) -> DataFrame:
    return case_evidence(t.view("cases").drop("label"), marked(t, k, variant), limit, clamp)


# ---------------------------------------------------------------- the same tables in SQL

def _pairs(vector: str) -> str:
    return f"""
        SELECT q.vec_id AS case_id, d.vec_id AS id, q.vec_id % 3 <> 0 AND q.label = d.label AS is_expected,
               floor(list_cosine_similarity({vector}, CAST(d.embedding AS DOUBLE[])) * 1e9 + 0.5) / 1e9 AS score
        FROM embeddings q, embeddings d"""


def sql_ranked(k: int = 5, variant: str = "reversed") -> dict[str, str]:
    vector = "CAST(q.embedding AS DOUBLE[])"
    if variant == "reversed":
        vector = f"list_reverse({vector})"
    return {
        "pairs": _pairs(vector),
        "ranked": "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) AS rank FROM pairs",
        "top": f"SELECT * FROM ranked WHERE rank <= {k}",
    }


def sql_evidence(k: int = 5, limit: int = 5, variant: str = "reversed", clamp: bool = False, prefix: str = "") -> dict[str, str]:
    """CTEs ending in `evidence`, one row per case."""
    gap = "(s1 - s2)"
    margin = f"floor({'greatest(0, ' + gap + ')' if clamp else gap} * 1e12 + 0.5) / 1e12"
    ctes = sql_ranked(k, variant) | {
        "seen": f"""
            SELECT case_id, min(CASE WHEN is_expected THEN rank END) AS r, max(CASE WHEN rank = 1 THEN id END) AS top1_id,
                   max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2,
                   max(CASE WHEN is_expected THEN score END) AS target, max(CASE WHEN NOT is_expected THEN score END) AS other,
                   max(CASE WHEN is_expected AND rank <= 5 THEN score END) AS best5, count(*) AS probe,
                   count(CASE WHEN rank <= {limit} THEN 1 END) AS result_count
            FROM top GROUP BY case_id""",
        "evidence": f"""
            SELECT c.id AS case_id, c.language, c.category, c.challenge, c.answerable,
                   CASE WHEN c.answerable THEN r END AS expected_rank,
                   CASE WHEN c.answerable AND r IS NULL THEN probe + 1 END AS expected_rank_lower_bound,
                   CASE WHEN c.answerable AND r <= {limit} THEN 1.0 / r ELSE 0.0 END AS reciprocal_rank,
                   CASE WHEN c.answerable AND r <= 1 THEN 1 ELSE 0 END AS hit_at_1,
                   CASE WHEN c.answerable AND r <= 3 THEN 1 ELSE 0 END AS hit_at_3,
                   CASE WHEN c.answerable AND r <= 5 THEN 1 ELSE 0 END AS hit_at_5,
                   result_count, top1_id, s1 AS top1_score, {margin} AS top1_top2_margin,
                   CASE WHEN c.answerable THEN floor((target - other) * 1e12 + 0.5) / 1e12 END AS target_margin,
                   CASE WHEN c.answerable THEN best5 END AS best5
            FROM cases c JOIN seen ON seen.case_id = c.id""",
    }
    if prefix:
        ctes = {prefix + k_: _prefixed(v, ctes, prefix) for k_, v in ctes.items()}
    return ctes


def _prefixed(text: str, names, prefix: str) -> str:
    for name in names:
        for word in ("FROM ", "JOIN "):
            text = text.replace(f"{word}{name} ", f"{word}{prefix}{name} ").replace(f"{word}{name}\n", f"{word}{prefix}{name}\n")
            if text.endswith(f"{word}{name}"):
                text = text[: -len(name)] + prefix + name
    if prefix:
        text = text.replace("ON seen.case_id", f"ON {prefix}seen.case_id")
    return text


def sql_fold(x: str) -> str:
    plain = f"lower(strip_accents(replace(replace(coalesce({x}, ''), 'đ', 'd'), 'Đ', 'D')))"
    unquoted = f"regexp_replace({plain}, '[“”‘’''\"`]', '', 'g')"
    return f"trim(regexp_replace({unquoted}, '[^a-z0-9]+', ' ', 'g'))"

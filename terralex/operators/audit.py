"""State and provenance checks of a collection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.operators.filters import runtime_matches


def collection_counts(collection: DataFrame, fingerprint: str) -> DataFrame:
    return collection.select("index_fingerprint").agg(
        F.count("*").alias("points"), F.count_if(F.col("index_fingerprint") == fingerprint).alias("matching")
    )


def load_mode(points: int, matching: int, expected: int) -> str:
    """fresh / resume / idempotent; foreign or surplus points are an error."""
    if expected < 1:
        raise ValueError("expected points must be a positive integer")
    if points > expected:
        raise ValueError(f"collection contains {points} points but this load expects {expected}; use a new collection")
    if matching != points:
        raise ValueError("collection contains points from a different dataset or embedding configuration")
    return "fresh" if points == 0 else "idempotent" if points == expected else "resume"


def verify_load(points: int, matching: int, expected: int) -> None:
    if points != expected or matching != expected:
        raise ValueError(f"load verification failed: expected {expected} points, got total={points}, matching={matching}")


def provenance_counts(
    collection: DataFrame, runtime: Mapping, embedding_model: str | None = None, text_version: str | None = None,
    semantic_only: bool = False,
) -> DataFrame:
    """points and matching in one pass over the provenance columns only."""
    matches = runtime_matches(runtime, embedding_model, text_version, semantic_only)
    return collection.agg(F.count("*").alias("points"), F.count_if(matches).alias("matching"))


def audit_provenance(collection: DataFrame, expected: int, runtime: Mapping, **options) -> dict:
    counts = provenance_counts(collection, runtime, **options).first().asDict()
    if counts["points"] != expected or counts["matching"] != expected:
        raise ValueError(
            f"provenance verification failed: expected {expected} points, got total={counts['points']}, matching={counts['matching']}"
        )
    return counts


def collection_stats(collection: DataFrame) -> DataFrame:
    return collection.agg(
        F.count("*").alias("points"), F.min(F.size("embedding")).alias("min_dimension"),
        F.max(F.size("embedding")).alias("max_dimension"),
    )


def check_pairing(text_version: str, collection_name: str, reserved: Mapping[str, str]) -> None:
    """`reserved` maps a text version to the only collection it may use, which no other version may use."""
    own = reserved.get(text_version)
    if own is not None and collection_name != own:
        raise ValueError(f"text {text_version} must target {own}; refusing collection {collection_name or '(empty)'}")
    for version, name in reserved.items():
        if version != text_version and name == collection_name:
            raise ValueError(f"text {text_version} must not target the {version} collection {name}")


def compatibility(collection: DataFrame, dimension: int, expected: int, fingerprint: str | None = None) -> list[str]:
    """Reasons a collection cannot be searched or compared; empty means compatible."""
    aggregates = [
        F.count("*").alias("points"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"),
        F.count_if(F.col("distance") != "cosine").alias("other_distance") if "distance" in collection.columns else F.lit(0).alias("other_distance"),
    ]
    if fingerprint is not None:
        aggregates.append(F.count_if(F.col("index_fingerprint").eqNullSafe(fingerprint)).alias("matching"))
    seen = collection.agg(*aggregates).first()
    problems = []
    if seen["points"] != expected:
        problems.append(f"point count mismatch: expected {expected}, got {seen['points']}")
    if seen["lo"] != dimension or seen["hi"] != dimension:
        problems.append(f"vector size mismatch: expected {dimension}, got {seen['lo']}..{seen['hi']}")
    if seen["other_distance"]:
        problems.append("distance mismatch: expected cosine")
    if fingerprint is not None and seen["matching"] != expected:
        problems.append(f"fingerprint mismatch: {seen['matching']} of {expected} points match")
    return problems

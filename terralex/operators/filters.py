"""Structured filters, thresholds, dataset options and embedding-runtime predicates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex import fixed_values as fv


def compile_filter(conditions: Mapping | None) -> Column:
    """AND of equality and population-range conditions; put it before a scan and Parquet prunes with it."""
    if conditions is None:
        conditions = {}
    if not isinstance(conditions, Mapping):
        raise TypeError("filter must be a mapping")
    parts: list[Column] = []
    for key, value in conditions.items():
        if key in fv.KEYWORD_FILTERS:
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"{key} must be a non-empty string")
            parts.append(F.col(key) == value.strip())
        elif key == fv.RANGE_FILTER:
            parts.extend(_population_range(value))
        else:
            raise ValueError(f"unsupported filter field: {key}")
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _population_range(bounds) -> list[Column]:
    if not isinstance(bounds, Mapping):
        raise ValueError("population must be a range")
    column = F.col(fv.RANGE_FILTER)
    compare = {"gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__}
    parts = []
    for op in fv.RANGE_OPS:
        if bounds.get(op) is None:
            continue
        bound = float(bounds[op])
        if not math.isfinite(bound) or bound < 0:
            raise ValueError(f"population.{op} must be non-negative")
        parts.append(compare[op](F.lit(int(bound) if bound.is_integer() else bound)))
    if not parts:
        raise ValueError("population range is empty")
    return parts


def dataset_options(
    sources: Sequence[str] | str = fv.PUBLIC_SOURCES, types: Sequence[str] | str = fv.BACKBONE_TYPES,
    limit: int | None = None,
) -> dict:
    def listed(value, fallback) -> list[str]:
        items = value.split(",") if isinstance(value, str) else value
        cleaned = list(dict.fromkeys(s for s in (str(i).strip() for i in items) if s))
        return cleaned or list(fallback)

    chosen, wanted = listed(sources, fv.PUBLIC_SOURCES), listed(types, fv.BACKBONE_TYPES)
    for source in chosen:
        if source not in fv.PUBLIC_SOURCES:
            raise ValueError(f"unsupported dataset source: {source}")
    if "wof" in chosen and "geonames" not in chosen:
        raise ValueError("concordance enrichment requires the gazetteer source")
    for kind in wanted:
        if kind not in fv.ENTITY_TYPES:
            raise ValueError(f"unsupported entity type: {kind}")
    if limit is not None and (not isinstance(limit, int) or limit < 1):
        raise ValueError("limit must be a positive integer")
    skipped = [
        {"source": "geonames", "type": t, "reason": "unsupported_type"} for t in wanted if t not in fv.BACKBONE_TYPES
    ]
    return {
        "sources": chosen, "types": wanted, "limit": limit,
        "loaded_types": [t for t in wanted if t in fv.BACKBONE_TYPES], "skipped": skipped,
    }


# ---------------------------------------------------------------- embedding runtime identity

def normalise_runtime(identity: Mapping | None) -> dict | None:
    if not isinstance(identity, Mapping):
        return None

    def text(key: str) -> str:
        value = identity.get(key)
        return "" if value is None else str(value).strip()

    backend, implementation = text("backend"), text("implementation")
    if not backend and not implementation and not isinstance(identity.get("semantic"), bool):
        return None
    runtime = {
        "backend": backend or "unknown", "implementation": implementation or "unknown",
        "semantic": identity.get("semantic") is True,
    }
    optional = [f for f in fv.PAYLOAD_RUNTIME_FIELDS if f not in runtime]
    return runtime | {f: text(f) for f in optional if text(f)}


def require_semantic_runtime(identity: Mapping | None) -> dict:
    runtime = normalise_runtime(identity)
    verified = (
        runtime and runtime["semantic"] and runtime["backend"] != "unknown" and runtime["implementation"] != "unknown"
        and "mock" not in f"{runtime['backend']} {runtime['implementation']}".lower()
    )
    if not verified:
        raise ValueError("a verified semantic embedding backend is required")
    return runtime


def compatible_runtime(identity: Mapping) -> dict:
    """The part of an identity that must agree for vectors to be comparable."""
    runtime = require_semantic_runtime(identity)
    kept = ("backend", "implementation", "semantic", *fv.SEMANTIC_RUNTIME_FIELDS)
    return {f: runtime[f] for f in kept if f in runtime}


def verified_runtime_rows() -> Column:
    """The same rule over provenance columns of a collection."""
    backend, implementation = F.trim("embedding_backend"), F.trim("embedding_implementation")
    known = (backend != "") & (implementation != "") & (backend != "unknown") & (implementation != "unknown")
    mock = F.lower(F.concat_ws(" ", backend, implementation)).contains("mock")
    return F.coalesce(known & (F.col("embedding_semantic") == F.lit(True)) & ~mock, F.lit(False))


def runtime_matches(
    runtime: Mapping, embedding_model: str | None = None, text_version: str | None = None, semantic_only: bool = False
) -> Column:
    """Rows whose provenance equals the expected identity; `semantic_only` ignores host details."""
    expected = require_semantic_runtime(runtime) if semantic_only else normalise_runtime(runtime)
    if not expected or not expected["semantic"]:
        raise ValueError("a verified semantic runtime is required")
    optional = [f for f in fv.PAYLOAD_RUNTIME_FIELDS if f not in ("backend", "implementation", "semantic")]
    compared = list(fv.SEMANTIC_RUNTIME_FIELDS) if semantic_only else ["backend", "implementation", *optional]
    parts = [F.col("embedding_semantic") == F.lit(True)]
    parts += [F.col(f"embedding_{f}") == expected[f] for f in compared if f in expected]
    if embedding_model:
        parts.append(F.col("embedding_model") == embedding_model)
    if text_version:
        parts.append(F.col("embedding_text_version") == text_version)
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))

"""Entities -> stored, verified collection; and the build-translate-load plan around it."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.document_text import selected_document_text
from terralex.functions.ids import point_id
from terralex.operators import audit
from terralex.operators.embed import Embedder, embed_texts
from terralex.operators.filters import compatible_runtime, normalise_runtime, require_semantic_runtime
from terralex.operators.fingerprint import index_fingerprint
from terralex.operators.payload import to_points
from terralex.operators.translate import TranslationIdentity, check_fields, translate_missing, translation_candidates, translation_report
from terralex.session import Scratch, materialise
from terralex.sources.collection_store import CollectionStore

#: Bytes of stored entities that a load moves to their buckets at a time, in few parts: each publishes a version.
PART_BYTES = 32 << 20
MAX_PARTS = 4


def stored_counts(store: CollectionStore, fingerprint: str) -> tuple[int, int]:
    current = store.read()
    if current is None:
        return 0, 0
    row = audit.collection_counts(current, fingerprint).first()
    return row["points"], row["matching"]


def load_collection(
    entities: DataFrame, store: CollectionStore, make_embedder: Callable[[], Embedder], metadata: Mapping,
    text_version: str = fv.DEFAULT_TEXT_VERSION, batch_size: int = 64, require_semantic: bool = False,
    collection_name: str = "", reserved: Mapping[str, str] | None = None,
) -> dict:
    """Fingerprint, decide the mode, embed what is missing, write, verify, report.

    A complete collection of the same fingerprint is left alone; a partial one is completed; anything else
    in it is an error.
    """
    started = time.monotonic()
    audit.check_pairing(text_version, collection_name, reserved or {})
    if require_semantic:
        require_semantic_runtime(metadata.get("embedding_runtime"))
    entities = materialise(entities)  # read for the fingerprint and again for the points
    fingerprint = index_fingerprint(entities, metadata, text_version)
    expected = fingerprint["entity_count"]
    store.size_for(expected)
    points, matching = stored_counts(store, fingerprint["value"])
    mode = audit.load_mode(points, matching, expected)
    report = {
        "read": expected, "mode": mode, "index_fingerprint": fingerprint["value"], "embedding_text_version": text_version,
        "embedding_runtime": normalise_runtime(metadata.get("embedding_runtime")),
        "points_before": points, "matching_before": matching, "upserted": 0, "skipped_existing": points,
        "points_after": points, "matching_after": matching,
    }
    if mode != "idempotent":
        stamp = {**metadata, "index_fingerprint": fingerprint["value"]}
        pending = store.missing(entities.withColumn("point_id", point_id(F.col("id"))))
        size = int(str(entities._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        parts = min(MAX_PARTS, max(1, -(-size // PART_BYTES)))
        for part in range(parts):  # buckets by turns: one part's rows are on their way to them at a time
            some = pending.where(store.bucket(F.col("point_id")) % parts == part) if parts > 1 else pending
            vectors = embed_texts(some.withColumn("document", selected_document_text(text_version)), "document", make_embedder, batch_size).drop("document")
            # Points hold every text twice, in a column of its own and in the document: they are made of the entities where they are written.
            report["upserted"] += store.insert(vectors, unique=True, finish=lambda rows: to_points(rows, stamp, text_version, also=["embedding"]))
        report["points_after"], report["matching_after"] = stored_counts(store, fingerprint["value"])
        audit.verify_load(report["points_after"], report["matching_after"], expected)
    elapsed = time.monotonic() - started
    return report | {
        "elapsed_ms": round(elapsed * 1000, 3),
        "docs_per_second": round(report["upserted"] / elapsed, 3) if elapsed > 0 else 0,
    }


def semantic_audit(collection: DataFrame, expected: int, identity: Mapping, embedding_model: str | None = None, text_version: str | None = None) -> dict:
    """All points come from an embedding identity compatible with the given one."""
    return audit.audit_provenance(
        collection, expected, compatible_runtime(identity), embedding_model=embedding_model, text_version=text_version, semantic_only=True
    )


def build_translate_load(
    build: Callable[[], tuple[DataFrame, dict]], load: Callable[[DataFrame], dict],
    make_translator: Callable | None = None, cache: DataFrame | None = None, identity: TranslationIdentity | None = None,
    fields: Sequence[str] = ("description",), dry_run: bool = False, save_cache: Callable[[DataFrame], None] | None = None,
) -> dict:
    """Plan first; a dry run stops there with counts only."""
    fields = check_fields(fields)
    entities, manifest = build()
    provider = identity.provider if identity and make_translator else "none"
    candidates = 0 if provider == "none" else translation_candidates(entities, fields).count()
    outcome = {
        "dryRun": dry_run, "build": manifest, "translation": None, "seed": None, "entities": entities,
        "plan": {"entities": entities.count(), "translationProvider": provider, "translationFields": fields, "translationCandidates": candidates},
    }
    if dry_run:
        return outcome
    translation = {"provider": provider, "candidates": candidates, "translatedCandidates": 0}
    if provider != "none":
        with Scratch(entities.sparkSession) as keep:  # texts on their way, and new records once `save_cache` has them
            translated, fresh = translate_missing(entities, cache, make_translator, identity, fields, keep)
            if save_cache:
                save_cache(fresh)
            translated = materialise(translated)  # counted, loaded and handed on
        counts = translation_report(entities, translated, fields).first()
        translation |= {"translatedCandidates": counts["translated"], "remainingCandidates": counts["remaining"]}
        entities = translated
    return outcome | {"entities": entities, "translation": translation, "seed": load(entities)}


def missing_points(points: DataFrame, existing: DataFrame) -> DataFrame:
    """Resume: only points whose id is not stored."""
    return points.join(existing.select("point_id"), "point_id", "left_anti")


def upserted(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after an upsert keyed by point id."""
    kept = existing.join(incoming.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def resolve_vectors(collection: DataFrame) -> DataFrame:
    return collection.select(F.col("entity_id").alias("id"), "embedding")

"""Entity -> stored point columns, and stored point -> result or entity view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.document_text import selected_document_text
from terralex.functions.ids import canonical_entity_id, point_id
from terralex.operators.filters import normalise_runtime
from terralex.operators.validate import bilingual_state
from terralex.session import require, small_side


def to_points(entities: DataFrame, metadata: Mapping, text_version: str = fv.DEFAULT_TEXT_VERSION, also: Sequence[str] = ()) -> DataFrame:
    """point_id, document text and the payload columns, and what entities carry `also`; unset runtime details are null."""
    runtime = normalise_runtime(metadata.get("embedding_runtime")) or {}
    stamped = [F.lit(runtime.get(f)).cast("boolean" if f == "semantic" else "string").alias(f"embedding_{f}") for f in fv.PAYLOAD_RUNTIME_FIELDS]
    return entities.select(
        point_id(F.col("id")).alias("point_id"), selected_document_text(text_version).alias("document"),
        F.col("id").alias("entity_id"), "type", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"),
        F.col("description.en").alias("description_en"), F.col("description.vi").alias("description_vi"),
        "continent", "region", "country_code", "population", "facts", "source", "source_id", "source_refs",
        bilingual_state().alias("bilingual_state"), "language_provenance", "translation_metadata",
        F.lit(metadata.get("embedding_model")).cast("string").alias("embedding_model"),
        F.lit(metadata.get("embedding_version")).cast("string").alias("embedding_version"),
        *stamped, F.lit(text_version).alias("embedding_text_version"),
        F.lit(metadata.get("dataset_version")).cast("string").alias("dataset_version"),
        F.lit(metadata.get("index_fingerprint")).cast("string").alias("index_fingerprint"), *also,
    )


RESULT_FIELDS = (
    "type", "name_en", "name_vi", "description_en", "description_vi", "continent", "region", "population", "facts",
    "bilingual_state",
)


def attach_payload(results: DataFrame, collection: DataFrame) -> DataFrame:
    """Payload of the winners only: the vectors were scanned without it, these few rows come back for it.

    `results` should be a stored table. There are at most k winners per query: when their ids are few, the
    collection is filtered by a broadcast of them in its scan, and only matching rows meet the results.
    """
    fields = [f for f in RESULT_FIELDS if f in collection.columns]
    key = "entity_id" if "entity_id" in collection.columns else "id"
    winners = small_side(results.select("id").distinct())
    payload = collection.select(F.col(key).alias("id"), *fields).join(winners, "id", "left_semi")
    return results.join(payload, "id", "left")


def entity_view(points: DataFrame) -> DataFrame:
    return points.select(
        F.col("entity_id").alias("id"), "point_id", "type", F.struct(F.col("name_en").alias("en"), F.col("name_vi").alias("vi")).alias("name"),
        F.struct(F.col("description_en").alias("en"), F.col("description_vi").alias("vi")).alias("description"),
        "continent", "region", "country_code", "population", "facts", "source", "source_id", "bilingual_state",
        "language_provenance", "source_refs",
    )


def lookup(collection: DataFrame, ids: DataFrame) -> DataFrame:
    """Entity views of a batch of ids; malformed ids fail the job, unknown ones are absent."""
    canonical = canonical_entity_id(F.col("id"))
    wanted = ids.where(require(canonical.isNotNull(), "entity id must be a Q-id or a safe namespaced id"))
    keys = small_side(wanted.select(point_id(F.col("id")).alias("point_id")).distinct())
    return entity_view(collection.join(keys, "point_id", "left_semi"))

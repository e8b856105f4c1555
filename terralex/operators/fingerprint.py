"""Order-independent fingerprint of an indexed dataset."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.document_text import selected_document_text
from terralex.functions.ids import canonical_json
from terralex.operators.filters import normalise_runtime

_WORDS = 8


def row_digest(entities: DataFrame, text_version: str) -> Column:
    text = selected_document_text(text_version)
    return F.sha2(F.concat_ws("\n", canonical_json(entities.schema), F.lit(text_version), text), 256)


def _word(digest: Column, index: int) -> Column:
    return F.conv(F.substring(digest, 8 * index + 1, 8), 16, 10).cast("decimal(20,0)")


def digest_sums(rows: DataFrame, digest: Column, *keys: str) -> DataFrame:
    """Row count and the sums of the eight 32-bit words of every row digest, for each value of the keys if there are any.

    Sums commute, so each task reduces its rows to nine numbers: nothing is sorted or shuffled per row.
    """
    named = rows.select(*keys, digest.alias("_d"))
    sums = [F.coalesce(F.sum(_word(F.col("_d"), i)), F.lit(0)).cast("decimal(38,0)").alias(f"w{i}") for i in range(_WORDS)]
    return named.groupBy(*keys).agg(F.count("*").alias("entities"), *sums)


def index_identity(metadata: Mapping) -> dict:
    cleaned = {k: str(metadata.get(k) or "").strip() for k in ("embedding_model", "embedding_version", "dataset_version")}
    for key, value in cleaned.items():
        if not value:
            raise ValueError(f"metadata.{key} is required")
    runtime = normalise_runtime(metadata.get("embedding_runtime"))
    return cleaned | ({"embedding_runtime": runtime} if runtime else {})


def index_fingerprint(entities: DataFrame, metadata: Mapping, text_version: str = fv.DEFAULT_TEXT_VERSION) -> dict:
    """{value, embedding_text_version, entity_count} - sensitive to content, text version and identity."""
    identity = index_identity(metadata)
    totals = digest_sums(entities, row_digest(entities, text_version)).first()
    return fingerprint_of(totals, identity, text_version)


def fingerprint_of(totals: Row, identity: Mapping, text_version: str) -> dict:
    """The fingerprint from the dataset's sums, however they were added up."""
    if totals["entities"] == 0:
        raise ValueError("entities must be non-empty")
    payload = {"identity": identity, "text_version": text_version, "sums": [str(v) for v in totals]}
    value = hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()
    return {"value": f"sha256:{value}", "embedding_text_version": text_version, "entity_count": totals["entities"]}

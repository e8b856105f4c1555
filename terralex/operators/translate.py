"""Filling missing Vietnamese texts: candidates, cache lookup, translator contract, provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex import schema
from terralex.functions.ids import text_sha256, translation_key
from terralex.functions.text import trim_to_null, trimmed
from terralex.session import materialise

FIELDS = ("description", "name")


class Translator(Protocol):
    def translate(self, texts: Sequence[str]) -> Sequence[str]: ...


@dataclass(frozen=True)
class TranslationIdentity:
    provider: str
    model: str
    prompt_version: str
    translation_version: str = "v1"
    source: str = "en"
    target: str = "vi"


def check_fields(fields: Sequence[str]) -> list[str]:
    cleaned = list(dict.fromkeys(f.strip() for f in fields if f.strip()))
    if not cleaned:
        raise ValueError("translation fields must be a non-empty list")
    for field in cleaned:
        if field not in FIELDS:
            raise ValueError(f"unsupported translation field: {field}")
    return cleaned


def translation_candidates(entities: DataFrame, fields: Sequence[str] = ("description",)) -> DataFrame:
    """(id, field, text): English present, Vietnamese absent."""
    pairs = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f"{f}.en").alias("en"), F.col(f"{f}.vi").alias("vi"))
        for f in check_fields(fields)
    ])
    rows = entities.select("id", F.explode(pairs).alias("p"))
    return rows.where(trim_to_null(F.col("p.en")).isNotNull() & trim_to_null(F.col("p.vi")).isNull()).select(
        "id", F.col("p.field").alias("field"), F.col("p.en").alias("text")
    )


def keyed_texts(candidates: DataFrame, identity: TranslationIdentity) -> DataFrame:
    return candidates.withColumn("key", translation_key(
        F.col("text"), identity.provider, identity.model, identity.prompt_version, identity.source, identity.target
    ))


def latest_records(records: DataFrame, order: str) -> DataFrame:
    """Last record per key wins; records lacking a key, text or metadata are skipped."""
    valid = records.where(F.col("key").isNotNull() & F.col("text").isNotNull() & F.col("metadata").isNotNull())
    latest = F.max_by(F.struct("text", "metadata"), order)
    return valid.groupBy("key").agg(latest.alias("_r")).select("key", "_r.text", "_r.metadata")


def cache_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text): each distinct uncached key once, however many fields carry the text."""
    distinct = keyed.groupBy("key").agg(F.min("text").alias("text"))
    return distinct.join(cache.select("key"), "key", "left_anti")


def translate_texts(misses: DataFrame, make_translator: Callable[[], Translator], identity: TranslationIdentity) -> DataFrame:
    """Cache records for the misses; an empty or missing translation fails the job."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        translator = None
        for frame in frames:
            if len(frame) == 0:
                continue
            translator = translator or make_translator()
            out = list(translator.translate(frame["text"].str.strip().tolist()))
            if len(out) != len(frame) or any(not isinstance(t, str) or not t.strip() for t in out):
                raise ValueError("translator returned empty text or a wrong count")
            yield pd.DataFrame({"key": frame["key"], "source_text": frame["text"], "text": [t.strip() for t in out]})

    done = misses.select("key", "text").mapInPandas(run, "key string, source_text string, text string")
    metadata = F.struct(
        F.lit(identity.provider).alias("provider"), F.lit(identity.model).alias("model"),
        F.lit(identity.prompt_version).alias("prompt_version"), F.lit(identity.source).alias("source_language"),
        F.lit(identity.target).alias("target_language"), text_sha256(F.col("source_text")).alias("source_sha256"),
        F.lit(identity.translation_version).alias("translation_version"),
    )
    return done.select("key", "text", metadata.alias("metadata"))


def apply_translations(entities: DataFrame, translated: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Write texts, provenance and metadata for (id, field, text, metadata) rows; native text always wins."""
    fields = check_fields(fields)
    wide = translated.groupBy("id").agg(*[
        F.max(F.when(F.col("field") == f, F.struct("text", "metadata"))).alias(f"_t_{f}") for f in fields
    ])
    joined = entities.join(wide, "id", "left")
    updates, provenance = {}, F.col("language_provenance")
    added = F.array().cast(f"array<struct<key:string,value:{schema.TRANSLATION.simpleString()}>>")
    for field in fields:
        found = F.col(f"_t_{field}")
        use = found.isNotNull() & trim_to_null(F.col(f"{field}.vi")).isNull()
        text = F.when(use, trimmed(found["text"])).otherwise(F.col(f"{field}.vi"))
        updates[field] = F.col(field).withField("vi", text)
        stamp = F.when(use, "machine_translation").otherwise(provenance[f"{field}_vi"])
        provenance = provenance.withField(f"{field}_vi", stamp)
        entry = F.array(F.struct(F.lit(f"{field}_vi").alias("key"), found["metadata"].alias("value")))
        added = F.concat(added, F.when(use, entry).otherwise(F.slice(entry, 1, 0)))
    keep = F.map_filter("translation_metadata", lambda k, _: ~F.array_contains(F.transform(added, lambda e: e["key"]), k))
    updates["translation_metadata"] = F.map_concat(keep, F.map_from_entries(added))
    updates["language_provenance"] = provenance
    return joined.withColumns(updates).select(*entities.columns)


def translate_missing(
    entities: DataFrame, cache: DataFrame, make_translator: Callable[[], Translator], identity: TranslationIdentity,
    fields: Sequence[str] = ("description",), keep: Callable[[DataFrame], DataFrame] = materialise,
) -> tuple[DataFrame, DataFrame]:
    """(translated entities, new cache records). `keep` stores the steps; both results read what it stored."""
    keyed = keyed_texts(translation_candidates(entities, fields), identity)
    # Stored before use: every consumer reads the same texts, and the model sees each miss once.
    fresh = keep(translate_texts(cache_misses(keyed, cache), make_translator, identity))
    known = cache.select("key", "text", "metadata").unionByName(fresh)
    # Stored too: the shuffles that bring texts to their keys are gone before those that bring them to the entities.
    translated = keep(keyed.select("id", "field", "key").join(known, "key"))
    return apply_translations(entities, translated, fields), fresh


def translation_report(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """candidates, translated, remaining as one row."""
    start = translation_candidates(before, fields).select(F.lit(1).alias("candidates"), F.lit(0).alias("remaining"))
    rest = translation_candidates(after, fields).select(F.lit(0).alias("candidates"), F.lit(1).alias("remaining"))
    totals = start.unionByName(rest).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("candidates", "remaining")])
    gained = F.greatest(F.lit(0), F.col("candidates") - F.col("remaining"))
    return totals.select("candidates", gained.alias("translated"), "remaining")

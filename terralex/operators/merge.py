"""Merging records of one entity from several sources by priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex import fixed_values as fv
from terralex import schema
from terralex.session import require


def source_rank(priority: Sequence[str]) -> Column:
    """Listed sources in order, unknown ones last; ties by source and source id."""
    position = F.array_position(F.array(*[F.lit(s) for s in priority]), F.col("source"))
    return F.struct(
        F.when(position > 0, position).otherwise(F.lit(1_000_000)).alias("position"), "source", "source_id"
    )


def _first(value: Column, usable: Column | None = None) -> Column:
    """First usable value in source order, as a mergeable aggregate rather than a collected group."""
    usable = value.isNotNull() if usable is None else usable
    return F.min_by(F.when(usable, value), F.when(usable, F.col("_rank")))


def _listed_values(rows: DataFrame) -> DataFrame:
    """Per id, the ordered unions of all list and map fields, in one pass.

    Every element becomes a row keyed by (id, field, element), so duplicates combine map-side and a hot
    id is spread over its elements before anything is gathered.
    """
    def elements(field: str, items: Column, first, second=None, value=None) -> Column:
        none = F.lit(None).cast("string")
        return F.transform(F.coalesce(items, F.array().cast(_kind(rows, items))), lambda x, i: F.struct(
            F.lit(field).alias("field"), i.alias("pos"), first(x).alias("k1"),
            (second(x) if second else none).alias("k2"), (value(x) if value else none).alias("value"),
        ))

    refs = F.coalesce("source_refs", F.array(F.struct("source", "source_id")))
    flat = F.concat(
        elements("en", F.col("aliases.en"), lambda x: x),
        elements("vi", F.col("aliases.vi"), lambda x: x),
        elements("languages", F.col("facts.languages"), lambda x: x),
        elements("refs", refs, lambda x: x["source"], lambda x: x["source_id"]),
        elements("extra", F.map_entries("facts.extra"), lambda x: x["key"], value=lambda x: x["value"]),
        elements("meta", F.map_entries("translation_metadata"), lambda x: x["key"], value=lambda x: F.to_json(x["value"])),
    )
    exploded = rows.select("id", "_rank", F.explode(flat).alias("e")).select("id", "_rank", "e.*")
    firsts = exploded.groupBy("id", "field", "k1", "k2").agg(
        F.min(F.struct("_rank", "pos")).alias("at"), F.min_by("value", "_rank").alias("value")
    )

    def gathered(field: str) -> Column:
        item = F.when(F.col("field") == field, F.struct("at", "k1", "k2", "value"))
        return F.array_sort(F.collect_list(item))

    def words(field: str) -> Column:
        return F.transform(gathered(field), lambda x: x["k1"])

    def mapping(field: str, decode) -> Column:
        return F.map_from_entries(F.transform(gathered(field), lambda x: F.struct(x["k1"], decode(x["value"]))))

    return firsts.groupBy("id").agg(
        words("en").alias("_a_en"), words("vi").alias("_a_vi"), words("languages").alias("_languages"),
        F.transform(gathered("refs"), lambda x: F.struct(x["k1"].alias("source"), x["k2"].alias("source_id"))).alias("_refs"),
        mapping("extra", lambda v: v).alias("_extra"),
        mapping("meta", lambda v: F.from_json(v, schema.TRANSLATION)).alias("_meta"),
    )


def _kind(rows: DataFrame, items: Column):
    return rows.select(items).schema.fields[0].dataType


def merge_entities(datasets: Sequence[DataFrame], priority: Sequence[str] = fv.SOURCE_PRIORITY) -> DataFrame:
    """One entity per id. Scalars take the first value by source priority; lists are ordered unions.

    Rows must be normalised. A type conflict between sources fails the job.
    """
    if not datasets:
        raise ValueError("datasets must be a non-empty list")
    rows = datasets[0]
    for other in datasets[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    rows = rows.withColumn("_rank", source_rank(priority))
    provenance = F.col("language_provenance")

    def localized(field: str, language: str) -> tuple[Column, Column]:
        value = F.col(f"{field}.{language}")
        usable = F.coalesce(value != "", F.lit(False))
        stamp = F.coalesce(provenance[f"{field}_{language}"], F.col("source"))
        return _first(value, usable), F.coalesce(_first(stamp, usable), F.lit("missing"))

    parts = {f"{f}_{lang}": localized(f, lang) for f in ("name", "description") for lang in fv.NAME_LANGUAGES}
    scalar_facts = [f for f in schema.FACTS.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    aggregates = [
        F.min("type").alias("type"), F.max("type").alias("_other_type"),
        *[value.alias(f"_{key}") for key, (value, _) in parts.items()],
        *[stamp.alias(f"_p_{key}") for key, (_, stamp) in parts.items()],
        *[_first(F.col(c), F.coalesce(F.col(c) != "", F.lit(False))).alias(c) for c in ("continent", "region", "country_code")],
        _first(F.col("population")).alias("population"),
        *[_first(F.col(f"facts.{f.name}")).alias(f"_f_{f.name}") for f in scalar_facts],
        F.min("_rank").alias("_top"),
    ]
    flat = rows.groupBy("id").agg(*aggregates)
    flat = flat.where(require(
        F.col("type") == F.col("_other_type"),
        F.concat(F.lit("entity "), F.col("id"), F.lit(" has a type conflict across sources")),
    ))
    flat = flat.join(_listed_values(rows), "id", "left")
    empty = F.array().cast("array<string>")
    facts = F.struct(*[
        (F.col("_languages") if f.name == "languages" else F.col("_extra") if f.name == "extra" else F.col(f"_f_{f.name}")).alias(f.name)
        for f in schema.FACTS.fields
    ])
    return flat.select(
        "id", "type",
        *[F.struct(F.col(f"_{f}_en").alias("en"), F.col(f"_{f}_vi").alias("vi")).alias(f) for f in ("name", "description")],
        F.struct(F.coalesce("_a_en", empty).alias("en"), F.coalesce("_a_vi", empty).alias("vi")).alias("aliases"),
        "continent", "region", "country_code", "population", facts.alias("facts"),
        F.col("_top.source").alias("source"), F.col("_top.source_id").alias("source_id"),
        F.col("_refs").alias("source_refs"),
        F.struct(*[F.col(f"_p_{key}").alias(key) for key in parts]).alias("language_provenance"),
        F.col("_meta").alias("translation_metadata"),
    )

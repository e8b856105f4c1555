"""Entity files, benchmark cases, reports and manifests."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex import schema
from terralex.operators.validate import normalise_entities
from terralex.session import assert_unique, fail_on_errors


def _facts_from_json(raw) -> F.Column:
    """Known keys become typed columns; a capital is a flag on cities and a name elsewhere."""
    columns = []
    for field in schema.FACTS.fields:
        name = field.name
        if name == "capital":
            value = F.when(~((F.col("type") == "city") & raw["capital"].isin("true", "false")), raw["capital"])
        elif name == "is_capital":
            value = F.when(F.col("type") == "city", raw["capital"].try_cast("boolean"))
        elif name == "languages":
            value = F.from_json(raw["languages"], "array<string>")
        elif name == "extra":
            known = [*schema.FACT_JSON_KEYS, "capital", "languages"]
            value = F.map_filter(raw, lambda k, _: ~k.isin(*known))
        else:
            key = next(k for k, v in schema.FACT_JSON_KEYS.items() if v == name)
            value = raw[key].try_cast(field.dataType)
        columns.append(value.cast(field.dataType).alias(name))
    return F.struct(*columns)


def parse_entity_json(raw: DataFrame) -> DataFrame:
    """Rows in the file schema -> normalised entities with `_errors`."""
    refs = F.transform("sourceRefs", lambda r: F.struct(r["source"].alias("source"), r["sourceId"].alias("source_id")))
    shaped = raw.select(
        "id", "type", "name", "description", "aliases", "continent", "region",
        F.col("countryCode").alias("country_code"), "population", _facts_from_json(F.col("facts")).alias("facts"),
        "source", F.col("sourceId").alias("source_id"), refs.alias("source_refs"),
        F.col("languageProvenance").alias("language_provenance"),
        F.col("translationMetadata").alias("translation_metadata"),
    )
    return normalise_entities(shaped)


def _read_json(spark: SparkSession, path: str, kind, array: bool) -> DataFrame:
    """One record per line, which splits; with `array`, files that each hold one JSON array, read whole by one
    task each. A line that is not a record fails, so an array file is never taken for lines in silence."""
    return spark.read.schema(kind).option("multiLine", array).option("mode", "FAILFAST").json(path)


def read_entities(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """JSON lines, or JSON array files with `array`; any invalid row or duplicate id fails."""
    return assert_unique(fail_on_errors(parse_entity_json(_read_json(spark, path, schema.ENTITY_JSON, array))), "id", "entity id")


def read_cases(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return _read_json(spark, path, schema.CASE, array)


def read_report_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_json_document(spark: SparkSession, document: dict, path: str) -> None:
    """One small JSON object (a manifest or summary) written through Spark's file committer."""
    def plain(value):
        return value.isoformat() if isinstance(value, (date, datetime)) else str(value)

    text = json.dumps(document, ensure_ascii=False, default=plain)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def write_dataset(entities: DataFrame, manifest: dict, path: str) -> None:
    """Entities, the manifest, and beside it the tables it carries (countries, ambiguity candidates), one Parquet
    folder each; in the document stands the name of the folder."""
    entities.write.mode("overwrite").parquet(f"{path}/entities")

    def stored(value, name: str):
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(f"{path}/{name}")
            return {"table": name}
        return {k: stored(v, k) for k, v in value.items()} if isinstance(value, dict) else value

    write_json_document(entities.sparkSession, stored(manifest, "manifest"), f"{path}/manifest")


def write_report(tables: dict[str, DataFrame], summary: dict, path: str) -> None:
    """Each metric table as Parquet beside one summary document."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    write_json_document(spark, summary, f"{path}/summary")

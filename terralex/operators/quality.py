"""Coverage, coverage gate and data quality of an entity table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.text import has_legacy_letters


def coverage_counts() -> dict[str, Column]:
    """Totals and language counters as aggregates by name."""
    provenance = F.col("language_provenance")
    en, vi = F.col("name.en").isNotNull(), F.col("name.vi").isNotNull()
    en_fallback = F.coalesce(provenance["name_en"] == "geonames_fallback", F.lit(False))
    vi_fallback = F.coalesce(provenance["name_vi"] == "geonames_fallback", F.lit(False))
    vi_texts = F.concat(F.array("name.vi"), F.col("aliases.vi"))
    return {
        "total": F.count("*"), "city_count": F.count_if(F.col("type") == "city"),
        "name_en": F.count_if(en & ~en_fallback), "name_en_present": F.count_if(en),
        "name_en_fallback": F.count_if(en & en_fallback), "name_vi": F.count_if(vi & ~vi_fallback),
        "description_en": F.count_if(F.col("description.en").isNotNull()),
        "description_vi": F.count_if(F.col("description.vi").isNotNull()),
        "vi_legacy_texts": F.coalesce(F.sum(F.size(F.filter(vi_texts, has_legacy_letters))), F.lit(0)).cast("bigint"),
    }


def coverage(entities: DataFrame) -> DataFrame:
    """Totals and language counters as one row."""
    return entities.agg(*[count.alias(name) for name, count in coverage_counts().items()])


def continent_counts(continents: tuple[str, ...] = fv.CONTINENTS) -> dict[str, Column]:
    """Entities of every known continent as aggregates by its name."""
    return {c: F.count_if(F.col("continent") == c) for c in continents}


def continent_coverage(entities: DataFrame, continents: tuple[str, ...] = fv.CONTINENTS) -> DataFrame:
    """(continent, entities) for every known continent, zeros included."""
    spark = entities.sparkSession
    known = spark.createDataFrame([(c,) for c in continents], "continent string")
    counts = entities.groupBy("continent").agg(F.count("*").alias("entities"))
    return known.join(counts, "continent", "left").select("continent", F.coalesce("entities", F.lit(0)).alias("entities"))


def country_coverage(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("country_code").isNotNull()).groupBy("country_code").agg(F.count("*").alias("entities"))


def coverage_failures(cities: int, counts: Mapping[str, int]) -> list[str]:
    """A large city dataset must have entities in every required continent (counts per continent)."""
    if cities < fv.COVERAGE_MIN_CITIES:
        return []
    return [
        f"dataset coverage check failed: {c} has no cities in a {cities}-city dataset"
        for c in fv.COVERAGE_REQUIRED_CONTINENTS if not counts.get(c)
    ]


def quality_issues(entities: DataFrame) -> DataFrame:
    """(code, entity_id, field, value, occurrences): duplicate ids, shared references, legacy letters.

    Shared references and duplicate ids are found from map-side-combined counts; owners of a hot
    reference are reported by their smallest and largest id, never gathered.
    """
    none = F.lit(None).cast("string")
    duplicates = entities.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.lit("duplicate_entity_id").alias("code"), F.col("id").alias("entity_id"), none.alias("field"),
        none.alias("value"), (F.col("n") - 1).alias("occurrences"),
    )
    refs = entities.select("id", F.explode("source_refs").alias("r")).groupBy("r.source", "r.source_id").agg(
        F.min("id").alias("first_owner"), F.max("id").alias("last_owner")
    )
    shared = refs.where("first_owner <> last_owner").select(
        F.lit("duplicate_source_ref").alias("code"), F.col("first_owner").alias("entity_id"),
        F.concat_ws("\u0000", "source", "source_id").alias("field"), F.col("last_owner").alias("value"),
        F.lit(1).cast("bigint").alias("occurrences"),
    )
    texts = F.concat(
        F.array(F.struct(F.lit("name.vi").alias("field"), F.col("name.vi").alias("value"))),
        F.transform("aliases.vi", lambda x, i: F.struct(
            F.concat(F.lit("aliases.vi["), i.cast("string"), F.lit("]")).alias("field"), x.alias("value"))),
    )
    legacy = entities.select("id", F.explode(F.filter(texts, lambda t: has_legacy_letters(t["value"]))).alias("t")).select(
        F.lit("vi_legacy_text").alias("code"), F.col("id").alias("entity_id"), "t.field", "t.value",
        F.lit(1).cast("bigint").alias("occurrences"),
    )
    return duplicates.unionByName(shared).unionByName(legacy)


def quality_counts() -> dict[str, Column]:
    """Occurrences per kind of issue as aggregates by name."""
    def total(code: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("code") == code, F.col("occurrences"))), F.lit(0)).cast("bigint")

    return {
        "duplicate_entity_ids": total("duplicate_entity_id"), "duplicate_source_refs": total("duplicate_source_ref"),
        "vi_legacy_texts": total("vi_legacy_text"),
    }


def quality_checks(issues: DataFrame) -> DataFrame:
    return issues.agg(*[count.alias(name) for name, count in quality_counts().items()])

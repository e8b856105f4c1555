"""Gazetteer rows -> entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex import schema
from terralex.operators.validate import normalise_entities


def continent_name(code: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in fv.CONTINENT_BY_CODE.items() for x in pair])[code]


def _facts(**values: Column) -> Column:
    return F.struct(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FACTS.fields
    ])


def _bilingual(en: Column) -> Column:
    return F.struct(en.alias("en"), F.lit(None).cast("string").alias("vi"))


def with_reference_data(cities: DataFrame, countries: DataFrame, admin1: DataFrame) -> DataFrame:
    """Left joins onto the two reference tables; Spark broadcasts them when they are measurably small."""
    country = countries.select(
        F.col("iso2").alias("country_code"), F.col("country_name").alias("_country"),
        F.col("continent_code").alias("_continent"),
    )
    division = admin1.select(F.col("code").alias("_code"), F.col("name").alias("_region"))
    keyed = cities.withColumn("_code", F.concat("country_code", F.lit("."), "admin1_code"))
    return keyed.join(country, "country_code", "left").join(division, "_code", "left").drop("_code")


def city_entities(cities: DataFrame, countries: DataFrame, admin1: DataFrame) -> DataFrame:
    rows = with_reference_data(cities, countries, admin1)
    kept = ("timezone", "feature_code", "admin1_code", "admin2_code", "admin3_code", "admin4_code",
            "latitude", "longitude", "elevation", "dem", "modification_date")
    facts = _facts(
        country=F.col("_country"), local_name=F.col("name"),
        ascii_name=F.when(F.col("ascii_name") != F.col("name"), F.col("ascii_name")),
        is_capital=F.coalesce(F.col("feature_code") == fv.CAPITAL_FEATURE_CODE, F.lit(False)),
        **{c: F.col(c) for c in kept},
    )
    absent = F.lit(None).cast("string")
    provenance = F.struct(
        F.lit("geonames_fallback").alias("name_en"), absent.alias("name_vi"),
        absent.alias("description_en"), absent.alias("description_vi"),
    )
    return normalise_entities(rows.select(
        F.concat(F.lit("geonames:city:"), F.col("geoname_id").cast("string")).alias("id"), F.lit("city").alias("type"),
        _bilingual(F.col("name")).alias("name"), continent_name(F.col("_continent")).alias("continent"),
        F.col("_region").alias("region"), "country_code", "population", facts.alias("facts"),
        F.lit("geonames").alias("source"), F.col("geoname_id").cast("string").alias("source_id"),
        provenance.alias("language_provenance"),
    ))


def country_entities(countries: DataFrame) -> DataFrame:
    facts = _facts(
        capital=F.col("capital"), currency=F.col("currency_name"), languages=F.col("languages"), iso3=F.col("iso3")
    )
    return normalise_entities(countries.select(
        F.concat(F.lit("geonames:country:"), F.col("geoname_id").cast("string")).alias("id"),
        F.lit("country").alias("type"), _bilingual(F.col("country_name")).alias("name"),
        continent_name(F.col("continent_code")).alias("continent"), F.col("iso2").alias("country_code"),
        "population", facts.alias("facts"), F.lit("geonames").alias("source"),
        F.col("geoname_id").cast("string").alias("source_id"),
    ))


def gazetteer_id() -> Column:
    """The numeric gazetteer id: the first gazetteer reference, else the source id."""
    refs = F.filter("source_refs", lambda r: r["source"] == "geonames")
    value = F.coalesce(F.get(refs, F.lit(0))["source_id"], F.when(F.col("source") == "geonames", F.col("source_id")))
    return F.when(value.rlike(r"^[0-9]+\z"), value.try_cast("bigint"))


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row per key in load order, as a map-side-combined aggregate."""
    rest = [c for c in df.columns if c not in (key, order)]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return df.groupBy(key).agg(first).select(key, "_first.*").select(*[c for c in df.columns if c != order])


def representative_order() -> list[Column]:
    """Capital cities, then population (unknown last), then gazetteer id, then id."""
    capital = (F.col("type") == "city") & F.coalesce(F.col("facts.is_capital"), F.lit(False))
    return [
        F.desc(capital), F.desc(F.coalesce("population", F.lit(-1))),
        F.asc_nulls_last(gazetteer_id()), F.asc("id"),
    ]


def select_representative(entities: DataFrame, limit: int | None) -> DataFrame:
    if limit is None:
        return entities
    if limit < 1:
        raise ValueError("limit must be a positive integer")
    from terralex.operators.ordering import top_n

    return top_n(entities, representative_order(), limit)

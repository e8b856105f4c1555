"""Concordance features (GeoJSON, one per line): names and gazetteer ids; geometry is never parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.localized_names import localized_names, positive_ids
from terralex.session import small_side


def mentioned_ids(text: Column) -> Column:
    """Ids a cheap pattern finds in the raw text, before any JSON parsing."""
    groups = F.regexp_extract_all(text, F.lit(fv.CONCORDANCE_ID_PATTERN), 1)
    return F.array_distinct(F.regexp_extract_all(F.array_join(groups, ","), F.lit("[0-9]+"), 0))


def feature_properties(lines: DataFrame) -> DataFrame:
    """The raw `properties` text of each feature line with the ids it mentions. Rows that carry properties already,
    such as those of an archive, are passed on."""
    if "properties" in lines.columns:
        return lines.select("properties").withColumn("_ids", mentioned_ids("properties"))
    text = F.get_json_object("value", "$.properties")
    return lines.select(text.alias("properties")).withColumn("_ids", mentioned_ids("properties"))


def worth_parsing(features: DataFrame, target_ids: DataFrame) -> DataFrame:
    """Features that may concern a target: the rest is skipped without parsing its JSON.

    A feature is kept when it mentions a target id, or carries the key with a value the pattern cannot
    read, or has no properties (so that it is reported as invalid). Lines naming several ids, which are
    rare, are matched as one row each: equal lines stay separate rows.
    """
    targets = small_side(target_ids.select(F.col("geoname_id").cast("string").alias("_id")).distinct())
    one = features.where(F.size("_ids") == 1).withColumn("_id", F.get("_ids", F.lit(0)))
    single = one.join(targets, "_id", "left_semi").select("properties")
    # Ids meet the targets as (id list, id) pairs; the lines are then kept by their whole id list.
    several = features.where(F.size("_ids") > 1).withColumn("_ids", F.array_join("_ids", ","))
    lists = several.select("_ids").distinct().withColumn("_id", F.explode(F.split("_ids", ",")))
    wanted = lists.join(targets, "_id", "left_semi").select("_ids").distinct()
    multiple = several.join(wanted, "_ids", "left_semi").select("properties")
    named_key = F.col("properties").contains('"gn:id"') | F.col("properties").contains('"gn:geonameid"')
    unreadable = features.where(F.col("properties").isNull() | ((F.size("_ids") == 0) & named_key))
    return single.unionByName(multiple).unionByName(unreadable.select("properties"))


def parse_features(features: DataFrame, entity_type: str) -> DataFrame:
    """Typed candidates plus `_admissible` and `_errors`, from `properties` texts.

    Placetype and currency are judged first, so a feature that is out of scope is dropped rather than
    reported; an in-scope feature without a positive id is an error; anything but one distinct
    concordance id makes it inadmissible.
    """
    rows = features.select(F.try_parse_json("properties").alias("_p")).withColumn("_map", F.expr("try_cast(_p AS MAP<STRING, VARIANT>)"))
    raw_id = F.trim(F.try_variant_get("_p", "$['wof:id']", "string"))
    current = F.try_variant_get("_p", "$['mz:is_current']", "variant")
    kind = F.schema_of_variant(current)
    not_current = (kind == "BOOLEAN") & (F.try_variant_get(current, "$", "boolean") == F.lit(False)) | (
        kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
    ) & (F.try_variant_get(current, "$", "double") == 0)
    placetype = F.trim(F.try_variant_get("_p", "$['wof:placetype']", "string"))
    ids = positive_ids(F.try_variant_get("_p", "$['wof:concordances']['gn:id']", "variant"))
    in_scope = placetype.isin(*fv.CONCORDANCE_PLACETYPES[entity_type]) & ~F.coalesce(not_current, F.lit(False))
    id_ok = F.coalesce(raw_id.rlike(r"^[0-9]+\z") & (raw_id != "0"), F.lit(False))
    shaped = rows.select(
        F.col("_p").isNull().alias("_broken"), F.coalesce(in_scope, F.lit(False)).alias("_in_scope"),
        F.when(id_ok, raw_id).alias("wof_id"), placetype.alias("placetype"), ids.alias("gn_ids"),
        localized_names(F.col("_map"), "en").alias("_en"), localized_names(F.col("_map"), "vi").alias("_vi"),
    )
    return shaped.select(
        "wof_id", "placetype", "gn_ids", F.get("gn_ids", F.lit(0)).alias("gn_id"),
        F.col("_en.primary").alias("name_en"), F.col("_vi.primary").alias("name_vi"),
        F.col("_en.aliases").alias("aliases_en"), F.col("_vi.aliases").alias("aliases_vi"),
        (F.col("_in_scope") & F.col("wof_id").isNotNull() & (F.size("gn_ids") == 1)).alias("_admissible"),
        F.array_compact(F.array(
            F.when(F.col("_broken"), F.lit("feature properties are required")),
            F.when(F.col("_in_scope") & F.col("wof_id").isNull(), F.lit("feature requires a positive id")),
        )).alias("_errors"),
    )

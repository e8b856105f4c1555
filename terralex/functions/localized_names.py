"""Names and ids inside a concordance record's `properties` object (held as VARIANT values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.text import clean_list, has_legacy_letters


def strings_of(value: Column) -> Column:
    """The string items of a JSON array, or a lone string as one item."""
    kind = F.schema_of_variant(value)
    items = F.filter(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)),
    )
    many = F.transform(items, lambda x: F.try_variant_get(x, "$", "string"))
    one = F.array(F.try_variant_get(value, "$", "string"))
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(kind.startswith("ARRAY"), many).when(kind == "STRING", one), empty)


def _values(properties: Column, prefix: str, *suffixes: str) -> Column:
    def wanted(key: Column) -> Column:
        ending = key.endswith(suffixes[0])
        for suffix in suffixes[1:]:
            ending = ending | key.endswith(suffix)
        return key.startswith(prefix) & ending

    keys = F.array_sort(F.filter(F.map_keys(properties), wanted))
    return F.flatten(F.transform(keys, lambda key: strings_of(properties[key])))


def localized_names(properties: Column, language: str) -> Column:
    """struct(primary, aliases) for `en` or `vi`; Vietnamese values with legacy letters are dropped."""
    prefix = "name:" + fv.CONCORDANCE_LANGUAGES[language]

    def usable(names: Column) -> Column:
        cleaned = clean_list(names)
        return F.filter(cleaned, lambda x: ~has_legacy_letters(x)) if language == "vi" else cleaned

    preferred = usable(_values(properties, prefix, "_x_preferred"))
    variants = _values(properties, prefix, "_x_variant", "_x_colloquial")
    primary = F.get(preferred, F.lit(0))
    rest = usable(F.concat(F.slice(preferred, F.lit(2), F.greatest(F.size(preferred), F.lit(0))), variants))
    aliases = F.filter(rest, lambda x: F.coalesce(x != primary, F.lit(True)))
    return F.struct(primary.alias("primary"), aliases.alias("aliases"))


def positive_ids(value: Column) -> Column:
    """Distinct positive integer ids (text) of a scalar or array, in numeric order."""
    kind = F.schema_of_variant(value)
    many = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda x: F.trim(F.try_variant_get(x, "$", "string"))
    )
    one = F.array(F.trim(F.try_variant_get(value, "$", "string")))
    items = F.coalesce(F.when(kind.startswith("ARRAY"), many).otherwise(one), F.array().cast("array<string>"))
    valid = F.filter(items, lambda x: x.isNotNull() & x.rlike(r"^[0-9]+\z") & (x != "0"))
    keyed = F.array_sort(F.transform(
        F.array_distinct(valid), lambda x: F.struct(F.length(F.ltrim(x, F.lit("0"))).alias("length"), F.ltrim(x, F.lit("0")).alias("number"), x.alias("id"))
    ))
    return F.transform(keyed, lambda x: x["id"])

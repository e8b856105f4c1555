"""Canonical ids, point ids, content hashes and canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex import fixed_values as fv
from terralex.functions.text import trimmed


def canonical_entity_id(value: Column) -> Column:
    """Upper-cased Q-id or a safe namespaced id; anything else is null."""
    text = trimmed(value)
    return F.when(text.rlike(fv.QID_PATTERN), F.concat(F.lit("Q"), F.substring(text, F.lit(2), F.length(text)))).when(
        text.rlike(fv.NAMESPACED_ID_PATTERN) & ~text.contains(".."), text
    )


def uuid_v5(name: Column, namespace: str = fv.UUID_NAMESPACE_DNS) -> Column:
    seed = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    digest = F.sha1(seed)
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def point_id(entity_id: Column) -> Column:
    canonical = canonical_entity_id(entity_id)
    return F.when(
        canonical.isNotNull(), uuid_v5(F.concat(F.lit(fv.POINT_ID_PREFIX), canonical), fv.UUID_NAMESPACE_URL)
    )


def text_sha256(text: Column) -> Column:
    return F.sha2(trimmed(text), 256)


def translation_key(text: Column, provider: str, model: str, prompt_version: str,
                    source: str = "en", target: str = "vi") -> Column:
    identity = F.struct(
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        F.lit(prompt_version).alias("promptVersion"), F.lit(source).alias("from"),
        F.lit(target).alias("to"), text_sha256(text).alias("sourceSha256"),
    )
    return F.sha2(F.to_json(identity), 256)


def _ordered(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, T.MapType):
        ordered = F.map_from_entries(F.array_sort(F.map_entries(value)))
        if isinstance(kind.valueType, T.StructType):
            return F.transform_values(ordered, lambda _, x: _ordered(x, kind.valueType))
        return ordered
    return value


def canonical_json(schema: T.StructType) -> Column:
    """JSON of the whole row with keys sorted at every level, so column order never matters."""
    fields = sorted(schema.fields, key=lambda f: f.name)
    ordered = F.struct(*[_ordered(F.col(f.name), f.dataType).alias(f.name) for f in fields])
    return F.to_json(ordered, {"ignoreNullFields": "false"})

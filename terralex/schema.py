"""Declared schemas of the tables the jobs exchange."""

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


BILINGUAL = _struct(en=_S, vi=_S)
ALIASES = _struct(en=T.ArrayType(_S), vi=T.ArrayType(_S))
SOURCE_REF = _struct(source=_S, source_id=_S)
PROVENANCE = _struct(name_en=_S, name_vi=_S, description_en=_S, description_vi=_S)
TRANSLATION = _struct(
    provider=_S, model=_S, prompt_version=_S, source_language=_S, target_language=_S,
    source_sha256=_S, translation_version=_S,
)
# A country's capital is a name, a city's is a flag: two columns.
FACTS = _struct(
    country=_S, capital=_S, is_capital=_B, currency=_S, languages=T.ArrayType(_S), local_name=_S,
    ascii_name=_S, latitude=_D, longitude=_D, timezone=_S, feature_code=_S, admin1_code=_S,
    admin2_code=_S, admin3_code=_S, admin4_code=_S, elevation=_I, dem=_I, modification_date=_S,
    iso3=_S, wof_id=_S, wof_placetype=_S, extra=T.MapType(_S, _S),
)
ENTITY = _struct(
    id=_S, type=_S, name=BILINGUAL, description=BILINGUAL, aliases=ALIASES, continent=_S, region=_S,
    country_code=_S, population=_L, facts=FACTS, source=_S, source_id=_S,
    source_refs=T.ArrayType(SOURCE_REF), language_provenance=PROVENANCE,
    translation_metadata=T.MapType(_S, TRANSLATION),
)

# Entity JSON files use camelCase keys; `facts` stays a raw map because its value types vary.
ENTITY_JSON = _struct(
    id=_S, type=_S, name=BILINGUAL, description=BILINGUAL, aliases=ALIASES, continent=_S, region=_S,
    countryCode=_S, population=_D, facts=T.MapType(_S, _S), source=_S, sourceId=_S,
    sourceRefs=T.ArrayType(_struct(source=_S, sourceId=_S)), languageProvenance=PROVENANCE,
    translationMetadata=T.MapType(_S, TRANSLATION),
)
FACT_JSON_KEYS = {
    "country": "country", "currency": "currency", "localName": "local_name", "asciiName": "ascii_name",
    "latitude": "latitude", "longitude": "longitude", "timezone": "timezone", "featureCode": "feature_code",
    "admin1Code": "admin1_code", "admin2Code": "admin2_code", "admin3Code": "admin3_code",
    "admin4Code": "admin4_code", "elevation": "elevation", "dem": "dem",
    "modificationDate": "modification_date", "iso3": "iso3", "wofId": "wof_id",
    "wofPlacetype": "wof_placetype",
}

CASE = _struct(
    id=_S, language=_S, query=_S, expected_ids=T.ArrayType(_S), category=_S, challenge=_S, answerable=_B,
)
RESULT = _struct(case_id=_S, rank=_I, id=_S, score=_D)
CACHE_RECORD = _struct(key=_S, text=_S, metadata=TRANSLATION)
PROGRESS = _struct(
    run_id=_S, collection=_S, stage=_S, batch=_L, total_batches=_L, total=_L, embedded=_L, upserted=_L,
    skipped_existing=_L, elapsed_ms=_D, embedding_ms=_D, upsert_ms=_D,
)

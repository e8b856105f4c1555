"""Entity, case and request validation: normalised columns plus an `_errors` array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex import schema
from terralex.functions.ids import canonical_entity_id
from terralex.functions.numeric import finite
from terralex.functions.text import clean_list, trim_to_null, utf16_length


def _unless(condition: Column, message: str) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(message))


def _column(df: DataFrame, name: str) -> Column:
    kind = schema.ENTITY[name].dataType
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def normalise_entities(df: DataFrame) -> DataFrame:
    """The canonical entity row. Missing columns are null; empty text becomes null."""
    name, description, aliases = (_column(df, c) for c in ("name", "description", "aliases"))
    given_provenance, refs = _column(df, "language_provenance"), _column(df, "source_refs")
    source = F.coalesce(_column(df, "source"), F.lit(fv.DEFAULT_SOURCE))
    source_id = F.coalesce(_column(df, "source_id"), F.col("id"))
    population = _column(df, "population").cast("double")
    name_en, name_vi = trim_to_null(name["en"]), trim_to_null(name["vi"])

    def provenance(field: str, present: Column) -> Column:
        return F.coalesce(given_provenance[field], F.when(present, source).otherwise(F.lit("missing"))).alias(field)

    def has(text: Column) -> Column:
        return F.coalesce(text != "", F.lit(False))

    own_ref = F.array(F.struct(source.alias("source"), source_id.alias("source_id")))
    all_refs = F.array_distinct(F.coalesce(refs, own_ref))
    known = F.struct(
        provenance("name_en", name_en.isNotNull()), provenance("name_vi", name_vi.isNotNull()),
        provenance("description_en", has(description["en"])), provenance("description_vi", has(description["vi"])),
    )
    canonical = canonical_entity_id(F.col("id"))
    errors = F.array_compact(F.array(
        _unless(canonical.isNotNull(), "id must be a canonical entity id"),
        _unless(F.col("type").isin(*fv.ENTITY_TYPES), "unsupported entity type"),
        _unless(name_en.isNotNull() | name_vi.isNotNull(), "at least one localized name is required"),
        _unless(source.rlike(fv.SOURCE_NAME_PATTERN), "source must be a safe lowercase source name"),
        _unless(
            F.forall(all_refs, lambda r: r["source"].rlike(fv.SOURCE_NAME_PATTERN) & trim_to_null(r["source_id"]).isNotNull()),
            "source_refs must contain valid pairs",
        ),
        F.when(population.isNotNull() & ~(finite(population) & (population >= 0)), F.lit("population must be a non-negative number")),
        *[
            _unless(known[f].isin(*fv.PROVENANCE), f"invalid provenance for {f}")
            for f in ("name_en", "name_vi", "description_en", "description_vi")
        ],
    ))
    return df.select(
        canonical.alias("id"), "type",
        F.struct(name_en.alias("en"), name_vi.alias("vi")).alias("name"),
        F.struct(trim_to_null(description["en"]).alias("en"), trim_to_null(description["vi"]).alias("vi")).alias("description"),
        F.struct(clean_list(aliases["en"]).alias("en"), clean_list(aliases["vi"]).alias("vi")).alias("aliases"),
        trim_to_null(_column(df, "continent")).alias("continent"), trim_to_null(_column(df, "region")).alias("region"),
        trim_to_null(_column(df, "country_code")).alias("country_code"),
        population.try_cast("bigint").alias("population"), _column(df, "facts").alias("facts"),
        source.alias("source"), source_id.alias("source_id"), all_refs.alias("source_refs"),
        known.alias("language_provenance"),
        F.coalesce(_column(df, "translation_metadata"), F.create_map().cast(schema.ENTITY["translation_metadata"].dataType)).alias("translation_metadata"),
        errors.alias("_errors"),
    )


def bilingual_state() -> Column:
    def has(language: str) -> Column:
        return F.col(f"name.{language}").isNotNull() | F.col(f"description.{language}").isNotNull()

    provenance = F.col("language_provenance")
    machine = F.lit(False)
    for field in schema.PROVENANCE.names:
        machine = machine | F.coalesce(provenance[field] == "machine_translation", F.lit(False))
    both = has("en") & has("vi")
    return (
        F.when(machine & both, "translated_bilingual").when(both, "native_bilingual")
        .when(has("en"), "english_only").otherwise("vietnamese_only")
    )


def validate_requests(
    requests: DataFrame, default_limit: int = fv.DEFAULT_LIMIT, max_limit: int = fv.MAX_LIMIT,
    default_threshold: float = fv.DEFAULT_SCORE_THRESHOLD,
) -> DataFrame:
    """Trimmed and defaulted request columns plus `_error` (the first violation, else null)."""
    def column(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in requests.columns else F.lit(None).cast(kind)

    query = trim_to_null(F.col("query"))
    language = F.coalesce(column("language", "string"), F.lit("auto"))
    limit = F.coalesce(column("limit", "double"), F.lit(float(default_limit)))
    threshold = F.coalesce(column("score_threshold", "double"), F.lit(float(default_threshold)))
    filter_errors = [
        F.when(F.col(c).isNotNull() & trim_to_null(F.col(c)).isNull(), F.lit(f"{c.removeprefix('filter_')} must be a non-empty string"))
        for c in (f"filter_{f}" for f in fv.KEYWORD_FILTERS) if c in requests.columns
    ] + [
        F.when(F.col(c).isNotNull() & ~(finite(F.col(c)) & (F.col(c) >= 0)), F.lit("population bounds must be non-negative"))
        for c in (f"filter_{fv.RANGE_FILTER}_{op}" for op in fv.RANGE_OPS) if c in requests.columns
    ]
    error = F.coalesce(
        _unless(query.isNotNull(), "query is required"),
        F.when(utf16_length(query) > fv.MAX_QUERY_CHARS, F.lit("query must be at most 1000 characters")),
        _unless(language.isin(*fv.QUERY_LANGUAGES), "language must be auto, en or vi"),
        _unless((limit == F.floor(limit)) & (limit >= 1) & (limit <= max_limit), f"limit must be between 1 and {max_limit}"),
        _unless(finite(threshold) & (threshold >= 0) & (threshold <= 1), "score_threshold must be between 0 and 1"),
        *filter_errors,
    )
    trimmed_filters = {
        f"filter_{f}": trim_to_null(F.col(f"filter_{f}")) for f in fv.KEYWORD_FILTERS if f"filter_{f}" in requests.columns
    }
    return requests.withColumns({
        "_error": error, "query": query, "language": language, "limit": limit.try_cast("int"),
        "score_threshold": threshold, **trimmed_filters,
    })


def validate_cases(cases: DataFrame, entities: DataFrame) -> DataFrame:
    """Cases with `_errors`: shape rules, duplicate ids, and expected ids that exist with the right type."""
    required_type = None
    for category, kind in fv.CATEGORY_TYPES.items():
        if kind:
            hit = F.col("category") == category
            required_type = F.when(hit, kind) if required_type is None else required_type.when(hit, kind)
    expected = cases.select("id", required_type.alias("_need"), F.explode("expected_ids").alias("_expected"))
    types = entities.select(F.col("id").alias("_expected"), F.col("type").alias("_type"))
    wrong = expected.join(types, "_expected", "left").groupBy("id").agg(
        F.count_if(F.col("_type").isNull()).alias("_absent"),
        F.count_if(F.col("_type").isNotNull() & F.col("_need").isNotNull() & (F.col("_type") != F.col("_need"))).alias("_mistyped"),
    )
    copies = cases.groupBy("id").agg(F.count("*").alias("_copies"))
    rows = cases.join(copies, "id", "left").join(wrong, "id", "left")
    no_answer = F.col("category") == "no-answer"
    can_answer = F.coalesce("answerable", F.lit(True))
    blank = F.coalesce(F.size("expected_ids"), F.lit(-1)) < 0
    some = F.size("expected_ids") > 0
    errors = F.array_compact(F.array(
        _unless(trim_to_null(F.col("id")).isNotNull(), "id is blank"),
        F.when(F.col("_copies") > 1, F.lit("id occurs more than once")),
        _unless(F.col("language").isin(*fv.CASE_LANGUAGES), "language is not one of the two"),
        _unless(F.col("category").isin(*fv.CATEGORY_TYPES), "category is unknown"),
        _unless(trim_to_null(F.col("query")).isNotNull(), "query is blank"),
        F.when(blank, F.lit("expected ids are missing")),
        F.when(no_answer & can_answer, F.lit("a case without an answer is marked answerable")),
        F.when(no_answer & some, F.lit("a case without an answer names expected ids")),
        F.when(~no_answer & ~can_answer, F.lit("category has answers but the case is marked unanswerable")),
        F.when(~no_answer & ~some & ~blank, F.lit("expected ids are missing")),
        F.when(~no_answer & F.exists("expected_ids", lambda x: x.rlike(r"^[Qq][0-9]+\z")), F.lit("expected id is of the old form")),
        F.when(~no_answer & (F.col("_absent") > 0), F.lit("expected id is in no entity")),
        F.when(~no_answer & (F.col("_mistyped") > 0), F.lit("expected entity is not of the category's type")),
    ))
    return rows.withColumn("_errors", errors).drop("_copies", "_absent", "_mistyped")

"""Tab-delimited gazetteer dumps: cities, countries, first-level divisions, alternate names.

Each parser takes a one-column table of lines (`value`) and returns typed columns plus `_errors`, so the
caller chooses between failing and quarantining. Nothing is collected; a file of any size splits by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.functions.numeric import number_error, parse_number
from terralex.functions.text import repair_legacy_letters, split_list, trim_to_null, trimmed
from terralex.session import small_side


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_positioned_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with `line_at`, which orders them as they stand in the files, files by name: the row number counts
    within a split, and splits are told apart by file and offset, so the order does not depend on their size."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select("value", at.alias("line_at"))


def _at(lines: DataFrame) -> list[str]:
    return ["line_at"] if "line_at" in lines.columns else []


def _cells(lines: DataFrame, skip_comments: bool = False) -> DataFrame:
    line = F.regexp_replace("value", "\r\\z", "")
    rows = lines.select(line.alias("_line"), *_at(lines)).where(F.col("_line") != "")
    if skip_comments:
        rows = rows.where(~F.col("_line").startswith("#"))
    return rows.withColumn("_cell", F.split("_line", "\t", -1))


def _cell(names: tuple[str, ...], name: str) -> Column:
    return F.get(F.col("_cell"), F.lit(names.index(name)))


def _digits(cell: Column) -> Column:
    return F.coalesce(cell.rlike(r"^[0-9]+\z"), F.lit(False))


def _errors(*checks: Column) -> Column:
    replacement = F.when(
        F.col("_line").contains(fv.REPLACEMENT_CHARACTER), F.lit("row contains a Unicode replacement character")
    )
    return F.array_compact(F.array(replacement, *checks)).alias("_errors")


def _unless(condition: Column, message: str) -> Column:
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(message))


def parse_cities(lines: DataFrame) -> DataFrame:
    def cell(name: str) -> Column:
        return _cell(fv.CITY_COLUMNS, name)

    def whole(name: str) -> Column:
        return parse_number(cell(name)).try_cast("bigint")

    numbers = {"latitude", "longitude", "population", "elevation", "dem"}
    fixed = {"geoname_id", "country_code"}
    text = [trim_to_null(cell(n)).alias(n) for n in fv.CITY_COLUMNS if n not in numbers | fixed]
    return _cells(lines).select(
        cell("geoname_id").try_cast("bigint").alias("geoname_id"), cell("country_code").alias("country_code"), *text,
        parse_number(cell("latitude")).alias("latitude"), parse_number(cell("longitude")).alias("longitude"),
        whole("population").alias("population"),
        whole("elevation").cast("int").alias("elevation"), whole("dem").cast("int").alias("dem"), *_at(lines),
        _errors(
            _unless(F.size("_cell") == len(fv.CITY_COLUMNS), "city row must contain 19 tab-delimited columns"),
            _unless(_digits(cell("geoname_id")), "geoname id is invalid"),
            _unless(trim_to_null(cell("name")).isNotNull(), "city name is required"),
            _unless(cell("country_code").rlike(r"^[A-Z]{2}\z"), "country code is invalid"),
            number_error(cell("latitude"), "latitude", low=-90, high=90),
            number_error(cell("longitude"), "longitude", low=-180, high=180),
            number_error(cell("population"), "population", integer=True, low=0),
            number_error(cell("elevation"), "elevation", integer=True),
            number_error(cell("dem"), "dem", integer=True),
        ),
    )


def parse_countries(lines: DataFrame) -> DataFrame:
    def cell(name: str) -> Column:
        return _cell(fv.COUNTRY_COLUMNS, name)

    special = {"iso2", "geoname_id", "area_km2", "population", "languages", "neighbours"}
    text = [trim_to_null(cell(n)).alias(n) for n in fv.COUNTRY_COLUMNS if n not in special]
    return _cells(lines, skip_comments=True).select(
        cell("iso2").alias("iso2"), cell("geoname_id").try_cast("bigint").alias("geoname_id"), *text,
        parse_number(cell("area_km2")).alias("area_km2"),
        parse_number(cell("population")).try_cast("bigint").alias("population"),
        split_list(cell("languages")).alias("languages"), split_list(cell("neighbours")).alias("neighbours"), *_at(lines),
        _errors(
            _unless(F.size("_cell") >= fv.COUNTRY_MIN_COLUMNS, "country row is malformed"),
            _unless(cell("iso2").rlike(r"^[A-Z]{2}\z") & _digits(cell("geoname_id")), "country identity is invalid"),
            number_error(cell("area_km2"), "country area", low=0),
            number_error(cell("population"), "country population", integer=True, low=0),
        ),
    )


def parse_admin1(lines: DataFrame) -> DataFrame:
    def cell(name: str) -> Column:
        return _cell(fv.ADMIN1_COLUMNS, name)

    return _cells(lines).select(
        cell("code").alias("code"), trim_to_null(cell("name")).alias("name"),
        trim_to_null(cell("ascii_name")).alias("ascii_name"),
        cell("geoname_id").try_cast("bigint").alias("geoname_id"),
        _errors(
            _unless(F.size("_cell") == len(fv.ADMIN1_COLUMNS), "admin-1 row must contain 4 tab-delimited columns"),
            _unless((cell("code") != "") & _digits(cell("geoname_id")), "admin-1 identity is invalid"),
        ),
    )


def parse_alternate_names(lines: DataFrame, selected_ids: DataFrame | None = None) -> DataFrame:
    """Rows in the two kept languages, optionally only those of `selected_ids` (geoname_id).

    The semi-join runs on the raw key cell, before any other cell is read or checked.
    """
    def cell(name: str) -> Column:
        return _cell(fv.ALTERNATE_NAME_COLUMNS, name)

    def flag(name: str) -> Column:
        return cell(name) == "1"

    def flag_ok(name: str) -> Column:
        return cell(name).isin("", "1")

    def raw(position: int) -> Column:
        return F.substring_index(F.substring_index("value", "\t", position + 1), "\t", -1)

    lines = lines.where(raw(fv.ALTERNATE_NAME_COLUMNS.index("language")).isin(*fv.NAME_LANGUAGES))
    if selected_ids is not None:
        keys = small_side(selected_ids.select(F.col("geoname_id").cast("string").alias("_id")).distinct())
        lines = lines.join(keys, raw(fv.ALTERNATE_NAME_COLUMNS.index("geoname_id")) == F.col("_id"), "left_semi")
    rows = _cells(lines).where(cell("language").isin(*fv.NAME_LANGUAGES))
    name = F.when(cell("language") == "vi", repair_legacy_letters(trimmed(cell("name")))).otherwise(trimmed(cell("name")))
    flags_ok = flag_ok("preferred") & flag_ok("short_name") & flag_ok("colloquial") & flag_ok("historic")
    return rows.select(
        cell("alternate_name_id").try_cast("bigint").alias("alternate_name_id"),
        cell("geoname_id").try_cast("bigint").alias("geoname_id"),
        cell("language").alias("language"), name.alias("name"),
        *[flag(n).alias(n) for n in ("preferred", "short_name", "colloquial", "historic")],
        F.nullif(cell("valid_from"), F.lit("")).alias("valid_from"),
        F.nullif(cell("valid_to"), F.lit("")).alias("valid_to"),
        _errors(
            _unless(F.size("_cell") == len(fv.ALTERNATE_NAME_COLUMNS), "alternate name row must contain 10 tab-delimited columns"),
            _unless(_digits(cell("alternate_name_id")) & _digits(cell("geoname_id")), "alternate name identity is invalid"),
            _unless(flags_ok, "alternate name flags are invalid"),
            _unless(trim_to_null(cell("name")).isNotNull(), "alternate name text is required"),
        ),
    )

"""Dataset building queries: sources, normalisation, enrichment, merging, coverage, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs
from checks.inputs import sql_fold
from checks.registry import Tables, register
from terralex import fixed_values as fv
from terralex import schema
from terralex.functions.ids import canonical_entity_id, point_id
from terralex.functions.localized_names import localized_names
from terralex.functions.numeric import number_error
from terralex.functions.text import clean_list, has_legacy_letters, repair_legacy_letters, split_list
from terralex.operators import enrich, merge, quality
from terralex.operators.normalize import gazetteer_id, keep_first, representative_order, select_representative
from terralex.operators.ordering import bounded_sample, number_rows
from terralex.operators.validate import bilingual_state, normalise_entities
from terralex.session import fail_on_errors
from terralex.sources import concordance, gazetteer
from terralex.sources.entities import parse_entity_json


# ---------------------------------------------------------------- raw dumps, derived line by line from the tables


def city_lines(t: Tables, broken: bool = True):
    """19-column lines; `broken` damages some of them in each way the parser checks."""
    key, empty = F.col("geoname_id"), F.lit("")
    latitude = F.when(F.lit(broken) & (key % 41 == 0), "north").otherwise(F.round(key % 90 + 0.5, 2).cast("string"))
    cells = [
        key.cast("string"), F.col("name"), F.col("ascii_name"), empty, latitude, (key % 180).cast("string"), F.lit("P"), F.col("feature_code"),
        F.when(F.lit(broken) & (key % 43 == 0), F.lower("country_code")).otherwise(F.col("country_code")), empty, F.col("admin1_code"), empty, empty, empty,
        F.when(F.lit(broken) & (key % 47 == 0), "-5").otherwise(F.coalesce(F.col("population").cast("string"), empty)),
        empty, (key % 1000).cast("string"), F.lit("UTC"), F.lit("2024-01-01"),
    ]
    line = F.concat_ws("\t", *cells)
    line = F.when(F.lit(broken) & (key % 53 == 0), F.concat(line, F.lit("\textra"))).otherwise(line)
    return t.view("city_src").select(F.concat(line, F.when(key % 2 == 0, "\r").otherwise(empty)).alias("value"))


def country_lines(t: Tables):
    empty = F.lit("")
    cells = {
        "iso2": F.col("iso2"), "iso3": F.col("iso3"), "country_name": F.col("country_name"), "capital": F.coalesce("capital", empty),
        "area_km2": F.lit("1000.5"), "population": F.coalesce(F.col("population").cast("string"), empty), "continent_code": F.col("continent_code"),
        "currency_name": F.col("currency_name"), "languages": F.concat(F.lit("en, ,"), F.lower("iso3"), F.lit(",")),
        "geoname_id": F.col("geoname_id").cast("string"),
    }
    line = F.concat_ws("\t", *[cells.get(c, empty) for c in fv.COUNTRY_COLUMNS[:17]])
    rows = t.view("country_src").select(F.explode(F.array(F.concat(F.lit("# "), F.col("iso2")), line, empty)).alias("value"))
    return rows


def admin1_lines(t: Tables):
    return t.view("admin1_src").select(F.concat_ws("\t", "code", "name", F.lower("name"), F.lit("7")).alias("value"))


def alternate_lines(t: Tables):
    def flag(name: str):
        return F.when(F.col(name), "1").otherwise("")

    return t.view("alt_src").select(F.concat_ws(
        "\t", F.col("alternate_name_id").cast("string"), F.col("geoname_id").cast("string"), "language",
        F.when(F.col("language") == "vi", F.concat(F.lit("Ðảo "), F.col("name"))).otherwise(F.col("name")),
        flag("preferred"), flag("short_name"), F.lit(""), flag("historic"), F.lit(""), F.lit("")).alias("value"))


@register(
    "S2_F18_city_source",
    """SELECT geoname_id, name, CASE WHEN geoname_id % 53 = 0 THEN 1 ELSE 0 END + CASE WHEN geoname_id % 41 = 0 THEN 1 ELSE 0 END
            + CASE WHEN geoname_id % 43 = 0 THEN 1 ELSE 0 END + CASE WHEN geoname_id % 47 = 0 THEN 1 ELSE 0 END AS errors,
            CASE WHEN geoname_id % 47 = 0 THEN -5 ELSE population END AS population,
            CASE WHEN geoname_id % 41 <> 0 THEN CAST(geoname_id % 90 + 0.5 AS DOUBLE) END AS latitude FROM city_src""", "city_src")
def city_source(t: Tables):
    rows = gazetteer.parse_cities(city_lines(t))
    return rows.select("geoname_id", "name", F.size("_errors").cast("bigint").alias("errors"), "population", "latitude")


@register(
    "S3_F19_country_source",
    "SELECT iso2, geoname_id, country_name, capital, population, continent_code, 'en|' || lower(iso3) AS languages, 0 AS errors FROM country_src", "country_src")
def country_source(t: Tables):
    rows = gazetteer.parse_countries(country_lines(t))
    return rows.select("iso2", "geoname_id", "country_name", "capital", "population", "continent_code",
                       F.array_join("languages", "|").alias("languages"), F.size("_errors").cast("bigint").alias("errors"))


@register("S4_admin1_source", "SELECT code, name, lower(name) AS ascii_name, 7 AS geoname_id FROM admin1_src", "admin1_src")
def admin1_source(t: Tables):
    return fail_on_errors(gazetteer.parse_admin1(admin1_lines(t)))


@register(
    "S5_J2_P8_P10_alternate_name_source",
    """SELECT alternate_name_id, a.geoname_id, language, CASE WHEN language = 'vi' THEN 'Đảo ' || name ELSE name END AS name, preferred, short_name, historic
       FROM alt_src a WHERE language IN ('en', 'vi') AND a.geoname_id IN (SELECT geoname_id FROM city_src WHERE population >= 100000)""", "alt_src", "city_src")
def alternate_name_source(t: Tables):
    selected = t.view("city_src").where("population >= 100000").select("geoname_id")
    rows = fail_on_errors(gazetteer.parse_alternate_names(alternate_lines(t), selected))
    return rows.select("alternate_name_id", "geoname_id", "language", "name", "preferred", "short_name", "historic")


def feature_lines(t: Tables):
    """GeoJSON features with scalar or array ids, dynamic name keys, and a bulky geometry."""
    key = F.col("wof_id").cast("bigint")
    ids = F.when(key % 3 == 0, F.concat(F.lit("["), F.col("gn_id"), F.lit("]"))).when(key % 3 == 1, F.concat(F.lit('"'), F.col("gn_id"), F.lit('"'))).otherwise(F.col("gn_id"))

    def names(label: str, column: str, suffix: str):
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f',"name:{label}{suffix}":["'), F.col(column), F.lit('"," '), F.col(column), F.lit(' B "]'))).otherwise("")

    line = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":{"wof:id":'), F.col("wof_id"),
        F.lit(',"wof:placetype":"'), F.col("placetype"), F.lit('","mz:is_current":'), F.when(F.col("is_current"), "1").otherwise("0"),
        names("eng", "name_en", "_x_preferred"), names("eng", "name_en", "_x_variant"), names("vie", "name_vi", "_x_preferred"),
        F.lit(',"wof:concordances":{"gn:id":'), ids, F.lit("}}}"))
    return t.view("wof_src").select(line.alias("value"))


@register(
    "S6_P9_F22_F23_concordance_source",
    """SELECT wof_id, nullif(gn_id, '0') AS gn_id, placetype, name_en, name_vi, CASE WHEN name_en IS NULL THEN '' ELSE name_en || ' B' END AS aliases_en,
              placetype = 'locality' AND is_current AND gn_id <> '0' AS admissible FROM wof_src""", "wof_src")
def concordance_source(t: Tables):
    rows = concordance.parse_features(concordance.feature_properties(feature_lines(t)), "city")
    return rows.select("wof_id", "gn_id", "placetype", "name_en", "name_vi", F.array_join("aliases_en", "|").alias("aliases_en"), F.col("_admissible").alias("admissible"))


@register(
    "S6_parse_only_mentioned",
    "SELECT count(*) AS scanned, count(CASE WHEN gn_id NOT IN (SELECT CAST(geoname_id AS STRING) FROM city_src WHERE population > 300000) THEN 1 END) AS skipped_unmatched, "
    "0 AS invalid FROM wof_src", "wof_src", "city_src")
def parse_only_mentioned(t: Tables):
    features = concordance.feature_properties(feature_lines(t))
    kept = concordance.worth_parsing(features, t.view("city_src").where("population > 300000").select("geoname_id"))
    return enrich.scan_report(features, concordance.parse_features(kept, "city"))


@register(
    "S1_P1_entity_json",
    """SELECT 'Q' || CAST(c_custkey + 1 AS STRING) AS id, c_name AS name_en, CASE WHEN c_custkey % 2 = 0 THEN 'vi ' || c_name END AS name_vi,
              'A|B' AS aliases_en, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS errors, c_custkey % 5 = 0 AS is_capital,
              CASE WHEN c_custkey % 7 = 0 THEN 'geonames' ELSE 'wikidata' END AS prov_en, 'x' AS extra FROM customer""")
def entity_json(t: Tables):
    """Entities written as JSON and read back with the declared schema, polymorphic facts included."""
    key = F.col("c_custkey")
    text = F.to_json(F.struct(
        F.concat(F.lit(" q"), (key + 1).cast("string")).alias("id"), F.lit("city").alias("type"),
        F.struct(F.concat(F.col("c_name"), F.lit(" ")).alias("en"), F.when(key % 2 == 0, F.concat(F.lit("vi "), F.col("c_name"))).otherwise("").alias("vi")).alias("name"),
        F.struct(F.array(F.lit(" A"), F.lit("B"), F.lit("A"), F.lit("")).alias("en")).alias("aliases"),
        F.col("c_acctbal").alias("population"), F.struct((key % 5 == 0).alias("capital"), F.lit("x").alias("other")).alias("facts"),
        F.when(key % 7 == 0, F.lit("geonames")).alias("source"),
    ))
    raw = t.table("customer").select(F.from_json(text, schema.ENTITY_JSON).alias("r")).select("r.*")
    return parse_entity_json(raw).select(
        "id", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"), F.array_join("aliases.en", "|").alias("aliases_en"),
        F.size("_errors").cast("bigint").alias("errors"), F.col("facts.is_capital").alias("is_capital"),
        F.col("language_provenance.name_en").alias("prov_en"), F.col("facts.extra")["other"].alias("extra"))


@register(
    "P2_canonical_ids",
    """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN CASE WHEN c_custkey = 0 THEN NULL ELSE 'Q' || CAST(c_custkey AS STRING) END
          WHEN 1 THEN 'geonames:city:' || CAST(c_custkey AS STRING) WHEN 4 THEN 'ns_1:' || c_name2 END AS id
       FROM (SELECT *, replace(c_name, '#', '-') AS c_name2 FROM customer) x""")
def canonical_ids(t: Tables):
    key = F.col("c_custkey")
    text = key.cast("string")
    raw = (
        F.when(key % 6 == 0, F.concat(F.lit("q"), text)).when(key % 6 == 1, F.concat(F.lit("  geonames:city:"), text, F.lit("\t")))
        .when(key % 6 == 2, F.concat(F.lit("Geo:"), text)).when(key % 6 == 3, F.concat(F.lit("ns:a.."), text))
        .when(key % 6 == 4, F.concat(F.lit("ns_1:"), F.replace("c_name", F.lit("#"), F.lit("-")))).otherwise(F.concat(F.lit("n:"), text)))
    return t.table("customer").select("c_custkey", canonical_entity_id(raw).alias("id"))


_ENT = "SELECT id, type, name_en, continent, region, country_code, population, is_capital, capital, country, prov_en FROM ent"


def _flat(df):
    return df.select(
        "id", "type", F.col("name.en").alias("name_en"), "continent", "region", "country_code", "population", F.col("facts.is_capital").alias("is_capital"),
        F.col("facts.capital").alias("capital"), F.col("facts.country").alias("country"), F.col("language_provenance.name_en").alias("prov_en"))


@register("P3_J1_city_entities", _ENT + " WHERE type = 'city'", "ent")
def city_entities(t: Tables):
    return _flat(inputs.city_rows(t))


@register("P4_country_entities", _ENT + " WHERE type = 'country'", "ent")
def country_entities(t: Tables):
    return _flat(inputs.country_rows(t))


@register("U1_W6_union_keep_first", "SELECT id, name_en FROM ent", "ent")
def union_keep_first(t: Tables):
    """The same cities loaded twice under different names: the first load wins."""
    base = inputs.entities(t).select("id", F.col("name.en").alias("name_en"))
    again = base.withColumn("name_en", F.lower("name_en"))
    both = base.withColumn("load", F.lit(1)).unionByName(again.withColumn("load", F.lit(2)))
    return keep_first(both, "id", "load")


_TOP = "ORDER BY CASE WHEN is_capital THEN 1 ELSE 0 END DESC, coalesce(population, -1) DESC, geoname_id, id"


@register("T1_representative", f"SELECT id, population FROM ent {_TOP} LIMIT 200", "ent")
def representative(t: Tables):
    return select_representative(inputs.entities(t), 200).select("id", "population")


@register("T1_T7_numbered_order", f"SELECT id, row_number() OVER ({_TOP}) AS row FROM ent", "ent")
def numbered_order(t: Tables):
    """The whole representative order, numbered across partitions."""
    return number_rows(inputs.entities(t).select("id", "type", "facts", "population", "source_refs", "source", "source_id"), representative_order()).select(
        "id", F.col("_row").alias("row"))


@register(
    "T6_bounded_sample",
    "SELECT geoname_id, TRUE AS truncated FROM city_src WHERE population IS NULL ORDER BY geoname_id LIMIT 20", "city_src")
def sample(t: Tables):
    rows, truncated = bounded_sample(t.view("city_src").where("population IS NULL").select("geoname_id"), [F.asc("geoname_id")], 20)
    return rows.withColumn("truncated", F.lit(truncated))


# ---------------------------------------------------------------- alternate names

_NAMES = {
    "eligible": "SELECT * FROM alt_src WHERE language IN ('en', 'vi') AND NOT historic",
    "best": """SELECT geoname_id, language, name FROM (SELECT *, row_number() OVER (PARTITION BY geoname_id, language
               ORDER BY preferred DESC, short_name DESC, alternate_name_id) AS rn FROM eligible) x WHERE rn = 1""",
    "spelled": "SELECT geoname_id, language, name, min(alternate_name_id) AS seq FROM eligible GROUP BY 1, 2, 3",
}


@register("W1_best_current_name", "SELECT geoname_id, language, name FROM best", "alt_src", then=_NAMES)
def best_current_name(t: Tables):
    return enrich.best_current_names(t.view("alt_src"))


@register(
    "J3_W7_alternate_name_enrichment",
    """SELECT e.id, coalesce(en.name, e.name_en) AS name_en, vi.name AS name_vi, coalesce(a.aliases, '') AS aliases_en,
              CASE WHEN en.name IS NOT NULL THEN 'geonames_alternate' ELSE e.prov_en END AS prov_en
       FROM ent e LEFT JOIN best en ON en.geoname_id = e.geoname_id AND en.language = 'en'
       LEFT JOIN best vi ON vi.geoname_id = e.geoname_id AND vi.language = 'vi'
       LEFT JOIN (SELECT s.geoname_id, string_agg(s.name, '|' ORDER BY s.seq) AS aliases FROM spelled s
                  JOIN best b ON b.geoname_id = s.geoname_id AND b.language = 'en'
                  WHERE s.language = 'en' AND s.name <> b.name GROUP BY 1) a ON a.geoname_id = e.geoname_id""",
    "ent", "alt_src", then=_NAMES)
def alternate_name_enrichment(t: Tables):
    rows = enrich.apply_alternate_names(inputs.entities(t), t.view("alt_src"))
    return rows.select("id", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"), F.array_join("aliases.en", "|").alias("aliases_en"),
                       F.col("language_provenance.name_en").alias("prov_en"))


@register(
    "P10_legacy_letters",
    "SELECT c_custkey, replace(replace('Ðà ð' || c_name, 'Ð', 'Đ'), 'ð', 'đ') AS repaired, TRUE AS had, FALSE AS has FROM customer")
def legacy_letters(t: Tables):
    text = F.concat(F.lit("Ðà ð"), F.col("c_name"))
    fixed = repair_legacy_letters(text)
    return t.table("customer").select("c_custkey", fixed.alias("repaired"), has_legacy_letters(text).alias("had"), has_legacy_letters(fixed).alias("has"))


# ---------------------------------------------------------------- concordance

_MATCH = {
    "cand": "SELECT * FROM wof_src WHERE placetype = 'locality' AND is_current",
    "per": "SELECT gn_id, count(DISTINCT wof_id) AS n, min(wof_id) AS wof_id FROM cand GROUP BY gn_id",
    "m": """SELECT e.*, per.n, w.wof_id, w.name_en AS w_en, w.name_vi AS w_vi,
            CASE WHEN per.n > 1 THEN 'ambiguous' WHEN per.n = 1 THEN 'matched' ELSE 'none' END AS state
            FROM ent e LEFT JOIN per ON per.gn_id = CAST(e.geoname_id AS STRING) AND e.type = 'city'
            LEFT JOIN cand w ON w.wof_id = per.wof_id AND per.n = 1 WHERE e.type = 'city'""",
}


def _matched(t: Tables):
    rows = t.view("wof_src").where("placetype = 'locality' AND is_current")
    empty = F.array().cast("array<string>")
    candidates = rows.select("gn_id", "wof_id", "placetype", "name_en", "name_vi", empty.alias("aliases_en"), empty.alias("aliases_vi"))
    return enrich.match_concordance(inputs.city_rows(t), candidates), candidates


@register("J4_J5_match_concordance", "SELECT id, state, CASE WHEN state = 'matched' THEN wof_id END AS wof_id, n AS candidates FROM m", "ent", "wof_src", then=_MATCH)
def match_concordance(t: Tables):
    rows, _ = _matched(t)
    return rows.select("id", F.col("match").alias("state"), F.when(F.col("match") == "matched", F.col("c_wof_id")).alias("wof_id"),
                       F.col("c_candidate_count").alias("candidates"))


@register(
    "J5_contested_candidates",
    """SELECT gn_id, count(DISTINCT wof_id) > 1 OR max(CASE WHEN claims > 1 THEN 1 ELSE 0 END) = 1 AS ambiguous FROM (
         SELECT CAST(l_partkey % 300 AS STRING) AS wof_id, CAST(l_partkey AS STRING) AS gn_id FROM lineitem) c
       JOIN (SELECT wof_id, count(DISTINCT gn_id) AS claims FROM (SELECT CAST(l_partkey % 300 AS STRING) AS wof_id, CAST(l_partkey AS STRING) AS gn_id FROM lineitem) y GROUP BY 1) k
       USING (wof_id) GROUP BY gn_id""")
def contested_candidates(t: Tables):
    """Ambiguity from the other side: one candidate claimed by several ids."""
    key = F.col("l_partkey")
    rows = t.table("lineitem").select((key % 300).cast("string").alias("wof_id"), key.cast("string").alias("gn_id"), F.lit("x").alias("placetype"))
    return enrich.candidate_degrees(rows).select("gn_id", "ambiguous")


@register(
    "J4_apply_concordance",
    """SELECT id, coalesce(w_en, name_en) AS name_en, w_vi AS name_vi, CASE WHEN w_en IS NOT NULL THEN name_en ELSE '' END AS aliases_en,
              CASE WHEN w_en IS NOT NULL THEN 'whosonfirst' ELSE prov_en END AS prov_en, CASE WHEN state = 'matched' THEN 2 ELSE 1 END AS refs FROM m""",
    "ent", "wof_src", then=_MATCH)
def apply_concordance(t: Tables):
    rows, _ = _matched(t)
    done = enrich.apply_concordance(rows, inputs.city_rows(t).columns)
    return done.select("id", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"), F.array_join("aliases.en", "|").alias("aliases_en"),
                       F.col("language_provenance.name_en").alias("prov_en"), F.size("source_refs").cast("bigint").alias("refs"))


@register(
    "A4_concordance_report",
    """SELECT type, count(*) AS requested, count(CASE WHEN state = 'matched' THEN 1 END) AS matched, count(CASE WHEN state = 'ambiguous' THEN 1 END) AS ambiguous,
              count(w_en) AS name_en, count(w_vi) AS name_vi FROM (SELECT type, state, w_en, w_vi FROM m UNION ALL SELECT NULL, state, w_en, w_vi FROM m) x GROUP BY type""",
    "ent", "wof_src", then=_MATCH)
def concordance_report(t: Tables):
    rows, _ = _matched(t)
    return enrich.concordance_report(enrich.apply_concordance(rows, inputs.city_rows(t).columns))


@register(
    "T6_ambiguity_samples",
    """SELECT p.id AS type, c.wof_id, c.gn_id FROM (SELECT 'city' AS id, CAST(geoname_id AS STRING) AS gn_id FROM m WHERE state = 'ambiguous' ORDER BY m.id LIMIT 10) p
       JOIN cand c USING (gn_id)""", "ent", "wof_src", then=_MATCH)
def ambiguity_samples(t: Tables):
    rows, candidates = _matched(t)
    return enrich.ambiguity_samples(rows, candidates, 10)


# ---------------------------------------------------------------- merging

_MERGE_ROWS = {
    "src": """
        SELECT 'Q' || CAST(c_custkey + 1 AS STRING) AS id, 'geonames' AS source, 2 AS pos, 'g' || CAST(c_custkey AS STRING) AS source_id, 'G ' || c_name AS name_en,
               CASE WHEN c_custkey % 3 = 0 THEN 'V ' || c_name END AS name_vi, CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS population,
               c_mktsegment AS region, 'en' AS l1, 'b' AS l2, 'tz' AS tz FROM customer
        UNION ALL SELECT 'Q' || CAST(c_custkey + 1 AS STRING), 'wikidata', 1, 'w' || CAST(c_custkey AS STRING), CASE WHEN c_custkey % 2 = 0 THEN 'W ' || c_name END,
               'WV ' || c_name, CASE WHEN c_custkey % 4 = 0 THEN 7 END, NULL, 'a', 'b', NULL FROM customer
        UNION ALL SELECT 'Q' || CAST(s_suppkey + 1 AS STRING), 'whosonfirst', 99, 's' || CAST(s_suppkey AS STRING), s_name, NULL, 5, 'R', 'z', 'a', 'late' FROM supplier""",
}


def _merge_inputs(t: Tables):
    def shaped(df, source, prefix, key, name_en, name_vi, population, region, l1, l2, tz):
        facts = F.struct(*[
            (F.array(F.lit(l1), F.lit(l2)) if f.name == "languages" else F.lit(tz) if f.name == "timezone" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.FACTS.fields])
        aliases = F.struct(F.array(F.lit(l1), F.lit(l2)).alias("en"), F.array().cast("array<string>").alias("vi"))
        return fail_on_errors(normalise_entities(df.select(
            F.concat(F.lit("Q"), (key + 1).cast("string")).alias("id"), F.lit("city").alias("type"), F.struct(name_en.alias("en"), name_vi.alias("vi")).alias("name"),
            aliases.alias("aliases"), population.cast("bigint").alias("population"), region.cast("string").alias("region"), facts.alias("facts"),
            F.lit(source).alias("source"), F.concat(F.lit(prefix), key.cast("string")).alias("source_id"))))

    customer, supplier = t.table("customer"), t.table("supplier")
    key, name, none = F.col("c_custkey"), F.col("c_name"), F.lit(None).cast("string")
    return [
        shaped(customer, "geonames", "g", key, F.concat(F.lit("G "), name), F.when(key % 3 == 0, F.concat(F.lit("V "), name)),
               F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal")), F.col("c_mktsegment"), "en", "b", "tz"),
        shaped(customer, "wikidata", "w", key, F.when(key % 2 == 0, F.concat(F.lit("W "), name)), F.concat(F.lit("WV "), name), F.when(key % 4 == 0, 7), none, "a", "b", None),
        shaped(supplier, "whosonfirst", "s", F.col("s_suppkey"), F.col("s_name"), none, F.lit(5), F.lit("R"), "z", "a", "late"),
    ]


@register(
    "J6_C5_A23_W5_merge_sources",
    """SELECT id, arg_min(name_en, pos) FILTER (WHERE name_en IS NOT NULL) AS name_en, arg_min(name_vi, pos) FILTER (WHERE name_vi IS NOT NULL) AS name_vi,
              arg_min(source, pos) FILTER (WHERE name_en IS NOT NULL) AS prov_en, arg_min(population, pos) FILTER (WHERE population IS NOT NULL) AS population,
              arg_min(region, pos) FILTER (WHERE region IS NOT NULL) AS region, arg_min(tz, pos) FILTER (WHERE tz IS NOT NULL) AS timezone,
              arg_min(source, pos) AS source, string_agg(source_id, '|' ORDER BY pos) AS refs,
              (SELECT string_agg(l, '|' ORDER BY o) FROM (SELECT l, min(o) AS o FROM (SELECT l1 AS l, pos * 10 AS o FROM src i WHERE i.id = s.id
                UNION ALL SELECT l2, pos * 10 + 1 FROM src i WHERE i.id = s.id) y GROUP BY l) z) AS languages
       FROM src s GROUP BY id""", then=_MERGE_ROWS)
def merge_sources(t: Tables):
    merged = merge.merge_entities(_merge_inputs(t))
    return merged.select(
        "id", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"), F.col("language_provenance.name_en").alias("prov_en"), "population", "region",
        F.col("facts.timezone").alias("timezone"), "source", F.array_join(F.transform("source_refs", lambda r: r["source_id"]), "|").alias("refs"),
        F.array_join("facts.languages", "|").alias("languages"))


@register("W7_merged_aliases", "SELECT id, count(DISTINCT l) AS aliases FROM (SELECT id, l1 AS l FROM src UNION ALL SELECT id, l2 FROM src) x GROUP BY id", then=_MERGE_ROWS)
def merged_aliases(t: Tables):
    return merge.merge_entities(_merge_inputs(t)).select("id", F.size("aliases.en").cast("bigint").alias("aliases"))


# ---------------------------------------------------------------- coverage and quality

@register(
    "A1_coverage",
    """SELECT count(*) AS total, count(CASE WHEN type = 'city' THEN 1 END) AS city_count, count(CASE WHEN prov_en <> 'geonames_fallback' THEN 1 END) AS name_en,
              count(*) AS name_en_present, count(CASE WHEN prov_en = 'geonames_fallback' THEN 1 END) AS name_en_fallback, 0 AS name_vi, 0 AS description_en,
              0 AS description_vi, 0 AS vi_legacy_texts FROM ent""", "ent")
def coverage(t: Tables):
    return quality.coverage(inputs.entities(t))


@register(
    "A1_continent_coverage",
    "SELECT v.continent, count(e.id) AS entities FROM (VALUES ('Africa'), ('Antarctica'), ('Asia'), ('Europe'), ('North America'), ('Oceania'), ('South America')) v(continent) "
    "LEFT JOIN ent e USING (continent) GROUP BY 1", "ent")
def continent_coverage(t: Tables):
    return quality.continent_coverage(inputs.entities(t))


@register("A1_country_coverage", "SELECT country_code, count(*) AS entities FROM ent WHERE country_code IS NOT NULL GROUP BY 1", "ent")
def country_coverage(t: Tables):
    return quality.country_coverage(inputs.entities(t))


_QUALITY_ROWS = {
    "qe": """SELECT CAST(o_custkey AS STRING) AS id, o_orderkey % 900 AS ref, CASE WHEN o_orderkey % 5 = 0 THEN 'Ðảo' END AS vi FROM orders""",
}


def _quality_rows(t: Tables):
    key = F.col("o_orderkey")
    name = F.struct(F.lit("x").alias("en"), F.when(key % 5 == 0, F.lit("Ðảo")).alias("vi"))
    aliases = F.struct(F.array().cast("array<string>").alias("en"), F.array(F.lit("đảo")).alias("vi"))
    ref = F.array(F.struct(F.lit("s").alias("source"), (key % 900).cast("string").alias("source_id")))
    return t.table("orders").select(F.col("o_custkey").cast("string").alias("id"), name.alias("name"), aliases.alias("aliases"), ref.alias("source_refs"))


@register(
    "A3_quality_checks",
    """SELECT (SELECT count(*) - count(DISTINCT id) FROM qe) AS duplicate_entity_ids,
              (SELECT count(*) FROM (SELECT ref FROM qe GROUP BY ref HAVING count(DISTINCT id) > 1) x) AS duplicate_source_refs,
              (SELECT count(vi) FROM qe) AS vi_legacy_texts""", then=_QUALITY_ROWS)
def quality_checks(t: Tables):
    return quality.quality_checks(quality.quality_issues(_quality_rows(t)))


@register(
    "A3_quality_issues",
    """SELECT 'duplicate_entity_id' AS code, id AS entity_id, NULL AS value, count(*) - 1 AS occurrences FROM qe GROUP BY id HAVING count(*) > 1
       UNION ALL SELECT 'duplicate_source_ref', min(id), max(id), 1 FROM qe GROUP BY ref HAVING count(DISTINCT id) > 1
       UNION ALL SELECT 'vi_legacy_text', id, vi, 1 FROM qe WHERE vi IS NOT NULL""", then=_QUALITY_ROWS)
def quality_issues(t: Tables):
    return quality.quality_issues(_quality_rows(t)).select("code", "entity_id", "value", "occurrences")


@register(
    "P13_bilingual_state",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN 'english_only' WHEN c_custkey % 3 = 0 THEN 'native_bilingual'
              WHEN c_custkey % 5 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'english_only' ELSE 'english_only' END ELSE 'translated_bilingual' END AS state FROM customer""")
def bilingual_states(t: Tables):
    key = F.col("c_custkey")
    none = F.lit(None).cast("string")
    stamp = F.when(key % 3 == 0, "geonames").otherwise("machine_translation")
    rows = t.table("customer").select(
        "c_custkey", F.struct(F.lit("x").alias("en"), F.when(key % 5 != 0, "y").alias("vi")).alias("name"),
        F.struct(none.alias("en"), none.alias("vi")).alias("description"),
        F.struct(F.lit("geonames").alias("name_en"), stamp.alias("name_vi"), none.alias("description_en"), none.alias("description_vi")).alias("language_provenance"))
    return rows.select("c_custkey", bilingual_state().alias("state"))


@register(
    "F18_number_checks",
    "SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 OR (c_custkey % 4 = 0 AND c_acctbal < 0) OR c_custkey % 4 = 3 THEN 'n is invalid' END AS problem FROM customer")
def number_checks(t: Tables):
    key = F.col("c_custkey")
    text = (F.when(key % 4 == 0, F.floor("c_acctbal").cast("string")).when(key % 4 == 1, F.lit(" ")).when(key % 4 == 2, F.lit("NaN")).otherwise(F.lit("1.5")))
    return t.table("customer").select("c_custkey", number_error(text, "n", integer=True, low=0).alias("problem"))


@register("F19_list_cleaning", "SELECT c_custkey, c_mktsegment || '|x' AS clean, 3 AS parts FROM customer")
def list_cleaning(t: Tables):
    raw = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" ,, x,"), F.col("c_mktsegment"))
    parts = split_list(raw)
    return t.table("customer").select("c_custkey", F.array_join(clean_list(parts), "|").alias("clean"), F.size(parts).cast("bigint").alias("parts"))


@register("F22_localized_names", "SELECT p_partkey, p_name AS primary_name, p_brand || '|z' AS aliases FROM part")
def names(t: Tables):
    text = F.to_json(F.create_map(
        F.lit("name:eng_x_preferred"), F.array("p_name", F.col("p_brand")), F.lit("name:eng_x_variant"), F.array(F.col("p_brand"), F.lit(" z ")),
        F.lit("name:fra_x_preferred"), F.array(F.lit("f"))))
    rows = t.table("part").select("p_partkey", F.try_parse_json(text).alias("v")).withColumn("m", F.expr("try_cast(v AS MAP<STRING, VARIANT>)"))
    found = localized_names(F.col("m"), "en")
    return rows.select("p_partkey", found["primary"].alias("primary_name"), F.array_join(found["aliases"], "|").alias("aliases"))


@register("J11_F11_point_ids", "SELECT count(DISTINCT id) AS ids, 36 AS width, count(DISTINCT id) AS version5 FROM ent", "ent")
def point_ids(t: Tables):
    ids = inputs.entities(t).select(point_id(F.col("id")).alias("p"))
    return ids.agg(F.countDistinct("p").alias("ids"), F.max(F.length("p")).cast("bigint").alias("width"),
                   F.count_if(F.col("p").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("version5"))


@register("F1_fold_entities", f"SELECT id, {sql_fold('name_en')} AS folded, geoname_id AS gid FROM ent", "ent")
def fold_entities(t: Tables):
    from terralex.functions.text import fold

    return inputs.entities(t).select("id", fold(F.col("name.en")).alias("folded"), gazetteer_id().alias("gid"))

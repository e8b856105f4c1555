"""Registration, input tables and the views shared by the Spark jobs and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.session import ship_package

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# One text per view; it runs unchanged on Spark and on the checking engine.
VIEWS: dict[str, str] = {
    "country_src": """
        SELECT CAST(n.n_nationkey AS BIGINT) AS geoname_id, n.n_name AS country_name,
               'N' || chr(65 + n.n_nationkey) AS iso2, 'NT' || chr(65 + n.n_nationkey) AS iso3,
               CASE n.n_regionkey WHEN 0 THEN 'AF' WHEN 1 THEN 'NA' WHEN 2 THEN 'AS' WHEN 3 THEN 'EU' ELSE 'SA' END AS continent_code,
               CASE n.n_regionkey WHEN 0 THEN 'Africa' WHEN 1 THEN 'North America' WHEN 2 THEN 'Asia' WHEN 3 THEN 'Europe'
                    ELSE 'South America' END AS continent,
               m.capital, 'Currency ' || CAST(n.n_regionkey AS STRING) AS currency_name, m.population
        FROM nation n
        LEFT JOIN (SELECT c_nationkey, MIN(c_name) AS capital, COUNT(*) * 100000 AS population FROM customer GROUP BY c_nationkey) m
          ON m.c_nationkey = n.n_nationkey""",
    "city_src": """
        SELECT c_custkey AS geoname_id, c_name AS name,
               CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(c_name) END AS ascii_name,
               'N' || chr(65 + c_nationkey) AS country_code, c_mktsegment AS admin1_code,
               CASE WHEN c_acctbal < 0 THEN NULL ELSE CAST(FLOOR(c_acctbal * 100) AS BIGINT) END AS population,
               CASE WHEN c_name = MIN(c_name) OVER (PARTITION BY c_nationkey) THEN 'PPLC' ELSE 'PPL' END AS feature_code
        FROM customer""",
    "admin1_src": """
        SELECT DISTINCT 'N' || chr(65 + c_nationkey) || '.' || c_mktsegment AS code,
               c_mktsegment || ' of ' || CAST(c_nationkey AS STRING) AS name
        FROM customer WHERE c_mktsegment <> 'BUILDING'""",
    "alt_src": """
        SELECT o_orderkey AS alternate_name_id, o_custkey AS geoname_id,
               CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'vi' WHEN 2 THEN 'fr' ELSE 'link' END AS language,
               o_orderpriority || ' ' || CAST(o_orderkey % 7 AS STRING) AS name,
               o_orderstatus = 'F' AS preferred, o_orderkey % 3 = 0 AS short_name, o_orderkey % 11 = 0 AS historic
        FROM orders""",
    "wof_src": """
        SELECT CAST(p_partkey + 1 AS STRING) AS wof_id, CAST(p_partkey * 7 % 400 AS STRING) AS gn_id,
               CASE WHEN p_partkey % 5 = 0 THEN 'county' ELSE 'locality' END AS placetype,
               p_partkey % 13 <> 0 AS is_current,
               CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS name_en,
               CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS name_vi
        FROM part
        UNION ALL
        SELECT CAST(1000000 + s_suppkey AS STRING), CAST(400 + s_suppkey AS STRING), 'locality', TRUE, s_name, NULL FROM supplier""",
    "ent": """
        SELECT 'geonames:city:' || CAST(c.geoname_id AS STRING) AS id, 'city' AS type, c.geoname_id, c.name AS name_en,
               k.continent, a.name AS region, c.country_code, c.population, c.feature_code = 'PPLC' AS is_capital,
               CAST(NULL AS STRING) AS capital, k.country_name AS country, CAST(NULL AS STRING) AS currency,
               'geonames_fallback' AS prov_en
        FROM city_src c LEFT JOIN country_src k ON k.iso2 = c.country_code
        LEFT JOIN admin1_src a ON a.code = c.country_code || '.' || c.admin1_code
        UNION ALL
        SELECT 'geonames:country:' || CAST(geoname_id AS STRING), 'country', geoname_id, country_name, continent,
               CAST(NULL AS STRING), iso2, population, CAST(NULL AS BOOLEAN), capital, CAST(NULL AS STRING), currency_name, 'geonames'
        FROM country_src""",
    "query_text": """
        SELECT c.c_custkey AS query_id,
               CASE c.c_custkey % 16
                 WHEN 0 THEN 'Which European country has ' || c.c_name || ' as its capital and uses the yen?'
                 WHEN 1 THEN 'Quốc gia châu Âu nào có thủ đô ' || n.n_name || ' và sử dụng đồng yên?'
                 WHEN 2 THEN 'Nước nào có ' || c.c_name || ' làm thủ đô quốc gia?'
                 WHEN 3 THEN 'What is the plot of the movie ' || c.c_name || '?'
                 WHEN 4 THEN 'Nội dung phim ' || c.c_name || ' nói về điều gì?'
                 WHEN 5 THEN 'What trophies has ' || c.c_mktsegment || ' Football Club won?'
                 WHEN 6 THEN 'Where is ' || n.n_name || ' located?'
                 WHEN 7 THEN 'Which South American country has ' || c.c_mktsegment || ' as the national capital?'
                 WHEN 8 THEN 'Not the country ' || n.n_name || '; which city is the capital of ' || n.n_name || '?'
                 WHEN 9 THEN 'country whose capital is ' || c.c_name || ' and currency is the dong'
                 WHEN 10 THEN 'Nuoc nao o chau A co ' || c.c_mktsegment || ' va ' || n.n_name || ' lam thu do quoc gia'
                 WHEN 11 THEN 'Câu lạc bộ bóng đá ' || c.c_name || ' đã giành danh hiệu nào?'
                 WHEN 12 THEN 'Quốc gia châu Phi nào lớn nhất?'
                 WHEN 13 THEN 'Which nation in North American waters have “' || n.n_name || '” as their capital city'
                 WHEN 14 THEN c.c_mktsegment || ' Asian food in ' || n.n_name
                 ELSE 'Thành phố ' || n.n_name || ' ở đâu? City population' END AS query
        FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
        UNION ALL
        SELECT 1000000000 + conv_id * 1000 + turn, text FROM conversations
        UNION ALL
        SELECT 2000000000 + item_id, text FROM benchmark""",
    "cases": """
        SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'en' ELSE 'vi' END AS language,
               CASE label % 3 WHEN 0 THEN 'country-factual' WHEN 1 THEN 'city-capital' ELSE 'city-alias' END AS category,
               CASE vec_id % 7 WHEN 0 THEN 'hard-negative' WHEN 1 THEN 'compressed' WHEN 2 THEN 'implicit-relation'
                    WHEN 3 THEN 'no-diacritics' WHEN 4 THEN 'contradictory-geography' WHEN 5 THEN 'plausible-absent-entity' END AS challenge,
               'case ' || CAST(vec_id AS STRING) AS query, vec_id % 3 <> 0 AS answerable, label
        FROM embeddings""",
}
_DEPENDS = {"ent": ("country_src", "city_src", "admin1_src")}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the shared views for one session and scale."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        ship_package(spark, "checks")
        for name in TABLES:
            spark.read.parquet(f"{folder}/{name}.parquet").createOrReplaceTempView(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *views: str) -> DataFrame:
        return self.spark.sql(with_views(text, *views))

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}", name)


def with_views(text: str, *views: str, then: dict[str, str] | None = None) -> str:
    wanted: dict[str, str] = {}
    for view in views:
        for needed in (*_DEPENDS.get(view, ()), view):
            wanted[needed] = VIEWS[needed]
    wanted |= then or {}
    if not wanted:
        return text
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in wanted.items()) + "\n" + text


def register(name: str, sql: str | None = None, *views: str, then: dict[str, str] | None = None):
    """Register a job under `name`, with its checking SQL unless it has none."""
    def wrap(job: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: job(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views, then=then)
        return job

    return wrap


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def r6(expression: str, alias: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {alias}"

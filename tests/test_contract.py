"""The registered queries: naming, coverage by SQL, and a sample of them against it."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.registry import QUERIES as CATALOGUE
from checks.registry import TABLES
from checks.verify import normal

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "J7_T2_similarity_join", "J7_grid_similarity_join", "A6_quality_by_group", "A7_latency_total", "A9_threshold_sweep", "J3_W7_alternate_name_enrichment",
    "J5_contested_candidates", "J6_C5_A23_W5_merge_sources", "F4_F5_constraints", "F10_document_text_v21", "T5_W8_A19_stress_candidates", "R1_streaming_load",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


def test_registered():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert set(CATALOGUE) <= set(queries) and len(set(CATALOGUE) - set(sql)) <= 1  # one embeds texts, which SQL cannot


def test_every_sql_text_runs(db):
    for name, text in entry.oracle_sql().items():
        db.execute(f"EXPLAIN {text}"), name


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, db, name):
    got, want = entry.queries()[name](spark, FOLDER).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_cases_of_rejected_requests_are_not_counted(spark, db):
    """Some texts of this folder are longer than a request may be."""
    test_against_sql(spark, db, "C24_intent_experiment")

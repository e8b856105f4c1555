"""The registered queries and the pipeline, whole, against SQL and brute force."""

import collections

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from checks.registry import TABLES
from checks.verify import normal
from terralex.llm import queries, snapshots
from tests.llm import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    return con


def test_one_query_per_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, db, name):
    got, want = queries.QUERIES[name](spark, FOLDER).toPandas(), db.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_whole_table(spark, name):
    found = queries.QUERIES[name](spark, FOLDER)
    want = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id")
    assert found.select("doc_id").exceptAll(want).count() == 0 and want.exceptAll(found.select("doc_id")).count() == 0


def _log(spark, conversations):
    rows = [(c, i, role, text, "x") for c, turns in conversations.items() for i, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n string")


def test_snapshots_collapse(spark):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "")]
    log = {
        5: a, 3: a[:2], 9: a[:1], 4: a, 7: [*a[:2], ("user", "other")], 8: [("user", "hi"), ("assistant", None)], 2: [("user", None)], 1: [("user", "")],
        10: [*a[:3], ("assistant", None)], 11: [("assistant", "hi")]}
    found = {r["conv_id"]: r["rendered"] for r in snapshots.collapse(_log(spark, log)).collect()}
    # Kept: conversations that are no proper prefix of another; of equal ones the smallest id.
    want = [c for c, t in log.items() if not any(len(u) > len(t) and u[: len(t)] == t for u in log.values()) and c == min(d for d, u in log.items() if u == t)]
    assert sorted(found) == sorted(want)
    assert found[7] == "<|user|>\nhi\n<|assistant|>\nhello\n<|user|>\nother\n"
    assert snapshots.collapse(_log(spark, {1: a}).limit(0)).count() == 0


def test_stages(spark, tmp_path):
    """Each stage keeps the columns of documents, works on what the one before kept, and its decisions hold."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "near_duplicates", "mixing", "bpe"]
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, after)
        if name != "bpe":
            assert after.columns == docs.columns
        before = after

    def rows(df):
        return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}

    before, after = map(rows, seen["quality_rules"])
    plain = {i for i, t in before.items() if (f := brute.rules(t))[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    assert set(after) <= plain and len(after) > 0.9 * len(plain)
    before, after = map(rows, seen["near_duplicates"])
    ids = sorted(before)
    _, labels = brute.components(ids, [before[i] for i in ids])
    assert set(after) == set(labels)
    before, after = seen["mixing"]
    counts = collections.Counter(r["doc_id"] for r in after.select("doc_id").collect())
    assert set(counts) <= set(rows(before)) and max(counts.values()) <= 3
    last = spark.read.parquet(str(tmp_path / "bpe"))
    assert collections.Counter(r["doc_id"] for r in last.select("doc_id").collect()) == counts
    assert corpus_pipeline.run(spark, FOLDER).count() == last.count()

"""The collection store: several writers, replayed transactions, filters, bounded files."""

import glob
import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terralex.session import materialise
from terralex.sources import bloom
from terralex.sources.collection_store import CollectionStore, Conflict, last_per_id


def points(spark, low, high, value=0):
    return spark.range(low, high).select(F.concat(F.lit("p"), "id").alias("point_id"), F.lit(value).alias("v"))


def stored(store):
    return {r["point_id"]: r["v"] for r in store.read().collect()}


def test_two_writers_both_land(spark, tmp_path):
    first, second = (CollectionStore(spark, str(tmp_path / "c"), buckets=4) for _ in range(2))
    assert first.insert(points(spark, 0, 20, 1)) == 20
    # The second writer opened the store before; ids 10 to 19 are there by now.
    assert second.insert(points(spark, 10, 30, 2)) == 10
    assert second.manifest["version"] == 2
    reopened = CollectionStore(spark, str(tmp_path / "c"))
    assert reopened.manifest == second.manifest
    assert stored(reopened) == {f"p{i}": 1 if i < 20 else 2 for i in range(30)}
    # An upsert against a state that has moved on is made again on the new one.
    first.upsert(points(spark, 25, 35, 3))
    assert stored(first) == {f"p{i}": 1 if i < 20 else 2 if i < 25 else 3 for i in range(35)}
    first.attempts = 0
    with pytest.raises(Conflict):
        first.insert(points(spark, 100, 101))


def test_writer_with_other_ids_keeps_its_segment(spark, tmp_path):
    first, second = (CollectionStore(spark, str(tmp_path / "c"), buckets=2) for _ in range(2))
    first.insert(points(spark, 0, 10))
    assert second.insert(points(spark, 10, 20).withColumn("note", F.lit("n"))) == 10
    assert sorted(len(s) for s in second.manifest["segments"].values()) == [2, 2] and second.read().where("note = 'n'").count() == 10
    assert first.insert(points(spark, 30, 31).limit(0)) == 0


def test_transactions(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=2)
    assert store.insert(points(spark, 0, 5), transaction=("a", 0)) == 5
    assert store.insert(points(spark, 5, 9), transaction=("a", 0)) == 0
    assert store.insert(points(spark, 5, 9), transaction=("b", 0)) == 4
    assert store.upsert(points(spark, 0, 9, 7), transaction=("a", 1)) and not store.upsert(points(spark, 0, 9, 8), transaction=("a", 1))
    assert set(stored(store).values()) == {7} and CollectionStore(spark, str(tmp_path / "c")).recorded(("a", 1))
    # A replay by another process that still sees the old state.
    late = CollectionStore(spark, str(tmp_path / "c"))
    store.insert(points(spark, 20, 25), transaction=("a", 2))
    assert late.insert(points(spark, 20, 25), transaction=("a", 2)) == 0 and late.read().count() == 14


def test_missing_reads_no_stored_ids_for_new_points(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=4)
    store.insert(points(spark, 0, 500))
    store.insert(points(spark, 1000, 1400))
    assert store.stored(points(spark, 5000, 7000)) is None
    for most in (500_000, 30, 300):
        assert sorted(r["point_id"] for r in store.stored(points(spark, 300, 1200).select("point_id"), most).collect()) == sorted(f"p{i}" for i in [*range(300, 500), *range(1000, 1200)])
    assert store.missing(points(spark, 300, 1200)).count() == 500
    asked = store.maybe_stored(points(spark, 300, 1200))
    plan = store.stored(points(spark, 300, 1200))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and asked.count() >= 400
    assert store.missing(points(spark, 0, 0)).count() == 0


def test_bounded_files(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=2, max_segments=3, keep_versions=2)
    segments = []
    for i in range(20):
        store.insert(points(spark, 10 * i, 10 * i + 10, i))
        segments.append(max(len(s) for s in store.manifest["segments"].values()))
    assert max(segments) <= 3 * 4 and store.read().count() == 200
    live = {s for names in store.manifest["segments"].values() for s in names} | {s for _, s, _ in store.manifest["retired"]}
    assert set(os.listdir(tmp_path / "c" / "data")) <= live and set(os.listdir(tmp_path / "c" / "filters")) <= live
    assert len(glob.glob(str(tmp_path / "c" / "_manifest" / "*.json"))) <= 3
    assert store.missing(points(spark, 150, 250)).count() == 50
    assert sum(n for rows in store.manifest["rows"].values() for n in rows.values()) == 200


def test_filters_know_every_id(spark):
    rng = np.random.default_rng(0)
    hashes = rng.integers(-(2**63), 2**63 - 1, 50000)
    bits = bloom.build(hashes)
    assert bloom.may_hold(bits, hashes).all() and bloom.may_hold(bits, rng.integers(-(2**63), 2**63 - 1, 200000)).sum() <= 3
    batches = [pa.record_batch({"bucket": pa.array(hashes[i::3] % 5, pa.int32()), "hash": hashes[i::3]}) for i in range(3)]
    made = list(bloom.filters_of(iter(batches), most=20000))
    assert len(made) == 2 and sum(sum(b["n"].to_pylist()) for b in made) == 50000
    for bucket in range(5):
        mine = hashes[hashes % 5 == bucket]
        held = np.zeros(len(mine), bool)
        for batch in made:
            for b, f in zip(batch["bucket"].to_pylist(), batch["bits"].to_pylist(), strict=True):
                held |= bloom.may_hold(f, mine) if b == bucket else False
        assert held.all()


def test_last_per_id_of_rows_with_maps(spark):
    rows = spark.createDataFrame([("a", {"x": "1"}, [{"y": "2"}], 1), ("a", {"x": "1"}, [{"y": "2"}], 2), ("b", None, None, 3)], "point_id string, m map<string,string>, l array<map<string,string>>, n int")
    assert {r["point_id"]: r["n"] for r in last_per_id(rows, "n").collect()} == {"a": 2, "b": 3} and last_per_id(rows).count() == 2


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


def test_stored_steps_leave_no_shuffle_files(spark, tmp_path):
    """Shuffles of a write go with it, however long the driver keeps its objects; a stored table is not stored again."""
    before = shuffle_files(spark)
    kept = materialise(points(spark, 0, 50).repartition(3, "point_id"))
    assert CollectionStore(spark, str(tmp_path / "c"), buckets=4).insert(kept, unique=True) == 50
    deadline = time.monotonic() + 20
    while shuffle_files(spark) > before and time.monotonic() < deadline:
        time.sleep(0.2)
    assert shuffle_files(spark) <= before
    assert materialise(kept) is kept and materialise(kept.where("v = 0")) is not kept


def test_points_are_finished_where_they_are_written(spark, tmp_path):
    first, second = (CollectionStore(spark, str(tmp_path / "c"), buckets=4) for _ in range(2))
    assert first.insert(points(spark, 0, 20, 1)) == 20
    made = second.insert(points(spark, 10, 30, 2), unique=True, finish=lambda rows: rows.select("point_id", (F.col("v") + 5).alias("v")))
    assert made == 10
    assert stored(second) == {f"p{i}": 1 if i < 20 else 7 for i in range(30)}

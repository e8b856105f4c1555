"""Snapshots that name what changed, model batches bounded by length, vectors by Columns, resident collections."""

import collections
import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.collections import META
from terralex.functions.letter_groups import GROUP_PRIME, GROUP_WEIGHTS, letter_group_counts, letter_group_vector
from terralex.operators.embed import CharacterGrams, bounded_batches, embed_by_columns, embed_texts
from terralex.operators.fingerprint import fingerprint_of, index_fingerprint, index_identity
from terralex.operators.validate import normalise_entities
from terralex.plans.evaluate import text_experiment
from terralex.plans.search import SearchOptions
from terralex.session import fail_on_errors, remove_path, resident
from terralex.sources import snapshots
from terralex.streaming import jobs

TEXTS = ["", "a", "Ab c", "Hà Nội là thủ đô", "x" * 5000, "a\nb\tc", "𝄞 music 𝄞", "AAAA aaaa"]


def brute_counts(text, dimension):
    points = [ord(c) for c in "  " + "".join(c.lower() if "A" <= c <= "Z" else c for c in text) + " "]
    found = collections.Counter(sum(p * w for p, w in zip(points[i : i + 3], GROUP_WEIGHTS, strict=True)) % GROUP_PRIME % dimension for i in range(len(points) - 2))
    return [found[k] for k in range(dimension)]


@pytest.mark.parametrize("dimension", [1, 7, 64])
def test_letter_groups(spark, dimension):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "text string")
    for r in rows.select("text", letter_group_counts(F.col("text"), dimension).alias("n"), letter_group_vector(F.col("text"), dimension).alias("v")).collect():
        want = brute_counts(r["text"] or "", dimension)
        assert r["n"] == want
        assert np.array_equal(np.float32(r["v"]), np.float32(np.array(want) / math.sqrt(sum(x * x for x in want))))


def test_letter_groups_of_a_long_text(spark):
    """Two million letters take well below a second, not the ten and more of array expressions; pieces meet without a gap."""
    text = "".join(f"Đảo {i} " for i in range(220_000))
    rows = spark.createDataFrame([(t,) for t in [text, "ab"]], "text string").coalesce(1).localCheckpoint()
    rows.where("length(text) < 3").select(letter_group_counts(F.col("text"))).collect()  # starts the worker
    started = time.perf_counter()
    found = {r["text"]: r["n"] for r in rows.select("text", letter_group_counts(F.col("text")).alias("n")).collect()}
    assert time.perf_counter() - started < 5
    assert found == {t: brute_counts(t, 64) for t in (text, "ab")}


def test_blank_texts_fail_with_columns(spark):
    with pytest.raises(Exception, match="non-empty"):
        embed_by_columns(spark.createDataFrame([(" \n",)], "text string"), "text", letter_group_vector).collect()
    with pytest.raises(ValueError, match="either"):
        text_experiment(None, None, None)


@pytest.mark.parametrize("letters", [None, 1, 50, 10_000])
def test_batches_are_bounded(letters):
    lengths = np.random.default_rng(3).integers(0, 60, 500)
    batches = list(bounded_batches(lengths, 16, letters))
    assert sorted(np.concatenate(batches).tolist()) == list(range(500)) and all(0 < len(b) <= 16 for b in batches)
    if letters is None:
        assert np.array_equal(np.concatenate(batches), np.arange(500))
    else:
        assert all(len(b) == 1 or len(b) * lengths[b].max() <= letters for b in batches)
    assert list(bounded_batches(np.zeros(0, int), 16, letters)) == []


class Bounded(CharacterGrams):
    """A model that refuses calls beyond 200 letters after padding, unless they are one text."""

    def encode(self, texts):
        if len(texts) > 1 and len(texts) * max(map(len, texts)) > 200:
            raise MemoryError("padded batch is too large")
        return super().encode(texts)


def test_bounded_batches_change_no_vector(spark):
    rows = spark.createDataFrame([(i, "ab c" * (1 + i * 7 % 23)) for i in range(300)], "k long, text string").coalesce(2)
    plain = embed_texts(rows, "text", lambda: CharacterGrams(16)).orderBy("k").collect()
    assert embed_texts(rows, "text", lambda: Bounded(16), batch_letters=200).orderBy("k").collect() == plain
    with pytest.raises(Exception, match="too large"):
        embed_texts(rows, "text", lambda: Bounded(16)).collect()


def entities(spark, n, changed=(), shift=0):
    rows = [(f"ns:d{i}", "landmark", (f"d{i}", None), (f"text {i}" + " new" * (i in changed), None)) for i in range(shift, n)]
    return fail_on_errors(normalise_entities(spark.createDataFrame(rows, "id string, type string, name struct<en:string,vi:string>, description struct<en:string,vi:string>")))


def test_snapshots_read_changed_buckets_only(spark, tmp_path):
    paths = [str(tmp_path / x) for x in "abc"]
    before, after = entities(spark, 400), entities(spark, 401, changed=(17, 200), shift=1)
    for rows, path in zip((before, after, before), paths, strict=True):
        snapshots.write_snapshot(rows, path, "v2.1", 64)
    changed = {r[0] for r in snapshots.changed_buckets(spark, paths[0], paths[1]).collect()}
    assert 1 <= len(changed) <= 4
    for path in paths[:2]:
        for file in Path(path, "rows").rglob("*.parquet"):
            if int(file.parent.name.split("=")[1]) not in changed:
                file.write_bytes(b"reading this would fail")
    found = snapshots.changed_ids(spark, paths[0], paths[1])
    assert {(r["id"], r["change"]) for r in found.collect()} == {("ns:d0", "removed"), ("ns:d400", "added"), ("ns:d17", "changed"), ("ns:d200", "changed")}
    assert snapshots.changed_ids(spark, paths[0], paths[0]).count() == 0
    assert snapshots.changed_ids(spark, paths[2], paths[2]).count() == 0


def test_bucket_digests_add_up_to_the_fingerprint(spark, tmp_path):
    rows, path = entities(spark, 90), str(tmp_path / "s")
    snapshots.write_snapshot(rows, path, "v2.1", 64)
    digests = snapshots.snapshot_digests(spark, path)
    totals = digests.agg(F.sum("entities").alias("entities"), *[F.sum(f"w{i}").cast("decimal(38,0)").alias(f"w{i}") for i in range(8)]).first()
    assert fingerprint_of(totals, index_identity(META), "v2.1") == index_fingerprint(rows, META, "v2.1")


def test_snapshots_of_nothing_and_of_other_sizes(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    snapshots.write_snapshot(entities(spark, 1).where("false"), a, "v2.1", 64)
    snapshots.write_snapshot(entities(spark, 3), b, "v2.1", 64)
    snapshots.write_snapshot(entities(spark, 3), c, "v2.1", 65)
    assert sorted(r["change"] for r in snapshots.changed_ids(spark, a, b).collect()) == ["added"] * 3
    assert snapshots.changed_ids(spark, a, a).count() == 0
    with pytest.raises(ValueError, match="different numbers"):
        snapshots.changed_ids(spark, b, c)
    with pytest.raises(ValueError, match="between"):
        snapshots.write_snapshot(entities(spark, 1), str(tmp_path / "d"), "v2.1", 0)


def test_a_resident_collection_is_read_once(spark, tmp_path):
    """The files of the collection are gone after the first batch; later batches still find every point."""
    points, source = str(tmp_path / "points"), str(tmp_path / "requests")
    vectors = CharacterGrams(16).encode([f"place {i}" for i in range(40)])
    facts = F.lit(None).cast("struct<capital:string>")
    rows = spark.createDataFrame([(f"Q{i + 1}", "city", "Asia", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, type string, continent string, embedding array<float>")
    rows.withColumns({"facts": facts, "name_en": F.col("id"), "name_vi": F.lit(None).cast("string")}).write.parquet(points)
    asked = lambda ids: spark.createDataFrame([(i, f"place {i}", [float(x) for x in vectors[i]]) for i in ids], "query_id long, query string, embedding array<float>")
    options = SearchOptions(default_threshold=0.0)
    with resident(spark.read.parquet(points)) as collection:
        for batch in (range(5), range(5, 12)):
            asked(batch).write.mode("append").parquet(source)
            stream = spark.readStream.schema("query_id long, query string, embedding array<float>").parquet(source)
            jobs.search_stream(stream, collection, str(tmp_path / "out"), str(tmp_path / "check"), options).awaitTermination()
            remove_path(spark, points)
    first = spark.read.parquet(str(tmp_path / "out" / "results")).where("rank = 1")
    assert {(r["query_id"], r["id"]) for r in first.select("query_id", "id").collect()} == {(i, f"Q{i + 1}") for i in range(12)}

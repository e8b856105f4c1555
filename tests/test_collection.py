"""Loading, resuming, auditing, translating, searching and streaming a collection."""

import pytest
from pyspark.sql import functions as F

from terralex.operators import audit, translate
from terralex.operators.embed import CharacterGrams, embed_texts
from terralex.operators.fingerprint import index_fingerprint
from terralex.operators.validate import normalise_entities
from terralex.plans.load_collection import build_translate_load, load_collection, semantic_audit
from terralex.plans.search import SearchOptions, prepare_requests, search
from terralex.session import fail_on_errors
from terralex.sources import logs
from terralex.sources.collection_store import CollectionStore
from terralex.streaming import jobs

META = {"embedding_model": "grams", "embedding_version": "1", "dataset_version": "d1",
        "embedding_runtime": {"backend": "local", "implementation": "grams", "semantic": True, "profile": "raw"}}
FACTS = "struct<country:string,capital:string,is_capital:boolean,currency:string,languages:array<string>>"


def entities(spark, n=30):
    rows = [(f"ns:e{i}", ("city", "country")[i % 2], (f"Name {i} {'abcdefgh'[i % 8] * 5}", None), ("some description", None), ("Asia", "Europe")[i % 3 == 0], i * 10) for i in range(n)]
    shaped = spark.createDataFrame(rows, "id string, type string, name struct<en:string,vi:string>, description struct<en:string,vi:string>, continent string, population bigint")
    from terralex import schema

    facts = F.struct(*[(F.lit("Tokyo") if f.name == "capital" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.FACTS.fields])
    return fail_on_errors(normalise_entities(shaped.withColumn("facts", F.when(F.col("type") == "country", facts))))


def grams():
    return CharacterGrams(32)


def test_fresh_then_idempotent_then_foreign(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=4)
    rows = entities(spark)
    first = load_collection(rows, store, grams, META)
    assert (first["mode"], first["upserted"], first["points_after"]) == ("fresh", 30, 30)
    again = load_collection(rows.repartition(3), CollectionStore(spark, str(tmp_path / "c")), grams, META)
    assert (again["mode"], again["upserted"]) == ("idempotent", 0)
    with pytest.raises(ValueError, match="different dataset"):
        load_collection(rows.withColumn("population", F.lit(1).cast("bigint")), store, grams, META)
    assert semantic_audit(store.read(), 30, META["embedding_runtime"], "grams", "v1")["matching"] == 30
    with pytest.raises(ValueError, match="provenance"):
        semantic_audit(store.read(), 30, META["embedding_runtime"], "other")
    assert audit.compatibility(store.read(), 32, 30) == [] and len(audit.compatibility(store.read(), 64, 31)) == 2


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=4)
    rows = spark.range(40).select(F.col("id").cast("string").alias("point_id"), F.lit(0).alias("v"))
    store.insert(rows)
    before = {b: list(s) for b, s in store.manifest["segments"].items()}
    store.upsert(rows.where("point_id = '7'").withColumn("v", F.lit(9)))
    changed = [b for b, s in store.manifest["segments"].items() if s != before[b]]
    assert len(changed) == 1 and store.read().count() == 40
    reopened = CollectionStore(spark, str(tmp_path / "c"))
    assert reopened.manifest == store.manifest and reopened.read().where("v = 9").first()["point_id"] == "7"


def test_guards(spark):
    reserved = {"v2.1": "canon"}
    audit.check_pairing("v2.1", "canon", reserved)
    audit.check_pairing("v1", "other", reserved)
    for version, name in (("v2.1", "other"), ("v1", "canon")):
        with pytest.raises(ValueError):
            audit.check_pairing(version, name, reserved)
    assert [audit.load_mode(p, p, 3) for p in (0, 1, 3)] == ["fresh", "resume", "idempotent"]
    for points, matching in ((4, 4), (2, 1)):
        with pytest.raises(ValueError):
            audit.load_mode(points, matching, 3)
    with pytest.raises(ValueError):
        index_fingerprint(entities(spark, 2), {**META, "dataset_version": " "})


def test_embedder_contract(spark):
    texts = spark.createDataFrame([("a",), (" ",)], "t string")
    with pytest.raises(Exception, match="non-empty"):
        embed_texts(texts, "t", grams).collect()
    with pytest.raises(ValueError, match="batch size"):
        embed_texts(texts, "t", grams, batch_size=257)

    class Wrong(CharacterGrams):
        def encode(self, texts):
            return super().encode(texts)[:, :-1]

    with pytest.raises(Exception, match="dimension"):
        embed_texts(texts.limit(1), "t", lambda: Wrong(8)).collect()


class Upper:
    def translate(self, texts):
        return [t.upper() for t in texts]


class Blank:
    def translate(self, texts):
        return [" " for _ in texts]


def test_translation_cache_and_plan(spark, tmp_path):
    path, identity = str(tmp_path / "cache"), translate.TranslationIdentity("p", "m", "1")
    rows = entities(spark, 6)
    done, fresh = translate.translate_missing(rows, logs.read_cache(spark, path), Upper, identity, ["description", "name"])
    assert fresh.count() == 7  # one shared description, six names
    first = done.orderBy("id").first()
    assert first["description"]["vi"] == "SOME DESCRIPTION" and first["language_provenance"]["name_vi"] == "machine_translation"
    assert sorted(first["translation_metadata"]) == ["description_vi", "name_vi"]
    logs.append_cache(fresh, path)
    _, nothing = translate.translate_missing(rows, logs.read_cache(spark, path), Blank, identity, ["description", "name"])
    assert nothing.count() == 0
    with pytest.raises(Exception, match="empty text"):
        translate.translate_missing(rows, logs.read_cache(spark, str(tmp_path / "none")), Blank, identity)[0].collect()
    with pytest.raises(ValueError):
        translate.check_fields(["alias"])
    kept = []
    outcome = build_translate_load(lambda: (rows, {"m": 1}), lambda e: {"n": e.count()}, Upper, logs.read_cache(spark, path), identity, save_cache=lambda c: kept.append(c.count()))
    assert outcome["translation"] == {"provider": "p", "candidates": 6, "translatedCandidates": 6, "remainingCandidates": 0}
    assert outcome["seed"] == {"n": 6} and kept == [0]
    dry = build_translate_load(lambda: (rows, {}), lambda e: 1 / 0, dry_run=True)
    assert dry["plan"] == {"entities": 6, "translationProvider": "none", "translationFields": ["description"], "translationCandidates": 0}


def test_cache_lines_last_record_wins(spark, tmp_path):
    path = tmp_path / "cache.jsonl"
    good = '{"key":"k","text":"%s","metadata":{"provider":"p"}}'
    path.write_text("\n".join([good % "old", "not json", '{"key":"k","text":"x"}', good % "new", ""]))
    assert [(r["key"], r["text"]) for r in logs.read_cache_lines(spark, str(path)).collect()] == [("k", "new")]


def loaded(spark, tmp_path):
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=4)
    load_collection(entities(spark), store, grams, META)
    return store.read()


def test_search_end_to_end(spark, tmp_path):
    points = loaded(spark, tmp_path)
    requests = spark.createDataFrame([
        (1, "Name 3 ddddd", None), (2, "Which country has Tokyo as its capital?", None), (3, "Which country has Paris as its capital?", None),
        (4, "What is the plot of the movie Name?", None), (5, " ", None), (6, "Name 4 eeeee", "Europe"),
    ], "query_id int, query string, filter_continent string")
    options = SearchOptions(default_limit=3, default_threshold=0.0)
    results, meta = search(requests, points, options, grams)
    rows = {}
    for r in results.orderBy("query_id", "rank").collect():
        rows.setdefault(r["query_id"], []).append(r)
    assert rows[1][0]["name_en"].endswith("ddddd") and [r["rank"] for r in rows[1]] == [1, 2, 3]
    assert {r["type"] for r in rows[2]} == {"country"}
    assert 3 not in rows and 4 not in rows and 5 not in rows
    assert {r["continent"] for r in rows[6]} == {"Europe"}
    counters = {r["query_id"]: r for r in meta.collect()}
    assert set(counters) == {1, 2, 3, 4, 6}
    assert counters[3]["candidate_limit"] == 15 and counters[3]["rejected_capital"] > 0 and counters[3]["count"] == 0
    assert counters[4]["intent_applied"] and counters[4]["intent_rejected"] == 3
    off, _ = search(requests, points, SearchOptions(verify_consistency=False, gate_intent=False, default_limit=3, default_threshold=0.0), grams)
    assert off.where("query_id = 4").count() == 3
    assert [r["query_id"] for r in prepare_requests(requests, options)[1].collect()] == [5]


def test_streams_are_safe_to_replay(spark, tmp_path):
    rows = entities(spark, 12)
    source = str(tmp_path / "in")
    rows.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=2)
    metadata = {**META, "index_fingerprint": "fp"}
    for run in ("a", "b"):
        jobs.load_stream(stream, store, grams, metadata, str(tmp_path / f"state-{run}"), progress_path=str(tmp_path / "progress"), run_id=run).awaitTermination()
    assert store.read().count() == 12
    written = {r["run_id"]: r["n"] for r in spark.read.parquet(str(tmp_path / "progress")).groupBy("run_id").agg(F.sum("upserted").alias("n")).collect()}
    assert written == {"a": 12, "b": 0}


def test_progress_publishing():
    assert [logs.publish_every(n) for n in (1, 100, 101, 1000)] == [1, 1, 2, 10] and logs.publish_every(5, 3) == 3


def test_a_load_in_parts_is_the_whole_load(spark, tmp_path, monkeypatch):
    """Parts take whole buckets by turns, so a bucket gets one segment, and steps of a translation are removed."""
    import os

    from checks.collections import IDENTITY, META, Prefixing, make_grams
    from terralex.plans import load_collection as plan
    from terralex.schema import TRANSLATION

    monkeypatch.setattr(plan, "PART_BYTES", 1)
    rows = spark.range(60).select(
        F.concat(F.lit("ns:doc"), "id").alias("id"), F.lit("landmark").alias("type"), F.struct(F.concat(F.lit("d"), "id").alias("en"), F.lit(None).cast("string").alias("vi")).alias("name"),
        F.struct(F.concat(F.lit("text "), "id").alias("en"), F.lit(None).cast("string").alias("vi")).alias("description"))
    rows = fail_on_errors(normalise_entities(rows))
    store = CollectionStore(spark, str(tmp_path / "c"), buckets=8)
    cache = spark.createDataFrame([], f"key string, text string, metadata {TRANSLATION.simpleString()}")
    seen = []
    outcome = build_translate_load(
        lambda: (rows, {}), lambda r: plan.load_collection(r, store, make_grams, META, "v2.1"), Prefixing, cache, IDENTITY, save_cache=lambda c: seen.extend(c.inputFiles()) or seen.append(c.count()))
    assert outcome["seed"]["upserted"] == 60 and store.manifest["version"] == 4 and seen[-1] == 60
    assert all(len(names) == 1 for names in store.manifest["segments"].values())
    assert {r["entity_id"]: r["description_vi"] for r in store.read().collect()} == {f"ns:doc{n}": f"VI text {n}" for n in range(60)}
    assert not any(os.path.exists(f.removeprefix("file://").removeprefix("file:")) for f in seen[:-1])

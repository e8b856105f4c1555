"""Model calls per distinct text, bounded filter memory, shared folders, stored tables that go away."""

import os
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from checks.collections import META
from terralex import session
from terralex.operators import knn
from terralex.operators.embed import CharacterGrams
from terralex.operators.translate import TranslationIdentity
from terralex.operators.validate import normalise_entities
from terralex.plans.load_collection import build_translate_load, load_collection
from terralex.plans.search import SearchOptions, search
from terralex.session import Scratch, fail_on_errors
from terralex.sources.collection_store import CollectionStore


class Counting(CharacterGrams):
    """Writes down every text it is given."""

    def __init__(self, folder):
        super().__init__(16)
        self.folder = folder

    def encode(self, texts):
        with open(f"{self.folder}/{os.getpid()}", "a") as out:
            out.writelines("x\n" for _ in texts)
        return super().encode(texts)

    def translate(self, texts):
        with open(f"{self.folder}/{os.getpid()}", "a") as out:
            out.writelines("x\n" for _ in texts)
        return [f"vi {t}" for t in texts]


def calls(folder):
    return sum(len((folder / f).read_text().split()) for f in os.listdir(folder))


def test_each_distinct_query_is_embedded_once(spark, tmp_path):
    vectors = CharacterGrams(16).encode([f"place {i}" for i in range(40)])
    facts = F.lit(None).cast("struct<capital:string>")
    rows = spark.createDataFrame([(f"Q{i + 1}", "city", "Asia", [float(x) for x in v]) for i, v in enumerate(vectors)], "id string, type string, continent string, embedding array<float>")
    rows = rows.withColumns({"facts": facts, "name_en": F.col("id"), "name_vi": F.lit(None).cast("string")})
    requests = spark.createDataFrame([(i, f"place {i % 7}") for i in range(20)], "query_id long, query string")
    folder = str(tmp_path)
    results, meta = search(requests, rows, SearchOptions(default_threshold=0.0), lambda: Counting(folder))
    assert results.count() == 200 and meta.count() == 20 and calls(tmp_path) == 7


def test_each_miss_is_translated_once(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    rows = spark.createDataFrame([(f"ns:d{i}", "landmark", (f"d{i}", None), (f"text {i % 9}", None)) for i in range(30)], "id string, type string, name struct<en:string,vi:string>, description struct<en:string,vi:string>")
    entities = fail_on_errors(normalise_entities(rows))
    store, folder = CollectionStore(spark, str(tmp_path / "c")), str(tmp_path / "calls")
    from terralex import schema

    outcome = build_translate_load(
        lambda: (entities, {}), load=lambda e: load_collection(e, store, CharacterGrams, META, "v2.1"), make_translator=lambda: Counting(folder),
        cache=spark.createDataFrame([], schema.CACHE_RECORD), identity=TranslationIdentity("p", "m", "1"))
    assert outcome["translation"]["translatedCandidates"] == 30 and outcome["seed"]["upserted"] == 30 and calls(tmp_path / "calls") == 9


def test_a_filter_per_query_stays_small():
    n, rows = 4000, 5000
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"query_id": range(n), "embedding": list(rng.normal(size=(n, 8))), "k": 3, "score_threshold": -2.0, "filter_population_gte": np.arange(n, dtype=float)})
    best = knn._TopK(knn._Queries.from_pandas(frame, ["filter_population_gte"]), 9)
    tracemalloc.start()
    best.add(np.arange(rows), rng.normal(size=(rows, 8)), pd.DataFrame({"population": np.arange(rows)}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    found = best.result()
    assert (found["id"] >= found["query_id"]).all() and len(found) >= 3 * (n - 10)
    assert peak < 250e6  # a mask per filter and row would add n x rows bytes to the block of scores


def test_query_blocks_equal_one_broadcast(spark):
    rng = np.random.default_rng(1)
    queries = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(50)], "query_id long, embedding array<float>")
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=6)]) for i in range(80)], "id long, embedding array<float>")
    want = sorted(map(tuple, knn.top_k(queries, rows, 4).collect()))
    size = 50 * (6 * 8 + 4 * knn.BYTES_PER_RESULT)
    assert sorted(map(tuple, knn.top_k(queries, rows, 4, broadcast_bytes=size // 3).collect())) == want


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077", setCheckpointDir=lambda _: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None)))


def test_stored_steps_go_with_their_job(spark):
    with Scratch(spark) as keep:
        kept = keep(spark.range(5))
        assert kept.count() == 5 and session.path_exists(spark, keep.folder)
    assert not session.path_exists(spark, keep.folder)


def test_text_experiment_has_the_cases_of_all_countries(spark):
    from unittest import mock

    from checks import catalogue, collections

    with mock.patch.object(collections.evaluate, "text_experiment", side_effect=collections.evaluate.text_experiment) as run:
        catalogue.QUERIES["C14_C11_text_experiment"](spark, "/root/testdata/sf0.001")
    cases, _, selection, _ = run.call_args.args
    want = spark.read.parquet("/root/testdata/sf0.001/nation.parquet").count()
    assert cases.count() == want and selection.where("reason = 'expected'").count() == want


def test_json_arrays_are_many_files(spark, tmp_path):
    from checks import files

    rows = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.lit("x" * 50).alias("query"))
    files._write_arrays(rows, f"{tmp_path}/many", target=1 << 14)
    written = list((tmp_path / "many").glob("part-*"))
    assert len(written) > 15 and max(p.stat().st_size for p in written) < 3 << 14
    found = spark.read.schema("id string, query string").json(f"{tmp_path}/many", multiLine=True)
    assert sorted(int(r["id"]) for r in found.collect()) == list(range(5000))
    files._write_arrays(rows.limit(0), f"{tmp_path}/none")
    assert spark.read.schema("id string, query string").json(f"{tmp_path}/none", multiLine=True).count() == 0

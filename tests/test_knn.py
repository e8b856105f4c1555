"""The similarity join against brute force, in both forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.operators.knn import exact_scores, top_k
from terralex.operators.ordering import number_rows, top_n

rng = np.random.default_rng(7)
VECTORS = rng.normal(size=(300, 8)).astype(np.float32)
VECTORS[100:200] = VECTORS[0]  # a third of the collection holds one vector: ties everywhere
QUERIES = np.vstack([VECTORS[:3], rng.normal(size=(17, 8))]).astype(np.float32)


def tables(spark, parts=3):
    rows = [(f"p{i:04d}", VECTORS[i].tolist(), ("city", "country")[i % 2], None if i % 5 == 0 else i * 10) for i in range(len(VECTORS))]
    collection = spark.createDataFrame(rows, "id string, embedding array<float>, type string, population bigint").repartition(parts)
    queries = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(QUERIES)], "query_id int, embedding array<float>")
    return queries, collection


def brute(k, keep=lambda q, i: True, floor=-2.0):
    out = {}
    v = VECTORS.astype(np.float64)
    for n, q in enumerate(QUERIES.astype(np.float64)):
        scores = np.floor(v @ q / np.sqrt((v * v).sum(1) * (q @ q)) * 1e9 + 0.5) / 1e9
        rows = sorted((-s, f"p{i:04d}") for i, s in enumerate(scores) if keep(n, i) and s >= floor)
        out[n] = [(i, -s) for s, i in rows[: k(n) if callable(k) else k]]
    return out


def collected(df):
    out = {n: [] for n in range(len(QUERIES))}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["id"], r["score"]))
    return out


FORMS = [{}, {"broadcast_bytes": 0, "cell_bytes": 2000}]


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("parts", [1, 7])
def test_matches_brute_force_with_ties(spark, form, parts):
    queries, collection = tables(spark, parts)
    assert collected(top_k(queries, collection, 5, digits=9, **form)) == brute(5)


@pytest.mark.parametrize("form", FORMS)
def test_filters_limits_and_threshold(spark, form):
    queries, collection = tables(spark)
    mod = F.col("query_id") % 3
    queries = queries.withColumns({
        "k": (F.col("query_id") % 4 + 1).cast("int"), "filter_type": F.when(mod == 0, "city"),
        "filter_population_gte": F.when(mod == 1, F.lit(500.0)), "filter_population_lt": F.when(mod == 1, F.lit(2000.0)),
    })

    def keep(n, i):
        if n % 3 == 0:
            return i % 2 == 0
        return n % 3 != 1 or (i % 5 != 0 and 500 <= i * 10 < 2000)

    assert collected(top_k(queries, collection, score_threshold=0.2, digits=9, **form)) == brute(lambda n: n % 4 + 1, keep, 0.2)


def test_sql_scores_agree(spark):
    queries, collection = tables(spark)
    found = top_k(queries, collection, 3, digits=9)
    again = exact_scores(queries, found.select("query_id", "id"), collection, digits=9)
    assert {(r["query_id"], r["id"]): r["score"] for r in found.collect()} == {(r["query_id"], r["id"]): r["score"] for r in again.collect()}


def test_empty_sides(spark):
    queries, collection = tables(spark)
    assert top_k(queries.limit(0), collection, 5).count() == 0
    assert top_k(queries, collection.limit(0), 5).count() == 0


@pytest.mark.parametrize("bad", [[0.0] * 8, [float("nan")] * 8, [1.0] * 7])
def test_bad_vectors_fail(spark, bad):
    queries, collection = tables(spark)
    broken = collection.limit(1).withColumn("embedding", F.lit(bad).cast("array<float>"))
    with pytest.raises(Exception, match="vectors"):
        top_k(queries, broken, 5).collect()


def test_sorted_prefix_forms_agree(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("v")).repartition(9)
    order = [F.desc("v"), F.asc("id")]
    want = [r["id"] for r in rows.orderBy(*order).limit(50).collect()]
    assert [r["id"] for r in top_n(rows, order, 50, groups=3).orderBy(*order).collect()] == want
    numbered = number_rows(rows, order).where("_row <= 50").orderBy("_row")
    assert [r["id"] for r in numbered.collect()] == want


def test_queries_of_one_vector_are_asked_once(spark, monkeypatch):
    """Eight queries a vector, with limits and thresholds of their own, past the number of pairs that are broadcast."""
    from terralex.operators import knn

    queries, collection = tables(spark)
    asked = []
    grid = knn._grid_form
    monkeypatch.setattr(knn, "GRID_PAIRS", 100)
    monkeypatch.setattr(knn, "_grid_form", lambda shaped, *rest: asked.append(shaped.count()) or grid(shaped, *rest))
    several = queries.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        (F.col("query_id") * 8 + F.col("c")).alias("query_id"), "embedding", (F.col("c") + 1).alias("k"), F.when(F.col("c") > 3, F.lit(0.3)).alias("score_threshold"))
    found = {n: [] for n in range(8 * len(QUERIES))}
    for r in sorted(top_k(several, collection, digits=9).collect(), key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["id"], r["score"]))
    best = brute(8)
    assert asked == [len(QUERIES)]
    assert found == {8 * n + c: [x for x in best[n][:c + 1] if c <= 3 or x[1] >= 0.3] for n in best for c in range(8)}


def test_rows_travel_a_bounded_number_of_times():
    """Cells of 64 KB would send every row once per cell of queries: a thousand times at 112,000 queries."""
    from terralex.operators.knn import CELLS, CELL_BYTES, _cells

    for n in (1_000, 112_000, 10_000_000):
        query_cells, row_cells = _cells(n * 584, n * 512, n, 12, 64 * 1024)
        assert max(query_cells, row_cells) <= max(CELLS, 48, -(-n * 584 // CELL_BYTES))
    assert _cells(50_000_000, 50_000_000, 100_000, 12, CELL_BYTES)[0] == 48  # all cores are busy though one cell would hold them


def test_a_block_of_queries_is_merged_alone(monkeypatch):
    """What is kept for other blocks is not sorted again; results stay those of brute force."""
    import pandas as pd

    from terralex.operators import knn

    seen = []
    usual = np.lexsort
    monkeypatch.setattr(knn.np, "lexsort", lambda keys: seen.append(len(keys[0])) or usual(keys))
    frame = pd.DataFrame({"query_id": range(4000), "embedding": list(rng.normal(size=(4000, 8))), "k": 5, "score_threshold": float("-inf")})
    best = knn._TopK(knn._Queries.from_pandas(frame, []), 9)
    rows = rng.normal(size=(3000, 8))
    for start in range(0, 3000, 500):
        best.add(np.arange(start, start + 500), rows[start:start + 500], pd.DataFrame(index=range(500)))
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    scores = np.floor(best.q.units @ units.T * 1e9 + 0.5) / 1e9
    want = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    assert max(seen) < 4000 * 5
    assert (best.result()["id"].to_numpy().reshape(4000, 5) == want).all()


def test_wide_results_are_not_sorted_again_for_each_tile(monkeypatch):
    """Merges of a hundred results a query are few: candidates wait until they are as many as the results."""
    import pandas as pd

    from terralex.operators import knn

    merges = []
    usual = np.lexsort
    monkeypatch.setattr(knn.np, "lexsort", lambda keys: merges.append(len(keys[0])) or usual(keys))
    frame = pd.DataFrame({"query_id": range(200), "embedding": list(rng.normal(size=(200, 8))), "k": 100, "score_threshold": float("-inf")})
    best = knn._TopK(knn._Queries.from_pandas(frame, []), 9)
    rows = rng.normal(size=(40_000, 8))
    for start in range(0, 40_000, 500):
        best.add(np.arange(start, start + 500), rows[start:start + 500], pd.DataFrame(index=range(500)))
    units = rows / np.linalg.norm(rows, axis=1)[:, None]
    scores = np.floor(best.q.units @ units.T * 1e9 + 0.5) / 1e9
    want = np.argsort(-scores, axis=1, kind="stable")[:, :100]
    assert (best.result()["id"].to_numpy().reshape(200, 100) == want).all()
    assert len(merges) < 25  # of 80 batches


def test_set_flags_are_found_at_any_length():
    from terralex.operators.knn import _true_positions

    for size in (1, 7, 8, 9, 61, 64):
        flags = np.ones(72, bool)
        flags[:size] = rng.random(size) < 0.3
        want = np.flatnonzero(flags[:size])
        assert _true_positions(flags, size).tolist() == want.tolist()


def test_cells_are_not_put_into_few_tasks(spark):
    """Cells are small in bytes and long in time: the tasks follow their number, not their bytes, and the few winners of
    a query are merged in one pass."""
    queries, collection = tables(spark)
    found = top_k(queries, collection, 5, digits=9, broadcast_bytes=0, cell_bytes=2000)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2
    assert "_salt" not in plan
    assert collected(found) == brute(5)


def test_streamed_requests_of_one_file_are_read_by_several_tasks(spark, tmp_path, monkeypatch):
    from terralex.streaming import jobs

    queries, collection = tables(spark)
    requests = queries.select("query_id", F.concat(F.lit("place "), F.col("query_id").cast("string")).alias("query"), "embedding")
    requests.coalesce(1).write.parquet(f"{tmp_path}/in")
    read, usual = [], jobs.prepare_requests
    monkeypatch.setattr(jobs, "prepare_requests", lambda rows, *rest: read.append(rows.rdd.getNumPartitions()) or usual(rows, *rest))
    payload = collection.withColumns({"continent": F.lit("Asia"), "name_en": F.col("id"), "name_vi": F.lit(None).cast("string")})
    stream = spark.readStream.schema(requests.schema).parquet(f"{tmp_path}/in")
    jobs.search_stream(stream, payload, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert read == [spark.sparkContext.defaultParallelism] and read[0] > 1
    assert spark.read.parquet(f"{tmp_path}/out/meta").count() == len(QUERIES)


def test_tiles_out_of_reach_are_not_scored(monkeypatch):
    """Queries that are sure of a score near 1 meet the few tiles that can hold it; the result is brute force's."""
    import pandas as pd

    from terralex.operators import knn

    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    vectors = np.vstack([rng.normal(size=(1024, 8)), rng.normal(size=(1, 8)).repeat(40, axis=0)])
    asked = np.vstack([vectors[:256] * 3, vectors[-3:]])
    floors = np.full(len(asked), 1 - 2e-9)
    queries = knn._Queries(np.arange(len(asked)), knn._unit_rows(asked), np.full(len(asked), 2), floors, [{}], np.zeros(len(asked), np.int64))
    scored = []
    best = knn._TopK(queries, 9)
    seen = best._candidates
    best._candidates = lambda *args: scored.append(1) or seen(*args)
    best.add(np.arange(len(vectors)), vectors, pd.DataFrame(index=range(len(vectors))))
    found = {n: list(zip(g["id"], g["score"])) for n, g in best.result().sort_values(["query_id", "score", "id"], ascending=[True, False, True]).groupby("query_id")}
    assert found == {n: [(n, 1.0)] for n in range(256)} | {256 + n: [(1024, 1.0), (1025, 1.0)] for n in range(3)}
    assert 4 * len(scored) < -(-len(vectors) // 16) * -(-len(asked) // 16)


def test_queries_that_stand_in_the_collection_have_sure_floors(spark):
    from terralex.operators import knn

    _, collection = tables(spark)
    asked = tables(spark)[1].select(F.col("id").alias("query_id"), "embedding")
    shaped, _ = knn._prepare_queries(asked, 2, 0.5)
    floors = {r["query_id"]: r["score_threshold"] for r in knn._sure_floors(shaped.withColumn("k", F.lit(1)), collection, 9, 300).collect()}
    assert len(floors) == 300 and set(floors.values()) == {1 - 2e-9}
    some = knn._sure_floors(shaped.withColumn("k", F.when(F.col("query_id") < "p0010", 2).otherwise(1)), collection, 9, 300)
    floors = {r["query_id"]: r["score_threshold"] for r in some.collect()}  # two are asked for; one vector stands 101 times
    assert {i for i, x in floors.items() if x == 0.5} == {f"p{i:04d}" for i in range(1, 10)}
    want = knn.top_k(asked, collection, 1, digits=9).collect()
    got = knn.top_k(asked, collection, 1, digits=9, broadcast_bytes=0, cell_bytes=2000).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 300


def test_the_best_row_of_stored_vectors_is_found_without_all_pairs(spark, monkeypatch):
    """Queries that ask for their own vector meet near vectors only, in no grid of cells, whatever the pairs; ids, ties
    by rounded score and queries that stand in no row are brute force's."""
    from terralex.operators import knn

    base = np.random.default_rng(5).normal(size=(120, 6))
    rows = [(f"r{n:04d}", (v * f).tolist()) for n, v in enumerate(base) for f in (1.0, 1.0, 2.0)]
    rows += [(f"a{n:04d}", (v + 3e-8 * np.roll(v, 1)).tolist()) for n, v in enumerate(base[:60])]  # scores 1 when rounded
    rows += [(f"b{n:04d}", (v + 0.01 * np.roll(v, 1)).tolist()) for n, v in enumerate(base[:60])]
    asked = [(n, v) for n, (_, v) in enumerate(rows)]
    collection = spark.createDataFrame([(f"{i}-{n}", v) for n, (i, v) in enumerate(rows)], "id string, embedding array<double>")
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    want = sorted(map(tuple, top_k(queries, collection, 1).collect()))
    usual = knn._cells
    monkeypatch.setattr(knn, "GRID_PAIRS", 0)
    monkeypatch.setattr(knn, "NEAR_PAIRS", 7)
    monkeypatch.setattr(knn, "_cells", lambda *_: 1 / 0)
    assert sorted(map(tuple, top_k(queries, collection, 1).collect())) == want and len(want) == len(rows)
    assert {r[1][0] for r in want[:180]} == {"a"}
    monkeypatch.setattr(knn, "_cells", usual)
    others = spark.createDataFrame([(1000 + n, np.roll(v, 2).tolist()) for n, v in enumerate(base[:50])], "query_id bigint, embedding array<double>")
    both = queries.unionAll(others)
    found = sorted(map(tuple, top_k(both, collection, 1).collect()))
    monkeypatch.setattr(knn, "NEAR_ROWS", 0)  # too many vectors in a cell: the grid
    assert sorted(map(tuple, top_k(both, collection, 1).collect())) == found and len(found) == len(rows) + 50


def test_pairs_of_two_cells_are_bounded():
    """The longest task takes as long with more vectors: cells grow in number with the pairs."""
    from terralex.operators.knn import CELL_BYTES, CELL_PAIRS, _cells

    for n in (10_000, 100_000, 600_000, 3_000_000):
        query_cells, row_cells = _cells(n * 632, n * 512, n, 12, CELL_BYTES, n * n)
        assert n * n / (query_cells * row_cells) <= CELL_PAIRS
    assert _cells(50_000_000, 50_000_000, 100_000, 12, CELL_BYTES, 10**10)[0] == 48  # few pairs: by the cores, as before


def test_numbered_rows_are_stored_as_columns(spark):
    """Later passes read columns of files, and of these only what they use."""
    numbered = number_rows(spark.range(100).withColumn("text", F.repeat(F.lit("a"), 1000)), [F.desc("id")], "n")
    assert len(numbered.inputFiles()) > 0
    assert "text" not in numbered.select("n")._jdf.queryExecution().executedPlan().toString()
    assert [r["id"] for r in numbered.orderBy("n").collect()] == list(range(99, -1, -1))

"""Streaming forms of the load, progress, request statistics and search jobs.

There is no event time here: progress and statistics are running aggregates, load and search are
per-batch jobs made safe to replay by keys.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terralex import fixed_values as fv
from terralex.operators import audit
from terralex.operators.embed import Embedder, embed_texts
from terralex.operators.payload import to_points
from terralex.operators.stats import request_statistics, running_progress
from terralex.plans.load_collection import stored_counts
from terralex.plans.search import SearchOptions, prepare_requests, search_candidates, search_meta, search_results
from terralex.session import Scratch, path_exists
from terralex.sources.collection_store import CollectionStore


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _record(spark, path: str, run_id: str, batch: int, written: int) -> None:
    """One folder per run and batch: a replay replaces its row. A replay that finds its points stored keeps the
    number the first attempt recorded."""
    row = spark.createDataFrame([(run_id, batch, written)], "run_id string, batch bigint, upserted bigint")
    folder = f"{path}/run={run_id}-batch={batch:09d}"
    if written or not path_exists(spark, folder):
        row.write.mode("overwrite").parquet(folder)


def read_progress(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/run=*")


def load_stream(
    entities: DataFrame, store: CollectionStore, make_embedder: Callable[[], Embedder], metadata: Mapping, checkpoint: str,
    text_version: str = fv.DEFAULT_TEXT_VERSION, batch_size: int = 64, progress_path: str | None = None,
    run_id: str = "stream", trigger: dict | None = None,
) -> StreamingQuery:
    """Load entities as they arrive. A replayed batch is known by its transaction (the checkpoint names the stream)
    and does nothing; points that another stream loaded are found present and not written again.

    `metadata` carries the fingerprint agreed for the whole load.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        store.refresh()
        transaction, written = (checkpoint, int(batch_id)), 0
        if not store.recorded(transaction):
            points = to_points(batch.dropDuplicates(["id"]), metadata, text_version)
            written = store.insert(embed_texts(store.missing(points), "document", make_embedder, batch_size), unique=True, transaction=transaction)
        if progress_path:
            _record(batch.sparkSession, progress_path, run_id, int(batch_id) + 1, int(written))

    return _start(entities, each, checkpoint, trigger)


def verify_stream(store: CollectionStore, fingerprint: str, expected: int) -> None:
    """The end of a load: all points stored, all of the agreed fingerprint."""
    points, matching = stored_counts(store, fingerprint)
    audit.verify_load(points, matching, expected)


def load_vectors_stream(points: DataFrame, store: CollectionStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The same for points that already carry vectors."""
    def each(batch: DataFrame, batch_id: int) -> None:
        store.refresh()
        if not store.recorded((checkpoint, int(batch_id))):
            store.insert(store.missing(batch.dropDuplicates(["point_id"])), unique=True, transaction=(checkpoint, int(batch_id)))

    return _start(points, each, checkpoint, trigger)


def progress_stream(batches: DataFrame) -> DataFrame:
    """Latest cumulative snapshot per run; write it in update mode."""
    return running_progress(batches)


def request_statistics_stream(requests: DataFrame) -> DataFrame:
    """Cumulative counters per kind; write it in update or complete mode."""
    return request_statistics(requests)


def search_stream(
    requests: DataFrame, collection: DataFrame, output: str, checkpoint: str, options: SearchOptions = SearchOptions(),
    make_embedder: Callable[[], Embedder] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Answer requests as they arrive. Each batch writes its own directories, so a replay overwrites itself."""
    def each(batch: DataFrame, batch_id: int) -> None:
        with Scratch(batch.sparkSession) as keep:
            # A batch has as many splits as files; texts are read by rules that take far longer than the files.
            spread = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism)
            valid, rejected = prepare_requests(spread, options)
            valid = keep(valid)
            judged = keep(search_candidates(valid, collection, options, make_embedder, keep))
            tables = {
                "results": search_results(valid, judged), "meta": search_meta(valid, judged),
                "rejected": rejected.select("query_id", "_error"),
            }
            for name, table in tables.items():
                table.write.mode("overwrite").parquet(f"{output}/{name}/batch={batch_id}")

    return _start(requests, each, checkpoint, trigger)

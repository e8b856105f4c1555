"""Append-only logs: translation cache and load progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex import schema
from terralex.operators.translate import latest_records
from terralex.session import path_exists


def append_cache(records: DataFrame, path: str) -> None:
    """Append records, one per key; the write time orders them against earlier appends. Of several records of a
    key the largest by text is kept, whatever order they arrive in."""
    one = records.groupBy("key").agg(F.max_by(F.struct("text", "metadata"), F.struct("text", F.xxhash64("metadata"))).alias("_r"))
    one.select("key", "_r.*").withColumn("appended_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Latest usable record per key; an absent cache is empty."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema.CACHE_RECORD)
    return latest_records(spark.read.parquet(path), "appended_at")


def read_cache_lines(spark: SparkSession, path: str) -> DataFrame:
    """The JSON-lines form of the cache; malformed lines are skipped, file position orders the records."""
    order = F.struct(F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", order.alias("_order"))
    parsed = lines.select(F.from_json("value", schema.CACHE_RECORD).alias("r"), "_order").select("r.*", "_order")
    return latest_records(parsed, "_order")


def append_progress(snapshots: DataFrame, path: str) -> None:
    snapshots.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot of each run."""
    events = spark.read.parquet(path)
    rest = [c for c in events.columns if c != "run_id"]
    newest = F.max_by(F.struct(*rest), F.struct("recorded_at", "batch"))
    return events.groupBy("run_id").agg(newest.alias("_n")).select("run_id", "_n.*")


def publish_every(total_batches: int, configured: int = 0) -> int:
    """How many batches lie between published progress events (about one hundred in all by default)."""
    return configured if configured > 0 else max(1, -(-max(1, total_batches) // 100))


def published(snapshots: DataFrame, every: int) -> DataFrame:
    """First, last and every n-th batch; other stages always."""
    batch = F.col("batch")
    return snapshots.where(
        (F.col("stage") != "seeding") | (batch == 1) | (batch == F.col("total_batches")) | (batch % every == 0)
    )

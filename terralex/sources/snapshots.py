"""Digests of a dataset by bucket, stored beside its row digests, so that two versions are compared by reading only
the buckets that differ.

A snapshot is a folder with `rows` (id, digest; one folder per bucket of the id) and `digests` (per bucket the number
of rows and the sums of the words of their digests). The sums of all buckets are the sums of the dataset, from which
its fingerprint is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.operators.fingerprint import digest_sums, row_digest
from terralex.session import collect_bounded

ROWS_PER_BUCKET = 1000
MIN_BUCKETS = 64
#: A bucket is a folder, and changed ones are named in the scan; beyond ten million rows the buckets grow instead.
MAX_BUCKETS = 10_000


def snapshot_buckets(rows: int) -> int:
    return min(MAX_BUCKETS, max(MIN_BUCKETS, -(-rows // ROWS_PER_BUCKET)))


def write_snapshot(entities: DataFrame, path: str, text_version: str, buckets: int) -> None:
    """Store the snapshot of a dataset whose ids are unique. Versions that are to be compared take one number of
    buckets. An empty dataset is a snapshot without buckets."""
    if not 1 <= buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be between 1 and {MAX_BUCKETS}")
    spark = entities.sparkSession
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    rows = entities.select("id", row_digest(entities, text_version).alias("digest"), bucket.alias("bucket"))
    rows.repartition("bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(f"{path}/rows")
    digests = digest_sums(_rows(spark, path), F.col("digest"), "bucket").withColumn("buckets", F.lit(buckets))
    digests.write.parquet(f"{path}/digests")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, digest string, bucket int").parquet(f"{path}/rows")


def snapshot_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/digests")


def changed_buckets(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(bucket): those whose digests differ, or that only one version has. Reads the digests only."""
    old, new = snapshot_digests(spark, before), snapshot_digests(spark, after)
    if old.select("buckets").unionAll(new.select("buckets")).distinct().count() > 1:
        raise ValueError("the snapshots have different numbers of buckets")
    sums = [c for c in old.columns if c not in ("bucket", "buckets")]
    left, right = (d.select("bucket", F.struct(*sums).alias(side)) for d, side in ((old, "old"), (new, "new")))
    return left.join(right, "bucket", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("bucket")


def changed_ids(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(id, change): `added`, `removed` or `changed`. Of the rows only those in changed buckets are read."""
    listed = [r["bucket"] for r in collect_bounded(changed_buckets(spark, before, after), MAX_BUCKETS, "changed buckets")]

    def side(path: str, name: str) -> DataFrame:
        rows = _rows(spark, path).where(F.col("bucket").isin(listed))
        return rows.select("bucket", "id", F.col("digest").alias(name))

    both = side(before, "old").join(side(after, "new"), ["bucket", "id"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("id", change.alias("change"))

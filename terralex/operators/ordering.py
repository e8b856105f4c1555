"""Sorted prefixes of any size and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.session import materialise

MERGE_GROUPS = 16


def _local_top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of every partition: a local sort and a row index, no shuffle."""
    index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return df.sortWithinPartitions(*order).withColumn("_i", index).where(F.col("_i") < n).drop("_i")


def top_n(df: DataFrame, order: list[Column], n: int, groups: int = MERGE_GROUPS) -> DataFrame:
    """The first n rows of a total order.

    A plain sorted limit merges n rows of every task in one; here partitions are cut locally and merged in
    `groups` parts first, so the last step sees groups x n rows at most, however many tasks there are.
    """
    df = _local_top(_local_top(df, order, n).repartition(groups), order, n)
    return df.orderBy(*order).limit(n)


def number_rows(df: DataFrame, order: list[Column], column: str = "_row") -> DataFrame:
    """A global 1-based position without a single-task window."""
    sorted_rows = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn(
        "_in_part", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    fixed = materialise(sorted_rows)  # as columns: every later pass reads the rows, most of them a few columns only
    counts = {r["_part"]: r["n"] for r in fixed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for part in sorted(counts):
        offsets.append((part, total))
        total += counts[part]
    spark = df.sparkSession
    table = spark.createDataFrame(offsets, "_part int, _offset bigint")
    return fixed.join(F.broadcast(table), "_part").withColumn(
        column, F.col("_offset") + F.col("_in_part") + 1
    ).drop("_part", "_in_part", "_offset")


def keep_top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= n).drop("_r")


def bounded_sample(df: DataFrame, order: list[Column], n: int) -> tuple[DataFrame, bool]:
    """The first n rows and whether there were more."""
    rows = df.orderBy(*order).limit(n + 1)
    return rows.orderBy(*order).limit(n), rows.count() > n

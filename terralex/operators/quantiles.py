"""Exact nearest-rank summaries that never hold a whole group in one task.

A mergeable sketch with a guaranteed rank error brackets each percentile; only the values inside the
brackets (a few sketch errors' worth of distinct values) are then ordered to find the exact one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex import fixed_values as fv
from terralex.session import materialise, require, small_side

SKETCH_ACCURACY = 100_000


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = fv.PERCENTILES,
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """(keys, percentile, value): the ceil(p/100*n)-th smallest value, exactly."""
    keys = list(keys)
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    slack = 4.0 / accuracy
    low = [max(0.0, p / 100 - slack) for p in percentiles]
    high = [min(1.0, p / 100 + slack) for p in percentiles]
    sketch = F.percentile_approx("_v", low + high, accuracy)
    count = len(percentiles)
    brackets = data.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_s")
    )
    bands = F.array(*[
        F.struct(
            F.lit(float(p)).alias("percentile"),
            F.greatest(F.lit(1), F.ceil(F.lit(p / 100.0) * F.col("_n"))).cast("bigint").alias("target"),
            (F.col("_min") if low[i] == 0.0 else F.col("_s")[i]).alias("lo"),
            (F.col("_max") if high[i] == 1.0 else F.col("_s")[count + i]).alias("hi"),
        )
        for i, p in enumerate(percentiles)
    ])
    brackets = materialise(brackets.select(*keys, bands.alias("_bands"))) if keys else brackets.select(bands.alias("_bands"))
    joined = _join(data, brackets, keys) if keys else _with_constant(data, brackets)
    # Below the bracket only a count is needed; inside it the distinct values with their counts.
    placed = joined.select(*keys, "_v", F.explode("_bands").alias("b")).where(F.col("_v") <= F.col("b.hi")).select(
        *keys, F.col("b.percentile").alias("percentile"), F.col("b.target").alias("target"),
        F.when(F.col("_v") >= F.col("b.lo"), F.col("_v")).alias("_v"),
    )
    counted = placed.groupBy(*keys, "percentile", "target", "_v").agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys, "percentile").orderBy(F.asc_nulls_first("_v")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    reached = counted.withColumn("_cum", F.sum("_c").over(order)).where(F.col("_cum") >= F.col("target"))
    result = reached.groupBy(*keys, "percentile", "target").agg(
        F.min_by("_v", "_cum").alias("value")
    )
    # A null here would mean the target fell below its bracket, which the sketch's error bound excludes.
    return result.where(require(F.col("value").isNotNull(), "percentile bracket missed its target")).drop("target")


def _join(data: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    shaped, condition = brackets, None
    for key in keys:
        shaped = shaped.withColumnRenamed(key, f"_k_{key}")
    for key in keys:
        part = data[key].eqNullSafe(shaped[f"_k_{key}"])
        condition = part if condition is None else condition & part
    # One row per group, counted before it is broadcast: the raw rows stay where they are.
    return data.join(small_side(shaped), condition).drop(*[f"_k_{key}" for key in keys])


def _with_constant(data: DataFrame, brackets: DataFrame) -> DataFrame:
    """The one row of a global aggregate, as literals."""
    row = brackets.first()
    kinds = "struct<percentile:double,target:bigint,lo:double,hi:double>"
    bands = [
        F.struct(*[F.lit(v).alias(n) for n, v in band.asDict().items()]).cast(kinds) for band in row["_bands"]
    ]
    return data.withColumn("_bands", F.array(*bands))


def summarize(
    df: DataFrame, keys: Sequence[str], value: str, percentiles: Sequence[float] = fv.PERCENTILES,
) -> DataFrame:
    """(keys, count, min, mean, p50, p90, p95, p99, max) of the non-null values; zeros for an empty group."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(value).cast("double").alias("min"),
        F.avg(value).alias("mean"), F.max(value).cast("double").alias("max"),
    )
    ranks = exact_percentiles(df, keys, value, percentiles).groupBy(*keys).agg(*[
        F.max(F.when(F.col("percentile") == float(p), F.col("value"))).alias(f"p{p:g}") for p in percentiles
    ])
    columns = ["min", "mean", *[f"p{p:g}" for p in percentiles], "max"]
    # Two one-row-per-group tables fold into one by an aggregate.
    both = base.unionByName(ranks, allowMissingColumns=True)
    joined = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in both.columns if c not in keys])
    return joined.select(*keys, "count", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in columns])


def require_latencies(df: DataFrame, value: str) -> DataFrame:
    """Latencies must be finite and non-negative."""
    from terralex.functions.numeric import finite

    ok = F.col(value).isNull() | (finite(F.col(value)) & (F.col(value) >= 0))
    return df.where(require(ok, "latencies must be non-negative finite numbers"))

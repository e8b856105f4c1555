"""Load progress and request statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _rate(count: Column, ms: Column) -> Column:
    return F.when(ms > 0, count / (ms / 1000.0)).otherwise(F.lit(0.0))


def _derived(df: DataFrame) -> DataFrame:
    """percent, rate, ETA and stage rates from cumulative counters; rounded to 3 digits.

    Progress ends at `total`; rates are of what was done, also where the counters pass a total that was set too low.
    """
    total = F.greatest(F.coalesce("total", F.lit(0)), F.lit(0))
    cap = F.when(total > 0, total).otherwise(F.lit(2**53))
    upserted = F.greatest(F.coalesce("upserted", F.lit(0)), F.lit(0))
    skipped = F.greatest(F.coalesce("skipped_existing", F.lit(0)), F.lit(0))
    completed = F.least(cap, upserted + skipped)
    rate = _rate(upserted, F.col("elapsed_ms"))
    remaining = F.greatest(F.lit(0), total - completed)
    eta = F.when((rate > 0) & (remaining > 0), remaining / rate * 1000.0).otherwise(F.lit(0.0))
    percent = F.when(total > 0, F.least(F.lit(100.0), completed / total * 100.0)).otherwise(F.lit(0.0))
    return df.withColumns({
        "percent": F.round(percent, 3), "rate_per_second": F.round(rate, 3), "eta_ms": F.round(eta, 3),
        "embedding_docs_per_second": F.round(_rate(F.col("embedded"), F.col("embedding_ms")), 3),
        "upsert_docs_per_second": F.round(_rate(upserted, F.col("upsert_ms")), 3),
    })


def progress_snapshots(batches: DataFrame, every: int = 1) -> DataFrame:
    """Per-batch metrics -> cumulative snapshots per run at the first batch and at every `every`-th one.

    Batches are summed per publishing step before the running totals, so a run's window holds its
    published snapshots only (about one hundred with the default step), however many batches it had.
    """
    step = F.when(F.col("batch") == 1, F.lit(0)).otherwise(F.ceil(F.col("batch") / every))
    counters = ("embedded", "upserted", "skipped_existing", "elapsed_ms", "embedding_ms", "upsert_ms")
    summed = batches.groupBy("run_id", step.alias("_step")).agg(
        F.max("batch").alias("batch"), F.max("total").alias("total"), *[F.sum(c).alias(c) for c in counters]
    )
    order = Window.partitionBy("run_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _derived(summed.drop("_step").withColumns({c: F.sum(c).over(order) for c in counters}))


def running_progress(batches: DataFrame) -> DataFrame:
    """The latest snapshot per run as a plain aggregation, usable on a stream in update mode."""
    return _derived(batches.groupBy("run_id").agg(
        F.max("total").alias("total"), F.max("batch").alias("batch"),
        *[F.sum(c).alias(c) for c in ("embedded", "upserted", "skipped_existing", "elapsed_ms", "embedding_ms", "upsert_ms")],
    ))


def request_statistics(requests: DataFrame) -> DataFrame:
    """Per kind: requests, items, inference time, size of the last batch. Works on streams as well."""
    return requests.groupBy("kind").agg(
        F.count("*").alias("requests"), F.sum("items").alias("items"),
        F.round(F.sum(F.greatest(F.lit(0.0), "inference_ms")), 3).alias("inference_ms"),
        F.max_by("items", F.struct("ts", "request_id")).alias("last_batch_size"),
    )

"""Mixing sources to target weights under a time-varying curriculum.

Every source has a target number of words and a weight schedule over training time t in [0, 1]. The schedule's
integral, scaled to the target, is the source's cumulative demand. A source's documents stand in a fixed
shuffled order, repeated as often as the target needs; the words before a document are looked up in the
inverse of the demand, which gives the document's training position. Documents range-sorted by position are
the training order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import WORD_PATTERN
from terralex.session import materialise


@dataclass(frozen=True)
class Curriculum:
    weights: tuple[float, ...] = (5, 2, 1)  # dealt to the sources by code point, repeating
    max_repeats: int = 3  # targets stop at so many times the source's size
    #: Start and end of each source's linear weight schedule, dealt like the weights.
    schedules: tuple[tuple[float, float], ...] = ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0))
    rows_per_block: int = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size; `_order`, a hash of the id that shuffles a source's documents; `_twin`, which
    numbers rows of the same id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "source", size.alias("size"), order.alias("_order"), F.xxhash64("text").alias("_content"))
    return rows.withColumn("_twin", F.row_number().over(Window.partitionBy("_order").orderBy("_content", "source"))).drop("_content")


def source_targets(sizes: DataFrame, options: Curriculum = Curriculum()) -> DataFrame:
    """One row per source: size, target and schedule.

    The targets share the total by weight. A source whose share is above its cap stops there and the excess is
    shared again by weight: with the sources in order of cap / weight, those before the first one whose cap
    exceeds its share of the rest are capped, and all others get weight x (rest / rest of the weights).
    Works on one row per source; a source's rows are combined before they are shuffled.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("_rank") % len(values) + 1).cast("int"))
    per = per.withColumn("_rank", F.row_number().over(by_name) - 1)
    per = per.withColumns({
        "weight": pick(options.weights), "start": pick([a for a, _ in options.schedules]), "end": pick([b for _, b in options.schedules]),
        "cap": (options.max_repeats * F.col("source_size")).cast("double"),
    })
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("_level", rest / left).withColumn("_capped", F.col("cap") / F.col("weight") <= F.col("_level"))
    # The level at the first source that is not capped holds for it and for all after it.
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("cap") / F.col("weight"), F.col("_rank"), F.col("_level").alias("level")))).over(everything)
    target = F.when(F.col("_capped"), F.col("cap")).otherwise(F.col("weight") * level.level)
    return per.withColumn("target", target).select("source", "source_size", "target", "weight", "start", "end")


def words_before(sizes: DataFrame, blocks: int) -> DataFrame:
    """Exclusive running sum of `size` within each source in shuffled order, as `before`.

    A source's order is cut into `blocks` equal hash ranges: sums per range, running sums over the ranges, and
    running sums inside a range. The largest task holds one range of one source, however large the source.
    """
    block = F.floor(F.conv(F.substring("_order", 1, 7), 16, 10).cast("long") * blocks / (1 << 28))
    cut = sizes.withColumn("_block", block.cast("int"))
    sums = cut.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead_of = sums.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("source", "_block").orderBy("_order", "_twin").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = cut.join(ahead_of, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("before", F.col("_ahead") + F.col("_within")).drop("_s", "_b", "_block", "_ahead", "_within")


def position_of(words: Column) -> Column:
    """The time t at which a source's cumulative demand reaches `words`: inverse of
    target * (a t + (b - a) t^2 / 2) / ((a + b) / 2) for its schedule running from a to b."""
    a, b, goal = F.col("start"), F.col("end"), F.col("target")
    area = F.least(words / goal, F.lit(1.0)) * (a + b) / 2
    root = F.sqrt(a * a + 2 * (b - a) * area)
    return F.when(goal <= 0, F.lit(0.0)).otherwise(F.least(2 * area / (a + root), F.lit(1.0)))


def mix(docs: DataFrame, options: Curriculum = Curriculum()) -> DataFrame:
    """One row per document: size, source_size, target, taken (words of all its repeats; the document at which
    a source reaches its target counts with the words up to there), copies, first position.

    Null or empty text has size 0 and is never taken. Null source is one source, last in order. Repeated rows
    are documents of their own. If no document has a word, all targets and takes are 0.
    """
    sizes = materialise(sized(docs))
    blocks = max(1, sizes.count() // options.rows_per_block)
    t = source_targets(sizes, options).select(F.col("source").alias("_source"), "source_size", "target", "start", "end")
    if t.count() <= 100_000:
        t = F.broadcast(t)
    rows = words_before(sizes, blocks).join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    goal = F.floor("target")
    full = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - full * F.col("source_size")
    part = F.greatest(F.least(F.col("size"), rest - F.col("before")), F.lit(0))
    rows = rows.withColumns({"taken": (full * F.col("size") + part).cast("long"), "_full": full.cast("int"), "_part": part})
    whole = (2 * F.col("_part") >= F.col("size")) & (F.col("_part") > 0)
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("_full") + whole.cast("int")))
    return rows.withColumn("position", F.when(F.col("taken") > 0, position_of(F.col("before").cast("double"))))


def training_rows(mixed: DataFrame) -> DataFrame:
    """One row per copy of a document with the copy's own position."""
    copy = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copy.withColumn("position", position_of((F.col("copy") * F.col("source_size") + F.col("before")).cast("double")))


def training_order(docs: DataFrame, partitions: int, options: Curriculum = Curriculum()) -> DataFrame:
    """The rows of `docs` that the mix takes, repeated as often as it takes them (the document that a source's
    target cuts is there if at least half of it is taken), range-sorted by training position."""
    places = training_rows(mix(docs, options)).select(F.col("_order").alias("_o"), F.col("_twin").alias("_t"), F.col("position").alias("_position"))
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    twin = F.row_number().over(Window.partitionBy("_order").orderBy("_content", "source"))
    rows = docs.select(F.struct("*").alias("row"), order.alias("_order"), F.xxhash64("text").alias("_content"), "source").withColumn("_twin", twin)
    placed = rows.join(places, (F.col("_order") == F.col("_o")) & (F.col("_twin") == F.col("_t"))).select("row", "_position", "_order")
    return placed.repartitionByRange(partitions, "_position", "_order").sortWithinPartitions("_position", "_order").select("row.*")

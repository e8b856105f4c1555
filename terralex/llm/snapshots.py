"""Conversations logged as cumulative snapshots: those that are a prefix of a longer one are dropped, and the
maximal ones rendered for training."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.session import materialise


@dataclass(frozen=True)
class ChatFormat:
    open: str = "<|"
    close: str = "|>\n"
    end: str = "\n"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, n (turns up to here), h1, h2: a 128-bit hash of the conversation's first n turns.

    Each turn's hash covers its place, role and text; the rolling prefix hash is their exclusive or, so a prefix
    costs one step whatever its length. Nulls are told apart from empty strings. Turns are in order of `turn`
    (null first), then role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = turns.select("conv_id", "turn", "role", "text").withColumn("n", F.row_number().over(order))
    parts = [F.col("n"), F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    hashed = place.select("conv_id", "turn", "n", "role", "text", F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))
    rolled = Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("conv_id", "n", F.bit_xor("a").over(rolled).alias("h1"), F.bit_xor("b").over(rolled).alias("h2"))


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no longer one begins with; of equal ones the smallest id.

    Prefixes and whole conversations meet on (n, hash), of which each is shuffled once after its copies are
    combined, so a first turn or a conversation that thousands share is one row per task. A null conv_id is a
    conversation of its own.
    """
    found = materialise(prefixes(turns))
    last = found.groupBy(F.col("conv_id").alias("_c")).agg(F.max("n").alias("last"))
    marked = found.join(last, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "n", "h1", "h2", (F.col("n") == F.col("last")).alias("whole"))
    whole = marked.where("whole").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.where("not whole").select("n", "h1", "h2").distinct()
    return whole.join(inner, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def render(turns: DataFrame, kept: DataFrame, style: ChatFormat = ChatFormat()) -> DataFrame:
    """conv_id, n_turns, rendered: the turns of each kept conversation in order, each under its role."""
    ids = kept.select(F.col("conv_id").alias("_c"), "n_turns")
    rows = turns.select("conv_id", "turn", "role", "text").join(ids, F.col("conv_id").eqNullSafe(F.col("_c")))
    text = F.concat(F.lit(style.open), F.coalesce("role", F.lit("")), F.lit(style.close), F.coalesce("text", F.lit("")), F.lit(style.end))
    grouped = rows.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", text.alias("line")))).alias("lines"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.col("lines.line"), "").alias("rendered"))


def collapse(turns: DataFrame, style: ChatFormat = ChatFormat()) -> DataFrame:
    """The maximal conversations of a log, rendered.

    Null texts and roles render as empty and differ from empty ones when conversations are compared. Repeated
    turns are turns of their own. Other columns of `turns` are not read. An empty log gives an empty result.
    """
    return render(turns, materialise(maximal(turns)), style)

"""An embedder stated as Columns: hashed groups of three letters, counted per slot, unit length.

It needs no model, gives equal vectors to equal texts and near ones to texts that share letter groups, and any SQL
engine can compute the same values. Letters are counted in Arrow batches: as array expressions, which Spark interprets
letter by letter, they took minutes of a core for every hundred megabytes of text.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a group are weighed by these, summed and reduced by the prime before they are dealt to slots.
GROUP_WEIGHTS = (31337, 7919, 104729)
GROUP_PRIME = 1000003
#: Groups of a text that are counted at once: what a task holds does not grow with the text's length.
PIECE = 1 << 17


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _reduced(values: np.ndarray, by: int) -> np.ndarray:
    """Remainders of numbers from zero up: division by one number is quicker than numpy's remainder."""
    return values - values // by * by


def count_groups(text: str, dimension: int) -> np.ndarray:
    padded, counts = f"  {text} ", np.zeros(dimension, np.int64)
    for start in range(0, len(padded) - 2, PIECE):
        points = np.frombuffer(padded[start : start + PIECE + 2].encode("utf-32-le"), "<u4").astype(np.int64)
        points[(points >= ord("A")) & (points <= ord("Z"))] += ord("a") - ord("A")
        groups = sum(points[k : len(points) - 2 + k] * w for k, w in enumerate(GROUP_WEIGHTS))
        counts += np.bincount(_reduced(_reduced(groups, GROUP_PRIME), dimension), minlength=dimension)
    return counts


def letter_group_counts(text: Column, dimension: int = 64) -> Column:
    """How many groups of three code points fall into each slot. A-Z are lower-cased; two spaces stand before the text
    and one after it. Null counts as empty."""
    @F.arrow_udf("array<int>")
    def counted(texts: pa.Array) -> pa.Array:
        counts = np.zeros((len(texts), dimension), np.int32)
        for row, value in enumerate(texts):
            counts[row] = count_groups(value.as_py(), dimension)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * dimension, counts.ravel())

    return counted(F.make_valid_utf8(F.coalesce(text, F.lit(""))))


def letter_group_vector(text: Column, dimension: int = 64) -> Column:
    """The counts divided by their length, as floats."""
    def scaled(counts: Column) -> Column:
        square = F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, x: total + x.cast("bigint") * x)
        return _bound(F.sqrt(square.cast("double")), lambda norm: F.transform(counts, lambda x: (x.cast("double") / norm).cast("float")))

    return _bound(letter_group_counts(text, dimension), scaled)

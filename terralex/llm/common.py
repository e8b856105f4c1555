"""Helpers shared by the operators: whole texts of an Arrow batch as flat arrays, and word and line hashes
computed over those arrays without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.session import ship_package

#: Words are runs of anything but these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the decimal doc_id modulo `folds`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def hash_sample(docs: DataFrame, rows: int, total: int) -> DataFrame:
    """The `rows` documents with the smallest id hashes of about `total`. A hash bound with room to spare goes
    first, so that no task sorts or sends more than its share of the sample."""
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    bound = min(1 << 32, int((1 << 32) * (2 * rows + 100) / max(total, 1)))
    return docs.where(spread < bound).orderBy(spread, "doc_id", F.xxhash64("text")).limit(rows)


def text_volume(docs: DataFrame) -> tuple[int, int]:
    """(bytes of text, rows): what the numbers of partitions and buckets are derived from."""
    row = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    return int(row[0]), int(row[1])


def partitions_for(spark: SparkSession, size: int, target: int) -> int:
    """Enough partitions for `target` bytes each, not fewer than the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // target))


# ---- hashes -----------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (splitmix64)."""
    x = x + np.uint64(_BASE)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _inverse(_BASE))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 8 * SLICE_BYTES:  # made for one very long text: not kept
        _POWERS.clear()
    return up, down


class Texts:
    """The texts of a slice as one byte array. Null counts as empty.

    `offsets` has one more entry than there are texts. Hashes of any spans come from one running sum of
    polynomial terms, so the cost does not depend on how many spans there are or how they overlap.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        buffers = texts.buffers()
        ends = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.offsets = ends - ends[0]
        data = data[ends[0] : ends[-1]]
        self.data = _LOWER[data] if lower else data
        self.count = len(texts)
        self._sums = None

    def _running(self) -> tuple[np.ndarray, np.ndarray]:
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * up[: len(self.data)], out=self._sums[1:])
        return self._sums, down

    def rolling(self, window: int) -> np.ndarray:
        """A hash of every `window` bytes in a row, by where they start."""
        sums, down = self._running()
        return (sums[window:] - sums[:-window]) * down[: max(len(sums) - window, 0)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        _, down = self._running()
        spans = (self._sums[ends] - self._sums[starts]) * down[starts]
        return mix(spans ^ ((ends - starts).astype(np.uint64) << np.uint64(40)))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end) of every word in bytes, and per text the number of words before it (n + 1 entries)."""
        solid = ~_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def code_points(self) -> np.ndarray:
        """Running number of code points before each byte (one more entry than bytes)."""
        out = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out


def per_text(before: np.ndarray) -> np.ndarray:
    """The text number of each item, from the running counts that `words` returns."""
    return np.repeat(np.arange(len(before) - 1), np.diff(before))


def cuts(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of texts of at most `limit` bytes together; a longer text is a run of its own."""
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i - start
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes) - start


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for start, count in cuts(batch.column(column), limit):
        yield batch.slice(start, count)


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """Whole texts as strings, null as empty."""
    return [t or "" for t in batch.column("text").to_pylist()]


def sums_per_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fu" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[before[1:]] - total[before[:-1]]

"""Blocked Bloom filters of 64-bit hashes, built and asked in Arrow batches.

A block is four words of 64 bits, and an id sets three bits in each, so one filter lookup reads 32 bytes in a row.
With 40 bits an id about one absent id in a million is taken for present.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BITS_PER_ID = 40
_WORDS = 4
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


def _places(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def _mask(hashes: np.ndarray, word: int) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MULTIPLIERS[word])
    out = np.zeros(len(hashes), np.uint64)
    for shift in (58, 52, 46):
        out |= np.uint64(1) << ((mixed >> np.uint64(shift)) & np.uint64(63))
    return out


def build(hashes: np.ndarray) -> bytes:
    hashes = hashes.view(np.uint64)
    blocks = max(1, -(-len(hashes) * BITS_PER_ID // (64 * _WORDS)))
    table = np.zeros((blocks, _WORDS), np.uint64)
    at = _places(hashes, blocks)
    for word in range(_WORDS):
        np.bitwise_or.at(table[:, word], at, _mask(hashes, word))
    return table.tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter; never false for one that is."""
    hashes = hashes.view(np.uint64)
    table = np.frombuffer(filter_, np.uint64).reshape(-1, _WORDS)
    at = _places(hashes, len(table))
    found = np.ones(len(hashes), bool)
    for word in range(_WORDS):
        mask = _mask(hashes, word)
        found &= table[at, word] & mask == mask
    return found


def filters_of(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """(bucket, hash) rows to (bucket, n, bits): a filter for at most `most` ids at a time, which is what a task holds."""
    pending: dict[int, list[np.ndarray]] = defaultdict(list)
    rows = 0

    def made() -> pa.RecordBatch:
        parts = {b: np.concatenate(p) for b, p in pending.items()}
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([len(p) for p in parts.values()], pa.int64()), pa.array([build(p) for p in parts.values()], pa.binary())],
            names=["bucket", "n", "bits"])

    for batch in batches:
        buckets, hashes = batch.column("bucket").to_numpy(), batch.column("hash").to_numpy()
        for bucket in np.unique(buckets):
            pending[int(bucket)].append(hashes[buckets == bucket])
        rows += len(hashes)
        if rows >= most:
            yield made()
            pending.clear()
            rows = 0
    if pending:
        yield made()

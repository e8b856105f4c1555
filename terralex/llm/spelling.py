"""Spelling variants found by Bloom-guided neighbourhoods.

Every word's edits are generated as hashes and probed against blocked Bloom filters of the vocabulary, one filter
per word length. Filters are built in slices by tasks and broadcast a bounded number of bytes at a time; a larger
vocabulary takes more passes. Only the edits that a filter lets through become strings and are shuffled, to a
join with the vocabulary that removes the false ones.

Two words one inserted or deleted code point apart are found from the longer one, two words one replaced code point
apart from the one with the smaller symbol there, so each pair is generated once; pairs are then read both ways.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Texts, cuts, mix
from terralex.session import Scratch, materialise


@dataclass(frozen=True)
class SpellingSettings:
    damage: int = 97  # a run loses one code point if this divides its hash
    shortest: int = 5  # code points of a word
    least: int = 3  # occurrences of a word
    ratio: int = 2  # how much more frequent a form must be
    bits_per_word: int = 20
    filter_bytes: int = 32 << 20  # bytes of filters that are broadcast at once
    slice_bytes: int = 1 << 20  # bytes of filter that one task builds
    longest: int = 64  # words of this length or more share one filter
    probes: int = 1 << 20  # edits that are hashed at once
    pending_rows: int = 300_000  # distinct words a task holds before it passes them on


# ---- words ------------------------------------------------------------------------------------------------

#: The symbols of words: a-z and U+00C0 to U+00FF.
SYMBOLS = np.concatenate([np.arange(97, 123), np.arange(0xC0, 0x100)]).astype(np.uint32)
_INDEX = np.zeros(256, np.uint8)
_INDEX[SYMBOLS] = np.arange(len(SYMBOLS))
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0xC3] = True  # the first byte of U+00C0 to U+00FF, and of nothing else


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def run_hashes(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, usual: int = 64) -> np.ndarray:
    """crc32 of each run continued from the crc32 of what stands before it, byte by byte for all runs at once."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    first = int(np.searchsorted(-lengths[order], -usual))  # longer ones are hashed one by one
    state, at, size = ~prefix[order].astype(np.uint32), starts[order], lengths[order]
    for j in range(usual):
        n = int(np.searchsorted(-size, -j))
        if n <= first:
            break
        here = state[first:n]
        state[first:n] = _CRC[(here ^ data[at[first:n] + j]) & np.uint32(255)] ^ (here >> np.uint32(8))
    state = ~state
    for i in range(first):
        state[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(prefix[order[i]]))
    out = np.empty(len(state), np.uint32)
    out[order] = state
    return out


def letter_runs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) in bytes of the maximal runs of letters, and the text of each."""
    letter = _LETTER[t.data]
    letter[1:] |= t.data[:-1] == 0xC3
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.offsets] = True
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:-1]
    last[:-1] &= ~letter[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(t.offsets, starts, "right") - 1


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans, which do not overlap, as an Arrow array."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    body = data[np.cumsum(inside[:-1]).astype(bool)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _counts(words: pa.Array) -> pa.Table:
    found = words.value_counts()
    return pa.table({"word": found.field("values"), "n": found.field("counts")})


def slice_counts(ids: list[str], texts: pa.Array, s: SpellingSettings) -> list[pa.Table]:
    """Words of a slice of texts and how often they stand there."""
    t = Texts(texts, lower=True)
    if not len(t.data):
        return []
    starts, ends, owner = letter_runs(t)
    points = t.code_points()
    length = points[ends] - points[starts]
    keep = length >= s.shortest  # a shorter run is no word, whole or damaged
    starts, ends, owner, length = starts[keep], ends[keep], owner[keep], length[keep]
    if not len(starts):
        return []
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    h = run_hashes(prefix[owner], t.data, starts, ends)
    hit = h % s.damage == 0
    out = []
    if not hit.all():
        out.append(_counts(_strings(t.data, starts[~hit], ends[~hit])))
    damaged = []
    for a, b, n, value in zip(starts[hit].tolist(), ends[hit].tolist(), length[hit].tolist(), h[hit].tolist(), strict=True):
        if n > s.shortest:
            word, at = t.data[a:b].tobytes().decode(), value % n
            damaged.append(word[:at] + word[at + 1 :])
    if damaged:
        out.append(_counts(pa.array(damaged, pa.large_string())))
    return out


def _merged(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")])
    return pa.table({"word": found["word"], "n": found["n_sum"]})


def vocabulary(docs: DataFrame, s: SpellingSettings) -> DataFrame:
    """word, n, length of every word. Counts are added up in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.Table] = []
        rows = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for start, count in cuts(batch.column("text")):
                made = slice_counts(ids[start : start + count], batch.column("text").slice(start, count), s)
                pending += made
                rows += sum(t.num_rows for t in made)
                if rows > 4 * s.pending_rows:
                    pending = [_merged(pending)]
                    rows = pending[0].num_rows
                    if rows > s.pending_rows:
                        yield from pending[0].cast(_COUNTS).to_batches(1 << 16)
                        pending, rows = [], 0
        if pending:
            yield from _merged(pending).cast(_COUNTS).to_batches(1 << 16)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= s.least).withColumn("length", F.char_length("word").cast("int"))


_COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


# ---- hashes of words and of their edits -----------------------------------------------------------------------

_STEP = 0x9E3779B97F4A7C15
_VALUES = mix(np.arange(1, len(SYMBOLS) + 1, dtype=np.uint64))


def _steps(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words as one array of symbols, with the running sums that give the hash of any edit in one step."""

    def __init__(self, words: pa.Array):
        self.words = words.to_pylist()
        codes = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.symbol = _INDEX[codes]
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.owner = np.repeat(np.arange(len(self.words)), self.length)
        self.place = np.arange(len(codes)) - self.first[self.owner]
        self.steps = _steps(int(self.length.max(initial=0)) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[self.symbol] * self.steps[self.place], dtype=np.uint64)])
        self.whole = self.sums[self.first[1:]] - self.sums[self.first[:-1]]

    def deletions(self) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, hash of the word without each): equal neighbours give one word, found once."""
        at = np.flatnonzero((self.place == 0) | (np.append(True, self.symbol[1:] != self.symbol[:-1])))
        start = self.sums[self.first[self.owner[at]]]
        back = np.uint64(pow(_STEP, -1, 1 << 64))
        return at, (self.sums[at] - start) + (self.sums[self.first[self.owner[at] + 1]] - self.sums[at + 1]) * back

    def replacements(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, larger symbol put there, hash) for the symbols a..b."""
        at, new = np.nonzero(np.arange(len(SYMBOLS))[None] > self.symbol[a:b, None])
        at += a
        return at, new, self.whole[self.owner[at]] + (_VALUES[new] - _VALUES[self.symbol[at]]) * self.steps[self.place[at]]


# ---- filters ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Shard:
    """The filter of one length: `parts` slices of `blocks` blocks of 128 bits."""

    parts: int
    blocks: int


def plan_shards(sizes: dict[int, int], s: SpellingSettings) -> dict[int, Shard]:
    out = {}
    for length, n in sizes.items():
        blocks = max(1, -(-n * s.bits_per_word // 128))
        parts = -(-blocks * 16 // s.slice_bytes)
        out[length] = Shard(parts, -(-blocks // parts))
    return out


def plan_passes(shards: dict[int, Shard], s: SpellingSettings) -> list[list[tuple[int, int]]]:
    """Slices (length, part) dealt to passes of at most `filter_bytes` (one slice at least), lengths in order."""
    passes: list[list[tuple[int, int]]] = []
    room = 0
    for length in sorted(shards):
        for part in range(shards[length].parts):
            need = 16 * shards[length].blocks
            if not passes or need > room:
                passes.append([])
                room = s.filter_bytes
            passes[-1].append((length, part))
            room -= need
    return passes


def _keys(hashes: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return mix(hashes ^ mix(np.atleast_1d(length).astype(np.uint64)))


def _block(key: np.ndarray, shard: Shard) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(shard.parts * shard.blocks)) >> np.uint64(32)).astype(np.int64)


def _masks(bits: np.ndarray) -> np.ndarray:
    """Four of 64 bits, from the low 24 bits of a hash."""
    out = np.zeros(len(bits), np.uint64)
    for k in (0, 6, 12, 18):
        out |= np.uint64(1) << ((bits >> np.uint64(k)) & np.uint64(63))
    return out


class Filter:
    """Slices of blocked Bloom filters by length; a block is two words of 64 bits, the second one looked at only
    where the first one fits."""

    def __init__(self, shards: dict[int, Shard], slices: dict[tuple[int, int], bytes], longest: int):
        self.shards, self.longest, self.data = shards, longest, {}
        for length in {length for length, _ in slices}:
            parts = sorted(p for g, p in slices if g == length)
            joined = b"".join(slices[length, p] for p in parts)
            self.data[length] = (parts[0] * shards[length].blocks, np.frombuffer(joined, np.uint64).reshape(-1, 2))

    def test(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Which hashes of words of a length may be in the slices held here (numbers)."""
        group = min(length, self.longest)
        if group not in self.data:
            return np.zeros(0, np.int64)
        low, table = self.data[group]
        key = _keys(hashes, length)
        block = _block(key, self.shards[group]) - low
        at = np.flatnonzero((block >= 0) & (block < len(table)))
        mask = _masks(key[at])
        at = at[table[block[at], 0] & mask == mask]
        mask = _masks(mix(key[at]))
        return at[table[block[at], 1] & mask == mask]


def filter_slices(words: DataFrame, shards: dict[int, Shard], s: SpellingSettings) -> DataFrame:
    """shard, part, bits: every slice is built by one task from its own words."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column("word"))
            group = np.minimum(w.length, s.longest)
            key = _keys(w.whole, w.length)
            block = np.zeros(len(key), np.int64)
            part = np.zeros(len(key), np.int64)
            for g in np.unique(group):
                here = group == g
                block[here] = _block(key[here], shards[int(g)])
                part[here], block[here] = np.divmod(block[here], shards[int(g)].blocks)
            columns = [group.astype(np.int32), part.astype(np.int32), block, _masks(key).view(np.int64), _masks(mix(key)).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "part", "block", "low", "high"])

    def build(group: pa.Table) -> pa.Table:
        shard, part = group["shard"][0].as_py(), group["part"][0].as_py()
        bits = np.zeros((shards[shard].blocks, 2), np.uint64)
        block = group["block"].to_numpy()
        for k, name in enumerate(("low", "high")):
            np.bitwise_or.at(bits[:, k], block, group[name].to_numpy().view(np.uint64))
        return pa.table({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})

    placed = words.select("word").mapInArrow(place, "shard int, part int, block long, low long, high long")
    return placed.groupBy("shard", "part").applyInArrow(build, "shard int, part int, bits binary")


# ---- neighbours ---------------------------------------------------------------------------------------------


def probe(words: pa.Array, counts: pa.Array, held: Filter, s: SpellingSettings) -> pa.RecordBatch:
    """word, n, near: the edits of the words that the filter lets through."""
    w = Words(words)
    owners, found = [], []

    def take(at: np.ndarray, hashes: np.ndarray, length: np.ndarray, new: np.ndarray | None) -> None:
        for size in np.unique(length):
            here = np.flatnonzero(length == size)
            for i in here[held.test(hashes[here], int(size))].tolist():
                word, place = w.words[w.owner[at[i]]], int(w.place[at[i]])
                owners.append(int(w.owner[at[i]]))
                found.append(word[:place] + ("" if new is None else chr(SYMBOLS[new[i]])) + word[place + 1 :])

    at, hashes = w.deletions()
    take(at, hashes, w.length[w.owner[at]] - 1, None)
    step = max(1, s.probes // len(SYMBOLS))
    for a in range(0, len(w.symbol), step):
        at, new, hashes = w.replacements(a, min(a + step, len(w.symbol)))
        take(at, hashes, w.length[w.owner[at]], new)
    source = pa.array(owners, pa.int64())
    return pa.RecordBatch.from_arrays([words.take(source), counts.take(source), pa.array(found, pa.string())], names=["word", "n", "near"])


def near_pairs(words: DataFrame, s: SpellingSettings, keep: Scratch) -> DataFrame:
    """word, n, near, near_n of every pair of words one edit apart, each pair once."""
    sizes = {r["shard"]: r["n"] for r in words.groupBy(F.least("length", F.lit(s.longest)).alias("shard")).agg(F.count("*").alias("n")).collect()}
    shards = plan_shards(sizes, s)
    spark = words.sparkSession
    bits = keep(filter_slices(words, shards, s))
    schema = "word string, n long, near string"
    passes = []
    for taken in plan_passes(shards, s):
        low, high = taken[0], taken[-1]  # slices in a row
        here = bits.where((F.struct("shard", "part") >= F.struct(F.lit(low[0]), F.lit(low[1]))) & (F.struct("shard", "part") <= F.struct(F.lit(high[0]), F.lit(high[1]))))
        slices = {(r["shard"], r["part"]): bytes(r["bits"]) for r in here.toLocalIterator()}
        shared = spark.sparkContext.broadcast((shards, slices))  # at most filter_bytes

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = Filter(*shared.value, s.longest)
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    yield probe(part.column("word"), part.column("n"), held, s)

        passes.append(keep(words.select("word", "n").mapInArrow(run, schema)))
        shared.destroy()
    if not passes:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    positives = passes[0]
    for more in passes[1:]:
        positives = positives.unionAll(more)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return positives.join(known, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame, keep: Scratch) -> DataFrame:
    """word, root: forms followed to the last one by doubling. A form is at least twice as frequent as its word,
    so chains end after at most log2 of the largest count, and the rounds are the logarithm of that."""
    table = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = table.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = keep(table.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        table = step.select("word", "root")
        if step.where("_moved").limit(1).count() == 0:
            return table


def group_variants(docs: DataFrame, settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Null and empty texts have no words; a null doc_id counts as the empty text in the hash that damages runs.
    Repeated rows count each. Of equally frequent near words the smallest in code-point order is the form. Columns
    other than doc_id and text are not read. An empty table has no words.
    """
    s = settings
    words = materialise(vocabulary(docs, s))
    with Scratch(words.sparkSession) as keep:
        pairs = near_pairs(words, s, keep)
        ways = F.explode(F.array(
            F.struct("word", F.col("near"), F.col("near_n")),
            F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("way")
        best = pairs.select(ways).select("way.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
        near = words.join(best, "word", "left")
        strong = -F.col("best.minus") >= s.ratio * F.col("n")
        stated = keep(near.select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(strong, -F.col("best.minus")).alias("form_n")))
        ends = roots(stated.where("form IS NOT NULL"), keep)
        found = stated.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialise(found)

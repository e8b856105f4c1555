"""Document fingerprints by consistent weighted sampling.

A document's terms are its words (A-Z lower-cased), weighted by how often they occur. For every coordinate k and
term, two gamma(2, 1) variates r and c and a uniform b come from a hash of the term and k, so they are the same
in every document. With weight S, t = floor(ln S / r + b) and ln a = ln c - r (t - b) - r; the term with the
least a is the sample. Two documents draw the same (term, t) with a probability equal to the generalised Jaccard
similarity, sum of minima over sum of maxima, of their weights. The value a identifies the sample; the
fingerprint keeps 16 bits of it per coordinate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import Texts, cuts, mix, partitions_for, text_volume
from terralex.llm.packing import pack, unpack
from terralex.session import materialise


@dataclass(frozen=True)
class Sampling:
    coordinates: int = 128
    partition_bytes: int = 64 << 20  # of text


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma(2, 1) law at the midpoints of n equal cells, by Newton steps on its distribution
    function 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.where(p < 0.3, np.sqrt(2 * p), 1 - np.log1p(-p))
    for _ in range(60):
        slope = np.maximum(x * np.exp(-x), 1e-300)
        x = np.maximum(x - np.clip(((1 - (1 + x) * np.exp(-x)) - p) / slope, -1, 1), x / 4)
    return x


class WeightedSampler:
    def __init__(self, coordinates: int):
        quantiles = _gamma_quantiles()
        self.gamma, self.log_gamma = quantiles.astype(np.float32), np.log(quantiles).astype(np.float32)
        seeds = mix(np.arange(2 * coordinates, dtype=np.uint64) + np.uint64(1000))
        self.flip, self.times = seeds[:coordinates], seeds[coordinates:] | np.uint64(1)
        self.coordinates = coordinates

    def least(self, terms: np.ndarray, log_weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """ln a of the sample, per run of terms (beginning at `starts`) and coordinate."""
        h = (terms[:, None] ^ self.flip) * self.times
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9FB21C651E98DF25)
        fields = h.view(np.uint16).reshape(*h.shape, 4)
        r, b = self.gamma[fields[..., 3]], fields[..., 1] * np.float32(1 / 65536)
        t = np.floor(log_weights[:, None] / r + b)
        return np.minimum.reduceat(self.log_gamma[fields[..., 2]] - r * (t - b + 1), starts, axis=0)

    def fingerprints(self, texts: pa.Array) -> np.ndarray:
        """text x coordinate, 16 bits each; 0 throughout for a text without words."""
        out = np.zeros((len(texts), self.coordinates), np.uint16)
        for start, count in cuts(texts):
            t = Texts(texts.slice(start, count), lower=True)
            starts, ends, before = t.words()
            words = t.hashes(starts, ends)
            terms, weights, owners, waiting = [], [], [], 0
            for i in range(count):
                if before[i] < before[i + 1]:
                    found, n = np.unique(words[before[i] : before[i + 1]], return_counts=True)
                    terms.append(found), weights.append(np.log(n).astype(np.float32)), owners.append(start + i)
                    waiting += len(found)
                if waiting > 2048 or i == count - 1:
                    if owners:
                        out[owners] = self._sample(terms, weights)
                    terms, weights, owners, waiting = [], [], [], 0
        return out

    def _sample(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        if len(terms) == 1 and len(terms[0]) > 4096:  # one long text, in pieces
            pieces = range(0, len(terms[0]), 4096)
            least = np.min([self.least(terms[0][p : p + 4096], weights[0][p : p + 4096], np.array([0])) for p in pieces], axis=0)
        else:
            sizes = np.array([len(x) for x in terms])
            least = self.least(np.concatenate(terms), np.concatenate(weights), np.cumsum(sizes) - sizes)
        return (mix(least.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_NAMES = ["kind", "part", "doc_id", "n_chars", "edited_sha256", "print", "edited_print", "near_edited", "near_next", "packed"]
_TYPES = [pa.int32(), pa.int32(), None, pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]
_DONE, _LAST, _FIRST = 0, 1, 2


def _rows(kind: int, part: int, ids: pa.Array, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray, sampler: WeightedSampler) -> pa.RecordBatch:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    other = sampler.fingerprints(pa.array(changed, pa.large_string()))
    n = len(texts)
    arrays = [
        pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), ids, pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array([p.tobytes() for p in prints], pa.binary()),
        pa.array([p.tobytes() for p in other], pa.binary()), pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints)), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def _edge(kind: int, part: int, ids: pa.Array, text: str, print_: np.ndarray) -> pa.RecordBatch:
    values = [kind, part, None, len(text), None, print_.tobytes(), None, None, None, pack(text.encode())]
    arrays = [ids if name == "doc_id" else pa.array([v], t) for name, v, t in zip(_NAMES, values, _TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_NAMES)


def fingerprint_documents(docs: DataFrame, options: Sampling = Sampling()) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal),
    near_edited, near_next.

    Documents stand in ascending order of doc_id (null first; rows of one id by content); after the last comes
    the first. Null text counts as empty; texts without words are alike. Repeated rows follow each other. The
    documents are range-partitioned once; only the first and the last document of a partition are looked at
    again, to pass its neighbour's text over the boundary.
    """
    size, _ = text_volume(docs)
    n = partitions_for(docs.sparkSession, size, options.partition_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    inner = docs.select("doc_id", F.xxhash64("text").alias("content"), F.col("text").cast("string").alias("text"))
    packed = inner.mapInArrow(_pack_texts, f"doc_id {kind}, content long, packed binary")
    ordered = packed.repartitionByRange(n, "doc_id", "content").sortWithinPartitions("doc_id", "content")
    schema = f"kind int, part int, doc_id {kind}, n_chars long, edited_sha256 string, print binary, edited_print binary, near_edited double, near_next double, packed binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part, held = WeightedSampler(options.coordinates), TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                texts = [unpack(x).decode() for x in rows.column("packed").to_pylist()]
                ids, prints = rows.column("doc_id"), sampler.fingerprints(pa.array(texts, pa.large_string()))
                if held is None:
                    yield _edge(_FIRST, part, ids.slice(0, 1), texts[0], prints[0])
                else:
                    ids, texts, prints = pa.concat_arrays([held[0], ids]), [held[1], *texts], np.vstack([held[2][None], prints])
                if len(texts) > 1:
                    yield _rows(_DONE, part, ids.slice(0, len(texts) - 1), texts[:-1], texts[1:], prints[:-1], prints[1:], sampler)
                held = ids.slice(len(texts) - 1), texts[-1], prints[-1]
        if held is not None:
            yield _edge(_LAST, part, *held)

    found = materialise(ordered.mapInArrow(run, schema))
    first = found.where(F.col("kind") == _FIRST)
    # One narrow row per partition; the texts are joined by partition number afterwards.
    by_part = Window.orderBy("part")
    everything = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = first.select("part", F.coalesce(F.lead("part").over(by_part), F.min("part").over(everything)).alias("next_part"))
    ahead = first.select(F.col("part").alias("next_part"), F.col("packed").alias("next_packed"), F.col("print").alias("next_print"))
    last = found.where(F.col("kind") == _LAST).join(follow, "part").join(ahead, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = WeightedSampler(options.coordinates)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                text, following = (unpack(row.column(c)[0].as_py()).decode() for c in ("packed", "next_packed"))
                own, other = (np.frombuffer(row.column(c)[0].as_py(), np.uint16)[None] for c in ("print", "next_print"))
                yield _rows(_DONE, row.column("part")[0].as_py(), row.column("doc_id"), [text], [following], own, other, sampler)

    closed = last.select("part", "doc_id", "packed", "print", "next_packed", "next_print").mapInArrow(close, schema)
    return found.where(F.col("kind") == _DONE).unionAll(closed).select(
        "doc_id", "n_chars", "edited_sha256", F.lower(F.hex("print")).alias("fingerprint"), F.lower(F.hex("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")


def _pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(packed, pa.binary())], names=["doc_id", "content", "packed"])

"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector, made from its hash. Its word vector is the sum of the index vectors of
the words around all its occurrences in the whole corpus, each turned by its distance, so words used alike have like
vectors. Words share a fixed number of rows by hash, which bounds the table whatever the corpus. A document is the
weighted mean of its words' vectors, the mean of their squares, how alike words near each other are, and its length; a
two-layer network, fitted on a
bounded sample of labelled documents, turns that into a logit, and a temperature fitted on labelled documents that the
network has not seen turns the logit into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import Texts, cuts, fold_of, hash_sample, mix, per_text
from terralex.llm.packing import pack, unpack


@dataclass(frozen=True)
class QualitySettings:
    log_rows: int = 16  # rows of the table of word vectors, as a power of two
    dimensions: int = 48
    nonzeros: int = 4  # entries of an index vector, half of them -1
    window: int = 2  # words on either side
    block_rows: int = 1024  # rows of the table that are added up together
    smoothing: float = 1e-3  # words more frequent than this count for less in the mean
    #: The network and its temperature are fitted on at most so many labelled documents of either label.
    sample_rows: int = 4000
    calibration_share: float = 0.25
    hidden: int = 32
    steps: int = 300
    rate: float = 0.02
    l2: float = 1e-4
    seed: int = 12
    threshold: float = 0.7
    folds: int = 4
    held_out_fold: int = 2


# ---- words ------------------------------------------------------------------------------------------------

_KIND = np.full(256, 2, np.int8)  # marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0  # white space
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1  # letters and digits


def token_rows(t: Texts, s: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """The table row of every word, and per text the number of words before it. A word is a run of letters and
    digits, or a run of marks, as written."""
    kind = _KIND[t.data]
    change = np.zeros(len(t.data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[t.offsets] = True
    edges = np.flatnonzero(change)
    if len(edges) < 2:
        return np.zeros(0, np.int64), np.zeros(t.count + 1, np.int64)
    starts, ends = edges[:-1], edges[1:]
    solid = kind[starts] != 0
    starts, ends = starts[solid], ends[solid]
    t.rolling(1)  # the running sums that hashes are read from
    rows = (t.hashes(starts, ends) >> np.uint64(64 - s.log_rows)).astype(np.int64)
    return rows, np.searchsorted(starts, t.offsets)


def index_vectors(s: QualitySettings) -> np.ndarray:
    """Row x dimension: `nonzeros` entries of +1 and -1 in turn, at places made from the row's number. Entries at
    one place add up."""
    rows = np.arange(1 << s.log_rows, dtype=np.uint64)
    out = np.zeros((len(rows), s.dimensions), np.int16)
    for k in range(s.nonzeros):
        place = (mix(rows * np.uint64(s.nonzeros) + np.uint64(k)) >> np.uint64(32)) % np.uint64(s.dimensions)
        np.add.at(out, (np.arange(len(rows)), place.astype(np.int64)), 1 if k % 2 == 0 else -1)
    return out


def context_sums(rows: np.ndarray, before: np.ndarray, index: np.ndarray, s: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """(rows that occur, their summed contexts with the number of occurrences as a last column)."""
    near = np.zeros((len(rows), s.dimensions + 1), np.int32)
    near[:, -1] = 1
    owner = per_text(before)
    for k in range(1, s.window + 1):
        if len(rows) <= k:
            break
        same = (owner[k:] == owner[:-k])[:, None]
        near[:-k, :-1] += np.where(same, np.roll(index, k, axis=1)[rows[k:]], 0)
        near[k:, :-1] += np.where(same, np.roll(index, -k, axis=1)[rows[:-k]], 0)
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(rows) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(near[order], first, axis=0) if len(rows) else near


def _add_blocks(batches: Iterator[pa.RecordBatch], s: QualitySettings) -> Iterator[pa.RecordBatch]:
    """Blocks of the table added up as they arrive: what a task holds is at most the table."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            part = np.frombuffer(unpack(data), np.int64).reshape(-1, s.dimensions + 1)
            if block in sums:
                sums[block] += part
            else:
                sums[block] = part.copy()
    for block, total in sums.items():
        yield _block_row(block, total)


def _block_row(block: int, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([pack(np.ascontiguousarray(sums, np.int64).tobytes())], pa.binary())], names=["block", "sums"])


def context_table(docs: DataFrame, s: QualitySettings) -> np.ndarray:
    """Row x (dimension + 1): summed contexts and occurrences of all words of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors(s)
        sums = np.zeros((1 << s.log_rows, s.dimensions + 1), np.int64)
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                found, added = context_sums(*token_rows(Texts(batch.column("text").slice(start, count)), s), index, s)
                sums[found] += added
        for block in range(-(-len(sums) // s.block_rows)):
            part = sums[block * s.block_rows : (block + 1) * s.block_rows]
            if part[:, -1].any():
                yield _block_row(block, part)

    schema = "block int, sums binary"
    blocks = -(-(1 << s.log_rows) // s.block_rows)
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    # Every task's blocks meet by number; salted first, so that many tasks' blocks are added up in many places.
    for salt in (16, 1):
        dealt = parts.repartition(min(blocks * salt, 4 * docs.sparkSession.sparkContext.defaultParallelism), "block", *([F.spark_partition_id() % salt] if salt > 1 else []))
        parts = dealt.mapInArrow(lambda batches: _add_blocks(batches, s), schema)
    table = np.zeros((1 << s.log_rows, s.dimensions + 1), np.int64)
    for row in parts.collect():  # the table itself: its size is fixed by the settings
        part = np.frombuffer(unpack(bytes(row["sums"])), np.int64).reshape(-1, s.dimensions + 1)
        table[row["block"] * s.block_rows : row["block"] * s.block_rows + len(part)] = part
    return table


@dataclass(frozen=True)
class WordVectors:
    vectors: np.ndarray  # row x dimension, float32
    weights: np.ndarray  # of a word in the mean
    settings: QualitySettings


def word_vectors(table: np.ndarray, s: QualitySettings) -> WordVectors:
    """Contexts damped by square roots, freed of what all words share, and of length one."""
    n = table[:, -1].astype(float)
    total = max(n.sum(), 1.0)
    damped = np.sign(table[:, :-1]) * np.sqrt(np.abs(table[:, :-1].astype(float)))
    damped /= np.maximum(np.linalg.norm(damped, axis=1, keepdims=True), 1e-12)
    centred = np.where(n[:, None] > 0, damped - (n @ damped) / total, 0.0)
    centred /= np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-12)
    return WordVectors(centred.astype(np.float32), (s.smoothing / (s.smoothing + n / total)).astype(np.float32), s)


def pooled(texts: pa.Array, words: WordVectors, step: int = 1 << 16) -> np.ndarray:
    """Text x feature: weighted mean of word vectors, root of the mean of their squares, mean likeness of words 1 to
    `window` apart, log of 1 + words. All zero without a word. Vectors of `step` words are held at once."""
    s = words.settings
    d = s.dimensions
    t = Texts(texts)
    rows, before = token_rows(t, s)
    owner = per_text(before)
    sums = np.zeros((t.count, 2 * d + s.window))
    mass = np.zeros((t.count, 2))
    for a in range(0, len(rows), step):
        b = min(a + step, len(rows))
        own, ahead = owner[a:b], min(b + s.window, len(rows))
        v = words.vectors[rows[a:ahead]]
        weight = words.weights[rows[a:b]]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        texts_here = own[first]
        heavy = v[: b - a] * weight[:, None]
        sums[texts_here, :d] += np.add.reduceat(heavy, first, axis=0)
        sums[texts_here, d : 2 * d] += np.add.reduceat(heavy * heavy, first, axis=0)
        mass[texts_here] += np.add.reduceat(np.stack([weight, weight * weight], axis=1), first, axis=0)
        for k in range(1, s.window + 1):
            n = min(b, len(rows) - k) - a
            if n > 0:
                alike = np.einsum("nd,nd->n", v[:n], v[k : n + k]) * (own[:n] == owner[a + k : a + k + n])
                sums[:, 2 * d + k - 1] += np.bincount(own[:n], alike, t.count)
    count = np.diff(before)
    out = np.zeros((t.count, 2 * d + s.window + 1), np.float32)
    some = count > 0
    out[some, :d] = sums[some, :d] / mass[some, :1]
    out[some, d : 2 * d] = np.sqrt(sums[some, d : 2 * d] / mass[some, 1:])
    for k in range(1, s.window + 1):
        out[:, 2 * d + k - 1] = sums[:, 2 * d + k - 1] / np.maximum(count - k, 1)
    out[:, -1] = np.log1p(count)
    return out


# ---- network ----------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray  # feature x hidden
    first_bias: np.ndarray
    second: np.ndarray  # hidden
    second_bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.first + self.first_bias) @ self.second + self.second_bias


def loss_and_gradient(parameters: list[np.ndarray], z: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float) -> tuple[float, list[np.ndarray]]:
    """Weighted logistic loss of the two layers with an L2 penalty on their weights, and its gradient."""
    a, a0, b, b0 = parameters
    h = np.tanh(z @ a + a0)
    logit = h @ b + b0[0]
    loss = float(weight @ (np.logaddexp(0, logit) - y * logit)) + 0.5 * l2 * float((a * a).sum() + (b * b).sum())
    d = weight * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y)
    dh = d[:, None] * b * (1 - h * h)
    return loss, [z.T @ dh + l2 * a, dh.sum(axis=0), h.T @ d + l2 * b, np.array([d.sum()])]


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, s: QualitySettings) -> Network:
    """Adam on all rows at once, from a fixed seed."""
    rng = np.random.default_rng(s.seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    parameters = [rng.normal(size=(x.shape[1], s.hidden)) / np.sqrt(x.shape[1]), np.zeros(s.hidden), rng.normal(size=s.hidden) / np.sqrt(s.hidden), np.zeros(1)]
    first, second = ([np.zeros_like(p) for p in parameters] for _ in range(2))
    for step in range(1, s.steps + 1):
        _, gradient = loss_and_gradient(parameters, z, y, weight / weight.sum(), s.l2)
        for p, g, m, v in zip(parameters, gradient, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= s.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(mean, scale, *parameters[:3], float(parameters[3][0]))


def fit_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature of the smallest weighted logistic loss, searched on a fine grid of logarithms."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(20), 400))
    losses = [weight @ (np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(losses))])


@dataclass(frozen=True)
class QualityModel:
    words: WordVectors
    network: Network | None
    temperature: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.network.logits(pooled(texts, self.words).astype(float)) / self.temperature, -40, 40)))


def labelled_sample(docs: DataFrame, labels: DataFrame, s: QualitySettings) -> tuple[DataFrame | None, dict[int, int]]:
    """doc_id, y of at most `sample_rows` labelled ids of either label that have a document, outside the held-out
    fold, and how many ids there are in all. Labels of one id are combined: it is good if no label says otherwise."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    marks = marks.where(fold_of(F.col("doc_id"), s.folds) != s.held_out_fold)
    marks = marks.join(docs.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")  # ids only
    sizes = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [hash_sample(marks.where(F.col("y") == y).withColumn("text", F.lit("")), s.sample_rows, n).select("doc_id", "y") for y, n in sorted(sizes.items())]
    if not picked:
        return None, sizes
    return picked[0] if len(picked) == 1 else picked[0].unionAll(picked[1]), sizes


def fit(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> QualityModel:
    """Word vectors from all documents; network and temperature from the labelled sample, whose rows weigh what
    their label weighs among all labelled documents. Without any label every score is one half."""
    s = settings
    words = word_vectors(context_table(docs, s), s)
    chosen, sizes = labelled_sample(docs, labels, s)
    if chosen is None:
        return QualityModel(words, None, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(words)  # its size is fixed by the settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                x = [v.tobytes() for v in pooled(part.column("text"), shared.value)]
                yield pa.RecordBatch.from_arrays([part.column("y"), part.column("h"), pa.array(x, pa.binary())], names=["y", "h", "x"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 x sample_rows ids
    made = texts.select("text", "y", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).mapInArrow(run, "y int, h long, x binary")
    # Equal texts count once; features, not texts, come to the driver: a few hundred bytes a row.
    rows = made.groupBy("h", "x").agg(F.min("y").alias("y")).orderBy("h", "x").limit(2 * s.sample_rows).collect()
    if not rows:
        return QualityModel(words, None, 1.0)
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), -1).astype(float)
    y = np.array([r["y"] for r in rows], float)
    share = {k: sizes[k] / max((y == k).sum(), 1) for k in sizes}
    weight = np.array([share[int(k)] for k in y])
    held = mix(np.array([r["h"] for r in rows], np.int64).view(np.uint64)) % np.uint64(1000) < np.uint64(1000 * s.calibration_share)
    if held.all() or len(rows) < 20:
        held[:] = False
    network = fit_network(x[~held], y[~held], weight[~held], s)
    return QualityModel(words, network, fit_temperature(network.logits(x[held]), y[held], weight[held]))


def predict(docs: DataFrame, model: QualityModel) -> DataFrame:
    """held_out, score and predicted of every row, with doc_id.

    Null and empty texts get the score of a text without words. Repeated rows are scored each. No column but `text`
    is an input of a score; other columns are not read. An empty table gives an empty result.
    """
    s = model.words.settings
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                score = shared.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= s.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    inner = docs.select("doc_id", (fold_of(F.col("doc_id"), s.folds) == s.held_out_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([*inner.drop("text").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return inner.mapInArrow(run, schema)

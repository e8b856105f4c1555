"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, its confidences calibrated by a temperature."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralex.llm.common import cuts, fold_of, mix

_PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """A letter of any script; numbers that are no digits, such as fractions, are none."""
    return _PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageSettings:
    orders: tuple[int, ...] = (1, 2, 3)
    log_features: int = 17
    #: The classifier is fitted on so many labelled documents, shared out evenly among all languages of the training
    #: rows, but on `language_rows` of each language at least; of each those with the smallest id hashes. The document
    #: frequencies behind the IDF weights, and the languages' shares, come from every training document.
    sample_rows: int = 3000
    language_rows: int = 200
    calibration_share: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    scale: float = 20.0
    folds: int = 4
    held_out_fold: int = 2


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # feature x language, IDF and temperature folded in
    bias: np.ndarray
    settings: LanguageSettings


def ngram_features(texts: list[str], settings: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature of every character n-gram of every text (lower case), text by text, and per text the
    number of n-grams before it. N-grams do not cross texts."""
    lowered = [t.lower() for t in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    shift = np.uint64(64 - settings.log_features)
    parts, inside = [], []
    rolled = np.zeros(len(points), np.uint64)
    for n in range(1, max(settings.orders) + 1):
        rolled[: max(len(points) - n + 1, 0)] += points[n - 1 :] * mix(np.array([n], np.uint64))[0]
        if n in settings.orders:
            at = np.arange(len(points))
            inside.append(at + n <= ends)
            parts.append((mix(rolled + np.uint64(n)) >> shift).astype(np.int32))
    kept = np.stack(inside, axis=1) if inside else np.zeros((0, 0), bool)
    features = np.stack(parts, axis=1)[kept]
    counts = np.zeros(len(points) + 1, np.int64)
    np.cumsum(kept.sum(axis=1), out=counts[1:])
    return features, counts[np.concatenate([[0], np.cumsum(lengths)])]


def document_frequencies(docs: DataFrame, settings: LanguageSettings) -> tuple[np.ndarray, int]:
    """(documents per feature, documents), over all rows of `docs`. Each task adds up its own documents; one row
    per feature and task is shuffled, and 2^log_features numbers, fixed by the parameter, reach the driver."""
    size = 1 << settings.log_features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, seen = np.zeros(size, np.int64), 0, np.zeros(size, np.int64)
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                features, before = ngram_features([t or "" for t in batch.column("text").slice(start, count).to_pylist()], settings)
                for a, b in zip(before[:-1], before[1:], strict=True):
                    part = features[a:b]
                    order = np.arange(len(part))
                    seen[part] = order  # the last occurrence of each feature stays
                    found[part[seen[part] == order]] += 1
                rows += count
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(found[used], rows))], names=["feature", "n"])

    summed = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    at, n = summed.column("feature").to_numpy(), summed.column("n").to_numpy()
    out = np.zeros(size, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _vectors(texts: list[str], idf: np.ndarray, settings: LanguageSettings) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        features, _ = ngram_features([text], settings)
        used, counts = np.unique(features, return_counts=True)
        out.append((used, settings.scale * counts / max(len(features), 1) * idf[used]))
    return out


def _spread() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))


def language_sizes(train: DataFrame) -> dict[str, tuple[int, int]]:
    """language -> (documents, smallest id hash)."""
    return {r["lang"]: (r["n"], r["least"]) for r in train.groupBy("lang").agg(F.count("*").alias("n"), F.min(_spread()).alias("least")).collect()}


def language_sample(train: DataFrame, sizes: dict[str, tuple[int, int]], rows: int) -> list[dict]:
    """At most `rows` documents (spread, text, lang) of every language, those with the smallest id hashes, and one at
    least. A hash bound per language, with room to spare, goes first: where ids differ, no task ranks more than about
    twice a language's share."""
    bounds = [(lang, max(least + 1, min(1 << 32, (1 << 32) * (2 * rows + 100) // n))) for lang, (n, least) in sizes.items()]
    bounds = train.sparkSession.createDataFrame(bounds, "lang string, bound long")
    near = train.select("text", "lang", _spread().alias("spread"), F.xxhash64("text").alias("content")).join(F.broadcast(bounds), "lang").where("spread < bound")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spread", "content"))
    found = near.withColumn("place", place).where(F.col("place") <= rows).select("spread", "content", "lang", "text").toArrow().to_pylist()
    return sorted(found, key=lambda r: (r["spread"], r["content"], r["lang"]))


def _calibration_rows(labels: np.ndarray, share: float) -> np.ndarray:
    """Whether a row is held out for the temperature: the first `share` of each language, rounded down."""
    held = np.zeros(len(labels), bool)
    for label in np.unique(labels):
        at = np.flatnonzero(labels == label)
        held[at[: int(len(at) * share)]] = True
    return held


def fit(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Learn from text and non-null lang of the documents outside the held-out fold: every language that stands
    there. It is fitted as if all sampled rows were typical; the bias then moves from the sample's shares of the
    languages to those of all training rows, and calibration rows count by these."""
    train = docs.where((fold_of(F.col("doc_id"), settings.folds) != settings.held_out_fold) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found, total = document_frequencies(train, settings)
    idf = np.log((1 + total) / (1 + found)) + 1
    sizes = language_sizes(train)
    languages = sorted(sizes)
    size, k = 1 << settings.log_features, len(languages)
    if k == 0:
        return LanguageModel([], np.zeros((size, 0), np.float32), np.zeros(0), settings)
    picked = language_sample(train, sizes, max(settings.sample_rows // k, settings.language_rows))
    number = {lang: i for i, lang in enumerate(languages)}
    vectors, labels = _vectors([r["text"] for r in picked], idf, settings), np.array([number[r["lang"]] for r in picked], int)
    held = _calibration_rows(labels, settings.calibration_share)
    used = np.flatnonzero(~held)
    weights, bias = _follow_the_regularised_leader([vectors[i] for i in used], labels[used].tolist(), size, k, settings)
    logits = np.array([x @ weights[f] + bias for f, x in (vectors[i] for i in np.flatnonzero(held))]).reshape(-1, k)
    share = np.array([sizes[lang][0] for lang in languages]) / total
    prior = np.log(share) - np.log(np.bincount(labels[used], minlength=k) / len(used))
    counts = np.bincount(labels[held], minlength=k)
    temperature = _temperature(logits, labels[held], prior, share[labels[held]] / counts[labels[held]])
    scaled = (weights * idf[:, None] * settings.scale / temperature).astype(np.float32)
    return LanguageModel(languages, scaled, bias / temperature + prior, settings)


def _follow_the_regularised_leader(vectors, labels, size: int, k: int, s: LanguageSettings) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal with L1 and L2 penalties; the last row is the bias."""
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def current(rows):
        shrunk = np.sign(z[rows]) * np.maximum(np.abs(z[rows]) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[rows])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for (features, x), label in zip(vectors, labels, strict=True):
            rows, x = np.append(features, size), np.append(x, 1.0)
            w = current(rows)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / s.alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = current(slice(None))
    return w[:size], w[size]


def _temperature(logits: np.ndarray, labels: np.ndarray, prior: np.ndarray, counts: np.ndarray) -> float:
    """The temperature with the smallest negative log-likelihood on the calibration rows, counted `counts` times."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    losses = [-counts @ np.log(np.maximum(_softmax(logits / t + prior)[np.arange(len(labels)), labels], 1e-12)) for t in grid]
    return float(grid[int(np.argmin(losses))])


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. Null text, or one without a letter: `und`, score 0.
    If there was nothing to learn from, every prediction is `und`. Other columns of `docs` are not read."""
    s = model.settings
    held = fold_of(F.col("doc_id"), s.folds) == s.held_out_fold
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^log_features x languages of the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, "und"], object)
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                texts = [t or "" for t in part.column("text").to_pylist()]
                lettered = np.array([has_letter(t) for t in texts], bool)
                best, score = np.full(count, len(m.languages)), np.zeros(count)
                if m.languages and lettered.any():
                    features, before = ngram_features(texts, s)
                    n = np.diff(before)
                    full = np.flatnonzero(n)
                    logits = np.zeros((count, len(m.languages)))
                    logits[full] = np.add.reduceat(m.weights[features], before[:-1][full], axis=0) / n[full, None]
                    p = _softmax(logits + m.bias)
                    best = np.where(lettered, p.argmax(axis=1), best)
                    score = np.where(lettered, p.max(axis=1), score)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    inner = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    return inner.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")

"""Toxic spans by a linear-chain conditional random field.

Tokens are words; the two states are clean and toxic. Labels exist for documents only, so the field is fitted to what
they say of its states: in a clean document all tokens are clean, in a toxic one at least one is not. Its features
are words and their beginnings that stand in a few toxic documents of the sample and more often there than in clean
ones; a penalty, not a threshold, weighs those that are there by chance. Forward-backward marginals of every whole
text then give the spans and, through a logistic curve fitted on documents left out of the field's fit, the
document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import Texts, cuts, fold_of, hash_sample, mix
from terralex.session import Scratch


@dataclass(frozen=True)
class ToxicSettings:
    #: The field and its curve are fitted on at most so many labelled documents of either label.
    sample_rows: int = 3000
    prefixes: tuple[int, ...] = (3, 4, 5, 6, 8)  # bytes of a word's beginning, lower case; and the whole word
    support: int = 3  # toxic documents of the sample, copies left out, that a feature stands in,
    lift: float = 2.0  # and how much more frequent it is in them than in clean ones (counts half a document more)
    plain_run: int = 8  # tokens without a feature in a row that count while fitting; inference takes all
    segment: int = 256  # tokens per chain while fitting; inference runs over whole texts
    chains_at_once: int = 1024
    steps: int = 100
    rate: float = 0.1
    penalty: float = 0.05  # of half the squared weights, against the log likelihood of all documents
    calibration_share: float = 0.2
    span_probability: float = 0.5
    threshold: float = 0.3
    folds: int = 4
    held_out_fold: int = 2


@dataclass(frozen=True)
class ToxicModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float
    transitions: np.ndarray  # log potentials, previous state x next state
    curve: np.ndarray  # intercept, weight of log(1 + expected toxic tokens), weight of the largest marginal
    settings: ToxicSettings


# ---- tokens and features ----------------------------------------------------------------------------------


def token_features(t: Texts, starts: np.ndarray, ends: np.ndarray, settings: ToxicSettings) -> np.ndarray:
    """Hashes, token x feature: the beginnings that a word is long enough for (0 otherwise) and the word."""
    columns = [mix(t.hashes(starts, ends) + np.uint64(1))]
    for k in settings.prefixes:
        cut = np.minimum(starts + k, ends)
        columns.append(np.where(ends - starts >= k, t.hashes(starts, cut), np.uint64(0)))
    return np.stack(columns, axis=1)


def _lookup(sorted_hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value, -1 if it is not there."""
    if not len(sorted_hashes):
        return np.full(values.shape, -1)
    at = np.minimum(np.searchsorted(sorted_hashes, values), len(sorted_hashes) - 1)
    return np.where(sorted_hashes[at] == values, at, -1)


class FeatureTable:
    """Sums of weights of the known features among many hashes: a bit table answers most lookups."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bits: int = 20):
        self.features, self.weights, self.shift = features, weights, np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[features >> self.shift] = True

    def emissions(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens with a known feature, their summed weights)."""
        rows, columns = np.nonzero(self.maybe[hashes >> self.shift])
        at = _lookup(self.features, hashes[rows, columns])
        rows, at = rows[at >= 0], at[at >= 0]
        tokens, inverse = np.unique(rows, return_inverse=True)
        return tokens, np.bincount(inverse, self.weights[at], len(tokens))


# ---- fitting ----------------------------------------------------------------------------------------------


def _smallest(values: np.ndarray, number: int) -> list[int]:
    """The smallest hash of a document's word triples under each of four orders."""
    return [int(mix(values ^ np.uint64(k + 1)).min()) for k in range(4)] if len(values) else [number] * 4


def _without_copies(smallest: list[list[int]]) -> np.ndarray:
    """Which documents to keep so that near copies do not count as independent evidence: a document goes if it
    shares a smallest hash with an earlier one."""
    seen: list[set] = [set() for _ in range(4)]
    kept = []
    for i, least in enumerate(smallest):
        if not any(v in s for v, s in zip(least, seen, strict=True)):
            kept.append(i)
        for v, s in zip(least, seen, strict=True):
            s.add(v)
    return np.array(kept, int)


def _triples(words: np.ndarray) -> np.ndarray:
    return words[:-2] + mix(words[1:-1] + mix(words[2:])) if len(words) > 2 else words


def _messages(potentials: np.ndarray, moves: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward vectors (scaled) of chains side by side: chain x token x state, starting clean. Where no
    token is `here`, vectors stay as they are."""
    chains, length, _ = potentials.shape
    forward, backward = np.empty_like(potentials), np.ones_like(potentials)
    scale = np.empty((chains, length))
    state = np.tile([1.0, 0.0], (chains, 1))
    for i in range(length):
        on = here[:, i, None]
        state = np.where(on, (state @ moves) * potentials[:, i], state)
        scale[:, i] = state.sum(axis=1)
        state = state / scale[:, i, None]
        forward[:, i] = state
    for i in range(length - 2, -1, -1):
        backward[:, i] = np.where(here[:, i + 1, None], (backward[:, i + 1] * potentials[:, i + 1]) @ moves.T / scale[:, i + 1, None], 1.0)
    return forward, backward, scale


@dataclass(frozen=True)
class Sampled:
    """A document for fitting: its length, and where which known feature stands."""

    length: int
    token: np.ndarray
    feature: np.ndarray


def shortened(length: int, token: np.ndarray, most: int) -> tuple[int, np.ndarray]:
    """Length and token places after runs of more than `most` tokens without a feature are cut to that."""
    if not len(token):
        return min(length, most), token
    places, back = np.unique(token, return_inverse=True)
    gaps = np.diff(np.concatenate([[-1], places, [length]])) - 1
    short = np.minimum(gaps, most)
    new = np.cumsum(short[:-1] + 1) - 1
    return int(new[-1] + 1 + short[-1]), new[back]


def _chains(docs: list[Sampled], width: int) -> tuple[np.ndarray, ...]:
    """Documents cut into chains of `width` tokens: tokens per chain, document of each chain, and chain, place and
    feature of every known feature."""
    counts = np.array([max(-(-d.length // width), 1) for d in docs])
    first = np.cumsum(counts) - counts
    sizes = np.full(counts.sum(), width)
    sizes[first + counts - 1] = [d.length - width * (n - 1) for d, n in zip(docs, counts, strict=True)]
    rows, columns, features = (
        np.concatenate([np.zeros(0, np.int64), *x]) for x in ([f + d.token // width for f, d in zip(first, docs, strict=True)], [d.token % width for d in docs], [d.feature for d in docs]))
    return sizes, np.repeat(np.arange(len(docs)), counts), rows.astype(int), columns.astype(int), features.astype(int)


def field_gradient(parameters: np.ndarray, chains: tuple[np.ndarray, ...], toxic: np.ndarray, n_features: int, s: ToxicSettings) -> tuple[float, np.ndarray]:
    """Log likelihood of the document labels, and its gradient by weights, bias and transitions.

    With p the probability that all tokens of a document are clean, a clean document counts log p and a toxic one
    log(1 - p). Either gradient is the expected features under the field, less those of the all-clean path, times
    -1 or p / (1 - p).
    """
    sizes, owner, row, col, index = chains
    weights, bias, moves = parameters[:n_features], parameters[n_features], np.exp(parameters[n_features + 1 :].reshape(2, 2))
    starts = list(range(0, len(sizes), s.chains_at_once))
    log_clean = np.zeros(len(toxic))
    parts = []
    for a in starts:
        b = min(a + s.chains_at_once, len(sizes))
        lo, hi = np.searchsorted(row, (a, b))
        here = np.arange(max(int(sizes[a:b].max()), 1))[None] < sizes[a:b, None]
        r, c, f = row[lo:hi] - a, col[lo:hi], index[lo:hi]
        emission = np.full(here.shape, bias)
        np.add.at(emission, (r, c), weights[f])
        potentials = np.ones((*here.shape, 2))
        potentials[..., 1] = np.exp(np.clip(emission, -30, 30))
        # Behind a chain's end the state stays as it is and counts for nothing.
        forward, backward, scale = _messages(potentials, moves, here)
        marginal = np.where(here, forward[..., 1] * backward[..., 1] / (forward * backward).sum(axis=2), 0)
        previous = np.concatenate([np.tile([1.0, 0.0], (len(here), 1, 1)), forward[:, :-1]], axis=1)
        ahead = backward * potentials / scale[..., None] * here[..., None]
        pairs = np.einsum("nta,ntb->nab", previous, ahead) * moves
        pairs[:, 0, 0] -= sizes[a:b]
        log_clean += np.bincount(owner[a:b], sizes[a:b] * np.log(moves[0, 0]) - (np.log(scale) * here).sum(axis=1), len(toxic))
        parts.append((owner[a:b], marginal[r, c], r, f, marginal.sum(axis=1), pairs))
    p = np.exp(np.minimum(log_clean, -1e-9))
    factor = np.where(toxic == 1, p / (1 - p), -1.0)
    gradient = np.zeros_like(parameters)
    for own, at, r, f, hot, pairs in parts:
        k = factor[own]
        gradient[:n_features] += np.bincount(f, at * k[r], n_features)
        gradient[n_features] += k @ hot
        gradient[n_features + 1 :] += np.einsum("n,nab->ab", k, pairs).ravel()
    return float(np.where(toxic == 1, np.log1p(-p), log_clean).sum()), gradient


def _fit_field(docs: list[Sampled], toxic: np.ndarray, n_features: int, s: ToxicSettings) -> tuple[np.ndarray, float, np.ndarray]:
    """Penalised maximum likelihood by Adam, with exact gradients over all sampled documents."""
    parameters = np.concatenate([np.zeros(n_features), [-4.0], [0.0, -1.0, 0.0, 0.0]])
    if docs:
        chains = _chains(docs, s.segment)
        pull = np.zeros_like(parameters)
        pull[:n_features] = s.penalty
        first, second = np.zeros_like(parameters), np.zeros_like(parameters)
        for step in range(1, s.steps + 1):
            gradient = (field_gradient(parameters, chains, toxic, n_features, s)[1] - pull * parameters) / len(docs)
            first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
            parameters = parameters + s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    return parameters[:n_features], float(parameters[n_features]), parameters[n_features + 1 :].reshape(2, 2)


def _fit_curve(evidence: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression of the label on (1, log(1 + expected toxic tokens), largest marginal)."""
    x, w = np.column_stack([np.ones(len(evidence)), np.log1p(evidence[:, 0]), evidence[:, 1]]), np.array([-3.0, 1.0, 3.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p) + 1e-6)[:, None]).T @ x + 0.05 * np.eye(3)
        w = w + np.linalg.solve(hessian, x.T @ (weight * (toxic - p)) - 0.05 * (w - np.array([-3.0, 1.0, 3.0])))
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, s: ToxicSettings) -> tuple[DataFrame | None, dict[int, int]]:
    """doc_id, toxic of at most `sample_rows` labelled ids of either label that have a document in `docs`, outside the
    held-out fold, and how many ids there are in all. Labels of one id are combined: any toxic one counts."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.where(fold_of(F.col("doc_id"), s.folds) != s.held_out_fold)
    marks = marks.join(docs.select("doc_id").where("doc_id IS NOT NULL"), "doc_id", "left_semi")  # ids only
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [hash_sample(marks.where(F.col("toxic") == y).withColumn("text", F.lit("")), s.sample_rows, n).select("doc_id", "toxic") for y, n in sorted(sizes.items())]
    if not picked:
        return None, sizes
    return picked[0] if len(picked) == 1 else picked[0].unionAll(picked[1]), sizes


def _per_document(batches: Iterator[pa.RecordBatch], s: ToxicSettings, each) -> Iterator[pa.RecordBatch]:
    """`each(features of a document's tokens, word hashes, toxic, number)` to rows, batch by batch."""
    for batch in batches:
        for start, count in cuts(batch.column("text")):
            part = batch.slice(start, count)
            t = Texts(part.column("text"), lower=True)
            starts, ends, before = t.words()
            features, words = token_features(t, starts, ends, s), t.hashes(starts, ends)
            rows = zip(part.column("h").to_pylist(), part.column("toxic").to_pylist(), before[:-1], before[1:], strict=True)
            yield each([(h, y, features[a:b], words[a:b]) for h, y, a, b in rows])


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicSettings = ToxicSettings()) -> ToxicModel:
    """Learn from labelled documents outside the held-out fold. Without any label every score is the curve's value for
    no evidence. Texts stay in the tasks: the driver sees hashes, counts of features and the places of known ones."""
    s = settings
    chosen, sizes = labelled_sample(docs, labels, s)
    unfitted = ToxicModel(np.zeros(0, np.uint64), np.zeros(0), -5.0, np.zeros((2, 2)), np.array([-3.0, 1.0, 3.0]), s)
    if chosen is None:
        return unfitted
    with Scratch(docs.sparkSession) as keep:
        # At most 2 x sample_rows ids: small enough to broadcast, so only their texts leave the scan.
        texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
        sample = keep(texts.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")))
        return _fit_sample(sample, sizes, s)


def _fit_sample(sample: DataFrame, sizes: dict[int, int], s: ToxicSettings) -> ToxicModel:
    spark = sample.sparkSession

    def outline(rows) -> pa.RecordBatch:
        least = [_smallest(_triples(words), h) for h, _, _, words in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([[v & (2**63 - 1) for v in x] for x in least], pa.list_(pa.int64()))], names=["h", "toxic", "least"])

    outlined = sample.mapInArrow(lambda batches: _per_document(batches, s, outline), "h long, toxic int, least array<long>").orderBy("h").collect()
    kept = _without_copies([r["least"] for r in outlined])
    held_count = int(len(kept) * s.calibration_share)
    used = {outlined[i]["h"] for i in kept[held_count:]}
    held = {outlined[i]["h"] for i in kept[:held_count]}
    toxic_used = sum(outlined[i]["toxic"] for i in kept[held_count:])
    clean_used = len(used) - toxic_used

    def document_counts(rows) -> pa.RecordBatch:
        parts = [(np.unique(features), y) for h, y, features, _ in rows if h in used]
        found, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *(f for f, _ in parts)]), return_inverse=True)
        marks = np.concatenate([np.zeros(0), *(np.full(len(f), y, float) for f, y in parts)])
        bad, every = np.bincount(at, marks, len(found)), np.bincount(at, minlength=len(found))
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad.astype(np.int64)), pa.array((every - bad).astype(np.int64))], names=["feature", "bad", "good"])

    counted = sample.mapInArrow(lambda batches: _per_document(batches, s, document_counts), "feature long, bad long, good long")
    counted = counted.where("feature <> 0").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    more = (F.col("bad") + 0.5) * max(clean_used, 1) >= s.lift * (F.col("good") + 0.5) * max(toxic_used, 1)
    features = np.sort(counted.where((F.col("bad") >= s.support) & more).select("feature").toArrow().column("feature").to_numpy().view(np.uint64))
    shared = spark.sparkContext.broadcast(features)  # of a bounded sample

    def known(rows) -> pa.RecordBatch:
        out = []
        for h, y, found, _ in rows:
            if h in used or h in held:
                at = _lookup(shared.value, found)
                token, slot = np.nonzero(at >= 0)
                out.append((h, y, len(found), token.astype(np.int32).tobytes(), at[token, slot].astype(np.int32).tobytes()))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(types)], names=["h", "toxic", "length", "token", "feature"])

    made = sample.mapInArrow(lambda batches: _per_document(batches, s, known), "h long, toxic int, length long, token binary, feature binary").orderBy("h").collect()
    shared.destroy()
    rows = [(r["h"], r["toxic"], r["length"], np.frombuffer(bytes(r["token"]), np.int32), np.frombuffer(bytes(r["feature"]), np.int32)) for r in made]
    fitted = [r for r in rows if r[0] in used]
    short = [Sampled(*shortened(length, token, s.plain_run), feature) for _, _, length, token, feature in fitted]
    weights, bias, transitions = _fit_field(short, np.array([r[1] for r in fitted]), len(features), s)
    model = ToxicModel(features, weights, bias, transitions, np.zeros(3), s)
    evidence, marks = [], []
    for h, y, length, token, feature in rows:
        if h in held:
            places, back = np.unique(token, return_inverse=True)
            p = marginals(places.astype(np.int64), np.bincount(back, weights[feature], len(places)), np.array([0, length]), model)
            evidence.append((p.sum(), p.max(initial=0.0)))
            marks.append(y)
    marks = np.array(marks, int)
    # Rows weigh what their label weighs among all labelled documents, as many in all as there are rows.
    share = np.array([sizes.get(y, 0) / max((marks == y).sum(), 1) for y in (0, 1)])[marks]
    curve = _fit_curve(np.array(evidence).reshape(-1, 2), marks, share * len(marks) / max(share.sum(), 1e-9))
    used_features = np.abs(weights) > 1e-3
    return ToxicModel(features[used_features], weights[used_features], bias, transitions, curve, s)


# ---- inference --------------------------------------------------------------------------------------------


def marginals(tokens: np.ndarray, emission: np.ndarray, before: np.ndarray, model: ToxicModel) -> np.ndarray:
    """Exact probability of the toxic state at each of `tokens` (those with a known feature) in whole chains.

    All other tokens share one potential, so a run of g of them is the g-th power of one 2 x 2 matrix, taken
    through its eigenvalues. Chains advance side by side from one such token to the next.
    """
    if not len(tokens):
        return np.zeros(0)
    moves = np.exp(model.transitions)
    plain = moves * np.array([1.0, np.exp(model.bias)])
    values, right = np.linalg.eig(plain)
    left = np.linalg.inv(right)
    order = np.argsort(-values.real)
    ratio = values.real[order[1]] / values.real[order[0]]
    major, minor = (np.outer(right[:, i], left[i]).real for i in order)

    def power(gaps: np.ndarray) -> np.ndarray:
        return major[None] + (ratio ** gaps)[:, None, None] * minor[None]

    lengths = np.diff(before)
    owner = np.searchsorted(before, tokens, "right") - 1
    place = tokens - before[owner]
    new = np.append(True, owner[1:] != owner[:-1])
    rank = np.arange(len(tokens)) - np.maximum.accumulate(np.where(new, np.arange(len(tokens)), 0))
    gap = place - np.where(new, -1, np.append(-1, place[:-1])) - 1
    potential = np.stack([np.ones(len(tokens)), np.exp(np.clip(emission + model.bias, -30, 30))], axis=1)
    last = np.append(new[1:], True)
    steps = [np.flatnonzero(rank == r) for r in range(rank.max() + 1)] if rank.max() < 64 else _by_rank(rank)
    forward, state = np.empty((len(tokens), 2)), np.zeros((len(lengths), 2))
    state[:, 0] = 1.0
    for at in steps:
        ahead = np.einsum("na,nab->nb", state[owner[at]], power(gap[at])) @ moves * potential[at]
        state[owner[at]] = forward[at] = ahead / ahead.sum(axis=1, keepdims=True)
    backward, state = np.empty((len(tokens), 2)), np.ones((len(lengths), 2))
    for at in reversed(steps):
        ending = at[last[at]]
        rest = lengths[owner[ending]] - place[ending] - 1
        state[owner[ending]] = power(rest).sum(axis=2)
        backward[at] = state[owner[at]]
        behind = np.einsum("nab,nb->na", power(gap[at]), (backward[at] * potential[at]) @ moves.T)
        state[owner[at]] = behind / behind.sum(axis=1, keepdims=True)
    joint = np.maximum(forward * backward, 0)
    return joint[:, 1] / np.maximum(joint.sum(axis=1), 1e-300)


def _by_rank(rank: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(rank, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(rank[order])) + 1)


def score_texts(texts: pa.Array, model: ToxicModel, table: FeatureTable) -> tuple[np.ndarray, list[list[dict]]]:
    """Score per text, and its toxic spans as code-point offsets with the largest marginal inside."""
    s = model.settings
    t = Texts(texts, lower=True)
    starts, ends, before = t.words()
    tokens, emission = table.emissions(token_features(t, starts, ends, s))
    p = marginals(tokens, emission, before, model)
    owner = np.searchsorted(before, tokens, "right") - 1
    expected, largest = np.bincount(owner, p, t.count), np.zeros(t.count)
    np.maximum.at(largest, owner, p)
    z = model.curve[0] + model.curve[1] * np.log1p(expected) + model.curve[2] * largest
    spans: list[list[dict]] = [[] for _ in range(t.count)]
    hot = np.flatnonzero(p >= s.span_probability)
    if len(hot):
        points = t.code_points()
        previous = -2
        for i in hot:
            token, own = tokens[i], owner[i]
            begin, end = (int(points[x] - points[t.offsets[own]]) for x in (starts[token], ends[token]))
            if token == previous + 1 and spans[own]:
                spans[own][-1] |= {"end": end, "probability": max(spans[own][-1]["probability"], float(p[i]))}
            else:
                spans[own].append({"start": begin, "end": end, "probability": float(p[i])})
            previous = token
    return 1 / (1 + np.exp(-z)), spans


SPAN_TYPE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("probability", T.DoubleType())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def predict(docs: DataFrame, model: ToxicModel, whole_rows: bool = False) -> DataFrame:
    """held_out, score, predicted and spans of every row, with doc_id, or with the document as a struct `row`.

    Null or empty text: the score of a text without evidence, no spans. Repeated rows are scored each. No
    column but `text` is an input of a score.
    """
    s = model.settings
    held = (fold_of(F.col("doc_id"), s.folds) == s.held_out_fold).alias("held_out")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # features of a bounded sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        table = FeatureTable(m.features, m.weights)
        for batch in batches:
            text = batch.column("row").field("text") if whole_rows else batch.column("text")
            names = [n for n in batch.schema.names if n != "text"]
            for start, count in cuts(text):
                score, spans = score_texts(text.slice(start, count), m, table)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(n).slice(start, count) for n in names), pa.array(score), pa.array((score >= s.threshold).astype(np.int32)), pa.array(spans, _SPANS)],
                    names=[*names, "score", "predicted", "spans"])

    inner = docs.select(F.struct("*").alias("row"), held) if whole_rows else docs.select("doc_id", held, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*inner.drop("text").schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPAN_TYPE)])
    return inner.mapInArrow(run, schema)


def keep_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with their columns."""
    return predict(docs, model, whole_rows=True).where("predicted = 0").select("row.*")

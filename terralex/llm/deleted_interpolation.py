"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of order two, one and zero are mixed with weights that depend on how often the
context was seen; the weights come from expectation-maximisation on counts held out of the estimates.

Counting and scoring share one shuffle. Documents are dealt into groups of bounded size by a hash. A group sends
its distinct words and word pairs, sorted, with their training counts, cut into slots by hash range: one row per
group and slot. Groups and slots grow with the square root of a large input, so that the number of these rows grows
with the input and not with its square. A slot adds up the counts of all groups and answers every group with the totals of the keys it
sent, in their order. The group then has the corpus counts of all its tokens at hand. A key occurs once per group
however frequent it is, so a word that makes up a third of all tokens is no hot spot. Rows equal in id and text are
counted where they are read and travel once per task.

The weights are learned on every document of one training fold. A slot answers a second time with the totals of
only those keys that stand in the group's documents of that fold, so these documents are resolved without the rest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Texts, cuts, fold_of, mix, partitions_for, text_volume
from terralex.llm.packing import pack, unpack
from terralex.session import materialise

_END = np.uint64(0xE0D0F7E87A5C31B1)
_START = np.uint64(0x57A27B1DD3C4096F)
WORDS, PAIRS = 0, 1


@dataclass(frozen=True)
class Interpolation:
    folds: int = 5
    held_out_fold: int = 1
    em_fold: int = 0  # training fold whose counts are held out while the weights are learned
    group_bytes: int = 4 << 20  # of text
    slot_bytes: int = 16 << 20
    messages: int = 8192  # rows to slots for each group_bytes of text, at most; beyond, groups and slots grow
    buckets: int = 40  # of the context's count, by powers of two
    iterations: int = 60


class GroupTokens:
    """Tokens of a group's texts: words with A-Z lower-cased and one end each; pairs with the token before."""

    def __init__(self, texts: pa.Array, copies: np.ndarray):
        parts = [self._hashed(texts.slice(start, count)) for start, count in cuts(texts)]
        self.tokens = np.concatenate([np.zeros(0, np.uint64), *(tokens for tokens, _ in parts)])
        self.offsets = np.cumsum(np.concatenate([[0], *(sizes for _, sizes in parts)]))
        self.copies = np.repeat(copies, np.diff(self.offsets))
        n = len(self.tokens)
        self.first = np.zeros(n, bool)
        self.first[self.offsets[:-1]] = True
        context = np.where(self.first, _START, np.append(_START, self.tokens[:-1])[:n])
        self.keys, self.inverse = {}, {}
        for kind, values in ((WORDS, self.tokens), (PAIRS, mix(context + mix(self.tokens ^ _START)))):
            self.keys[kind], self.inverse[kind] = np.unique(values, return_inverse=True)

    @staticmethod
    def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the tokens of some texts, and the number of tokens of each text."""
        t = Texts(texts, lower=True)
        starts, ends, before = t.words()
        offsets = before + np.arange(t.count + 1)
        tokens = np.full(len(starts) + t.count, _END)
        is_word = np.ones(len(tokens), bool)
        is_word[offsets[1:] - 1] = False
        tokens[is_word] = t.hashes(starts, ends)
        return tokens, np.diff(offsets)

    def counts(self, kind: int, chosen: np.ndarray) -> np.ndarray:
        """Occurrences of each key in the chosen texts and their copies."""
        here = np.repeat(chosen, np.diff(self.offsets))
        return np.bincount(self.inverse[kind][here], self.copies[here], len(self.keys[kind])).astype(np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Packed byte plane by byte plane: the leading bytes of sorted keys, and of small counts, hardly cost."""
    return pack(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unpack(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _slot_cuts(keys: np.ndarray, slots: int) -> np.ndarray:
    return np.searchsorted((keys >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32), np.arange(slots + 1))


def _group_texts(table: pa.Table) -> pa.Array:
    return pa.array([unpack(x) for x in table.column("packed").to_pylist()], pa.large_binary()).cast(pa.large_string())


def _sorted_rows(table: pa.Table) -> pa.Table:
    return table.sort_by([("content", "ascending"), ("fold", "ascending")])


class Scorer:
    """Counts of a corpus, resolved for its documents."""

    def __init__(self, docs: DataFrame, options: Interpolation = Interpolation()):
        o = self.options = options
        size, _ = text_volume(docs)
        growth = max(1.0, math.sqrt(size / (o.messages * o.slot_bytes)))
        self.groups = max(1, math.ceil(size / (growth * o.group_bytes)))
        self.slots = partitions_for(docs.sparkSession, size, math.ceil(growth * o.slot_bytes))
        self.group_tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.groups // 2))
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        inner = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("content"), fold_of(F.col("doc_id"), o.folds).cast("int").alias("fold"), F.col("text").cast("string").alias("text"))
        inner = inner.withColumn("grp", F.pmod("content", F.lit(self.groups)).cast("int"))
        self.inner = inner
        self.totals = materialise(self._totals(self._packed(inner)))
        row = self.totals.where("grp < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_rest", "v"))).first()
        self.n, self.n_rest, self.v = row["n"], row["n_rest"], row["v"]

    def _packed(self, inner: DataFrame) -> DataFrame:
        packed = inner.mapInArrow(_pack_texts, f"doc_id {self.kind}, content long, fold int, grp int, packed binary, copies long")
        return packed.repartition(self.group_tasks, "grp")

    def _totals(self, packed: DataFrame) -> DataFrame:
        o, slots = self.options, self.slots

        def send(table: pa.Table) -> pa.Table:
            table = _sorted_rows(table)
            fold, group = table.column("fold").to_numpy(), table.column("grp")[0].as_py()
            tokens = GroupTokens(_group_texts(table), table.column("copies").to_numpy())
            rows = {"slot": [], "grp": [], "keys": [], "em": [], "rest": []}
            for kind in (WORDS, PAIRS):
                keys = tokens.keys[kind]
                em = tokens.counts(kind, fold == o.em_fold)
                rest = tokens.counts(kind, (fold != o.em_fold) & (fold != o.held_out_fold))
                cut = _slot_cuts(keys, slots)
                for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        for name, value in (("slot", kind * slots + s), ("grp", group), ("keys", _planes(keys[a:b])), ("em", _planes(em[a:b])), ("rest", _planes(rest[a:b]))):
                            rows[name].append(value)
            return pa.table({"slot": pa.array(rows["slot"], pa.int32()), "grp": pa.array(rows["grp"], pa.int32()), **{c: pa.array(rows[c], pa.binary()) for c in ("keys", "em", "rest")}})

        def answer(table: pa.Table) -> pa.Table:
            slot, groups = table.column("slot")[0].as_py(), table.column("grp").to_pylist()
            parts = [_from_planes(x, np.uint64) for x in table.column("keys").to_pylist()]
            keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            totals = [np.bincount(inverse, np.concatenate([_from_planes(x, np.uint64) for x in table.column(c).to_pylist()]), len(keys)).astype(np.uint64) for c in ("em", "rest")]
            ends = np.cumsum([len(p) for p in parts])
            replies = [[_planes(t[inverse[e - len(p) : e]]) for p, e in zip(parts, ends, strict=True)] for t in totals]
            own = [_from_planes(x, np.uint64) > 0 for x in table.column("em").to_pylist()]
            held = [_planes(totals[1][inverse[e - len(p) : e][f]]) if f.any() else None for p, e, f in zip(parts, ends, own, strict=True)]
            words = slot < slots
            sums = [int(totals[0].sum() + totals[1].sum()), int(totals[1].sum()), int((totals[0] + totals[1] > 0).sum())] if words else [0, 0, 0]
            count = len(groups)
            return pa.table({
                "grp": pa.array([*groups, -1], pa.int32()), "slot": pa.array([slot] * (count + 1), pa.int32()),
                "em": pa.array([*replies[0], None], pa.binary()), "rest": pa.array([*replies[1], None], pa.binary()),
                "held": pa.array([*held, None], pa.binary()),
                **{c: pa.array([0] * count + [x], pa.int64()) for c, x in zip(("n", "n_rest", "v"), sums, strict=True)}})

        sent = packed.groupBy("grp").applyInArrow(send, "slot int, grp int, keys binary, em binary, rest binary")
        return sent.repartition(2 * slots, "slot").groupBy("slot").applyInArrow(answer, "grp int, slot int, em binary, rest binary, held binary, n long, n_rest long, v long")

    def _resolved(self, inner: DataFrame, replies: DataFrame, use, schema: str) -> DataFrame:
        """`use(table, tokens, counts)` per group; counts: (kind, column of the replies) -> totals per token. The
        replies of a group are those for all keys of its documents in `inner`."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            left, right = _sorted_rows(left), right.sort_by("slot")
            tokens, counts = GroupTokens(_group_texts(left), left.column("copies").to_numpy()), {}
            kinds = right.column("slot").to_numpy() >= slots
            for kind in (WORDS, PAIRS):
                for c in columns:
                    found = [_from_planes(x, np.uint64) for x, k in zip(right.column(c).to_pylist(), kinds, strict=True) if k == kind]
                    counts[kind, c] = np.concatenate(found).astype(np.float64)[tokens.inverse[kind]]
            return use(left, tokens, counts)

        slots, columns = self.slots, [c for c in replies.columns if c not in ("grp", "slot")]
        return self._packed(inner).groupBy("grp").cogroup(replies.repartition(self.group_tasks, "grp").groupBy("grp")).applyInArrow(run, schema)

    def weights(self) -> np.ndarray:
        """bucket x order (0, 1, 2), learned on all documents of the held-out training fold."""
        o, n_rest, v = self.options, self.n_rest, self.v

        def events(table: pa.Table, tokens: GroupTokens, counts: dict) -> pa.Table:
            context = _contexts(tokens, counts[WORDS, "held"])
            p2 = counts[PAIRS, "held"] / np.maximum(context, 1)
            p1 = counts[WORDS, "held"] / max(n_rest, 1)
            cells = np.stack([_bucket(context, o), *(np.where(p > 0, np.round(8 * np.log2(np.maximum(p, 1e-300))), 1) for p in (p2, p1))], axis=1).astype(np.int64)
            cells, inverse = np.unique(cells, axis=0, return_inverse=True)
            n = np.bincount(inverse.ravel(), tokens.copies, len(cells))
            return pa.table({"bucket": cells[:, 0], "q2": cells[:, 1], "q1": cells[:, 2], "n": n.astype(np.int64)})

        replies = self.totals.where("grp >= 0 AND held IS NOT NULL").select("grp", "slot", "held")
        cells = self._resolved(self.inner.where(F.col("fold") == o.em_fold), replies, events, "bucket long, q2 long, q1 long, n long")
        found = cells.groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n")).toArrow()  # probabilities in eighths of a power of two
        bucket, q2, q1, n = (found.column(c).to_numpy() for c in ("bucket", "q2", "q1", "n"))
        p = np.stack([np.full(len(n), 1 / (v + 1)), np.where(q1 > 0, 0, 2.0 ** (q1 / 8)), np.where(q2 > 0, 0, 2.0 ** (q2 / 8))], axis=1)
        pooled = expectation_maximisation(np.zeros(len(n), int), p, n, 1, np.full((1, 3), 1 / 3), o.iterations)
        return expectation_maximisation(bucket, p, n, o.buckets, np.repeat(pooled, o.buckets, axis=0), o.iterations)

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
        o, n, v, kind = self.options, self.n, self.v, self.kind
        weights = self.weights()

        def score(table: pa.Table, tokens: GroupTokens, counts: dict) -> pa.Table:
            word, pair = (counts[k, "em"] + counts[k, "rest"] for k in (WORDS, PAIRS))
            context = _contexts(tokens, word)
            mixed = weights[_bucket(context, o)]
            p = mixed[:, 0] / (v + 1) + mixed[:, 1] * word / max(n, 1) + mixed[:, 2] * pair / np.maximum(context, 1)
            base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
            at = tokens.offsets[:-1]
            return pa.table({
                "doc_id": table.column("doc_id"), "held_out": table.column("fold").to_numpy() == o.held_out_fold, "n_tokens": np.diff(tokens.offsets),
                "n_known": np.add.reduceat((word > 0).astype(np.int64), at), "train_tokens": np.full(table.num_rows, n),
                "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at), "copies": table.column("copies")})

        schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, copies long"
        scored = self._resolved(self.inner, self.totals.where("grp >= 0").select("grp", "slot", "em", "rest"), score, schema)
        return scored.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy", "copies")


def _contexts(tokens: GroupTokens, word: np.ndarray) -> np.ndarray:
    """Count of each token's context: every training token but the ends is a context once, and the start of a
    text counts as often as there are ends."""
    before = np.append(0.0, word[:-1])
    ends = word[tokens.offsets[1:] - 1]
    before[tokens.offsets[:-1]] = ends
    return before


def _bucket(context: np.ndarray, o: Interpolation) -> np.ndarray:
    return np.minimum(np.floor(np.log2(context + 1)).astype(np.int64), o.buckets - 1)


def expectation_maximisation(bucket: np.ndarray, p: np.ndarray, n: np.ndarray, buckets: int, start: np.ndarray, iterations: int) -> np.ndarray:
    """Mixture weights per bucket that maximise the likelihood of n events with component probabilities p. Two
    events' worth of the starting weights is added to every bucket, so no weight is zero."""
    weights = start.copy()
    for _ in range(iterations):
        share = weights[bucket] * p
        share = share / np.maximum(share.sum(axis=1, keepdims=True), 1e-300) * n[:, None]
        expected = 2.0 * start + np.stack([np.bincount(bucket, share[:, j], buckets) for j in range(3)], axis=1)
        weights = expected / expected.sum(axis=1, keepdims=True)
    return weights


def _pack_texts(batches: Iterator[pa.RecordBatch], held_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Compressed texts. Equal rows of a batch become one row with the number of copies; those that had copies wait
    for more of them in later batches, up to `held_bytes` of text."""

    def packed(rows: dict, like: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array(x, like.schema.field(c).type) for c, x in zip(names, zip(*(k[:4] for k in rows), strict=True), strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([pack(k[4]) for k in rows], pa.binary()), pa.array(list(rows.values()), pa.int64())], names=[*names, "packed", "copies"])

    names, held, size, batch = ["doc_id", "content", "fold", "grp"], Counter(), 0, None
    for batch in batches:
        texts = (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column("text").cast(pa.binary()))
        rows = Counter(zip(*(batch.column(c).to_pylist() for c in names), texts, strict=True))
        for key in [k for k, n in rows.items() if n > 1 or k in held]:
            size += 0 if key in held else len(key[4]) + 100
            held[key] += rows.pop(key)
        if rows:
            yield packed(rows, batch)
        if size > held_bytes:
            yield packed(held, batch)
            held, size = Counter(), 0
    if held:
        yield packed(held, batch)


def score_documents(docs: DataFrame, options: Interpolation = Interpolation()) -> DataFrame:
    """Scores of every document of `docs`, learned from those outside the held-out fold.

    Null or empty text: one token, the end. Repeated rows count and are scored each. Without training rows the
    model is uniform. Other columns of `docs` are not read. An empty table gives an empty result.
    """
    return Scorer(docs, options).scores()

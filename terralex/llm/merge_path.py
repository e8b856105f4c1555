"""Alignment of two tokenizers by merge-path partitioning.

Both tokenizers cut the same bytes, so each gives a rising list of token ends. Merging the two lists is divided by
diagonals: a binary search on each finds how many ends of either list lie before it, which cuts the merge into
pieces of equal work that need nothing from one another. All pieces of a slice of texts advance side by side, one
end per step, and emit the ends that both lists hold. An exclusive sum over the pieces' numbers of such ends stitches
the tokens at their boundaries into groups, which may reach over any number of pieces.

Pairs of tokens that end together are then counted over the corpus, the highest count of every B id is found, and the
stored links of each document are held against the counts: a bounded part of the counts at a time.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.llm.common import cuts
from terralex.llm.packing import pack, unpack
from terralex.session import Scratch, materialise


@dataclass(frozen=True)
class AlignSettings:
    a_path: str  # a byte-level BPE file of the tokenizers library
    b_path: str  # a sentencepiece model
    piece_work: int = 128  # token ends that one piece merges
    slice_bytes: int = 1 << 20  # text that is merged at once; a longer text is a slice of its own
    pending_pairs: int = 1 << 20  # links a task holds before it adds them up
    count_rows: int = 4_000_000  # pair counts that are broadcast at once (16 bytes each)


# ---- the two tokenizers -----------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters stand for
    themselves, the other bytes in order for the characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenBytes:
    """The bytes of every token of a vocabulary as one array, from which runs of tokens are put together."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.length = np.array([len(x) for x in entries], np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.length[ids]
        place = np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        place += np.arange(len(place))
        return self.data[place]

    def spells(self, lists: list[np.ndarray], wanted: list[bytes], asked: np.ndarray) -> np.ndarray:
        """Whether the tokens of each list that is asked for are the wanted bytes."""
        same = np.array([ok and int(self.length[ids].sum()) == len(w) for ids, w, ok in zip(lists, wanted, asked.tolist(), strict=True)], bool)
        some = np.flatnonzero(same)
        if not len(some):
            return same
        made = self.joined(np.concatenate([lists[i] for i in some]))
        whole = np.frombuffer(b"".join(wanted[i] for i in some), np.uint8)
        ends = np.cumsum([len(wanted[i]) for i in some])
        wrong = np.flatnonzero(made != whole)
        same[some[np.searchsorted(ends, wrong, "right")]] = False
        return same


class Tokenizers:
    """Both tokenizers with the bytes of each of their tokens."""

    def __init__(self, settings: AlignSettings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(settings.a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=settings.b_path)
        alphabet = byte_alphabet()
        size = self.a.get_vocab_size(with_added_tokens=True)
        entries = [self.a.id_to_token(i) or "" for i in range(size)]
        self.a_table = TokenBytes([bytes(alphabet[c] for c in e) if all(c in alphabet for c in e) else e.encode() for e in entries])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_table = TokenBytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        if max(size, len(pieces)) > 1 << B_BITS:
            raise ValueError("vocabularies of more than 65,536 tokens do not fit into a pair")
        # Decimal ids with what follows them: inside a run, after the last A of a group, after its last B.
        ids = [str(i) for i in range(max(size, len(pieces)))]
        self.width = len(ids)
        self.printed = TokenBytes([(i + mark).encode() for mark in ",|;" for i in ids])

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Both id lists of each text; empty where the bytes of either differ from space and text."""
        wholes = [b" " + t.encode() for t in texts]
        a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = [np.array(ids, np.int64) for ids in self.b.encode(texts, num_threads=1)]
        good = np.array([bool(t) for t in texts], bool)
        for ids, table in ((a, self.a_table), (b, self.b_table)):
            good &= table.spells(ids, wholes, good)
        return [(x, y) if ok else (x[:0], y[:0]) for x, y, ok in zip(a, b, good.tolist(), strict=True)]


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers_of(settings: AlignSettings) -> Tokenizers:
    key = settings.a_path, settings.b_path
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizers(settings)
    return _TOKENIZERS[key]


# ---- merging ------------------------------------------------------------------------------------------------


def diagonal_splits(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many ends of `a` are among the first d ends of the merge (of equal ends, `a`'s comes first), for every
    diagonal d, by binary searches that advance together."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) // 2
        other = diagonals - middle - 1
        # a[middle] belongs before the diagonal if it is not after the b end that would take its place.
        before = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(other, 0, len(b) - 1)])
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)


def merge_pieces(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place in a, place in b) of every end that stands in both lists, each strictly rising; the last end
    of both lists must be the same. Pieces hold `work` ends each and are merged side by side."""
    total = len(a) + len(b)
    edges = np.append(np.arange(0, total, work), total)
    taken = diagonal_splits(a, b, edges)
    i, j = taken[:-1].copy(), edges[:-1] - taken[:-1]
    size = np.diff(edges)
    end = np.int64(a[-1]) + 1  # greater than any end
    a_ends, b_ends = np.append(a, end), np.append(b, end)
    # One more in front, so that the first piece may look behind itself.
    a_before = np.concatenate([[np.int64(-1)], a])
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(work):
        live = size > step
        from_a = live & (a_ends[i] <= b_ends[j])
        from_b = live & ~from_a
        both = np.flatnonzero(from_b & (a_before[i] == b_ends[j]))  # a's equal end came just before, perhaps in the last piece
        if len(both):
            met.append((both, i[both] - 1, j[both]))
        i += from_a
        j += from_b
    if not met:
        return (np.zeros(0, np.int64),) * 3
    piece, at_a, at_b = (np.concatenate(x) for x in zip(*met, strict=True))
    return piece, at_a, at_b


def group_starts(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b at which groups end, in order. An exclusive sum over the pieces gives each piece the
    number of its first group; within a piece, groups follow the order of the ends."""
    piece, at_a, at_b = merge_pieces(a, b, work)
    pieces = -(-(len(a) + len(b)) // work)
    per_piece = np.bincount(piece, minlength=pieces)
    before = np.cumsum(per_piece) - per_piece
    order = np.argsort(piece, kind="stable")  # steps come in order, so a piece's ends do
    within = np.arange(len(piece)) - before[piece[order]]
    group = np.empty(len(piece), np.int64)
    group[order] = before[piece[order]] + within
    last_a, last_b = np.empty(len(piece), np.int64), np.empty(len(piece), np.int64)
    last_a[group], last_b[group] = at_a, at_b
    return last_a, last_b


@dataclass(frozen=True)
class Aligned:
    """The alignment of one text: both lists of ids, and where in them each group ends."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @property
    def links(self) -> np.ndarray:
        """The pair of ids that ends each group: A's in the bits above the lowest `B_BITS`, B's in those."""
        return (self.a_ids[self.last_a] << B_BITS) | self.b_ids[self.last_b]


#: A pair of ids is one number of 32 bits; `Tokenizers` refuses vocabularies that need more.
B_BITS = 16


def align(coded: list[tuple[np.ndarray, np.ndarray]], tokens: Tokenizers, settings: AlignSettings) -> list[Aligned]:
    """The texts of a slice, merged as one pair of lists: texts end together, so no group reaches over two."""
    a_ids, b_ids = (np.concatenate([np.zeros(0, np.int64), *(pair[k] for pair in coded)]) for k in (0, 1))
    a_before, b_before = (np.concatenate([[0], np.cumsum([len(pair[k]) for pair in coded])]).astype(np.int64) for k in (0, 1))
    if not len(a_ids):
        nothing = np.zeros(0, np.int64)
        return [Aligned(nothing, nothing, nothing, nothing) for _ in coded]
    last_a, last_b = group_starts(np.cumsum(tokens.a_table.length[a_ids]), np.cumsum(tokens.b_table.length[b_ids]), settings.piece_work)
    cut = np.searchsorted(last_a, a_before)
    return [
        Aligned(a_ids[a_before[t] : a_before[t + 1]], b_ids[b_before[t] : b_before[t + 1]], last_a[cut[t] : cut[t + 1]] - a_before[t], last_b[cut[t] : cut[t + 1]] - b_before[t])
        for t in range(len(coded))]


def printed_groups(x: Aligned, tokens: Tokenizers) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group in order."""
    if not len(x.a_ids):
        return b""
    end_a, end_b = x.last_a + 1, x.last_b + 1
    start_a, start_b = np.append(0, end_a[:-1]), np.append(0, end_b[:-1])
    codes = np.empty(len(x.a_ids) + len(x.b_ids), np.int64)
    place_a = np.arange(len(x.a_ids)) + np.repeat(start_b, end_a - start_a)  # behind B's tokens of the groups before
    place_b = np.arange(len(x.b_ids)) + np.repeat(end_a, end_b - start_b)  # behind A's tokens up to the own group
    codes[place_a], codes[place_b] = x.a_ids, x.b_ids
    codes[place_a[x.last_a]] += tokens.width
    codes[place_b[x.last_b]] += 2 * tokens.width
    return tokens.printed.joined(codes)[:-1].tobytes()


# ---- the corpus -----------------------------------------------------------------------------------------------


def align_documents(docs: DataFrame, settings: AlignSettings, groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256 (or the printed `groups` themselves) and the packed links of every
    row."""
    kind = docs.schema["doc_id"].dataType
    shown = "groups" if groups else "groups_sha256"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizers_of(settings)
        for batch in batches:
            for start, count in cuts(batch.column("text"), settings.slice_bytes):
                texts = [t or "" for t in batch.column("text").slice(start, count).to_pylist()]
                found = align(tokens.encode(texts), tokens, settings)
                printed = [printed_groups(x, tokens) for x in found]
                printed = [p.decode() if groups or not p else hashlib.sha256(p).hexdigest() for p in printed]
                numbers = [pa.array([len(n) for n in values], pa.int64()) for values in zip(*((x.a_ids, x.b_ids, x.last_a) for x in found), strict=True)]
                links = pa.array([pack(x.links.astype("<u4").tobytes()) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, count), *numbers, pa.array(printed, pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", shown, "links"])

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")), T.StructField(shown, T.StringType()), T.StructField("links", T.BinaryType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _links(packed: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(unpack(x), "<u4") for x in packed.to_pylist()]


def pair_counts(aligned: DataFrame, settings: AlignSettings) -> DataFrame:
    """pair, n, best: links of every id pair, and whether no pair with the same B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pending: list[np.ndarray] = []
        rows = 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate([keys[:0], *pending]), return_counts=True)
            found, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([counts, n]), len(found)).astype(np.int64)

        for batch in batches:
            for links in _links(batch.column("links")):
                pending.append(links)
                rows += len(links)
                if rows >= settings.pending_pairs:
                    keys, counts = added()
                    pending, rows = [], 0
                    if len(keys) >= settings.pending_pairs:
                        yield _pairs(keys, counts)
                        keys, counts = keys[:0], counts[:0]
        if pending or len(keys):
            yield _pairs(*added())

    counted = aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    low = F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))
    highest = counted.groupBy(low.alias("b")).agg(F.max("n").alias("highest"))
    return counted.withColumn("b", low).join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _pairs(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts)], names=["pair", "n"])


def _with_counts(rows: DataFrame, part: DataFrame) -> DataFrame:
    """The columns of `rows` without links, with n_best and count_sum over the pairs of `part`, which is broadcast."""
    spark = rows.sparkSession
    table = part.orderBy("pair").toArrow()  # at most about count_rows rows
    columns = [table.column("pair").to_numpy().astype(np.uint32), table.column("n").to_numpy(), table.column("best").to_numpy()]
    shared = spark.sparkContext.broadcast(columns)
    names = [c for c in rows.columns if c != "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            lists = _links(batch.column("links"))
            links = np.concatenate([keys[:0], *lists])
            n, top = np.zeros(len(links), np.int64), np.zeros(len(links), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
                known = keys[at] == links
                n, top = np.where(known, counts[at], 0), (known & best[at]).astype(np.int64)
            before = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (top, n)]
            made = [pa.array(s[before[1:]] - s[before[:-1]]) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, "n_best", "count_sum"])

    schema = T.StructType([*rows.select(*names).schema.fields, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return rows.mapInArrow(run, schema)


def cross_align(docs: DataFrame, settings: AlignSettings, groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and groups_sha256 (or `groups`).

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros
    and an empty text. Repeated rows are aligned and counted each. Columns other than doc_id and text are not read.
    An empty table gives an empty result.
    """
    aligned = materialise(align_documents(docs, settings, groups))
    with Scratch(docs.sparkSession) as keep:
        counts = keep(pair_counts(aligned, settings))
        total = counts.count()
        parts = max(1, -(-total // settings.count_rows))
        shown = "groups" if groups else "groups_sha256"
        fixed = ["doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), shown]
        if parts == 1:
            return materialise(_with_counts(aligned.select(*fixed, "links"), counts))
        # More pairs than may be broadcast: part by part, by pair; the parts' sums are added up per row.
        numbered = keep(aligned.withColumn("_row", F.monotonically_increasing_id()))
        sums = None
        for k in range(parts):
            found = keep(_with_counts(numbered.select("_row", "links"), counts.where(F.pmod(F.xxhash64("pair"), F.lit(parts)) == k)))
            sums = found if sums is None else sums.unionAll(found)
        added = sums.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        return materialise(numbered.select("_row", *fixed).join(added, "_row").drop("_row"))

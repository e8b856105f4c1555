"""BPE encoding that reuses content-defined chunks, and decoding.

A rolling hash over the last bytes cuts every text where its value says so, so equal passages are cut alike
wherever they stand. Chunks that occur more than once in the corpus are encoded once, from one representative;
their encodings are joined to the documents. A chunk's encoding covers its interior, from its first to its last
white space, because a cut may split a word. Everything between the interiors is encoded with the document,
and every join is checked by re-encoding a window that reaches a word into both neighbours: the stored tokens must end
and begin with what it gives. Where they do not, the window is widened to the whole of both neighbours, whose stored
tokens must be what it gives; where they are not either, the document is encoded as one string, which is exact by
definition.
"""

from __future__ import annotations

import array
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import _SPACE, Texts, cuts
from terralex.llm.packing import pack, unpack
from terralex.session import materialise, small_side


@dataclass(frozen=True)
class ChunkSettings:
    tokenizer: str  # path of a tokenizers file, the same on every machine
    window: int = 32  # bytes of the rolling hash
    average: int = 512  # bytes of a chunk, a power of two
    memo_words: int = 400_000  # encoded words that a worker remembers, twice over
    broadcast_rows: int = 500_000


#: A word may be cut before a comma or full stop that ends it: after a letter it is a token of its own.
_ENDING = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|\Z)")


class Encoder:
    """The library's encoder with a bounded memory of words. Tokens never reach across white space, so a run of
    whole words is the sequence of its words' tokens."""

    def __init__(self, settings: ChunkSettings):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(settings.tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.limit, self.memo, self.older = settings.memo_words, {}, {}
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = "H" if size <= 1 << 16 else "I"
        self.tokens = [(self.library.id_to_token(i) or "") for i in range(size)] if self.library.decoder is None else None
        self.decimals = [str(i) for i in range(size)]
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or "\0"
        self.closing = np.array([(self.library.id_to_token(i) or "").endswith(suffix) for i in range(size)])
        self.lower = "Lowercase" in str(self.library.normalizer)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [array.array(self.kind, e.ids).tobytes() for e in found]

    def words(self, text: bytes) -> list[bytes]:
        """Pieces of a run of whole words that are encoded each by itself. Where the tokenizer lower-cases, A-Z are
        lower-cased first (unless special tokens, which are matched as they stand, may be there)."""
        if self.lower and b"<|" not in text:
            text = _ENDING.sub(rb" \1", text.lower())
        return text.split()

    def learn(self, words: set[bytes]) -> None:
        """Remember the words. Of an older half of the memory only what is used again is kept."""
        new = words - self.memo.keys()
        if len(self.memo) + len(new) > self.limit:
            self.memo, self.older = {}, self.memo
            new = words
        known = new & self.older.keys()
        self.memo.update((w, self.older[w]) for w in known)
        letters, others = [], []
        for w in new - known:
            (letters if w.decode().isalpha() else others).append(w)
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            self.memo.update(zip(part, self.encode(part), strict=True))
        groups = [letters[at : at + 64] for at in range(0, len(letters), 64)]
        for at in range(0, len(groups), 64):
            part = groups[at : at + 64]
            for words_, data in zip(part, self.encode([b" ".join(g) for g in part]), strict=True):
                self._divide(words_, data)

    def _divide(self, words: list[bytes], data: bytes) -> None:
        """Remember words of letters that were encoded in one call. Each is one run of tokens that closes with the
        only end-of-word token in it; where the numbers differ the words are encoded one by one."""
        width = array.array(self.kind).itemsize
        cuts_ = np.flatnonzero(self.closing[np.frombuffer(data, self.kind)]) + 1
        if len(cuts_) != len(words) or cuts_[-1] * width != len(data):
            self.memo.update(zip(words, self.encode(words), strict=True))
            return
        start = 0
        for word, end in zip(words, (cuts_ * width).tolist(), strict=True):
            self.memo[word] = data[start:end]
            start = end

    def run(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.memo.__getitem__, words))

    def ids(self, data: bytes) -> list[int]:
        return array.array(self.kind, data).tolist()

    def decode(self, ids: list[int]) -> str:
        if self.tokens is None:
            return self.library.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))  # what decode does for a file without a decoder


_ENCODERS: dict[ChunkSettings, Encoder] = {}


def encoder_of(settings: ChunkSettings) -> Encoder:
    """One encoder per worker process, so that its memory of words outlives a task."""
    if settings not in _ENCODERS:
        _ENCODERS[settings] = Encoder(settings)
    return _ENCODERS[settings]


def chunk_bounds(t: Texts, settings: ChunkSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the chunks of a slice of texts: cut after every byte at which the hash of
    the last `window` bytes falls into 1 of `average` and a code point ends."""
    w = settings.window
    cut = np.flatnonzero(t.rolling(w) >> np.uint64(64 - (settings.average.bit_length() - 1)) == 0) + w
    cut = cut[cut < len(t.data)]
    cut = cut[(t.data[cut] & 0xC0) != 0x80]
    owner = np.searchsorted(t.offsets, cut, "right") - 1
    cut = cut[cut - w >= t.offsets[owner]] if len(cut) else cut
    edges = np.unique(np.concatenate([t.offsets, cut]))
    starts, ends = edges[:-1], edges[1:]
    return starts, ends, np.searchsorted(t.offsets, starts, "right") - 1


def _interiors(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From just after the first white space of each chunk to its last one (empty if there are not two)."""
    spaces = np.append(np.flatnonzero(_SPACE[t.data]), len(t.data))
    first = spaces[np.searchsorted(spaces, starts)]
    last = spaces[np.searchsorted(spaces, ends) - 1]
    good = (first < ends) & (last > first)
    return np.where(good, first + 1, starts), np.where(good, last, starts)


def _keys(t: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each chunk's bytes: a rolling hash, and a cryptographic one that has nothing in common with it."""
    raw = t.data.tobytes()
    second = b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
    return t.hashes(starts, ends).view(np.int64), np.frombuffer(second, np.int64)


def chunk_keys(docs: DataFrame, settings: ChunkSettings) -> DataFrame:
    """content, number, a, b of every chunk that has an interior, with the smallest doc_id of that content."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                t = Texts(part.column("text"))
                starts, ends, owner = chunk_bounds(t, settings)
                low, high = _interiors(t, starts, ends)
                number = np.arange(len(starts)) - np.searchsorted(owner, owner)
                keep = high > low
                a, b = _keys(t, starts[keep], ends[keep])
                at = pa.array(owner[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("content").take(at), pa.array(number[keep].astype(np.int32)), pa.array(a), pa.array(b)],
                    names=["doc_id", "content", "number", "a", "b"])

    found = docs.mapInArrow(run, f"doc_id {kind}, content binary, number int, a long, b long")
    return found.groupBy("content", "number", "a", "b").agg(F.min("doc_id").alias("doc_id"))


def encode_shared(rows: DataFrame, settings: ChunkSettings) -> DataFrame:
    """a, b, ids of the chunks named by the list `numbers` beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(settings)
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                t = Texts(part.column("text"))
                starts, ends, owner = chunk_bounds(t, settings)
                first = np.searchsorted(owner, np.arange(t.count))
                picked = np.array(sorted({int(first[i]) + n for i, numbers in enumerate(part.column("numbers").to_pylist()) for n in numbers}), np.int64)
                low, high = _interiors(t, starts[picked], ends[picked])
                a, b = _keys(t, starts[picked], ends[picked])
                raw = t.data.tobytes()
                runs = [encoder.words(raw[x:y]) for x, y in zip(low, high, strict=True)]
                encoder.learn({w for r in runs for w in r})
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array([pack(encoder.run(r)) for r in runs], pa.binary())], names=["a", "b", "ids"])

    return rows.select("text", "numbers").mapInArrow(run, "a long, b long, ids binary")


def _plan(raw: bytes, bounds: list[tuple[int, int]], shared: dict[int, bytes]) -> list[tuple[int, int, bytes | None]]:
    """Alternate stretches of a text: encoded with the document (None), or a shared chunk's tokens."""
    out, at = [], 0
    for number, (low, high) in enumerate(bounds):
        if number in shared and high > low:
            out += [(at, low, None), (low, high, shared[number])]
            at = high
    return [*out, (at, len(raw), None)]


def _join_window(raw: bytes, low: int, high: int) -> tuple[int, int]:
    """The stretch low..high with the word before and the word after it."""
    reach = 4096
    before = raw[max(0, low - reach) : low].rstrip()
    space = max(before.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
    start = max(0, low - reach) + space + 1 if space >= 0 else 0
    words = raw[high : high + reach].lstrip().split(None, 1)
    skipped = min(reach, len(raw) - high) - len(raw[high : high + reach].lstrip())
    end = high + skipped + len(words[0]) if words else len(raw)
    return start, end if end < high + reach else len(raw)


def encode_documents(docs: DataFrame, settings: ChunkSettings, digests: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens and either the digests of ids and decoded text, or `ids` and
    `decoded` themselves.

    Null or empty text: no tokens. Repeated rows are encoded each. Other columns of `docs` are not read. An
    empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("content"), text.alias("text"))
    keys = materialise(chunk_keys(inner, settings))
    # Copies of a text are one content, so a chunk is shared if it stands in two contents or twice in one.
    shared = keys.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "content", "number")).alias("one")).where("n > 1")
    holders = shared.groupBy(F.col("one.doc_id").alias("_d"), F.col("one.content").alias("_c")).agg(F.collect_set("one.number").alias("numbers"))
    holders = small_side(materialise(holders), settings.broadcast_rows)
    held = inner.join(holders, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("content") == F.col("_c")))
    once = materialise(encode_shared(held, settings).dropDuplicates(["a", "b"]))
    reused = keys.join(once, ["a", "b"]).groupBy(F.col("content").alias("_c")).agg(F.collect_list(F.struct("number", "ids")).alias("reused"))
    packed = inner.mapInArrow(_packed_texts, f"doc_id {kind}, content binary, packed binary")
    rows = packed.join(reused, F.col("content") == F.col("_c"), "left")
    result = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last, done = encoder_of(settings), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                contents = part.column("content").to_pylist()
                new = [i for i, c in enumerate(contents) if c != (contents[i - 1] if i else last)]  # copies stand together
                made = iter(_results(_encode_part(part.take(pa.array(new, pa.int32())), encoder, settings), encoder, digests))
                fresh, results = set(new), []
                for i in range(len(contents)):
                    done = next(made) if i in fresh else done
                    results.append(done)
                last = contents[-1]
                types = [pa.int64(), pa.string(), pa.string()] if digests else [pa.int64(), pa.list_(pa.int32()), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*results, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return rows.select("doc_id", "content", "packed", "reused").mapInArrow(run, f"doc_id {kind}, n_tokens long, {result}")


def _results(coded: list[list[int]], encoder: Encoder, digests: bool) -> Iterator[tuple]:
    for ids in coded:
        if digests:
            yield (len(ids), hashlib.sha256(" ".join(map(encoder.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
        else:
            yield len(ids), ids, encoder.decode(ids)


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [pack(t.as_buffer().to_pybytes()) if t.is_valid else None for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array(packed, pa.binary())], names=["doc_id", "content", "packed"])


def _stored(plan: list[tuple[int, int, bytes | None]], k: int) -> tuple[bytes | None, bytes | None]:
    """Stored tokens before and after a stretch; None at the ends of the text."""
    return (plan[k - 1][2] if k else None), (plan[k + 1][2] if k + 1 < len(plan) else None)


def _agrees(stored: bytes | None, given: bytes, test: Callable[[bytes, bytes], bool]) -> bool:
    """Whether stored tokens end or start with the given ones, or the other way round where the word is longer."""
    if stored is None or not given:
        return True
    return test(stored, given) or test(given, stored)


def _whole_agrees(raw: bytes, plan: list[tuple[int, int, bytes | None]], k: int, middle: list[bytes], encoder: Encoder) -> bool:
    """Whether the library gives the stored tokens of both neighbours of a stretch around its own."""
    before, after = _stored(plan, k)
    start = plan[k - 1][0] if before is not None else plan[k][0]
    end = plan[k + 1][1] if after is not None else plan[k][1]
    return encoder.encode([raw[start:end]])[0] == (before or b"") + encoder.run(middle) + (after or b"")


def _encode_part(part: pa.RecordBatch, encoder: Encoder, settings: ChunkSettings) -> list[list[int]]:
    raws = [unpack(x) if x is not None else b"" for x in part.column("packed").to_pylist()]
    plans: list[list[tuple[int, int, bytes | None]]] = []
    windows, sides = [], []
    for i, (raw, reused) in enumerate(zip(raws, part.column("reused").to_pylist(), strict=True)):
        if not reused:
            plans.append([(0, len(raw), None)])
            continue
        t = Texts(pa.array([raw.decode()]))
        starts, ends, _ = chunk_bounds(t, settings)
        low, high = _interiors(t, starts, ends)
        stored = {r["number"]: r["ids"] for r in reused}
        plan = _plan(raw, list(zip(low.tolist(), high.tolist(), strict=True)), {n: unpack(x) for n, x in stored.items()})
        plans.append(plan)
        for k, (a, b, ids) in enumerate(plan):
            if ids is None:
                start, end = _join_window(raw, a, b)
                windows.append(raw[start:end])
                sides.append((i, k, raw[start:a], raw[a:b], raw[b:end]))
    words = encoder.words
    runs = [[words(raw[a:b]) if ids is None else None for a, b, ids in plan] for raw, plan in zip(raws, plans, strict=True)]
    sides = [(i, k, words(left), words(middle), words(right)) for i, k, left, middle, right in sides]
    needed = {w for run in runs for found in run if found for w in found}
    for _, _, left, middle, right in sides:
        needed.update(left, middle, right)
    encoder.learn(needed)
    run = encoder.run
    loose = []
    for (i, k, left, middle, right), ids in zip(sides, encoder.encode(windows), strict=True):
        before, after = _stored(plans[i], k)
        head, tail = run(left), run(right)
        # What the window gives of a neighbour must be what is stored of it; a word may also stand outside of it.
        if ids != head + run(middle) + tail or not _agrees(before, head, bytes.endswith) or not _agrees(after, tail, bytes.startswith):
            loose.append((i, k))
    torn = {i for i, k in loose if not _whole_agrees(raws[i], plans[i], k, runs[i][k], encoder)}
    out = []
    for i, (raw, plan) in enumerate(zip(raws, plans, strict=True)):
        data = encoder.encode([raw])[0] if i in torn else b"".join(ids if found is None else run(found) for (_, _, ids), found in zip(plan, runs[i], strict=True))
        out.append(encoder.ids(data))
    return out

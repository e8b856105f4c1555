"""Spelling variants, the quality classifier and token alignment against plain Python versions, on given and on
awkward rows."""

import collections
import dataclasses
import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from terralex.llm import merge_path, random_indexing, spelling
from terralex.llm.common import Texts
from tests.llm import brute


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


# ---- 11 ---------------------------------------------------------------------------------------------------


def _variants(docs, settings=spelling.SpellingSettings()):
    return sorted((tuple(r) for r in spelling.group_variants(docs, settings).collect()), key=str)


@pytest.mark.parametrize("name", ["given", "odd"])
def test_variants(name, request):
    docs = request.getfixturevalue(name)
    assert _variants(docs) == sorted(brute.variants(rows_of(docs)), key=str)


def _misspelt(spark):
    """Words with all single edits, chains of forms, ties, words of over 64 letters and every symbol of the range."""
    rng = np.random.default_rng(11)
    symbols = [chr(c) for c in spelling.SYMBOLS]
    counts = {}
    for base in ("kitten", "straße", "àéîõü", "banana", "x" * 70 + "end", "aaaaa", "ÀÿÞ÷×q".lower()):
        counts[base] = 40
        for _ in range(25):
            i, c = int(rng.integers(len(base))), str(rng.choice(symbols))
            for w in (base[:i] + base[i + 1 :], base[:i] + c + base[i:], base[:i] + c + base[i + 1 :]):
                counts.setdefault(w, int(rng.choice([1, 2, 3, 4, 9, 20, 21])))
    chain = "abcdefgh"
    for k in range(7):  # each form twice as frequent as the one before
        counts[chain] = 3 * 2**k
        chain = chain[: k % 8] + "z" + chain[k % 8 + 1 :]
    counts |= {"tieaa": 10, "tieab": 20, "tieac": 20}
    rows = [(i, " ".join([w if i % 2 else w.replace("b", "B")] * n), "x") for i, (w, n) in enumerate(counts.items())]
    return spark.createDataFrame([*rows, (None, "kitten kitten", None), (None, "kitten", None)], "doc_id long, text string, near string")


def test_variants_of_planted_misspellings(spark):
    docs = _misspelt(spark)
    want = sorted(brute.variants(rows_of(docs)), key=str)
    assert max(w[2] != w[1] for w in want if w[1]) and any(len(w[0]) >= 70 and w[1] for w in want)
    assert _variants(docs) == want
    # One slice of filter at a time, small slices, and filters that let almost everything through.
    small = spelling.SpellingSettings(filter_bytes=64, slice_bytes=64, pending_rows=20, probes=500)
    assert len(spelling.plan_passes(spelling.plan_shards({5: 300, 6: 2}, small), small)) > 5
    assert _variants(docs, dataclasses.replace(small, filter_bytes=1000)) == want
    assert _variants(docs, spelling.SpellingSettings(bits_per_word=1)) == want


def test_run_hashes_are_crc32():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 4000).astype(np.uint8)
    starts = np.sort(rng.choice(3000, 200, replace=False))
    ends = starts + rng.integers(1, 300, 200)
    prefix = np.array([zlib.crc32(f"{i}:".encode()) for i in range(200)], np.uint32)
    want = [zlib.crc32(f"{i}:".encode() + data[a:b].tobytes()) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
    assert spelling.run_hashes(prefix, data, starts, ends).tolist() == want


def test_filters_hold_every_word_and_few_others():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 8)) for _ in range(6000)]
    s = spelling.SpellingSettings(slice_bytes=4096)
    shards = spelling.plan_shards({8: 3000}, s)
    w = spelling.Words(pa.array(words[:3000]))
    key = spelling._keys(w.whole, w.length)
    table = np.zeros((shards[8].parts * shards[8].blocks, 2), np.uint64)
    np.bitwise_or.at(table[:, 0], spelling._block(key, shards[8]), spelling._masks(key))
    np.bitwise_or.at(table[:, 1], spelling._block(key, shards[8]), spelling._masks(spelling.mix(key)))
    size = shards[8].blocks
    held = spelling.Filter(shards, {(8, p): table[p * size : (p + 1) * size].tobytes() for p in range(shards[8].parts)}, 64)
    others = spelling.Words(pa.array(sorted(set(words[3000:]) - set(words[:3000]))))
    assert shards[8].parts > 1 and len(held.test(w.whole, 8)) == 3000
    assert len(held.test(others.whole, 8)) < 0.02 * len(others.words) and len(held.test(w.whole, 9)) == 0


def test_edits_are_found_once():
    w = spelling.Words(pa.array(["aabba", "zzzzz", "ÿzàab".lower()]))
    at, hashes = w.deletions()
    made = [w.words[w.owner[i]][: w.place[i]] + w.words[w.owner[i]][w.place[i] + 1 :] for i in at]
    assert len(set(made)) == len(made) and set(made) == {x[:i] + x[i + 1 :] for x in w.words for i in range(5)}
    assert hashes.tolist() == spelling.Words(pa.array(made)).whole.tolist()
    at, new, hashes = w.replacements(0, 15)
    made = [w.words[w.owner[i]][: w.place[i]] + chr(spelling.SYMBOLS[c]) + w.words[w.owner[i]][w.place[i] + 1 :] for i, c in zip(at, new, strict=True)]
    assert hashes.tolist() == spelling.Words(pa.array(made)).whole.tolist()


def test_no_words(none, spark):
    assert _variants(none) == []
    few = spark.createDataFrame([(1, "few words here", 1), (2, None, 2), (3, "", 3), (4, "12 34 漢字", 4)], "doc_id long, text string, n long")
    assert _variants(few) == []
    lone = spark.createDataFrame([(1, "alone alone alone", 1)], "doc_id long, text string, n long")
    assert _variants(lone) == sorted(brute.variants(rows_of(lone)), key=str)


# ---- 12 ---------------------------------------------------------------------------------------------------

SMALL_TABLE = random_indexing.QualitySettings(log_rows=8, dimensions=16, block_rows=50)


def _plain_words(text, s):
    """(word, table row) by a loop over bytes."""
    kinds = random_indexing._KIND
    data, out = (text or "").encode(), []
    for b in data:
        if out and out[-1] and kinds[out[-1][-1]] == kinds[b] and kinds[b]:
            out[-1] += bytes([b])
        else:
            out.append(bytes([b]) if kinds[b] else b"")
    return [w for w in out if w]


def _row_of(word, s):
    rows, _ = random_indexing.token_rows(Texts(pa.array([word], pa.binary()).cast(pa.string())), s)
    return int(rows[0])


def test_words_are_runs_of_letters_or_marks(odd):
    s = SMALL_TABLE
    texts = [t for _, t in rows_of(odd)]
    rows, before = random_indexing.token_rows(Texts(pa.array(texts)), s)
    for i, text in enumerate(texts):
        words = _plain_words(text, s)
        assert before[i + 1] - before[i] == len(words)
        assert rows[before[i] : before[i + 1]][:50].tolist() == [_row_of(w, s) for w in words[:50]]


def test_word_vectors_are_sums_of_turned_index_vectors(spark, odd):
    s = SMALL_TABLE
    docs = odd.where("doc_id IS NULL OR doc_id NOT IN (4, 10)")
    index = random_indexing.index_vectors(s).astype(int)
    assert (np.abs(index).sum(axis=1) <= s.nonzeros).all() and (index.sum(axis=1) == 0).all()
    want = np.zeros((1 << s.log_rows, s.dimensions + 1), np.int64)
    for _, text in rows_of(docs):
        rows = [_row_of(w, s) for w in _plain_words(text, s)]
        for i, r in enumerate(rows):
            want[r, -1] += 1
            for k in range(1, s.window + 1):
                if i + k < len(rows):
                    want[r, :-1] += np.roll(index[rows[i + k]], k)
                if i >= k:
                    want[r, :-1] += np.roll(index[rows[i - k]], -k)
    assert (random_indexing.context_table(docs.repartition(5), s) == want).all()


def test_pooling(odd, given):
    s = SMALL_TABLE
    words = random_indexing.word_vectors(random_indexing.context_table(given, s), s)
    texts = [t for _, t in rows_of(odd)][:3] + [t for _, t in rows_of(given)][:20]
    got = random_indexing.pooled(pa.array(texts), words)
    assert np.allclose(got, random_indexing.pooled(pa.array(texts), words, step=7), atol=1e-5)  # long texts go in stretches
    for x, text in zip(got, texts, strict=True):
        rows = [_row_of(w, s) for w in _plain_words(text, s)]
        if not rows:
            assert not x.any()
            continue
        v, w = words.vectors[rows].astype(float), words.weights[rows].astype(float)[:, None]
        near = [(v[:-k] * v[k:]).sum() / max(len(rows) - k, 1) if len(rows) > k else 0 for k in range(1, s.window + 1)]
        want = [*(v * w).sum(axis=0) / w.sum(), *np.sqrt(((v * w) ** 2).sum(axis=0) / (w**2).sum()), *near, np.log1p(len(rows))]
        assert np.allclose(x, want, atol=1e-4)


def test_network_gradient():
    rng = np.random.default_rng(4)
    z, y, weight = rng.normal(size=(9, 5)), rng.integers(0, 2, 9).astype(float), rng.random(9)
    parameters = [rng.normal(size=(5, 3)), rng.normal(size=3), rng.normal(size=3), rng.normal(size=1)]
    _, gradient = random_indexing.loss_and_gradient(parameters, z, y, weight, 0.1)
    for p, g in zip(parameters, gradient, strict=True):
        for at in np.ndindex(p.shape):
            # The penalty leaves the biases out, as the gradient does.
            old, losses = p[at], []
            for step in (1e-6, -1e-6):
                p[at] = old + step
                losses.append(random_indexing.loss_and_gradient(parameters, z, y, weight, 0.1)[0])
            p[at] = old
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5


def test_temperature_is_found():
    rng = np.random.default_rng(6)
    logits = rng.normal(size=40000) * 2
    y = (rng.random(40000) < 1 / (1 + np.exp(-logits))).astype(float)
    for t in (0.5, 1.0, 3.0):
        assert abs(np.log(random_indexing.fit_temperature(logits * t, y, np.ones(len(y))) / t)) < 0.08


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = random_indexing.predict(docs, random_indexing.fit(docs, labels))
    assert found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out").collect()
    assert all(brute.fold(r["doc_id"], 4) == 2 and r["predicted"] == (r["score"] >= 0.7) for r in held)
    good, bad = ([r for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([r["predicted"] for r in good]) > 0.98 and np.mean([r["predicted"] for r in bad]) < 0.05
    assert abs(np.mean([r["score"] for r in held]) - np.mean([r["quality"] for r in held])) < 0.03  # calibrated


def test_quality_scores_of_odd_rows(odd, none, given, spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = random_indexing.fit(given, labels, random_indexing.QualitySettings(log_rows=10))
    found = random_indexing.predict(odd, model).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(i for i, _ in rows_of(odd))
    empty = {r["score"] for r in found if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (5, 6)}) == 1
    assert random_indexing.predict(none, model).count() == 0
    for marks in (labels.where("doc_id < 0"), spark.createDataFrame([(None, None)], "doc_id long, quality int")):
        plain = random_indexing.fit(none, marks, SMALL_TABLE)
        assert {r["score"] for r in random_indexing.predict(odd, plain).collect()} == {0.5}
    one = random_indexing.fit(odd, spark.createDataFrame([(5, 1), (7, 1), (None, 0)], "doc_id long, quality int"), SMALL_TABLE)
    assert random_indexing.predict(odd, one).count() == odd.count()


def test_sample_holds_documents_only(spark):
    """Labels without a document, and those of the held-out fold, take no place in the sample."""
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(0, 400, 2)] + [(0, "again"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(400)] + [(2, 0), (None, 1)], "doc_id long, quality int")
    chosen, sizes = random_indexing.labelled_sample(docs, labels, random_indexing.QualitySettings(sample_rows=30))
    want = [i for i in range(0, 400, 2) if brute.fold(i, 4) != 2]
    assert sizes == dict(collections.Counter(int(i % 10 > 0 and i != 2) for i in want))
    got = chosen.collect()
    assert collections.Counter(r["y"] for r in got) == {0: min(30, sizes[0]), 1: 30} and {r["doc_id"] for r in got} <= set(want)


# ---- 13 ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def align_settings():
    return merge_path.AlignSettings(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def _aligned(rows, settings):
    tokens = merge_path.Tokenizers(settings)
    counts, found = collections.Counter(), []
    for doc_id, text in rows:
        ((a, b),) = tokens.encode([text or ""])
        a, b = a.tolist(), b.tolist()
        groups = brute.aligned_groups(*([len(t.entries[i]) for i in ids] for t, ids in ((tokens.a_table, a), (tokens.b_table, b))))
        links = [(a[x[-1]], b[y[-1]]) for x, y in groups]
        counts.update(links)
        found.append((doc_id, a, b, links, ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[i]) for i in y) for x, y in groups)))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(i, len(a), len(b), len(links), len(links), groups, sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links)) for i, a, b, links, groups in found]


@pytest.mark.parametrize("name", ["given", "odd"])
@pytest.mark.parametrize("small", [False, True])
def test_alignment(name, small, request, align_settings):
    docs = request.getfixturevalue(name)
    settings = dataclasses.replace(align_settings, piece_work=5, slice_bytes=2000, pending_pairs=300, count_rows=500) if small else align_settings
    got = [tuple(r) for r in merge_path.cross_align(docs, settings, groups=True).collect()]
    assert sorted(got, key=str) == sorted(_aligned(rows_of(docs), settings), key=str)


def test_alignment_digests(given, none, align_settings):
    shown = {r["doc_id"]: r["groups"] for r in merge_path.cross_align(given, align_settings, groups=True).collect()}
    for r in merge_path.cross_align(given, align_settings).collect():
        assert r["groups_sha256"] == (hashlib.sha256(shown[r["doc_id"]].encode()).hexdigest() if r["n_a"] else "")
    assert merge_path.cross_align(none, align_settings).count() == 0


def test_token_bytes_give_the_text_back(odd, align_settings):
    """Special strings are plain text; a text that a tokenizer changes has no tokens."""
    tokens = merge_path.Tokenizers(align_settings)
    texts = ["<|endoftext|> a", "<s> </s> <unk>", "漢字 🤦🏼‍♂️", "tab\tand\nline", " two  spaces ", "a"]
    for text, (a, b) in zip(texts, tokens.encode(texts), strict=True):
        assert len(a) and b"".join(tokens.a_table.entries[i] for i in a) == b"".join(tokens.b_table.entries[i] for i in b) == b" " + text.encode()
        assert max(a) < 50256 and not any(tokens.b.is_control(i) for i in b.tolist())
    assert [len(x) for x in tokens.encode([""])[0]] == [0, 0]
    right = [np.array(tokens.b.encode(t)) for t in texts]
    wanted = [b" " + t.encode() for t in texts]
    wanted[1], wanted[3] = b"?" + wanted[1][1:], wanted[3] + b"!"
    assert tokens.b_table.spells(right, wanted, np.array([True] * 5 + [False])).tolist() == [True, False, True, False, True, False]
    for i, entry in enumerate(tokens.a_table.entries[:50256]):
        if entry.isascii():
            assert tokens.a.decode([i]) == entry.decode()


def test_pieces_are_equal_and_independent():
    rng = np.random.default_rng(13)
    for _ in range(60):
        end = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, end + 1, rng.integers(1, 120)), end)) for _ in range(2))
        both = np.intersect1d(a, b)
        for work in (1, 2, 3, 16, 1000):
            edges = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
            merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
            assert merge_path.diagonal_splits(a, b, edges).tolist() == [sum(k == 0 for _, k in merged[:d]) for d in edges]
            last_a, last_b = merge_path.group_starts(a, b, work)
            assert (a[last_a] == both).all() and (b[last_b] == both).all()

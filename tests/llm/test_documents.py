"""Operators on documents against plain Python versions, on given and on awkward rows."""

import collections
import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest

from terralex.llm import chunk_bpe, curriculum, deleted_interpolation, host_rules, language_id, separator_scan, signature_join, toxic_spans, weighted_sampling
from tests.llm import brute

def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is None, str(v)) for v in x)


# ---- 1 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["given", "odd"])
def test_fingerprints(name, request):
    docs = request.getfixturevalue(name)
    found = weighted_sampling.fingerprint_documents(docs, weighted_sampling.Sampling(coordinates=256)).collect()
    order = sorted(rows_of(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(found) == len(order)
    texts = collections.Counter()
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1] or ""
        texts[doc_id, len(text or ""), hashlib.sha256(weighted_sampling.edited(text or "", following).encode()).hexdigest()] += 1
    got = collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found)
    if name == "given":
        assert got == texts
        want = [brute.generalised_jaccard(t, weighted_sampling.edited(t, order[(i + 1) % len(order)][1])) for i, (_, t) in enumerate(order)]
        near = [r["near_edited"] for r in sorted(found, key=lambda r: r["doc_id"])]
        assert abs(np.mean(near) - np.mean(want)) < 0.01 and np.abs(np.array(near) - want).mean() < 0.035
    else:
        same = {r["fingerprint"] for r in found if r["doc_id"] in (5, 6)}
        assert len(same) == 1 and all(0 <= r["near_next"] <= 1 for r in found)


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(1)
    sampler = weighted_sampling.WeightedSampler(4096)
    for _ in range(4):
        a, b = (" ".join(np.repeat([f"w{i}" for i in range(30)], rng.integers(0, 6, 30))) for _ in range(2))
        prints = sampler.fingerprints(pa.array([a, b]))
        assert abs(weighted_sampling.likeness(prints[0], prints[1]) - brute.generalised_jaccard(a, b)) < 0.03


# ---- 3 and 5 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["given", "odd"])
def test_chunked_encoding_equals_the_library(name, request):
    from tokenizers import Tokenizer

    docs, path = request.getfixturevalue(name), vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    found = chunk_bpe.encode_documents(docs, chunk_bpe.ChunkSettings(path, average=64), digests=False).collect()
    want = []
    for doc_id, text in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted([(r["doc_id"], r["n_tokens"], list(r["ids"]), r["decoded"]) for r in found], key=key) == sorted(want, key=key)


def test_chunks_are_shared_wherever_they_stand(spark):
    passage = " ".join(f"word{i * 7919}" for i in range(2000))
    docs = spark.createDataFrame([(1, "intro " + passage), (2, passage + " outro"), (3, "zz yy " * 9 + passage)], "doc_id long, text string")
    from pyspark.sql import functions as F

    settings = chunk_bpe.ChunkSettings("", average=256)
    keys = chunk_bpe.chunk_keys(docs.withColumn("content", F.unhex(F.md5("text"))).select("doc_id", "content", "text"), settings).collect()
    counts = collections.Counter((r["a"], r["b"]) for r in keys)
    assert sum(n == 3 for n in counts.values()) > 0.8 * len(counts)


def test_a_wrong_stored_chunk_is_repaired(spark, monkeypatch):
    """Stored tokens that are not those of their chunk, as after a clash of keys, do not reach a document."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(7)
    passage = " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(1500))
    docs = spark.createDataFrame([(1, "intro " + passage), (2, passage + " outro"), (3, "zz yy, " * 9 + passage)], "doc_id long, text string")
    path = vocabulary("word_bpe_49k.json")
    usual = chunk_bpe.encode_shared

    def reversed_tokens(rows, settings):
        def run(batches):
            for batch in batches:
                ids = [chunk_bpe.pack(np.frombuffer(chunk_bpe.unpack(x), np.uint16)[::-1].tobytes()) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ids, pa.binary())], names=["a", "b", "ids"])

        return usual(rows, settings).mapInArrow(run, "a long, b long, ids binary")

    monkeypatch.setattr(chunk_bpe, "encode_shared", reversed_tokens)
    library = Tokenizer.from_file(path)
    found = chunk_bpe.encode_documents(docs, chunk_bpe.ChunkSettings(path, average=128), digests=False).collect()
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in rows_of(docs)}
    assert {r["doc_id"]: list(r["ids"]) for r in found} == want


@pytest.mark.parametrize("block", [7, 1 << 21])
def test_token_files_are_counted_across_blocks(spark, odd, block):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    ranks = separator_scan.Ranks(vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = odd.where("doc_id IS NULL OR doc_id NOT IN (4, 10)") if block == 7 else odd
    options = separator_scan.TokenFiles(block_tokens=block)
    folder, written = separator_scan.write_token_files(docs.repartition(3), ranks, options)
    found = separator_scan.count_tokens(spark, folder, options).join(written, ["file", "ordinal"], "full").collect()
    encoding = ranks.encoding()
    assert isinstance(encoding, tiktoken.Encoding)
    want = collections.Counter((i, len(encoding.encode_ordinary(t or ""))) for i, t in rows_of(docs))
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in found) == want and all(r["closed"] for r in found)


def test_token_file_without_last_separator(spark, tmp_path):
    ids = np.array([5, 9, 9, 5, 1, 2, 9, 3, 3, 3, 3], "<u2")
    (tmp_path / "a.bin").write_bytes(ids.tobytes())
    (tmp_path / "b.bin").write_bytes(b"")
    for block in (1, 2, 3, 100):
        found = separator_scan.count_tokens(spark, f"file://{tmp_path}", separator_scan.TokenFiles(separator=9, block_tokens=block)).orderBy("ordinal").collect()
        assert [(r["file"], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in found] == [
            ("a.bin", 0, 0, 1, True), ("a.bin", 1, 2, 0, True), ("a.bin", 2, 3, 3, True), ("a.bin", 3, 7, 4, False)]


# ---- 4 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["given", "odd"])
def test_host_rules(name, request):
    docs = request.getfixturevalue(name)
    found = host_rules.score_documents(docs).collect()
    got = sorted([(r["doc_id"], *(r[f] for f in host_rules.FEATURES)) for r in found], key=key)
    assert got == sorted([(i, *brute.rules(t)) for i, t in rows_of(docs)], key=key)
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["host_rate"] <= 0.5)
    kept = host_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in found)


def test_bad_host_takes_its_documents_with_it(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good if i % 20 == 0 else "short", "bad") for i in range(200)] + [(1000 + i, good + str(i), f"s{i % 9}") for i in range(300)]
    found = {r["doc_id"]: r for r in host_rules.score_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(found[i]["kept"] for i in range(200)) and all(found[1000 + i]["kept"] for i in range(300))
    assert 0.5 < found[0]["host_rate"] < 0.95  # shrunk towards the mean of the hosts


# ---- 6 ----------------------------------------------------------------------------------------------------


def test_near_duplicates(given):
    rows = sorted(rows_of(given))
    found = signature_join.memberships(given).orderBy("doc_id").collect()
    sizes, labels = brute.components([i for i, _ in rows], [t for _, t in rows])
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in found] == [(n, c, c == i) for (i, _), n, c in zip(rows, sizes, labels, strict=True)]


def test_near_duplicate_groups_and_chains(spark):
    """A group of copies with single changes, a chain whose ends are far apart, and texts that share half."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.integers(200)] = f"c{i}"
        rows.append(" ".join(copy))
    chain = [f"k{i}" for i in range(160)]
    for i in range(12):
        chain = chain[3:] + [f"n{i}-{j}" for j in range(3)]
        rows.append(" ".join(chain))
    half = " ".join(f"h{i}" for i in range(120))
    rows += [half + " " + " ".join(f"u{i}-{j}" for j in range(80)) for i in range(30)]
    rows += ["few words", "Few  WORDS", "few", "", None]
    ids = list(range(10, 10 + len(rows)))
    found = signature_join.memberships(spark.createDataFrame(list(zip(ids, rows, strict=True)), "doc_id long, text string")).orderBy("doc_id").collect()
    sizes, labels = brute.components(ids, rows)
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found] == list(zip(ids, sizes, labels, strict=True))


def changed(words, positions, mark):
    return " ".join(f"{mark}{k}" if k in positions else w for k, w in enumerate(words))


@pytest.mark.parametrize("turned", [False, True])
def test_rows_of_one_id_keep_the_links_of_each_text(spark, turned):
    """Document 1 has two texts; 2 is a near copy of the second, 3 of the first, in both orders of the rows."""
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, changed(b, {5}, "x")), (3, changed(a, {9}, "y")), (4, "a text of its own words")]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in signature_join.memberships(docs).collect()} == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)}
    assert {(r["doc_id"], r["text"]) for r in signature_join.keep_one_of_each(docs).collect()} == {rows[0], rows[1], rows[4]}


def test_rows_without_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(None, a), (7, a), (None, b), (None, b.upper()), (None, "c d"), (None, None), (None, "")], "doc_id long, text string")
    kept = collections.Counter((r["doc_id"], (r["text"] or "").lower()) for r in signature_join.keep_one_of_each(docs).collect())
    assert kept == {(7, a): 1, (None, b): 1, (None, "c d"): 1, (None, ""): 2}


def unresolved(spark, n, rng):
    """n texts that share a fifth of their words, half of them near copies of another one; their hub is given."""
    base, rows = [f"s{i}" for i in range(30)], []
    for i in range(n // 2):
        own = base + [f"u{i}-{k}" for k in range(120)]
        rows += [own, [f"v{i}" if k == 100 + int(rng.integers(40)) else w for k, w in enumerate(own)]]
    texts = [" ".join(r) for r in rows]
    ids = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "id long, text string")
    hubs = spark.createDataFrame([(1, i + 1) for i in range(1, n)], "a long, b long")
    return ids, hubs, {(2 * i + 1, 2 * i + 2) for i in range(n // 2)}


def test_large_unresolved_hubs(spark):
    """Far more members than a block: every link comes out, and rows grow with the members, not with their square."""
    rng, sizes = np.random.default_rng(4), {}
    options = signature_join.NearDuplicates(block_rows=8, signature_blocks=2)
    labels = spark.createDataFrame([], "id long, label long")
    for n in (60, 240):
        texts, hubs, want = unresolved(spark, n, rng)
        fine = signature_join.materialise(signature_join.fine_signatures(texts, options))
        members = signature_join.unresolved_members(hubs, labels, options)
        lists = signature_join.meeting_lists(members, fine, options)
        blocks = signature_join.blocks_beside(lists, options)
        found = signature_join.materialise(signature_join.candidate_members(blocks, fine, options))
        links = {tuple(sorted((r["a"], r["b"]))) for r in signature_join.link_lists(found, fine, options).collect()}
        assert links == want
        sizes[n] = blocks.count(), found.select("id").distinct().count()
    assert sizes[240][0] <= 6 * sizes[60][0] and sizes[240][1] == 240


@pytest.mark.parametrize("rows", [3, 1024])
def test_blocks_change_no_component(spark, rows):
    """Boilerplate shared by unlike texts of which some are near copies: the same components for any block size."""
    rng = np.random.default_rng(9)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for i in range(40):
        own = shared + [f"u{i // 3}-{k}" for k in range(60)]
        texts.append(changed(own, set(rng.integers(0, 120, 2).tolist()), f"m{i}-"))
    ids = list(range(1, 41))
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    found = signature_join.memberships(docs, signature_join.NearDuplicates(block_rows=rows, signature_blocks=2)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == brute.components(ids, texts)[1]


def test_near_duplicates_of_odd_rows(odd):
    found = signature_join.memberships(odd).collect()
    by_id = collections.defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["component_id"], r["kept"]))
    assert by_id[6] == {(5, False)} and by_id[7] == {(5, False)} and by_id[12] == {(11, False)} and by_id[1] == {(1, True)} and by_id[2] == {(2, True)}
    kept = signature_join.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id < 13").collect()) == [1, 2, 3, 4, 5, 8, 9, 10, 11]


# ---- 7 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["given", "odd"])
def test_mixture(name, request):
    docs, options = request.getfixturevalue(name), curriculum.Curriculum(rows_per_block=20)
    found = curriculum.mix(docs, options).collect()
    assert sorted([r["doc_id"] for r in found], key=lambda i: (i is None, i)) == sorted([i for i, _ in rows_of(docs)], key=lambda i: (i is None, i))
    sizes = collections.Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(brute.words(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute.targets(sizes, {s: options.weights[i % 3] for i, s in enumerate(order)}, 3)
    taken = collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], abs_tol=1e-6) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    again = curriculum.mix(docs.repartition(5), curriculum.Curriculum(rows_per_block=3)).collect()
    assert sorted((key((r["doc_id"], r["size"], r["taken"]))) for r in again) == sorted((key((r["doc_id"], r["size"], r["taken"]))) for r in found)


def test_training_order(given):
    places = {(r["doc_id"], r["copy"]): r["position"] for r in curriculum.training_rows(curriculum.mix(given)).collect()}
    ordered = curriculum.training_order(given, 3)
    assert ordered.columns == given.columns
    got = [r["doc_id"] for r in ordered.collect()]
    assert collections.Counter(got) == collections.Counter(i for i, _ in places)
    seen, positions = collections.Counter(), []
    by_doc = collections.defaultdict(list)
    for (i, _), p in places.items():
        by_doc[i].append(p)
    for i in got:
        positions.append(sorted(by_doc[i])[seen[i]])
        seen[i] += 1
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1


def test_position_inverts_the_demand(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(a, b, 1000.0, t) for a, b in ((1.5, 0.5), (0.5, 1.5), (1.0, 1.0)) for t in (0.0, 0.1, 0.5, 0.9, 1.0)], "start double, end double, target double, t double")
    demand = F.col("target") * (F.col("start") * F.col("t") + (F.col("end") - F.col("start")) * F.col("t") ** 2 / 2) / ((F.col("start") + F.col("end")) / 2)
    assert all(abs(r["t"] - r["p"]) < 1e-9 for r in rows.withColumn("p", curriculum.position_of(demand)).collect())


# ---- 8 ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["given", "odd"])
def test_deleted_interpolation(name, request):
    docs = request.getfixturevalue(name)
    options = deleted_interpolation.Interpolation(group_bytes=1 << 16, slot_bytes=1 << 17)
    scorer = deleted_interpolation.Scorer(docs, options)
    weights = scorer.weights()
    assert np.allclose(weights.sum(axis=1), 1) and (weights > 0).all()
    rows = rows_of(docs)
    one, two = brute.language_model(rows)
    want = sorted([(i, brute.fold(i, 5) == 1, *(round(x, 4) for x in brute.language_scores(t, one, two, weights, options.buckets))) for i, t in rows], key=key)
    got = sorted([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in scorer.scores().collect()], key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=2e-3)


def test_weights_are_learned_on_every_group(spark):
    """Many groups: the weights are those of all events of the fold, counted by plain Python."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 40)) % 500)) for i in range(400)]
    options = deleted_interpolation.Interpolation(group_bytes=512, slot_bytes=1 << 12)
    scorer = deleted_interpolation.Scorer(spark.createDataFrame(rows, "doc_id long, text string"), options)
    assert scorer.groups > 40
    fold = {i: brute.fold(i, options.folds) for i, _ in rows}
    one, two, events = collections.Counter(), collections.Counter(), []
    for i, text in rows:
        seen = [None, *brute.words(text), ""]  # the start, and the end of a text
        if fold[i] == options.em_fold:
            events += zip(seen[:-1], seen[1:], strict=True)
        elif fold[i] != options.held_out_fold:
            one.update(seen[1:])
            two.update(zip(seen[:-1], seen[1:], strict=True))
    vocabulary = {w for i, t in rows if fold[i] != options.held_out_fold for w in [*brute.words(t), ""]}
    context = np.array([one["" if a is None else a] for a, _ in events])
    p2, p1 = np.array([two[e] for e in events]) / np.maximum(context, 1), np.array([one[b] for _, b in events]) / sum(one.values())
    near = [np.where(x > 0, 2.0 ** (np.round(8 * np.log2(np.maximum(x, 1e-300))) / 8), 0) for x in (p1, p2)]
    p, n = np.column_stack([np.full(len(events), 1 / (len(vocabulary) + 1)), *near]), np.ones(len(events))
    em, k = deleted_interpolation.expectation_maximisation, options.buckets
    pooled = em(np.zeros(len(events), int), p, n, 1, np.full((1, 3), 1 / 3), options.iterations)
    want = em(np.floor(np.log2(context + 1)).astype(int), p, n, k, np.repeat(pooled, k, axis=0), options.iterations)
    assert np.allclose(scorer.weights(), want, atol=1e-9)


def test_messages_grow_with_the_input(spark):
    """Twice the documents send about twice the rows between groups and slots, not four times."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 10**6, 15))) for i in range(16000)]
    options = deleted_interpolation.Interpolation(group_bytes=512, slot_bytes=1 << 11, messages=2)
    sent = [deleted_interpolation.Scorer(spark.createDataFrame(rows[:n], "doc_id long, text string"), options).totals.where("grp >= 0").count() for n in (4000, 8000, 16000)]
    assert sent[1] < 2.2 * sent[0] and sent[2] < 2.2 * sent[1]


def test_equal_rows_travel_once(spark):
    from pyspark.sql import functions as F

    hot, rest = [(None, "a b a")] * 3000 + [(7, "c b")] * 40, [(i, f"b x{i}") for i in range(100)]
    docs = spark.createDataFrame(hot + rest, "doc_id long, text string").repartition(3)
    options = deleted_interpolation.Interpolation()
    scorer = deleted_interpolation.Scorer(docs, options)
    packed = scorer._packed(scorer.inner)
    assert packed.where("doc_id IS NULL").count() == 3 and packed.agg(F.sum("copies")).first()[0] == 3140
    one, two = brute.language_model(hot + rest)
    weights = scorer.weights()
    want = sorted([(i, *(round(x, 4) for x in brute.language_scores(t, one, two, weights, options.buckets))) for i, t in hot + rest], key=key)
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in scorer.scores().collect()], key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=2e-3)


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    p = rng.random((4000, 3)) ** 3
    truth = np.array([0.2, 0.3, 0.5])
    n = p @ truth  # expected counts of events whose likelihood the mixture describes
    density = p / p.sum(axis=0)
    weights = deleted_interpolation.expectation_maximisation(np.zeros(4000, int), density, 1e6 * (density @ truth), 1, np.full((1, 3), 1 / 3), 3000)
    assert np.abs(weights[0] - truth).max() < 0.02 and n.shape == (4000,)


# ---- 9 ----------------------------------------------------------------------------------------------------


def _brute_marginals(tokens, emission, length, model):
    """All chains of states, summed one by one."""
    import itertools

    moves = np.exp(model.transitions)
    local = np.full(length, model.bias)
    local[tokens] += emission
    total, hot = 0.0, np.zeros(length)
    for states in itertools.product((0, 1), repeat=length):
        weight, previous = 1.0, 0
        for i, s in enumerate(states):
            weight *= moves[previous, s] * math.exp(local[i] * s)
            previous = s
        total += weight
        hot += weight * np.array(states)
    return hot[tokens] / total


def test_marginals_are_exact():
    rng = np.random.default_rng(5)
    settings = toxic_spans.ToxicSettings()
    for _ in range(20):
        model = toxic_spans.ToxicModel(np.zeros(0, np.uint64), np.zeros(0), rng.normal() - 1, rng.normal(size=(2, 2)), np.zeros(3), settings)
        lengths = [int(rng.integers(1, 11)) for _ in range(3)]
        before = np.concatenate([[0], np.cumsum(lengths)])
        places = [np.sort(rng.choice(n, rng.integers(0, n + 1), replace=False)) for n in lengths]
        emissions = [rng.normal(size=len(p)) * 2 for p in places]
        got = toxic_spans.marginals(np.concatenate([p + b for p, b in zip(places, before, strict=False)]).astype(int), np.concatenate(emissions), before, model)
        want = np.concatenate([_brute_marginals(p, e, n, model) for p, e, n in zip(places, emissions, lengths, strict=True)])
        assert np.allclose(got, want)


def test_gradient_of_the_field():
    """Label likelihoods by all state sequences of small documents, and their differences."""
    import itertools

    rng = np.random.default_rng(9)
    s = toxic_spans.ToxicSettings(segment=4, chains_at_once=2)
    docs, toxic = [], np.array([1, 0, 1, 0, 1])
    for length in (3, 6, 1, 4, 9):
        token = np.sort(rng.integers(0, length, 5))
        docs.append(toxic_spans.Sampled(length, token, rng.integers(0, 3, 5)))
    chains = toxic_spans._chains(docs, s.segment)
    parameters = rng.normal(size=8)

    def likelihood(x):
        total, moves = 0.0, np.exp(x[4:].reshape(2, 2))
        for d, y in zip(docs, toxic, strict=True):
            local = np.full(d.length, x[3])
            np.add.at(local, d.token, x[:3][d.feature])
            clean = 1.0
            for a in range(0, d.length, s.segment):
                part = local[a : a + s.segment]
                paths = [math.prod(moves[p, q] * math.exp(v * q) for p, q, v in zip((0, *states), states, part, strict=False)) for states in itertools.product((0, 1), repeat=len(part))]
                clean *= paths[0] / sum(paths)
            total += math.log(1 - clean) if y else math.log(clean)
        return total

    value, gradient = toxic_spans.field_gradient(parameters, chains, toxic, 3, s)
    assert math.isclose(value, likelihood(parameters), rel_tol=1e-9)
    for i in range(8):
        step = np.eye(8)[i] * 1e-6
        assert math.isclose(gradient[i], (likelihood(parameters + step) - likelihood(parameters - step)) / 2e-6, rel_tol=1e-4, abs_tol=1e-6)


def test_runs_without_features_are_shortened():
    assert toxic_spans.shortened(100, np.zeros(0, int), 8)[0] == 8
    length, token = toxic_spans.shortened(100, np.array([20, 20, 23, 60, 99]), 8)
    assert token.tolist() == [8, 8, 11, 20, 29] and length == 30


@pytest.mark.parametrize("words", [200, 400])
def test_rare_toxic_words_are_learned(spark, words):
    """Two of many toxic words in every toxic document: each word stands in few of them."""
    rng = np.random.default_rng(2)
    syllables = [a + b for a in ("ta", "re", "mi", "so", "lu", "pe", "ka") for b in ("na", "to", "ri", "ka", "vel", "dum", "sh")]
    plain = ["".join(rng.choice(syllables, 2)) for _ in range(3000)]
    bad = ["".join(rng.choice(list("qwkjvbxz"), 5)) for _ in range(words)]
    rows = []
    for i in range(8000):
        text = list(rng.choice(plain, rng.integers(5, 80)))
        for _ in range(2 if i % 4 == 0 else 0):
            text.insert(int(rng.integers(len(text))), str(rng.choice(bad)))
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(8000)], "doc_id long, toxic int")
    held = [r for r in toxic_spans.predict(docs, toxic_spans.fit(docs, labels)).collect() if r["held_out"]]
    assert np.mean([r["predicted"] for r in held if r["doc_id"] % 4 == 0]) > 0.9 and np.mean([r["predicted"] for r in held if r["doc_id"] % 4]) < 0.02


def _toxic_rows(spark, n=400):
    rng = np.random.default_rng(2)
    plain = [f"{a}{b}" for a in ("ta", "re", "mi", "so", "lu", "pe") for b in ("na", "to", "ri", "ka", "vel", "dum")]
    rows, labels = [], []
    for i in range(n):
        text = list(rng.choice(plain, rng.integers(5, 80)))
        toxic = i % 5 == 0
        for _ in range(2 * toxic):
            text.insert(int(rng.integers(len(text))), "grobl" + str(rng.choice(plain)))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_spans_on_held_out_documents(spark):
    docs, labels = _toxic_rows(spark)
    model = toxic_spans.fit(docs, labels)
    found = {r["doc_id"]: r for r in toxic_spans.predict(docs, model).collect()}
    texts = dict(rows_of(docs))
    held = [i for i in found if brute.fold(i, 4) == 2]
    assert held and all(found[i]["held_out"] == (brute.fold(i, 4) == 2) for i in found)
    assert np.mean([found[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    for i in held:
        for span in found[i]["spans"]:
            assert all(w.startswith("grobl") for w in texts[i][span["start"] : span["end"]].split())


def test_toxic_scores_of_odd_rows(odd, none, spark):
    docs, labels = _toxic_rows(spark)
    model = toxic_spans.fit(docs, labels)
    found = toxic_spans.predict(odd, model).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    kept = toxic_spans.keep_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    unlabelled = toxic_spans.fit(odd, labels.where("doc_id < 0"))
    assert toxic_spans.predict(none, unlabelled).count() == 0 and toxic_spans.predict(odd, unlabelled).where("predicted = 1").count() == 0


# ---- 10 ---------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.98
    assert all(brute.fold(r["doc_id"], 4) == 2 for r in found)
    # Calibrated: the mean confidence is near the accuracy.
    assert abs(np.mean([r["score"] for r in found]) - np.mean([r["lang"] == r["lang_pred"] for r in found])) < 0.03


def test_rare_languages_are_learned(spark):
    """Documents of a rare language whose id hashes are the largest of all, so that no sample over all rows has them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    syllables = {"aa": "ta re mi so lu pe".split(), "bb": "gro ksu vny dzi shk bro".split(), "cc": "wai ohu eia ueo aio hau".split()}
    hashes = spark.range(12000).select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 32)).alias("h")).orderBy("h").collect()
    training = [r["id"] for r in hashes if brute.fold(r["id"], 4) != 2]
    rare = {*training[-25:], *[r["id"] for r in hashes if brute.fold(r["id"], 4) == 2][:5]}
    lang = {r["id"]: "cc" if r["id"] in rare else ("aa", "bb")[r["id"] % 2] for r in hashes}
    rows = [(i, " ".join("".join(rng.choice(syllables[g], 3)) for _ in range(12)), g) for i, g in lang.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["aa", "bb", "cc"]
    found = [r for r in language_id.predict(docs, model).collect() if r["held_out"]]
    assert sum(lang[r["doc_id"]] == "cc" for r in found) == 5
    assert all(r["lang_pred"] == lang[r["doc_id"]] for r in found)


def test_language_sample_is_bounded_in_each_language(spark):
    rows = [(i, f"t{i}", "a") for i in range(3000)] + [(5000 + i, f"t{i}", "b") for i in range(60)] + [(9000, "x", "c")] + [(9001, f"t{i}", "d") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = language_id.language_sizes(docs)
    assert {g: n for g, (n, _) in sizes.items()} == {"a": 3000, "b": 60, "c": 1, "d": 900}
    found = language_id.language_sample(docs, sizes, 50)
    assert collections.Counter(r["lang"] for r in found) == {"a": 50, "b": 50, "c": 1, "d": 50}
    held = language_id._calibration_rows(np.array([0] * 10 + [1] * 4 + [0] * 5), 0.2)
    assert np.flatnonzero(held).tolist() == [0, 1, 2]


def test_language_of_odd_rows(odd, none, given):
    model = language_id.fit(given)
    found = language_id.predict(odd, model).collect()
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3) or r["doc_id"] is None and r["score"] == 0) for r in found)
    empty = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}


def test_texts_without_a_letter_have_no_language(spark, given):
    texts = ["²", "½ 3", "①", "1 2 3 !", "_", "漢", "é", "a1", "٣", "ª"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, language_id.fit(given)).collect()}
    assert [found[i] == "und" for i in range(len(texts))] == [not any(c.isalpha() for c in t) for t in texts]


def test_document_frequencies_cover_all_rows(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(["abab", "ba", None, "", "zz"])], "doc_id long, text string, lang string")
    settings = language_id.LanguageSettings(orders=(1, 2), log_features=12)
    found, rows = language_id.document_frequencies(docs, settings)
    want = np.zeros(1 << 12, int)
    for text in ("abab", "ba", "", "", "zz"):
        features, _ = language_id.ngram_features([text], settings)
        want[np.unique(features)] += 1
    assert rows == 5 and (found == want).all()


# ---- all --------------------------------------------------------------------------------------------------


def test_empty_tables(none, spark):
    assert weighted_sampling.fingerprint_documents(none).count() == 0
    assert chunk_bpe.encode_documents(none, chunk_bpe.ChunkSettings(vocabulary("word_bpe_49k.json"))).count() == 0
    assert host_rules.score_documents(none).count() == 0 and host_rules.keep_documents(none).count() == 0
    assert signature_join.memberships(none).count() == 0 and signature_join.keep_one_of_each(none).count() == 0
    assert curriculum.mix(none).count() == 0 and curriculum.training_order(none, 2).count() == 0
    assert deleted_interpolation.score_documents(none).count() == 0
    assert language_id.predict(none, language_id.fit(none)).count() == 0
    import public_tokenizers

    folder, written = separator_scan.write_token_files(none, separator_scan.Ranks(vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
    assert written.count() == 0 and separator_scan.count_tokens(spark, folder).count() == 0

"""Near-duplicate documents by an inverted join of MinHash signatures.

Documents with equal shingle sets are one class. Every class posts its signature under each coordinate-value
pair. A pair of classes whose sets overlap by 0.75 agrees on 48 of 64 coordinates on average and on fewer than
32 with a probability below 4e-6, so at least 32 agreements are asked for: values held by one class only are
dropped, then classes with fewer than 32 shared values, and of the rest the rarest values only, as many as must
contain one that the partner posts too (the prefix). Candidates are skipped unless their set sizes allow the
overlap, their agreements are counted over all coordinates, and pairs at or above the match threshold are
confirmed on the full shingle sets of the texts.

Not all pairs of a group are needed for its component. Each posting list first proposes its smallest member, its hub, to
all others; confirmed links are joined into components. Two documents that share a list share its hub, so what
is left are pairs of one hub's members in different components. They are not paired by a join: a hub's members
meet in blocks, where longer signatures, without texts, are compared as vectors. A hub of more members than a
block is first split by bands of those signatures: only members that agree on a whole band meet. The texts of
members that have a candidate in another component follow, candidates are confirmed and only the links that join
components come out. No link between components is lost, and a group of n near copies costs about n rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralex.llm.common import Texts, _powers, cuts, mix
from terralex.llm.packing import pack, unpack
from terralex.session import materialise, small_side


@dataclass(frozen=True)
class NearDuplicates:
    words: int = 5
    percent: int = 75
    coordinates: int = 64
    matches: int = 32
    #: Inside unresolved lists: coordinates of one byte each. 0.75 gives 384 agreements of 512 on average and fewer
    #: than 334 with a probability below 1e-6.
    fine_coordinates: int = 512
    fine_matches: int = 334
    #: Agreement on one of 85 bands of six coordinates: a pair at 0.75 has none with a probability below 1e-7.
    band: int = 6
    block_rows: int = 1024  # whose texts a task holds, twice
    signature_blocks: int = 4  # of those blocks together while only signatures are compared
    broadcast_ids: int = 1_000_000


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; of fewer words, the whole sequence."""
    t = Texts(texts, lower=True)
    starts, ends, before = t.words()
    tokens = t.hashes(starts, ends)
    up, down = _powers(len(tokens) + 1)
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
    for a, b in zip(before[:-1], before[1:], strict=True):
        if b - a < words:
            span = (sums[b : b + 1] - sums[a : a + 1]) * down[a] + np.uint64(b - a)
            yield mix(span) if b > a else np.zeros(0, np.uint64)
        else:
            yield np.unique(mix((sums[a + words : b + 1] - sums[a : b + 1 - words]) * down[a : b + 1 - words] + np.uint64(words)))


class MinHash:
    def __init__(self, coordinates: int):
        seeds = mix(np.arange(2 * coordinates, dtype=np.uint64))
        self.flip, self.times = seeds[:coordinates], seeds[coordinates:] | np.uint64(1)

    def signature(self, values: np.ndarray) -> np.ndarray:
        least = np.full(len(self.flip), np.iinfo(np.uint64).max)
        for at in range(0, len(values), 4096):
            part = values[at : at + 4096, None]
            np.minimum(least, ((part ^ self.flip) * self.times).min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """doc_id, content (a hash of the text as it stands), n_shingles, a 128-bit hash of the shingle set, signature."""
    inner = docs.select("doc_id", F.xxhash64("text").alias("content"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(options.coordinates)
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                sizes, first, second, rows = [], [], [], []
                for values in shingle_sets(part.column("text"), options.words):
                    sizes.append(len(values))
                    first.append(mix(values + np.uint64(1)).sum(dtype=np.uint64))
                    second.append(mix(values + np.uint64(2)).sum(dtype=np.uint64))
                    rows.append(family.signature(values) if len(values) else None)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("content"), pa.array(sizes, pa.int64()),
                    *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (first, second)), pa.array(rows, pa.list_(pa.int32())),
                ], names=["doc_id", "content", "n_shingles", "set_a", "set_b", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return inner.mapInArrow(run, f"doc_id {kind}, content long, n_shingles long, set_a long, set_b long, signature array<int>")


def prefix_postings(classes: DataFrame, options: NearDuplicates) -> DataFrame:
    """(posting, id) of every class's prefix.

    A posting is one coordinate and its value, so one value of a third of all classes is still only that share
    of one of the 64 coordinates.
    """
    posting = classes.select("id", F.posexplode("signature").alias("k", "v")).select(
        F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("posting"), "id")
    counts = posting.groupBy("posting").agg(F.count("*").alias("n")).where("n > 1")
    shared = posting.join(counts, "posting")
    own = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("own"))
    alive = own.where(F.size("own") >= options.matches)
    return alive.select("id", F.explode(F.slice("own", F.lit(1), F.size("own") - options.matches + 1)).alias("p")).select("p.posting", "id")


def hub_pairs(postings: DataFrame) -> DataFrame:
    """Each member of a posting list with the list's smallest member."""
    hubs = postings.groupBy("posting").agg(F.min("id").alias("hub"))
    return postings.join(hubs, "posting").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()


def unresolved_members(hubs: DataFrame, labels: DataFrame, options: NearDuplicates) -> DataFrame:
    """(hub, n, id, label): the members of every hub that has members of several components, and their number."""
    members = hubs.select(F.col("a").alias("hub"), F.col("b").alias("id")).unionAll(hubs.select(F.col("a").alias("hub"), F.col("a").alias("id")).distinct())
    named = materialise(members.join(labels.withColumnRenamed("id", "_v"), F.col("id") == F.col("_v"), "left").select("hub", "id", F.coalesce("label", "id").alias("label")))
    return named.join(_several_components(named, options, "hub"), "hub").select("hub", "n", "id", "label")


def _several_components(members: DataFrame, options: NearDuplicates, *keys: str) -> DataFrame:
    """(keys, n) of the lists that hold several components; small enough, they are sent to the members' tasks, so
    that no list's members are brought together for it."""
    lists = members.groupBy(*keys).agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return small_side(materialise(lists.select(*keys, "n")), options.broadcast_ids)


def meeting_lists(members: DataFrame, fine: DataFrame, options: NearDuplicates) -> DataFrame:
    """(hub, band, value, n, id, label): lists whose members are to be compared. A hub that fits one block of
    signatures is a list of its own; of a larger one, the members that agree on a band are."""
    whole = options.block_rows * options.signature_blocks
    small = members.where(F.col("n") <= whole).select("hub", F.lit(-1).alias("band"), F.lit(b"").alias("value"), "n", "id", "label")
    bands = F.transform(F.sequence(F.lit(0), F.lit(options.fine_coordinates // options.band - 1)), lambda k: F.struct(
        k.alias("band"), F.substring(F.col("fine"), k * options.band + 1, F.lit(options.band)).alias("value")))
    large = members.where(F.col("n") > whole).join(fine.select("id", "fine"), "id").select("hub", "id", "label", F.explode(bands).alias("b"))
    large = materialise(large.select("hub", "b.band", "b.value", "id", "label"))
    split = large.join(_several_components(large, options, "hub", "band", "value"), ["hub", "band", "value"])
    return small.unionByName(split)


def blocks_beside(lists: DataFrame, options: NearDuplicates) -> DataFrame:
    """Every member of a list in the blocks of signatures it meets: columns i <= j, and its block of texts `own`."""
    dealt = lists.withColumn("own", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / options.block_rows)).cast("int"))
    dealt = dealt.withColumn("_at", F.floor(F.col("own") / options.signature_blocks).cast("int"))
    last = F.ceil(F.ceil(F.col("n") / options.block_rows) / options.signature_blocks).cast("int") - 1
    beside = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    return beside.select("hub", "band", "value", F.least("_at", "_other").alias("i"), F.greatest("_at", "_other").alias("j"), "own", "id", "label")


def fine_signatures(texts: DataFrame, options: NearDuplicates) -> DataFrame:
    """id, fine (one byte of each of many MinHash coordinates), packed (the text)."""
    inner = texts.select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash(options.fine_coordinates)
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                fine = [family.signature(v).view(np.uint8)[::4].tobytes() if len(v) else b"" for v in shingle_sets(part.column("text"), options.words)]
                packed = [pack((t or "").encode()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fine, pa.binary()), pa.array(packed, pa.binary())], names=["id", "fine", "packed"])

    return inner.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, fine binary, packed binary")


def _bits(table: pa.Table, options: NearDuplicates) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, label numbers, members to ask) of a block: any pair across components has a member outside the
    most frequent component."""
    bits = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(table.num_rows, options.fine_coordinates)
    numbers: dict = {}
    label = np.array([numbers.setdefault(str(x), len(numbers)) for x in table.column("label").to_pylist()], np.int64)
    return bits, label, np.flatnonzero(label != np.bincount(label).argmax())


def candidate_members(blocks: DataFrame, fine: DataFrame, options: NearDuplicates) -> DataFrame:
    """(hub, band, value, x, y, id, label): members whose signatures agree often enough with one of another
    component, under the two blocks of texts that they and it stand in. Members come out, not pairs."""
    columns = ["hub", "band", "value"]

    def run(table: pa.Table) -> pa.Table:
        bits, label, asking = _bits(table, options)
        own = table.column("own").to_numpy()
        found: dict[tuple, set] = {}
        for i in asking:
            near = np.flatnonzero((np.count_nonzero(bits == bits[i], axis=1) >= options.fine_matches) & (label != label[i]))
            for block in np.unique(own[near]):
                members = found.setdefault((min(own[i], block), max(own[i], block)), set())
                members.add(int(i))
                members.update(near[own[near] == block].tolist())
        rows = [(x, y, m) for (x, y), members in found.items() for m in sorted(members)]
        part = table.select([*columns, "id", "label"]).take(pa.array([m for *_, m in rows], pa.int64()))
        x, y = (pa.array([r[k] for r in rows], pa.int32()) for k in (0, 1))
        return pa.table([*(part.column(c) for c in columns), x, y, part.column("id"), part.column("label")], names=[*columns, "x", "y", "id", "label"])

    kind = blocks.schema["id"].dataType.simpleString()
    rows = blocks.join(fine.select("id", "fine"), "id").select(*columns, "i", "j", "own", "id", "label", "fine")
    return rows.groupBy(*columns, "i", "j").applyInArrow(run, f"hub {kind}, band int, value binary, x int, y int, id {kind}, label {kind}")


def link_lists(found: DataFrame, fine: DataFrame, options: NearDuplicates) -> DataFrame:
    """Confirmed links between components among the members found, as many as join them (no pair inside one).

    A task holds the members of two blocks that have a candidate. Their candidates are confirmed on the full sets,
    and a confirmed link joins its components at once, so no links within a group of copies are emitted.
    """
    kind = found.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ids, text = table.column("id").to_pylist(), table.column("packed").to_pylist()
        bits, label, asking = _bits(table, options)
        sets: dict[int, np.ndarray] = {}
        links: list[tuple] = []

        def shingles(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = next(shingle_sets(pa.array([unpack(text[i]).decode()]), options.words))
            return sets[i]

        for i in asking:
            for j in np.flatnonzero(np.count_nonzero(bits == bits[i], axis=1) >= options.fine_matches):
                if label[i] == label[j]:
                    continue
                x, y = shingles(i), shingles(j)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= options.percent * (len(x) + len(y) - common):
                    links.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        kinds = table.schema.field("id").type
        return pa.table({"a": pa.array([a for a, _ in links], kinds), "b": pa.array([b for _, b in links], kinds)})

    rows = found.join(fine, "id").select("hub", "band", "value", "x", "y", "id", "label", "fine", "packed")
    return rows.groupBy("hub", "band", "value", "x", "y").applyInArrow(run, f"a {kind}, b {kind}")


def matching(pairs: DataFrame, classes: DataFrame, options: NearDuplicates) -> DataFrame:
    """The pairs whose sizes allow the overlap and whose signatures agree often enough."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= options.percent * F.greatest("n_a", "n_b"))
    same = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return both.where(same >= options.matches).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, options: NearDuplicates) -> DataFrame:
    """The pairs whose full shingle sets overlap enough. Rows stream through in the order of `a`."""
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_a, ids_b = batch.column("a"), batch.column("b")
            sizes = np.array(pa.compute.binary_length(batch.column("text_a")).fill_null(0).to_pylist()) + np.array(pa.compute.binary_length(batch.column("text_b")).fill_null(0).to_pylist())
            step, keep = max(1, int((1 << 21) / max(sizes.mean(), 1))), []
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                for x, y in zip(shingle_sets(part.column("text_a"), options.words), shingle_sets(part.column("text_b"), options.words), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= options.percent * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([ids_a.filter(mask), ids_b.filter(mask)], names=["a", "b"])

    import pyarrow.compute  # noqa: F401

    kind = pairs.schema["a"].dataType.simpleString()
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each linked id reaches. Labels take the least label around them and
    then their label's label, so paths shorten by half each round; every round is written and read again."""
    edges = materialise(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialise(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")))
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(around, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        moved = materialise(lower.join(jump, F.col("label") == F.col("_i"), "left").select("id", "old", F.least("label", "_l").alias("label")))
        labels = moved.select("id", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels


def memberships(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """One row per document: doc_id, content, n_shingles, component_id, kept.

    Null or empty text, or one without words: no shingles, linked with nothing. Repeated rows fall into one
    class. Rows of one doc_id with different texts are documents of their own, linked by their texts only. A null
    id is never the smallest of a component and is not kept if another document stands for it.

    """
    found = _classified(docs, options)
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component.doc_id", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "content", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def _classified(docs: DataFrame, options: NearDuplicates) -> DataFrame:
    """doc_id, content, n_shingles, set_a, component of every row. A class is identified by its smallest doc_id and the
    hash of the text it has there, so the smallest class of a component names the component; null without an id."""
    signed = materialise(signatures(docs, options))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    reps = materialise(full.groupBy(*key).agg(F.min(F.struct("doc_id", "content")).alias("rep")).select(*key, F.col("rep").alias("id")))
    at = reps.select(*key, "id", F.col("id.doc_id").alias("doc_id"), F.col("id.content").alias("content"))
    classes = materialise(full.join(at, [*key, "doc_id", "content"]).select("id", "n_shingles", "signature").dropDuplicates(["id"]))
    postings = materialise(prefix_postings(classes, options))
    first = materialise(matching(hubs := materialise(hub_pairs(postings)), classes, options))
    links = _confirm(first, docs, options)
    labels = components(links)
    members = materialise(unresolved_members(hubs, labels, options))
    fine = materialise(fine_signatures(_class_texts(docs, members.select("id").distinct(), options), options))
    lists = meeting_lists(members, fine, options)
    found = materialise(candidate_members(blocks_beside(lists, options), fine, options))
    more = materialise(link_lists(found, fine, options))
    if more.limit(1).count():
        labels = components(links.unionAll(more))
    named = reps.join(labels, "id", "left").select(*key, F.coalesce("label", "id").alias("component"))
    return signed.select("doc_id", "content", *key).join(named, key, "left").select("doc_id", "content", "n_shingles", "set_a", "component")


def _class_texts(docs: DataFrame, ids: DataFrame, options: NearDuplicates) -> DataFrame:
    """(id, text) of the classes: the text that the class's smallest document has in it."""
    wanted = small_side(materialise(ids.select("id", F.col("id.doc_id").alias("_d"), F.col("id.content").alias("_c"))), options.broadcast_ids)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_t"))
    joined = texts.join(wanted, (F.col("doc_id") == F.col("_d")) & (F.col("_t") == F.col("_c")))
    return joined.select("id", "text").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, docs: DataFrame, options: NearDuplicates) -> DataFrame:
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).distinct()
    return materialise(confirmed(pairs, materialise(_class_texts(docs, ids, options)), options))


def keep_one_of_each(docs: DataFrame, options: NearDuplicates = NearDuplicates()) -> DataFrame:
    """The rows of `docs` that stand for their component, with their columns; one row for repeated rows. A row without
    an id stands for its text's set only if no row with an id does."""
    found = materialise(_classified(docs, options))
    alone = found.where("n_shingles = 0").select("doc_id", "content")
    same = F.coalesce("component", F.struct(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("set_a").alias("content")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "content"))
    chosen = found.where("n_shingles > 0").groupBy(same.alias("_same")).agg(first.alias("one")).select("one.doc_id", "one.content")
    keep = alone.unionAll(chosen).distinct().select(F.col("doc_id").alias("_d"), F.col("content").alias("_c"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"))
    joined = rows.join(keep, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_c")), "left_semi")
    return joined.dropDuplicates(["_id", "_text"]).select("row.*")

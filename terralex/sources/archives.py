"""Concordance features inside tar archives, read in parallel.

An archive is read as blocks of 512 bytes by splits of the file. Where a split begins inside a member is not known
from the split alone, so a first pass notes every block that could be a header (its checksum holds) and where the
chain of headers from there leaves the split. Chains are then followed from the start of the file over the splits,
which tells true headers from member data that looks like one. A second pass walks each split from its first true
header. Members within a split are cut down to their `properties` on the spot; only pieces of members that cross
splits are shuffled, to be put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.session import materialise, path_length, ship_package
from terralex.sources.concordance import mentioned_ids

BLOCK = 512
SPLIT_BYTES = 64 << 20
MAX_SPLITS = 128  # of all archives together, until they reach the usual size
_PART = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}]', re.DOTALL)
_KEY = re.compile(rb'"properties"[\x20\t\r\n]*:[\x20\t\r\n]*(?=\{)')


def properties_of(data: bytes) -> str | None:
    """The text of a feature's first `properties` object, found by its braces outside strings; None if there is no
    such object, it does not end, or it is not UTF-8."""
    first = data.find(b'"properties"')
    key = _KEY.match(data, first) if first >= 0 else None
    if not key:
        return None
    depth = 0
    for part in _PART.finditer(data, key.end()):
        depth += {b"{": 1, b"}": -1}.get(part.group(), 0)
        if depth == 0:
            try:
                return data[key.end() : part.end()].decode()
            except UnicodeDecodeError:
                return None
    return None


def header_fields(block: bytes) -> tuple[str, int, bool] | None:
    """(path, size, regular) of a header block; None if it is none: its checksum or its size does not hold."""
    stated = block[148:156].split(b"\0")[0].strip()
    if not re.fullmatch(rb"[0-7]+", stated) or int(stated, 8) != sum(block) - sum(block[148:156]) + 8 * 32:
        return None
    field = block[124:136]
    if field[0] & 0x80:
        size = int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big")
    else:
        digits = field.split(b"\0")[0].strip() or b"0"
        if not re.fullmatch(rb"[0-7]+", digits):
            return None
        size = int(digits, 8)
    name, prefix = (part.split(b"\0")[0].decode("utf-8", "replace").strip() for part in (block[:100], block[345:500]))
    return (f"{prefix}/{name}" if prefix else name), size, block[156:157] in (b"0", b"\0")


def after(offset: int, size: int) -> int:
    """Where the header after a member stands."""
    return offset + BLOCK + -(-size // BLOCK) * BLOCK


def chain_exits(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, int, int, int]]:
    """(begin, end, candidate, exit) of a split: every block that may be a header, and the first offset outside the
    split on its chain. A row with candidate -1 stands for the split itself."""
    begin = end = -1
    onward: dict[int, int] = {}
    for offset, block in records:
        begin, end = (offset if begin < 0 else begin), offset + BLOCK
        found = header_fields(bytes(block)) if block[0] or block[345] else None
        if found:
            onward[offset] = after(offset, found[1])
    if begin < 0:
        return
    yield begin, end, -1, -1
    exits: dict[int, int] = {}
    for offset in sorted(onward, reverse=True):
        at = onward[offset]
        exits[offset] = exits.get(at, at)
        yield begin, end, offset, exits[offset]


def split_entries(splits: list[tuple[int, int]], exits: dict[int, int]) -> dict[int, int]:
    """The first true header at or after the start of every split, by the split's start. It stands behind the split
    if a member covers all of it. Splits behind the end of the archive are left out."""
    entries, at = {}, 0
    for begin, end in sorted(splits):
        entries[begin] = at
        if begin <= at < end:
            if at not in exits:  # the end mark, or a broken header that the walk reports
                break
            at = exits[at]
    return entries


def walk_split(records: Iterator[tuple[int, bytes]], entries: dict[int, int], suffix: str) -> Iterator[tuple[int, int, str | None, int, bytes | None, str | None]]:
    """(next, offset, path, size, piece, properties) of a split's members that end with `suffix`. Whole members come
    with their properties and a null piece. Pieces of a member that crosses splits carry the offset of the header after
    it as `next`; its first piece carries path and size."""
    entry = None
    member: tuple[int, str | None, int, int] | None = None  # next header, path, size, offset of the data
    data = bytearray()
    piece_at = 0
    done = False
    for offset, block in records:
        if entry is None:
            if offset not in entries:
                return
            entry = entries[offset]
            if offset < entry:
                member, piece_at = (entry, None, -1, -1), offset
        if done:
            return
        if member and offset < member[0]:
            data += block
            continue
        if member:
            yield from _closed(member, piece_at, data, suffix)
        fields = header_fields(bytes(block))
        if fields is None:
            if any(block):
                raise ValueError(f"invalid archive header at byte {offset}")
            member, done = None, True
            continue
        path, size, regular = fields
        wanted = regular and path.lower().endswith(suffix)
        member, data, piece_at = (after(offset, size), path if wanted else "", size, offset + BLOCK), bytearray(), offset + BLOCK
        if size == 0 and wanted:
            yield member[0], piece_at, path, 0, None, properties_of(b"")
            member = None
    if member and not done:
        yield from _closed(member, piece_at, data, suffix)


def _closed(member: tuple[int, str | None, int, int], piece_at: int, data: bytearray, suffix: str) -> Iterator[tuple]:
    onward, path, size, begin = member
    if path is None:  # began in an earlier split
        yield onward, piece_at, None, -1, bytes(data), None
    elif path and len(data) >= size:
        yield onward, begin, path, size, None, properties_of(bytes(data[:size]))
    elif path:
        yield onward, begin, path, size, bytes(data), None


def _joined(pieces: pa.Table) -> pa.Table:
    """The pieces of one member put together. Pieces without a first one belong to a member that is not wanted."""
    rows = sorted(zip(*(pieces[c].to_pylist() for c in ("offset", "path", "size", "piece")), strict=True), key=lambda r: (r[0], r[1] is None))
    out = []
    if rows[0][1] is not None:
        _, path, size, _ = rows[0]
        data = b"".join(r[3] for r in rows)
        if len(data) < size:
            raise ValueError(f"archive ends inside {path}")
        out.append((path, properties_of(data[:size])))
    return pa.table({"path": pa.array([p for p, _ in out], pa.string()), "properties": pa.array([p for _, p in out], pa.string())})


def _blocks(spark: SparkSession, path: str, split_bytes: int):
    conf = {"fixedlengthinputformat.record.length": str(BLOCK), "mapreduce.input.fileinputformat.split.maxsize": str(split_bytes // BLOCK * BLOCK)}
    return spark.sparkContext.newAPIHadoopFile(
        path, "org.apache.hadoop.mapreduce.lib.input.FixedLengthInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)


def read_size(lengths: list[int], split_bytes: int) -> int:
    """The size of splits: `split_bytes`, but larger, up to the usual size, if archives of these lengths had more than
    MAX_SPLITS of them. Every split is a task and a stored file in both passes."""
    return max(split_bytes, min(SPLIT_BYTES, -(-sum(lengths) // MAX_SPLITS)))


def archive_members(spark: SparkSession, paths: str | list[str], split_bytes: int = SPLIT_BYTES, suffix: str = ".geojson") -> DataFrame:
    """path, properties of every regular member of the archives whose name ends with `suffix`, in any case.
    `properties` is null where a feature has none that can be read. All archives are read in the same two passes."""
    ship_package(spark)
    sc, paths = spark.sparkContext, [paths] if isinstance(paths, str) else paths
    split_bytes = read_size([path_length(spark, path) for path in paths], split_bytes)
    blocks = [_blocks(spark, path, split_bytes) for path in paths]
    chains = materialise(spark.createDataFrame(
        sc.union([part.mapPartitions(lambda records, n=n: ((n, *row) for row in chain_exits(records))) for n, part in enumerate(blocks)]),
        "archive int, begin long, end long, candidate long, exit long"))
    # Only candidates at which another split's chain arrives, or the start, can be the first of a split: a few each.
    arrivals = chains.where("candidate >= 0 AND exit >= end").select("archive", F.col("exit").alias("candidate")).distinct()
    first = chains.where("candidate = 0").select("archive", "candidate", "exit").unionAll(
        chains.where("candidate > 0").join(arrivals, ["archive", "candidate"], "left_semi").select("archive", "candidate", "exit"))
    splits: dict[int, list[tuple[int, int]]] = {n: [] for n in range(len(paths))}
    exits: dict[int, dict[int, int]] = {n: {} for n in range(len(paths))}
    for r in chains.where("candidate = -1").collect():
        splits[r["archive"]].append((r["begin"], r["end"]))
    for r in first.collect():
        exits[r["archive"]][r["candidate"]] = r["exit"]
    entries = sc.broadcast({n: split_entries(splits[n], exits[n]) for n in splits})  # once a worker, not once a task
    found = materialise(spark.createDataFrame(
        sc.union([part.mapPartitions(lambda records, n=n: ((n, *row) for row in walk_split(records, entries.value[n], suffix))) for n, part in enumerate(blocks)]),
        "archive int, next long, offset long, path string, size long, piece binary, properties string"))
    whole = found.where("piece IS NULL").select("path", "properties")
    pieces = found.where("piece IS NOT NULL").groupBy("archive", "next").applyInArrow(_joined, "path string, properties string")
    return whole.unionByName(pieces)


def archive_properties(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The features of several archives as `concordance.feature_properties` gives those of line files."""
    if not paths:
        raise ValueError("no archive is given")
    return archive_members(spark, paths, split_bytes).select("properties").withColumn("_ids", mentioned_ids("properties"))

"""A collection on shared storage: hash-bucketed Parquet segments under versioned manifests.

Each point belongs to the bucket of its point id. A manifest lists the live segments per bucket; writing adds a
segment directory and then publishes a new manifest, so readers never see half a write and a failed write leaves
only unlisted files.

Writers do not wait for one another. A manifest is published only if its version is still free; a writer that comes
second reads what the first one changed, takes it into account and publishes the next version. Stream batches carry
a transaction, recorded in the manifest, so a replayed batch is known before anything is read.

Beside every segment stand Bloom filters of its ids, by bucket. They tell most new points from stored ones without
reading stored ids; what they leave in doubt is looked up in the buckets concerned.

Segments of like size are merged once a bucket has several, so the number of files stays within a logarithm of the
number of points; files that no recent manifest lists are removed.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralex.session import Scratch, materialise, remove_path, shuffles_removed
from terralex.sources import bloom

MIN_BUCKETS = 8
POINTS_PER_BUCKET = 100_000
#: Ids that one lookup in stored buckets broadcasts.
LOOKUP_IDS = 500_000


def buckets_for(points: int) -> int:
    return max(MIN_BUCKETS, -(-points // POINTS_PER_BUCKET))


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def last_per_id(points: DataFrame, order: str | None = None) -> DataFrame:
    """One row per point id: the last by `order`; without one, or among ties, by a hash of the row."""
    last = [F.desc(order)] if order else []
    # Maps have no hash of their own; all other columns are hashed as they are.
    columns = [F.to_json(f.name) if _has_map(f.dataType) and not isinstance(f.dataType, T.ArrayType) else F.to_json(F.struct(f.name)) if _has_map(f.dataType) else F.col(f.name) for f in points.schema.fields]
    by_id = Window.partitionBy("point_id").orderBy(*last, F.desc(F.xxhash64(*columns)))
    return points.withColumn("_r", F.row_number().over(by_id)).where("_r = 1").drop("_r")


class Conflict(RuntimeError):
    """Other writers published first, more often than the writer may retry."""


class CollectionStore:
    def __init__(
        self, spark: SparkSession, path: str, buckets: int | None = None, expected_points: int = 0, max_segments: int = 8, keep_versions: int = 10, attempts: int = 20,
    ):
        """A new store takes its number of buckets from `buckets`, or from the number of points it is to hold.
        `max_segments` of like size are merged; replaced files stay for `keep_versions` more versions."""
        self.spark, self.path = spark, path.rstrip("/")
        self.max_segments, self.keep_versions, self.attempts = max_segments, keep_versions, attempts
        self.sized = buckets is not None
        self.manifest = self._latest() or {
            "version": 0, "buckets": buckets or buckets_for(expected_points), "segments": {}, "rows": {}, "schema": None, "transactions": {}, "retired": []}

    def size_for(self, points: int) -> None:
        """Derive the number of buckets from the points to come, as long as nothing is stored."""
        if not self.sized and not self.manifest["version"]:
            self.manifest["buckets"] = buckets_for(points)

    # ---- manifests ----------------------------------------------------------------------------------------

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/_manifest/v{version:09d}.json"

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_manifest")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def _latest(self) -> dict | None:
        versions = self._versions()
        if not versions:
            return None
        return json.loads(self.spark.read.text(self._manifest_path(versions[-1]), wholetext=True).first()[0])

    def refresh(self) -> None:
        """Read the newest manifest."""
        self.manifest = self._latest() or self.manifest

    def _publish(self, manifest: dict) -> bool:
        """Make a manifest visible under its version, unless another writer has taken that version."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(self._manifest_path(manifest["version"]))
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        files = draft.getFileSystem(conf)
        files.mkdirs(target.getParent())
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        # A rename that does not replace: of two writers one finds the name taken.
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        modes = self.spark.sparkContext._gateway.new_array(rename, 1)
        modes[0] = rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), conf).rename(files.makeQualified(draft), files.makeQualified(target), modes)
        except Exception as problem:
            files.delete(draft, False)
            if "FileAlreadyExists" not in str(problem):
                raise
            return False
        self.manifest = manifest
        return True

    # ---- reading ------------------------------------------------------------------------------------------

    def bucket(self, point_id: Column) -> Column:
        return F.pmod(F.xxhash64(point_id), F.lit(self.manifest["buckets"])).cast("int")

    def exists(self) -> bool:
        return any(self.manifest["segments"].values())

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All live points, or those of some buckets; None when there are no segments."""
        wanted = None if buckets is None else set(buckets)
        return self._rows({b: s for b, s in self.manifest["segments"].items() if wanted is None or int(b) in wanted})

    def _rows(self, segments: dict[str, list[str]]) -> DataFrame | None:
        paths = [f"{self.path}/data/{segment}/bucket={bucket}" for bucket, names in segments.items() for segment in names]
        if not paths:
            return None
        # The recorded schema covers columns that only later segments have.
        return self.spark.read.schema(T.StructType.fromJson(json.loads(self.manifest["schema"]))).parquet(*paths)

    def filters(self) -> DataFrame:
        """bucket, bits of the live segments. Ids that were replaced since stay in their filters: a filter may only
        say yes too often."""
        live = sorted({s for names in self.manifest["segments"].values() for s in names})
        return self.spark.read.schema("bucket int, n long, bits binary").parquet(*[f"{self.path}/filters/{s}" for s in live]).select("bucket", "bits")

    def maybe_stored(self, ids: DataFrame) -> DataFrame:
        """point_id, bucket of the ids that the filters do not rule out. Only ids and filters meet, by bucket."""
        kind = ids.schema["point_id"].dataType.simpleString()

        def ask(asked: pa.Table, held: pa.Table) -> pa.Table:
            hashes = asked["hash"].to_numpy()
            found = np.zeros(len(hashes), bool)
            for bits in held["bits"].to_pylist():
                open_ = np.flatnonzero(~found)
                found[open_] = bloom.may_hold(bits, hashes[open_])
            return asked.filter(pa.array(found)).select(["point_id", "bucket"])

        asked = ids.select("point_id", self.bucket(F.col("point_id")).alias("bucket"), F.xxhash64("point_id").alias("hash")).distinct()
        return asked.groupBy("bucket").cogroup(self.filters().groupBy("bucket")).applyInArrow(ask, f"point_id {kind}, bucket int")

    def _lookups(self, sizes: dict[int, int], most: int) -> Iterator[tuple[list[int], int, int]]:
        """(buckets, part, parts): lookups of at most about `most` ids; a bucket with more is looked up in parts."""
        buckets, room = [], most
        for bucket, n in sorted(sizes.items()):
            if n > most:
                parts = -(-n // most)
                yield from (([bucket], part, parts) for part in range(parts))
                continue
            if n > room:
                yield buckets, 0, 1
                buckets, room = [], most
            buckets.append(bucket)
            room -= n
        if buckets:
            yield buckets, 0, 1

    def stored(self, ids: DataFrame, most: int = LOOKUP_IDS) -> DataFrame | None:
        """point_id of those ids that are stored; None if the filters rule out all of them. Ids in doubt are
        broadcast, a bounded number at a time, to a scan of the ids in their buckets: stored ids are not moved."""
        maybe = materialise(self.maybe_stored(ids))
        sizes = {r["bucket"]: r["n"] for r in maybe.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        found = None
        for buckets, part, parts in self._lookups(sizes, most):
            asked = maybe.where(F.col("bucket").isin(buckets))
            if parts > 1:
                asked = asked.where(F.pmod(F.xxhash64("point_id", F.lit(1)), F.lit(parts)) == part)
            here = self.read(buckets).select("point_id").join(F.broadcast(asked.select("point_id")), "point_id", "left_semi")
            here = materialise(here) if len(sizes) > len(buckets) or parts > 1 else here  # one broadcast at a time
            found = here if found is None else found.unionAll(here)
        return found

    def missing(self, points: DataFrame) -> DataFrame:
        """Points not stored yet. The points are evaluated once, stored ids are not shuffled."""
        if not self.exists():
            return points
        points = materialise(points)
        found = self.stored(points.select("point_id"))
        return points if found is None else points.join(found, "point_id", "left_anti")

    # ---- writing ------------------------------------------------------------------------------------------

    def insert(
        self, points: DataFrame, unique: bool = False, transaction: tuple[str, int] | None = None, finish: Callable[[DataFrame], DataFrame] | None = None,
    ) -> int:
        """Append points known to be absent. Returns the number written. Rows of one id are stored once; `unique`
        says that there are none and saves the shuffle. Points that another writer stored in the meantime are left
        out. A `transaction` (stream, batch) that is recorded already writes nothing. `finish` makes points of the given
        rows, one each and of the same id, after these have been moved to their buckets."""
        if self.recorded(transaction):
            return 0
        base = self.manifest
        segment, counts, recorded = self._write(points if unique else last_per_id(points), finish)
        for _ in range(self.attempts):
            if self._publish(self._appended(segment, counts, recorded, transaction)):
                self._maintain()
                return sum(counts.values())
            self.refresh()
            if self.recorded(transaction):
                self._remove_segment(segment)
                return 0
            new = {b: [s for s in names if s not in base["segments"].get(b, [])] for b, names in self.manifest["segments"].items() if int(b) in counts}
            others = self._rows(new)
            if others is not None:
                rows = self.spark.read.schema(T.StructType.fromJson(json.loads(recorded))).parquet(*[f"{self.path}/data/{segment}/bucket={b}" for b in counts])
                if rows.join(others.select("point_id"), "point_id", "left_semi").limit(1).count():
                    old = segment
                    segment, counts, recorded = self._write(rows.join(others.select("point_id"), "point_id", "left_anti"))
                    self._remove_segment(old)
            recorded = self._merged_schema(T.StructType.fromJson(json.loads(recorded)))
            base = self.manifest
        raise Conflict(f"{self.path}: {self.attempts} attempts")

    def upsert(self, points: DataFrame, order: str | None = None, transaction: tuple[str, int] | None = None) -> int:
        """Insert or replace by point id; only buckets that receive points are rewritten. Of several rows of one
        id the last by `order` is stored. The points are evaluated once."""
        with Scratch(self.spark) as keep:
            points = keep(last_per_id(points, order))
            touched = sorted(r["b"] for r in points.select(self.bucket(F.col("point_id")).alias("b")).distinct().collect())
            for _ in range(self.attempts):
                if self.recorded(transaction) or not touched:
                    return 0
                current, rows = self.read(touched), points
                if current is not None:
                    kept = current.join(points.select("point_id"), "point_id", "left_anti")
                    rows = kept.unionByName(points, allowMissingColumns=True)
                segment, counts, recorded = self._write(rows)
                replaced = {str(b): self.manifest["segments"].get(str(b), []) for b in touched}
                if self._publish(self._appended(segment, counts, recorded, transaction, replaced)):
                    self._maintain()
                    return sum(counts.values())
                self._remove_segment(segment)
                self.refresh()
        raise Conflict(f"{self.path}: {self.attempts} attempts")

    def recorded(self, transaction: tuple[str, int] | None) -> bool:
        """Whether a stream's batch, or a later one, is part of the collection."""
        return bool(transaction) and self.manifest["transactions"].get(transaction[0], -1) >= transaction[1]

    def _write(self, points: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> tuple[str, dict[int, int], str]:
        """Write a segment and its filters: (name, rows per bucket, schema). Nothing is visible yet."""
        segment = uuid.uuid4().hex
        target = f"{self.path}/data/{segment}"
        finish = finish or (lambda rows: rows.drop("bucket"))
        recorded = self._merged_schema(finish(points).schema)
        # Rebalancing sizes the files: small buckets share a task, a large one is split over several.
        placed = points.withColumn("bucket", self.bucket(F.col("point_id"))).hint("rebalance", "bucket")
        with shuffles_removed(self.spark):
            finish(placed).withColumn("bucket", self.bucket(F.col("point_id"))).write.option("compression", "zstd").partitionBy("bucket").parquet(target)
        if not self._has_files(target):
            return segment, {}, recorded
        hashes = self.spark.read.parquet(target).select("bucket", F.xxhash64("point_id").alias("hash"))
        hashes.mapInArrow(bloom.filters_of, "bucket int, n long, bits binary").write.parquet(f"{self.path}/filters/{segment}")
        counts = self.spark.read.parquet(f"{self.path}/filters/{segment}").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
        return segment, {r["bucket"]: r["n"] for r in counts}, recorded

    def _appended(self, segment: str, counts: dict[int, int], recorded: str, transaction: tuple[str, int] | None = None, replaced: dict[str, list[str]] | None = None) -> dict:
        """The next manifest: the segment added to its buckets, in place of the `replaced` segments there."""
        old, version = self.manifest, self.manifest["version"] + 1
        replaced = replaced or {}
        segments = {b: [s for s in names if s not in replaced.get(b, [])] for b, names in old["segments"].items()}
        for bucket in counts:
            segments[str(bucket)] = [*segments.get(str(bucket), []), segment]
        segments = {b: names for b, names in segments.items() if names}
        rows = {b: {s: old["rows"].get(b, {}).get(s, counts.get(int(b), 0)) for s in names} for b, names in segments.items()}
        # Files retired `keep_versions` ago went when the last version was published.
        retired = [r for r in old["retired"] if r[0] > version - 1 - self.keep_versions] + [[version, s, b] for b, names in replaced.items() for s in names]
        transactions = old["transactions"] | ({transaction[0]: transaction[1]} if transaction else {})
        return {"version": version, "buckets": old["buckets"], "segments": segments, "rows": rows, "schema": recorded, "transactions": transactions, "retired": retired}

    def _merged_schema(self, new: T.StructType) -> str:
        """Stored columns in their order, then new ones; all nullable, since older segments lack the new ones."""
        known = T.StructType.fromJson(json.loads(self.manifest["schema"])).fields if self.manifest.get("schema") else []
        names = {f.name for f in known}
        fields = [*known, *(f for f in new.fields if f.name not in names)]
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]).json()

    # ---- maintenance --------------------------------------------------------------------------------------

    def _due(self) -> dict[str, list[str]]:
        """Segments to merge by bucket: `max_segments` or more whose numbers of rows have the same order."""
        out = {}
        for bucket, rows in self.manifest["rows"].items():
            levels: dict[int, list[str]] = {}
            for segment, n in rows.items():
                levels.setdefault(int(math.log(max(n, 1), self.max_segments)), []).append(segment)
            full = [s for names in levels.values() if len(names) >= self.max_segments for s in names]
            if full:
                out[bucket] = full
        return out

    def compact(self) -> int:
        """Merge segments of like size. Returns the number of buckets merged; none if another writer was first."""
        due = self._due()
        rows = self._rows(due)
        if rows is None:
            return 0
        segment, counts, recorded = self._write(rows)
        if self._publish(self._appended(segment, counts, recorded, replaced=due)):
            return len(due)
        self._remove_segment(segment)
        self.refresh()
        return 0

    def _maintain(self) -> None:
        before = self.manifest
        self.compact()
        self._vacuum(before)

    def _vacuum(self, before: dict) -> None:
        """Remove what manifests older than `keep_versions` alone list. Files of writers that have not published
        are in no manifest and are left alone."""
        oldest = self.manifest["version"] - self.keep_versions
        retired = before["retired"] + self.manifest["retired"]
        kept = {s for names in self.manifest["segments"].values() for s in names} | {s for version, s, _ in retired if version > oldest}
        for segment, bucket in {(s, b) for version, s, b in retired if version <= oldest}:
            remove_path(self.spark, f"{self.path}/data/{segment}/bucket={bucket}")
            if segment not in kept:
                self._remove_segment(segment)
        for version in self._versions():
            if version <= oldest:
                remove_path(self.spark, self._manifest_path(version))

    def _remove_segment(self, segment: str) -> None:
        for part in ("data", "filters"):
            remove_path(self.spark, f"{self.path}/{part}/{segment}")

    def _has_files(self, target: str) -> bool:
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/bucket=*")
        found = pattern.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return found is not None and len(found) > 0

"""Sources and stores beyond one writer and one file: archives, concurrent writers, lookups by filter, changed
buckets, stable load order."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.collections import _BUILD, _documents, _points, scratch
from checks.dataset import admin1_lines, alternate_lines, city_lines, country_lines, feature_lines
from checks.registry import Tables, register
from terralex.plans.build_dataset import Dumps, build_dataset, load_backbone
from terralex.session import materialise
from terralex.sources import archives, concordance, gazetteer, snapshots
from terralex.sources.collection_store import CollectionStore


@register(
    "S11_concurrent_writers",
    """SELECT vec_id AS entity_key, CASE WHEN vec_id % 5 = 0 THEN label + 200 WHEN vec_id % 2 = 0 THEN label ELSE label + 100 END AS label
       FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0""")
def concurrent_writers(t: Tables):
    """Three writers open an empty store. The first inserts the even points, the second the multiples of three, of
    which half are there by then, the third replaces the multiples of five."""
    path = scratch(t)
    first, second, third = (CollectionStore(t.spark, path, buckets=8) for _ in range(3))
    points = _points(t).drop("embedding")
    first.insert(points.where("entity_key % 2 = 0"), unique=True)
    second.insert(points.where("entity_key % 3 = 0").withColumn("label", F.col("label") + 100), unique=True)
    third.upsert(points.where("entity_key % 5 = 0").withColumn("label", F.col("label") + 200))
    return CollectionStore(t.spark, path).read().select("entity_key", "label")


@register(
    "S11_many_batches", "SELECT vec_id AS entity_key, label FROM embeddings")
def many_batches(t: Tables):
    """Twelve batches, each of a twelfth of the points and a replay of the batch before; segments are merged as they
    come."""
    store = CollectionStore(t.spark, scratch(t), buckets=4, max_segments=3, keep_versions=2)
    points = _points(t).drop("embedding")
    for batch in range(12):
        for k in (batch - 1, batch):
            store.insert(points.where((F.pmod("entity_key", F.lit(12)) == k)), unique=True, transaction=("load", k))
    assert max(len(names) for names in store.manifest["segments"].values()) <= 6
    return store.read().select("entity_key", "label")


@register(
    "J13_missing_by_filter",
    "SELECT vec_id AS entity_key FROM embeddings WHERE NOT (label < 4 OR vec_id % 7 = 0)")
def missing_by_filter(t: Tables):
    """Two loads are stored; the points asked for are told from them by the filters and a lookup of the rest."""
    store = CollectionStore(t.spark, scratch(t), buckets=8)
    points = _points(t).drop("embedding")
    store.insert(points.where("label < 4"), unique=True)
    store.insert(store.missing(points.where("entity_key % 7 = 0")), unique=True)
    return store.missing(points).select("entity_key")


def write_archives(rows: DataFrame, folder: str) -> list[str]:
    """(path, data) rows as tar archives, one per task, written by the tasks. Returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():05d}.tar"
        trial = f"{root}/_{name}.{task.taskAttemptId()}"
        with store.open_output_stream(trial) as out:
            for batch in batches:
                for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    info = tarfile.TarInfo(path)
                    info.size = len(data)
                    out.write(info.tobuf(tarfile.USTAR_FORMAT) + data + bytes(-len(data) % archives.BLOCK))
            out.write(bytes(2 * archives.BLOCK))
        store.move(trial, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"])], names=["path"])

    return sorted(r["path"] for r in rows.mapInArrow(run, "path string").collect())


def archived_features(t: Tables, parts: int = 2) -> DataFrame:
    """All features as members of archives, some with a geometry longer than a split, among members of other kinds.
    An archive is written by one task, so their number follows the features."""
    lines = feature_lines(t).select("value", F.get_json_object("value", "$.properties['wof:id']").cast("bigint").alias("k"))
    ring = F.repeat(F.lit('{"}'), F.when(F.col("k") % 97 == 0, 40000).otherwise(F.col("k") % 50).cast("int"))
    padded = F.replace("value", F.lit('"geometry":{'), F.concat(F.lit('"geometry":{"ring":"'), F.replace(ring, F.lit('"'), F.lit('\\"')), F.lit('",')))
    features = lines.select(F.concat(F.lit("data/"), F.col("k").cast("string"), F.lit(".geojson")).alias("path"), padded.cast("binary").alias("data"))
    others = lines.where("k % 10 = 0").select(F.concat(F.lit("meta/"), F.col("k").cast("string"), F.lit(".csv")).alias("path"), F.col("value").cast("binary").alias("data"))
    parts = max(parts, -(-lines.count() // 50_000))
    paths = write_archives(features.unionByName(others).repartition(parts, "path"), scratch(t))
    return archives.archive_properties(t.spark, paths, split_bytes=1 << 16)


@register(
    "S6_archive_source",
    """SELECT wof_id, nullif(gn_id, '0') AS gn_id, placetype, name_en, name_vi, CASE WHEN name_en IS NULL THEN '' ELSE name_en || ' B' END AS aliases_en,
              placetype = 'locality' AND is_current AND gn_id <> '0' AS admissible FROM wof_src""", "wof_src")
def archive_source(t: Tables):
    rows = concordance.parse_features(archived_features(t), "city")
    return rows.select("wof_id", "gn_id", "placetype", "name_en", "name_vi", F.array_join("aliases_en", "|").alias("aliases_en"), F.col("_admissible").alias("admissible"))


@register(
    "W6_U1_first_line",
    """SELECT s.split, 'geonames:city:' || CAST(geoname_id AS STRING) AS id, CASE WHEN geoname_id % 3 = 0 THEN upper(name) ELSE name END AS name_en
       FROM city_src, (SELECT 'small' AS split UNION ALL SELECT 'large') s""", "city_src")
def first_line(t: Tables):
    """Every city stands twice in files of lines, under two names; whichever comes first in the files wins, for small
    and for large splits of them."""
    fields = F.split("value", "\t", -1)
    key = fields[0].cast("bigint")
    lines = city_lines(t, broken=False).select("value", key.alias("k"), fields.alias("f"))
    other = lines.select(F.array_join(F.concat(F.slice("f", 1, 1), F.array(F.upper(F.col("f")[1])), F.slice("f", 3, 17)), "\t").alias("value"), "k", (F.col("k") % 3 != 0).alias("late"))
    both = lines.select("value", "k", (F.col("k") % 3 == 0).alias("late")).unionByName(other)
    path = scratch(t)
    both.repartitionByRange(3, "late", F.xxhash64("k")).sortWithinPartitions("late", F.xxhash64("k")).select("value").write.text(path)
    name, found = "spark.sql.files.maxPartitionBytes", None
    usual = t.spark.conf.get(name)
    for split, size in (("small", "8k"), ("large", "128m")):
        t.spark.conf.set(name, size)
        dumps = Dumps(gazetteer.read_positioned_lines(t.spark, path), country_lines(t), admin1_lines(t), alternate_lines(t))
        rows = materialise(load_backbone(dumps, ["city"]).select(F.lit(split).alias("split"), "id", F.col("name.en").alias("name_en")))
        found = rows if found is None else found.unionByName(rows)
    t.spark.conf.set(name, usual)
    return found


@register("J4_C4_archive_build", "SELECT id, name_en, name_vi, wof_id FROM built", "ent", "alt_src", "wof_src", then=_BUILD)
def archive_build(t: Tables):
    """The whole build with the concordance features of the cities in archives."""
    dumps = Dumps(city_lines(t, broken=False), country_lines(t), admin1_lines(t), alternate_lines(t), {"city": lambda: archived_features(t)})
    entities, _ = build_dataset(dumps)
    return entities.select("id", F.col("name.en").alias("name_en"), F.col("name.vi").alias("name_vi"), F.col("facts.wof_id").alias("wof_id"))


@register(
    "A18_C26_changed_ids",
    """SELECT 'ns:doc' || CAST(doc_id AS STRING) AS id, CASE doc_id % 997 WHEN 1 THEN 'removed' WHEN 2 THEN 'added' ELSE 'changed' END AS change
       FROM documents WHERE doc_id % 997 IN (1, 2, 3)""")
def changed_ids(t: Tables):
    """Two versions of all documents as a dataset; the second lacks some, has some more and some with other texts."""
    rows = _documents(t)
    part = F.pmod(F.substring("id", 7, 20).cast("bigint"), F.lit(997))
    other = F.when(part == 3, F.col("description").withField("en", F.concat(F.col("description.en"), F.lit(" again")))).otherwise(F.col("description"))
    before, after = scratch(t), scratch(t)
    buckets = snapshots.snapshot_buckets(rows.count())
    snapshots.write_snapshot(rows.where(part != 2), before, "v2.1", buckets)
    snapshots.write_snapshot(rows.where(part != 1).withColumn("description", other), after, "v2.1", buckets)
    return snapshots.changed_ids(t.spark, before, after)

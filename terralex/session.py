"""Session settings and the guards shared by the jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakSet

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "terralex", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster names a shared folder. Without one a local master gets a temporary folder; on a cluster that
    is an error, because executors would write to disks that no other machine sees."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, *packages: str) -> None:
    """Send the package sources to the Python workers, once per application.

    Needed when the job was not submitted with the package (for example with --py-files).
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "terralex_sources.zip"
    root = Path(__file__).resolve().parent.parent
    with zipfile.ZipFile(archive, "w") as bundle:
        for package in ("terralex", *packages):
            for source in sorted((root / package).rglob("*.py")):
                bundle.write(source, source.relative_to(root))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)


_STORED: WeakSet[DataFrame] = WeakSet()
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes made here go when a write ends, not when the driver's memory happens to be collected."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Write a table once to the shared folder and read it back: later passes scan columns instead of
    recomputing, and a lost executor costs a re-read only. A table that was stored here is not stored again."""
    if df in _STORED:
        return df
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    _STORED.add(kept)
    return kept


def materialise_counted(df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
    """`materialise` with aggregates of the rows, taken while they are written. They stand on the write itself,
    whose tasks count once each, however often earlier stages run."""
    found = Observation()
    kept = materialise(df.observe(found, *[m.alias(name) for name, m in metrics.items()]))
    return kept, {name: (found.get or {}).get(name) or 0 for name in metrics}


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def path_length(spark: SparkSession, path: str) -> int:
    """Bytes of one file."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(file).getLen()


def remove_path(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Stored steps of one job, removed together when it ends: `with Scratch(spark) as keep: t = keep(df)`.

    `keep.counted(df, n=F.count("*"))` also returns aggregates of the rows, taken while they are written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
        self.count = 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count:04d}"
        with shuffles_removed(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        found = Observation()
        kept = self(df.observe(found, *[m.alias(name) for name, m in metrics.items()]))
        return kept, {name: (found.get or {}).get(name) or 0 for name in metrics}  # nothing is observed of a plan known to be empty

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove_path(self.spark, self.folder)


@contextmanager
def resident(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a table's columns in the executors (on their disks where memory is short) while a stream or several jobs
    use it: only the first use reads its files, and what a lost executor held is read again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def small_side(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Mark one side of a join for broadcast if it really has at most `max_rows` narrow rows.

    Counting first keeps the other, large side from being shuffled before its partner's size is known;
    beyond the bound the join is left to Spark.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def require(condition: Column, message: str | Column) -> Column:
    """A predicate for `where` that keeps every row and fails the job on the first violation.

    The row id makes it non-deterministic to the optimizer, so it stays where it is written: it never sees
    rows that an earlier join removes, and later filters cannot hide rows from it.
    """
    text = F.lit(message) if isinstance(message, str) else message
    always = F.monotonically_increasing_id() >= 0
    return F.when(F.coalesce(condition, F.lit(False)), always).otherwise(F.raise_error(text).cast("boolean"))


def fail_on_errors(df: DataFrame, errors: str = "_errors") -> DataFrame:
    """Fail-fast policy: checked inside the same scan, no extra pass."""
    message = F.concat_ws("; ", F.col(errors))
    return df.where(require(F.size(errors) == 0, message)).drop(errors)


def quarantine(df: DataFrame, errors: str = "_errors") -> tuple[DataFrame, DataFrame]:
    """Quarantine policy: (valid rows, rejected rows with their reasons)."""
    return df.where(F.size(errors) == 0).drop(errors), df.where(F.size(errors) > 0)


def assert_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    clash = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"duplicate {what} {clash[0][0]}")
    return df


def require_non_empty(df: DataFrame, what: str) -> DataFrame:
    if not df.limit(1).collect():
        raise ValueError(f"{what} must not be empty")
    return df


def collect_bounded(df: DataFrame, max_rows: int, what: str) -> list:
    """Bring a table to the driver only if it has at most `max_rows` rows; anything larger is an error."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows")
    return rows

"""Token counts of the documents in flat, unindexed token files.

A file is a run of 16-bit token ids in which an end-of-document id closes every document. It is cut into blocks
of equal size that any task may read; each block is searched for the separator as one vector. A prefix scan over
the blocks of a file carries the last separator and the number of separators forward, so that a document that
begins in one block and ends in another is counted once and whole.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralex.llm.common import cuts
from terralex.session import ensure_checkpoint_dir, materialise

_ID = np.dtype("<u2")


@dataclass(frozen=True)
class TokenFiles:
    separator: int = 50256
    block_tokens: int = 1 << 21


@dataclass(frozen=True)
class Ranks:
    """A byte-level BPE vocabulary file (base64 token and rank per line) and the pattern that splits its input."""

    path: str
    pattern: str

    def encoding(self):
        import tiktoken

        with open(self.path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, ranks: Ranks, options: TokenFiles = TokenFiles()) -> tuple[str, DataFrame]:
    """Write one token file per task under the shared folder; returns the folder, and (file, ordinal, doc_id).

    Null and empty texts are a separator alone. Repeated rows are written each. An empty table leaves an empty folder.
    Columns other than doc_id and text are not read.
    A file gets its name when it is complete, so a task that is run again replaces it by an equal one.
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/tokens/{uuid.uuid4().hex}"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoding = TaskContext.get(), None
        store, root = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder.removeprefix("file:"))
        name, out, ordinal = f"part-{task.partitionId():06d}.bin", None, 0
        trial = f"{root}/_{name}.{task.taskAttemptId()}"
        for batch in batches:
            for start, count in cuts(batch.column("text")):
                part = batch.slice(start, count)
                if out is None:
                    encoding = ranks.encoding()
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(trial)
                for text in part.column("text").to_pylist():
                    out.write(np.array([*encoding.encode_ordinary(text or ""), options.separator], _ID).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * count), pa.array(np.arange(ordinal, ordinal + count)), part.column("doc_id")], names=["file", "ordinal", "doc_id"])
                ordinal += count
        if out is not None:
            out.close()
            store.move(trial, f"{root}/{name}")

    inner = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    written = materialise(inner.mapInArrow(run, f"file string, ordinal long, doc_id {kind}"))
    make_folder(docs.sparkSession, folder)  # where no task had a row
    return folder, written


def make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def scan_blocks(spark: SparkSession, folder: str, options: TokenFiles = TokenFiles()) -> DataFrame:
    """path, block, tokens up to the block's end, and the offsets of the separators in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", (F.col("length") / _ID.itemsize).cast("long").alias("tokens"))
    step = options.block_tokens
    blocks = files.where("tokens > 0").select("path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {step}"))).alias("block"))
    blocks = blocks.select("path", "block", (F.col("block") * step).alias("start"), F.least(F.col("tokens"), (F.col("block") + 1) * step).alias("stop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stop")), strict=True):
                store, name = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with store.open_input_file(name) as source:
                    ids = np.frombuffer(source.read_at((stop - start) * _ID.itemsize, start * _ID.itemsize), _ID)
                found.append(np.flatnonzero(ids == options.separator) + start)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("block"), batch.column("stop"), pa.array(found, pa.list_(pa.int64()))], names=["path", "block", "stop", "separators"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(width, "path", "block").mapInArrow(run, "path string, block long, stop long, separators array<long>")


def documents_of(blocks: DataFrame) -> DataFrame:
    """One row per document: file, ordinal, start, n_tokens (without its separator), closed.

    The carry of a block is the largest separator offset and the number of separators of the blocks before it:
    running values over one narrow row per block. Tokens after a file's last separator are a document that is
    not closed. A file without tokens has no document; two separators in a row close an empty one.
    """
    ahead = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    narrow = blocks.select("path", "block", F.array_max("separators").alias("last"), F.size("separators").alias("n"))
    carry = narrow.select("path", "block", (F.coalesce(F.max("last").over(ahead), F.lit(-1)) + 1).alias("begin"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    rows = blocks.join(carry, ["path", "block"])
    starts = F.concat(F.array("begin"), F.transform(F.slice("separators", 1, F.greatest(F.size("separators") - 1, F.lit(0))), lambda s: s + 1))
    closed = rows.where(F.size("separators") > 0).select("path", "before", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("separators").alias("stop"))).alias("i", "d"))
    closed = closed.select("path", (F.col("before") + F.col("i")).alias("ordinal"), F.col("d.start").alias("start"), (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    ends = blocks.groupBy("path").agg(F.max("stop").alias("stop"), F.coalesce(F.max(F.array_max("separators")) + 1, F.lit(0)).alias("start"), F.sum(F.size("separators")).alias("ordinal"))
    open_ = ends.where("stop > start").select("path", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(open_).withColumn("file", F.element_at(F.split("path", "/"), -1)).drop("path")


def count_tokens(spark: SparkSession, folder: str, options: TokenFiles = TokenFiles()) -> DataFrame:
    """The documents of all token files (`*.bin`) of a folder; none for a folder without files."""
    return documents_of(materialise(scan_blocks(spark, folder, options)))

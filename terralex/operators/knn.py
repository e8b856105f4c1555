"""Exact cosine top-k of query vectors over a collection (the similarity join).

Two physical forms with the same result:

* broadcast - the query matrix is sent to every task when its measured size is within a byte limit and the pairs
  are few. Each task streams its part of the collection once and keeps k rows per query, so the shuffle carries
  tasks x queries x k rows whatever the collection size. The measure counts the k results per query; a few
  times the limit is answered in as many scans.
* grid - beyond that nothing passes through the driver. Queries and collection rows are hashed into
  cells of bounded size and every pair of cells meets in one task (co-grouped), which again emits k rows
  per query. The rows are cut as seldom as their cells' size allows, the queries as often as it takes to keep
  all cores busy: a row travels once per cell of queries, a query's results once per cell of rows. Queries that
  share a vector and its filters are answered once.

  One best row is asked in cells of space instead, by queries whose own vector is in the collection: only vectors
  next to it can score as much, so vectors and queries are dealt once each and the work does not grow with the pairs.

No pair table is ever materialised. Scores are bounded in single precision first; only pairs that may enter the
result are scored in double precision. Queries and rows are sorted along the queries' main direction, so tiles of rows
that stand too far from a block of queries to reach its scores are passed over; that is most of them where queries are
sure of a high score, as those whose own vector is in the collection are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from terralex import fixed_values as fv
from terralex.session import materialise

BROADCAST_BYTES = 128 * 1024 * 1024
CELL_BYTES = 64 * 1024 * 1024
SCORE_BLOCK = 4_000_000
QUERY_BLOCK = 256  # queries that are scored, and whose results are kept, together
TILE_ROWS = 2048  # collection rows scored at once: a block's scores of them stay in a core's cache
DIRECTIONS = 8  # main directions of the queries by which far tiles are told
DIRECTION_SAMPLE = 4096  # queries the directions are taken from; any directions give the same result
CELLS = 16  # cells a side below the usual cell size
CELL_PAIRS = 4_000_000_000  # pairs of two cells, so that a task's time does not grow with the square of the input
GRID_PAIRS = 2_000_000_000  # pairs from which the grid, which needs no driver and little merging, is quicker
TASKS_PER_CORE = 4
SPREAD = 64  # tasks a core up to which there are several for every pair of cells, so that few of these share one
MERGE_FAN_IN = 64
MERGE_ROWS = 100_000  # rows a query may have from all tasks before they are merged in two passes
BYTES_PER_RESULT = 24
NEAR = 1e-8  # queries that need no score further from 1 than this meet in cells of space
NEAR_WIDTH = 0.01  # of such a cell along each of its directions
NEAR_DIRECTIONS = 8
NEAR_ROWS = 50_000  # vectors of one cell of space beyond which the grid spreads them better
NEAR_GROUP = 100_000  # vectors of the cells that a task takes together
NEAR_PAIRS = 1 << 18  # pairs that are scored together there
MAX_BLOCKS = 4  # scans of the collection, each with its part of the queries, before the grid is cheaper

# Filter columns a request row may carry; null means "no condition".
FILTER_COLUMNS = tuple(f"filter_{name}" for name in fv.KEYWORD_FILTERS) + tuple(
    f"filter_{fv.RANGE_FILTER}_{op}" for op in fv.RANGE_OPS
)


@dataclass
class _Queries:
    """A block of queries as unit vectors, with the distinct filters they use."""

    ids: np.ndarray
    units: np.ndarray
    limits: np.ndarray
    floors: np.ndarray
    filters: list[dict]
    filter_index: np.ndarray

    @classmethod
    def from_pandas(cls, frame: pd.DataFrame, filter_columns: list[str]) -> _Queries:
        filters: dict[tuple, int] = {}
        keys = frame[filter_columns].itertuples(index=False, name=None) if filter_columns else [()] * len(frame)
        index = [
            filters.setdefault(tuple((c, v) for c, v in zip(filter_columns, key) if not pd.isna(v)), len(filters))
            for key in keys
        ]
        return cls(
            frame["query_id"].to_numpy(), _unit_rows(_stack(frame["embedding"])),
            frame["k"].to_numpy(dtype=np.int64), frame["score_threshold"].to_numpy(dtype=np.float64),
            [dict(f) for f in filters], np.asarray(index, dtype=np.int64),
        )


    def taken(self, order: np.ndarray) -> _Queries:
        return _Queries(self.ids[order], self.units[order], self.limits[order], self.floors[order], self.filters, self.filter_index[order])


def _main_directions(units: np.ndarray) -> np.ndarray:
    """Columns: orthonormal directions in which the queries differ most, the widest first."""
    if len(units) == 0:
        return np.empty((units.shape[1], 0))
    some = units[:: max(1, len(units) // DIRECTION_SAMPLE)]
    apart = some - some.mean(axis=0)
    return np.linalg.eigh(apart.T @ apart)[1][:, ::-1][:, :DIRECTIONS]


def _boxes(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, greatest) coordinates of every `size` points that follow each other."""
    starts = np.arange(0, len(points), size)
    if len(starts) == 0:
        return points, points
    return np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)


def _stack(vectors: pd.Series) -> np.ndarray:
    if len(vectors) == 0:
        return np.empty((0, 0))
    return np.asarray(np.stack(vectors.to_numpy()), dtype=np.float64)


def _list_matrix(column: pa.ListArray) -> np.ndarray:
    """A list column as a matrix without building one Python object per row."""
    if column.null_count:
        raise ValueError("vectors must not be null")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = len(column)
    lengths = np.diff(column.offsets.to_numpy())
    if rows and (lengths != lengths[0]).any():
        raise ValueError("collection vectors differ in dimension")
    return flat.reshape(rows, -1) if rows else np.empty((0, 0))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    if not np.isfinite(norms).all() or not norms.all():
        raise ValueError("vectors must be finite and non-zero")
    return matrix / norms[:, None]


def _filter_mask(condition: dict, columns: pd.DataFrame) -> np.ndarray | None:
    mask = None
    for column, wanted in condition.items():
        name = column.removeprefix("filter_")
        if name in fv.KEYWORD_FILTERS:
            part = (columns[name] == wanted).to_numpy(dtype=bool)
        else:
            base, op = name.rsplit("_", 1)
            values = pd.to_numeric(columns[base]).to_numpy(dtype=np.float64, na_value=np.nan)
            compare = {"gt": np.greater, "gte": np.greater_equal, "lt": np.less, "lte": np.less_equal}[op]
            part = compare(values, wanted)
        mask = part if mask is None else mask & part
    return mask


class _TopK:
    """Running top-k of queries over streamed collection batches, kept by blocks of queries: a block's scores meet
    the results of that block only."""

    def __init__(self, queries: _Queries, digits: int):
        self.directions = _main_directions(queries.units)
        along = queries.units @ self.directions
        order = np.argsort(along[:, 0]) if along.size else np.arange(len(queries.ids))
        self.q, self.scale = queries.taken(order), float(10**digits)
        self.low, self.high = _boxes(along[order], QUERY_BLOCK)
        self.far = 2.0 / self.scale + 1e-9  # rounding to digits, and of the directions
        self.narrow = self.q.units.astype(np.float32)
        dimension = self.q.units.shape[1] if self.q.units.ndim == 2 else 0
        self.slack = 2.0 / self.scale + (dimension + 8) * 2.0**-23  # rounding to digits, and of single precision
        self.floor = self.q.floors.copy()
        self.kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}  # candidates not yet merged
        self.rough = np.empty(QUERY_BLOCK * TILE_ROWS, np.float32)
        self.passing = np.empty(QUERY_BLOCK * TILE_ROWS, bool)

    def add(self, ids: np.ndarray, vectors: np.ndarray, columns: pd.DataFrame) -> None:
        if len(ids) == 0 or len(self.q.ids) == 0:
            return
        if vectors.shape[1] != self.q.units.shape[1]:
            raise ValueError("query and collection vectors differ in dimension")
        units = _unit_rows(vectors)
        along = units @ self.directions
        order = np.argsort(along[:, 0])
        units, ids, columns, along = units[order], ids[order], columns.iloc[order], along[order]
        step = max(1, SCORE_BLOCK // QUERY_BLOCK)
        for first in range(0, len(ids), step):
            part = slice(first, first + step)
            few, narrow, (low, high) = columns.iloc[part], units[part].astype(np.float32), _boxes(along[part], TILE_ROWS)
            for number, start in enumerate(range(0, len(self.q.ids), QUERY_BLOCK)):
                gap = np.maximum(0.0, np.maximum(low - self.high[number], self.low[number] - high))
                most = 1.0 - np.einsum("ij,ij->i", gap, gap) / 2  # cosine of unit vectors at that distance
                self._add_block(slice(start, min(start + QUERY_BLOCK, len(self.q.ids))), units[part], narrow, ids[part], few, most)

    def _add_block(
        self, block: slice, units: np.ndarray, narrow: np.ndarray, ids: np.ndarray, columns: pd.DataFrame, most: np.ndarray,
    ) -> None:
        """`most` is the most that a pair of the block and of each tile can score."""
        if most.max() < self.floor[block].min() - self.far:
            return
        barred = []
        for index in np.unique(self.q.filter_index[block]):  # one mask at a time: a filter per query costs no more memory
            mask = _filter_mask(self.q.filters[index], columns)
            if mask is not None:
                barred.append((np.flatnonzero(self.q.filter_index[block] == index), ~mask))
        for number in np.argsort(-most, kind="stable"):  # near tiles first: they raise the floors
            if most[number] < self.floor[block].min() - self.far:
                break
            tile = slice(number * TILE_ROWS, (number + 1) * TILE_ROWS)
            row, column = self._candidates(block, narrow[tile], [(rows, out[tile]) for rows, out in barred])
            if len(row) == 0:
                continue
            raw = _pair_scores(self.q.units[block], units[tile], row, column)
            scores = np.floor(raw * self.scale + 0.5) / self.scale
            passing = scores >= self.floor[block][row]
            self._keep(block, row[passing], scores[passing], ids[tile][column[passing]])

    def _candidates(self, block: slice, narrow: np.ndarray, barred: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(query of the block, row of the tile) of the pairs that may enter the result."""
        queries = self.narrow[block]
        shape, size = (len(queries), len(narrow)), len(queries) * len(narrow)
        rough, passing = self.rough[:size].reshape(shape), self.passing[:size].reshape(shape)
        np.matmul(queries, narrow.T, out=rough)
        for rows, out in barred:
            rough[np.ix_(rows, out)] = -np.inf
        floor = (np.maximum(self.floor[block], -2.0) - self.slack).astype(np.float32)
        np.greater_equal(rough, floor[:, None], out=passing)
        widest = int(self.q.limits[block].max())
        if widest < shape[1] and np.count_nonzero(passing) > 4 * widest * shape[0]:
            kth = np.partition(rough, -widest, axis=1)[:, -widest] - np.float32(2 * self.slack)
            np.greater_equal(rough, np.maximum(floor, kth)[:, None], out=passing)
        return np.divmod(_true_positions(self.passing, size), shape[1])

    def _keep(self, block: slice, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates wait until they are as many as the results: merging each tile's few would sort the kept rows over
        and over."""
        waiting = self.waiting.setdefault(block.start, [])
        waiting.append((rows, scores, ids))
        if block.start not in self.kept or sum(len(part[0]) for part in waiting) >= self.q.limits[block].sum():
            self._keep_best(block)

    def _keep_best(self, block: slice) -> None:
        """Merge a block's candidates; per query keep `limit` rows by score descending, id ascending."""
        parts = self.waiting.pop(block.start, [])
        if block.start in self.kept:
            parts.insert(0, self.kept[block.start])
        rows, scores, ids = (np.concatenate([part[i] for part in parts]) for i in range(3))
        if len(rows) == 0:
            return
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
        position = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
        limits = self.q.limits[block]
        keep = position < limits[rows]
        rows, scores, ids = self.kept[block.start] = rows[keep], scores[keep], ids[keep]
        counts = np.bincount(rows, minlength=len(limits))
        full = np.flatnonzero((counts >= limits) & (counts > 0))
        floor = self.floor[block]
        floor[full] = np.maximum(floor[full], scores[np.cumsum(counts)[full] - 1])

    def result(self) -> pd.DataFrame:
        rows, scores, ids = self.arrays()
        return pd.DataFrame({"query_id": self.q.ids[rows], "id": ids, "score": scores})

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(positions of queries, scores, ids) of what is kept."""
        for start in list(self.waiting):
            self._keep_best(slice(start, min(start + QUERY_BLOCK, len(self.q.ids))))
        if not self.kept:
            return np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=object)
        parts = sorted(self.kept.items())
        return np.concatenate([start + rows for start, (rows, _, _) in parts]), np.concatenate([p[1] for _, p in parts]), np.concatenate([p[2] for _, p in parts])


def _true_positions(flags: np.ndarray, size: int) -> np.ndarray:
    """Positions of the few set flags among the first `size`, eight flags looked at together."""
    words = -(-size // 8)
    flags[size : words * 8] = False
    some = np.flatnonzero(flags[: words * 8].view(np.uint64))
    word, byte = np.nonzero(flags.reshape(-1, 8)[some])
    return some[word] * 8 + byte


def _pair_scores(queries: np.ndarray, units: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Scores of single pairs in double precision; of the whole block at once where the pairs are many."""
    if len(row) * 8 > len(queries) * len(units):
        return (queries @ units.T)[row, column]
    return _listed_scores(queries, units, row, column)


def _listed_scores(queries: np.ndarray, units: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    scores = np.empty(len(row))
    for start in range(0, len(row), 1 << 15):
        part = slice(start, start + (1 << 15))
        scores[part] = np.einsum("ij,ij->i", queries[row[part]], units[column[part]])
    return scores


def _prepare_queries(queries: DataFrame, k: int, threshold: float | None) -> tuple[DataFrame, list[str]]:
    present = set(queries.columns)
    filters = [c for c in FILTER_COLUMNS if c in present]
    limit = F.col("k") if "k" in present else F.lit(k)
    floor = F.col("score_threshold") if "score_threshold" in present else F.lit(threshold)
    shaped = queries.select(
        "query_id", "embedding", limit.cast("int").alias("k"),
        F.coalesce(floor.cast("double"), F.lit(float("-inf"))).alias("score_threshold"), *filters,
    )
    return shaped, filters


def _collection_columns(collection: DataFrame, filters: list[str]) -> DataFrame:
    needed = {c.removeprefix("filter_") for c in filters}
    bases = {fv.RANGE_FILTER if n.startswith(fv.RANGE_FILTER) else n for n in needed}
    return collection.select("id", "embedding", *sorted(bases))


def top_k(
    queries: DataFrame,
    collection: DataFrame,
    k: int = fv.EVALUATION_LIMIT,
    score_threshold: float | None = None,
    digits: int = 12,
    broadcast_bytes: int = BROADCAST_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """(query_id, id, score, rank) with the k best rows per query, score descending then id ascending.

    `queries` has query_id and embedding, optionally k, score_threshold and filter columns per row.
    `collection` has id, embedding and any filterable columns; shared filters belong before this call,
    where they reach the scan.
    """
    shaped, filters = _prepare_queries(queries, k, score_threshold)
    narrow = _collection_columns(collection, filters)
    size = shaped.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.max("k").alias("k")).first()
    rows = narrow.count()
    # A task holds every query's vector and its k best rows so far.
    blocks = max(1, math.ceil(_query_bytes(size, k) / max(broadcast_bytes, 1)))
    if blocks > MAX_BLOCKS or size["n"] * rows > GRID_PAIRS:
        vectors = shaped.agg(F.approx_count_distinct(F.xxhash64("embedding", *filters))).first()[0]
        if 2 * vectors < size["n"] or size["k"] == 1 and not filters:
            return _shared_vectors(shaped, narrow, filters, digits, rows, size, k, cell_bytes)
        partial, parts = _grid_form(shaped, narrow, filters, _found_schema(shaped, narrow), digits, rows, size, k, cell_bytes)
    else:
        partial, parts = None, None
        for block in range(blocks):
            part = shaped if blocks == 1 else shaped.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            found = _broadcast_form(part, narrow, filters, _found_schema(shaped, narrow), digits)
            partial = found if partial is None else partial.unionAll(found)
    return _merge(partial, shaped, "k" in queries.columns, size["k"] or k, parts)


def _query_bytes(size, k: int) -> int:
    return size["n"] * ((size["d"] or 0) * 8 + (size["k"] or k) * BYTES_PER_RESULT)


def _found_schema(shaped: DataFrame, narrow: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", shaped.schema["query_id"].dataType),
        T.StructField("id", narrow.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _shared_vectors(shaped: DataFrame, narrow: DataFrame, filters: list[str], digits: int, rows, size, k: int, cell_bytes: int) -> DataFrame:
    """Queries that agree on vector and filters are asked once, with their largest k and smallest threshold, by the
    smallest of their ids; each takes its own part of the answer, whose order is the same."""
    agree = ["embedding", *filters]
    shaped = shaped.withColumn("_hash", F.xxhash64(*agree))  # rows meet by it: sorting vectors costs far more
    asked = materialise(shaped.groupBy("_hash", *agree).agg(
        F.min("query_id").alias("_asked"), F.max("k").alias("k"), F.min("score_threshold").alias("score_threshold")))
    queries = asked.withColumnRenamed("_asked", "query_id").drop("_hash")
    few = {"n": asked.count(), "d": size["d"], "k": size["k"]}
    partial, parts = _grid_form(queries, narrow, filters, _found_schema(queries, narrow), digits, rows, few, k, cell_bytes)
    found = _merge(partial, queries, False, size["k"] or k, parts).withColumnRenamed("query_id", "_asked")
    # The guard keeps the vectors out of the join's keys: they are compared only where the hashes agree.
    same = [F.when(shaped["_hash"] == asked["_hash"], shaped[c].eqNullSafe(asked[c])) for c in agree]
    each = shaped.join(asked, [shaped["_hash"] == asked["_hash"], *same]).select(shaped["query_id"], "_asked", shaped["k"].alias("_k"), shaped["score_threshold"].alias("_floor"))
    return each.join(found, "_asked").where((F.col("rank") <= F.col("_k")) & (F.col("score") >= F.col("_floor"))).select("query_id", "id", "score", "rank")


def _sure_floors(shaped: DataFrame, narrow: DataFrame, digits: int, number: int) -> DataFrame:
    """Queries whose vector stands in the collection at least k times need no row that scores less than these do.

    Hashes tell whether that holds for most queries; if so, the vectors settle it.
    """
    shaped = shaped.withColumn("_hash", F.xxhash64("embedding"))
    hashes = narrow.groupBy(F.xxhash64("embedding").alias("_hash")).agg(F.count("*").alias("_copies"))
    if 2 * shaped.select("_hash", "k").join(hashes, "_hash").where(F.col("_copies") >= F.col("k")).count() < number:
        return shaped.drop("_hash")
    # The hash leads the keys: rows are sorted by numbers before vectors.
    copies = narrow.groupBy(F.xxhash64("embedding").alias("_copy"), F.col("embedding").alias("_same")).agg(F.count("*").alias("_copies"))
    met = F.col("_hash") == F.col("_copy")
    same = F.when(met, F.col("embedding") == F.col("_same"))  # keeps the vectors out of the join's keys
    sure = F.when(F.col("_copies") >= F.col("k"), F.greatest("score_threshold", F.lit(1.0 - max(2.0 / 10**digits, 1e-13))))
    floored = shaped.join(copies, met & same, "left").withColumn("score_threshold", F.coalesce(sure, "score_threshold"))
    return floored.drop("_hash", "_copy", "_same", "_copies")


def _broadcast_form(shaped, narrow, filters, schema, digits) -> DataFrame:
    shared = shaped.sparkSession.sparkContext.broadcast(_Queries.from_pandas(shaped.toPandas(), filters))

    bases = [c for c in narrow.columns if c not in ("id", "embedding")]
    out_schema = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _TopK(shared.value, digits)
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            best.add(ids, _list_matrix(batch.column("embedding")), batch.select(bases).to_pandas())
        yield pa.RecordBatch.from_pandas(best.result(), schema=out_schema, preserve_index=False)

    return narrow.mapInArrow(scan, schema)


def _cells(query_bytes: int, row_bytes: int, number: int, cores: int, cell_bytes: int, pairs: int = 0) -> tuple[int, int]:
    """(cells of queries, cells of rows): of `cell_bytes` while there are few of them, of the usual size in the end;
    more of queries if that leaves cores without work or two cells with more than `CELL_PAIRS` of the `pairs`."""
    row_cells = max(1, math.ceil(row_bytes / max(cell_bytes, min(CELL_BYTES, row_bytes / CELLS))))
    query_cells = max(1, math.ceil(query_bytes / max(cell_bytes, min(CELL_BYTES, query_bytes / CELLS))))
    wanted = max(TASKS_PER_CORE * cores, math.ceil(pairs / CELL_PAIRS))
    busy = min(math.ceil(wanted / row_cells), math.ceil(number / QUERY_BLOCK))
    return max(query_cells, busy), row_cells


def _grid_form(shaped, narrow, filters, schema, digits, rows, size, k, cell_bytes) -> tuple[DataFrame, int]:
    """(winners of every cell, number of cells that hold winners of one query)."""
    if not filters:
        shaped = _sure_floors(shaped, narrow, digits, size["n"])
        if size["k"] == 1 and digits >= 9:
            shaped = materialise(shaped)
            near = (F.col("k") == 1) & (F.col("score_threshold") >= 1 - NEAR)
            number = shaped.where(near).count()
            found = _near_form(shaped.where(near), narrow, schema, digits, size["d"], number + rows) if 2 * number >= size["n"] else None
            if found is not None:
                left = size["n"] - number
                if left == 0:
                    return found, 1
                rest, parts = _grid_form_of(shaped.where(~F.coalesce(near, F.lit(False))), narrow, filters, schema, digits, rows, {"n": left, "d": size["d"], "k": 1}, k, cell_bytes)
                return found.unionAll(rest), parts
    return _grid_form_of(shaped, narrow, filters, schema, digits, rows, size, k, cell_bytes)


def _grid_form_of(shaped, narrow, filters, schema, digits, rows, size, k, cell_bytes) -> tuple[DataFrame, int]:
    cores = narrow.sparkSession.sparkContext.defaultParallelism
    query_cells, row_cells = _cells(_query_bytes(size, k), rows * (size["d"] or 0) * 8, size["n"], cores, cell_bytes, size["n"] * rows)
    left = shaped.select(
        "*", F.pmod(F.xxhash64("query_id"), F.lit(query_cells)).alias("_qc"),
        F.explode(F.sequence(F.lit(0), F.lit(row_cells - 1))).alias("_rc"),
    )
    right = narrow.select(
        "*", F.pmod(F.xxhash64("id"), F.lit(row_cells)).cast("int").alias("_rc"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_cells - 1).cast("bigint"))).alias("_qc"),
    )
    bases = [c for c in narrow.columns if c not in ("id", "embedding")]
    out_schema = to_arrow_schema(schema)

    def meet(queries: pa.Table, collection: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or collection.num_rows == 0:
            return out_schema.empty_table()
        best = _TopK(_Queries.from_pandas(queries.to_pandas(), filters), digits)
        for batch in collection.to_batches(max_chunksize=1 << 16):
            best.add(batch.column("id").to_numpy(zero_copy_only=False), _list_matrix(batch.column("embedding")), batch.select(bases).to_pandas())
        return pa.Table.from_pandas(best.result(), schema=out_schema, preserve_index=False)

    # A number of tasks by the cells: by the bytes alone, cells that take long would be put into few tasks.
    cells = query_cells * row_cells
    tasks = max(cells, min(TASKS_PER_CORE * cells, SPREAD * cores))
    left, right = (side.repartition(tasks, "_qc", "_rc") for side in (left, right))
    return left.groupBy("_qc", "_rc").cogroup(right.groupBy("_qc", "_rc")).applyInArrow(meet, schema), row_cells


def _near_cells(units: np.ndarray, reach: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the vector, number of a cell) for all cells with a point within `reach` of a vector."""
    along = units @ directions
    at, numbers = np.arange(len(units)), np.zeros(len(units), np.uint64)
    for column in along.T:
        low, high = (np.floor((column[at] + side * reach[at]) / NEAR_WIDTH).astype(np.int64).view(np.uint64) for side in (-1, 1))
        both = np.flatnonzero(low != high)
        numbers, at = np.concatenate([numbers ^ low, numbers[both] ^ high[both]]) * np.uint64(0x9E3779B97F4A7C15), np.concatenate([at, at[both]])
        numbers ^= numbers >> np.uint64(29)
    return at, numbers.view(np.int64)


def _in_cells(df: DataFrame, dimension: int, digits: int) -> DataFrame:
    """Rows with the number of their cell of space, `_cell`; a row with a score_threshold once for every cell that may
    hold a vector with that score."""
    directions = np.linalg.qr(np.random.default_rng(0).normal(size=(dimension, min(dimension, NEAR_DIRECTIONS))))[0]
    schema = T.StructType([*df.schema.fields, T.StructField("_cell", T.LongType())])
    out_schema = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = _list_matrix(batch.column("embedding"))
            if vectors.shape[1] != dimension:
                raise ValueError("query and collection vectors differ in dimension")
            reach = np.zeros(len(vectors))
            if "score_threshold" in batch.schema.names:
                gap = 1 - batch.column("score_threshold").to_numpy() + 1 / 10**digits
                reach = np.sqrt(2 * np.maximum(gap, 0)) + 1e-6  # rounding of scores and of lengths
            at, numbers = _near_cells(_unit_rows(vectors), reach, directions)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(numbers)], schema=out_schema)

    return df.mapInArrow(place, schema)


def _near_form(shaped: DataFrame, narrow: DataFrame, schema: T.StructType, digits: int, dimension: int, number: int) -> DataFrame | None:
    """The best row of each query, whose vectors are distinct and whose thresholds are near 1; None if a cell holds too
    many vectors. Of rows with one vector the smallest id wins, so vectors meet once each."""
    vectors = narrow.groupBy(F.xxhash64("embedding").alias("_hash"), "embedding").agg(F.min("id").alias("id")).select("id", "embedding")
    asked, held = (materialise(_in_cells(side, dimension, digits)) for side in (shaped.select("query_id", "embedding", "score_threshold"), vectors))
    fullest = [side.groupBy("_cell").count().agg(F.max("count")).first()[0] or 0 for side in (asked, held)]
    if max(fullest) > NEAR_ROWS:
        return None
    groups = max(TASKS_PER_CORE * shaped.sparkSession.sparkContext.defaultParallelism, math.ceil(number / NEAR_GROUP))
    out_schema, scale = to_arrow_schema(schema), float(10**digits)

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if queries.num_rows == 0 or rows.num_rows == 0:
            return out_schema.empty_table()
        order = np.argsort(rows["_cell"].to_numpy(), kind="stable")
        cells, wanted = rows["_cell"].to_numpy()[order], queries["_cell"].to_numpy()
        first = np.searchsorted(cells, wanted, "left")
        counts = np.searchsorted(cells, wanted, "right") - first
        ends, floors = np.cumsum(counts), queries["score_threshold"].to_numpy()
        ids = rows["id"].to_numpy()[order]
        units, asking = _unit_rows(_list_matrix(rows["embedding"].combine_chunks()))[order], _unit_rows(_list_matrix(queries["embedding"].combine_chunks()))
        best, start = [], 0
        while start < len(wanted):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + NEAR_PAIRS, "right")))
            row = np.repeat(np.arange(start, stop), counts[start:stop])
            column = np.arange(len(row)) + np.repeat(first[start:stop] - (ends[start:stop] - counts[start:stop] - done), counts[start:stop])
            scores = np.floor(_listed_scores(asking, units, row, column) * scale + 0.5) / scale
            passing = scores >= floors[row]
            row, column, scores = row[passing], column[passing], scores[passing]
            ranked = np.lexsort((ids[column], -scores, row))
            ranked = ranked[np.r_[True, np.diff(row[ranked]) > 0]] if len(ranked) else ranked
            best.append((row[ranked], column[ranked], scores[ranked]))
            start = stop
        row, column, scores = (np.concatenate(parts) for parts in zip(*best, strict=True))
        columns = [queries["query_id"].combine_chunks().take(pa.array(row)), pa.array(ids[column], out_schema.field("id").type), pa.array(scores)]
        return pa.Table.from_arrays(columns, schema=out_schema)

    group = F.pmod(F.xxhash64("_cell"), F.lit(groups)).alias("_group")
    left, right = (side.select("*", group).repartition(groups, "_group") for side in (asked, held))
    return left.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(meet, schema)


def _merge(partial: DataFrame, shaped: DataFrame, varying_k: bool, widest: int, parts: int | None = None) -> DataFrame:
    """Rank the per-task winners; a salted first pass bounds the rows any one task sorts for a query, unless they come
    from `parts` tasks that bound them already."""
    best_first = [F.desc("score"), F.asc("id")]
    salted = Window.partitionBy("query_id", "_salt").orderBy(*best_first)
    final = Window.partitionBy("query_id").orderBy(*best_first)
    if parts is None or parts * widest > MERGE_ROWS:
        partial = (
            partial.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(MERGE_FAN_IN)))
            .withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= widest).drop("_r", "_salt")
        )
    ranked = partial.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= widest)
    if varying_k:
        limits = shaped.select("query_id", F.col("k").alias("_k"))
        ranked = ranked.join(limits, "query_id").where(F.col("rank") <= F.col("_k")).drop("_k")
    return ranked


def exact_scores(queries: DataFrame, pairs: DataFrame, collection: DataFrame, digits: int = 12) -> DataFrame:
    """Scores of given (query_id, id) pairs, in SQL expressions: the readable check of the kernel."""
    from terralex.functions.numeric import round_half_up
    from terralex.functions.vectors import cosine

    joined = (
        pairs.join(queries.select("query_id", F.col("embedding").alias("_q")), "query_id")
        .join(collection.select("id", F.col("embedding").alias("_v")), "id")
    )
    return joined.withColumn("score", round_half_up(cosine(F.col("_q"), F.col("_v")), digits)).drop("_q", "_v")

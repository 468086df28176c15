"""JN-9 / SRT-1: exact dense retrieval (inner product on normalised prefixes,
top-k per query) as one streaming scan of the products.

Exact search must score every query against every product, but it need not
emit, replicate or even exchange the products. A batch of queries, bounded by
``QUERY_BATCH_BYTES``, is broadcast; ``mapInArrow`` streams the products past
it where they lie, one numpy matrix product per Arrow batch, and each task
keeps one running top-k per query. Exactly k rows per query and *task* leave
the scan; the final top-k is a window with a partial WindowGroupLimit.

More queries than a batch holds are dealt into batches by a hash of their id;
each batch is one more scan, and its list is written before the next begins, so
neither the driver nor a task ever holds more than one batch.

Vectors that are null or hold null or non-finite components are not ranked and
do not rank; vectors narrower than the prefix, or of another width than the
queries', raise. A zero vector scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rankforge.functions.vectors import NORM_FLOOR, prefix
from rankforge.operators.ranking import top_k
from rankforge.sources.clustered import written

QUERY_BATCH_BYTES = 64 << 20  # vectors and running lists of the queries of one scan
SCORES_AT_ONCE = 1 << 20      # entries of a score matrix (bounds task memory)
ENTRIES_AT_ONCE = 1 << 18     # list entries that are merged or given out at once
WIDEST = 4096                 # width assumed for sizing a batch before a vector was seen


# ------------------------------------------------------------- Arrow to numpy
def vector_rows(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of unit rows, row numbers) of the usable vectors of an Arrow
    list column. Rows of another width than ``width`` raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    usable = np.array(column.is_valid()) if column.null_count else np.ones(len(column), bool)
    if len(sizes) and width is None and usable.any():
        width = int(sizes[usable][0])
    if (sizes[usable] != width).any():
        raise ValueError(f"vector of {int(sizes[usable][sizes[usable] != width][0])} components, {width} expected")
    rows = np.flatnonzero(usable)
    if not len(rows):
        return np.zeros((0, width or 0)), rows
    flat = column.take(pa.array(rows)).flatten() if column.null_count else column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(rows), width)
    finite = np.isfinite(values).all(axis=1)  # a null component arrives as NaN
    if not finite.all():
        values, rows = values[finite], rows[finite]
    norms = np.sqrt(np.einsum("ij,ij->i", values, values))
    return values / np.maximum(norms, NORM_FLOOR)[:, None], rows


def id_array(column) -> np.ndarray:
    """Ids as an array that numpy can sort."""
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(str) if values.dtype == object else values


class RunningTopK:
    """The k best (score desc, id asc) of every query over blocks of products.

    The lists are kept in ranges of neighbouring queries and new entries are
    merged range by range, so a merge never copies more than one range: a task
    holds the lists once, at most half as many new entries, and one range."""

    def __init__(self, n_queries: int, k: int, digits: int | None):
        self.k, self.digits = k, digits
        self.floor = np.full(n_queries, -np.inf)  # the k-th best score so far
        self._parts, self._n = [], 0
        self._most = max(ENTRIES_AT_ONCE, n_queries * k // 2)
        step = max(1, ENTRIES_AT_ONCE // max(1, k))
        self._starts = np.arange(0, n_queries, step)
        self._kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the queries ``rows`` (matrix rows) for products ``ids``."""
        if self.digits is not None:
            scores = np.round(scores, self.digits)
        floor, n = self.floor[rows], scores.shape[1]
        if n > self.k:
            floor = np.maximum(floor, np.partition(scores, n - self.k, axis=1)[:, n - self.k])
        # a score that equals the k-th best stays: its id may be the lower one
        q, p = np.nonzero(scores >= floor[:, None])
        self._parts.append((rows[q], scores[q, p], ids[p]))
        self._n += len(q)
        if self._n > self._most:
            self._cut()

    def _cut(self) -> None:
        rows, scores, ids = (np.concatenate(x) for x in zip(*self._parts))
        self._parts, self._n = [], 0
        order = np.argsort(rows, kind="stable")
        ends = np.searchsorted(rows, [*self._starts, len(self.floor)], sorter=order)
        for r in np.flatnonzero(np.diff(ends)).tolist():
            mine = order[ends[r]:ends[r + 1]]
            self._merge(r, (rows[mine], scores[mine], ids[mine]))

    def _merge(self, r: int, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        rows, scores, ids = (np.concatenate(x) for x in zip(self._kept[r], new)) if r in self._kept else new
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep, last = nth < self.k, nth == self.k - 1
        self.floor[rows[last]] = scores[order[last]]
        self._kept[r] = rows[keep], scores[order[keep]], ids[order[keep]]

    def ranges(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, score, id) of the best, one range of queries at a time;
        what was given out is forgotten."""
        if self._parts:
            self._cut()
        for r in sorted(self._kept):
            yield self._kept.pop(r)

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, score, id) of the best."""
        parts = list(self.ranges())
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts))


# ------------------------------------------------------------- query batches
def query_batches(queries: DataFrame, k: int, width: int | None, batch_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of all queries (query_id, vec), at most about
    ``batch_bytes`` at once. The first batch is only taken whole if nothing is
    left behind it; otherwise the queries are counted and dealt out."""
    most = max(1, batch_bytes // (8 * (width or WIDEST) + 24 * k))
    got = queries.limit(most + 1).toArrow()
    if got.num_rows <= most:
        yield _batch(got, width)
        return
    batches = -(-queries.count() // most)
    for b in range(batches):
        yield _batch(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == b).toArrow(), width)


def _batch(got: pa.Table, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    vectors, rows = vector_rows(got.column("vec"), width)
    return id_array(got.column("query_id"))[rows], vectors


def list_batches(query_ids: np.ndarray, best: RunningTopK, types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """A task's lists as (query_id, product_id, score)."""
    for rows, scores, ids in best.ranges():
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[rows]).cast(types[0]), pa.array(ids).cast(types[1]), pa.array(scores)],
                                         names=["query_id", "product_id", "score"])


def list_schema(queries: DataFrame, products: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                         T.StructField("product_id", products.schema["product_id"].dataType), T.StructField("score", T.DoubleType())])


def ranked_best(lists: list[DataFrame], k: int, source: str) -> DataFrame:
    """(query_id, source, product_id, score, rank) of the tasks' lists."""
    ranked = top_k(reduce(DataFrame.unionByName, lists), "query_id", [F.col("score").desc(), F.col("product_id").asc()], k)
    return ranked.select("query_id", F.lit(source).alias("source"), "product_id", "score", "rank")


def dense_search(queries: DataFrame, products: DataFrame, k: int, dim: int | None = None,
                 query_col: str = "query_id", product_col: str = "product_id",
                 query_vec: str = "embedding", product_vec: str = "embedding",
                 source: str = "dense", digits: int | None = 9, batch_bytes: int = QUERY_BATCH_BYTES) -> DataFrame:
    """Ranked list (query_id, source, product_id, score, rank 0-based) of the
    k nearest products of every query by inner product of the L2-normalised
    ``dim``-prefixes. Only real products are ranked (k > N gives N rows).
    Fetches the queries; the scan is lazy unless there are several batches."""
    q = queries.select(F.col(query_col).alias("query_id"), prefix(query_vec, dim).alias("vec"))
    p = products.select(F.col(product_col).alias("product_id"), prefix(product_vec, dim).alias("vec"))
    schema = list_schema(q, p)
    types, k = [to_arrow_type(f.dataType) for f in schema], int(k)

    def scan(shared):
        def run(batches):
            ids, vectors = shared.value
            best = RunningTopK(len(ids), k, digits)
            for batch in batches if len(ids) else ():
                products, rows = vector_rows(batch.column(1), vectors.shape[1])
                names, at_once = id_array(batch.column(0))[rows], max(1, SCORES_AT_ONCE // max(1, len(rows)))
                for lo in range(0, len(ids) if len(rows) else 0, at_once):
                    part = np.arange(lo, min(lo + at_once, len(ids)))
                    best.add(part, vectors[part] @ products.T, names)
            yield from list_batches(ids, best, types)
        return run

    context = queries.sparkSession.sparkContext
    lists = (p.mapInArrow(scan(context.broadcast(b)), schema) for b in query_batches(q, k, dim, batch_bytes))
    return ranked_best(one_by_one(lists), k, source)


def one_by_one(lists: Iterator[DataFrame]) -> list[DataFrame]:
    """All lists; from the second on each is written when it is made, so that
    the driver fetches a batch only after the one before is done."""
    first = next(lists)
    second = next(lists, None)
    if second is None:
        return [first]
    return [written(first), written(second), *(written(x) for x in lists)]

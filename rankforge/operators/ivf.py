"""OPT-2: approximate vector search with an inverted file of cells.

Build: coarse centroids are learned by spherical k-means in numpy on a bounded
sample (``sample_rows``), every product is assigned to its nearest centroid, and
the rows are written in folders of their cell. A cell with many rows (copies of
one vector, say) is dealt over several files by a hash of the id, so no task
writes or reads it alone.

Search: a batch of queries is compared with the centroids and probes its
``probes`` nearest cells. The scan reads only folders that some query probes
(partition pruning), scores each cell against the queries that probe it, and
keeps one running top-k per query and task, as the exact scan does.

``tune_probes`` finds how many probes reach a recall on held-back sample
vectors; ``recall_at_k`` measures it against the exact scan. Probing all cells
gives the exact list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from rankforge.functions.vectors import prefix
from rankforge.operators import dense as D
from rankforge.sources.clustered import scratch_folder, written

MOST_CELLS = 4096
SAMPLE_ROWS = 50_000
ROWS_PER_FILE = 200_000


@dataclass
class IvfIndex:
    rows: DataFrame          # product_id, vec, cell (folders of cell)
    centroids: np.ndarray    # unit rows
    probes: int              # cells a query reads unless told otherwise
    n_rows: int
    path: str


# ------------------------------------------------------------- learning
def learn_centroids(vectors: np.ndarray, n_cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centroids that attract the unit rows of
    ``vectors``. An empty cell is moved to the row that fits its cell least."""
    rng = np.random.default_rng(seed)
    different = np.unique(vectors, axis=0)
    n_cells = max(1, min(n_cells, len(different)))
    centroids = different[rng.choice(len(different), n_cells, replace=False)]
    for _ in range(rounds):
        cell, fit = nearest_cells(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, vectors)
        lost = np.flatnonzero(np.bincount(cell, minlength=n_cells) == 0)
        sums[lost] = vectors[np.argsort(fit)[:len(lost)]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-10), centroids)
    return centroids


def nearest_cells(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, inner product with its centroid) of every row."""
    cells, fits = [np.zeros(0, np.int64)], [np.zeros(0)]
    step = max(1, D.SCORES_AT_ONCE // max(1, len(centroids)))
    for lo in range(0, len(vectors), step):
        scores = vectors[lo:lo + step] @ centroids.T
        cells.append(scores.argmax(axis=1))
        fits.append(scores.max(axis=1))
    return np.concatenate(cells), np.concatenate(fits)


def probed_cells(vectors: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """The ``probes`` nearest cells of every row, nearest first."""
    return np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :probes]


def tune_probes(vectors: np.ndarray, centroids: np.ndarray, k: int = 100, target: float = 0.95, n_queries: int = 200) -> int:
    """The fewest probes whose mean recall of the k nearest sample vectors
    reaches ``target``, over ``n_queries`` sample vectors. A sample is thinner
    than the table, so its k nearest lie farther away and need more probes."""
    queries = vectors[np.linspace(0, len(vectors) - 1, min(n_queries, len(vectors))).astype(int)] if len(vectors) else vectors
    if not len(queries):
        return len(centroids)
    scores = queries @ vectors.T
    best = np.argsort(-scores, axis=1, kind="stable")[:, :min(k, len(vectors))]
    cell, _ = nearest_cells(vectors, centroids)
    order = probed_cells(queries, centroids, len(centroids))
    place = np.empty_like(order)  # when a query probes a cell
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(order), 0), axis=1)
    needed = np.take_along_axis(place, cell[best], axis=1)
    recall = np.cumsum(np.bincount(needed.ravel(), minlength=len(centroids))) / needed.size
    return int(np.searchsorted(recall, target) + 1) if target < 1 else len(centroids)


# ------------------------------------------------------------- index
def build_ivf(products: DataFrame, dim: int | None = None, product_col: str = "product_id", product_vec: str = "embedding",
              n_cells: int | None = None, sample_rows: int = SAMPLE_ROWS, k: int = 100, target: float = 0.95,
              path: str | None = None, seed: int = 0) -> IvfIndex:
    """An index of all products. Runs jobs: a count, the sample, the
    assignment and the write. ``n_cells`` defaults to the root of the number of
    rows, at most ``MOST_CELLS``. Unusable vectors (see dense.py) are left out."""
    spark = products.sparkSession
    p = products.select(F.col(product_col).alias("product_id"), prefix(product_vec, dim).alias("vec"))
    total = p.count()
    n_cells = n_cells or int(min(MOST_CELLS, max(1, round(total ** 0.5))))
    share = min(1.0, sample_rows / max(1, total))
    pick = F.pmod(F.xxhash64(F.col("product_id"), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True)
    sample, _ = D.vector_rows(p.where(pick).select("vec").toArrow().column("vec"), dim)
    if not len(sample):
        sample = np.zeros((1, dim or 1))
    centroids = learn_centroids(sample, n_cells, seed=seed)
    shared = spark.sparkContext.broadcast(centroids)
    vec_type = p.schema["vec"].dataType.simpleString()
    id_type = p.schema["product_id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, rows = D.vector_rows(batch.column(1), dim)
            if len(rows):
                kept = batch.take(pa.array(rows))
                cell, _ = nearest_cells(vectors, shared.value)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell.astype(np.int32))], names=["product_id", "vec", "cell"])

    assigned = written(p.mapInArrow(assign, f"product_id {id_type}, vec {vec_type}, cell int"))
    sizes = {r[0]: r[1] for r in assigned.groupBy("cell").count().collect()}  # one row per cell
    path = path or scratch_folder(spark)
    files = F.array(*[F.lit(-(-sizes.get(c, 1) // ROWS_PER_FILE)) for c in range(len(centroids))])
    dealt = assigned.withColumn("file", F.pmod(F.xxhash64("product_id"), F.get(files, F.col("cell"))))
    dealt.repartition("cell", "file").drop("file").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    probes = tune_probes(sample, centroids, k, target)
    told = [(c, [float(x) for x in v], probes, sum(sizes.values())) for c, v in enumerate(centroids)]
    spark.createDataFrame(told, "cell int, centroid array<double>, probes int, n_rows long").write.mode("overwrite").parquet(f"{path}/centroids")
    return read_ivf(spark, path)


def read_ivf(spark: SparkSession, path: str) -> IvfIndex:
    """The index that ``build_ivf`` left in ``path``; raises if rows are missing."""
    told = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()  # at most MOST_CELLS
    n_rows = told[0]["n_rows"]
    if n_rows == 0:
        rows = spark.createDataFrame([], "product_id long, vec array<float>, cell int")
    else:
        rows = spark.read.parquet(f"{path}/rows")
    if (got := rows.count()) != n_rows:
        raise ValueError(f"index at {path} is incomplete: {got} rows, {n_rows} were written")
    return IvfIndex(rows, np.array([r["centroid"] for r in told]), told[0]["probes"], n_rows, path)


# ------------------------------------------------------------- search
def ivf_search(index: IvfIndex, queries: DataFrame, k: int, dim: int | None = None, probes: int | None = None,
               query_col: str = "query_id", query_vec: str = "embedding", source: str = "dense",
               digits: int | None = 9, batch_bytes: int = D.QUERY_BATCH_BYTES) -> DataFrame:
    """Ranked list as ``dense_search`` gives it, over the probed cells only."""
    probes = min(probes or index.probes, len(index.centroids))
    q = queries.select(F.col(query_col).alias("query_id"), prefix(query_vec, dim).alias("vec"))
    schema = D.list_schema(q, index.rows)
    types, k = [to_arrow_type(f.dataType) for f in schema], int(k)
    context = queries.sparkSession.sparkContext

    def scan(shared):
        def run(batches):
            ids, vectors, of_cell = shared.value
            best = D.RunningTopK(len(ids), k, digits)
            for batch in batches:
                products, rows = D.vector_rows(batch.column(1), vectors.shape[1])
                names, cells = D.id_array(batch.column(0))[rows], batch.column(2).to_numpy()[rows]
                for cell in np.unique(cells):
                    mine = cells == cell
                    asking = of_cell[int(cell)]
                    step = max(1, D.SCORES_AT_ONCE // int(mine.sum()))
                    for lo in range(0, len(asking), step):
                        part = asking[lo:lo + step]
                        best.add(part, vectors[part] @ products[mine].T, names[mine])
            yield from D.list_batches(ids, best, types)
        return run

    def lists():
        for ids, vectors in D.query_batches(q, k, index.centroids.shape[1], batch_bytes):
            cells = probed_cells(vectors, index.centroids, probes) if len(ids) else np.zeros((0, probes), np.int64)
            asking = np.repeat(np.arange(len(ids)), cells.shape[1])
            order = np.argsort(cells.ravel(), kind="stable")
            read, first = np.unique(cells.ravel()[order], return_index=True)
            of_cell = dict(zip(read.tolist(), np.split(asking[order], first[1:])))
            rows = index.rows.where(F.col("cell").isin([int(c) for c in read])).select("product_id", "vec", "cell")
            yield rows.mapInArrow(scan(context.broadcast((ids, vectors, of_cell))), schema)

    return D.ranked_best(D.one_by_one(lists()), k, source)


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, n_exact, n_found, recall): the share of each query's exact
    list that the other list holds."""
    hits = exact.join(found.select("query_id", "product_id", F.lit(1).alias("hit")), ["query_id", "product_id"], "left")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).select(
        "query_id", "n_exact", "n_found", (F.col("n_found") / F.col("n_exact")).alias("recall"))

"""Embedding near-dedup by iterative quantisation and multi-index tables.

1. Vectors that are equal (same label, same components) are one class; one
   representative goes on, with the number of its copies.
2. Iterative quantisation: on a bounded sample of representatives, the unit
   vectors are centred and turned to their principal axes; then a rotation is
   learned by alternating "codes = signs of the rotated data" and "rotation
   that brings the data closest to the codes". Several starts give as many
   bits as the tables need.
3. Multi-index tables: each table takes ``width`` bits of the code; the width
   follows the logarithm of the number of representatives, so that buckets do
   not grow with the corpus, and the number of tables follows from the width
   so that a pair at the threshold is missed in all of them with probability
   ``miss``; how often its bits agree is taken from the centred norms of the
   sample, because centring widens angles where vectors share a direction.
   Buckets hold representatives of one label.
4. Rerank: members of a bucket are compared by cosine in double precision, in
   blocks of bounded size. A block gives link counts and spanning-forest edges,
   never its pairs; a pair counts only in the first table that holds it.
5. Large-star / small-star closes the links into components.

Vectors that are null, empty, zero or hold null or non-finite components, rows
with a null label and rows without an id link with nothing (n_links 0, their
own component, kept). Vectors of different lengths do not link. Repeated rows
count as vectors of their own. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch
from rankforge.llm.components import block_pairs, connected_components

SAMPLE_VALUES = 2_000_000  # numbers in the sample that the rotation is learned on
LOW_NORM = 0.01  # quantile of the centred square norms that the tables are made for
MANY_TABLES = 48  # 42 are needed for 30 bits at 0.98 without a common direction
ROW_COST = 250  # comparisons that take as long as moving one vector to a bucket
SALTS = 1024  # shares that the copies of one vector are dealt into
BLOCK = 2000  # members of a bucket that are compared at once
TILE = 128


# ------------------------------------------------------------- quantiser
@dataclass
class Quantiser:
    mean: np.ndarray
    planes: np.ndarray  # one column per bit
    width: int
    tables: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """One integer per vector and table."""
        bits = ((unit - self.mean) @ self.planes > 0).reshape(len(unit), self.tables, self.width)
        return bits @ (1 << np.arange(self.width, dtype=np.int64))


def matrix(column, kind=float) -> np.ndarray:
    """Rows of a list column without nulls as one array, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    wide = sizes.max(initial=0)
    if (sizes == wide).all():
        return flat.reshape(len(sizes), wide)
    out = np.zeros((len(sizes), wide), kind)
    out[np.arange(wide) < sizes[:, None]] = flat
    return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled first, so that squares do not overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(unit: np.ndarray, width: int, tables: int, rounds: int = 30, seed: int = 3) -> Quantiser:
    """Rotations of the centred sample, by alternating quantisation."""
    rng = np.random.default_rng(seed)
    d = unit.shape[1]
    mean = unit.mean(axis=0)
    centred = unit - mean
    _, _, axes = np.linalg.svd(centred.T @ centred)
    data = centred @ axes.T
    planes = []
    for _ in range(-(-width * tables // d)):
        turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
        for _ in range(rounds):
            signs = np.where(data @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(data.T @ signs)
            turn = left @ right
        planes.append(axes.T @ turn)
    return Quantiser(mean, np.concatenate(planes, axis=1)[:, :width * tables], width, tables)


def centred_cosine(unit: np.ndarray, mean: np.ndarray, threshold: float) -> float:
    """Cosine that a pair at the threshold has after centring, for vectors whose
    centred square norm is the sample's low quantile: centring keeps distances."""
    low = np.quantile(((unit - mean) ** 2).sum(axis=1), LOW_NORM)
    return float(np.clip(1 - (1 - threshold) / max(low, 1e-9), 0.0, min(threshold, 1.0)))


def layout(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits per table, tables) for n representatives; ``threshold`` is the
    cosine of the vectors that give the bits. Where more than ``MANY_TABLES``
    would be needed, fewer bits may cost less: larger buckets, fewer tables."""
    agree = 1 - np.arccos(min(threshold, 1.0)) / np.pi  # of one bit, at the threshold
    width = int(np.clip(np.ceil(np.log2(max(n, 2))) - 2, 8, 30))
    needed = lambda w: max(4, int(np.ceil(np.log(miss) / np.log1p(-min(agree ** w, 1 - 1e-9)))))
    if needed(width) > MANY_TABLES:
        width = min(range(4, width + 1), key=lambda w: needed(w) * (ROW_COST + n / 2 ** w))
    return width, needed(width)


# ------------------------------------------------------------- rerank
FOUND = "u long, v long, n long"  # v null: u has n more links; else an edge


def _rerank(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("rep").to_numpy()
        own, lo, hi, parts, nth = (table.column(c).to_numpy() for c in ("own", "lo", "hi", "parts", "nth"))
        copies = table.column("copies").to_numpy().astype(float)
        unit = unit_rows(matrix(table.column("vector")))
        codes = matrix(table.column("codes"), np.int64)[:, :nth[0]]
        # members of one block meet in several block pairs: they count in the pair with the next block
        nxt = (own + 1) % parts
        here = (parts == 1) | (np.minimum(own, nxt) == lo) & (np.maximum(own, nxt) == hi)
        links, group, edges = np.zeros(len(ids)), np.arange(len(ids)), []
        for k in range(0, len(ids), TILE):
            near = unit[k:k + TILE] @ unit.T >= threshold
            a, b = np.nonzero(np.triu(near, k + 1))
            a += k
            ok = here[a] | (own[a] != own[b])
            a, b = a[ok], b[ok]
            for t in range(codes.shape[1]):  # seen in an earlier table
                ok = codes[a, t] != codes[b, t]
                a, b = a[ok], b[ok]
            links += np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            for i in np.unique(a):
                with_i = b[a == i]
                while len(with_i := with_i[group[with_i] != group[i]]):
                    edges.append((i, with_i[0]))
                    group[group == group[with_i[0]]] = group[i]
        at, e = np.flatnonzero(links), np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"u": np.concatenate((ids[at], ids[e[:, 0]])),
                         "v": pa.array([*[None] * len(at), *ids[e[:, 1]].tolist()], pa.int64()),
                         "n": pa.array([*links[at].astype(int).tolist(), *[None] * len(e)], pa.int64())})

    return run


# ------------------------------------------------------------- operator
def link(vectors: DataFrame, threshold: float = 0.98, miss: float = 0.002, block: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links,
    component_id, kept. Runs jobs and keeps its tables in the shared folder;
    the result is lazy."""
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    fit = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()
           & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0))
    usable = rows.where(fit)
    usable = usable.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    # a vector that very many rows share is at most SALTS rows here
    shares = usable.groupBy("label", "vector", "salt").agg(F.min("vec_id").alias("least"), F.count("*").alias("c"))
    classes = scratch.save(shares.groupBy("label", "vector").agg(F.min("least").alias("rep"), F.sum("c").alias("copies")), "classes")
    stats = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    count, dim = stats[0], stats[1] or 1
    wanted = max(2, min(count, SAMPLE_VALUES // dim))
    pick = F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, wanted / max(count, 1)))
    sample = classes.where(pick).select("vector").limit(2 * wanted).collect()

    def padded(vectors) -> np.ndarray:
        x = matrix(vectors)
        return unit_rows(np.pad(x, ((0, 0), (0, dim - x.shape[1]))))

    if len(sample) > 1:
        unit = padded(pa.array([r["vector"] for r in sample], pa.list_(pa.float64())))
        width, tables = layout(count, centred_cosine(unit, unit.mean(axis=0), threshold), miss)
        quantiser = learn(unit, width, tables)
    else:
        width, tables = layout(count, threshold, miss)
        quantiser = Quantiser(np.zeros(dim), np.eye(dim, width * tables), width, tables)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                codes = quantiser.codes(padded(batch.column("vector")))
                at = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("group"), pa.ListArray.from_arrays(at, pa.array(codes.ravel()))],
                                                 names=["rep", "group", "codes"])

    coded = scratch.save(classes.select("rep", F.xxhash64("label", F.size("vector")).alias("group"), "vector")
                         .mapInArrow(encode, "rep long, group long, codes array<long>"), "codes")
    keyed = coded.select("rep", "group", F.posexplode("codes").alias("nth", "code")).select(
        "rep", "nth", F.struct("group", "nth", "code").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = (block_pairs(keyed, sizes, "key", "rep", block)
               .join(coded.select("rep", "codes"), "rep").join(classes.select("rep", "vector", "copies"), "rep"))
    found = scratch.save(members.groupBy("key", "lo", "hi").applyInArrow(_rerank(threshold), FOUND), "found")
    joined = scratch.save(connected_components(found.where("v IS NOT NULL").select("u", "v"), scratch, "linked"), "joined")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("_links"))
    of_class = (classes.join(links, "rep", "left").join(joined, classes.rep == joined.node, "left")
                .select("label", "vector", (F.col("copies") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"),
                        F.coalesce("component", "rep").alias("component_id")))
    own = shares.select("label", "vector", "salt").join(of_class, ["label", "vector"])
    known = (usable.join(own, ["label", "vector", "salt"])
             .select("vec_id", "n_links", "component_id", (F.col("component_id") == F.col("vec_id")).alias("kept")))
    alone = (rows.where(~F.coalesce(fit, F.lit(False)))
             .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
    return known.union(alone)

"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankforge.session import checkpoint_dir, ship_package

HELD_OUT_MOD = 5  # documents with crc32(id) % 5 == 0 are never learned from


class Scratch:
    """Intermediate tables of one run, as Parquet in the shared checkpoint
    folder. A written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession):
        ship_package(spark)
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/rankforge-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table (lazy, prunable)."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Delete one table (or all) that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5 (null id: text '')."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_MOD == 0


def sample_by_hash(df: DataFrame, stratum: str, per_stratum: int, key: str = "doc_id", most_strata: int = 1000) -> DataFrame:
    """About ``per_stratum`` rows of each of the ``most_strata`` largest strata,
    chosen by a hash of the key.

    Strata with fewer rows are taken whole. At most twice the wanted number of
    rows of a stratum comes back, also where very many rows share a key, so a
    caller may collect what it derives from them.
    """
    counts = [(r[0], r[1]) for r in df.groupBy(stratum).count().orderBy(F.desc("count"), stratum).limit(most_strata).collect()]
    if not counts:
        return df.limit(0)
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(stratum).eqNullSafe(F.lit(value)), F.lit(min(1.0, per_stratum / n))).otherwise(share)
    order = F.xxhash64(F.coalesce(F.col(key), F.lit(-1)), F.lit(17))
    pick = F.pmod(order, F.lit(1 << 20)) / float(1 << 20)
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return df.where(pick < share).withColumn("_rf_nth", nth).where(F.col("_rf_nth") <= 2 * per_stratum).drop("_rf_nth")


def slices(sizes: np.ndarray, budget: int):
    """Consecutive (start, stop) ranges whose sizes add up to about ``budget``."""
    start, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > budget:
            yield start, i
            start, total = i, 0
        total += int(s)
    if start < len(sizes):
        yield start, len(sizes)

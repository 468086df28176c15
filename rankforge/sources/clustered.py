"""Tables clustered by document: bucketed Parquet.

Postings and learned term weights are written in buckets of ``doc_id``. A scan
then reports that clustering, so sums per (query, document) and the partial
top-k behind them stay in the task that reads the bucket: no exchange of
(query, document) rows. The bucket count follows from the bytes that the
written rows are computed from, and is at least the session's shuffle
partition count, unless it is given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankforge.session import checkpoint_dir, shuffle_partitions


BUCKET_BYTES = 256 << 20  # source bytes that one bucket, and so one task of a search, stands for
UNKNOWN_BYTES = 1 << 60  # Spark reports sizes it cannot tell as the largest long


def _name() -> str:
    return f"rankforge_{uuid.uuid4().hex}"


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{_name()}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet below the shared checkpoint folder (runs a job): cuts
    lineage, prunes columns when read, survives lost executors."""
    path = scratch_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def source_bytes(df: DataFrame) -> int:
    """Bytes of the tables and files that ``df`` reads, as Spark's statistics
    tell them without a job; sources of unknown size count 0. The analyzed plan
    still names the files below a persisted table."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def bucket_count(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for rows computed from ``df``: one per ``bucket_bytes`` that it
    reads, at least the shuffle partitions, at most what Spark allows."""
    spark = df.sparkSession
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(max(shuffle_partitions(spark), -(-source_bytes(df) // bucket_bytes)), most)


def write_clustered(df: DataFrame, key: str = "doc_id", path: str | None = None,
                    buckets: int | None = None, clustered: bool = False) -> DataFrame:
    """Write ``df`` in buckets of ``key`` (default: below the shared checkpoint
    folder) and return the bucketed table. Runs one job. ``clustered`` says
    that ``df`` already is hash-partitioned into ``buckets`` by the key."""
    spark = df.sparkSession
    n = buckets or bucket_count(df)
    name = _name()
    path = path or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    rows = df if clustered else df.repartition(n, key)
    (rows.write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key)
     .option("path", path).saveAsTable(name))
    return spark.table(name)


def read_clustered(spark: SparkSession, path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """The bucketed table that ``write_clustered`` left in ``path``."""
    name = _name()
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)

"""Sharding by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a prime-sized
table: slot ``(offset + i * skip) mod size`` for i = 0, 1, ..., with offset and
skip hashed from its name. The shards take turns; at its turn a shard claims
the first slot of its order that nobody has. Shards so differ by at most one
slot, and when a shard leaves, almost all slots keep their owner.

A row's slot is a hash of its key. The table has ``size`` rows whatever the
data, so it is broadcast: placement is one array lookup per row, no shuffle,
and a hot source or key is spread because the key is the document id.

Odd input: a null key hashes like the empty text; repeated ids meet in the
same shard; an empty table gives an empty result; extra columns stay; a
column that has the name of an output already raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # prime


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Owner (index into ``shards``) of every slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be given and distinct")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime not below the number of shards")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digests]
    owner = [-1] * size
    at, filled = list(offset), 0
    while filled < size:
        for s in range(len(shards)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + skip[s]) % size
            owner[at[s]] = s
            filled += 1
            if filled == size:
                break
    return np.array(owner, np.int32)


def slot_of(key: Column, size: int) -> Column:
    """Slot of a key: the first 60 bits of its MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def assign(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
           slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and the shard name of every row."""
    if taken := sorted({slot_col.lower(), shard_col.lower()} & {c.lower() for c in df.columns}):
        raise ValueError(f"the table has a column {', '.join(taken)} already: choose other names")
    spark = df.sparkSession
    table = lookup_table(shards, size)
    rows = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(table.tolist())], f"_rf_slot long, `{shard_col}` string")
    placed = df.withColumn(slot_col, slot_of(F.col(key), size))
    # exactly ``size`` rows, fixed by the parameter: safe to broadcast
    return placed.join(F.broadcast(rows), F.col(slot_col) == F.col("_rf_slot"), "left").drop("_rf_slot")


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", files_per_shard: int = 1) -> None:
    """One folder per shard; several files each spread a large shard over tasks."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_shard))
    (df.repartition(F.col(shard_col), salt).write.mode("error").partitionBy(shard_col).parquet(path))

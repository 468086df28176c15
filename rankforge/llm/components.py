"""Connected components and bounded blocks of groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch

PIVOTS = 8  # members of a large key that all of its blocks see, about


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v), by alternating
    large-star and small-star; the component is its smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest node it sees. A round is written to the shared folder and the
    one before it is dropped. The joins are plain equi-joins of an edge list
    with one row per node, so a hub with very many neighbours is a skewed join
    that adaptive execution splits; its minimum is pre-aggregated.
    """
    def mark(table: DataFrame):
        row = table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        return row[0], row[1]

    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .where("u <> v").distinct(), f"{name}-0")
    seen, k = mark(now), 0
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        k += 1
        now = scratch.save(small, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        was, seen = seen, mark(now)
        if seen == was:
            break
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def block_pairs(rows: DataFrame, sizes: DataFrame, key: str, member: str, block: int) -> DataFrame:
    """``rows`` with (key, lo, hi) such that any two members of a key meet in
    some block pair and no block pair holds more than about 2 * ``block`` rows.

    ``sizes`` has (key, n) of the keys to keep. A key with n members is dealt
    into ceil(n / block) blocks by a hash of the member; a row goes once into
    each pair of its block with another one. ``own`` and ``parts`` tell a row's
    block and how many there are.
    """
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return (rows.join(sizes, key)
            .withColumn("parts", parts).withColumn("own", own).withColumn("_other", other)
            .where("parts = 1 OR own <> _other")
            .withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other"))
            .drop("n", "_other"))


def deal(rows: DataFrame, member: str, block: int) -> DataFrame:
    """``rows`` (with ``n``, the size of their key) once in the block of their
    member, and the few pivots of a key in each of its blocks: (lo, hi = lo).

    The rows grow with n, not with its square: a key has about ``PIVOTS`` pivots
    and ceil(n / block) blocks.
    """
    pivot = (F.col("parts") > 1) & (F.pmod(F.xxhash64(member, F.lit(7)), F.col("n")) < PIVOTS)
    return (rows.withColumn("parts", F.ceil(F.col("n") / F.lit(block)).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64(member), F.col("parts")).cast("int"))
            .withColumn("lo", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("own"))))
            .withColumn("hi", F.col("lo")))


def close_groups(rows: DataFrame, most: int, details: DataFrame, key: str, member: str, block: int,
                 link: Callable, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) of the members that ``link`` joins within a key.

    ``rows`` has (key, member, n) with n the size of the key, ``most`` is the
    largest n, ``details`` holds what ``link`` reads of a member (columns that
    ``rows`` may carry already). ``link`` gets one block as an Arrow table and
    returns edges (u, v) of a spanning forest of it.

    Keys of up to ``block`` members are one block. A larger key is dealt into
    blocks that share a few pivots, so that a family that is linked throughout
    becomes one component with rows in proportion to n. What the blocks left
    outside the largest component of its key then meets all members of the key,
    again in blocks, so no link between two components is lost: the rows of that
    step are n * outside / block.
    """
    def edges(dealt: DataFrame) -> DataFrame:
        whole = dealt if set(details.columns) <= set(dealt.columns) else dealt.join(details, member)
        return whole.groupBy(key, "lo", "hi").applyInArrow(link, "u long, v long")

    found = scratch.save(connected_components(edges(deal(rows, member, block)), scratch, name), f"{name}-found")
    if most <= block:
        return found
    large = rows.where(F.col("n") > block).select(key, member, "n").distinct()
    now = found.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    inside = scratch.save(large.join(now, F.col(member) == F.col("_node"), "left")
                          .select(key, member, "n", F.coalesce("_component", member).alias("_now")), f"{name}-inside")
    outside = scratch.save(
        inside.groupBy(key, "_now").agg(F.count("*").alias("c")).groupBy(key)
        .agg(F.max_by("_now", F.struct("c", "_now")).alias("_main"), (F.sum("c") - F.max("c")).alias("_rest"))
        .where("_rest > 0"), f"{name}-outside")
    if outside.isEmpty():
        return found
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    again = (inside.join(outside, key).withColumn("_parts", blocks("n")).withColumn("_outer", blocks("_rest"))
             .withColumn("_own", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int"))
             .withColumn("_nth", F.pmod(F.xxhash64(member, F.lit(9)), F.col("_outer")).cast("int")))
    met = (again.select(key, member, F.col("_own").alias("lo"), every("_outer").alias("hi"))
           .union(again.where("_now <> _main").select(key, member, every("_parts").alias("lo"), F.col("_nth").alias("hi"))))
    known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    return scratch.save(connected_components(known.union(edges(met)), scratch, f"{name}-again"), f"{name}-closed")


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph ``near`` over 0..n-1.

    ``near(i, others)`` is a mask of the ``others`` linked with i. Only nodes
    that no tree has yet are compared, so a group that is linked throughout
    takes about n comparisons instead of n * n / 2.
    """
    left, edges = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            found = left[hit]
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
            left = left[~hit]
    return edges

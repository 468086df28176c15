"""Ranking helpers: positions in sorted lists and top-k per group.

Written as ``row_number() <= k`` so Catalyst plans a WindowGroupLimit: each
task keeps only its local top-k per group *before* the shuffle, so a hot
group never moves more than k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(cs) -> list:
    if cs is None:
        return []
    return [cs] if isinstance(cs, (str, Column)) else list(cs)


def add_rank(df: DataFrame, partition_by, order_by, name: str = "rank", zero_based: bool = True) -> DataFrame:
    """WIN-1: position in the sorted list of each group (0-based by default)."""
    w = Window.partitionBy(*_cols(partition_by)).orderBy(*_cols(order_by))
    pos = F.row_number().over(w)
    return df.withColumn(name, (pos - 1 if zero_based else pos).cast("int"))


def top_k(df: DataFrame, partition_by, order_by, k: int, rank_name: str | None = "rank",
          zero_based: bool = True) -> DataFrame:
    """WIN-3 / SRT-1 / SRT-2: first k rows per group after a sort."""
    w = Window.partitionBy(*_cols(partition_by)).orderBy(*_cols(order_by))
    tmp = "__pos"
    out = df.withColumn(tmp, F.row_number().over(w)).where(F.col(tmp) <= int(k))
    if rank_name is None:
        return out.drop(tmp)
    pos = (F.col(tmp) - 1) if zero_based else F.col(tmp)
    return out.withColumn(rank_name, pos.cast("int")).drop(tmp)


def rounded(score, digits: int | None) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return c if digits is None else F.round(c, int(digits))


def ranked_list(df: DataFrame, query_col: str, item_col: str, score_col: str, k: int,
                source: str, digits: int | None = 9) -> DataFrame:
    """Standard ranked list (query_id, source, product_id, score, rank):
    score desc (rounded to ``digits`` so engines agree), ties by item id."""
    scored = df.select(F.col(query_col).alias("query_id"), F.col(item_col).alias("product_id"),
                       rounded(score_col, digits).alias("score"))
    out = top_k(scored, "query_id", [F.col("score").desc(), F.col("product_id").asc()], k)
    return out.select("query_id", F.lit(source).alias("source"), "product_id", "score", "rank")

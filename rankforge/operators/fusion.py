"""AGG-9 / SRT-3 / SET-1: weighted reciprocal-rank fusion.

The ranked lists of all active sources are one table (union by name), fused
by one aggregate per (query, product): one conditional sum per source, added
in the fixed source order (so the float sum equals the reference's running
dict sum), plus the first-seen position for ties. The union is exchanged
once on query_id; that one shuffle (at most k rows per query and source)
serves both the aggregate and the final window.
"""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.config import SOURCE_ORDER
from rankforge.functions.scoring import rrf_term
from rankforge.operators.ranking import top_k


def union_ranked(lists: Sequence[DataFrame]) -> DataFrame:
    """SET-1: one table of (query_id, source, product_id, score, rank)."""
    if not lists:
        raise ValueError("at least one ranked list is needed")
    return reduce(lambda a, b: a.unionByName(b), lists)


def rrf_fuse(ranked: DataFrame, weights: Mapping[str, float], rrf_k: int = 60,
             top_n: int | None = 200, source_order: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """(query_id, product_id, rrf_score, rank) of the fused top ``top_n``.

    rrf = sum over sources of weight / (k + rank0 + 1). Equal scores keep the
    order of first insertion: earlier source first, then its rank. Weighted
    sources that ``source_order`` does not name follow it in the order of
    ``weights``. A list whose source has no weight raises; give it 0 to leave
    it out."""
    known = F.col("source").isin(list(weights))
    ranked = ranked.withColumn("rank", F.when(known, F.col("rank")).otherwise(
        F.raise_error(F.concat(F.lit("no fusion weight for source "), F.coalesce("source", F.lit("null")))).cast("int")))
    source_order = [*source_order, *(s for s in weights if s not in source_order)]
    parts = [F.sum(F.when(F.col("source") == s, rrf_term("rank", rrf_k, float(weights.get(s, 0.0)))))
             .alias(f"__{s}") for s in source_order]
    order_code = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(source_order)],
                            F.lit(len(source_order)))
    first_seen = F.min(F.struct(order_code.alias("src"), F.col("rank").alias("pos"))).alias("__first")
    # an explicit exchange on query_id: a union's inherited partitioning is not
    # trusted (AQE may coalesce the children's shuffles differently)
    agg = ranked.repartition("query_id").groupBy("query_id", "product_id").agg(*parts, first_seen)
    total = None
    for s in source_order:
        c = F.coalesce(F.col(f"__{s}"), F.lit(0.0))
        total = c if total is None else total + c
    fused = agg.select("query_id", "product_id", total.alias("rrf_score"), "__first")
    order = [F.col("rrf_score").desc(), F.col("__first.src").asc(), F.col("__first.pos").asc()]
    if top_n is None:
        top_n = 2 ** 31 - 1
    return top_k(fused, "query_id", order, top_n).drop("__first")

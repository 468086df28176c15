"""OPT-1: hard negatives, candidates that rank high and are not relevant.

A left-anti join on (query, product) takes the relevant pairs out of the
ranked candidates; a window with a partial limit keeps the best ``per_query`` of
a rank band. The join is null-safe: a candidate without a product id never
equals a relevant one and is dropped as unusable, a query without judgments
keeps all of its candidates. Rows repeated in the candidates count once, at
their best rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.operators import prep
from rankforge.operators.ranking import top_k


def mine_hard_negatives(cands: DataFrame, pairs: DataFrame, per_query: int = 5, first_rank: int = 0, last_rank: int = 200,
                        mode: str = "broad") -> DataFrame:
    """(query_id, product_id, rank, negative): for every query the best
    ``per_query`` candidates of ranks ``first_rank`` <= rank < ``last_rank``
    that are not relevant by ``mode``; ``negative`` numbers them from 0.

    A lower bound above 0 skips the top, where unjudged products are often
    relevant. ``cands``: (query_id, product_id, rank)."""
    band = cands.where((F.col("rank") >= first_rank) & (F.col("rank") < last_rank) & F.col("query_id").isNotNull() & F.col("product_id").isNotNull())
    once = band.groupBy("query_id", "product_id").agg(F.min("rank").alias("rank"))
    others = once.join(prep.relevant_sets(pairs, mode), ["query_id", "product_id"], "left_anti")
    return top_k(others, "query_id", [F.col("rank").asc(), F.col("product_id").asc()], per_query, rank_name="negative")


def training_triples(pairs: DataFrame, negatives: DataFrame, products: DataFrame, queries: DataFrame, mode: str = "strict") -> DataFrame:
    """(anchor, positive, negative): the instructed query with the text of a
    relevant and of a mined product, one row per pair of them."""
    texts = products.select("product_id", "product_text_dense")
    pos = prep.relevant_sets(pairs, mode).join(texts, "product_id").select("query_id", F.col("product_text_dense").alias("positive"))
    neg = negatives.join(texts, "product_id").select("query_id", F.col("product_text_dense").alias("negative"))
    anchors = queries.select("query_id", prep.instructed_query().alias("anchor"))
    return pos.join(neg, "query_id").join(anchors, "query_id").select("anchor", "positive", "negative")

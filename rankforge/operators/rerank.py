"""UDF-4 / WIN-3 / SRT-4: second-stage rescoring of the best candidates.

The top ``k`` candidates per query are cut with a window limit (partial per
task, before the shuffle), spread over the cluster, and scored with

* a JVM column expression (``token_overlap_scorer``, used in checks), or
* a user model in a pandas UDF: the model is loaded once per Python worker
  (``functions/models.py``) and fed Arrow batches of (query, text) pairs.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankforge.functions.models import Model, loaded
from rankforge.functions.text import word_tokens
from rankforge.operators.ranking import top_k


def token_overlap_scorer(query: Column, text: Column) -> Column:
    """Deterministic stand-in scorer: share of distinct query tokens found in
    the text, plus a small bonus per shared token."""
    q = F.array_distinct(word_tokens(query, null_as="None"))
    t = F.array_distinct(word_tokens(text))
    shared = F.size(F.array_intersect(q, t)).cast("double")
    return F.coalesce(F.try_divide(shared, F.size(q).cast("double")), F.lit(0.0)) + shared * F.lit(0.001)


def model_scorer(model: Model, batch_size: int = 2048):
    """A user model as a scorer over two string columns: ``model.load`` gives
    ``predict(queries: list, texts: list) -> scores``, once per Python worker."""

    @F.pandas_udf("double")
    def score(queries: pd.Series, texts: pd.Series) -> pd.Series:
        predict = loaded(model)
        parts = [np.asarray(predict(queries[lo:lo + batch_size].tolist(), texts[lo:lo + batch_size].tolist()), np.float64)
                 for lo in range(0, len(queries), batch_size)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    def scorer(query: Column, text: Column) -> Column:
        return score(F.coalesce(query.cast("string"), F.lit("None")), F.coalesce(text, F.lit("")))
    return scorer


def rerank(cands: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap_scorer,
           k: int = 200, query_col: str = "query", text_col: str = "product_text_dense",
           spread: int | None = None) -> DataFrame:
    """Top ``k`` candidates per query by fused order, with ``ce_score``.

    ``spread`` repartitions the cut set before scoring so an expensive model
    runs on many tasks (the cut leaves few rows per partition otherwise)."""
    order = [F.col("rrf_score").desc()]
    if "rank" in cands.columns:
        order.append(F.col("rank").asc())
    order.append(F.col("product_id").asc())
    subset = top_k(cands, "query_id", order, k, rank_name=None)
    if spread:
        subset = subset.repartition(int(spread))
    return subset.withColumn("ce_score", scorer(F.col(query_col), F.col(text_col)))


def rerank_order(df: DataFrame) -> DataFrame:
    """SRT-4: query_id asc, ce_score desc (ties by product id)."""
    return df.orderBy(F.col("query_id").asc(), F.col("ce_score").desc(), F.col("product_id").asc())

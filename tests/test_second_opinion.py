"""spark.ml RankingEvaluator as a second opinion on Recall@K (binary relevance)."""

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankforge.operators import metrics as M
from rankforge.plans import catalog as C
from conftest import SF_CHECK


def test_recall_matches_ranking_evaluator(spark):
    art, cands = C._cands(spark, SF_CHECK)
    k = 50
    ours = M.evaluate(cands, art.pairs, recall_ks=(k,), ndcg_ks=()).first()[f"recall_{k}"]
    w = Window.partitionBy("query_id").orderBy(F.col("rrf_score").desc(), F.col("product_id").asc())
    ranked = cands.withColumn("pos", F.row_number().over(w))
    pred = ranked.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("product_id").cast("double").alias("p")))),
                    lambda s: s["p"]).alias("prediction"))
    labels = (art.pairs.where(F.col("grade") >= 0.1)
              .groupBy("query_id").agg(F.collect_set(F.col("product_id").cast("double")).alias("label")))
    joined = pred.join(labels, "query_id")
    theirs = RankingEvaluator(metricName="recallAtK", k=k, predictionCol="prediction",
                              labelCol="label").evaluate(joined)
    assert ours == pytest.approx(theirs)

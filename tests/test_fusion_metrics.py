"""Fusion and metric semantics on hand-made tables."""

import math

import pytest
from pyspark.sql import functions as F

from rankforge.operators import metrics as M
from rankforge.operators.fusion import rrf_fuse

W = {"dense": 1.0, "splade": 0.5, "bm25": 0.3}


def test_rrf_sum_and_tie_order(spark):
    ranked = spark.createDataFrame([
        (1, "dense", "a", 0.9, 0), (1, "dense", "b", 0.8, 1),
        (1, "bm25", "c", 5.0, 0), (1, "bm25", "a", 4.0, 1),
        (2, "dense", "x", 0.9, 0), (2, "splade", "y", 1.0, 0),
    ], "query_id long, source string, product_id string, score double, rank int")
    # equal weights -> x and y tie; dense came first, so x ranks first
    out = {(r.query_id, r.product_id): (r.rrf_score, r.rank)
           for r in rrf_fuse(ranked, {"dense": 1.0, "splade": 1.0, "bm25": 0.3}, 60, 200).collect()}
    assert out[(1, "a")][0] == pytest.approx(1 / 61 + 0.3 / 62)
    assert out[(2, "x")][1] == 0 and out[(2, "y")][1] == 1
    one = rrf_fuse(ranked.where("source = 'dense'"), W, 60, 1).collect()
    assert sorted((r.query_id, r.product_id) for r in one) == [(1, "a"), (2, "x")]


def _cands(spark, rows):
    return spark.createDataFrame(rows, "query_id long, product_id string, rrf_score double, grade double")


def test_metrics_skip_rules_and_values(spark):
    pairs = spark.createDataFrame([
        (1, "a", 1.0), (1, "b", 0.1), (1, "c", 0.0),
        (2, "x", 0.0),                       # all I -> no relevant, no positive grade
        (3, "z", 1.0),                       # no candidates -> not in the mean
    ], "query_id long, product_id string, grade double")
    cands = _cands(spark, [(1, "a", 3.0, 1.0), (1, "c", 2.0, 0.0), (1, "b", 1.0, 0.1), (2, "x", 1.0, 0.0)])
    pq = {r.query_id: r for r in M.per_query_metrics(cands, pairs, (1, 3), (1, 3)).collect()}
    assert set(pq) == {1, 2}
    assert pq[2].recall_1 is None and pq[2].ndcg_1 is None
    assert pq[1].recall_1 == pytest.approx(0.5) and pq[1].recall_3 == pytest.approx(1.0)
    dcg = 1.0 + (2 ** 0.1 - 1) / math.log2(4)
    idcg = 1.0 + (2 ** 0.1 - 1) / math.log2(3)
    assert pq[1].ndcg_3 == pytest.approx(dcg / idcg)
    mean = M.evaluate(cands, pairs, (1, 3), (1, 3)).first()
    assert mean.recall_3 == pytest.approx(1.0) and mean.n_recall_queries == 1


def test_ndcg_is_one_for_ideal_order_and_recall_grows_with_k(spark):
    pairs = spark.createDataFrame([(1, p, g) for p, g in zip("abcd", (1.0, 0.1, 0.01, 1.0))],
                                  "query_id long, product_id string, grade double")
    ideal = _cands(spark, [(1, "a", 4.0, 1.0), (1, "d", 3.0, 1.0), (1, "b", 2.0, 0.1), (1, "c", 1.0, 0.01)])
    r = M.per_query_metrics(ideal, pairs, (1, 2, 3), (2, 4)).first()
    assert r.ndcg_2 == pytest.approx(1.0) and r.ndcg_4 == pytest.approx(1.0)
    assert r.recall_1 <= r.recall_2 <= r.recall_3
    none = M.evaluate(_cands(spark, [(9, "q", 1.0, 0.0)]), pairs).first()
    assert none.recall_50 == 0.0 and none.ndcg_10 == 0.0

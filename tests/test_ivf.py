"""Inverted-file search against the exact scan."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.operators import ivf
from rankforge.operators.dense import dense_search
from conftest import SF_CHECK


@pytest.fixture(scope="module")
def tables(spark):
    emb = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet")
    return (emb.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"),
            emb.select(F.col("vec_id").alias("product_id"), "embedding"))


def rows_of(df):
    return sorted((r.query_id, r.rank, r.product_id, round(r.score, 8)) for r in df.collect())


def test_all_probes_are_exact_and_read_back(spark, tables):
    q, p = tables
    index = ivf.build_ivf(p, dim=32, n_cells=9)
    assert index.n_rows == p.count() and len(index.centroids) == 9
    again = ivf.read_ivf(spark, index.path)
    want = rows_of(dense_search(q, p, 30, 32))
    assert rows_of(ivf.ivf_search(again, q, 30, 32, probes=9)) == want
    assert rows_of(ivf.ivf_search(again, q, 30, 32, probes=9, batch_bytes=6000)) == want


def test_recall_and_pruning(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + 0.15 * rng.normal(size=24)).tolist()) for i in range(4000)]
    p = spark.createDataFrame(rows, "product_id long, embedding array<double>")
    q = p.where("product_id % 20 = 0").withColumnRenamed("product_id", "query_id")
    index = ivf.build_ivf(p, k=50, target=0.95)
    assert index.probes < len(index.centroids) / 3
    found = ivf.ivf_search(index, q, 50)
    recall = ivf.recall_at_k(found, dense_search(q, p, 50))
    assert recall.agg(F.avg("recall")).first()[0] >= 0.9 and recall.agg(F.sum("n_exact")).first()[0] == 200 * 50
    one = ivf.ivf_search(index, q.limit(1), 5, probes=1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*cell#\d+ = \d", plan) and one.count() == 5


def test_copies_odd_rows_and_empty(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100, None), (101, [float("nan"), 1.0]), (102, [0.0, 0.0]), (103, [0.0, 1.0])]
    p = spark.createDataFrame(rows, "product_id long, embedding array<double>")
    index = ivf.build_ivf(p, n_cells=8)
    assert index.n_rows == 62 and len(index.centroids) <= 3
    q = spark.createDataFrame([(1, [0.0, 2.0])], "query_id long, embedding array<double>")
    assert [r.product_id for r in ivf.ivf_search(index, q, 1).collect()] == [103]
    none = ivf.build_ivf(p.limit(0))
    assert ivf.ivf_search(none, q.limit(0), 3).count() == 0
    p.limit(3).withColumn("cell", F.lit(0)).withColumnRenamed("embedding", "vec").write.mode("append").partitionBy("cell").parquet(f"{index.path}/rows")
    with pytest.raises(ValueError, match="incomplete"):
        ivf.read_ivf(spark, index.path)


def test_tuned_probes_reach_the_target():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = ivf.learn_centroids(x, 30)
    probes = [ivf.tune_probes(x, c, 20, t) for t in (0.3, 0.6, 0.9, 1.0)]
    assert probes == sorted(probes) and probes[-1] == 30 and probes[0] < 30
    exact = np.argsort(-(x @ x.T), axis=1)[:, :20]
    cell, _ = ivf.nearest_cells(x, c)
    mine = ivf.probed_cells(x, c, probes[2])
    hit = np.mean([np.isin(cell[exact[i]], mine[i]).mean() for i in range(len(x))])
    assert hit >= 0.87

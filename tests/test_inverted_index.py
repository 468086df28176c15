"""The index layout: bucketed by document, sums and partial top-k in the task."""

import re

import pytest
from pyspark.sql import functions as F

from rankforge.config import BM25Params
from rankforge.functions.text import analyze
from rankforge.operators import bm25
from rankforge.operators.learned_sparse import build_sparse_index, sparse_search
from rankforge.sources import clustered, io

DOCS = [(1, "running shoes for running"), (2, "large tent"), (3, "the tent runs"), (4, ""), (5, None)]
QUERIES = [(1, "run shoes"), (2, "tents"), (3, "the the large"), (4, "nothing"), (5, None)]


@pytest.fixture(scope="module")
def inputs(spark):
    return (spark.createDataFrame(DOCS, "doc_id long, text string"),
            spark.createDataFrame(QUERIES, "query_id long, query string"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_no_exchange_between_postings_and_partial_top_k(spark, inputs):
    docs, queries = inputs
    found = bm25.bm25_search(bm25.build_bm25_index(docs), queries, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    partial = [i for i, x in enumerate(plan.splitlines()) if re.search(r"WindowGroupLimit.*Partial", x)]
    assert partial
    below = "\n".join(plan.splitlines()[partial[0]:])
    assert "Exchange hashpartitioning" not in below and "SortMergeJoin" not in below
    assert "Bucketed: true" in below


@pytest.mark.parametrize("params", [BM25Params(), BM25Params(stem=False, k1=1.2, b=0.5), BM25Params(min_df=2)])
def test_reread_index_searches_alike(spark, inputs, params):
    docs, queries = inputs
    index = bm25.build_bm25_index(docs, params=params)
    path = io.scratch_path(spark, "index")
    io.write_bm25_index(index, path)
    back = io.read_bm25_index(spark, path)
    assert back.params == params
    want = rows(bm25.bm25_search(index, queries, 3))
    assert rows(bm25.bm25_search(back, queries, 3)) == want
    assert want
    lazy = bm25.build_bm25_index(docs, params=params, materialize=False)
    assert rows(bm25.bm25_search(lazy, queries, 3)) == want


def test_incomplete_index_raises(spark, inputs):
    path = io.scratch_path(spark, "index")
    io.write_bm25_index(bm25.build_bm25_index(inputs[0]), path)
    stats = spark.createDataFrame(spark.read.parquet(f"{path}/stats").withColumn("n_postings", F.col("n_postings") + 1).collect(),
                                  spark.read.parquet(f"{path}/stats").schema)
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    with pytest.raises(ValueError, match="postings"):
        io.read_bm25_index(spark, path)


def test_query_batches_equal_one_batch(spark):
    weights = spark.createDataFrame([(d, f"t{d * k % 7}", float(k)) for d in range(20) for k in range(1, 4)], "doc_id long, term string, weight double")
    weights = weights.groupBy("doc_id", "term").agg(F.sum("weight").alias("weight"))
    terms = spark.createDataFrame([(q, f"t{(q + k) % 7}", 1.0) for q in range(9) for k in range(2)], "query_id long, term string, qw double")
    index = build_sparse_index(weights)
    assert rows(bm25.sum_by_document(index, terms, 3)) == rows(bm25.sum_by_document(index, terms))


def test_reread_sparse_index(spark):
    weights = spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "doc_id long, term string, weight double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    path = io.scratch_path(spark, "sparse")
    io.write_sparse_index(weights, docs, path)
    back, ids = io.read_sparse_index(spark, path)
    query = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0)], "query_id long, term string, weight double")
    assert [(r.product_id, r.score) for r in sparse_search(query, back, 5).orderBy("rank").collect()] == [(2, 4.0), (1, 2.0)]
    assert ids.count() == 3


def test_rows_that_share_an_id_are_added_up(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "a"), (2, ""), (3, None)], "id long, t string")
    assert rows(analyze(df, "id", "t", stem=False).select("id", "term", "tf")) == [(1, "a", 3), (1, "b", 1)]


def test_buckets_follow_the_bytes_of_the_sources(spark, inputs, tmp_path, monkeypatch):
    docs, queries = inputs
    path = str(tmp_path / "docs")
    docs.repartition(2).write.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "docs").glob("*.parquet"))
    read = spark.read.parquet(path)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    joined = read.where("doc_id > 1").join(read.select("doc_id", F.upper("text").alias("t")), "doc_id")
    assert clustered.source_bytes(read) == size and clustered.source_bytes(joined) == 2 * size
    assert clustered.source_bytes(joined.persist()) == 2 * size  # not the estimate of a join
    joined.unpersist()
    assert clustered.source_bytes(docs) == 0 and clustered.bucket_count(docs) == least == clustered.bucket_count(read)
    assert clustered.bucket_count(read, bucket_bytes=10) == -(-size // 10) > least
    assert clustered.bucket_count(read, bucket_bytes=10) > clustered.bucket_count(read, bucket_bytes=40)
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "11")
    try:
        assert clustered.bucket_count(read, bucket_bytes=10) == 11
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    want = rows(bm25.bm25_search(bm25.build_bm25_index(read), queries, 2))
    monkeypatch.setattr(clustered.bucket_count, "__defaults__", (64,))
    index = bm25.build_bm25_index(read)
    assert index.buckets == -(-clustered.source_bytes(read.select("doc_id", "text")) // 64) > least
    assert rows(bm25.bm25_search(index, queries, 2)) == want
    io.write_bm25_index(index, str(tmp_path / "index"))
    again = io.read_bm25_index(spark, str(tmp_path / "index"))
    assert again.buckets == index.buckets and rows(bm25.bm25_search(again, queries, 2)) == want

"""Retrieval operators against brute force (numpy / plain Python)."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.config import BM25Params
from rankforge.functions.porter import stem
from rankforge.functions.text import word_tokens_py
from rankforge.operators.bm25 import bm25_search, build_bm25_index
from rankforge.operators.dense import dense_search
from rankforge.operators.learned_sparse import activations, sparse_search
from conftest import SF_SMALL


def _bm25_brute(docs, queries, k1=1.5, b=0.75, stem_on=True):
    norm = (lambda w: stem(w)) if stem_on else (lambda w: w)
    tf = {d: Counter(norm(w) for w in word_tokens_py(t)) for d, t in docs}
    n = len(docs)
    avgdl = sum(sum(c.values()) for c in tf.values()) / n
    dfreq = Counter(t for c in tf.values() for t in c)
    out = {}
    for qid, q in queries:
        qtf = Counter(norm(w) for w in word_tokens_py(q))
        for d, c in tf.items():
            s = 0.0
            dl = sum(c.values())
            for t, qn in qtf.items():
                if t in c:
                    idf = math.log((n - dfreq[t] + 0.5) / (dfreq[t] + 0.5) + 1.0)
                    s += qn * (c[t] * (k1 + 1) / (c[t] + k1 * (1 - b + b * dl / max(avgdl, 1e-9))) * idf)
            if s > 0:
                out[(qid, d)] = s
    return out


@pytest.mark.parametrize("stem_on", [True, False])
def test_bm25_equals_brute_force_on_whole_documents(spark, stem_on):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    idx = build_bm25_index(docs, "doc_id", "text", BM25Params(stem=stem_on))
    k = 15
    got = bm25_search(idx, bench, k, digits=9).collect()
    brute = _bm25_brute([(r.doc_id, r.text) for r in docs.collect()],
                        [(r.query_id, r.query) for r in bench.collect()], stem_on=stem_on)
    expected = {}
    for (q, d), s in brute.items():
        expected.setdefault(q, []).append((-round(s, 9), d))
    for q in expected:
        expected[q] = sorted(expected[q])[:k]
    got_by_q = {}
    for r in got:
        got_by_q.setdefault(r.query_id, []).append((r.rank, r.product_id, r.score))
    assert set(got_by_q) == set(expected)
    for q, rows in got_by_q.items():
        rows.sort()
        assert [d for _, d, _ in rows] == [d for _, d in expected[q]]
        for (_, _, s), (neg, _) in zip(rows, expected[q]):
            assert s == pytest.approx(-neg, abs=1e-7)


def test_bm25_edge_cases(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "blue ring"), (3, None)], "doc_id long, text string")
    qs = spark.createDataFrame([(10, "red red ring"), (11, "zzz"), (12, "ring")], "query_id long, query string")
    idx = build_bm25_index(docs, "doc_id", "text")
    got = bm25_search(idx, qs, 500).collect()
    by_q = {}
    for r in got:
        by_q.setdefault(r.query_id, []).append(r)
    assert 11 not in by_q                       # no known token -> empty list
    assert len(by_q[12]) == 2                   # fewer hits than k -> no phantom rows
    assert [r.product_id for r in sorted(by_q[10], key=lambda r: r.rank)][0] == 1
    padded = bm25_search(idx, qs, 3, pad_zero=True).collect()
    assert sorted(r.product_id for r in padded if r.query_id == 12) == [1, 2, 3]
    assert not [r for r in padded if r.query_id == 11]


def _unit(v):
    n = np.linalg.norm(v)
    return v / max(n, 1e-10)


@pytest.mark.parametrize("batch_bytes", [64 << 20, 2000])
def test_dense_scan_equals_brute_force(spark, batch_bytes):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    p = emb.where("vec_id % 25 <> 0").select(F.col("vec_id").alias("product_id"), "embedding")
    k, dim = 20, 16
    got = dense_search(q, p.repartition(3), k, dim, batch_bytes=batch_bytes).collect()
    Q = {r.query_id: _unit(np.asarray(r.embedding[:dim], dtype=np.float64)) for r in q.collect()}
    P = {r.product_id: _unit(np.asarray(r.embedding[:dim], dtype=np.float64)) for r in p.collect()}
    for qid, qv in Q.items():
        scores = sorted(((-round(float(qv @ pv), 9), pid) for pid, pv in P.items()))[:k]
        mine = sorted((r.rank, r.product_id) for r in got if r.query_id == qid)
        assert [pid for _, pid in mine] == [pid for _, pid in scores]


def test_dense_zero_vector_and_k_above_n(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "query_id long, embedding array<float>")
    p = spark.createDataFrame([(10, [0.0, 0.0]), (11, [0.0, 2.0]), (12, [3.0, 0.0])],
                              "product_id long, embedding array<float>")
    got = dense_search(q, p, 500, None).collect()
    assert len(got) == 6                         # k > N: only real products
    assert all(not math.isnan(r.score) for r in got)
    top = [r for r in got if r.query_id == 2 and r.rank == 0][0]
    assert top.product_id == 12 and top.score == pytest.approx(1.0)


def test_learned_sparse_and_activation(spark):
    logits = spark.createDataFrame(
        [(1, 0, "a", 2.0), (1, 1, "a", 5.0), (1, 2, "b", -1.0), (2, 0, "b", 0.5)],
        "doc_id long, pos int, term string, logit double")
    act = {(r.doc_id, r.term): r.weight for r in activations(logits).collect()}
    assert act == {(1, "a"): pytest.approx(math.log1p(5.0)), (2, "b"): pytest.approx(math.log1p(0.5))}
    docs = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (2, "b", 1.0)], "doc_id long, term string, weight double")
    qw = spark.createDataFrame([(7, "a", 1.0), (7, "b", 3.0)], "query_id long, term string, weight double")
    got = sorted((r.rank, r.product_id, r.score) for r in sparse_search(qw, docs, 10).collect())
    assert got == [(0, 2, 5.0), (1, 1, 1.0)]


@pytest.mark.parametrize("strings", [False, True])
def test_running_top_k_orders_by_score_then_id(strings):
    from rankforge.operators.dense import RunningTopK
    rng = np.random.default_rng(7)
    n, k = 6, 40
    scores = np.round(rng.random((n, 9000)), 2)          # many exact ties
    ids = rng.permutation(9000)
    ids = ids.astype(str) if strings else ids
    best = RunningTopK(n, k, 9)
    best._most = 500                                      # several cuts
    for lo in range(0, 9000, 700):
        for rows in (np.arange(4), np.arange(4, n)):
            best.add(rows, scores[rows, lo:lo + 700], ids[lo:lo + 700])
    rows, got, names = best.lists()
    for i in range(n):
        want = sorted(zip(-scores[i], ids))[:k]
        assert [(-s, p) for s, p in zip(got[rows == i], names[rows == i])] == want


def test_dense_odd_vectors(spark):
    nan = float("nan")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0])], "query_id long, embedding array<double>")
    p = spark.createDataFrame([("a", [1.0, 1.0]), ("b", None), ("c", [float("inf"), 0.0]), ("d", [2.0, None]), ("e", [3.0, 0.0]), ("e", [3.0, 0.0])],
                              "product_id string, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.product_id) for r in dense_search(q, p, 5).collect())
    assert got == [(1, 0, "e"), (1, 1, "e"), (1, 2, "a")]
    assert dense_search(q.limit(0), p, 5).count() == 0 and dense_search(q, p.limit(0), 5).count() == 0
    with pytest.raises(Exception, match="2 components, 3 expected|3 components, 2 expected"):
        wide = spark.createDataFrame([("w", [1.0, 2.0, 3.0])], "product_id string, embedding array<double>")
        dense_search(q, wide, 5).collect()


def test_dense_plan_scans_products_in_place(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    q = emb.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    df = dense_search(q, emb.withColumnRenamed("vec_id", "product_id"), 5, 16)
    below = df._jdf.queryExecution().executedPlan().toString().split("MapInArrow", 1)[1]
    assert "Exchange" not in below and "Generate" not in below and "Join" not in below


def test_running_top_k_holds_its_lists_about_once():
    """Merging and giving out the lists copies one range of queries at a time."""
    import tracemalloc

    from rankforge.operators.dense import ENTRIES_AT_ONCE, RunningTopK
    rng = np.random.default_rng(11)
    n, k = 4000, 500
    lists = 24 * n * k
    tracemalloc.start()
    try:
        best = RunningTopK(n, k, None)
        for block in range(4):
            for lo in range(0, n, 100):
                best.add(np.arange(lo, lo + 100), rng.random((100, 2000)), np.arange(2000) + 2000 * block)
        got = sum(len(rows) for rows, _, _ in best.ranges())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got == n * k and n * k > 4 * ENTRIES_AT_ONCE
    assert peak < 4 * lists, f"{peak / lists:.1f} times the lists"

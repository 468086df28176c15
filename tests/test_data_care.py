"""Drift sketches, versions, checked scans, run log, hard negatives."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.config import RetrievalConfig
from rankforge.operators import drift, prep
from rankforge.operators.fusion import rrf_fuse
from rankforge.operators.negatives import mine_hard_negatives
from rankforge.plans import experiment as X
from rankforge.plans import pipeline as pl
from rankforge.sources import io, versions
from rankforge.sources.checked import checked_scan


# ------------------------------------------------------------- drift
@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    rows = [("a", float(x), int(x * 50)) for x in rng.normal(0, 1, 6000)] + [("b", float(x), int(x * 50)) for x in rng.normal(0.5, 1, 4000)]
    return rows + [("a", None, None), ("a", float("nan"), 3), ("c", None, 1), ("c", None, 2), (None, 1.0, None)]


def test_sketches_merge_and_distances_equal_exact_ones(spark, values):
    df = spark.createDataFrame(values, "p string, v double, k long").withColumn("part", F.pmod(F.xxhash64("v", "k"), F.lit(7)))
    fine = drift.period_sketches(df, F.concat_ws("/", F.coalesce("p", F.lit("none")), "part"), F.col("v"), F.col("k"))
    merged = drift.merge_periods(fine, F.substring_index("period", "/", 1))
    got = {r.period: r for r in drift.drift_report(merged, F.col("period") == "a").collect()}
    sets = {p: np.sort([v for q, v, _ in values if q == p and v is not None and not math.isnan(v)]) for p in "ab"}
    for p, x in sets.items():
        assert (got[p].n, got[p].n_missing) == (sum(q == p for q, _, _ in values), 2 if p == "a" else 0)
        assert (got[p].low, got[p].high) == (x[0], x[-1])
        for name, share in (("p50", 0.5), ("p95", 0.95)):
            assert abs(np.searchsorted(x, got[p][name]) / len(x) - share) <= 0.01
        keys = len({k for q, _, k in values if q == p and k is not None})
        assert abs(got[p].n_distinct / keys - 1) <= 0.03
    grid = np.linspace(-4, 4, 2000)
    ks = np.abs(np.searchsorted(sets["a"], grid) / 6000 - np.searchsorted(sets["b"], grid) / 4000).max()
    assert abs(got["b"].ks - ks) <= 0.03 and got["a"].ks <= 0.01
    edges = np.quantile(sets["a"], np.arange(0.1, 1, 0.1))
    p, q = (np.diff([0, *(np.searchsorted(sets[s], edges) / len(sets[s])), 1]) for s in "ba")
    assert abs(got["b"].psi - ((p - q) * np.log(p / q)).sum()) <= 0.05 and got["a"].psi <= 0.005
    assert got["c"].n == got["c"].n_missing == 2 and got["c"].p50 is None and got["c"].ks is None and got["c"].psi is None
    empty = drift.drift_report(drift.period_sketches(df.limit(0), F.col("p"), F.col("v"), F.col("k")), F.col("period") == "a")
    assert empty.count() == 0


def test_mix_distance(spark):
    rows = [("a", "x")] * 6 + [("a", "y")] * 2 + [("a", None)] * 2 + [("b", "x")] * 1 + [("b", "z")] * 3 + [(None, None)] * 2
    got = {r.period: (r.n, round(r.mix_distance, 9)) for r in drift.mix_distance(
        spark.createDataFrame(rows, "p string, c string"), F.col("p"), F.col("c"), F.col("period") == "a").collect()}
    assert got == {"a": (10, 0.0), "b": (4, 0.75), None: (2, 0.8)}


# ------------------------------------------------------------- versions
def test_readers_see_whole_published_versions_only(spark):
    root = io.scratch_path(spark, "versions")
    cfg, other = RetrievalConfig(), RetrievalConfig(rrf_k=10)
    assert versions.versions(spark, root) == []
    with pytest.raises(ValueError, match="no published version"):
        versions.latest_version(spark, root)
    one, n = versions.write_version(spark, root, {"t": spark.range(5)})
    assert versions.versions(spark, root) == []  # written, not published
    v1 = versions.publish_version(spark, root, one, n, cfg, "m")
    assert versions.publish_version(spark, root, one, n, cfg, "m").created == v1.created  # a repeated job
    two, n2 = versions.write_version(spark, root, {"t": spark.range(9)})
    pinned = versions.latest_version(spark, root, cfg)
    versions.publish_version(spark, root, two, n2, other, "m")
    assert len(versions.versions(spark, root)) == 2
    assert versions.open_version(spark, root, pinned)["t"].count() == 5
    assert versions.latest_version(spark, root).name == two and versions.latest_version(spark, root, cfg, "m").name == one
    with pytest.raises(ValueError, match="no published version"):
        versions.latest_version(spark, root, model="x")
    spark.range(1).write.mode("append").parquet(f"{root}/versions/{two}/t")
    with pytest.raises(ValueError, match="10 rows, 9 were published"):
        versions.open_version(spark, root, versions.latest_version(spark, root, other))


def test_config_hash_ignores_the_order_of_keys():
    assert versions.config_hash({"a": 1, "b": {"x": 1, "y": [1, 2]}}) == versions.config_hash({"b": {"y": (1, 2), "x": 1}, "a": 1})
    assert versions.config_hash(RetrievalConfig()) == versions.config_hash(RetrievalConfig()) != versions.config_hash(RetrievalConfig(rrf_k=1))


# ------------------------------------------------------------- checked scan
def test_checked_scan_reports_every_finding_in_one_pass(spark):
    path = io.scratch_path(spark, "checked")
    rows = [("1", "10", "p", None, "x"), ("2", "no", "p", "us", "x"), (None, "3", None, "us", "x"), ("4", None, "q", "us", "x")]
    spark.createDataFrame(rows, "example_id string, query_id string, product_id string, product_locale string, `odd name` string").write.parquet(path)
    scan = io.scan_examples(spark, path)
    report = {r["column"]: (r.status, r.found_type, r.declared_type, r.n_bad) for r in scan.report.collect()}
    assert report == {
        "example_id": ("another type", "string", "bigint", 1), "query_id": ("another type", "string", "bigint", 2),
        "product_id": ("as declared", "string", "string", 1), "product_locale": ("as declared", "string", "string", 1),
        "query": ("missing", None, "string", 0), "esci_label": ("missing", None, "string", 0), "small_version": ("missing", None, "int", 0),
        "split": ("missing", None, "string", 0), "odd name": ("extra", "string", None, 0)}
    assert scan.rows.count() == 0 and scan.rows.schema == io.EXAMPLES_SCHEMA
    bad = {r.example_id: r.problems for r in scan.bad_rows.collect()}
    assert bad == {"1": ["product_locale"], "2": ["query_id"], None: ["example_id", "product_id"], "4": ["query_id"]}
    free = checked_scan(spark, path, io.EXAMPLES_SCHEMA, drop_bad=False).rows
    assert sorted((r.example_id or 0, r.query_id or 0) for r in free.collect()) == [(0, 3), (1, 10), (2, 0), (4, 0)]
    assert checked_scan(spark, path, io.EXAMPLES_SCHEMA).rows.count() == 3
    clean = io.scratch_path(spark, "clean")
    free.where("false").write.parquet(clean)
    scan = checked_scan(spark, clean, io.EXAMPLES_SCHEMA)
    assert scan.rows.count() == scan.bad_rows.count() == 0 and scan.report.agg(F.sum("n_bad")).first()[0] == 0


# ------------------------------------------------------------- run log
def test_a_repeated_job_does_not_double_its_runs(spark):
    path = io.scratch_path(spark, "log")
    m = spark.createDataFrame([("Dense", 64, 0.5), ("Dense", 32, 0.25)], "strategy string, dimension int, `Recall@200` double")
    for prefix, params in (("candidates", {"k@1": 5}), ("candidates", {"k@1": 5}), ("candidates", {"k@1": 6}), ("rerank", {"k@1": 5})):
        io.append_run_log(io.run_log(m, prefix, params, ["Recall@200"]), path)
    log = io.read_run_log(spark, path).collect()
    assert len(log) == 6 and len({r.run_id for r in log}) == 6
    assert {r.params["k_1"] for r in log} == {"5", "6"} and {r.metrics["Recall_200"] for r in log} == {0.5, 0.25}


def test_run_files_are_named_by_dimension_and_sources(spark):
    m = spark.createDataFrame([(64, "dense,bm25", 0.5), (32, "dense", 0.25)], "dimension int, sources string, recall double")
    folder = io.scratch_path(spark, "csv")
    files = io.write_run_csvs(m, folder, "rerank")
    assert files == {f"{folder}/rerank_dim64_dense_bm25.csv": "dense,bm25", f"{folder}/rerank_dim32_dense.csv": "dense"}
    assert io.read_metrics_csv(spark, list(files), "dimension int, sources string, recall double").count() == 2


# ------------------------------------------------------------- negatives, weights, group flags
def test_hard_negatives_against_plain_python(spark):
    rng = random.Random(2)
    cands = [(q, f"p{p}", r) for q in range(6) for r, p in enumerate(rng.sample(range(60), 40))]
    judged = [(q, f"p{p}", rng.choice([0.0, 0.01, 0.1, 1.0])) for q in range(5) for p in rng.sample(range(60), 25)]
    odd = [(0, None, 3), (None, "p1", 2), (1, cands[45][1], cands[45][2] + 1)]
    df = spark.createDataFrame(cands + odd, "query_id long, product_id string, rank int")
    pairs = spark.createDataFrame(judged + [(1, None, 1.0), (None, "p1", 1.0)], "query_id long, product_id string, grade double")
    relevant = {(q, p) for q, p, g in judged if g >= 0.1}
    want = []
    for q in range(6):
        left = sorted((r, p) for a, p, r in cands if a == q and 4 <= r < 30 and (q, p) not in relevant)[:7]
        want += [(q, p, r, i) for i, (r, p) in enumerate(left)]
    assert sorted(tuple(r) for r in mine_hard_negatives(df, pairs, 7, 4, 30).collect()) == sorted(want)
    assert mine_hard_negatives(df.limit(0), pairs).count() == 0 and mine_hard_negatives(df, pairs.limit(0), 1, 0, 1).count() == 6


def test_a_source_without_a_weight_raises(spark):
    lists = spark.createDataFrame([(1, "dense", "a", 1.0, 0), (1, "ann", "b", 1.0, 0)], "query_id long, source string, product_id string, score double, rank int")
    with pytest.raises(Exception, match="no fusion weight for source ann"):
        rrf_fuse(lists, {"dense": 1.0}).collect()
    got = {r.product_id: r.rrf_score for r in rrf_fuse(lists, {"dense": 1.0, "ann": 0.0}).collect()}
    assert got["a"] > 0 and got["b"] == 0
    with pytest.raises(ValueError, match="no fusion weight for source bm25"):
        X.run_table(spark, [X.Run("r", 64, ("dense", "bm25"), {"dense": 1.0})])
    with pytest.raises(ValueError, match="no fusion weight"):
        pl.build_candidates(None, None, RetrievalConfig(weights={"dense": 1.0}))


def test_group_flag_with_null_keys(spark):
    rows = [(1, "a", "E"), (1, "a", "S"), (1, "b", "S"), (None, "a", "E"), (None, "a", None), (2, None, None)]
    df = spark.createDataFrame(rows, "g long, h string, label string")
    got = sorted(((r.g, r.h, r.label, r.any) for r in prep.any_over_group(df, ["g", "h"], F.col("label") == "E").collect()), key=str)
    assert got == sorted([(1, "a", "E", True), (1, "a", "S", True), (1, "b", "S", False), (None, "a", "E", True), (None, "a", None, True), (2, None, None, False)], key=str)
    with pytest.raises(ValueError, match="unknown relevance mode"):
        prep.relevance_threshold("x")

"""Preparation operators: hand-made cases of FIXTURES.md section D."""

from pyspark.sql import functions as F

from rankforge.operators import prep
from rankforge.plans.pipeline import prepare_pairs

EX = "example_id long, query string, query_id long, product_id string, product_locale string, " \
     "esci_label string, small_version int, split string"
PR = "product_id string, product_locale string, product_title string, product_brand string, " \
     "product_bullet_point string"


def test_prepare_pairs_hand_cases(spark):
    ex = spark.createDataFrame([
        (1, "mug", 1, "p1", "us", "E", 1, "test"),
        (2, "mug", 1, "p2", "us", "X", 1, "test"),        # unmapped label -> dropped
        (3, None, 2, "p1", "us", "E", 1, "test"),         # null query kept by the ASCII filter
        (4, "tasse é", 3, "p1", "us", "E", 1, "test"),    # non-ASCII query dropped
        (5, "cup", 4, "p2", "us", "S", 1, "test"),        # no E in the group -> dropped
    ], EX)
    pr = spark.createDataFrame([("p1", "us", " Mug ", "NaN", None), ("p2", "us", None, "Acme", "b1")], PR)
    out = {r.example_id: r for r in prepare_pairs(ex, pr).collect()}
    assert set(out) == {1, 3}
    assert out[1].product_text_dense == "Mug."
    assert out[1].grade == 1.0


def test_overlap_removed_default_and_by_locale(spark):
    ex = spark.createDataFrame([
        (1, "q", 1, "p", "us", "E", 1, "test"),
        (2, "q", 1, "p", "us", "E", 1, "train"),
        (3, "q", 1, "p", "es", "E", 1, "train"),
    ], EX)
    default = sorted(r.example_id for r in prep.remove_train_test_overlap(ex).collect())
    by_loc = sorted(r.example_id for r in prep.remove_train_test_overlap(ex, by_locale=True).collect())
    assert default == [1]
    assert by_loc == [1, 3]


def test_sampling_is_repeatable_and_whole_queries(spark):
    ex = spark.createDataFrame([(i, "q", i % 7, "p", "us", "E", 1, "test") for i in range(50)], EX)
    a = sorted(r.example_id for r in prep.sample_queries(ex, 3, seed=1).collect())
    b = sorted(r.example_id for r in prep.sample_queries(ex, 3, seed=1).collect())
    assert a == b
    ids = {r.query_id for r in prep.sample_queries(ex, 3, seed=1).collect()}
    assert len(ids) == 3
    assert len(a) == sum(1 for i in range(50) if i % 7 in ids)
    assert prep.sample_queries(ex, 100).count() == 50


def test_overlap_removal_keeps_null_split(spark):
    from rankforge.operators import prep
    rows = [(1, "us", "train"), (1, "us", "test"), (1, "us", None)]
    df = spark.createDataFrame(rows, "query_id long, product_locale string, split string")
    assert sorted(str(r["split"]) for r in prep.remove_train_test_overlap(df).collect()) == ["None", "test"]


def test_fusion_counts_sources_named_by_weights_only(spark):
    from rankforge.operators.fusion import rrf_fuse
    df = spark.createDataFrame([(1, "ann", "a", 1.0, 0)], "query_id long, source string, product_id string, score double, rank int")
    assert rrf_fuse(df, {"ann": 2.0}).first()["rrf_score"] > 0

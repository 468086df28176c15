"""Plan shape: the optimizations the design relies on are really planned."""

from pyspark.sql import functions as F

from rankforge.operators import prep
from rankforge.operators.ranking import top_k
from rankforge.plans import catalog as C
from rankforge.plans.pipeline import prepare_pairs
from rankforge.sources import io
from rankforge.sources.fixtures import fixture
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    import contextlib
    import io as _io
    buf = _io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_top_k_plans_a_partial_window_group_limit(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 7)
    plan = _plan(top_k(df, "g", [F.col("id").desc()], 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_locale_filter_reaches_both_parquet_scans(spark):
    ex_path = io.scratch_path(spark, "ex")
    pr_path = io.scratch_path(spark, "pr")
    fixture(spark, SF_SMALL, "fx_examples").write.parquet(ex_path)
    fixture(spark, SF_SMALL, "fx_products").write.parquet(pr_path)
    pairs = prepare_pairs(io.read_examples(spark, ex_path), io.read_products(spark, pr_path))
    plan = _formatted(pairs)
    pushed = [line for line in plan.split("\n") if line.strip().startswith("PushedFilters")]
    assert len(pushed) >= 2, plan
    for s in pushed:
        assert "EqualTo(product_locale,us)" in s, s
    assert any("EqualTo(small_version,1)" in s for s in pushed)


def test_candidates_plan_has_no_cartesian_product(spark):
    _, cands = C._cands(spark, SF_SMALL)
    plan = _plan(cands)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert cands.count() > 0

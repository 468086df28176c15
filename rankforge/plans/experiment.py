"""Experiment sweeps and comparison tables (EXP-1/2, AGG-15/16, JN-7, PRJ-9,
FLT-9, SET-2).

A sweep is one job, not a loop of jobs: every retriever runs once (dense
once per prefix dimension), the ranked lists are tagged with the runs that
use them through a join with a small run table (strategy x dimension x
source -- its size is the product of the grid, fixed by the caller), and
fusion plus metrics are grouped by run.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.config import NDCG_KS, RECALL_KS, SOURCE_ORDER, RetrievalConfig
from rankforge.functions.names import join_sources
from rankforge.functions.scoring import lift_pct, rrf_term
from rankforge.operators import metrics as M
from rankforge.operators import prep
from rankforge.operators.dense import dense_search
from rankforge.operators.bm25 import bm25_search
from rankforge.operators.learned_sparse import sparse_search
from rankforge.plans.pipeline import Retrievers, SplitArtifacts, grade_lookup

# ---- fixed values: the strategy grid of the reference experiments ----
STRATEGIES: Mapping[str, tuple[str, ...]] = {
    "Dense Only": ("dense",),
    "Dense + BM25": ("dense", "bm25"),
    "Dense + SPLADE": ("dense", "splade"),
    "Dense + BM25 + SPLADE": ("dense", "bm25", "splade"),
}
# ---- end of fixed values ----


@dataclass(frozen=True)
class Run:
    """One retrieval setting of a sweep (EXP-2: fusion parameters are data)."""
    name: str
    dimension: int
    sources: tuple[str, ...]
    weights: Mapping[str, float]
    rrf_k: int = 60


def grid_runs(strategies: Mapping[str, Sequence[str]], dims: Sequence[int],
              cfg: RetrievalConfig = RetrievalConfig()) -> list[Run]:
    """EXP-1 grid: every strategy at every prefix dimension, config weights."""
    return [Run(name, int(d), tuple(srcs), dict(cfg.weights), cfg.rrf_k)
            for name, srcs in strategies.items() for d in dims]


def weight_grid_runs(sources: Sequence[str], dim: int, weight_grid: Sequence[Mapping[str, float]],
                     rrf_ks: Sequence[int] = (60,)) -> list[Run]:
    """EXP-2 grid: fusion weights x rrf_k for one source set and dimension."""
    runs = []
    for w in weight_grid:
        for k in rrf_ks:
            label = " ".join(f"{s}={w.get(s, 0.0):g}" for s in sources) + f" k={k}"
            runs.append(Run(label, int(dim), tuple(sources), dict(w), int(k)))
    return runs


def run_table(spark, runs: Sequence[Run]) -> DataFrame:
    """(strategy, dimension, source, sources, weight, rrf_k): one row per
    (run, source); its size is the grid the caller asked for. A source without
    a weight raises."""
    for r in runs:
        if lacking := [s for s in r.sources if s not in r.weights]:
            raise ValueError(f"run {r.name} has no fusion weight for source {', '.join(lacking)}")
    rows = [(r.name, r.dimension, s, list(r.sources), float(r.weights[s]), int(r.rrf_k)) for r in runs for s in r.sources]
    table = spark.createDataFrame(
        rows, "strategy string, dimension int, source string, sources array<string>, weight double, rrf_k int")
    return table.withColumn("sources", join_sources("sources"))


def sweep_candidates(art: SplitArtifacts, retr: Retrievers, cfg: RetrievalConfig = RetrievalConfig(),
                     dims: Sequence[int] = (64, 32, 16, 8),
                     strategies: Mapping[str, Sequence[str]] = STRATEGIES,
                     runs: Sequence[Run] | None = None, extra: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """EXP-1 / EXP-2: fused candidates of every run, one plan. Ranked lists of
    other sources come in ``extra`` (name -> list); they add in after the
    built-in sources, in the order given.

    Each retriever runs once (dense once per dimension used); the ranked
    lists are tagged with their runs by a join with the run table, and each
    tagged row carries its run's weight and rrf_k, so grids over fusion
    parameters need no extra retrieval."""
    spark = art.pairs.sparkSession
    runs = list(runs) if runs is not None else grid_runs(strategies, dims, cfg)
    queries = prep.gatekeep(art.queries, art.pairs, "broad")
    qids = queries.select("query_id")
    used, extra = {s for r in runs for s in r.sources}, dict(extra or {})
    order = [*SOURCE_ORDER, *(s for s in extra if s not in SOURCE_ORDER)]
    if unknown := sorted(used - set(order)):
        raise ValueError(f"no ranked list for source {', '.join(unknown)}")
    lists = []
    if "dense" in used:
        qv = retr.query_vectors.join(qids, "query_id", "left_semi")
        for d in sorted({r.dimension for r in runs if "dense" in r.sources}, reverse=True):
            lists.append(dense_search(qv, retr.product_vectors, cfg.dense_top_k, d, digits=cfg.score_digits)
                         .withColumn("dimension", F.lit(int(d))))
    if "bm25" in used:
        lists.append(bm25_search(retr.bm25, queries, cfg.sparse_top_k, digits=cfg.score_digits)
                     .withColumn("dimension", F.lit(None).cast("int")))
    if "splade" in used:
        qw = retr.splade_queries.join(qids, "query_id", "left_semi")
        lists.append(sparse_search(qw, retr.splade_docs, cfg.sparse_top_k, "splade", cfg.score_digits)
                     .withColumn("dimension", F.lit(None).cast("int")))
    for s in (s for s in extra if s in used):
        lists.append(extra[s].select("query_id", F.lit(s).alias("source"), "product_id", "score", "rank")
                     .withColumn("dimension", F.lit(None).cast("int")))
    ranked = reduce(DataFrame.unionByName, lists)
    table = run_table(spark, runs)
    dense_runs = ranked.where(F.col("source") == "dense").join(F.broadcast(table), ["source", "dimension"])
    other_runs = (ranked.where(F.col("source") != "dense").drop("dimension")
                  .join(F.broadcast(table), ["source"]))
    tagged = dense_runs.unionByName(other_runs).repartition("query_id")
    keys = ["strategy", "dimension", "sources"]
    term = rrf_term("rank", F.col("rrf_k"), F.col("weight"))
    parts = [F.sum(F.when(F.col("source") == s, term)).alias(f"__{s}") for s in order]
    code = F.coalesce(*[F.when(F.col("source") == s, F.lit(i)) for i, s in enumerate(order)])
    agg = tagged.groupBy(*keys, "query_id", "product_id").agg(
        *parts, F.min(F.struct(code.alias("src"), F.col("rank").alias("pos"))).alias("__first"))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"__{s}"), F.lit(0.0)) for s in order])
    fused = agg.select(*keys, "query_id", "product_id", total.alias("rrf_score"), "__first")
    w = Window.partitionBy(*keys, "query_id").orderBy(F.col("rrf_score").desc(), F.col("__first.src"),
                                                     F.col("__first.pos"))
    top = (fused.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= cfg.candidate_top_k)
           .drop("__rn", "__first"))
    grades = grade_lookup(art.pairs)
    return (top.join(grades, ["query_id", "product_id"], "left")
            .withColumn("grade", F.coalesce(F.col("grade"), F.lit(0.0))))


def sweep_metrics(art: SplitArtifacts, retr: Retrievers, cfg: RetrievalConfig = RetrievalConfig(),
                  dims: Sequence[int] = (64, 32, 16, 8), strategies: Mapping[str, Sequence[str]] = STRATEGIES,
                  model: str = "Baseline", recall_ks: Sequence[int] = RECALL_KS,
                  ndcg_ks: Sequence[int] = NDCG_KS, runs: Sequence[Run] | None = None,
                  extra: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """SET-2: one metric row per run (model, strategy, dimension, sources,
    recall_k..., ndcg_k...)."""
    cands = sweep_candidates(art, retr, cfg, dims, strategies, runs, extra)
    keys = ["strategy", "dimension", "sources"]
    w = Window.partitionBy(*keys, "query_id").orderBy(F.col("rrf_score").desc(), F.col("product_id").asc())
    ranked = cands.withColumn("pos", F.row_number().over(w))
    got = ranked.groupBy(*keys, "query_id").agg(
        *[F.sum(F.when((F.col("pos") <= k) & (F.col("grade") >= 0.10), 1).otherwise(0)).alias(f"hits_{k}")
          for k in recall_ks],
        *[F.coalesce(M.dcg("grade", "pos", k), F.lit(0.0)).alias(f"dcg_{k}") for k in ndcg_ks])
    summary = M.judged_summary(art.pairs, sorted(set(ndcg_ks)))
    j = got.join(summary, "query_id")
    per_q = j.select(*keys, "query_id",
                     *[F.when(F.col("n_rel") > 0, F.col(f"hits_{k}") / F.col("n_rel").cast("double"))
                       .alias(f"recall_{k}") for k in recall_ks],
                     *[F.when(F.coalesce(F.col("n_pos"), F.lit(0)) > 0,
                              F.when(F.col(f"idcg_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"idcg_{k}"))
                              .otherwise(F.lit(0.0))).alias(f"ndcg_{k}") for k in ndcg_ks])
    means = M.mean_metrics(per_q, recall_ks, ndcg_ks, group_by=keys)
    return means.select(F.lit(model).alias("model"), *keys,
                        *[f"recall_{k}" for k in recall_ks], *[f"ndcg_{k}" for k in ndcg_ks])


def sweep_pivot(metrics: DataFrame, value: str = "recall_200",
                strategies: Sequence[str] = tuple(STRATEGIES)) -> DataFrame:
    """AGG-15: dimension x strategy table of one metric (fixed pivot values,
    so no extra job to discover them)."""
    return metrics.groupBy("dimension").pivot("strategy", list(strategies)).agg(F.first(value))


def lift_comparison(base: DataFrame, tuned: DataFrame,
                    metrics: Sequence[str] = ("recall_200", "ndcg_20")) -> DataFrame:
    """JN-7 + AGG-16: join two sweeps on (strategy, dimension); lift in %."""
    b = base.select("strategy", "dimension", *[F.col(m).alias(f"{m}_base") for m in metrics])
    t = tuned.select("strategy", "dimension", *[F.col(m).alias(f"{m}_tuned") for m in metrics])
    j = b.join(t, ["strategy", "dimension"])
    return j.select("strategy", "dimension",
                    *[c for m in metrics for c in (F.col(f"{m}_base"), F.col(f"{m}_tuned"),
                                                   lift_pct(f"{m}_tuned", f"{m}_base").alias(f"{m}_lift_pct"))])


def at_dimension(table: DataFrame, dim: int, digits: int = 2) -> DataFrame:
    """FLT-9: one dimension of a comparison table, numbers rounded."""
    out = table.where(F.col("dimension") == int(dim))
    return out.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
                        for c, t in out.dtypes])


def stage_comparison(retrieval: DataFrame, reranked: DataFrame) -> DataFrame:
    """PRJ-9: two-stage table; the rerank stage has no recall columns."""
    first = retrieval.select(F.lit("1. Retrieval").alias("stage"), "ndcg_10", "ndcg_20", "ndcg_50",
                             "recall_100", "recall_200")
    second = reranked.select(F.lit("2. Reranking").alias("stage"), "ndcg_10", "ndcg_20", "ndcg_50")
    return first.unionByName(second, allowMissingColumns=True)

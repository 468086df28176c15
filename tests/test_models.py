"""User models: choice, loading once per worker, marks of their vectors."""

import os
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.functions.models import (DenseEncoder, HashedEncoder, Model, SparseEncoder, check_vectors, choose_model,
                                        marked)
from rankforge.operators.rerank import model_scorer
from rankforge.plans import catalog as C
from rankforge.plans import pipeline as pl
from rankforge.sources import io
from conftest import SF_SMALL


def counting(folder, dim=4):
    """A model that leaves a file for every load, named by worker."""
    def load(path):
        import uuid
        open(os.path.join(path, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: np.array([[len(t)] * dim for t in texts], np.float32)
    return Model(f"counting-{folder}", load, str(folder))


def test_a_worker_loads_a_model_once(spark, tmp_path):
    model = counting(tmp_path)
    encoder = DenseEncoder(model, 4, batch_size=3)
    rows = spark.range(200).select("id", F.lit("ab").alias("text")).repartition(24)
    for _ in range(3):  # three jobs of many tasks and batches
        assert encoder.documents(rows, "id", "text").agg(F.sum(F.col("embedding")[0])).first()[0] == 400
    loads = os.listdir(tmp_path)
    assert loads and len(loads) == len({x.split("-")[0] for x in loads})
    assert len(loads) < 3 * 24


def test_override_before_tuned_before_base(spark, tmp_path):
    base, override = Model("base", lambda p: None), Model("override", lambda p: None)
    tuned = Model("tuned", lambda p: None, str(tmp_path / "model"))
    assert choose_model(spark, base, tuned, override) is override
    assert choose_model(spark, base, tuned) is base       # its files do not exist
    (tmp_path / "model").mkdir()
    assert choose_model(spark, base, tuned) is tuned
    assert choose_model(spark, base) is base


def test_wrong_width_of_a_model_raises(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id long, text string")
    with pytest.raises(Exception, match=r"gave \(1, 4\), \(1, 8\) expected"):
        DenseEncoder(counting(tmp_path), 8).documents(rows, "id", "text").collect()


def test_null_texts_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (None, "abc")], "id long, text string")
    dense = DenseEncoder(counting(tmp_path), 4, instruction="12")
    assert {(r.id, r.embedding[0]) for r in dense.documents(rows, "id", "text").collect()} == {(1, 0.0), (None, 3.0)}
    assert {(r.id, r.embedding[0]) for r in dense.queries(rows, "id", "text").collect()} == {(1, 6.0), (None, 5.0)}
    assert dense.documents(rows.limit(0), "id", "text").count() == 0
    sparse = SparseEncoder(Model("letters", lambda p: lambda texts: [{t[:1]: 1.0} if t else {} for t in texts]))
    assert [tuple(r) for r in sparse.queries(rows, "id", "text").orderBy("term").collect()] == [(1, "N", 1.0), (None, "a", 1.0)]
    scorer = model_scorer(Model("longer", lambda p: lambda q, t: [len(a) - len(b) for a, b in zip(q, t)]), batch_size=1)
    assert sorted(r.s for r in rows.select(scorer(F.col("text"), F.lit("ab")).alias("s")).collect()) == [1.0, 2.0]


def test_marks_survive_and_mismatches_raise_before_any_job(spark):
    art = C._art(spark, SF_SMALL)
    retr = pl.build_retrievers(art, ("dense",))
    queries = spark.createDataFrame([(1, "large ring")], "query_id long, query string")
    cfg = replace(pl.INTERACTIVE_CONFIG, sources=("dense",))
    path = io.scratch_path(spark, "marked")
    retr.product_vectors.write.parquet(path)
    for vectors in (retr.product_vectors, spark.read.parquet(path), retr.product_vectors.join(art.products, "product_id")):
        check_vectors(vectors, HashedEncoder(64))
    groups = spark.sparkContext.statusTracker()
    before = len(groups.getJobIdsForGroup(None))
    for encoder, match in ((HashedEncoder(32), "with 64 components cannot"), (HashedEncoder(64, "b"), "hashed-a"), (None, "no dense encoder")):
        with pytest.raises(ValueError, match=match):
            pl.search_batch(queries, art, replace(retr, dense_encoder=encoder), cfg)
    with pytest.raises(ValueError, match="prefix of 128"):
        pl.search_batch(queries, art, retr, replace(cfg, dim=128))
    bare = retr.product_vectors.select("product_id", F.col("embedding").alias("embedding", metadata={}))
    with pytest.raises(ValueError, match="does not say"):
        pl.search_batch(queries, art, replace(retr, product_vectors=bare), cfg)
    assert len(groups.getJobIdsForGroup(None)) == before
    assert pl.search_batch(queries, art, retr, cfg).count() > 0
    check_vectors(bare.select(marked(F.col("embedding"), "hashed-a", 64)), HashedEncoder(64))

"""Micro-batch search over a stream of query files equals the batch search."""

from rankforge.plans import catalog as C
from rankforge.plans import pipeline as pl
from rankforge.sources import io
from rankforge.sources.fixtures import fixture
from rankforge.streaming.search_stream import start_search_stream
from conftest import SF_SMALL


def test_stream_answers_like_batch(spark):
    art = C._art(spark, SF_SMALL)
    retr = pl.build_retrievers(art)
    queries = fixture(spark, SF_SMALL, "fx_queries").select("query_id", "query")
    src, sink, ckpt = (io.scratch_path(spark, n) for n in ("qsrc", "qsink", "qckpt"))
    queries.write.parquet(src)
    q = start_search_stream(spark, src, sink, ckpt, art, retr, trigger_once=True)
    q.awaitTermination(600)
    assert q.exception() is None
    got = sorted(tuple(r) for r in spark.read.parquet(sink).drop("batch").collect())
    want = sorted(tuple(r) for r in pl.search_batch(queries, art, retr).collect())
    assert got == want and len(got) > 0

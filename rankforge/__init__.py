"""rankforge: hybrid search-relevance work as lazy Spark DataFrame operators.

Layout
------
functions/  column-level building blocks (text analysis, vectors, scoring, names)
sources/    readers, writers and the fixture views derived from the driver tables
operators/  DataFrame -> DataFrame operators (prep, retrieval, fusion, rerank, metrics)
plans/      composite entry points (prepare pairs, candidates, evaluate, sweeps)
streaming/  micro-batch search over a stream of query tables
"""

from rankforge.config import BM25Params, EvalConfig, RetrievalConfig

__all__ = ["BM25Params", "EvalConfig", "RetrievalConfig"]

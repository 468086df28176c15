"""Learned-sparse retrieval (JN-11, SCL-13, UDF-2).

Documents and queries are sparse term-weight vectors held in long form
(id, term, weight). Scoring is the same join as BM25 search: counted batches
of query terms are broadcast to the document weights, and sums and partial
top-k stay in the task when the weights are clustered by document
(``build_sparse_index``).
"""

from __future__ import annotations

from typing import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.functions.scoring import sparse_activation
from rankforge.operators.bm25 import pad_with_zero_scores, sum_by_document
from rankforge.operators.ranking import ranked_list
from rankforge.sources.clustered import write_clustered


def activations(logits: DataFrame, id_col: str = "doc_id", term_col: str = "term",
                logit_col: str = "logit") -> DataFrame:
    """SCL-13: weight(doc, term) = max over positions of log(1 + relu(logit)),
    zeros dropped. Input is long (id, position, term, logit) for real
    (unpadded) positions only, so a vector never depends on its batch (T6)."""
    return (logits.groupBy(F.col(id_col).alias("doc_id"), F.col(term_col).alias("term"))
            .agg(F.max(sparse_activation(logit_col)).alias("weight"))
            .where(F.col("weight") > 0))


def encode_sparse(df: DataFrame, id_col: str, text_col: str,
                  encoder: Callable[[list], Iterable[dict]], batch_size: int = 128,
                  term_type: str = "string") -> DataFrame:
    """UDF-2: run a user encoder over texts in batches (one model load per
    Python worker), emitting only the non-zero (doc_id, term, weight)."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                vecs = encoder([("" if t is None else str(t)) for t in part[text_col]])
                ids, terms, weights = [], [], []
                for doc, vec in zip(part[id_col], vecs):
                    for term, w in vec.items():
                        if w:
                            ids.append(doc)
                            terms.append(term)
                            weights.append(float(w))
                yield pd.DataFrame({"doc_id": ids, "term": terms, "weight": weights})

    schema = f"doc_id {id_type}, term {term_type}, weight double"
    return df.select(id_col, text_col).mapInPandas(run, schema=schema)


def build_sparse_index(weights: DataFrame) -> DataFrame:
    """The (doc_id, term, weight) rows written in buckets of doc_id (one job)."""
    return write_clustered(weights.select("doc_id", "term", "weight"), "doc_id")


def sparse_search(query_weights: DataFrame, doc_weights: DataFrame, k: int,
                  source: str = "splade", digits: int | None = 9, pad_zero: bool = False,
                  docs: DataFrame | None = None) -> DataFrame:
    """JN-11 + SRT-2: dot product of query and document term weights, top k.

    ``query_weights``: (query_id, term, weight); ``doc_weights``: (doc_id,
    term, weight). A query sharing no term with any document gets no rows;
    ``pad_zero`` fills short lists with zero-score documents (needs ``docs``)."""
    q = query_weights.select("query_id", "term", F.col("weight").alias("qw"))
    scores = sum_by_document(doc_weights, q)
    if pad_zero:
        if docs is None:
            raise ValueError("pad_zero needs the document id table")
        scores = pad_with_zero_scores(scores, docs, q.select("query_id").distinct(), k)
    return ranked_list(scores, "query_id", "doc_id", "score", k, source, digits)

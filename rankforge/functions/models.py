"""User models in jobs: which one is used, and loading it once per worker.

A ``Model`` names itself and knows how to load. ``choose_model`` resolves
override > tuned (if its files exist) > base. ``loaded`` keeps the loaded model
in the Python worker: a worker that Spark reuses for many tasks, and for many
batches of a task, loads it once.

An encoder turns texts into vectors or term weights and marks its output: the
column carries the model's name and width as metadata, which survives joins,
persisting and Parquet. ``check_vectors`` compares that mark with the encoder
that is to encode the queries before any job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.config import QUERY_INSTRUCTION
from rankforge.functions.encoders import hashed_bow_table
from rankforge.functions.text import analyze

_LOADED: dict[str, Any] = {}


@dataclass(frozen=True)
class Model:
    """``load(path)`` returns the callable that encodes a list of texts (or
    scores two lists). It runs on workers, so it must be picklable."""
    name: str
    load: Callable[[str | None], Callable] = field(compare=False)
    path: str | None = None

    @property
    def key(self) -> str:
        return f"{self.name}@{self.path or ''}"


def loaded(model: Model) -> Callable:
    """The loaded model of this Python worker."""
    if model.key not in _LOADED:
        _LOADED[model.key] = model.load(model.path)
    return _LOADED[model.key]


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if ``path`` is there for Spark, in whatever store it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def choose_model(spark: SparkSession, base: Model, tuned: Model | None = None, override: Model | None = None) -> Model:
    """UDF-1's choice: the override if given, else the tuned model if its
    files exist (or it needs none), else the base model."""
    if override is not None:
        return override
    if tuned is not None and (tuned.path is None or path_exists(spark, tuned.path)):
        return tuned
    return base


# ------------------------------------------------------------- marks
def marked(column: Column, model: str, dim: int, name: str = "embedding") -> Column:
    """The vector column with its model and width as metadata."""
    return column.alias(name, metadata={"model": model, "dim": int(dim)})


def check_vectors(vectors: DataFrame, encoder: "DenseEncoder | HashedEncoder", column: str = "embedding", dim: int | None = None) -> None:
    """Raises ValueError unless the vectors were made by the encoder's model
    at the encoder's width, and ``dim`` is a prefix of it. Reads the schema only."""
    mark = vectors.schema[column].metadata or {}
    if "model" not in mark:
        raise ValueError(f"column {column} does not say which model made it; see rankforge.functions.models.marked")
    if (mark["model"], mark["dim"]) != (encoder.name, encoder.dim):
        raise ValueError(f"vectors of {mark['model']} with {mark['dim']} components cannot be searched with {encoder.name} with {encoder.dim}")
    if dim is not None and not 1 <= dim <= encoder.dim:
        raise ValueError(f"a prefix of {dim} components was asked for, {encoder.name} has {encoder.dim}")


# ------------------------------------------------------------- dense encoders
def _text(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")


@dataclass(frozen=True)
class DenseEncoder:
    """UDF-1: vectors from a user model in Arrow batches. A null document is
    encoded as '', a null query as 'None', queries behind the instruction."""
    model: Model
    dim: int
    instruction: str = QUERY_INSTRUCTION
    batch_size: int = 32

    @property
    def name(self) -> str:
        return self.model.name

    def documents(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._encoded(df, id_col, F.coalesce(_text(text_col), F.lit("")))

    def queries(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._encoded(df, id_col, F.concat(F.lit(self.instruction), F.coalesce(_text(text_col), F.lit("None"))))

    def _encoded(self, df: DataFrame, id_col: str, text: Column) -> DataFrame:
        model, dim, size = self.model, self.dim, self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = loaded(model)
            for batch in batches:
                for lo in range(0, batch.num_rows, size):
                    part = batch.slice(lo, size)
                    vectors = np.asarray(encode(part.column(1).to_pylist()), np.float32)
                    if vectors.shape != (part.num_rows, dim):
                        raise ValueError(f"{model.name} gave {vectors.shape}, {(part.num_rows, dim)} expected")
                    offsets = pa.array(np.arange(0, vectors.size + 1, dim, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))],
                                                     names=[id_col, "embedding"])

        id_type = df.schema[id_col].dataType.simpleString()
        out = df.select(id_col, text.alias("__text")).mapInArrow(run, f"`{id_col}` {id_type}, embedding array<float>")
        return out.select(id_col, marked(F.col("embedding"), self.name, dim))


@dataclass(frozen=True)
class HashedEncoder:
    """The model-free stand-in, as column expressions."""
    dim: int = 64
    variant: str = "a"
    instruction: str = QUERY_INSTRUCTION

    @property
    def name(self) -> str:
        return f"hashed-{self.variant}"

    def documents(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._encoded(df, id_col, _text(text_col))

    def queries(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._encoded(df, id_col, F.concat(F.lit(self.instruction), F.coalesce(_text(text_col), F.lit("None"))))

    def _encoded(self, df: DataFrame, id_col: str, text: Column) -> DataFrame:
        out = hashed_bow_table(df, id_col, text, self.dim, self.variant)
        return out.select(id_col, marked(F.col("embedding"), self.name, self.dim))


# ------------------------------------------------------------- sparse encoders
@dataclass(frozen=True)
class SparseEncoder:
    """UDF-2: term weights from a user model, the non-zero ones only."""
    model: Model
    batch_size: int = 128
    term_type: str = "string"

    @property
    def name(self) -> str:
        return self.model.name

    def documents(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._encoded(df, id_col, F.coalesce(_text(text_col), F.lit("")))

    def queries(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._encoded(df, id_col, F.coalesce(_text(text_col), F.lit("None"))).withColumnRenamed("doc_id", id_col)

    def _encoded(self, df: DataFrame, id_col: str, text: Column) -> DataFrame:
        from rankforge.operators.learned_sparse import encode_sparse
        model = self.model
        return encode_sparse(df.select(id_col, text.alias("__text")), id_col, "__text", lambda texts: loaded(model)(texts),
                             self.batch_size, self.term_type)


@dataclass(frozen=True)
class LogTfEncoder:
    """The model-free stand-in ln(1 + tf) of unstemmed tokens."""
    name: str = "log-tf"

    def documents(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._weights(df, id_col, text_col, "")

    def queries(self, df: DataFrame, id_col: str, text_col) -> DataFrame:
        return self._weights(df, id_col, text_col, "None").withColumnRenamed("doc_id", id_col)

    def _weights(self, df: DataFrame, id_col: str, text_col, null_as: str) -> DataFrame:
        rows = df.select(F.col(id_col).alias("doc_id"), _text(text_col).alias("text"))
        tf = analyze(rows, "doc_id", "text", stem=False, null_as=null_as)
        return tf.select("doc_id", "term", F.log1p(F.col("tf").cast("double")).alias("weight"))

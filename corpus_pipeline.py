"""The training-data pipeline: five stages over ``documents``.

1. language_id     drops documents whose language cannot be told
2. minhash         keeps one document of every group of near copies
3. decontaminate   drops documents that hold a passage of the benchmark
4. pii             masks personal data in the texts
5. pack            packs the token ids of what is left into sequences

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared checkpoint folder and hands the written table to
the next one. All stages but the last return the columns of ``documents``, extra
ones included, whatever their names. Null and empty texts go with the first
stage; repeated rows are near copies of each other; an empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankforge.llm import decontam, langid, minhash, packing, pii
from rankforge.llm.common import Scratch
from rankforge.llm.queries import table, tokenizer_files


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language the classifier does not reject (null text or no
    letter: rejected). The model learns from ``docs`` itself."""
    names = ("_rf_lang", "_rf_score", "_rf_rejected")
    judged = langid.predict(docs, langid.fit(docs), docs.columns, names)
    return judged.where("NOT _rf_rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies (similarity 0.8 or more)."""
    return minhash.dedup(docs, threshold=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in their texts replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the sequences."""
    return packing.pack(docs, **tokenizer_files())


STAGES = [("language_id", language_id), ("minhash", near_duplicates), ("decontaminate", decontaminate),
          ("pii", mask_pii), ("pack", pack)]

# MinHash, byte-level BPE and the packing plan have no SQL form; the stages are
# tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs

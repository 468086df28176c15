"""UDF-3 as a job: the dictionary of stems of a whole table of term counts.

``stem_dictionary`` stems every distinct term once: the distinct terms come
from a partial and a final aggregate, so a word of every document is one row
per task in the exchange. The dictionary can be kept and reused for later
tables. ``apply_dictionary`` joins it back by its counted size:

* up to ``most`` terms: the whole dictionary is broadcast;
* beyond: the ``most`` most frequent terms are broadcast, the others are joined
  by an exchange on the term. Only rare terms are left for that exchange, so no
  word fills a task.

``analyze(stem=True)`` stems in the row instead, with a memory per worker, and
needs no exchange of the counts; both give the same terms (tested).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.text import stem_udf
from rankforge.sources.clustered import written

MAX_BROADCAST_TERMS = 500_000


def stem_dictionary(counts: DataFrame, term_col: str = "term") -> DataFrame:
    """(term, stem, n_rows) of every distinct non-null term; ``n_rows`` is the
    number of rows that hold it."""
    terms = counts.where(F.col(term_col).isNotNull()).groupBy(F.col(term_col).alias("term"))
    return terms.agg(F.count(F.lit(1)).alias("n_rows")).select("term", stem_udf("term").alias("stem"), "n_rows")


def apply_dictionary(counts: DataFrame, dictionary: DataFrame, id_cols, most: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """(id_cols..., term, tf) with every term replaced by its stem and the
    counts of equal stems added up. Terms that the dictionary lacks, and null
    terms, stay as they are. Writes the dictionary once and counts it; reads
    ``counts`` up to twice, so counts that take long are best written."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    words = written(dictionary.select("term", "stem", "n_rows"))
    rows = counts.select(*ids, "term", "tf")
    n = words.count()
    if n <= most:
        stemmed = _joined(rows, F.broadcast(words.select("term", "stem")))
    else:
        # the frequency at which `most` terms are left; ties below it go to the exchange
        sizes = words.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_terms"))  # one row per frequency
        reached = sizes.withColumn("reached", F.sum("n_terms").over(Window.orderBy(F.desc("n_rows"))))
        bound = reached.where(F.col("reached") > most).agg(F.max("n_rows")).first()[0]
        frequent = words.where(F.col("n_rows") > bound).select("term", "stem")
        hot = rows.join(F.broadcast(frequent), "term")
        rest = rows.join(F.broadcast(frequent.select("term")), "term", "left_anti")
        rare = words.where(F.col("n_rows") <= bound).select("term", "stem")
        stemmed = hot.select(*ids, "tf", F.col("stem").alias("term")).unionByName(
            _joined(rest.select(*ids, "term", "tf"), rare.hint("merge")))
    return stemmed.groupBy(*ids, "term").agg(F.sum("tf").alias("tf"))


def _joined(rows: DataFrame, words: DataFrame) -> DataFrame:
    others = [c for c in rows.columns if c != "term"]
    return rows.join(words, "term", "left").select(*others, F.coalesce("stem", "term").alias("term"))

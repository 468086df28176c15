"""The registered queries of this subpackage: one per operator, each over its
whole table with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm import alignment, decontam, embeddings, langid, linededup, minhash, packing, periodic, pii, quality, sharding, suffix, toxicity
from rankforge.llm.common import held_out
from rankforge.session import ship_package

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_files() -> dict[str, str]:
    """Paths and splitting pattern of the public tokenizer that op1 packs for."""
    import public_tokenizers as P

    return {"json_path": P.path("byte_bpe_50k.json"), "rank_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048, closing_id=0, **tokenizer_files())


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", held_out())
    return langid.predict(docs, langid.fit(docs), ["doc_id", "held_out"]).drop("rejected")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start_word", "n_words")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign(docs, "doc_id", SHARDS)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), threshold=85).drop("set_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def repeated_from(doc_id: int | None, words: list) -> list:
    """The words of every tenth document repeat from a word on: a = g % n,
    period 1 + (n - a) // (3 + g % 8), with g from the crc32 of the id."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * ((n - a) // period + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"), least=12, prepare=repeated_from)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return alignment.Alignment(table(spark, sf_dir, "documents"), **tokenizer_files(), piece_path=P.path("piece_bpe_32k.model")).documents()


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"), at_least=3, least_length=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_embedding_dedup, op3_language_id, op4_suffix_dedup, op5_decontamination, op6_sharding, op7_pii, op8_quality, op9_minhash, op10_toxicity, op11_periodic_runs, op12_alignment, op13_line_dedup)}


# Every window of every document that starts up to an item's length before one
# of the item's shingles is compared with the item by counts.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) - 4 AS n, i AS pos, array_to_string(w[i + 1:i + 5], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
bs AS (SELECT item_id, len(w) - 4 AS m, array_to_string(w[i + 1:i + 5], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(len(w) - 4)) AS i FROM b WHERE len(w) >= 5)),
bc AS (SELECT item_id, m, g, count(*) AS c FROM bs GROUP BY ALL),
h AS (SELECT doc_id, n, item_id, m, pos, g, c FROM ds JOIN bc USING (g)),
s AS (SELECT DISTINCT doc_id, n, item_id, m, start FROM (
        SELECT doc_id, n, item_id, m, unnest(range(greatest(0, least(pos - m + 1, n - m)), greatest(0, least(pos, n - m)) + 1)) AS start FROM h)),
x AS (SELECT doc_id, n, item_id, m, start, g, least(count(*), c) AS common FROM s JOIN h USING (doc_id, n, item_id, m)
      WHERE pos >= start AND pos < start + m GROUP BY doc_id, n, item_id, m, start, g, c),
y AS (SELECT doc_id, item_id, start, least(m, n) AS k, m, sum(common) AS common FROM x GROUP BY doc_id, n, item_id, m, start),
z AS (SELECT doc_id, item_id, start, k, common / (k + m - common) AS similarity FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS rn FROM z WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start_word, CAST(k + 4 AS INTEGER) AS n_words FROM r WHERE rn = 1
"""


# Lines as a list per document, so that their order can be kept.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.rid, k.doc_id, k.i, k.line, c.keep IS NOT NULL AND k.doc_id < c.keep AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": OP5_SQL, "op13_line_dedup": OP13_SQL}

"""Text functions: field cleaning, ASCII test, sparse-text analysis, stemming.

The analyser of the sparse retrievers is: lower-case, Unicode NFKD, every run
of characters outside ``[a-z0-9-.#+]`` becomes one space, then word tokens
``\\b\\w+\\b``. After that normalisation the tokens are exactly the runs of
``[a-z0-9]``, so the tokens of a column are JVM column expressions:

* lower-case in the JVM; rows with another than an ASCII character go through
  lower-case + NFKD in one Arrow-batched helper,
* ``regexp_extract_all(text, '[a-z0-9]+')`` in the JVM.

Accents thus split words ("crème" -> "cre me"), as NFKD + the separator rule
do. A pure-JVM variant (``word_tokens_jvm``) rewrites non-ASCII pieces
through an NFKD table built by rule from ``unicodedata`` (every code point
whose lower-cased NFKD form holds an ASCII letter or digit); it gives the
same tokens and serves inside higher-order functions.

Terms are counted inside their row, in Arrow batches of which a worker turns
about a MB at a time into Python strings. Stemming sees each distinct word of a row
once, and a worker remembers the stems. ``operators/stems.py`` is the
dictionary job: every distinct word of the corpus stemmed once and joined back.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankforge.functions.porter import stem as porter_stem

TOKEN_PATTERN = "[a-z0-9]+"
SLICE_BYTES = 1 << 20  # bytes of text that a worker holds as Python strings at once
NON_ASCII_PATTERN = "[^\\x00-\\x7F]"
# white space plus the ASCII/Unicode separators the field cleaner strips
_EDGE_SPACE = "^[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+|" \
              "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+$"

# ---- fixed values: strings a cleaned field treats as missing ----
MISSING_MARKERS = ("none", "nan", "")
# ---- end of fixed values ----


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_ascii(c) -> Column:
    """SCL-6: true when the string has only ASCII characters (null stays null)."""
    return ~_col(c).rlike(NON_ASCII_PATTERN)


def clean_field(c) -> Column:
    """SCL-5: null -> '', strip Unicode white space, 'none'/'nan'/'' -> ''."""
    s = F.regexp_replace(_col(c).cast("string"), _EDGE_SPACE, "")
    return F.when(s.isNull() | F.lower(s).isin(*MISSING_MARKERS), F.lit("")).otherwise(s)


def word_tokens_py(text) -> list[str]:
    return re.findall(TOKEN_PATTERN, _lower_nfkd(text)) if isinstance(text, str) else []


@lru_cache(maxsize=1)
def nfkd_table() -> dict[str, str]:
    """Lower-cased character -> its NFKD form, for every code point whose
    decomposition carries an ASCII letter or digit (built by rule)."""
    table: dict[str, str] = {}
    for cp in range(0x80, 0x110000):
        ch = chr(cp)
        if unicodedata.category(ch) in ("Cs", "Cn"):
            continue
        for key in {ch, ch.lower()}:
            if len(key) != 1 or ord(key) < 0x80:
                continue
            low = key.lower()
            dec = unicodedata.normalize("NFKD", low)
            if dec != key and re.search("[a-z0-9]", dec):
                table[key] = dec
    return table


@lru_cache(maxsize=1)
def _nfkd_json() -> str:
    return json.dumps(nfkd_table(), ensure_ascii=True, sort_keys=True)


def _nfkd_map_column() -> Column:
    # one string literal, folded to a map constant by the optimizer
    return F.from_json(F.lit(_nfkd_json()), "map<string,string>")


def _map_piece(piece: Column, table: Column) -> Column:
    chars = F.split(piece, "")
    mapped = F.transform(chars, lambda ch: F.coalesce(F.try_element_at(table, ch), ch))
    return F.array_join(mapped, "")


def _lower_nfkd(text):
    if text is None:
        return None
    low = text.lower()
    return low if low.isascii() else unicodedata.normalize("NFKD", low)


@F.arrow_udf(T.StringType())
def _lower_nfkd_udf(texts: pa.Array) -> pa.Array:
    return pa.chunked_array([pa.array([_lower_nfkd(t) for t in texts.slice(lo, n).to_pylist()], pa.string())
                             for lo, n in text_slices(texts)], pa.string()).combine_chunks()


def text_slices(texts: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(start, number of rows) of consecutive parts of about ``budget`` bytes
    of text, so that a worker holds that much of a batch as Python strings."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + budget, "right")))
        yield lo, hi - lo
        lo = hi


def word_tokens(c, null_as: str | None = "") -> Column:
    """SCL-1 + SCL-2: array of word tokens of a text column.

    ASCII rows stay in the JVM. Only rows with another character send their
    text to a small Arrow-batched helper (Python's C-implemented
    ``unicodedata``) for lower-casing + NFKD. The token extraction is the JVM
    ``regexp_extract_all``. ``null_as`` is the text a
    null becomes first ('' for fields, 'None' for raw query strings, as
    ``str(None)``). Not usable inside a higher-order lambda: put the tokens
    in a column first."""
    text = _col(c).cast("string")
    if null_as is not None:
        text = F.coalesce(text, F.lit(null_as))
    other = _lower_nfkd_udf(F.when(text.rlike(NON_ASCII_PATTERN), text))
    return F.regexp_extract_all(F.coalesce(other, F.lower(text)), F.lit(TOKEN_PATTERN), 0)


def word_tokens_jvm(c, null_as: str | None = "") -> Column:
    """Pure-JVM form of :func:`word_tokens` (usable inside higher-order
    functions): non-ASCII pieces are rewritten through the NFKD table. Equal
    results, slower on long non-ASCII texts."""
    text = _col(c).cast("string")
    if null_as is not None:
        text = F.coalesce(text, F.lit(null_as))
    low = F.lower(text)
    table = _nfkd_map_column()
    pieces = F.split(low, "\\s+")
    rewritten = F.transform(
        pieces,
        lambda p: F.when(p.rlike(NON_ASCII_PATTERN), _map_piece(p, table)).otherwise(p))
    general = F.regexp_extract_all(F.array_join(rewritten, " "), F.lit(TOKEN_PATTERN), 0)
    fast = F.regexp_extract_all(low, F.lit(TOKEN_PATTERN), 0)
    return F.when(low.rlike(NON_ASCII_PATTERN), general).otherwise(fast)


def normalize_sparse_text(c) -> Column:
    """SCL-1 as a string column: the tokens joined by one space.

    Equal to the reference normaliser up to the kept ``-.#+`` characters,
    which never reach a token."""
    return F.array_join(word_tokens(c), " ")


@F.pandas_udf(T.StringType())
def stem_udf(words: pd.Series) -> pd.Series:
    """UDF-3: the stem of every word. A worker remembers the stems of the last
    million words, so a frequent word is stemmed once per worker."""
    return words.map(_cached_stem, na_action="ignore")


@lru_cache(maxsize=1 << 20)
def _cached_stem(word: str) -> str:
    return porter_stem(word)


def row_term_counts(df: DataFrame, id_cols, text_col: str, null_as: str | None = "") -> DataFrame:
    """(id_cols..., term, tf) of every row, unstemmed, counted inside the row and
    sorted by term there: no exchange. Rows that share their ids are not added up."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    text = F.col(text_col).cast("string")
    rows = df.select(*ids, (text if null_as is None else F.coalesce(text, F.lit(null_as))).alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(ids))
            for lo, n in text_slices(texts):
                counts = [sorted(Counter(word_tokens_py(t)).items()) for t in texts.slice(lo, n).to_pylist()]
                row = np.repeat(np.arange(lo, lo + n), [len(c) for c in counts])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(pa.array(row)) for i in range(len(ids))),
                     pa.array([w for c in counts for w, _ in c], pa.string()),
                     pa.array([tf for c in counts for _, tf in c], pa.int64())], names=schema.names)

    return rows.mapInArrow(count, schema)


def analyze(df: DataFrame, id_cols, text_col: str, stem: bool = True,
            null_as: str | None = "", partitions: int | None = None) -> DataFrame:
    """Term counts per id: (id_cols..., term, tf), clustered by the ids.

    Texts are tokenised and counted inside their row, the terms of the counts
    are stemmed one by one, and only the counts are exchanged, once, on the
    ids (into ``partitions`` if given). Terms with one stem, and rows that
    share their ids, are then added up on that clustering. The stems never
    stand inside a lambda or a sort: Catalyst merges neighbouring projections
    and would evaluate those again for every element."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    counts = row_term_counts(df, ids, text_col, null_as)
    if stem:
        counts = counts.select(*ids, stem_udf("term").alias("term"), "tf")
    counts = counts.repartition(partitions, *ids) if partitions else counts.repartition(*ids)
    return counts.groupBy(*ids, "term").agg(F.sum("tf").alias("tf"))


def token_count(c) -> Column:
    """Default token-length expression for the length profile: word pieces
    and single punctuation marks, plus the two special tokens of an encoder."""
    return F.size(F.regexp_extract_all(F.coalesce(_col(c).cast("string"), F.lit("")),
                                       F.lit("[A-Za-z0-9]+|[^A-Za-z0-9\\s]"), 0)) + F.lit(2)

"""Text analysis: hand-made cases, stemming, and Spark == Python on whole texts."""

import pytest
from pyspark.sql import functions as F

from rankforge.functions.porter import stem
from rankforge.functions.text import (analyze, clean_field, is_ascii, word_tokens, word_tokens_jvm,
                                      word_tokens_py)
from conftest import SF_SMALL

CASES = [
    ("crème brûlée", ["cre", "me", "bru", "le", "e"]),
    ("C++ .NET #1 iPhone-13", ["c", "net", "1", "iphone", "13"]),
    ("Nike™ Shoes", ["nike", "shoes"]),
    ("ﬁve ½ in", ["five", "1", "2", "in"]),
    ("", []),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_python_normaliser(text, expected):
    assert word_tokens_py(text) == expected


def test_spark_tokens_hand_cases(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, t string")
    got = {r.id: (r.a, r.b) for r in df.select("id", word_tokens("t").alias("a"),
                                               word_tokens_jvm("t").alias("b")).collect()}
    for i, (_, expected) in enumerate(CASES):
        assert got[i][0] == expected
        assert got[i][1] == expected


def test_spark_tokens_equal_python_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", word_tokens("text").alias("a"),
                       word_tokens_jvm("text").alias("b")).collect()
    assert rows
    for r in rows:
        expected = word_tokens_py(r.text)
        assert r.a == expected, r.doc_id
        assert r.b == expected, r.doc_id


def test_field_cleaner(spark):
    df = spark.createDataFrame([(" Mug ", "NaN", None), (" x　", "none", " ")], "a string, b string, c string")
    out = df.select(clean_field("a").alias("a"), clean_field("b").alias("b"), clean_field("c").alias("c")).collect()
    assert (out[0].a, out[0].b, out[0].c) == ("Mug", "", "")
    assert out[1].a == "x"


def test_ascii_test_keeps_null_as_null(spark):
    df = spark.createDataFrame([("abc",), ("é",), (None,)], "q string")
    assert [r.x for r in df.select(is_ascii("q").alias("x")).collect()] == [True, False, None]


# Examples of the 1980 paper (and two irregular forms of the common extension set)
PORTER = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall",
    "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit",
    "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "callousness": "callous", "triplicate": "triplic", "formative": "form", "formalize": "formal",
    "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv",
    "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ",
    "effective": "effect", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate",
    "cease": "ceas", "generalizations": "gener", "oscillators": "oscil", "large": "larg",
    "dying": "die", "skies": "sky", "news": "news", "is": "is",
}


@pytest.mark.parametrize("word,expected", sorted(PORTER.items()))
def test_porter(word, expected):
    assert stem(word) == expected


def test_part_name_vocabulary_only_large_changes(spark):
    words = ("blue cold hot large new old red small anvil bolt gear gizmo plate ring rod widget").split()
    changed = {w: stem(w) for w in words if stem(w) != w}
    assert changed == {"large": "larg"}


def test_analyze_counts_repeated_words(spark):
    df = spark.createDataFrame([(1, "red red ring"), (2, None)], "id int, t string")
    got = {(r.id, r.term): r.tf for r in analyze(df, "id", "t", stem=True).collect()}
    assert got == {(1, "red"): 2, (1, "ring"): 1}


def test_a_batch_is_turned_into_strings_by_slices(spark):
    """A batch of long texts is never held whole as Python strings."""
    import tracemalloc

    import pyarrow as pa

    from rankforge.functions.text import SLICE_BYTES, _lower_nfkd, _lower_nfkd_udf, text_slices
    texts = [("É %d ω " % i) * 4000 for i in range(600)] + [None, "", "ﬁ"]
    batch = pa.array(texts)
    assert batch.nbytes > 16 * SLICE_BYTES
    assert [n for _, n in text_slices(pa.array([None, "x" * 2 * SLICE_BYTES, "", "y"]))] == [1, 1, 2]
    tracemalloc.start()
    try:
        got = _lower_nfkd_udf.func(batch)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got.to_pylist() == [_lower_nfkd(t) for t in texts]
    assert peak < batch.nbytes / 2


def test_row_term_counts_equal_the_tokens_of_each_row(spark):
    from collections import Counter

    from rankforge.functions.text import row_term_counts
    texts = ["B a b", "Crème İ K ﬁ x1", "", None, "a" * 5000 + " b", "--"]
    df = spark.createDataFrame([(i % 4, "k", t) for i, t in enumerate(texts)], "id int, kind string, t string")
    for null_as in ("", "None", None):
        got = Counter((r.id, r.kind, r.term, r.tf) for r in row_term_counts(df, ["id", "kind"], "t", null_as).collect())
        want = Counter()
        for i, t in enumerate(texts):
            t = null_as if t is None else t
            want.update((i % 4, "k", w, n) for w, n in Counter(word_tokens_py(t)).items())
        assert got == want

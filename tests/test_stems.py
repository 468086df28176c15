"""Stemmed analysis: worker cache, dictionary job and the SQL rules agree."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from rankforge.functions.porter import stem
from rankforge.functions.text import analyze, row_term_counts
from rankforge.operators.stems import apply_dictionary, stem_dictionary
from rankforge.plans.oracle import stem_ctes
from conftest import SF_SMALL
from test_text import PORTER

MORE = ("conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli "
        "vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti "
        "sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance "
        "inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption "
        "homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll "
        "happy sky skies dying ties died spied say enjoy by yyyy ayyb syzygy yay biology geology theology "
        "radically hopefully rationally equalli falling hissing fizzed failing filing agreed bleed hopping tanned").split()


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_sql_rules_equal_the_stemmer():
    words = sorted(set(PORTER) | set(MORE) | {w[:n] for w in MORE for n in range(1, len(w))})
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS w", [words])
    got = dict(con.execute(f"WITH {stem_ctes('x', 'words')} SELECT t, w FROM x_stem").fetchall())
    assert got == {w: stem(w) for w in words}


@pytest.fixture(scope="module")
def counts(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    return docs, row_term_counts(docs, "doc_id", "text").persist()


@pytest.mark.parametrize("most", [500_000, 50, 1])
def test_dictionary_joined_back_equals_worker_stems(counts, most):
    docs, plain = counts
    want = rows_of(analyze(docs, "doc_id", "text", stem=True), "doc_id", "term", "tf")
    assert rows_of(apply_dictionary(plain, stem_dictionary(plain), "doc_id", most=most), "doc_id", "term", "tf") == want


def test_dictionary_odd_rows(spark):
    rows = spark.createDataFrame([(1, "cats", 2), (1, "cat", 1), (1, None, 5), (None, "cats", 1), (2, "cats", 1), (2, "cats", 1)],
                                 "doc_id long, term string, tf long")
    words = stem_dictionary(rows)
    assert rows_of(words, "term", "stem", "n_rows") == [("cat", "cat", 1), ("cats", "cat", 4)]
    got = {(r.doc_id, r.term): r.tf for r in apply_dictionary(rows, words, "doc_id").collect()}
    assert got == {(1, "cat"): 3, (1, None): 5, (None, "cat"): 1, (2, "cat"): 2}
    empty = rows.limit(0)
    assert apply_dictionary(empty, stem_dictionary(empty), "doc_id").count() == 0


def test_no_sort_or_pattern_inside_the_stemmer_call(spark, counts):
    """The blow-up of an earlier layout: a merged projection evaluated the
    sort and the tokenising anew for every element."""
    plan = analyze(counts[0], "doc_id", "text", stem=True)._jdf.queryExecution().executedPlan().toString()
    calls = re.findall(r"stem_udf\(([^)]*)\)", plan)
    assert calls and all(re.fullmatch(r"(term|_\d+|\w+)#\d+L?", c) for c in calls), calls
    for line in plan.splitlines():
        if "lambdafunction" in line:
            inner = line.split("lambdafunction(", 1)[1]
            assert "sort_array" not in inner and "regexp_extract_all" not in inner


def test_stemmed_counts_tokenise_once(spark, tmp_path):
    """The documents are read and counted for the written table only."""
    from rankforge.plans import catalog
    rows = [(1, "hopping hopped Hop"), (2, "hop crème"), (2, "hops"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.q_stemmed_counts(spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "MapInArrow" not in plan and "regexp_extract_all" not in plan
    assert rows_of(got, "doc_id", "term", "tf") == [(1, "hop", 3), (2, "cre", 1), (2, "hop", 2), (2, "me", 1)]

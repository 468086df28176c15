"""Line dedup against a plain reading of its contract."""

import collections
import hashlib
import random

import pytest

from rankforge.llm import linededup, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, salt string, ids string, digests string, n_lines string"


def brute(rows, at_least=3, least=20):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(doc_id)
    keep = {k: max(ids, key=lambda x: (x is not None, x or 0)) for k, ids in holders.items() if len(ids) >= at_least}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if keep.get(key(x), doc_id) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(queries.op13_line_dedup(spark, SF)) == want and sum(r[2] for r in want) > 0


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    shared = ["A line that many documents hold", "  a LINE that many documents hold\t", "ünïcödé line of twenty ÄÖÜ", "x" * 20, "y" * 19,
              " no-break space stays at the ends ", "long " * 40_000, "", "   ", "12345678901234567890"]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(rng.choice(shared) for _ in range(rng.randrange(1, 9)))))
    rows += [(3, rows[3][1]), (4, "another text of doc four\n" + shared[0]), (None, shared[0]), (None, shared[3] + "\n" + shared[0]), (100, None), (101, ""),
             (102, "\n"), (103, shared[0] + "\n"), (104, "held by one document only, twice\nheld by one document only, twice"),
             (104, "held by one document only, twice"), (-5, shared[2]), (105, "two documents hold this line"), (106, "two documents hold this line")]
    return rows


@pytest.mark.parametrize("filter_bits", [28, 12, 8])
def test_odd_rows_at_any_filter(spark, odd, filter_bits):
    """A filter that is far too small suspects every line and loses nothing."""
    df = spark.createDataFrame([(i, t, "k", "s", "i", "d", "n") for i, t in odd], SCHEMA).repartition(5)
    assert got(linededup.report(df, filter_bits=filter_bits)) == brute(odd)


def test_texts_and_other_thresholds(spark, odd):
    df = spark.createDataFrame([(i, t, "k", "s", "i", "d", "n") for i, t in odd], SCHEMA).repartition(3)
    assert got(linededup.report(df, at_least=2, least_length=5)) == brute(odd, 2, 5)
    rows = {r.doc_id: bytes(r.text).decode() for r in linededup.drop_shared_lines(df).collect()}
    assert rows[103] == dict(odd)[103] and rows[101] == "" and rows[102] == "\n"


def test_empty(spark):
    assert linededup.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_filter_has_every_repeat_and_few_others(spark):
    rows = [(i, f"line number {i} of its own document\nshared line {i % 40} of some documents") for i in range(400)]
    parts = linededup.twice_seen(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 20, 20)
    suspects = linededup.Suspects(parts, 20)
    assert len(suspects.among({linededup.line_key(t.split("\n")[1].encode()) for _, t in rows})) == 40
    assert len(suspects.among({linededup.line_key(t.split("\n")[0].encode()) for _, t in rows})) <= 4

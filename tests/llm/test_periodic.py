"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import periodic, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, runs string, start string, n_words string"


def brute_runs(words, least=12):
    """Every period on its own: stretches of words that equal the word p later."""
    names = {}
    w = np.array([names.setdefault(x, len(names)) for x in words], np.int64)
    found = []
    for p in range(1, len(w) // 2 + 1):
        same = np.concatenate(([0], (w[p:] == w[:-p]).astype(np.int8), [0]))
        turn = np.flatnonzero(np.diff(same))
        for a, b in zip(turn[::2], turn[1::2]):
            n = int(b - a) + p
            if n >= max(least, 2 * p) and not any(q < p and s <= a and s + m >= a + n for s, m, q in found):
                found.append((int(a), n, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, words):
    runs = brute_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
            sha(" ".join(x for i, x in enumerate(words) if i not in gone)))


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def by_contract(doc_id, text):
    words, h = split(text), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return brute_row(doc_id, words)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_the_definition(letters):
    rng = random.Random(letters)
    for n in [0, 1, 2, 3, 5, 11, 12, 13, 24, 25, *range(30, 90, 7)]:
        for _ in range(12):
            words = [rng.randrange(letters) for _ in range(n)]
            if rng.random() < 0.6 and n > 4:  # a periodic part inside
                a, p = rng.randrange(n // 2), rng.randrange(1, n // 3 + 2)
                words[a:] = [words[a + i % p] if rng.random() > 0.03 else 9 for i in range(n - a)]
            # without a least length the automaton alone must find every run
            assert sorted((s, t - s + 1, p) for (s, p), t in periodic.runs_of(words).items()) == sorted(brute_runs(words, 2))
            assert periodic.runs_by_document([[7, 7], words, words], 12)[1:] == [brute_runs(words)] * 2


def test_segments_are_last_occurrences():
    rng = random.Random(0)
    w = [rng.randrange(3) for _ in range(60)]
    link, length, end = periodic.automaton(w)
    tree = periodic.LastOccurrence(link, length)
    for i, state in enumerate(end):
        want = {}
        for n in range(1, i + 2):
            old = [e for e in range(n - 1, i) if w[e - n + 1:e + 1] == w[i - n + 1:i + 1]]
            if old:
                want[max(old)] = n
        assert sorted(tree.access(state, i)) == sorted(want.items())


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((by_contract(r.doc_id, r.text) for r in docs), key=str)
    assert got(queries.op11_periodic_runs(spark, SF)) == want
    assert sum(r[1] > 0 for r in want) >= 10 and any(r[1] == 0 for r in want)


def test_odd_rows(spark):
    rng = random.Random(5)
    line = " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(40)) for _ in range(9))
    texts = [line * 3, " ".join([line] * 3), "\n".join([line] * 5) + " end", "x " * 30_000, "", None, " \t\n", "a" * 50_000, "one", "a b " * 6, "a b " * 5 + "a",
             "é ñ o ü " * 12, " ".join(str(rng.randrange(3)) for _ in range(3000)), (line + " x ") * 2 + line, "a\x0bb\x0cc\rd " * 9]
    rows = [(i, t, "r", "s", "n") for i, t in enumerate(texts)] + [(2, texts[2], "r", "s", "n"), (None, texts[1], None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = sorted((brute_row(r[0], split(r[1])) for r in rows), key=str)
    assert got(periodic.report(df)) == want
    assert periodic.report(df.limit(0)).count() == 0
    kept = {r.doc_id: r for r in periodic.find_runs(df).where(F.col("doc_id") == 2).collect()}[2]
    assert [tuple(x) for x in kept.runs] == [(0, 45, 9)] and kept.text == line + " end" and kept.n_words == 46

"""Groups that are closed block by block, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rankforge.llm import components, embeddings, minhash
from rankforge.llm.common import Scratch


def link_by(near):
    """Edges of a spanning forest of one block, members given by number."""
    def link(table: pa.Table) -> pa.Table:
        ids = np.unique(table.column("member").to_numpy())
        edges = components.forest(len(ids), lambda i, others: near(ids[i], ids[others]))
        at = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table({"u": ids[at[:, 0]], "v": ids[at[:, 1]]})

    return link


def closed(n, near):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if near(i, np.array([j]))[0]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


CASES = {
    "all": lambda i, o: np.ones(len(o), bool),
    "none": lambda i, o: np.zeros(len(o), bool),
    "chain": lambda i, o: np.abs(o - i) == 1,
    "two": lambda i, o: (o % 2 == i % 2),
    "few outside": lambda i, o: np.where((o < 6) | (i < 6), np.abs(o - i) == 90, True),
}


@pytest.mark.parametrize("case", CASES)
def test_close_groups_equals_brute_force(spark, case):
    near = CASES[case]
    rows = spark.createDataFrame([(k, i, 120) for k in (7,) for i in range(120)] + [(8, 500, 2), (8, 501, 2)],
                                 "key long, member long, n long")
    got = {r["node"]: r["component"] for r in components.close_groups(
        rows, 120, rows.select("member").distinct(), "key", "member", 10, link_by(near), Scratch(spark), "t").collect()}
    want = closed(120, near)
    assert [got.get(i, i) for i in range(120)] == want
    assert got.get(501, 501) == (500 if near(501, np.array([500]))[0] else 501)


@pytest.mark.parametrize("n", [2_000, 20_000])
def test_dealt_rows_grow_with_the_group(spark, n):
    rows = spark.range(n).selectExpr("id AS member", "1L AS key", f"{n}L AS n")
    dealt = components.deal(rows, "member", 100)
    sizes = [r["count"] for r in dealt.groupBy("key", "lo", "hi").count().collect()]
    assert sum(sizes) <= n + 3 * components.PIVOTS * n / 100 and max(sizes) <= 200


def test_one_large_family_of_near_copies(spark):
    """Distinct near copies of one text, and a few that only some members link with."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(300)]
    texts = []
    for k in range(150):
        w = list(base)
        for _ in range(2 if k % 25 else 6):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i:i + 5]) for i in range(296)} for t in texts]
    want = closed(150, lambda i, o: np.array([100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]) for j in o]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.link(docs, block=12).collect()}
    assert [got[i] for i in range(150)] == want and 1 < len(set(want)) < 150


def test_a_set_that_most_documents_share(spark):
    docs = spark.createDataFrame([(i, "one two three four five six") for i in range(3000)] +
                                 [(3000 + i, "" if i % 2 else None) for i in range(3000)], "doc_id long, text string")
    rows = minhash.link(docs).collect()
    assert len(rows) == 6000
    assert all(r["component_id"] == (0 if r["doc_id"] < 3000 else r["doc_id"]) for r in rows)
    assert sum(r["kept"] for r in rows) == 3001


def test_a_vector_that_most_rows_share(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1) for i in range(3000)] + [(3000 + i, None, 1) for i in range(2000)]
    rows += [(6000, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0, 3.0], 1)]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is not None and r["vec_id"] < 3000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (3000, 0, r["vec_id"] == 0)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)

"""Alignment of two tokenizers against a plain reading of the contract."""

import collections
import hashlib
import random

import numpy as np
import pytest

from rankforge.llm import alignment, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, part int, chunk long, n_a string, info string"


@pytest.fixture(scope="module")
def plain():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def byte_table():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(others)}


def brute(rows, plain):
    tok, sp = plain
    table = byte_table()
    groups = []
    for _, text in rows:
        data = b" " + (text or "").encode()
        enc = tok.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(table[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = []
        for i in sp.encode(text or ""):
            p = sp.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        out, ga, gb, ea, eb = [], [], [], 0, 0
        if text and b"".join(x for _, x in a) == data == b"".join(x for _, x in b):
            ia, ib = iter(a), iter(b)
            while ea < len(data) or eb < len(data):
                if ea <= eb:
                    i, x = next(ia)
                    ga.append(i)
                    ea += len(x)
                else:
                    i, x = next(ib)
                    gb.append(i)
                    eb += len(x)
                if ea == eb:
                    out.append((ga, gb))
                    ga, gb = [], []
        groups.append(out)
    count = collections.Counter(p for g in groups for p in {(i, j) for x, y in g for i in x for j in y})
    top = collections.defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    res = []
    for (doc_id, _), g in zip(rows, groups):
        links = [(i, j) for x, y in g for i in x for j in y]
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        res.append((doc_id, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(count[p] == top[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(line.encode()).hexdigest() if g else ""))
    return sorted(res, key=str), count, top


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def aligned(df):
    import public_tokenizers as P

    return alignment.Alignment(df, **queries.tokenizer_files(), piece_path=P.path("piece_bpe_32k.model"))


def test_whole_table(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_alignment(spark, SF)) == brute(rows, plain)[0]


def test_odd_rows_and_the_pair_table(spark, plain):
    rng = random.Random(1)
    texts = ["hello world", "hello world", "", None, " ", "  two  spaces ", "a" * 30_000, "<|endoftext|> and <s> or </s> <unk> <0x41>", "naïve café ▁ under",
             "ﬁ ligature ½", "日本語のテキスト 🙂🙂", "\x00\x01 control\n\n\ttabs", "x y " * 8000, "é combining", " no-break", "word " + "é" * 5000]
    texts += [" ".join("".join(rng.choice("aeilnrst") for _ in range(rng.randrange(1, 9))) for _ in range(60)) for _ in range(30)]
    rows = list(enumerate(texts)) + [(0, "hello world"), (None, "hello"), (None, None)]
    df = spark.createDataFrame([(i, t, 7, 9, "n", "i") for i, t in rows], SCHEMA).repartition(4)
    want, count, top = brute(rows, plain)
    made = aligned(df)
    assert got(made.documents()) == want
    assert got(made.pairs()) == sorted(((i, j, n, n == top[i]) for (i, j), n in count.items()), key=str)
    assert sum(r[4] for r in want) > 10_000


def test_small_shares_and_many_runs(monkeypatch):
    """Cascaded merges, links in shares and sums in a chunk lose nothing."""
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    rng = random.Random(2)
    runs = [np.unique([rng.randrange(500) for _ in range(rng.randrange(1, 300))]) for _ in range(11)]
    batch = [(0, alignment.packed(r, True), alignment.packed(r % 7 + 1)) for r in runs]
    import pyarrow as pa

    merged = list(alignment.merge_by_part([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*batch)], names=["part", "pairs", "counts"])]))
    want = collections.Counter()
    for r in runs:
        for x in r.tolist():
            want[x] += x % 7 + 1
    keys, sums = alignment.unpacked(merged[0].column(1)[0].as_py(), True), alignment.unpacked(merged[0].column(2)[0].as_py())
    assert len(merged) == 1 and dict(zip(keys.tolist(), sums.tolist())) == dict(want)
    two = alignment.TwoTokenizers(**queries.tokenizer_files(), piece_path=__import__("public_tokenizers").path("piece_bpe_32k.model"))
    text = "some words of text " * 40
    pieces = alignment.Aligned(two, *two.encode([text, "", "b " * 30]))
    whole = [np.concatenate(x) for x in zip(*pieces.links(1 << 30))]
    cut = [np.concatenate(x) for x in zip(*pieces.links(3))]
    assert all((x == y).all() for x, y in zip(whole, cut)) and len(whole[0]) == pieces.n_links.sum()
    made = []
    for most in (1 << 22, 50):  # at 50 links a document comes in many shares
        monkeypatch.setattr(alignment, "CHUNK_LINKS", most)
        chunk = alignment.Chunk(two)
        for at_a, at_b in pieces.links(7):
            chunk.add(pieces.a[at_a], pieces.b[at_b], pieces.document_a[at_a])
        made.append(list(chunk.runs()))
    assert made[0] == made[1]


def test_salts_do_not_change_rows(spark, plain):
    rows = [(i, f"document number {i} shares words with {i % 5}") for i in range(40)]
    made = aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(9))
    made.salts = 5
    made.counts = alignment.counted(made.runs, 5)
    assert got(made.documents()) == brute(rows, plain)[0]


def test_empty(spark):
    made = aligned(spark.createDataFrame([], SCHEMA))
    assert made.documents().count() == 0 and made.pairs().count() == 0


def test_packed_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 200, 60_000, 1 << 31, 1 << 40):
        x = np.sort(rng.integers(0, top, 1000)).astype(np.uint64)
        assert (alignment.unpacked(alignment.packed(x)) == x).all() and (alignment.unpacked(alignment.packed(x, True), True) == x).all()
    assert len(alignment.unpacked(alignment.packed(np.zeros(0, np.uint64)))) == 0

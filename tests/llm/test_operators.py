"""The training-data operators against brute force, and on odd input."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankforge.llm import decontam, embeddings, langid, minhash, packing, pii, quality, queries, sharding, suffix, toxicity
from rankforge.llm.common import sample_by_hash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, `_row` string"
WORDS = [f"{a}{b}" for a in ("tho", "ren", "ash", "il") for b in ("ka", "mo", "ti", "ur", "el")]


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties
    and extra columns whose names clash with internal ones."""
    base = words(120, 1)
    texts = [base, base, base.replace(" ", "  ") + " x1", words(80, 2), "", None, "one two", "one two", words(20_000, 3), "a" * 60_000]
    rows = [(i, t, "en", "s", len(t or ""), "c", "r") for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s", 1, "c", "r"), (None, base, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(n), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# ------------------------------------------------------------- 1 packing
def test_packing_round_trip(odd, none):
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    tok = Tokenizer.from_file(files["json_path"])
    tok.encode_special_tokens = True
    import zlib

    rows = packing.pack(odd, **files).toPandas()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    for doc_id, part in rows[rows.doc_id.notna() & (rows.doc_id != 3)].groupby("doc_id"):
        ids = np.array([*tok.encode(text[int(doc_id)] or "", add_special_tokens=False).ids, 0], "<u4")
        part = part.sort_values("piece")
        assert part.length.sum() == len(ids) and (part.length.iloc[1:] == 2048).all()
        for r in part.itertuples():
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    rows = rows.sort_values(["sequence_id", "offset"])
    within = rows.groupby("sequence_id").length
    assert (within.cumsum() - rows.length == rows.offset).all() and within.sum().max() <= 2048
    assert packing.pack(none, **files).count() == 0


def test_packing_ids_equal_the_plain_tokenizer():
    from tokenizers import Tokenizer

    files = queries.tokenizer_files()
    plain, bpe = Tokenizer.from_file(files["json_path"]), packing.ByteBpe(**files)
    literal = "<|endoftext|>"
    assert plain.token_to_id(literal) in plain.encode(literal, add_special_tokens=False).ids
    for text in (literal, f"one{literal} two {literal}", f"{'a' * 9000} {literal}x", "<|endoftext", words(50, 7), "b" * 9000):
        assert bpe.ids(text) == plain.encode(text, add_special_tokens=False).ids


def test_packing_plan_is_tight():
    rng = np.random.default_rng(0)
    for capacity, n in ((50, 400), (2048, 5000), (7, 30)):
        hist = collections.Counter(rng.integers(1, capacity + 1, n).tolist())
        made = collections.Counter()
        bins = 0
        for count, items in packing.plan(hist, capacity):
            assert sum(length * k for length, k in items) <= capacity
            bins += count
            for length, k in items:
                made[length] += count * k
        assert made == hist
        best_fit = sum(count for count, _ in packing.best_fit(hist, capacity))
        assert bins <= 1.02 * best_fit + 1


# ------------------------------------------------------------- 2 embeddings
def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vecs = [(centres[i % 12] + rng.normal(size=16) * (0.03 if i % 3 else 0.4)).tolist() for i in range(300)]
    rows = [(i, v, i % 2) for i, v in enumerate(vecs)] + [(900 + i, vecs[0], 0) for i in range(5)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] + [1.0] * 15, 0),
             (1004, vecs[0], None), (1005, [None] * 16, 0), (1006, [], 0), (1007, [1.0] * 8, 0), (1008, [1e200] * 16, 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    for block in (2000, 20):
        got = {r["vec_id"]: r for r in embeddings.link(table, block=block).collect()}
        usable = [r for r in rows if r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
        unit = [embeddings.unit_rows(np.array([r[1]]))[0] for r in usable]

        def near(i, j):
            return usable[i][2] == usable[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98

        part = closure(len(usable), near)
        want = {r[0]: sum(near(i, j) for j in range(len(usable)) if j != i) for i, r in enumerate(usable)}
        assert sum(got[k]["n_links"] for k in want) >= 0.9 * sum(want.values())
        assert all(got[k]["n_links"] <= n for k, n in want.items())
        exact = sum(got[r[0]]["component_id"] == usable[part[i]][0] for i, r in enumerate(usable))
        assert exact >= 0.9 * len(usable)
        for k in (1000, 1001, 1002, 1003, 1004, 1005, 1006):
            assert got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"]
    assert embeddings.link(table.limit(0)).count() == 0


def test_embeddings_with_a_common_direction(spark):
    rng = np.random.default_rng(8)
    common = np.zeros(32)
    common[0] = 3.0  # square norm of the mean about 0.9

    def pair():
        """Two vectors at cosine 0.98 to 0.985."""
        a = common + rng.normal(size=32) / np.sqrt(32)
        step = rng.normal(size=32)
        lo, hi = 0.0, 3.0
        for _ in range(40):
            mid = (lo + hi) / 2
            x, y = embeddings.unit_rows(np.array([a, a + mid * step]))
            lo, hi = (mid, hi) if x @ y > 0.981 else (lo, mid)
        return a, a + lo * step

    vecs = embeddings.unit_rows(np.array([v for _ in range(1500) for v in pair()]))
    assert (vecs.mean(axis=0) ** 2).sum() > 0.8
    near = vecs @ vecs.T >= 0.98
    want = near.sum(axis=1) - 1
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.link(table).collect()}
    recall = sum(got.values()) / want.sum()
    assert 1 >= recall >= 0.99, recall


# ------------------------------------------------------------- 3 language id
def test_language_id(spark, odd, none):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.95 and got.score.between(0, 1).all()
    model = langid.fit(docs)
    rows = langid.predict(odd, model, ["doc_id", "component_id"]).collect()
    assert len(rows) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"] for r in rows if r["doc_id"] in (4, 5))
    assert langid.fit(none) is None and langid.predict(none, None, ["doc_id"]).count() == 0


# ------------------------------------------------------------- 4 repeated strings
def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i:i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        hit = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i:i + length] = True
        out.append((len(t), int(hit.sum()), len(suffix._mask_ranges(hit)[0]), hashlib.sha256(np.frombuffer(t, np.uint8)[~hit].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("most_classes, length", [(1500, 100), (2, 100), (1, 100), (1, 300), (1, 20)])
def test_repeats_equal_brute_force(spark, most_classes, length):
    shared = words(60, 9)
    texts = [words(70, i) + " " + shared[i:] + " " + words(30, 100 + i) for i in range(12)] + [None, "", "é" * 300, words(70, 0), shared * 3, "ab" * 700]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, copies string")
    got = sorted(tuple(r) for r in suffix.remove_repeats(docs, length, most_classes).collect())
    assert got == [(i, *x) for i, x in enumerate(brute_repeats(texts, length))]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


def test_two_stage_order():
    rng = np.random.default_rng(1)
    for letters, n in itertools.product((1, 2, 4, 255), (0, 1, 2, 60, 500)):
        data = rng.integers(0, letters, n).astype(np.uint8)
        raw = data.tobytes()
        assert suffix.suffix_order(data, 10 ** 6).tolist() == sorted(range(n), key=lambda i: raw[i:])


# ------------------------------------------------------------- 5 decontamination
def test_decontamination_equals_brute_force(spark, none):
    items = [words(n, 50 + n) for n in (30, 12, 7, 3)] + [None, ""]
    edited = items[0].split()
    edited[10] = "changed"
    texts = [words(40, 1) + " " + items[0] + " " + words(10, 2), items[0].upper(), " ".join(edited), items[1] + "\n" + items[2], words(60, 5),
             None, "", items[3], "x " + items[3] + " y", " ".join(items[0].split()[:28]), items[2] * 1 + " " + items[2]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, items[0], 1)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def bag(w):
        return collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])

    want = {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for k, item in enumerate(items):
            b = (item or "").lower().split()
            if b and w:
                best = 0
                for s in range(max(len(w) - len(b), 0) + 1):
                    x, y = bag(w[s:s + len(b)]), bag(b)
                    best = max(best, sum((x & y).values()) / sum((x | y).values()))
                if best >= 0.8:
                    want[d, k] = best
    rows = decontam.contaminated(docs, bench).collect()
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in rows if r["doc_id"] is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert any(r["doc_id"] is None for r in rows)
    left = {r["doc_id"] for r in decontam.clean(docs, bench).collect()}
    assert left == {d for d in range(len(texts))} - {d for d, _ in want}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()


def test_decontamination_finds_windows_with_an_often_repeated_shingle(spark):
    """Items of 130 different words with one word 14 times behind them; the
    documents have another word there: similarity 0.818, weights decide."""
    rng = random.Random(8)
    bench, docs = [], []
    for i in range(200):
        head = [f"w{rng.randrange(10 ** 6)}" for _ in range(130)]
        bench.append((i, " ".join(head + ["tick"] * 14)))
        docs.append((i, " ".join([words(20, i), *head, *["tock"] * 14, words(20, 500 + i)])))
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in found.collect()}
    assert set(got) == {(i, i) for i in range(200)} and all(0.8 <= x < 0.83 for x in got.values())


def test_decontamination_very_long_and_repeated_rows(spark):
    item = words(60, 77)
    texts = [words(30_000, 78) + " " + item + " " + words(30_000, 79), item, item, "la " * 3_000 + item]
    docs = spark.createDataFrame([(min(i, 1), t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, item_id string, need string")
    bench = spark.createDataFrame([(5, item), (6, "la " * 40), (7, None), (8, "")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(docs, bench).collect())
    assert found == [(0, 5, 1.0), (1, 5, 1.0), (1, 5, 1.0), (1, 5, 1.0), (1, 6, 1.0)]


# ------------------------------------------------------------- 6 sharding
def test_sharding(odd, none):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    count = np.bincount(table)
    assert len(table) == 1009 and count.max() - count.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    stay = table != 6
    assert (table[stay] == fewer[stay]).mean() > 0.7
    rows = sharding.assign(odd, "doc_id", shards, 1009).collect()
    assert len(rows) == odd.count() and all(r["shard"] == shards[table[r["slot"]]] for r in rows)
    assert sharding.assign(none, "doc_id", shards, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)
    with pytest.raises(ValueError, match="a column shard, slot already"):
        sharding.assign(odd.withColumn("Slot", F.lit(1)).withColumn("shard", F.lit("x")), "doc_id", shards, 1009)
    named = sharding.assign(odd.withColumn("slot", F.lit(1)), "doc_id", shards, 1009, slot_col="place", shard_col="owner")
    assert [c for c in named.columns if c in ("slot", "place", "owner")] == ["slot", "place", "owner"]


def test_sharding_table_and_slots_by_their_definition(odd):
    """Turns and preference orders written out; slots from the md5 of the id."""
    names, size = ["a", "b", "c"], 31
    want, turn, given = [None] * size, 0, {}
    orders = {}
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        orders[n] = [(first + i * step) % size for i in range(size)]
    while None in want:
        n = names[turn % 3]
        free = next(x for x in orders[n] if want[x] is None)
        want[free], turn = n, turn + 1
    assert [names[i] for i in sharding.lookup_table(names, size)] == want
    for r in sharding.assign(odd.select("doc_id"), "doc_id", names, size).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % size
        assert (r.slot, r.shard) == (slot, want[slot])


# ------------------------------------------------------------- 7 PII
def luhn(d):
    return sum(v if i % 2 == 0 else (2 * v - 9 if 2 * v > 9 else 2 * v) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_spans(t):
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    for kind, p in patterns:
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if not (kind == "ip" and any(int(x) > 255 for x in m.group().split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d))
                    or kind == "phone" and not 8 <= len(d) <= 15):
                yield f"{kind}:{m.start()}:{m.end()}"


def test_pii_base_spans_equal_the_patterns(spark, odd, none):
    texts = ["", None, "a@b.c+d@e.f x@y z a@b..c@d.e.f a.b@c.d.", "1.2.3.4.5.6.7.8 999.1.1.1 1..2.3.4.5 0000255.1.2.3",
             "4111 1111 1111 1111 4111-1111-1111-1111-2 12 3", "+1 (208) 555-1177 4284896609045836 +1(((( +12 +1 2345678",
             "é 4111111111111111é a@b.co é+44 20 7946 0958.", "x" * 3000 + "@" + "y.z" * 2000, "1" * 5000, "+1" * 2000, "a@" + "b." * 4000 + "c"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    for r in pii.report(docs).collect():
        want = list(brute_spans(texts[r["doc_id"]] or ""))
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert sum(r[f"n_{k}"] for k in pii.KINDS[:4]) == len(want) and r["spans"].startswith(",".join(want))
    assert pii.report(odd).count() == odd.count() and pii.report(none).count() == 0
    masked = pii.mask(docs.withColumn("n_chars", F.length("text"))).where("doc_id = 6").first()
    assert masked["text"] == "é [CARD]é [EMAIL] é[PHONE]." and masked["n_chars"] == len(masked["text"])


def test_pii_contexts_find_unseen_identifiers(spark):
    texts = [f"please write to user{i}.{i:02d}@mail.com today" for i in range(30)] + ["please write to AB12-7734-XY today", "room 1234567 is free"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    patterns = pii.learn(docs)
    assert patterns == ["to"]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    at = texts[30].index("AB12")
    assert spans[30] == f"context:{at}:{at + 12}" and spans[31] == ""


def test_pii_uses_every_accepted_context(spark):
    names = [f"{a}{b}{c}" for a in "bdfg" for b in ("ar", "el", "in", "os", "um") for c in ("ka", "lo", "mi", "nu", "pe", "ra", "si", "to", "vu", "wy", "za", "qi", "xo")]
    texts = [f"{name} u{k}.{i:02d}@mail.com" for k, name in enumerate(names) for i in range(10)] + [f"x {name}: AB12-77{k:03d}-XY" for k, name in enumerate(names)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(names) == 260 and len(pii.learn(docs)) == 260
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    for i, t in enumerate(texts[2600:], 2600):
        assert spans[i] == f"context:{t.index('AB12')}:{len(t)}"


def test_pii_bootstrap_spreads_from_all_kinds(spark):
    ids = [f"QX-{1000 + 37 * i}-Z{i}" for i in range(40)]
    cards = [d for d in (str(4111_0000_0000_0000 + 7 * i) for i in range(400)) if luhn(d)][:20]
    texts = [f"dial +44 20 7946 {i:04d}" for i in range(30)] + ["paid " + " ".join(c[j:j + 4] for j in (0, 4, 8, 12)) for c in cards]
    texts += [f"mailto {''.join(chr(97 + int(d)) for d in str(1000 + i))}@mail.com" for i in range(30)]
    texts += ["dial AB12-3456", "paid AB12-3457"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert set(pii.learn(docs)) >= {"dial", "paid", "mailto"}
    few = spark.createDataFrame([(k, f"member {x}") for k, x in enumerate(ids)] + [(100 + k, f"mailto {x}") for k, x in enumerate(ids)]
                                + [(1000 + i, f"mailto {''.join(chr(97 + int(d)) for d in str(1000 + i))}@mail.com") for i in range(400)],
                                "doc_id long, text string")
    assert set(pii.learn(few)) == {"mailto", "member"}
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    n = len(texts)
    assert spans[n - 2] == "context:5:14" and spans[n - 1] == "context:5:14"
    found = {r["doc_id"]: r["spans"] for r in pii.report(few).collect()}
    assert all(found[k] == f"context:7:{7 + len(x)}" for k, x in enumerate(ids))


# ------------------------------------------------------------- 8 and 10 classifiers
def test_samples_with_hot_keys_stay_bounded_and_keep_every_stratum(spark):
    rows = spark.range(60000).selectExpr("IF(id < 50000, IF(id < 20000, 7, NULL), id) AS doc_id",
                                         "IF(id < 50000, 'hot', CONCAT('s', id % 40)) AS stratum")
    got = sample_by_hash(rows, "stratum", 50)
    sizes = {r["stratum"]: r["count"] for r in got.groupBy("stratum").count().collect()}
    assert got.columns == rows.columns and max(sizes.values()) <= 100
    assert all(20 <= sizes[f"s{k}"] for k in range(40))
    again = sample_by_hash(rows.repartition(7), "stratum", 50).collect()
    assert sorted(got.collect(), key=str) == sorted(again, key=str)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_samples_take_one_row_of_a_repeated_id(spark, module):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    labels = labels.withColumn("toxic", F.pmod("doc_id", F.lit(2)))
    once, often = module.fit(docs, labels, per_class=30), module.fit(docs.union(docs).union(docs), labels, per_class=30)
    assert (once is None) == (often is None)
    if module is toxicity:  # nothing but the sample is learned from
        want, got = ({r["doc_id"]: r["score"] for r in module.score(docs, m).collect()} for m in (once, often))
        assert want == pytest.approx(got)


@pytest.mark.parametrize("module, target", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, odd, none, module, target):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = module.fit(docs, labels)
    got = module.score(docs, model).where("held_out").join(labels, "doc_id").toPandas()
    truth = got[target] > 0
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    ranks = got.score.rank()
    auc = (ranks[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())
    assert auc >= 0.85
    rows = module.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert module.fit(docs, labels.limit(0)) is None and module.score(none, None).count() == 0


def test_quality_co_trains_on_all_unlabelled_rows(spark):
    rng = np.random.default_rng(2)
    n = 9000

    def rows_of(n):
        truth = rng.random(n) < 0.4
        return truth, rng.normal(size=(n, 3)) + truth[:, None], rng.normal(size=(n, 2)) + 1.5 * truth[:, None]

    y, text, meta = rows_of(4000)
    _, more_text, more_meta = rows_of(n)
    u = rng.random(n)
    rows = spark.createDataFrame([(i, float(u[i]), more_text[i].tolist(), more_meta[i].tolist()) for i in range(n)],
                                 "doc_id long, u double, text array<double>, meta array<double>").persist()
    models, history = quality.co_train(text, meta, y.astype(float), rows)
    labels = quality.taught(history, (more_text, more_meta), u)
    for v, (own, more) in enumerate(((text, more_text), (meta, more_meta))):
        got = labels[v] >= 0
        assert 0.95 * 5 * 450 <= got.sum() <= 1.05 * 5 * 450
        assert abs(labels[v][got].mean() - y.mean()) < 0.03
        want = quality.Logistic().fit(np.r_[own, more[got]], np.r_[y, labels[v][got]])
        assert np.allclose(models[v].w, want.w, atol=1e-5) and np.allclose(models[v].scale, want.scale)


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    fit = toxicity.Isotonic().fit(x, (rng.random(500) < 1 / (1 + np.exp(-x))).astype(float))
    y = fit(np.sort(x))
    assert (np.diff(y) >= 0).all() and 0 <= y[0] and y[-1] <= 1


# ------------------------------------------------------------- 9 MinHash
@pytest.mark.parametrize("block", [1500, 4])
def test_minhash_equals_brute_force(spark, odd, none, block):
    rng = random.Random(3)
    texts = []
    for k in range(8):
        base = words(100, 200 + k).split()
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    part = closure(len(texts), lambda i, j: 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, band string")
    got = {r["doc_id"]: r for r in minhash.link(docs, block=block).collect()}
    assert all(got[i]["component_id"] == part[i] and got[i]["n_shingles"] == len(sets[i]) for i in range(len(texts)))
    if block == 4:
        return
    rows = minhash.link(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["component_id"] == 0 and by[7]["component_id"] == 6 and by[4]["component_id"] == 4 and by[5]["kept"]
    assert by[None]["component_id"] is None and by[None]["kept"]
    kept = [r["doc_id"] for r in minhash.dedup(odd).collect()]
    assert sorted(x for x in kept if x is not None) == [0, 3, 4, 5, 6, 8, 9] and kept.count(None) == 1
    assert minhash.link(none).count() == 0 and minhash.dedup(none).count() == 0


def test_minhash_stage_drops_copies_at_80(spark):
    import corpus_pipeline as cp

    assert minhash.layout(85)[:2] == (24, 6) and minhash.layout(80)[:2] == (29, 5)
    for t in (50, 80, 85, 95):
        bands, rows, slack = minhash.layout(t)
        assert (1 - (t / 100) ** rows) ** bands <= minhash.MISS and slack >= 5 * (t / 100 * (1 - t / 100) / bands / rows) ** 0.5
    texts = []
    for k in range(30):  # two words in the middle: 86 of 106 shingles
        base = words(100, 900 + k).split()
        texts += [" ".join(base), " ".join([*base[:30], "edit", *base[31:70], "edit", *base[71:]])]
    sets = [shingle_set(t) for t in texts]
    near = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(texts), 2)]
    assert all(0.8 <= x < 0.85 for x in near)
    part = closure(len(texts), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in cp.near_duplicates(spark, docs, SF).collect()) == sorted(set(part))
    assert len(set(minhash.link(docs, 85).toPandas().component_id)) == len(texts)


# ------------------------------------------------------------- SQL and pipeline
def test_decontamination_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op5_decontamination"]).fetchall())
    assert want and want == sorted(tuple(r) for r in queries.op5_decontamination(spark, SF).collect())


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now, sizes = docs, []
    for name, stage in cp.STAGES:
        now = stage(spark, now, SF).persist()
        sizes.append((name, now.count()))
        if name != "pack":
            assert now.columns == docs.columns
    counts = dict(sizes)
    assert counts["language_id"] >= 0.99 * docs.count()
    text = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    sets = [shingle_set(t) for _, t in text]
    part = closure(len(text), lambda i, j: sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert counts["minhash"] == len(set(part))
    assert counts["minhash"] >= counts["decontaminate"] == counts["pii"] > 0 and now.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_with_odd_rows_and_clashing_columns(spark, odd):
    """Nulls, empty, very long and repeated rows, and extra columns with the
    names that the stages use: the same documents stay as without them."""
    import corpus_pipeline as cp

    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id >= 100").select("doc_id", "text", "lang", "source", "n_chars")
    plain = real.unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars")).persist()
    taken = ["score", "rejected", "lang_pred", "held_out", "slot", "shard", "set_id", "component_id", "row", "text_key", "grams", "similarity", "item_id", "kept"]
    clash = plain.select("*", *[F.lit("own").alias(c) for c in taken])
    kept = {}
    for name, docs in (("plain", plain), ("clash", clash)):
        columns = docs.columns
        for stage, function in cp.STAGES:
            docs = function(spark, docs, SF).persist()
            if stage != "pack":
                assert docs.columns == columns and (name == "plain" or docs.where("score <> 'own' OR shard <> 'own'").count() == 0)
                kept[name, stage] = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    for stage, _ in cp.STAGES[:-1]:
        assert kept["plain", stage] == kept["clash", stage] and kept["plain", stage]
    assert not any(t in (None, "") for _, t in kept["plain", "language_id"])
    empty = clash.limit(0)
    for _, function in cp.STAGES:
        empty = function(spark, empty, SF)
        assert empty.count() == 0


def test_language_id_output_names(spark, odd):
    with pytest.raises(ValueError, match="a column score already"):
        langid.predict(odd.withColumn("Score", F.lit(1)), None, ["doc_id", "Score"])
    rows = langid.predict(odd.withColumn("score", F.lit(7)), None, ["doc_id", "score"], ("a", "b", "c")).collect()
    assert {(r.score, r.a, r.b, r.c) for r in rows} == {(7, "und", 0.0, True)}


def test_language_id_equals_its_model_by_hand(spark, odd):
    """The packed application equals averaging each text's n-gram rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs, per_language=40)
    got = {r.doc_id: r for r in langid.predict(docs.limit(40).unionByName(odd.select(docs.columns).where("doc_id IS NULL")), model, ["doc_id", "text"]).collect()}
    for r in got.values():
        data = langid.LETTERS[np.frombuffer(r.text.lower().encode() + b" ", np.uint8)]
        grams = np.concatenate([langid.buckets(data, n)[:max(len(data) - n, 0)] for n in langid.ORDERS])
        p = model.probabilities(model.logits[grams].sum(axis=0, dtype=np.float64)[None], np.array([len(grams)]))[0]
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-6
    few = langid.fit(docs, per_language=20, most_languages=2)
    assert len(few.languages) == 2

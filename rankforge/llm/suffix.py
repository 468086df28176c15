"""Removal of repeated byte strings by two-stage suffix sorting.

A byte goes if a ``length``-byte string that covers it also starts anywhere
else in the corpus. The sorting is dealt out so that equal strings meet:

1. Anchors. Every ``length``-byte string belongs to one anchor: the leftmost
   smallest hash among its ``gram``-byte substrings. Equal strings have equal
   anchors, so strings need only be compared within an anchor group. Each text
   is scanned once; an anchor covers a range of string starts.
2. Classes. Anchor ranges with the same bytes are one class with a count,
   summed before they are shuffled. In a class that occurs twice all strings
   repeat; a class that is alone in its group repeats nowhere else.
3. Suffix arrays. The bytes of the classes of a group that has several are
   concatenated (many small groups together, about ``SORT_BYTES``): suffixes
   smaller than their successors are sorted directly, the others are induced
   by scanning the buckets of first bytes; adjacent common prefixes of
   ``length`` bytes are repeats.
4. A group with more than ``most_classes`` classes is too hot for one task.
   Its strings are spread by 128-bit fingerprints and counted instead, first
   in blocks of neighbouring starts and singly only at the edges of what
   repeats; the counts are summed before the shuffle.

Odd input: null or short text loses nothing (null counts as empty); repeated
rows are copies and so lose everything if long enough; an empty table gives an
empty result; extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch

GRAM = 64
MOST_CLASSES = 1500
SORT_BYTES = 1 << 19
CHUNK = 1 << 19  # string starts that are scanned at once
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ------------------------------------------------------------- suffix array
def suffix_order(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` in the order of their suffixes (first ``depth``
    bytes). Directly sorts the suffixes smaller than their successors only."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    turn = np.flatnonzero(data[1:] != data[:-1])  # last positions of runs
    following = np.searchsorted(turn, np.arange(n))
    small = np.zeros(n, bool)  # smaller than its successor
    inside = following < len(turn)
    at = turn[following[inside]]
    small[inside] = data[at] < data[at + 1]
    raw = data.tobytes()
    direct = np.flatnonzero(small)
    ordered = np.array(sorted(direct.tolist(), key=lambda i: raw[i:i + depth]), np.int64)
    cuts = np.searchsorted(data[ordered], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[data[-1]].append(np.array([n - 1]))  # the last suffix precedes the empty one in no order but its own
    out = []

    def induced(of: np.ndarray) -> np.ndarray:
        before = of[of > 0] - 1
        return before[~small[before]]

    for byte in range(256):
        bucket, front = [], np.concatenate(queues[byte]) if queues[byte] else np.zeros(0, np.int64)
        while len(front):
            bucket.append(front)
            front = induced(front)
            front = front[data[front] == byte]
        bucket.append(ordered[cuts[byte]:cuts[byte + 1]])
        done = np.concatenate(bucket)
        out.append(done)
        later = induced(done)
        later = later[data[later] > byte]
        if len(later):
            later = later[np.argsort(data[later], kind="stable")]
            first = data[later]
            for part in np.split(later, np.flatnonzero(first[1:] != first[:-1]) + 1):
                queues[data[part[0]]].append(part)
    return np.concatenate(out)


def repeated(data: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Mask of the valid starts whose ``length``-byte string starts at another
    valid position, too: neighbours in suffix order with a long enough common
    prefix."""
    order = suffix_order(data, length)
    order = order[valid[order]]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left, right = order[:-1], order[1:]
    same = np.arange(len(left))
    for k in (*range(0, length - 7, 8), length - 8) if length >= 8 else ():
        same = same[words[left[same] + k] == words[right[same] + k]]
    if length < 8:
        same = same[[data[a:a + length].tobytes() == data[b:b + length].tobytes() for a, b in zip(left, right)]]
    out = np.zeros(len(data), bool)
    out[left[same]] = out[right[same]] = True
    return out


# ------------------------------------------------------------- anchors
class Rolling:
    """Hashes of all substrings of one length, and of any ranges."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        base = int(rng.integers(1, 1 << 60)) * 8 + 5
        self.power = np.full(size, base, np.uint64)
        self.power[0] = 1
        self.power = np.cumprod(self.power)
        self.back = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        self.back[0] = 1
        self.back = np.cumprod(self.back)

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self.power[:len(data)])))

    def ranges(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.back[start]
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(x) - w + 1], ahead[w - 1:len(x)])


class Anchors:
    def __init__(self, length: int, gram: int = GRAM):
        self.length, self.gram = length, min(gram, length)
        size = CHUNK + 2 * length + 2
        self.pick, self.check = Rolling(21, size), Rolling(22, size)

    def of(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """(anchor hash, class digest, first start, last start) of a text."""
        found = []
        low = np.uint64((1 << 20) - 1)
        for at in range(0, len(data) - self.length + 1, CHUNK):
            part = data[at:at + CHUNK + self.length - 1]
            sums = self.pick.sums(part)
            n = len(part) - self.gram + 1
            grams = self.pick.ranges(sums, np.arange(n), np.arange(n) + self.gram)
            keyed = (grams & ~low) | np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost wins
            where = (_window_minima(keyed, self.length - self.gram + 1) & low).astype(np.int64)
            first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
            last = np.concatenate((first[1:], [len(where)])) - 1
            anchor = where[first]
            digest = self.check.ranges(self.check.sums(part), first, last + self.length)
            digest = digest * np.uint64(0x9E3779B97F4A7C15) + ((anchor - first) * 4096 + last - first).astype(np.uint64)
            found.append((grams[anchor].view(np.int64), digest.view(np.int64), first + at, last + at))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(np.zeros(0, np.int64) for _ in range(4))


# ------------------------------------------------------------- tasks
SCAN = ("doc_id long, k1 long, k2 long, n_bytes long, sha string, hashes array<long>, digests array<long>, "
        "lo array<int>, hi array<int>")


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0), kind))


def _scan(length: int):
    def run(batches):
        anchors = Anchors(length)
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            for k in range(0, len(texts), 1000):
                part, rows = texts[k:k + 1000], batch.slice(k, 1000)
                found = [anchors.of(np.frombuffer(t, np.uint8)) for t in part]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("k1"), rows.column("k2"), pa.array([len(t) for t in part], pa.int64()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in part]),
                     _lists([f[0] for f in found], pa.int64()), _lists([f[1] for f in found], pa.int64()),
                     _lists([f[2] for f in found], pa.int32()), _lists([f[3] for f in found], pa.int32())],
                    names=["doc_id", "k1", "k2", "n_bytes", "sha", "hashes", "digests", "lo", "hi"])

    return run


CLASS_BYTES = "hash long, digest long, copies long, classes long, starts int, bytes binary"


def _cut_out(length: int):
    """The bytes of the classes whose owner a text is."""
    def run(batches):
        for batch in batches:
            for text, wanted in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist()):
                rows = [(w["hash"], w["digest"], w["copies"], w["classes"], w["hi"] - w["lo"] + 1, text[w["lo"]:w["hi"] + length])
                        for w in wanted]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["hash", "digest", "copies", "classes", "starts", "bytes"])

    return run


RANGES = "hash long, digest long, first array<int>, last array<int>"


def _mask_ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _sort_groups(length: int):
    """Rows sorted by hash: whole groups together, one suffix array for about
    SORT_BYTES of them."""
    def solve(rows):
        rows = list({(r[0], r[1]): r for r in rows}.values())
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        valid, at = np.zeros(len(data), bool), 0
        for r in rows:
            valid[at:at + r[2]] = True
            at += len(r[3])
        hit, at, out = repeated(data, valid, length), 0, []
        for r in rows:
            first, last = _mask_ranges(hit[at:at + r[2]])
            at += len(r[3])
            if len(first):
                out.append((r[0], r[1], first, last))
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
             _lists([o[2] for o in out], pa.int32()), _lists([o[3] for o in out], pa.int32())],
            names=["hash", "digest", "first", "last"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("hash", "digest", "starts", "bytes")]
            for row in zip(*cols):
                if size >= SORT_BYTES and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return run


BLOCKS = (64, 8, 1)  # string starts in a block of a hot group, step by step
PARTS = "hash long, digest long, copies long, first int, last int, h1 long, h2 long, c1 long, c2 long"


def _spell_out(length: int, block: int):
    """The wanted starts of a class in blocks, numbered from the anchor. A
    block's hull holds the bytes of all its strings, its core the bytes that
    they have in common (of the whole block, also where a class has only some
    of it): equal strings lie in blocks with equal cores."""
    def run(batches):
        gram = min(GRAM, length)
        pick, one, two = (Rolling(seed, 4 * length + 2) for seed in (21, 31, 32))
        for batch in batches:
            for h, d, raw, wanted in zip(*(batch.column(c).to_pylist() for c in ("hash", "digest", "bytes", "wanted"))):
                data = np.frombuffer(raw, np.uint8)
                at = np.arange(len(data) - gram + 1)
                anchor = int(np.argmax(pick.ranges(pick.sums(data), at, at + gram).view(np.int64) == h))
                start = np.concatenate([np.arange(w["first"], w["last"] + 1) for w in wanted])
                copies = np.concatenate([np.full(w["last"] - w["first"] + 1, w["copies"]) for w in wanted])
                number = (anchor - start) // block
                head = np.flatnonzero(np.concatenate(([True], (number[1:] != number[:-1]) | (start[1:] != start[:-1] + 1))))
                first, last = start[head], start[np.concatenate((head[1:], [len(start)])) - 1]
                top = anchor - number[head] * block
                bottom = top - block + 1
                prints = [r.ranges(r.sums(data), x, y + length).view(np.int64) for x, y in ((first, last), (top, bottom)) for r in (one, two)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(head), x)) for x in (h, d)] + [pa.array(copies[head])]
                    + [pa.array(x.astype(np.int32)) for x in (first, last)] + [pa.array(x) for x in prints],
                    names=["hash", "digest", "copies", "first", "last", "h1", "h2", "c1", "c2"])

    return run


def _count_hot(cut: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """Repeated starts of the classes of hot groups that occur once: hash,
    digest, first, last. A block whose hull occurs twice repeats whole, one
    whose core occurs once repeats nowhere; blocks with equal cores in unequal
    hulls are looked at in smaller blocks, one for each hull."""
    core, hull = ["c1", "c2"], ["h1", "h2"]
    wanted = cut.select("hash", "digest", "bytes", F.array(F.struct(
        F.lit(0).alias("first"), (F.col("starts") - 1).alias("last"), "copies")).alias("wanted"))
    found = None
    for block in (b for b in BLOCKS if b == 1 or 4 * b <= length):
        parts = scratch.save(wanted.mapInArrow(_spell_out(length, block), PARTS), f"blocks-{block}")
        hulls = parts.groupBy(*core, *hull).agg(F.sum("copies").alias("copies"), F.min(F.struct("hash", "digest", "first", "last")).alias("r"))
        hulls = scratch.save(hulls, f"hulls-{block}")
        # a class that occurs twice is whole anyway: only the others ask back
        hit = (parts.where("copies = 1").join(hulls.where("copies > 1").select(*core, *hull), core + hull, "left_semi")
               .select("hash", "digest", "first", "last"))
        found = hit if found is None else found.unionByName(hit)
        several = hulls.groupBy(*core).agg(F.count("*").alias("_n")).where("_n > 1").select(*core)
        smaller = (hulls.join(several, core, "left_semi").select("r.hash", "r.digest", F.struct("r.first", "r.last", "copies").alias("w"))
                   .groupBy("hash", "digest").agg(F.sort_array(F.collect_list("w")).alias("wanted")))
        wanted = cut.select("hash", "digest", "bytes").join(smaller, ["hash", "digest"])
    return found


KEPT = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string"


def covered(n: int, spans, length: int) -> np.ndarray:
    """Mask of the bytes covered by strings that start in the (first, last) spans."""
    edge = np.zeros(n + 1, np.int64)
    for first, last in spans:
        edge[first] += 1
        edge[min(last + length, n)] -= 1
    return edge[:n].cumsum() > 0


def _apply(length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, text, first, last in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "text", "first", "last"))):
                data = np.frombuffer(text.encode(), np.uint8)
                gone = covered(len(data), zip(first, last), length)
                kept = data[~gone].tobytes()
                rows.append((k1, k2, int(gone.sum()), len(_mask_ranges(gone)[0]), hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            wide = 6 if keep_text else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(cols, kinds))[:wide]], names=names[:wide])

    return run


# ------------------------------------------------------------- operator
def remove_repeats(docs: DataFrame, length: int = 400, most_classes: int = MOST_CLASSES, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and, with
    ``keep_text``, what is left as text; cut characters are dropped there).

    Runs jobs and keeps its tables in the shared folder; the result is lazy.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(
        {"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), F.col("text"))})
    scan = scratch.save(docs.mapInArrow(_scan(length), SCAN), "scan")
    # ---- classes, counted before the shuffle
    ranges = scan.select("k1", "k2", F.explode(F.arrays_zip("hashes", "digests", "lo", "hi")).alias("a")).select(
        "k1", "k2", F.col("a.hashes").alias("hash"), F.col("a.digests").alias("digest"), F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))
    classes = ranges.groupBy("hash", "digest").agg(F.count("*").alias("copies"), F.min("k1").alias("owner"))
    groups = classes.groupBy("hash").agg(F.count("*").alias("classes"), F.sum("copies").alias("_n")).where("_n > 1").drop("_n")
    classes = scratch.save(classes.join(groups, "hash"), "classes")
    # ---- the texts that own a class to be sorted or may lose a part
    mixed = classes.where("classes > 1")
    owned = (ranges.join(mixed.withColumnRenamed("owner", "k1"), ["hash", "digest", "k1"])
             .groupBy("hash", "digest", "k1").agg(F.min(F.struct("lo", "hi")).alias("at"), F.first("copies").alias("copies"),
                                                  F.first("classes").alias("classes"))
             .select("k1", F.struct("hash", "digest", "copies", "classes", "at.lo", "at.hi").alias("w"))
             .groupBy("k1").agg(F.collect_list("w").alias("wanted")))
    first_id = scan.groupBy("k1").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("_id"))
    owned = scratch.save(owned.join(first_id, "k1"), "owned")
    texts = (docs.withColumn("_id", F.coalesce("doc_id", F.lit(-(1 << 62)))).join(owned, ["k1", "_id"])
             .select("k1", "k2", "text", "wanted"))
    texts = scratch.save(texts, "texts")
    cut = scratch.save(texts.mapInArrow(_cut_out(length), CLASS_BYTES), "bytes")
    # ---- suffix arrays; hot groups by fingerprints
    sorted_in = cut.where(F.col("classes") <= most_classes).repartition("hash").sortWithinPartitions("hash")
    hits = sorted_in.mapInArrow(_sort_groups(length), RANGES)
    hot = _count_hot(cut.where(F.col("classes") > most_classes).dropDuplicates(["hash", "digest"]), length, scratch)
    hot = hot.groupBy("hash", "digest").agg(F.collect_list(F.struct("first", "last")).alias("s")).select("hash", "digest", "s.first", "s.last")
    hits = scratch.save(hits.unionByName(hot), "hits")
    # ---- back to the texts: whole ranges of classes that occur twice, parts of the others
    whole = classes.where("copies > 1").select("hash", "digest", F.lit(None).cast("array<int>").alias("first"), F.lit(None).cast("array<int>").alias("last"))
    part = hits.join(classes.where("copies = 1").select("hash", "digest"), ["hash", "digest"], "left_semi")
    marked = ranges.join(whole.unionByName(part), ["hash", "digest"])
    spans = (marked.select("k1", "k2", F.explode(F.when(F.col("first").isNull(), F.array(F.struct("lo", "hi"))).otherwise(
                 F.transform(F.arrays_zip("first", "last"), lambda x: F.struct((F.col("lo") + x["first"]).alias("lo"), (F.col("lo") + x["last"]).alias("hi"))))).alias("s"))
             .distinct().groupBy("k1", "k2").agg(F.collect_list("s").alias("s"))
             .select("k1", "k2", F.col("s.lo").alias("first"), F.col("s.hi").alias("last")))
    spans = scratch.save(spans, "spans")
    schema = KEPT + (", kept_text string" if keep_text else "")
    lossy = scratch.save(docs.select("k1", "k2", "text").join(spans, ["k1", "k2"]).mapInArrow(_apply(length, keep_text), schema).distinct(), "lossy")
    same = F.col("n_removed").isNull()
    out = scan.select("doc_id", "k1", "k2", "n_bytes", "sha").join(lossy, ["k1", "k2"], "left")
    columns = ["doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
               F.when(same, F.col("sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    if keep_text:
        out = out.join(docs.select("k1", "k2", "text").distinct(), ["k1", "k2"])
        columns.append(F.when(same, F.col("text")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)

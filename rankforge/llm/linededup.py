"""Removal of lines that many documents share, by two Bloom filters.

A line's key is the line without white space at its ends, in lower case
(A-Z). Every scan task hashes the keys of its documents to bits. A bit that one
document has set is in the first filter (once seen), a bit that two have set is
in the second (twice seen). The filters of tasks merge: what two tasks have set
once counts twice. So each task sends its bits by segments of the filter, each
segment is merged by a task of its own, and only the second filter goes back
to the scan. A key with all of its bits twice seen is a suspected repeat; no
real repeat escapes, since all documents that hold it set the same bits.

Only suspected keys are shuffled: exact keys are grouped, those of
``at_least`` documents are confirmed and the largest id that holds one is
chosen. What is dropped comes back as a list of key digests per document, and a
last scan cuts the lines out.

The filter has ``2 ** filter_bits`` bits at every size of the input, that is
32 MiB by default, which bounds what the driver passes on. A fuller filter
suspects more lines and shuffles more; the results do not change. (Three
hundred million keys fit well; raise it with the corpus.)

Hot lines: a task sends a key once per flush with the ids that hold it, and at
most ``at_least`` ids per flush are counted, so a line of a third of all
documents is a few rows per task; these are dealt out by key and salt.

Results for odd input: null or empty text is one empty line; rows that share
an id are one document (each row is cut for itself); null ids are one document
that is smaller than any other; an empty table gives an empty result; extra
columns are ignored, whatever their names. Lines of any length are read whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch, slices

FILTER_BITS = 28
SEGMENT_BITS = 23  # bits of a segment of the filters: one task merges 2 x 1 MiB
FLUSH_KEYS = 1 << 18
READ_BYTES = 8 << 20
SALTS = 16
SPACE = b" \t\n\x0b\x0c\r"
KEYS = "key binary, salt int, ids array<long>"
CUT = "doc_id long, n_lines long, n_dropped long, text binary"


def line_key(line: bytes) -> bytes:
    """The key of a line (UTF-8): stripped, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    """True for keys of at least ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="surrogatepass")) >= least)


def digest(key: bytes) -> bytes:
    """128 bits that tell the keys of one document apart."""
    return hashlib.md5(key, usedforsecurity=False).digest()


def _documents(batches):
    """(doc_id, text as UTF-8) of every row, a bounded share decoded at once."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in texts])
        for lo, hi in slices(sizes, READ_BYTES):
            yield from zip(ids[lo:hi], (t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[lo:hi]))


def _keys(text: bytes, least: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if len(line) >= least and long_enough(k := line_key(line), least)}


def _bits(keys, filter_bits: int) -> np.ndarray:
    """The two bits of every key, as an array of two rows."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)
    mask = np.uint64((1 << filter_bits) - 1)
    return np.stack([h & mask, (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - filter_bits)) & mask])


# ------------------------------------------------------------- the two filters
def _segments(found: list[np.ndarray], segment_bits: int):
    """(segment, positions in it once or more, positions twice or more)."""
    at, n = np.unique(np.concatenate(found), return_counts=True)
    segment = (at >> np.uint64(segment_bits)).astype(np.int64)
    inner = (at & np.uint64((1 << segment_bits) - 1)).astype("<u4")
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for part, pos, cnt in zip(np.split(segment, cuts), np.split(inner, cuts), np.split(n, cuts)):
        if len(part):
            yield int(part[0]), pos, pos[cnt > 1]


def _packed(pos: np.ndarray, segment_bits: int) -> bytes:
    """Sorted positions as steps, or as a bitmap where that is shorter."""
    if len(pos) > 1 << segment_bits - 5:
        bits = np.zeros(1 << segment_bits, bool)
        bits[pos] = True
        return b"b" + zlib.compress(np.packbits(bits).tobytes(), 1)
    return b"s" + zlib.compress(np.diff(pos, prepend=np.uint32(0)).astype("<u4").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    body = zlib.decompress(data[1:])
    if data[:1] == b"b":
        return np.flatnonzero(np.unpackbits(np.frombuffer(body, np.uint8)))
    return np.cumsum(np.frombuffer(body, "<u4"), dtype=np.int64)


def twice_seen(docs: DataFrame, least: int, filter_bits: int = FILTER_BITS) -> list[tuple[int, bytes]]:
    """The second filter as (segment, packed positions); empty segments are
    left out. At most ``2 ** filter_bits`` bits come to the driver."""
    segment_bits = min(SEGMENT_BITS, filter_bits)

    def scan(batches):
        found, n = [], 0

        def flush():
            rows = [(s, _packed(a, segment_bits), _packed(b, segment_bits)) for s, a, b in _segments(found, segment_bits)]
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())],
                                              names=["segment", "once", "twice"])

        for _, text in _documents(batches):
            if keys := _keys(text, least):
                # a document sets a bit once, even if two of its keys share it
                found.append(np.unique(_bits(keys, filter_bits)))
                n += len(found[-1])
                if n >= 4 * FLUSH_KEYS:
                    yield flush()
                    found, n = [], 0
        if found:
            yield flush()

    def merge(batches):
        current, once, twice = None, None, None

        def done():
            pos = np.flatnonzero(twice)
            return pa.RecordBatch.from_arrays([pa.array([current] if len(pos) else [], pa.int32()),
                                               pa.array([_packed(pos.astype("<u4"), segment_bits)] if len(pos) else [], pa.binary())],
                                              names=["segment", "twice"])

        for batch in batches:
            for s, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != current:
                    if current is not None:
                        yield done()
                    current, once, twice = s, np.zeros(1 << segment_bits, bool), np.zeros(1 << segment_bits, bool)
                a = _unpacked(a)
                twice[a] |= once[a]
                once[a] = True
                twice[_unpacked(b)] = True
        if current is not None:
            yield done()

    bits = docs.mapInArrow(scan, "segment int, once binary, twice binary")
    dealt = bits.repartition(max(1, 1 << filter_bits - segment_bits), "segment").sortWithinPartitions("segment")
    return [(r[0], bytes(r[1])) for r in dealt.mapInArrow(merge, "segment int, twice binary").collect()]


class Suspects:
    """The second filter inside a task."""

    def __init__(self, parts: list[tuple[int, bytes]], filter_bits: int):
        self._filter_bits, segment_bits = filter_bits, min(SEGMENT_BITS, filter_bits)
        self._bits = np.zeros(max(1, 1 << filter_bits - 3), np.uint8)
        for segment, data in parts:
            pos = _unpacked(data) + (segment << segment_bits)
            np.bitwise_or.at(self._bits, pos >> 3, (1 << (pos & 7)).astype(np.uint8))

    def among(self, keys: set[bytes]) -> list[bytes]:
        """The keys with both bits twice seen."""
        if not keys:
            return []
        keys = list(keys)
        at = _bits(keys, self._filter_bits).astype(np.int64)
        hit = ((self._bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)
        return [keys[i] for i in np.flatnonzero(hit)]


# ------------------------------------------------------------- confirmation
def suspected(docs: DataFrame, parts: list[tuple[int, bytes]], least: int, filter_bits: int) -> DataFrame:
    """(key, salt, ids): the ids that hold a suspected key, one row per key
    and flush of a task, ids ascending without repeats, null first."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def scan(batches):
        suspects = Suspects(shared.value, filter_bits)
        held, n = {}, 0

        def flush():
            keys = list(held)
            ids = [sorted(held[k], key=lambda x: (x is not None, x or 0)) for k in keys]
            salts = [(i[0] or 0) % SALTS for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(salts, pa.int32()), pa.array(ids, pa.list_(pa.int64()))],
                                              names=["key", "salt", "ids"])

        for doc_id, text in _documents(batches):
            for key in suspects.among(_keys(text, least)):
                held.setdefault(key, set()).add(doc_id)
                n += 16 + len(key)
            if n >= 64 * FLUSH_KEYS:
                yield flush()
                held, n = {}, 0
        if held:
            yield flush()

    return docs.mapInArrow(scan, KEYS)


def confirmed(suspects: DataFrame, at_least: int) -> DataFrame:
    """(key, keep): the keys of ``at_least`` documents with the largest id."""
    last = F.slice("ids", -F.least(F.size("ids"), F.lit(at_least)), at_least)
    few = suspects.select("key", F.explode(last).alias("doc_id")).distinct()
    # null is one document: it counts, and is the largest only if alone
    by_key = few.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep"))
    return by_key.where(F.col("n") >= at_least).select("key", "keep")


def dropped_keys(suspects: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, digests): what each document loses."""
    salted = keys.select("key", "keep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    digests = suspects.join(salted, ["key", "salt"]).select(F.explode("ids").alias("doc_id"), "keep", F.unhex(F.md5("key")).alias("digest"))
    lost = digests.where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keep")))
    return lost.groupBy("doc_id").agg(F.collect_set("digest").alias("digests"))


# ------------------------------------------------------------- the operator
def drop_shared_lines(docs: DataFrame, at_least: int = 3, least_length: int = 20, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row of ``docs``: lines whose
    key has ``least_length`` code points and is held by ``at_least`` documents
    stay in the document with the largest id only. ``text`` is the UTF-8 of the
    lines that stay, joined by a line feed. Runs jobs."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = twice_seen(rows, least_length, filter_bits)
    suspects = scratch.save(suspected(rows, parts, least_length, filter_bits), "suspects")
    lost = scratch.save(dropped_keys(suspects, confirmed(suspects, at_least)), "lost")

    def cut(batches):
        for batch in batches:
            ids, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in texts])
            for lo, hi in slices(sizes, READ_BYTES):
                out = []
                for doc_id, text, gone in zip(ids[lo:hi], texts[lo:hi], lists[lo:hi].to_pylist()):
                    text = text.as_buffer().to_pybytes() if text.is_valid else b""
                    n = text.count(b"\n") + 1
                    if not gone:
                        out.append((doc_id, n, 0, text))
                        continue
                    gone = set(gone)
                    stay = [x for x in text.split(b"\n")
                            if len(x) < least_length or not long_enough(k := line_key(x), least_length) or digest(k) not in gone]
                    out.append((doc_id, n, n - len(stay), b"\n".join(stay)))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                                 names=["doc_id", "n_lines", "n_dropped", "text"])

    # the written size of `lost` decides between a broadcast and an exchange of the texts
    joined = rows.alias("d").join(lost.alias("x"), F.expr("d.doc_id <=> x.doc_id"), "left").select("d.doc_id", "d.text", "x.digests")
    return joined.mapInArrow(cut, CUT)


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""
    return drop_shared_lines(docs, **options).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

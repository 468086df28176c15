"""Alignment of two tokenizers, counted by external spilling.

Both tokenizers cut the same bytes; the offsets where tokens of both end divide
a document into groups, and within a group every A token is linked with every B
token. The count of an id pair is the number of documents that hold it linked.

1. Scan. A task turns its documents into pair-document records, sorts a chunk
   of about ``CHUNK_LINKS`` of them by radix (low bits of the A id), A id, B id
   and document, and writes a zstd run for each radix part: the distinct pairs,
   their documents and how often each holds them. A document lies in one chunk.
   Per-document figures are written beside the runs.
2. Counts. The pairs of the runs, already summed within their chunk, meet by
   part, first dealt out by salt, then whole. A heap merges ``FAN_IN`` sorted
   runs at once; the order is side-major, so the highest count of an A id is
   known when its last pair has streamed by.
3. Contributions. Every run reads the counts of its part and gives each of its
   documents a share of the sum and of the links that are best for their A id;
   the shares meet by chunk.

Only runs, counts and shares are exchanged, never texts. A part's counts are
bounded by the vocabularies, whatever the corpus; a hot A id is spread over the
salts of its part, which grow with the number of chunks. Every exchange reads a
written table, so lost executors cost only their tasks.

Results for odd input: null and empty texts, and texts whose tokens of either
side do not give back space + text, have no tokens: zeros and an empty digest.
Repeated rows count as documents of their own, also with a null or repeated id.
An empty table gives an empty result; extra columns are ignored, whatever their
names. Texts of any length are read whole. A pair's count may reach 2 ** 33.
"""

from __future__ import annotations

import hashlib
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch, slices
from rankforge.llm.packing import LONG_RUN, ByteBpe

PARTS_BITS = 5  # radix parts
CHUNK_LINKS = 1 << 22
DOCUMENT_BITS = 20  # documents of a chunk
SHARE_BYTES = 1 << 20
FAN_IN = 64
COUNT_BITS = 33
INFO = pa.struct([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())])
RUNS = ("chunk long, part int, pairs binary, held binary, documents binary, times binary, "
        "info array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>")
ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


# ------------------------------------------------------------- packed arrays
def packed(values: np.ndarray, steps: bool = False) -> bytes:
    """Unsigned numbers as zstd bytes: the width, then the first bytes of all,
    the second bytes of all and so on; ``steps`` stores the differences."""
    values = np.asarray(values, np.uint64)
    if steps:
        values = np.diff(values, prepend=np.uint64(0))
    top = int(values.max()) if len(values) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, steps: bool = False) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if steps else values


# ------------------------------------------------------------- tokens
class PlainByteBpe(ByteBpe):
    """Ids of a byte-level vocabulary; added tokens in a text are plain text."""

    def ids(self, text: str) -> list[int]:
        if len(text) > LONG_RUN and self._longest_run(text) > LONG_RUN:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json_path)
                self._slow.encode_special_tokens = True
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)


def piece_bytes(piece: str) -> bytes:
    """Bytes of a piece: U+2581 is a space, <0xHH> one byte."""
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class TwoTokenizers:
    """Both vocabularies, the bytes of their tokens and their written ids."""

    def __init__(self, json_path: str, rank_path: str, pattern: str, piece_path: str):
        import sentencepiece

        self.a = PlainByteBpe(json_path, rank_path, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        fast = self.a._fast
        self.bytes_a = [fast.decode_single_token_bytes(i) for i in range(fast.max_token_value + 1)]
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        if len({x for x in self.bytes_a if len(x) == 1}) != 256:
            raise ValueError("the byte-level vocabulary lacks single bytes, so it may lose some")
        # every id with what may follow it: A ids a comma or a bar, B ids a comma or a semicolon
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        words = [f"{i}{end}".encode() for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)]
        self.words, self.word_sizes = np.array(words), np.array([len(x) for x in words])
        self.b_bits = (n_b - 1).bit_length()
        self.a_bits = (n_a - 1).bit_length()

    def encode(self, texts: list[str | None]) -> tuple[list, list]:
        """Ids of both sides; none for a text that a side does not give back.
        (The byte-level side has all bytes and always does.)"""
        ids_a, ids_b = [], self.b.encode([t or "" for t in texts], num_threads=1)
        piece = self.bytes_b.__getitem__
        for k, text in enumerate(texts):
            if not text or b"".join(map(piece, ids_b[k])) != b" " + text.encode():
                ids_b[k] = []
            ids_a.append(self.a.ids(" " + text) if ids_b[k] else [])
        return ids_a, ids_b


def flattened(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some lists as one array, and the lists' lengths."""
    each = np.array([len(x) for x in lists], np.int64)
    return np.array(list(chain.from_iterable(lists)), np.int64), each


class Aligned:
    """Groups and links of a few documents at once."""

    def __init__(self, two: TwoTokenizers, ids_a: list, ids_b: list):
        self.two, n = two, len(ids_a)
        (self.a, self.n_a), (self.b, self.n_b) = flattened(ids_a), flattened(ids_b)
        ends_a, ends_b = np.cumsum(two.sizes_a[self.a]), np.cumsum(two.sizes_b[self.b])
        # documents end on both sides, so groups never cross them
        at = np.searchsorted(ends_b, ends_a)
        closes_a, closes_b = ends_b[at] == ends_a if len(at) else np.zeros(0, bool), np.zeros(len(ends_b), bool)
        closes_b[at[closes_a]] = True
        self.group_a, self.group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        self.document_a = np.repeat(np.arange(n), self.n_a)
        self.in_a, self.in_b = np.bincount(self.group_a), np.bincount(self.group_b)
        self.closes_a, self.closes_b = closes_a, closes_b
        of_group = self.document_a[closes_a]
        self.n_groups, self.n_links = np.bincount(of_group, minlength=n), np.zeros(n, np.int64)
        np.add.at(self.n_links, of_group, self.in_a * self.in_b)

    def links(self, most: int):
        """(A token, B token) indices of all links, at most about ``most`` at once."""
        each = self.in_b[self.group_a]
        start_b = (np.cumsum(self.in_b) - self.in_b)[self.group_a]
        total = np.cumsum(each)
        hi = 0
        while hi < len(each):
            lo = hi
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
            n = each[lo:hi]
            at_a = np.repeat(np.arange(lo, hi), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield at_a, np.repeat(start_b[lo:hi], n) + inner

    def digests(self) -> list[str]:
        """sha256 of the written groups of every document ('' without tokens)."""
        n_a, n_b = len(self.two.bytes_a), len(self.two.bytes_b)
        code_a = self.a + n_a * self.closes_a
        code_b = self.b + 2 * n_a + n_b * self.closes_b
        # a group's A tokens stand before its B tokens
        before_a, before_b = np.cumsum(self.in_b) - self.in_b, np.cumsum(self.in_a)
        codes = np.empty(len(code_a) + len(code_b), np.int64)
        codes[np.arange(len(code_a)) + before_a[self.group_a]] = code_a
        codes[np.arange(len(code_b)) + before_b[self.group_b]] = code_b
        sizes, width = self.two.word_sizes[codes], self.two.words.itemsize
        letters = self.two.words[codes].view(np.uint8).reshape(-1, width)
        text = memoryview(letters[np.arange(width) < sizes[:, None]])
        size = np.append(0, np.cumsum(sizes))
        ends = np.cumsum(self.n_a + self.n_b)
        cuts = zip(size[ends - self.n_a - self.n_b].tolist(), size[ends].tolist())
        return [hashlib.sha256(text[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in cuts]


# ------------------------------------------------------------- 1 scan
class Chunk:
    """Records of a chunk: radix part and A id, B id, document, in one number."""

    def __init__(self, two: TwoTokenizers):
        self.b_bits, self.low = two.b_bits, two.a_bits - PARTS_BITS
        self.key_bits = two.a_bits + two.b_bits
        self.info, self._raw, self._size = [], [], 0
        self._sorted, self._times = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return self._size + len(self._sorted)

    def add(self, a: np.ndarray, b: np.ndarray, document: np.ndarray) -> None:
        key = ((a & (1 << PARTS_BITS) - 1) << self.low | a >> PARTS_BITS) << self.b_bits | b
        self._raw.append((key << DOCUMENT_BITS | document).astype(np.uint64))
        self._size += len(key)
        if self._size > CHUNK_LINKS:
            self._sum()

    def _sum(self) -> None:
        got, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *self._raw]), return_counts=True)
        times = times.astype(np.uint64)
        if len(self._sorted):  # a very long document comes in several shares
            got, at = np.unique(np.concatenate([self._sorted, got]), return_inverse=True)
            both, times = np.concatenate([self._times, times]), np.zeros(len(got), np.uint64)
            np.add.at(times, at, both)
        self._sorted, self._times, self._raw, self._size = got, times, [], 0

    def runs(self):
        """(part, pairs, held, documents, times) of every part that has some."""
        self._sum()
        key = self._sorted >> np.uint64(DOCUMENT_BITS)
        cuts = np.searchsorted(key, np.arange((1 << PARTS_BITS) + 1, dtype=np.uint64) << np.uint64(self.low + self.b_bits))
        for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if hi > lo:
                pairs, held = np.unique(key[lo:hi], return_counts=True)
                documents = self._sorted[lo:hi] & np.uint64((1 << DOCUMENT_BITS) - 1)
                yield part, packed(pairs, True), packed(held), packed(documents), packed(self._times[lo:hi])


def scanned(docs: DataFrame, files: dict[str, str]) -> DataFrame:
    """The runs of every chunk, and one row of figures (part -1) a chunk."""

    def batch_of(chunk: Chunk, number: int) -> pa.RecordBatch:
        runs = list(chunk.runs())
        cols = list(zip(*runs)) if runs else [()] * 5
        n = len(runs) + 1
        arrays = [pa.array([number] * n, pa.int64()), pa.array([-1, *cols[0]], pa.int32()),
                  *(pa.array([None, *c], pa.binary()) for c in cols[1:]), pa.array([chunk.info, *[None] * (n - 1)], pa.list_(INFO))]
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "part", "pairs", "held", "documents", "times", "info"])

    def scan(batches):
        from pyspark import TaskContext

        two, number = TwoTokenizers(**files), TaskContext.get().partitionId() << 32
        chunk = Chunk(two)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in texts])
            for lo, hi in slices(sizes + 64, SHARE_BYTES):
                got = Aligned(two, *two.encode(texts.slice(lo, hi - lo).to_pylist()))
                first = len(chunk.info)
                for at_a, at_b in got.links(CHUNK_LINKS):
                    chunk.add(got.a[at_a], got.b[at_b], got.document_a[at_a] + first)
                figures = zip(ids[lo:hi], got.n_a.tolist(), got.n_b.tolist(), got.n_groups.tolist(), got.n_links.tolist(), got.digests())
                chunk.info += [dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), f)) for f in figures]
                if len(chunk) > CHUNK_LINKS // 2 or len(chunk.info) > 1 << DOCUMENT_BITS - 1:
                    yield batch_of(chunk, number)
                    chunk, number = Chunk(two), number + 1
        if chunk.info:
            yield batch_of(chunk, number)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, RUNS)


# ------------------------------------------------------------- 2 counts
def heap_merged(runs: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
    """Sorted runs of (pairs, counts) as one, counts of equal pairs added."""

    def items(pairs: bytes, counts: bytes):
        both = unpacked(pairs, True) << np.uint64(COUNT_BITS) | unpacked(counts)
        for lo in range(0, len(both), 4096):
            yield from both[lo:lo + 4096].tolist()

    merged = heapq.merge(*(items(*r) for r in runs))
    keys, sums = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    while len(block := np.fromiter(islice(merged, 1 << 16), np.uint64)):
        key, n = block >> np.uint64(COUNT_BITS), block & np.uint64((1 << COUNT_BITS) - 1)
        if len(keys[-1]) and keys[-1][-1] == key[0]:  # the last pair goes on
            key, n = np.append(keys[-1][-1], key), np.append(sums[-1][-1], n)
            keys[-1], sums[-1] = keys[-1][:-1], sums[-1][:-1]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        keys.append(key[first])
        sums.append(np.add.reduceat(n, first))
    return packed(np.concatenate(keys), True), packed(np.concatenate(sums))


def merge_by_part(batches):
    """Rows (part, pairs, counts), sorted by part, as one row a part; at most
    ``FAN_IN`` runs are open at once."""
    current, runs = None, []

    def row():
        (pairs, counts), = [heap_merged(runs)] if len(runs) > 1 else runs
        return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([pairs], pa.binary()), pa.array([counts], pa.binary())],
                                          names=["part", "pairs", "counts"])

    for batch in batches:
        for part, pairs, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != current:
                if runs:
                    yield row()
                current, runs = part, []
            runs.append((pairs, counts))
            if len(runs) == FAN_IN:
                runs = [heap_merged(runs)]
    if runs:
        yield row()


def counted(runs: DataFrame, salts: int) -> DataFrame:
    """(part, pairs, counts): the documents of every pair, one row a part."""
    schema = "part int, pairs binary, counts binary"
    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).alias("salt")
    mine = runs.where(F.col("part") >= 0).select("part", "pairs", F.col("held").alias("counts"), salt)
    some = mine.repartition("part", "salt").sortWithinPartitions("part", "salt").select("part", "pairs", "counts")
    return some.mapInArrow(merge_by_part, schema).repartition("part").sortWithinPartitions("part").mapInArrow(merge_by_part, schema)


def best_of(pairs: np.ndarray, counts: np.ndarray, b_bits: int) -> np.ndarray:
    """True where a pair has the highest count of its A id."""
    side = pairs >> np.uint64(b_bits)
    first = np.flatnonzero(np.append(True, side[1:] != side[:-1])) if len(side) else np.zeros(0, np.int64)
    top = np.maximum.reduceat(counts, first) if len(first) else counts
    return counts == np.repeat(top, np.diff(np.append(first, len(side))))


# ------------------------------------------------------------- 3 contributions
def contributed(runs: DataFrame, counts: DataFrame, salts: int, b_bits: int) -> DataFrame:
    """(chunk, best, total): what a run gives to the documents of its chunk."""

    def stream(batches):
        pairs = sums = best = None
        for batch in batches:
            for kind, chunk, p, held, documents, times in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if kind == 0:
                    pairs, sums = unpacked(p, True), unpacked(held)
                    best = best_of(pairs, sums, b_bits)
                    continue
                at = np.repeat(np.searchsorted(pairs, unpacked(p, True)), unpacked(held).astype(np.int64))
                of, n = unpacked(documents).astype(np.int64), unpacked(times)
                n_best, total = np.zeros(int(of.max()) + 1, np.uint64), np.zeros(int(of.max()) + 1, np.uint64)
                np.add.at(n_best, of, n * best[at])
                np.add.at(total, of, n * sums[at])
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([packed(n_best)], pa.binary()), pa.array([packed(total)], pa.binary())],
                                                 names=["chunk", "best", "total"])

    salt = F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")
    none = F.lit(None).cast("binary")
    tables = counts.select(F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), "pairs", F.col("counts").alias("held"), none.alias("documents"),
                           none.alias("times"), "part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    mine = runs.where(F.col("part") >= 0).select(F.lit(1).alias("kind"), "chunk", "pairs", "held", "documents", "times", "part", salt.alias("salt"))
    dealt = tables.unionByName(mine).repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")
    return dealt.drop("part", "salt").mapInArrow(stream, "chunk long, best binary, total binary")


def by_document(runs: DataFrame, shares: DataFrame) -> DataFrame:
    """The rows of all documents, with the shares of their chunk added up."""

    def stream(batches):
        current, best, total = None, None, None

        def added(sums, data):
            more = unpacked(data)
            if len(more) > len(sums):
                sums, more = more, sums
            sums[:len(more)] += more
            return sums

        for batch in batches:
            for chunk, info, b, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if chunk != current:
                    current, best, total = chunk, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
                if info is None:
                    best, total = added(best, b), added(total, t)
                    continue
                best, total = (np.append(x, np.zeros(len(info) - len(x), np.uint64)).astype(np.int64) for x in (best, total))
                cols = [[d[f.name] for d in info] for f in INFO]
                arrays = [pa.array(c, f.type) for c, f in zip(cols, INFO)]
                yield pa.RecordBatch.from_arrays([*arrays[:5], pa.array(best), pa.array(total), arrays[5]],
                                                 names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    none = F.lit(None).cast("binary")
    figures = runs.where(F.col("part") < 0).select("chunk", "info", none.alias("best"), none.alias("total"))
    mine = shares.select("chunk", F.lit(None).cast(runs.schema["info"].dataType).alias("info"), "best", "total")
    # a chunk's figures come last
    dealt = mine.unionByName(figures).repartition("chunk").sortWithinPartitions("chunk", F.col("info").isNotNull())
    return dealt.mapInArrow(stream, ROWS)


# ------------------------------------------------------------- the operator
class Alignment:
    """Written runs and counts of a corpus. Runs jobs when made."""

    def __init__(self, docs: DataFrame, **files: str):
        self._scratch = Scratch(docs.sparkSession)
        two = TwoTokenizers(**files)
        self._b_bits, self._low = two.b_bits, two.a_bits - PARTS_BITS
        self.runs = self._scratch.save(scanned(docs, files), "runs")
        # a task reads the runs of about 64 chunks
        self.salts = max(1, -(-self.runs.where(F.col("part") < 0).count() // 64))
        self.counts = self._scratch.save(counted(self.runs, self.salts), "counts")

    def documents(self) -> DataFrame:
        """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
        groups_sha256) of every row."""
        shares = self._scratch.save(contributed(self.runs, self.counts, self.salts, self._b_bits), "shares")
        return by_document(self.runs, shares)

    def pairs(self) -> DataFrame:
        """(a_id, b_id, n_docs, best): the alignment table of the vocabularies."""
        b_bits, low = self._b_bits, self._low

        def rows(batches):
            for batch in batches:
                for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    pairs, counts = unpacked(p, True), unpacked(c)
                    side = (pairs >> np.uint64(b_bits)).astype(np.int64)
                    a = (side & (1 << low) - 1) << PARTS_BITS | side >> low
                    b = (pairs & np.uint64((1 << b_bits) - 1)).astype(np.int64)
                    cols = [pa.array(a), pa.array(b), pa.array(counts.astype(np.int64)), pa.array(best_of(pairs, counts, b_bits))]
                    yield pa.RecordBatch.from_arrays(cols, names=["a_id", "b_id", "n_docs", "best"])

        return self.counts.select("pairs", "counts").mapInArrow(rows, "a_id long, b_id long, n_docs long, best boolean")

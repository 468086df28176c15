"""MinHash near-dedup over sets of five-word shingles.

Words are runs without ASCII white space after lower-casing A-Z; a document's
set holds its distinct five-word shingles (fewer words: the whole sequence as
one shingle; no words: the empty set, linked with nothing). Documents with
100 * |intersection| >= threshold * |union| are linked.

1. One pass over the texts makes, per document, a digest of its set, a
   signature of minima under many universal hashes and its band keys.
2. Documents with equal digests are one class; only one representative goes on.
3. Representatives that share a band key are candidates. Their signatures are
   compared in blocks of bounded size that share a few pivots; a block never
   lists its pairs but only the edges of a spanning forest of what passes.
   Large-star / small-star closes them into families; what stays outside the
   largest one of a band key then meets all members of that key.
4. Only members of families are read again. Inside a family (in blocks, too,
   in the same way) links are confirmed on the full sets, again as a spanning forest, and
   closed by large-star / small-star. No pair that passes the signature test
   and could join two components goes unconfirmed.
5. The class of a document gives its component.

Odd input: null or empty text has an empty set, is its own component and is
kept; a row without an id is returned with no component and is kept; repeated
rows share a component; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch, slices
from rankforge.llm.components import close_groups, forest

WORDS = 5
MISS = 1.2e-5  # probability that a pair at the threshold shares no band
MINIMA = 150  # at most; bands get as many rows as that allows
SIGNATURE_SLACK = 0.17  # five standard errors or more, of 144 minima at 0.85 and of 145 at 0.8
BLOCK = 1500  # members of a bucket or family that are compared at once
SALTS = 1024  # shares that the copies of one set are dealt into
SLICE_BYTES = 1 << 20

SIGNED = "doc_id long, n_shingles long, set_id binary, bands array<long>, signature binary"


def layout(threshold: int) -> tuple[int, int, float]:
    """(bands, rows, signature slack) for links at ``threshold`` percent:
    24 x 6 at 85, 29 x 5 at 80."""
    t = min(max(threshold, 1), 99) / 100
    fitting = [(int(np.ceil(np.log(MISS) / np.log1p(-t ** rows))), rows) for rows in range(1, 13)]
    bands, rows = [x for x in fitting if x[0] * x[1] <= MINIMA or x[1] == 1][-1]
    return bands, rows, max(SIGNATURE_SLACK, 5 * float(np.sqrt(t * (1 - t) / (bands * rows))))


# ------------------------------------------------------------- shingles
def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of the distinct shingles of many texts at once."""

    def __init__(self, words: int = WORDS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.words = words
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]  # A-Z as a-z
        self.coef = rng.integers(1, 1 << 63, words + 1, dtype=np.uint64) | np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._power = self._unpower = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._power) <= n:
            with np.errstate(over="ignore"):
                for name, b in (("_power", self.base), ("_unpower", self.inverse)):
                    p = np.full(n + 1, b, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.cumprod(p))

    def word_hashes(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and, per text, the index of its first word.
        ``data``: the texts' bytes, one space after each; ``first``: their starts."""
        space = (data == 32) | ((data >= 9) & (data <= 13))
        turn = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        begin, end = np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)
        self._powers(len(data))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.byte[data] * self._power[:len(data)])))
        words = _mix((total[end] - total[begin]) * self._unpower[begin] + (end - begin).astype(np.uint64))
        return words, np.searchsorted(begin, first)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of each text."""
        if not texts:
            return []
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        size = np.array([len(t) + 1 for t in texts])
        first = np.concatenate(([0], np.cumsum(size)))
        words, at = self.word_hashes(data, first)
        n, out = self.words, []
        if len(words) >= n:
            grams = _mix(sum(words[j:len(words) - n + 1 + j] * self.coef[j] for j in range(n)))
        for lo, hi in zip(at[:-1], at[1:]):
            if hi - lo >= n:
                out.append(np.unique(grams[lo:hi - n + 1]))
            elif hi > lo:
                short = (words[lo:hi] * self.coef[:hi - lo]).sum(dtype=np.uint64, keepdims=True)
                out.append(_mix(short ^ (self.coef[n:] * np.array([hi - lo], np.uint64))))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


class MinHasher:
    """Minima under ``bands * rows`` universal hash functions a*x + b mod 2^64."""

    def __init__(self, bands: int, rows: int, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64)
        self.mix = rng.integers(0, 1 << 64, rows, dtype=np.uint64) | np.uint64(1)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(shingles), 512):
            part = shingles[k:k + 512, None] * self.a + self.b
            np.minimum(best, part.min(axis=0), out=best)
        return best

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        keys = (minima.reshape(self.bands, self.rows) * self.mix).sum(axis=1, dtype=np.uint64)
        return _mix(keys + np.arange(self.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _texts(batch: pa.RecordBatch, column: str):
    """Slices (rows, texts as bytes) of a batch, about a megabyte each."""
    col = batch.column(column)
    raw = col.cast(pa.binary())
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in raw])
    for lo, hi in slices(sizes, SLICE_BYTES):
        yield lo, hi, [x or b"" for x in raw.slice(lo, hi - lo).to_pylist()]


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per document: set size, set digest, band keys and signature."""

    def sign(batches):
        shingler, hasher = Shingler(), MinHasher(bands, rows)
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, texts in _texts(batch, "text"):
                found = [(len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), hasher.minima(s)) if len(s)
                         else (0, b"", None) for s in shingler.sets(texts)]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.binary()),
                    pa.array([[] if x[2] is None else hasher.band_keys(x[2]) for x in found], pa.list_(pa.int64())),
                    pa.array([b"" if x[2] is None else (x[2] >> np.uint64(48)).astype("<u2").tobytes() for x in found],
                             pa.binary())], names=["doc_id", "n_shingles", "set_id", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, SIGNED)


# ------------------------------------------------------------- linking
def _edge_batch(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.Table:
    at = np.array(edges, np.int64).reshape(-1, 2)
    return pa.table({"u": ids[at[:, 0]], "v": ids[at[:, 1]]})


def _families(slack: float, threshold: int):
    def link(table: pa.Table) -> pa.Table:
        ids, size = table.column("rep").to_numpy(), table.column("n_shingles").to_numpy()
        ids, keep = np.unique(ids, return_index=True)
        size = size[keep]
        minima = np.array([np.frombuffer(x, "<u2") for x in table.column("signature").take(keep).to_pylist()])
        enough = (threshold / 100 - slack) * minima.shape[1]

        def near(i, others):
            a, b = np.minimum(size[i], size[others]), np.maximum(size[i], size[others])
            hit = 100 * a >= threshold * b
            hit[hit] = (minima[others[hit]] == minima[i]).sum(axis=1) >= enough
            return hit

        return _edge_batch(ids, forest(len(ids), near))

    return link


def _confirm(threshold: int):
    def link(table: pa.Table) -> pa.Table:
        ids, keep = np.unique(table.column("node").to_numpy(), return_index=True)
        sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").take(keep).to_pylist()]
        size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), size)
        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(word, kind="stable")
        posting = owner[order]  # who has shingle w: posting[start[w]:start[w + 1]]
        start = np.concatenate(([0], np.cumsum(np.bincount(word))))
        at = np.concatenate(([0], np.cumsum(size)))

        def near(i, others):
            own = word[at[i]:at[i + 1]]
            lens = start[own + 1] - start[own]
            skip = np.repeat(start[own] - np.concatenate(([0], np.cumsum(lens)[:-1])), lens)
            shared = np.bincount(posting[skip + np.arange(lens.sum())], minlength=len(sets))[others]
            return 100 * shared >= threshold * (size[i] + size[others] - shared)

        return _edge_batch(ids, forest(len(ids), near))

    return link


def link(docs: DataFrame, threshold: int = 85, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, set_id.

    Documents are linked where 100 * |intersection| >= ``threshold`` * |union|.
    Runs jobs and keeps its tables in the shared folder; the result is lazy.
    """
    scratch = Scratch(docs.sparkSession)
    bands, rows, slack = layout(threshold)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.save(signatures(docs, bands, rows), "signed")
    usable = signed.where("doc_id IS NOT NULL AND n_shingles > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # a set that very many documents share is at most SALTS rows here
    shares = scratch.save(usable.groupBy("set_id", "salt").agg(F.min("doc_id").alias("least")), "shares")
    classes = shares.groupBy("set_id").agg(F.min("least").alias("rep"))
    # equal in both columns: one row per class (repeated rows apart), and no key is hot
    reps = usable.join(classes, (usable.set_id == classes.set_id) & (usable.doc_id == classes.rep), "left_semi")
    keyed = scratch.save(reps.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band")), "bands")
    held = usable.select(F.col("doc_id").alias("rep"), "n_shingles", "signature")
    family = close_groups(*_sized(keyed, "band", scratch, "band-sizes"), held, "band", "rep", block,
                          _families(slack, threshold), scratch, "family")
    scratch.drop("bands")
    placed, most = _sized(family, "component", scratch, "family-sizes")
    placed = scratch.save(placed, "placed")  # light rows of known size: texts are only shuffled beside a large table
    texts = docs.join(placed, docs.doc_id == placed.node).select("node", "component", "n", "text")
    sets = scratch.save(texts.mapInArrow(_shingle_sets, "node long, component long, n long, shingles binary"), "sets")
    joined = close_groups(sets, most, sets.select("node", "shingles"), "component", "node", block,
                          _confirm(threshold), scratch, "linked")
    classes = (classes.join(joined, classes.rep == joined.node, "left")
               .select("set_id", F.coalesce("component", "rep").alias("component_id")))
    own = shares.join(classes, "set_id").select("set_id", "salt", "component_id")
    known = (usable.join(own, ["set_id", "salt"])
             .select("doc_id", "n_shingles", "component_id", (F.col("component_id") == F.col("doc_id")).alias("kept"), "set_id"))
    alone = (signed.where("doc_id IS NULL OR n_shingles = 0")
             .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "set_id"))
    return known.union(alone)


def _sized(rows: DataFrame, key: str, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """``rows`` of keys that occur more than once, with that number n; the largest n."""
    sizes = scratch.save(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), name)
    return rows.join(sizes, key), sizes.agg(F.max("n")).first()[0] or 0


def _shingle_sets(batches):
    shingler = Shingler()
    for batch in batches:
        for lo, hi, texts in _texts(batch, "text"):
            part = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays(
                [part.column("node"), part.column("component"), part.column("n"),
                 pa.array([s.astype("<u8").tobytes() for s in shingler.sets(texts)], pa.binary())],
                names=["node", "component", "n", "shingles"])


def dedup(docs: DataFrame, threshold: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row
    with the smallest doc_id stays. Rows without an id all stay. Rows that
    repeat an id are one document; the one with the smallest text stays."""
    kept = link(docs, threshold).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    with_id = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").select(docs.columns)
    twice = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.isEmpty():
        once = with_id.join(twice, "doc_id", "left_anti").select(docs.columns)
        again = (with_id.join(twice, "doc_id", "left_semi").groupBy("doc_id")
                 .agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_row"))
                 .select("_row.*"))
        with_id = once.unionByName(again)
    return with_id.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)

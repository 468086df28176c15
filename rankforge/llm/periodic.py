"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least two periods long,
that no neighbouring word extends. For every prefix of a word sequence the
states on the way from its automaton state to the root hold its suffixes, and
every state carries the end of its last occurrence as a colour. Appending a
word recolours that way (link-cut access). The way falls into segments of one
old colour e; the longest string of a segment has length L, so L words before
the old end e equal L words before the new end i. Where the distance p = i - e
is at most L, the last 2p words are a square, and all p + L words have period p
and cannot be extended to the left. The run then is the group of squares with
one start and period; its end is the last of them. A square of a string that
itself is a power never shows: such a string has a nearer occurrence, so p is
the smallest period. Recolouring costs O(log n) segments per word on average.

Most words never reach the automaton: a run of at least ``least`` words and two
periods repeats ``least // 2`` or more words in a row, and both copies lie in
it. So only the stretches of a document that are covered by repeated word
groups of that size are read; equal hashes are enough, since the automaton
decides. A run lies in one stretch whole.

A document is one row of one task; nothing is shuffled, and the rows of a batch
are read in shares of about a megabyte.

Results for odd input: a null or empty text has no words and no run; texts of
any length are read whole; repeated rows are reported each for itself; a null id
stays null; an empty table gives an empty result; extra columns are ignored,
whatever their names. Among runs of equal length the earliest, then the one
with the smallest period, counts as the greatest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import slices

LEAST = 12
SHARE_BYTES = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, text string"


# ------------------------------------------------------------- the automaton
def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, length, end): suffix links and longest lengths of the states of
    the suffix automaton, and the state of every prefix. State 0 is the root."""
    link, length, step, end = [-1], [0], [{}], []
    last = 0
    for c in words:
        cur = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.append({})
        end.append(cur)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] > length[p] + 1:
                clone = len(link)
                link.append(link[q])
                length.append(length[p] + 1)
                step.append(step[q].copy())
                link[q] = link[cur] = clone
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
            else:
                link[cur] = q
        last = cur
    return link, length, end


class LastOccurrence:
    """The link tree as preferred paths, each a splay tree by depth with one
    colour, kept at its root: 1 + the end of the last occurrence, 0 for none."""

    def __init__(self, link: list[int], length: list[int]):
        self.length = length
        self.par = [max(x, 0) for x in link]  # of a path's top: the state above it
        self.up, self.down, self.colour = [0] * len(link), [0] * len(link), [0] * len(link)

    def _rotate(self, x: int) -> None:
        up, down, par = self.up, self.down, self.par
        p = par[x]
        g = par[p]
        if g and up[g] == p:
            up[g] = x
        elif g and down[g] == p:
            down[g] = x
        else:
            self.colour[x] = self.colour[p]
        if up[p] == x:
            b = up[p] = down[x]
            down[x] = p
        else:
            b = down[p] = up[x]
            up[x] = p
        if b:
            par[b] = p
        par[p], par[x] = x, g

    def _splay(self, x: int) -> None:
        up, down, par = self.up, self.down, self.par
        while (p := par[x]) and (up[p] == x or down[p] == x):
            g = par[p]
            if g and (up[g] == p or down[g] == p):
                self._rotate(p if (up[g] == p) == (up[p] == x) else x)
            self._rotate(x)

    def access(self, state: int, now: int) -> list[tuple[int, int]]:
        """Colour the way from ``state`` to the root with ``now`` and return
        its former segments as (end of the last occurrence, longest length)."""
        down, colour, segments = self.down, self.colour, []
        below, x = 0, state
        while x:
            self._splay(x)
            old = colour[x]
            if old:
                segments.append((old - 1, self.length[x]))
            if down[x]:
                colour[down[x]] = old  # the deeper rest of the path stays as it was
            down[x] = below
            below, x = x, self.par[x]
        colour[below] = now + 1
        return segments


def runs_of(words: list[int]) -> dict[tuple[int, int], int]:
    """{(start, period): last word} of every run of at least two periods."""
    link, length, end = automaton(words)
    tree, found = LastOccurrence(link, length), {}
    for i, state in enumerate(end):
        for e, common in tree.access(state, i):
            if i - e <= common:
                found[(e - common + 1, i - e)] = i
    return found


# ------------------------------------------------------------- documents
def stretches(ids: np.ndarray, document: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(first, behind the last) of what repeated groups of ``size`` words of
    one document cover."""
    n = len(ids) - size + 1
    if n < 2:
        return []
    h = document[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(size):
        h = (h ^ ids[j:n + j].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    at = np.flatnonzero(document[:n] == document[size - 1:])
    order = at[np.argsort(h[at], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    repeated = np.zeros(len(order), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    turn = np.zeros(len(ids) + 1, np.int64)
    np.add.at(turn, order[repeated], 1)
    np.add.at(turn, order[repeated] + size, -1)
    covered = np.cumsum(turn) > 0
    # a word group never crosses documents, but two covered ends may touch
    edge = np.flatnonzero((covered[1:] != covered[:-1]) | np.append(covered[1:-1] & (document[1:] != document[:-1]), False)) + 1
    edge = np.concatenate(([0], edge)) if len(covered) and covered[0] else edge
    return [(int(a), int(b)) for a, b in zip(edge, edge[1:]) if covered[a]]


def runs_by_document(documents: list[list], least: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of every document, by start and period."""
    out = [[] for _ in documents]
    sizes = np.array([len(w) for w in documents])
    if sizes.sum() == 0:
        return out
    names: dict = {}
    ids = np.fromiter((names.setdefault(w, len(names)) for words in documents for w in words), np.int64, sizes.sum())
    document = np.repeat(np.arange(len(documents)), sizes)
    first = np.cumsum(sizes) - sizes
    for a, b in stretches(ids, document, max(1, least // 2)):
        k = document[a]
        if b - a >= least:
            for (start, period), last in runs_of(ids[a:b].tolist()).items():
                if last - start + 1 >= least:
                    out[k].append((int(a - first[k]) + start, last - start + 1, period))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that stay when every run keeps its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def find_runs(docs: DataFrame, least: int = LEAST, prepare: Callable | None = None) -> DataFrame:
    """(doc_id, n_words, runs, text) of every row of ``docs``: the runs of at
    least ``least`` words and two periods, by start and period, and the text
    without what a run repeats, words joined by one space. Words are what white
    space (space, tab to carriage return) divides. ``prepare(doc_id, words)``
    may change the words (as bytes) before."""

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in texts])
            for lo, hi in slices(sizes, SHARE_BYTES):
                documents = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in texts[lo:hi]]
                if prepare is not None:
                    documents = [prepare(i, w) for i, w in zip(ids[lo:hi], documents)]
                runs = runs_by_document(documents, least)
                kept = [b" ".join(collapsed(w, r)).decode() for w, r in zip(documents, runs)]
                rows = [[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi], pa.int64()), pa.array([len(w) for w in documents], pa.int64()), pa.array(rows, pa.list_(RUN)), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, FOUND)


def report(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256): the number of runs, the longest one and digests."""
    found = find_runs(docs, **options)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit(""))).alias("lines"), "text")
    length, period = F.col("best.length"), -F.col("best.p")
    return rows.select("doc_id", "n_runs", (-F.col("best.s")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                       F.sha2("lines", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))

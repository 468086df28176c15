"""Best-fit packing of tokenised documents by exact complements.

Every document becomes token ids plus a closing id; longer ones are cut into
full pieces (only the first piece may be shorter). What has to be packed is
then described completely by the histogram of piece lengths, which has at most
``capacity`` entries whatever the corpus size. The plan is made on that
histogram: for the longest open length, the gap it leaves is looked up among
the available lengths, then among their pair sums, then among their triple
sums, and the combination is consumed as often as the counts allow. What no
combination completes goes to the tightest open gap (best fit).

The plan never sees a row. Each piece gets its rank among the pieces of its
length (a running count inside its write task plus the counts of the tasks
before it), and the plan maps (length, rank) to (sequence, offset).

Results for odd input: a null or empty text is one piece that holds only the
closing id; repeated rows are packed each for itself; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
LONG_RUN = 4000  # bytes without a change between space and non-space


# ------------------------------------------------------------- tokenising
class ByteBpe:
    """Ids of a byte-level BPE vocabulary.

    Texts are encoded from the rank file, which holds the same vocabulary as
    the JSON file and is several times faster; texts with a very long unbroken
    run go through the JSON tokenizer, whose merge cost does not grow with the
    square of the run, and so do texts that hold an added token's literal, which
    only the JSON file knows. Both give the same ids otherwise (see tests).
    """

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._json_path, self._slow = json_path, None
        with open(json_path, encoding="utf-8") as f:
            self._added = [t["content"] for t in json.load(f).get("added_tokens") or []]

    def ids(self, text: str) -> list[int]:
        if any(t in text for t in self._added) or len(text) > LONG_RUN and self._longest_run(text) > LONG_RUN:
            if self._slow is None:
                from tokenizers import Tokenizer

                self._slow = Tokenizer.from_file(self._json_path)
            return self._slow.encode(text, add_special_tokens=False).ids
        return self._fast.encode_ordinary(text)

    @staticmethod
    def _longest_run(text: str) -> int:
        data = np.frombuffer(text.encode(), np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        turns = np.flatnonzero(space[1:] != space[:-1])
        return int(np.diff(np.concatenate(([-1], turns, [len(data) - 1]))).max())


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n_ids`` ids."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity
    starts = ([0] if first else []) + list(range(first, n_ids, capacity))
    return [(s, first if first and s == 0 else capacity) for s in starts]


def pieces(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int, closing_id: int) -> DataFrame:
    """One row per piece, with its rank among the equal lengths of its task."""

    def tokenise(batches):
        from pyspark import TaskContext

        bpe, task, seen = ByteBpe(json_path, rank_path, pattern), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            sizes = np.array([x.as_buffer().size if x.is_valid else 0 for x in texts])
            for lo, hi in slices(sizes, 4 << 20):
                rows = []
                for doc_id, text in zip(ids[lo:hi], texts.slice(lo, hi - lo).to_pylist()):
                    code = np.array([*bpe.ids(text or ""), closing_id], "<u4")
                    for k, (start, length) in enumerate(cut(len(code), capacity)):
                        crc = zlib.crc32(code[start:start + length].tobytes())
                        rows.append((doc_id, k, start, length, crc, task, seen[length]))
                        seen[length] += 1
                yield _batch(rows, PIECES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tokenise, PIECES)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [f.strip().split() for f in schema.split(",")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)],
                                      names=[n for n, _ in fields])


# ------------------------------------------------------------- planning
def find_fill(avail: np.ndarray, gap: int, most: int = 3) -> list[int] | None:
    """One to ``most`` (three) available lengths that add up to ``gap``
    exactly, the longest ones first."""
    if gap <= 0:
        return None
    if avail[gap] > 0:
        return [gap]

    def pair(total: int, most: int) -> list[int] | None:
        a = np.arange(min(total - 1, most), (total - 1) // 2, -1)
        if not len(a):
            return None
        ok = (avail[a] > 0) & (avail[total - a] > 0) & ((2 * a != total) | (avail[a] > 1))
        k = int(ok.argmax())
        return [int(a[k]), int(total - a[k])] if ok[k] else None

    if most < 2:
        return None
    if (found := pair(gap, gap)) or most < 3:
        return found
    for a in np.flatnonzero(avail[:gap - 1])[::-1]:
        a = int(a)
        if 3 * a < gap:
            break
        avail[a] -= 1
        found = pair(gap - a, a)
        avail[a] += 1
        if found:
            return [a, *found]
    return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, how often in each)]): of the
    plans with single, up to pair and up to triple complements, the one with
    the fewest sequences. Triples leave nothing open but may use up the short
    pieces that long ones need."""
    plans = [exact_fill(histogram, capacity, most) for most in (3, 2, 1)]
    return min(plans, key=lambda p: sum(count for count, _ in p))


def exact_fill(histogram: dict[int, int], capacity: int, most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        avail[length] += n
    out: list[tuple[int, list[tuple[int, int]]]] = []
    for length in range(capacity, 0, -1):
        while avail[length]:
            avail[length] -= 1
            fill = [] if length == capacity else find_fill(avail, capacity - length, most)
            avail[length] += 1
            if fill is None:
                break  # no exact complement: left for best fit
            need = Counter([length, *fill])
            times = min(int(avail[x]) // k for x, k in need.items())
            out.append((times, sorted(need.items(), reverse=True)))
            for x, k in need.items():
                avail[x] -= k * times
    return out + best_fit({i: int(n) for i, n in enumerate(avail) if n}, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing on counts: equal sequences are kept as one group."""
    gaps: list[int] = []  # sorted distinct gaps that have groups
    groups: dict[int, list[list]] = {}

    def add(gap: int, count: int, items: list[tuple[int, int]]) -> None:
        if count:
            if gap not in groups:
                groups[gap] = []
                insort(gaps, gap)
            groups[gap].append([count, items])

    def take(gap: int) -> list:
        group = groups[gap].pop()
        if not groups[gap]:
            del groups[gap]
            gaps.remove(gap)
        return group

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            k = bisect_left(gaps, length)
            gap = gaps[k] if k < len(gaps) else capacity
            fits = gap // length
            count, items = take(gap) if k < len(gaps) else (-(-left // fits), [])
            full = min(count, left // fits)
            add(gap - fits * length, full, [*items, (length, fits)])
            left -= full * fits
            rest = count - full
            if rest and left:  # fewer than ``fits`` are left for the last one
                add(gap - left * length, 1, [*items, (length, left)])
                left, rest = 0, rest - 1
            if items:
                add(gap, rest, items)
    return [(count, items) for gap in gaps for count, items in groups[gap]]


def places(patterns: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> dict[str, np.ndarray]:
    """The plan as arrays sorted by (length, first rank)."""
    used, rows, sequence = Counter(), [], 0
    for count, items in patterns:
        offset = 0
        for length, k in items:
            rows.append((length, used[length], k, sequence, offset))
            used[length] += count * k
            offset += k * length
        sequence += count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), cols))


# ------------------------------------------------------------- operator
def pack(docs: DataFrame, json_path: str, rank_path: str, pattern: str,
         capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` ids.

    Runs a job that tokenises and writes the pieces; the returned placement
    is lazy. See the module text for odd input.
    """
    scratch = Scratch(docs.sparkSession)
    cut_up = scratch.save(pieces(docs, json_path, rank_path, pattern, capacity, closing_id), "pieces")
    counts = cut_up.groupBy("length", "_task").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = places(plan(histogram, capacity), capacity)
    before = counts.withColumn("_before", F.sum("n").over(
        Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = (cut_up.join(before.drop("n"), ["length", "_task"])
              .select("doc_id", "piece", "start", "length", "ids_crc32",
                      (F.col("_rank") + F.coalesce("_before", F.lit(0))).alias("_rank")))
    wide = np.int64(1) << 48
    keys = at["length"] * wide + at["rank"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            k = np.searchsorted(keys, length * wide + rank, "right") - 1
            nth = rank - at["rank"][k]
            cols = [batch.column(i) for i in range(5)]
            cols += [pa.array(at["sequence"][k] + nth // at["each"][k]),
                     pa.array(at["offset"][k] + nth % at["each"][k] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=[re.split(r"\s+", f.strip())[0] for f in PLACED.split(",")])

    return ranked.mapInArrow(place, PLACED)

"""Toxicity scores by gradient-boosted trees over dense features.

The lexicon is learned from labelled training documents: words and word
prefixes whose share among toxic documents is far above that among the others
(Spark counts them over the sample). Per document, the features are lexicon
densities (plain and after undoing look-alike characters), the nearness of
lexicon words to second-person words, rates of capitals, punctuation and
obfuscated words, and lengths. Boosted trees on binned features give a margin;
isotonic regression on documents kept aside turns it into a probability.

Only documents whose crc32(doc_id as text) mod 5 is not 0 are learned from, at
most about ``per_class`` of each label; whole texts are read for training and
for scores.

Odd input: null text counts as empty and is scored like it; rows with a null
label, or without a document, teach nothing; repeated rows get equal scores;
empty tables give an empty result; with no labels at all every score is 0.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch, held_out, sample_by_hash

# Second-person words of the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre "
                          "vos tú ti tuyo usted ustedes vosotros vuestro".split())
# Characters that stand for letters in obfuscated words.
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
# lower-cases ASCII and blanks its punctuation; words are what lies between the blanks
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() or b == 95 else 32 for b in range(256)).lower()
# a look-alike before a letter, or single letters between separators
ODD = re.compile(r"[0-9@$*!]+(?=[^\W\d_])|[.\-*_][^\W\d_][.\-*_][^\W\d_]")
SHOUT = re.compile(r"[A-Z]{3,}")
PREFIXES = (5, 6)
NEAR = 5  # words between a lexicon word and a second-person word
FEATURES = ("per_word", "any_hit", "hits", "distinct", "weight", "heaviest", "look_alike", "near_you", "you_rate",
            "capitals", "shouted", "exclaimed", "questioned", "punctuation", "obfuscated", "digits", "word_length", "log_words")


def split_words(text: str) -> list[str]:
    return text.encode().translate(PLAIN).decode().lower().split()


def units(word: str) -> list[str]:
    """A word and its prefixes (marked, so that they are not taken for words)."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) >= n)]


# ------------------------------------------------------------- features
def _classes() -> np.ndarray:
    """Byte classes: 1 capital, 2 digit, 3 '!', 4 '?', 5 other punctuation, 0 the rest."""
    table = np.zeros(256, np.int64)
    table[33:127] = 5
    table[48:58] = 2
    table[65:91], table[97:123] = 1, 0
    table[ord("!")], table[ord("?")] = 3, 4
    return table


CLASSES = _classes()


class Lexicon:
    """Weights of words and prefixes; the best one counts for a word."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.words = {u for u in weights if not u.endswith("~")}
        self.prefixes = [(n, {u[:-1] for u in weights if u.endswith("~") and len(u) == n + 1}) for n in PREFIXES]

    def found(self, words) -> dict[str, float]:
        hit = set(self.words.intersection(words))
        for n, known in self.prefixes:
            if known.intersection([w[:n] for w in words]):
                hit.update(w for w in words if w[:n] in known)
        return {w: max(self.weights.get(u, 0.0) for u in units(w)) for w in hit}


def odd_words(text: str) -> set[str]:
    """White-space tokens with look-alikes inside a word or letters set apart."""
    out = set()
    for m in ODD.finditer(text):
        at = m.start()
        if text[at] in ".-*_" or (at and text[at - 1].isalpha()):
            lo = max(text.rfind(" ", 0, at), text.rfind("\n", 0, at)) + 1
            ends = [e for e in (text.find(" ", at), text.find("\n", at)) if e >= 0]
            out.add(text[lo:min(ends, default=len(text))])
    return out


def features(text: str, lexicon: Lexicon) -> list[float]:
    words = split_words(text)
    n = max(len(words), 1)
    counts = Counter(words)
    found = lexicon.found(counts)
    hits = sum(counts[w] for w in found)
    weight = sum(counts[w] * x for w, x in found.items())
    you = SECOND_PERSON.intersection(counts)
    near = 0
    if found and you:
        there = np.array([i for i, w in enumerate(words) if w in you])
        at = np.array([i for i, w in enumerate(words) if w in found])
        k = np.searchsorted(there, at)
        gap = np.minimum(np.abs(at - there[np.minimum(k, len(there) - 1)]), np.abs(at - there[np.maximum(k - 1, 0)]))
        near = int((gap <= NEAR).sum())
    odd = odd_words(text)
    alike = sum(bool(lexicon.found([re.sub(r"\W|_", "", w.lower().translate(LOOKALIKE))])) for w in odd)
    size = max(len(text), 1)
    kind = np.bincount(CLASSES[np.frombuffer(text.encode(), np.uint8)], minlength=6)
    return [hits / n, float(hits > 0), float(hits), float(len(found)), weight / n, max(found.values(), default=0.0),
            float(alike), near / n, sum(counts[w] for w in you) / n, kind[1] / size, len(SHOUT.findall(text)) / n,
            kind[3] / n, kind[4] / n, kind[3:].sum() / size, len(odd) / n, kind[2] / size, size / n, float(np.log1p(len(words)))]


# ------------------------------------------------------------- trees
@dataclass
class Trees:
    """Boosted trees of fixed depth on binned features, logistic loss."""

    depth: int = 3
    rounds: int = 60
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    least: float = 2.0  # hessian a leaf needs
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def _leaf(self, binned: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(binned), np.int64)  # heap order
        for _ in range(self.depth):
            right = binned[np.arange(len(binned)), feature[node]] > cut[node]
            node = 2 * node + 1 + right
        return node - (2 ** self.depth - 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = self._bin(x)
        margin = np.full(len(y), self.base)
        inner = 2 ** self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, self.bins)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, width = 2 ** level - 1, 2 ** level
                best = np.zeros(width)
                for j in range(x.shape[1]):
                    cell = (node - first) * self.bins + binned[:, j]
                    gs = np.bincount(cell, g, width * self.bins).reshape(width, -1).cumsum(axis=1)
                    hs = np.bincount(cell, h, width * self.bins).reshape(width, -1).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = (gs ** 2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt ** 2 / (ht + self.ridge))
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first:first + width][better] = j
                    cut[first:first + width][better] = at[better]
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        return self.base + sum((v[self._leaf(binned, f, c)] for f, c, v in self.trees), np.zeros(len(x)))


@dataclass
class Isotonic:
    """Least-squares non-decreasing fit (pool adjacent violators), linear
    between the block centres so that ranks inside a block survive."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Isotonic:
        blocks: list[list[float]] = []  # sum of x, sum of y, weight
        for a, b in sorted(zip(x.tolist(), y.tolist())):
            blocks.append([a, b, 1.0])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                a2, b2, w2 = blocks.pop()
                blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + w2]
        if blocks:
            self.x = np.array([b[0] / b[2] for b in blocks])
            self.y = np.array([b[1] / b[2] for b in blocks])
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1)


# ------------------------------------------------------------- fitting
@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def scores(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.margin(x)) if len(x) else np.zeros(0)


def learn_lexicon(sample: DataFrame, most: int = 3000, least: int = 4, ratio: float = 8.0) -> dict[str, float]:
    """Log ratio of the smoothed document shares of units that are common in
    toxic documents and rare elsewhere. ``sample``: text, label."""
    def spread(batches):
        for batch in batches:
            unit, toxic = [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                seen = {u for w in set(split_words(text or "")) if len(w) > 2 for u in units(w)}
                unit += seen
                toxic += [label] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(unit, pa.string()), pa.array(toxic, pa.int64())], names=["unit", "toxic"])

    totals = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}
    share = ((F.col("t") + 0.1) / pos) / ((F.col("c") + 0.5) / neg)
    rows = (sample.mapInArrow(spread, "unit string, toxic long").groupBy("unit")
            .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
            .where((F.col("t") >= least) & (share > ratio))
            .select("unit", F.log(share).alias("weight")).orderBy(F.desc("weight"), "unit").limit(most).collect())
    return {r["unit"]: r["weight"] for r in rows}


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model | None:
    """Learn lexicon, trees and calibration; ``labels``: doc_id, toxic.

    A fifth of the sampled documents (by another hash of the id) is kept
    aside: the lexicon and the trees do not see them, the calibration does.
    """
    spark = docs.sparkSession
    known = (labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("label")))
    picked = sample_by_hash(known, "label", per_class)  # at most 4 * per_class rows: small enough to broadcast
    scratch = Scratch(spark)
    sample = scratch.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                          .join(F.broadcast(picked), "doc_id")
                          .groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one row of a repeated id
                          .withColumn("aside", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0), "sample")
    lexicon = Lexicon(learn_lexicon(sample.where("NOT aside").select("text", "label")))

    def measure(batches):
        for batch in batches:
            rows = [features(t or "", lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("aside"), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["label", "aside", "x"])

    rows = sample.mapInArrow(measure, "label int, aside boolean, x array<double>").collect()
    scratch.drop()
    if len({r["label"] for r in rows if not r["aside"]}) < 2:
        return None
    x = np.array([r["x"] for r in rows])
    y, aside = np.array([r["label"] for r in rows], float), np.array([r["aside"] for r in rows])
    # the sample is dealt by class: weigh the calibration back to the corpus
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    trees = Trees().fit(x[~aside], y[~aside])
    held = aside if len(set(y[aside])) > 1 else ~aside
    taken = {c: max(int((y == c).sum()), 1) for c in (0, 1)}
    times = np.array([max(1, round(totals.get(int(c), 1) / taken[int(c)] / min(totals.get(k, 1) / taken[k] for k in (0, 1))))
                      for c in y[held]])
    calibration = Isotonic().fit(np.repeat(trees.margin(x[held]), times), np.repeat(y[held], times))
    return Model(lexicon, trees, calibration)


# ------------------------------------------------------------- operator
def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            out = []
            for lo in range(0, len(texts), 500):
                part = texts.slice(lo, 500).to_pylist()
                out.append(model.scores(np.array([features(t or "", model.lexicon) for t in part])) if model else np.zeros(len(part)))
            found = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found),
                                              pa.array((found >= 0.5).astype(np.int32))],
                                             names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))

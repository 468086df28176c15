"""Quality scores by co-training a text view and a metadata view.

Two logistic classifiers see disjoint views of a document: its text (repetition,
symbols, capitals, sentence and word shape) and its metadata (language, source,
length as the tables give them). Starting from labelled documents, each labels
in every round the unlabelled documents it is surest about, by class in the
proportion of the labels, and hands them to the other view. After the rounds
both are calibrated on labelled documents kept aside and their calibrated log
odds are combined by a small logistic model fitted there.

Only documents whose crc32(doc_id as text) mod 5 is not 0 are learned from: at
most about ``per_class`` of each label, and all unlabelled ones. Their views are
a table that Spark scores in every round; the confident share is cut out by a
histogram over all of it, and the classifiers are fitted from summed gradients
and Hessians. What was handed over weighs at most as much as the labels, so that
a large corpus does not drown them. All documents are scored on their whole
texts.

Odd input: null text counts as empty; null metadata is a value of its own;
repeated rows get equal scores; rows with a null label are unlabelled; empty
tables give an empty result; without labels of both classes every score is
0.5.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import Scratch, held_out, sample_by_hash

HASHED = 64  # columns of hashed language and source
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


# ------------------------------------------------------------- views
def text_view(text: str) -> list[float]:
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    counts = Counter(words)
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x]
    raw = np.frombuffer(text.encode(), np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    marks = int(((raw > 32) & (raw < 128)).sum()) - upper - digits - int(((raw >= 97) & (raw <= 122)).sum())
    return [len(counts) / n, max(counts.values(), default=0) / n, pairs / n, 1 - len(set(lines)) / max(len(lines), 1),
            marks / size, upper / size, digits / size, text.count("|") / n, text.count("!") / n,
            sum(map(text.count, "#$%&*=<>")) / n, (text.count(".") + text.count("?")) / n, len(lines) / n, size / n,
            float(np.log1p(len(words))), float(len(words) < 5)]


def meta_view(lang, source, n_chars) -> list[float]:
    hashed = [0.0] * HASHED
    for name, value in (("lang", lang), ("source", source)):
        hashed[zlib.crc32(f"{name}={value}".encode()) % HASHED] = 1.0
    size = np.log1p(max(float(n_chars), 0.0)) if n_chars is not None else 0.0
    return [*hashed, float(n_chars is None), float(size), float(size ** 2 / 10), float(size < 4), float(size < 5.5)]


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    cols = [batch.column(c).to_pylist() for c in COLUMNS[1:]]
    text = np.array([text_view(t or "") for t in cols[0]]).reshape(batch.num_rows, -1)
    meta = np.array([meta_view(*x) for x in zip(*cols[1:])]).reshape(batch.num_rows, -1)
    return text, meta


# ------------------------------------------------------------- classifiers
@dataclass
class Logistic:
    """Ridge logistic regression by Newton steps on standardised columns."""

    ridge: float = 1.0
    steps: int = 25

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], self.ridge)
        penalty[-1] = 1e-6
        for _ in range(self.steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z.T * (p * (1 - p) + 1e-6)) @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))]
        return z @ self.w


@dataclass
class Model:
    text: Logistic
    meta: Logistic
    calibration: tuple[Logistic, Logistic]
    joint: Logistic

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        both = np.c_[self.calibration[0].log_odds(self.text.log_odds(text)[:, None]),
                     self.calibration[1].log_odds(self.meta.log_odds(meta)[:, None])]
        return 1 / (1 + np.exp(-np.clip(self.joint.log_odds(both), -30, 30)))


# ------------------------------------------------------------- co-training on all unlabelled rows
BIN, BINS = 0.01, 3000  # the histogram of log odds: width, and bins on each side of 0


def _bins(odds: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(odds / BIN), -BINS, BINS - 1).astype(int)


def _lists(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def taught(history: list, views: tuple[np.ndarray, np.ndarray], u: np.ndarray) -> list[np.ndarray]:
    """Per view the labels that rows got from the other view in the rounds of
    ``history``, -1: none. ``u`` decides in the bin where the share ends."""
    labels = [np.full(len(u), -1.0), np.full(len(u), -1.0)]
    for models, cuts in history:
        for v in (0, 1):
            odds, free = models[v].log_odds(views[v]), labels[1 - v] < 0
            at, (top, top_part, low, low_part) = _bins(odds), cuts[v]
            labels[1 - v][free & (odds > 0) & ((at > top) | (at == top) & (u < top_part))] = 1.0
            labels[1 - v][free & (odds < 0) & ((at < low) | (at == low) & (u < low_part))] = 0.0
    return labels


def summed(rows: DataFrame, size: int, measure) -> np.ndarray:
    """Sum of ``measure(views, u)``, an array of ``size``, over all rows."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += measure((_lists(batch.column("text")), _lists(batch.column("meta"))), batch.column("u").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["k", "x"])

    out = np.zeros(size)
    for r in rows.select("text", "meta", "u").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


def _cut(counts: np.ndarray, wanted: int) -> tuple[int, float]:
    """Index of the bin, best first, where ``wanted`` rows are reached, and the
    part of that bin to take."""
    total = np.cumsum(counts)
    if not len(total) or wanted <= 0 or total[-1] <= wanted:
        return (len(counts), 0.0) if wanted > 0 else (-1, 0.0)
    k = int(np.searchsorted(total, wanted))
    return k, float((wanted - (total[k] - counts[k])) / counts[k])


def cutoffs(rows: DataFrame, history: list, models, n: int, positive: float) -> list[tuple]:
    """Per view the bins that hold the ``n`` rows it is surest about among the
    rows it has not handed over yet."""
    def measure(views, u):
        given, out = taught(history, views, u), []
        for v in (0, 1):
            odds = models[v].log_odds(views[v])
            out.append(np.bincount(_bins(odds[(given[1 - v] < 0) & (odds != 0)]) + BINS, minlength=2 * BINS))
        return np.concatenate(out)

    out = []
    for counts in summed(rows, 4 * BINS, measure).reshape(2, 2 * BINS):
        top, top_part = _cut(counts[:BINS - 1:-1], round(n * positive))
        low, low_part = _cut(counts[:BINS], round(n * (1 - positive)))
        out.append((BINS - 1 - top, top_part, low - BINS, low_part))
    return out


def fit_both(views, y: np.ndarray, rows: DataFrame, history: list, start) -> list[Logistic]:
    """Both classifiers on the labelled rows and what ``history`` hands over."""
    wide = [x.shape[1] for x in views]
    ends = np.cumsum([0, *[1 + 2 * d for d in wide]])

    def moments(x, y, v):
        return np.concatenate(([len(y)], x.sum(axis=0), (x * x).sum(axis=0)))

    def remote(size, each):
        def measure(views, u):
            label = taught(history, views, u)
            return np.concatenate([each(views[v][label[v] >= 0], label[v][label[v] >= 0], v) for v in (0, 1)])

        return summed(rows, size, measure)

    far, weight, models = remote(ends[-1], moments), [0.0, 0.0], [Logistic(), Logistic()]
    for v in (0, 1):
        part = far[ends[v]:ends[v + 1]]
        weight[v] = min(1.0, len(y) / max(part[0], 1.0))
        n, one, two = np.split(moments(views[v], y, v) + weight[v] * part, [1, 1 + wide[v]])
        models[v].mean = one / n
        models[v].scale = np.sqrt(np.maximum(two / n - models[v].mean ** 2, 0.0)) + 1e-9
        models[v].w = start[v].w.copy()

    def slope(x, y, v):
        """Gradient and Hessian without the ridge."""
        z = np.c_[np.clip((x - models[v].mean) / models[v].scale, -8, 8), np.ones(len(x))]
        p = 1 / (1 + np.exp(-np.clip(z @ models[v].w, -30, 30)))
        return np.concatenate((z.T @ (y - p), ((z.T * (p * (1 - p) + 1e-6)) @ z).ravel()))

    ends = np.cumsum([0, *[(d + 1) * (d + 2) for d in wide]])
    for _ in range(models[0].steps):
        far, moved = remote(ends[-1], slope), 0.0
        for v in (0, 1):
            total = slope(views[v], y, v) + weight[v] * far[ends[v]:ends[v + 1]]
            d = wide[v] + 1
            penalty = np.full(d, models[v].ridge)
            penalty[-1] = 1e-6
            step = np.linalg.solve(total[d:].reshape(d, d) + np.diag(penalty), total[:d] - penalty * models[v].w)
            models[v].w = models[v].w + step
            moved = max(moved, np.abs(step).max())
        if moved < 1e-6:
            break
    return models


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, rows: DataFrame,
             rounds: int = 5, share: float = 0.05) -> tuple[list[Logistic], list]:
    """Each round, each view hands the other the ``share`` of the unlabelled
    ``rows`` it is surest about, positives and negatives as among the labels.
    Gives the classifiers and what was handed over in the rounds."""
    views, history = (text, meta), []
    models = [Logistic().fit(views[v], y) for v in (0, 1)]
    n = int(share * rows.count())
    for _ in range(rounds if n else 0):
        history = [*history, (models, cutoffs(rows, history, models, n, y.mean()))]
        models = fit_both(views, y, rows, history, models)
    return models, history


def train(text, meta, y, aside, rows) -> Model:
    (first, second), _ = co_train(text[~aside], meta[~aside], y[~aside], rows)
    held = aside if len(set(y[aside])) > 1 else ~aside
    odds = (first.log_odds(text[held])[:, None], second.log_odds(meta[held])[:, None])
    calibration = tuple(Logistic(ridge=0.01).fit(o, y[held]) for o in odds)
    both = np.c_[calibration[0].log_odds(odds[0]), calibration[1].log_odds(odds[1])]
    return Model(first, second, calibration, Logistic(ridge=0.01).fit(both, y[held]))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, u (a hash of it from 0 to 1) and both views."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                text, meta = _views(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("u"), pa.array(list(text), pa.list_(pa.float64())),
                     pa.array(list(meta), pa.list_(pa.float64()))], names=["doc_id", "u", "text", "meta"])

    u = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:], u.alias("u"))
            .mapInArrow(run, "doc_id long, u double, text array<double>, meta array<double>"))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> Model | None:
    """Co-train on a bounded sample of the labels and all unlabelled rows;
    ``labels``: doc_id, quality. Collects only the feature rows of the sample."""
    docs = docs.select(*COLUMNS).where(F.col("doc_id").isNotNull() & ~held_out())
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("label")))
    # bounded by the parameter: small enough to broadcast
    scratch = Scratch(docs.sparkSession)
    picked = scratch.save(sample_by_hash(known.where(~held_out()), "label", per_class).select("doc_id", "label"), "picked")
    # one row of a repeated id, so that the sample stays bounded
    sample = scratch.save(docs.join(F.broadcast(picked), "doc_id", "left_semi")
                          .groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
                          .select("doc_id", "row.*"), "sample")
    label = {r["doc_id"]: r["label"] for r in picked.collect()}
    known_rows = measured(sample).collect()
    y = np.array([label[r["doc_id"]] for r in known_rows], float)
    aside = np.array([zlib.crc32(b"aside%d" % r["doc_id"]) % 5 == 0 for r in known_rows], bool)
    if len(set(y[~aside])) < 2:
        scratch.drop()
        return None
    rest = scratch.save(measured(docs).join(known, "doc_id", "left_anti"), "rest")
    model = train(np.array([r["text"] for r in known_rows]), np.array([r["meta"] for r in known_rows]), y, aside, rest)
    scratch.drop()
    return model


# ------------------------------------------------------------- operator
def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = model.score(*_views(part)) if model else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        "lang", "source", F.col("n_chars").cast("double").alias("n_chars"), held_out().alias("held_out"))
            .mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int"))

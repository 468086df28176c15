"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed byte n-grams (letters
lower-cased, everything that is not a letter as a space); a linear softmax
gives the language. Embeddings and softmax are trained together by stochastic
gradient descent in numpy on a bounded sample (``per_language`` documents of
each language, never the held-out fifth). Because the model is linear after
averaging, it is applied as one table of logits per n-gram bucket.

Part of the sample is kept aside to fit a temperature, which makes the scores
probabilities, and the confidence below which a document is rejected: at most
``reject_share`` of the kept-aside documents would fall below it, and it is
never above one and a half times chance, so that only texts the model can make
nothing of are rejected.

Odd input: null text or text without a letter gets ``und`` with score 0 and is
rejected; repeated rows get equal answers; an empty table gives an empty
result; if there is nothing to learn from, every text gets ``und``; extra
columns are ignored or kept, a name that clashes with an output raises.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm.common import held_out, sample_by_hash, slices

ORDERS = (2, 3, 4)  # bytes of an n-gram
BITS = 15  # buckets: 2 ** BITS
UNDETERMINED = "und"
SLICE_BYTES = 1 << 19


# ------------------------------------------------------------- features
def _letters() -> np.ndarray:
    """Byte map: ASCII letters lower-cased, other ASCII to space."""
    table = np.full(256, 32, np.uint32)
    table[128:] = np.arange(128, 256)
    table[97:123] = np.arange(97, 123)
    table[65:91] = table[97:123]
    return table


LETTERS = _letters()


def buckets(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte of ``data`` (uint32)."""
    n = len(data) - order + 1
    h = np.full(max(n, 0), 0x811C9DC5 + order, np.uint32)
    for k in range(order):
        h = (h ^ data[k:n + k]) * np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)


def _spread(texts: pa.Array):
    """Slices (lo, hi, bytes with a space after each text, first byte of each)."""
    raw = pc.utf8_lower(texts.cast(pa.string())).cast(pa.binary())
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in raw], np.int64)
    for lo, hi in slices(sizes, SLICE_BYTES):
        parts = [x or b"" for x in raw.slice(lo, hi - lo).to_pylist()]
        first = np.concatenate(([0], np.cumsum(sizes[lo:hi] + 1)))
        yield lo, hi, LETTERS[np.frombuffer(b" ".join(parts) + b" ", np.uint8)], first


def counted(docs: DataFrame) -> DataFrame:
    """(lang, buckets, counts) of each document; the lists as packed bytes,
    because the driver collects them for the sample."""
    def count(batches):
        for batch in batches:
            for lo, hi, data, first in _spread(batch.column("text")):
                grams = [buckets(data, n) for n in ORDERS]
                ids, counts = [], []
                for a, b in zip(first[:-1], first[1:]):
                    idx, n = np.unique(np.concatenate([g[a:max(a, b - k)] for g, k in zip(grams, ORDERS)]), return_counts=True)
                    ids.append(idx.astype("<i4").tobytes())
                    counts.append(n.astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(lo, hi - lo), pa.array(ids, pa.binary()),
                     pa.array(counts, pa.binary())], names=["lang", "ids", "counts"])

    return docs.select("lang", "text").mapInArrow(count, "lang string, ids binary, counts binary")


# ------------------------------------------------------------- model
@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # per bucket and language
    bias: np.ndarray
    reject_below: float

    def probabilities(self, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = sums / np.maximum(n, 1)[:, None] + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], width: int = 16, epochs: int = 5, rate: float = 0.2,
          batch: int = 32, reject_share: float = 0.001, seed: int = 5) -> Model:
    """Fit embeddings and softmax by SGD; a fifth of the rows calibrates."""
    languages = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    aside, rows = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    emb = rng.normal(0, 0.1, (1 << BITS, width)).astype(np.float32)
    seen = np.full(emb.shape, 1e-10, np.float32)  # per-weight step size, as n-gram counts differ by orders
    out, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    code = {x: i for i, x in enumerate(languages)}

    def average(ids, counts):
        return (counts / counts.sum()) @ emb[ids] if len(ids) else np.zeros(width, np.float32)

    steps, step = epochs * (len(rows) // batch + 1), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), batch):
            lr = rate * (1 - step / steps)
            step += 1
            part = [rows[i] for i in order[k:k + batch]]
            x = np.array([average(i, c) for _, i, c in part])
            z = x @ out + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [code[r[0]] for r in part]] -= 1
            back = p @ out.T
            out -= lr * x.T @ p
            bias -= lr * p.mean(axis=0)
            for g, (_, ids, counts) in zip(back, part):  # ids are distinct within a document
                if len(ids):
                    grad = (counts / counts.sum())[:, None] * g
                    seen[ids] += grad * grad
                    emb[ids] -= lr * grad / np.sqrt(seen[ids])
    x = np.array([average(i, c) for _, i, c in aside])
    y = np.array([code[r[0]] for r in aside])
    z = x @ out + bias

    def softmax(t):
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.1, 10, 41)
    heat = min(grid, key=lambda t: -np.log(softmax(t)[np.arange(len(y)), y] + 1e-9).mean())
    sure = softmax(heat).max(axis=1)
    return Model(languages, (emb @ out / heat).astype(np.float32), (bias / heat).astype(np.float32),
                 float(min(1.5 / len(languages), np.quantile(sure, reject_share))))


def fit(docs: DataFrame, per_language: int = 300, most_languages: int = 1000, **options) -> Model | None:
    """Train on at most about ``per_language`` documents of each language
    whose id is not held out, of the ``most_languages`` languages with the most
    documents (ties: by name); others cannot be predicted. Collects only the
    sample's n-gram counts."""
    usable = docs.select("doc_id", "lang", "text").where(
        ~held_out() & F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0))
    rows = [(r["lang"], np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<f4"))
            for r in counted(sample_by_hash(usable, "lang", per_language, most_strata=most_languages)).collect()]
    return train(rows, **options) if rows else None


# ------------------------------------------------------------- operator
OUTPUT = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model | None, columns: list[str], names: tuple[str, str, str] = OUTPUT) -> DataFrame:
    """``columns`` of every document plus lang_pred, score and rejected, under
    ``names``. Raises if a column has one of these names already."""
    if taken := sorted({n.lower() for n in names} & {c.lower() for c in columns}):
        raise ValueError(f"the documents have a column {', '.join(taken)} already: choose other names")
    shape = docs.select(*columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema)
    own = [f"_rf_{i}" for i in range(len(columns))]

    def classify(batches):
        for batch in batches:
            text = batch.column("_rf_text").cast(pa.string())
            written = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang = np.full(len(text), UNDETERMINED, object)
            score, rejected = np.zeros(len(text)), np.ones(len(text), bool)
            for lo, hi, data, first in _spread(text) if model is not None else ():
                sums = np.zeros((hi - lo, len(model.languages)))
                n = np.zeros(hi - lo)
                for order in ORDERS:
                    gram = buckets(data, order)
                    ends = np.minimum(np.maximum(first[:-1], first[1:] - order), len(gram))
                    picked = model.logits[gram].cumsum(axis=0, dtype=np.float64)
                    picked = np.concatenate((np.zeros((1, picked.shape[1])), picked))
                    start = np.minimum(first[:-1], len(gram))
                    sums += picked[ends] - picked[start]
                    n += ends - start
                p = model.probabilities(sums, n)
                best = p.argmax(axis=1)
                ok = written[lo:hi]
                lang[lo:hi][ok] = np.array(model.languages, object)[best[ok]]
                score[lo:hi][ok] = p.max(axis=1)[ok]
                rejected[lo:hi][ok] = score[lo:hi][ok] < model.reject_below
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in own] + [pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)],
                names=[*columns, *names])

    renamed = docs.select(*[F.col(c).alias(o) for c, o in zip(columns, own)], F.col("text").cast("string").alias("_rf_text"))
    return renamed.mapInArrow(classify, schema + ", `{}` string, `{}` double, `{}` boolean".format(*names))

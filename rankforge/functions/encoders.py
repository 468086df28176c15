"""Model-free text encoders written as column expressions.

They stand in for a trained dense encoder in tests and fixtures (a real model
plugs in through ``functions.models.DenseEncoder``). The
hashed bag-of-words vector puts each word token in one of ``dim`` buckets by
a simple character rule, counts, and is then sliced and normalised like any
embedding. Everything stays in the JVM (higher-order array functions).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankforge.functions.text import word_tokens

# ---- fixed values: bucket rule multipliers of the two stand-in models ----
HASH_MODELS = {"a": (31, 7), "b": (17, 13)}
# ---- end of fixed values ----


def token_bucket(t: Column, dim: int, model: str = "a") -> Column:
    m1, m2 = HASH_MODELS[model]
    return (F.ascii(t) * m1 + F.length(t) * m2 + F.ascii(F.reverse(t))) % F.lit(int(dim))


def _bucket_counts(buckets: Column, dim: int) -> Column:
    # count per bucket with the native array_remove (higher-order lambdas are
    # interpreted, so one lambda call per bucket instead of per token x bucket)
    return F.transform(F.sequence(F.lit(0), F.lit(int(dim) - 1)),
                       lambda i: (F.size(buckets) - F.size(F.array_remove(buckets, i))).cast("double"))


def hashed_bow_table(df, id_col: str, text, dim: int = 64, model: str = "a", null_as: str = ""):
    """(id, embedding) for a table: tokenise once into a column (Arrow-batched
    NFKD helper + JVM regexp), bucket once per token, count per bucket."""
    toks = df.select(id_col, word_tokens(text, null_as=null_as).alias("__toks"))
    buckets = toks.select(id_col, F.transform("__toks", lambda t: token_bucket(t, dim, model)).alias("__b"))
    return buckets.select(id_col, _bucket_counts(F.col("__b"), dim).alias("embedding"))


# ---------------------------------------------------------------- Python forms
# The same stand-in models as plain Python callables, for the batch-inference
# surfaces (UDF-1/2/4) that take a user model: they run in the worker
# exactly where a real model would.
def make_hashed_bow_encoder(dim: int = 64, model: str = "a", prefix: str = ""):
    """Factory for ``encode(texts) -> (n, dim)`` counts of hashed tokens."""
    import numpy as np
    from rankforge.functions.text import word_tokens_py

    m1, m2 = HASH_MODELS[model]

    def encode(texts):
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, text in enumerate(texts):
            for t in word_tokens_py(prefix + ("" if text is None else str(text))):
                out[i, (ord(t[0]) * m1 + len(t) * m2 + ord(t[-1])) % dim] += 1.0
        return out
    return encode


def log_tf_encoder(texts):
    """Sparse stand-in model: {token: ln(1 + tf)} per text."""
    import math
    from collections import Counter
    from rankforge.functions.text import word_tokens_py
    return [{t: math.log1p(c) for t, c in Counter(word_tokens_py(x)).items()} for x in texts]


def make_overlap_scorer():
    """Factory for ``predict(queries, texts) -> scores``: the token-overlap
    stand-in of a cross-encoder."""
    import numpy as np
    from rankforge.functions.text import word_tokens_py

    def predict(queries, texts):
        out = np.zeros(len(queries), dtype=np.float64)
        for i, (q, t) in enumerate(zip(queries, texts)):
            qs, ts = set(word_tokens_py(q)), set(word_tokens_py(t))
            shared = len(qs & ts)
            out[i] = (shared / len(qs) if qs else 0.0) + shared * 0.001
        return out
    return predict

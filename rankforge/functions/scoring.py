"""Scalar scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rrf_term(rank0, k=60, weight=1.0) -> Column:
    """SCL-10: weight * (1 / (k + rank + 1)) for a 0-based rank (this float
    order, as the candidate generator computes it). ``k`` and ``weight`` may
    be numbers or columns (per-run grids, EXP-2)."""
    kk = k if isinstance(k, Column) else F.lit(int(k))
    ww = weight if isinstance(weight, Column) else F.lit(float(weight))
    return ww.cast("double") * (F.lit(1.0) / (kk + _col(rank0) + F.lit(1)).cast("double"))


def gain(grade) -> Column:
    """SCL-12: 2^g - 1."""
    return F.pow(F.lit(2.0), _col(grade).cast("double")) - F.lit(1.0)


def discount(position1) -> Column:
    """SCL-12: log2(i + 1) for a 1-based position (= log2(i0 + 2))."""
    return F.log2(_col(position1).cast("double") + F.lit(1.0))


def bm25_idf(n_docs, doc_freq) -> Column:
    """SCL-11: ln((N - df + 0.5) / (df + 0.5) + 1)."""
    n = _col(n_docs).cast("double")
    d = _col(doc_freq).cast("double")
    return F.log((n - d + F.lit(0.5)) / (d + F.lit(0.5)) + F.lit(1.0))


def bm25_tf_part(tf, dl, avgdl, k1: float, b: float) -> Column:
    """tf (k1+1) / (tf + k1 (1 - b + b dl / max(avgdl, 1e-9)))."""
    t = _col(tf).cast("double")
    norm = F.lit(1.0 - b) + F.lit(b) * _col(dl).cast("double") / F.greatest(_col(avgdl), F.lit(1e-9))
    return t * F.lit(k1 + 1.0) / (t + F.lit(k1) * norm)


def sparse_activation(logit) -> Column:
    """SCL-13 (one position): log(1 + relu(logit))."""
    return F.log1p(F.greatest(_col(logit).cast("double"), F.lit(0.0)))


def lift_pct(new, base) -> Column:
    """AGG-16: (new - base) / base * 100; null when base is 0 (ANSI safe)."""
    return F.try_divide(_col(new) - _col(base), _col(base)) * F.lit(100.0)

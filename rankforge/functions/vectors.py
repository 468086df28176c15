"""Vector column functions (all JVM higher-order functions, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(c) -> Column:
    return F.transform(_col(c), lambda x: x.cast("double"))


def prefix(c, dim: int | None) -> Column:
    """SCL-7: the first ``dim`` components (Matryoshka truncation)."""
    return _col(c) if dim is None else F.slice(_col(c), 1, int(dim))


def l2_norm(c) -> Column:
    return F.sqrt(F.aggregate(_col(c), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(c) -> Column:
    """SCL-8: x / max(||x||, 1e-10); a zero vector stays zero."""
    v = _col(c)
    norm = F.greatest(l2_norm(v), F.lit(NORM_FLOOR))
    return F.transform(v, lambda x: x / norm)


def prefix_normalized(c, dim: int | None) -> Column:
    """Slice, cast to double, re-normalise (what every dense search uses)."""
    return l2_normalize(as_double(prefix(c, dim)))


def dot(a, b) -> Column:
    """SCL-9: inner product (cosine after normalisation)."""
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)

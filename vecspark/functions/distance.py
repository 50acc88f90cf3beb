"""Vector scalar functions as Spark Column expressions (JVM side, codegen'd).

All sums run in DOUBLE and in element order (``aggregate`` over ``zip_with``),
which gives the same bits as the block-scan kernel and as ordered SQL list sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(v) -> Column:
    return _c(v).cast("array<double>")


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_sq(a, b) -> Column:
    """Squared Euclidean distance ``Σ (a_i - b_i)²``."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)))


def l2_sq_int(a, b) -> Column:
    """Integer squared L2 over integer codes (uint8 vectors), LONG accumulator."""
    return F.aggregate(F.zip_with(_c(a).cast("array<long>"), _c(b).cast("array<long>"),
                                  lambda x, y: (x - y) * (x - y)),
                       F.lit(0).cast("long"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def ip_dist(a, b) -> Column:
    """Inner-product distance ``1 - a·b``."""
    return F.lit(1.0) - dot(a, b)


def sq_norm(a) -> Column:
    return dot(a, a)


def cosine_dist(a, b) -> Column:
    """``1 - a·b / sqrt(|a|² |b|²)``; a zero norm counts as 1, as in the block scan."""
    n = F.sqrt(sq_norm(a) * sq_norm(b))
    return F.lit(1.0) - dot(a, b) / F.when(n == 0, F.lit(1.0)).otherwise(n)


def euclidean(a, b) -> Column:
    """Metric (non-squared) Euclidean distance."""
    return F.sqrt(l2_sq(a, b))


DISTANCES = {"l2": l2_sq, "ip": ip_dist, "cosine": cosine_dist}


def distance(metric: str, a, b) -> Column:
    """Distance by registered name (pluggable: add to ``DISTANCES``)."""
    return DISTANCES[metric](a, b)


def register_distance(name: str, fn) -> None:
    """Plug in a distance ``fn(Column, Column) -> Column`` under ``name``."""
    DISTANCES[name] = fn


def l2_normalize(v) -> Column:
    """Rows scaled to unit norm; a zero norm is treated as 1."""
    n = F.sqrt(sq_norm(v))
    n = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(as_double(v), lambda x: x / n)


def mismatch_count(a, b) -> Column:
    """Number of positions where two attribute arrays differ."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.when(x != y, 1).otherwise(0)),
                       F.lit(0), lambda acc, x: acc + x)


def fusion_mul(d, cnt, m: int) -> Column:
    """``d · (1 + cnt / m)``."""
    return _c(d) * (F.lit(1.0) + _c(cnt) / F.lit(float(m)))


def fusion_add(d, cnt, w: float) -> Column:
    """``d + cnt · w``."""
    return _c(d) + _c(cnt) * F.lit(float(w))


def tag_codes(tags, n_tags: int) -> Column:
    """Tag set → dense attribute code array: position j holds ``2j+1`` if tag j present else ``2j``."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_tags - 1)),
                       lambda j: F.when(F.array_contains(_c(tags), j), j * 2 + 1).otherwise(j * 2))


def sq8_encode(v, lo: Column, hi: Column) -> Column:
    """Uniform 8-bit code ``round(255 (x - lo) / (hi - lo))`` clamped to [0, 255]."""
    return F.transform(as_double(v), lambda x: F.least(F.greatest(
        F.round(F.lit(255.0) * (x - lo) / (hi - lo)), F.lit(0.0)), F.lit(255.0)).cast("int"))


def sq8_decode(codes, lo: Column, hi: Column) -> Column:
    return F.transform(_c(codes), lambda c: lo + c.cast("double") * (hi - lo) / F.lit(255.0))


def ip_lift(v) -> Column:
    """Append ``sqrt(1 - |v|²)`` so inner product becomes a cosine/L2 problem (needs |v| <= 1)."""
    return F.concat(as_double(v), F.array(F.sqrt(F.lit(1.0) - sq_norm(v))))

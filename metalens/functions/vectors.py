"""Vector expressions over two array columns on the same row.

Higher-order functions (``zip_with`` / ``aggregate``) keep these inside the
JVM; there is no cosine built-in in PySpark 4.1.2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a, b) -> Column:
    """``1 - cosine distance``; null if a vector has zero norm."""
    den = norm(a) * norm(b)
    return F.when(den > 0, dot(a, b) / den)


def euclidean_distance(a, b) -> Column:
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def kernel_similarity(a, b, gamma: float = 1.0) -> Column:
    """``exp(-gamma * ||a - b||)``: 1 for equal vectors, towards 0 when far."""
    return F.exp(F.lit(-gamma) * euclidean_distance(a, b))


def same_length(a, b) -> Column:
    """Shape check: both vectors have the same number of dimensions."""
    return F.size(_c(a)) == F.size(_c(b))

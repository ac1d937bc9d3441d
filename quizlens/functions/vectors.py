"""Dense-vector similarity as native higher-order functions.

Vectors are ``array<float>`` or ``array<double>``; everything is computed in
double, left to right, so the value is reproducible in any engine that sums
in the same order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizlens.functions.rounding import py_round1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(a, b) -> Column:
    """Dot product of two arrays, in double, left to right."""
    a = _c(a).cast("array<double>")
    b = _c(b).cast("array<double>")
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def sq_norm(a) -> Column:
    """Squared Euclidean norm of an array, in double."""
    a = _c(a).cast("array<double>")
    return _sum(F.transform(a, lambda x: x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; 0.0 when either side is null, empty or all zero
    (as scikit-learn's normalisation gives), never NaN."""
    na, nb = sq_norm(a), sq_norm(b)
    ok = (F.size(_c(a)) > 0) & (F.size(_c(b)) > 0) & (na > 0) & (nb > 0)
    return F.when(ok, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(0.0))


def similarity_score(a, b) -> Column:
    """Answer score: Python-rounded 100 x cosine, one decimal; may be < 0."""
    return py_round1(cosine(a, b) * 100.0)

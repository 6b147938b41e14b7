"""Distances between array columns, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(_fold(F.zip_with(a, b, square)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; NULL when a side is NULL or all zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1.0 - dot(a, b) / size)


def distance(a: Column, b: Column, metric: str) -> Column:
    if metric == "l2":
        return l2_distance(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")


def check_vector(vector: Sequence[float], what: str = "query_vector") -> list[float]:
    """The components as floats; at least one, and all of them finite numbers."""
    held = list(vector)
    wrong = [v for v in held if type(v) not in (int, float) and not isinstance(v, np.floating)]
    wrong = wrong or [v for v in held if not np.isfinite(v)]
    if wrong or not held:
        raise ValueError(f"{what}: a vector of finite numbers is needed, found {wrong[0] if wrong else 'nothing'!r}")
    return [float(v) for v in held]


def same_size(vector: Column, size: Column | int) -> Column:
    """``vector``, or an error where it has another number of components than ``size``."""
    wanted = F.lit(size) if isinstance(size, int) else size
    message = F.concat(F.lit("vector of "), F.size(vector), F.lit(" components, expected "), wanted)
    return F.when(vector.isNull() | (F.size(vector) == wanted), vector).otherwise(F.raise_error(message))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in vector])

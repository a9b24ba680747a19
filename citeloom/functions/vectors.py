"""Distances of ARRAY<DOUBLE> columns as built-in expressions, and a way in for any other metric."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.columns import let


def _fold(a: Column, b: Column, term) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; NaN if either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(float("nan"))).otherwise(1 - F.try_divide(dot(a, b), size))


def sqeuclidean(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqeuclidean(a, b))


def cityblock(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def chebyshev(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: F.greatest(s, x))


def minkowski(a: Column, b: Column, p: float = 2) -> Column:
    return F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p)))), F.lit(1 / p))


def correlation(a: Column, b: Column) -> Column:
    """The cosine distance of the vectors less their means; NaN where one doesn't vary."""
    centred = lambda v: let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred(a), lambda x: let(centred(b), lambda y: cosine(x, y)))


def canberra(a: Column, b: Column) -> Column:
    """Differences over sums of sizes; two zeros add nothing."""
    return _fold(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0.0)).otherwise(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y))))


def braycurtis(a: Column, b: Column) -> Column:
    """The sum of differences over that of sums; NaN where these are 0."""
    below = _fold(a, b, lambda x, y: F.abs(x + y))
    return F.when(below == 0, F.lit(float("nan"))).otherwise(F.try_divide(cityblock(a, b), below))


def hamming(a: Column, b: Column) -> Column:
    """The share of places that differ."""
    return _fold(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    """The share of places that differ among those where one is not 0; 0 where both are all zero."""
    used = _fold(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1.0).otherwise(0.0))
    return F.when(used == 0, F.lit(0.0)).otherwise(F.try_divide(_fold(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)), used))


def sized(a: Column) -> Column:
    """(vec, size) of `a`, its length NaN if it is all zero."""
    return let(norm(a), lambda size: F.struct(a.alias("vec"), F.when(size == 0, F.lit(float("nan"))).otherwise(size).alias("size")))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    f.__name__: f for f in (cosine, euclidean, sqeuclidean, cityblock, chebyshev, minkowski, correlation, canberra, braycurtis, hamming, jaccard)
}


def prepared(of: str | Callable) -> tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]:
    """(what to do with each vector once, the distance of two vectors so prepared). For the cosine every vector is measured once.

    The quotient is the one of `cosine` and of the SQL, to the last bit: a distance that is 0 but for rounding keeps the sign that it has there."""
    if of == "cosine":
        return sized, (lambda a, b: 1 - dot(a["vec"], b["vec"]) / (a["size"] * b["size"]))
    return (lambda a: a), metric(of)


def metric(of: str | Callable) -> Callable[[Column, Column], Column]:
    """A metric by name, or a Python function of two vectors, run in Arrow batches."""
    if isinstance(of, str):
        if of not in METRICS:
            raise ValueError(f"no metric {of}; known are {', '.join(sorted(METRICS))}")
        return METRICS[of]

    @F.pandas_udf("double")
    def call(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(of(x, y)) for x, y in zip(a, b)])

    return call

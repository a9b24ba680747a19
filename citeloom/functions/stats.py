"""Quantiles and moments as NumPy defines them, with NaN that poisons instead of sorting last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The percentiles of a distance distribution.
PERCENTILES = (100, 99, 95, 90, 80, 50, 20, 10, 5, 1, 0)
NAN = float("nan")


def valid(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & ~c.isin(float("inf"), float("-inf"))


def quantile(value: str, p: float, times: str | None = None) -> Column:
    """The linearly interpolated p-quantile; NaN if any value is NaN. times: a column of multiplicities."""
    weight = f", {times}" if times else ""
    return F.when(F.max(F.isnan(value)), F.lit(NAN)).otherwise(F.expr(f"percentile({value}, {p}D{weight})"))


def distribution(value: str) -> list[Column]:
    """Aggregates: n, mean, population deviation and one column p<k> per percentile."""
    bad = F.max(F.isnan(value))
    all_ = F.percentile(value, F.array(*[F.lit(p / 100.0) for p in PERCENTILES]))
    out = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(bad, F.lit(NAN)).otherwise(F.stddev_pop(value)).alias("sd")]
    return out + [F.when(bad, F.lit(NAN)).otherwise(all_[k]).alias(f"p{p}") for k, p in enumerate(PERCENTILES)]


def negative_log(c: Column) -> Column:
    """-ln(x), +Inf at 0 where Spark's ln gives null."""
    return F.when(c == 0, F.lit(float("inf"))).otherwise(-F.log(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))

"""A few keys holding most records (problem 4): aggregates over joins without ever forming the joined rows.

Both inputs are reduced by the join key (map-side first, so a hot key leaves each task as one row), the compact
states are joined, and counts are multiplied and sums combined. The result equals the aggregate over the plain join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import stored


def _state(df: DataFrame, keys: list[str], sums: dict[str, Column], extremes: dict[str, Column], weight: Column | None, side: str) -> DataFrame:
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    aggs = [F.sum(w).alias(f"_{side}_n")]
    aggs += [F.sum(c * w).alias(f"_{side}_s_{k}") for k, c in sums.items()]
    aggs += [a for k, c in extremes.items() for a in (F.min(c).alias(f"_{side}_lo_{k}"), F.max(c).alias(f"_{side}_hi_{k}"))]
    return df.groupBy(*keys).agg(*aggs)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    by: Sequence[str],
    left_sums: dict[str, Column] | None = None,
    right_sums: dict[str, Column] | None = None,
    right_extremes: dict[str, Column] | None = None,
    left_weight: Column | None = None,
    how: str = "inner",
) -> DataFrame:
    """SELECT by, count(*), sum(..), min(..), max(..) FROM left JOIN right USING (on) GROUP BY by.

    `by` are columns of left. left_weight: a LONG column by which a left row counts several times (an array not exploded).
    Gives `by`, n_rows, n_matched, sum_<k> for each sum, min_<k> and max_<k> for each extreme of the right side.
    how: 'inner' or 'left'; with 'left', rows without a match count once in n_rows and not in n_matched. Null join keys never match;
    null `by` keys form a group, as in SQL. Sums skip null values and are null where all are null.
    Of tables with clashing names only the named columns are used. Empty inputs give no rows.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    left_sums, right_sums, right_extremes = left_sums or {}, right_sums or {}, right_extremes or {}
    on, by = list(on), list(by)
    lhs = _state(left, list(dict.fromkeys(on + by)), left_sums, {}, left_weight, "l")
    rhs = _state(right, on, right_sums, right_extremes, None, "r")
    joined = lhs.join(rhs, on, how)
    many = F.coalesce(F.col("_r_n"), F.lit(1))
    out = [
        F.sum(F.col("_l_n") * many).alias("n_rows"),
        F.coalesce(F.sum(F.col("_l_n") * F.col("_r_n")), F.lit(0)).alias("n_matched"),
    ]
    out += [F.sum(F.col(f"_l_s_{k}") * many).alias(f"sum_{k}") for k in left_sums]
    out += [F.sum(F.col(f"_r_s_{k}") * F.col("_l_n")).alias(f"sum_{k}") for k in right_sums]
    out += [a for k in right_extremes for a in (F.min(f"_r_lo_{k}").alias(f"min_{k}"), F.max(f"_r_hi_{k}").alias(f"max_{k}"))]
    return joined.groupBy(*by).agg(*out)


def heavy_keys(per_key: DataFrame, key: str, weight: str, share: float) -> DataFrame:
    """(key, weight) of a per-key result whose weight is at least `share` of the weight of all keys (share as a fraction, compared exactly in parts per million)."""
    per_key = stored(per_key.select(key, weight))  # read for the total and for the keys
    total = per_key.agg(F.sum(weight).alias("t"))
    ppm = round(share * 1_000_000)
    return per_key.filter(F.col(weight).cast("decimal(38,0)") * 1_000_000 >= total.scalar().cast("decimal(30,0)") * ppm)

"""Writing collections, networks and results: Parquet by year, each year replaced as a whole, so a repeated run changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_years(df: DataFrame, path: str) -> None:
    """`df` below <path>/year=<year>; only the years it has are replaced. Rows of a year are gathered by year, split by AQE where they are many."""
    df.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def result_key(variable: str, indicator: str, window: int | None = None, reuse: int | None = None, percentile: float | None = None) -> str:
    """The name of a result, e.g. items_commonness or items_reuse_3_1_restricted50."""
    key = f"{variable}_{indicator}"
    if window is not None:
        key += f"_{window}_{1 if reuse is None else reuse}" + ("" if percentile is None else f"_restricted{percentile:g}")
    return key


def write_result(scores: DataFrame, path: str, key: str) -> None:
    """A score frame with doc_id and year, below <path>/<key>/year=<year>."""
    write_years(scores, f"{path}/{key}")


def write_json_years(df: DataFrame, path: str, key: str) -> None:
    """Results as JSON lines by year: {doc_id, <key>: {the other columns}}, NaN and infinities as they are."""
    body = F.struct(*[c for c in df.columns if c not in ("doc_id", "year")])
    df.select("doc_id", "year", body.alias(key)).repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").json(path)

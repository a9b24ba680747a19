"""Ranks within groups of any size, without ever bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.runtime import cut, spread

#: Parts of a group that are numbered apart, by the first two digits of the keys.
DIGITS = 2


def ranked_by_hash(df: DataFrame, group: Sequence[str], key: str | Column, tie: str, name: str) -> DataFrame:
    """`df` with `name`: the 1-based place in its group by `key`, a hash in hexadecimal digits, then by `tie`. A key given as an expression is not shuffled.

    Hashes are spread evenly, so the first digits part a group of any size into parts of known order: each part is numbered for itself, and the small
    table of their sizes gives what stands before it. Nothing is written and no group comes into one task. Null group keys form a group.
    The rows are shuffled once: parts are structs, in which nulls are equal, so the sizes meet them where they were numbered. They are never broadcast,
    as estimates of their size don't see the explosions that made them.
    """
    made = F.col(key) if isinstance(key, str) else key
    parted = df.withColumn("_part", F.struct(*group, F.conv(F.substring(made, 1, DIGITS), 16, 10).cast("int").alias("_digits")))
    dealt = spread(parted.drop(*group), "_part").select("*", *[F.col(f"_part.{g}").alias(g) for g in group]).withColumn("_key", made)
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy("_key", tie))).drop("_key")
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*[f"_part.{g}" for g in group]).orderBy("_part._digits").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(spread(offsets, "_part").hint("merge"), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """`df` with `name`: the 1-based place in its group by `order`.

    The rows are range-partitioned and numbered inside their partition; a small table of rows per (partition, group) gives what
    stands before it. `order` should be unique within a group, otherwise ties take either place. Null group keys form a group.
    The sizes meet the rows where they were numbered, so neither is broadcast: left to sizes at run time, the rows are what goes through the driver if
    they are known first.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *group, *order).withColumn("_at", F.spark_partition_id()))
    parted = placed.withColumn("_part", F.struct("_at", *group)).drop("_at")
    local = parted.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*([f"_part.{g}" for g in group] or [F.lit(0)])).orderBy("_part._at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(offsets.hint("merge"), "_part").withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop("_part", "_local", "_before")

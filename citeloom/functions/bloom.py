"""Bloom filters that stay inside the JVM: Catalyst's own aggregate and probe, as used by Spark's runtime join filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per key (about 1 % false positives), the bits of one filter that Spark allows (8 MiB), and the most filters; each holds the keys of one hash bucket.
BITS_PER_KEY, MAX_BITS, MAX_FILTERS = 10, 1 << 26, 8


def _expr(df: DataFrame, col: Column):
    return df.sparkSession._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(col._jc)


def _bucket(key: Column, filters: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(filters)), F.lit(filters))


def bloom_filters(df: DataFrame, key: str, expected: int, max_bits: int = MAX_BITS, max_filters: int = MAX_FILTERS) -> list[bytes]:
    """Filters over `key` of a frame of `expected` rows, by one distributed aggregate: as many as hold BITS_PER_KEY bits a key, one per hash bucket.

    Together they have at most max_filters * max_bits bits (64 MiB), however many keys there are. About 1 in 100 absent keys passes up to 50 million
    keys, 1 in 10 at 110 million, half at 270 million; the exact check behind the filters removes these. Null keys are left out.
    """
    jvm = df.sparkSession._jvm
    expected = max(1, int(expected))
    filters = min(max_filters, -(-expected * BITS_PER_KEY // max_bits))
    each = -(-expected // filters)
    bits = min(max(1024, each * BITS_PER_KEY), max_bits)
    made = []
    for k in range(filters):
        hashed = F.when(_bucket(F.col(key), filters) == k, F.xxhash64(F.col(key)))  # null for the keys of other buckets, which the aggregate skips
        agg = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate(
            _expr(df, hashed), _expr(df, F.lit(min(each, max_bits // 2)).cast("long")), _expr(df, F.lit(bits).cast("long"))
        )
        made.append(Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(agg.toAggregateExpression())).alias(f"f{k}"))
    row = df.filter(F.col(key).isNotNull()).agg(*made).first()
    return [bytes(f) if f is not None else b"" for f in row]


def might_contain(df: DataFrame, filters: list[bytes], key: Column) -> Column:
    """False where the key is proven absent. The filters enter as constants, so Spark ships them once with the tasks. df: any frame of the session."""
    jvm, out = df.sparkSession._jvm, F.lit(False)
    for k, f in enumerate(filters):
        if f:
            probe = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(_expr(df, F.lit(f)), _expr(df, F.xxhash64(key)))
            out = F.when(_bucket(key, len(filters)) == k, Column(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(probe))).otherwise(out)
    return F.coalesce(out, F.lit(False))

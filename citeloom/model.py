"""Canonical shapes. Field names of a source are given once, when it is turned into these frames.

doc_items   (doc_id LONG, year INT, item STRING, item_year INT)   one row per occurrence: a multiset
item_counts (doc_id LONG, year INT, item STRING, n LONG)
doc_pairs   (doc_id LONG, year INT, i STRING, j STRING, n LONG)   i <= j, n = how often the pair is in the document
cooc        (year INT, i STRING, j STRING, w LONG)                i <= j
citations   (citing LONG, cited LONG), papers (doc_id LONG, year INT)
authorship  (doc_id LONG, year INT, pos INT, author_id LONG)
vectors     (doc_id LONG, year INT, vec ARRAY<DOUBLE>)

A null or missing array means that the document contributes nothing; null and empty items, and documents without a year, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents with fewer item occurrences get no co-occurrence score.
MIN_ITEMS = 3

ITEMS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("item", T.StringType()), T.StructField("year", T.IntegerType())]))),
    ]
)
CITATIONS_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("refs", T.ArrayType(T.LongType()))])
TEXTS_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("year", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType())])


def doc_items(df: DataFrame, items: str, item: str, item_year: str | None = "year", doc: str = "id", year: str = "year") -> DataFrame:
    """doc_items from one row per document with an array of structs."""
    got = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(year).cast("int").alias("year"), F.explode(items).alias("e"))
    own_year = F.col(f"e.{item_year}").cast("int") if item_year else F.lit(None).cast("int")
    return got.select("doc_id", "year", F.col(f"e.{item}").alias("item"), own_year.alias("item_year")).filter("year is not null and doc_id is not null and item <> ''")


def citations(df: DataFrame, refs: str = "refs", doc: str = "id") -> DataFrame:
    """Distinct citation edges from one row per document with an array of cited ids. Self-citations and nulls are left out."""
    got = df.select(F.col(doc).cast("long").alias("citing"), F.explode(refs).alias("cited"))
    return got.select("citing", F.col("cited").cast("long")).filter("citing <> cited").distinct()


def abstract_text(column: str, field: T.DataType, part: str = "AbstractText"):
    """An abstract that is a string, or the first element's `part` of an array of structs, by the schema's type."""
    return F.get(F.col(column), F.lit(0))[part] if isinstance(field, T.ArrayType) else F.col(column)

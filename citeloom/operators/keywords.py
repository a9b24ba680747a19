"""Scores from a document's keywords: the share of new ones and the variety of their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyword_novelty(df: DataFrame, terms: str, doc: str = "id", year: str = "year", term_year: str = "year") -> DataFrame:
    """(doc_id, year, novelty_kw): keywords of the document's own year among all its keywords. Without keywords or a year there is no row."""
    each = df.select(F.col(doc).alias("doc_id"), F.col(year).alias("year"), F.explode(terms).alias("t")).filter("year is not null and t is not null")
    own = F.coalesce(F.col(f"t.{term_year}") == F.col("year"), F.lit(False)).cast("int")
    return each.groupBy("doc_id", "year").agg((F.sum(own) / F.count("*")).alias("novelty_kw"))


def keyword_diversity(df: DataFrame, terms: str, doc: str = "id", year: str = "year", category: str = "category") -> DataFrame:
    """(doc_id, year, diversity_kw): different categories among all categories of the document's keywords. Without categories there is no row."""
    each = df.select(F.col(doc).alias("doc_id"), F.col(year).alias("year"), F.explode(terms).alias("t")).filter("year is not null")
    cats = each.select("doc_id", "year", F.explode(f"t.{category}").alias("c")).filter("c is not null")
    per = cats.groupBy("doc_id", "year", "c").agg(F.count("*").alias("n"))
    return per.groupBy("doc_id", "year").agg((F.count("*") / F.sum("n")).alias("diversity_kw"))


def tree_prefixes(numbers):
    """The distinct first two steps of tree numbers such as B05.051.300, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(numbers, lambda x: x.isNotNull()), lambda x: F.substring_index(x, ".", 2))))

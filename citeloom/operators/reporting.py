"""Descriptive statistics of collections and of scores: the frames behind the plots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.stats import valid


def doc_counts(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, n_docs) of frames that have a row per document."""
    out = None
    for name, df in collections.items():
        one = df.agg(F.count("*").alias("n_docs")).select(F.lit(name).alias("collection"), "n_docs")
        out = one if out is None else out.unionByName(one)
    return out


def doc_counts_by_year(collections: dict[str, DataFrame]) -> DataFrame:
    """(collection, year, n_docs); documents without a year are left out."""
    out = None
    for name, df in collections.items():
        one = df.filter("year is not null").groupBy("year").agg(F.count("*").alias("n_docs")).select(F.lit(name).alias("collection"), "year", "n_docs")
        out = one if out is None else out.unionByName(one)
    return out


def papers_per_author(author_lists: DataFrame) -> DataFrame:
    """(n_papers, n_authors) of author_papers, below the 99th percentile of list lengths."""
    sizes = author_lists.select(F.size("doc_list").alias("n_papers"))
    limit = sizes.agg(F.percentile("n_papers", F.lit(0.99)))
    return sizes.filter(F.col("n_papers") < limit.scalar()).groupBy("n_papers").agg(F.count("*").alias("n_authors"))


def entity_statistics(lists: DataFrame) -> DataFrame:
    """(n_entities, n_documents, mean) of entity_documents: how many there are and how many documents they have, in one row."""
    n = F.size("doc_list")
    return lists.agg(F.count("*").alias("n_entities"), F.coalesce(F.sum(n), F.lit(0)).alias("n_documents"), F.avg(n).alias("mean"))


def list_sizes(df: DataFrame, array: str, by: list[str]) -> DataFrame:
    """(by, n_docs, mean, variance): sizes of an array per document, with the population variance. Null arrays are left out."""
    got = df.filter(F.col(array).isNotNull() & F.col("year").isNotNull()).withColumn("_n", F.size(array))
    return got.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("_n").alias("mean"), F.var_pop("_n").alias("variance"))


def list_size_density(df: DataFrame, array: str) -> DataFrame:
    """(size, n_docs): how many documents have an array of each size, below the 99th percentile of sizes. Null arrays are left out."""
    sizes = df.filter(F.col(array).isNotNull()).select(F.size(array).alias("size"))
    limit = sizes.agg(F.percentile("size", F.lit(0.99)))
    return sizes.filter(F.col("size") < limit.scalar()).groupBy("size").agg(F.count("*").alias("n_docs"))


def field_availability(df: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """(by, n_docs, n_<field> ...): how many documents have each field."""
    return df.groupBy(*by).agg(F.count("*").alias("n_docs"), *[F.count(f).alias(f"n_{f}") for f in fields])


def trend(scores: DataFrame, value: str) -> DataFrame:
    """(year, n, mean): the yearly mean of a score over its valid values; null, NaN and infinities are masked."""
    return scores.filter(valid(F.col(value))).groupBy("year").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def long_scores(scores: dict[tuple[str, str], DataFrame], values: dict[tuple[str, str], str]) -> DataFrame:
    """(doc_id, year, indicator, variable, score) of several score frames, by {(indicator, variable): frame} and the column of each."""
    out = None
    for (indicator, variable), df in scores.items():
        one = df.select("doc_id", "year", F.lit(indicator).alias("indicator"), F.lit(variable).alias("variable"), F.col(values[indicator, variable]).cast("double").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def score_distribution(scores: DataFrame) -> DataFrame:
    """(indicator, variable, n, mean, sd, least, most) over the valid scores of long_scores."""
    kept = scores.filter(valid(F.col("score")))
    return kept.groupBy("indicator", "variable").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"), F.min("score").alias("least"), F.max("score").alias("most"))


def correlations(scores: DataFrame, per_year: bool = True, log: bool = False, names: list[str] | None = None) -> DataFrame:
    """([year,] a, b, n, r): Pearson correlations of every two indicators over the documents that have both, joined by document.

    scores: long_scores; names: '<variable>_<indicator>' of all of them, which are looked up in the scores if not given; invalid values are left out. With log, log(score + 1) of scores above -1. r is null where a side doesn't vary or n < 2.
    """
    kept = scores.filter(valid(F.col("score"))).withColumn("_k", F.concat_ws("_", "variable", "indicator"))
    if log:
        kept = kept.filter("score > -1").withColumn("score", F.log1p("score"))
    if names is None:
        names = [r[0] for r in scores.select(F.concat_ws("_", "variable", "indicator").alias("k")).distinct().collect()]  # one per indicator, not per document
    if len(names) < 2:
        raise ValueError("a correlation needs two indicators")
    wide = kept.groupBy("doc_id", "year").pivot("_k", sorted(names)).agg(F.first("score"))
    by = ["year"] if per_year else []
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in combinations(sorted(names), 2)])
    flat = wide.select(*by, F.explode(cells).alias("c")).select(*by, "c.*").filter("x is not null and y is not null")
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    return flat.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.when(varies, F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))).alias("r"))

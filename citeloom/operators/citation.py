"""Citation networks and the disruption indices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.stats import ratio
from citeloom.operators.ranking import ranked
from citeloom.runtime import stored

#: Works whose citers are counted by bits, at most, and citers from which a work is one of them.
HUBS, HUB_CITERS = 18, 500


def reverse_index(citations: DataFrame) -> DataFrame:
    """(doc_id, cited_by): the sorted citing documents of each cited one. For output; the indices below use the edges."""
    return citations.groupBy(F.col("cited").alias("doc_id")).agg(F.array_sort(F.collect_list("citing")).alias("cited_by"))


def reverse_chunks(citations: DataFrame, size: int = 10_000) -> DataFrame:
    """(doc_id, chunk_no, cited_by): reverse_index in rows of at most `size` citing documents, numbered from 0 in their order, so that no work is too
    large for a row. citations must be distinct."""
    placed = ranked(citations, ["cited"], ["citing"], "at").withColumn("chunk_no", ((F.col("at") - 1) / size).cast("int"))
    return placed.groupBy(F.col("cited").alias("doc_id"), "chunk_no").agg(F.array_sort(F.collect_list("citing")).alias("cited_by"))


def network(papers: DataFrame, citations: DataFrame) -> DataFrame:
    """(doc_id, year, refs, cited_by): one row per document, empty arrays where there is nothing."""
    refs = citations.groupBy(F.col("citing").alias("doc_id")).agg(F.array_sort(F.collect_list("cited")).alias("refs"))
    none = F.array().cast("array<bigint>")
    got = papers.join(refs, "doc_id", "left").join(reverse_index(citations), "doc_id", "left")
    return got.select("doc_id", "year", F.coalesce("refs", none).alias("refs"), F.coalesce("cited_by", none).alias("cited_by"))


def union_sizes(counts: dict[int, int], bits: int) -> np.ndarray:
    """For every mask of `bits` bits, how many of the counted masks share a bit with it."""
    within = np.zeros(1 << bits, np.int64)
    within[list(counts)] = list(counts.values())
    for b in range(bits):  # becomes the number of masks within each mask
        halves = within.reshape(-1, 2, 1 << b)
        halves[:, 1] += halves[:, 0]
    return sum(counts.values()) - within[::-1]  # the complement of a mask lies at its place from the end


def disruption_counts(papers: DataFrame, citations: DataFrame, focal: int, hub_citers: int = HUB_CITERS) -> DataFrame:
    """(doc_id, year, n_i, n_j, n_k, n_j5, shared, depth, breadth) of every document of the focal year.

    C cites the document; R, of the focal year or later, cites one of its references. J = C and R, I = C - J, K = R - J;
    shared sums the common references over C and n_j5 counts those of C with more than four. depth counts documents of C that cite
    another of C, breadth the others. citations must be distinct. Citers without a row in papers have no year and count in C only.

    R is never formed for the works everybody cites: the HUBS most cited ones with `hub_citers` citers or more become bits, the later documents
    are counted by the bits they cite (2 ** HUBS numbers), and only citers of the other references are joined, without those counted already.
    """
    spark = citations.sparkSession
    citations, papers = stored(citations), stored(papers)  # read by many joins below
    degree = citations.groupBy("cited").agg(F.count("*").alias("n")).filter(F.col("n") >= hub_citers)
    hubs = [r[0] for r in degree.orderBy(F.desc("n"), "cited").limit(HUBS).select("cited").collect()]
    bit = F.lit(0)
    for k, hub in enumerate(hubs):
        bit = F.when(F.col("cited") == hub, F.lit(1 << k)).otherwise(bit)
    masks = citations.filter(F.col("cited").isin(hubs)).groupBy(F.col("citing").alias("c")).agg(F.bit_or(bit).alias("mask")) if hubs else None
    late = papers.filter(F.col("year") >= focal).select(F.col("doc_id").alias("c"))
    mine = papers.filter(F.col("year") == focal).select("doc_id", "year")
    f = mine.select(F.col("doc_id").alias("f"))

    # who cites the document, and how many references they share with it
    c = citations.join(f, citations["cited"] == F.col("f")).select("f", F.col("citing").alias("c"))
    refs = citations.join(f, citations["citing"] == F.col("f")).select("f", F.col("cited").alias("r"))
    of_citers = c.join(citations.select(F.col("citing").alias("c"), F.col("cited").alias("r")), "c")
    shared = of_citers.join(refs, ["f", "r"]).groupBy("f", "c").agg(F.count("*").alias("shared"))
    known = c.join(shared, ["f", "c"], "left").join(late.withColumn("late", F.lit(True)), "c", "left")
    count = lambda x: F.sum(F.when(x, 1).otherwise(0))
    main = known.groupBy("f").agg(
        F.count("*").alias("n_c"), count((F.col("shared") > 0) & F.col("late")).alias("n_j"), count(F.col("shared") > 4).alias("n_j5"), F.sum(F.coalesce("shared", F.lit(0))).alias("shared")
    )
    deep = of_citers.join(c.select("f", F.col("c").alias("r")), ["f", "r"], "left_semi").groupBy("f").agg(F.countDistinct("c").alias("depth"))

    # how many later documents cite one of its references
    near = refs.filter(~F.col("r").isin(hubs)) if hubs else refs
    hop = near.join(citations.select(F.col("cited").alias("r"), F.col("citing").alias("c")), "r").filter("c <> f").select("f", "c").distinct().join(late, "c", "left_semi")
    if hubs:
        own = masks.withColumnRenamed("c", "f").withColumnRenamed("mask", "own")
        hop = hop.join(masks, "c", "left").join(own, "f", "left").filter((F.coalesce("mask", F.lit(0)).bitwiseAND(F.coalesce("own", F.lit(0)))) == 0)
        counts = {r[0]: r[1] for r in masks.join(late, "c", "left_semi").groupBy("mask").agg(F.count("*")).collect()}  # at most 2 ** HUBS rows
        sizes = spark.createDataFrame(pd.DataFrame({"own": np.arange(1 << len(hubs), dtype=np.int32), "n_hub": union_sizes(counts, len(hubs))}))
        of_hubs = f.join(own, "f").join(F.broadcast(sizes), "own").select("f", (F.col("n_hub") - 1).alias("n_hub"))  # without the document itself
    else:
        of_hubs = f.select("f", F.lit(0).alias("n_hub"))
    near_count = hop.groupBy("f").agg(F.count("*").alias("n_near"))

    out = f.join(main, "f", "left").join(deep, "f", "left").join(near_count, "f", "left").join(of_hubs, "f", "left").join(mine.withColumnRenamed("doc_id", "f"), "f")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).cast("long")
    return out.select(
        F.col("f").alias("doc_id"),
        "year",
        (zero("n_c") - zero("n_j")).alias("n_i"),
        zero("n_j").alias("n_j"),
        (zero("n_near") + zero("n_hub") - zero("n_j")).alias("n_k"),
        zero("n_j5").alias("n_j5"),
        zero("shared").alias("shared"),
        zero("depth").alias("depth"),
        (zero("n_c") - zero("depth")).alias("breadth"),
    )


def disruption_indices(counts: DataFrame) -> DataFrame:
    """(doc_id, year, di1, di5, di1nok, di5nok, dein, breadth, depth) from disruption_counts; 0 where a denominator is 0."""
    i, j, k, j5 = (F.col(n) for n in ("n_i", "n_j", "n_k", "n_j5"))
    return counts.select(
        "doc_id",
        "year",
        ratio(i - j, i + j + k).alias("di1"),
        ratio(i - j5, i + j5 + k).alias("di5"),
        ratio(i - j, i + j).alias("di1nok"),
        ratio(i - j5, i + j5).alias("di5nok"),
        ratio(F.col("shared"), i + j).alias("dein"),
        ratio(F.col("breadth"), i + j).alias("breadth"),
        ratio(F.col("depth"), i + j).alias("depth"),
    )

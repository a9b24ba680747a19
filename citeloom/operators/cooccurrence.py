"""Scores from co-occurring items: commonness, new and reused combinations, atypicality, crossing of communities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.stats import NAN, negative_log, quantile
from citeloom.model import MIN_ITEMS
from citeloom.operators import pairs as P
from citeloom.operators.ranking import ranked, ranked_by_hash
from citeloom.runtime import cut, stored

# ---- commonness: observed over expected


def commonness_pairs(cooc: DataFrame, margin: DataFrame | None = None, total: DataFrame | None = None) -> DataFrame:
    """(year, i, j, w, s): s = w * N / (N_i * N_j) within each year, N the year's weight and N_i the item's, its diagonal counted once.

    margin (year, item, n) and total (year, nt) are taken from the network itself unless given, as pairs.marginals and pairs.yearly_weight do without forming pairs.
    """
    if margin is None:
        ends = cooc.select("year", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("item"), "w")
        margin = ends.groupBy("year", "item").agg(F.sum("w").alias("n"))
    if total is None:
        total = cooc.groupBy("year").agg(F.sum("w").alias("nt"))
    return (
        cooc.join(F.broadcast(total), "year")  # one row per year
        .join(margin.select("year", F.col("item").alias("i"), F.col("n").alias("ni")), ["year", "i"])
        .join(margin.select("year", F.col("item").alias("j"), F.col("n").alias("nj")), ["year", "j"])
        .select("year", "i", "j", "w", (F.col("w").cast("double") * F.col("nt") / (F.col("ni").cast("double") * F.col("nj"))).alias("s"))
    )


def commonness(items: DataFrame, min_items: int = MIN_ITEMS, density: bool = False) -> DataFrame:
    """(doc_id, year, novelty[, scores]): -ln of the 10 % quantile of the document's pair scores, for every year at once."""
    bags = stored(P.item_bags(P.numbered(P.item_counts(items))))  # read for pairs, marginals and weights
    pairs = P.doc_pairs(None, bags=bags)
    aggs = [quantile("s", 0.1, "n").alias("q")] + ([P.score_array().alias("scores")] if density else [])
    scores = commonness_pairs(P.cooccurrence(pairs), P.marginals(None, bags), P.yearly_weight(None, bags))
    return P.document_scores(pairs, scores, min_items, aggs).withColumn("novelty", negative_log(F.col("q"))).drop("q")


# ---- new combinations that are reused, weighted by difficulty


def new_pairs(cooc: DataFrame, focal: int, start: int | None = None) -> DataFrame:
    """(i, j): pairs of the focal year that no year of [start, focal) has."""
    return cooc.filter(F.col("year") == focal).select("i", "j").filter("i < j").join(P.window_sum(cooc, start, focal), ["i", "j"], "left_anti")


def reused_pairs(cooc: DataFrame, focal: int, window: int, times: int = 1) -> DataFrame:
    """(i, j, w): pairs that the `window` years after the focal year have at least `times` times."""
    return P.window_sum(cooc, focal + 1, focal + window + 1).filter("i < j").filter(F.col("w") >= times)


def pair_cosine(pairs: DataFrame, network: DataFrame) -> DataFrame:
    """(i, j, cos) of the given pairs: cosine of the rows of the symmetric network. Pairs without a common neighbour are left out.

    Only the rows that the pairs name are joined, never all against all.
    """
    both = network.select(F.col("i").alias("a"), F.col("j").alias("k"), "w").unionByName(network.filter("i <> j").select(F.col("j").alias("a"), F.col("i").alias("k"), "w"))
    size = both.groupBy("a").agg(F.sqrt(F.sum(F.col("w").cast("double") * F.col("w"))).alias("size"))
    x = pairs.join(both.select(F.col("a").alias("i"), "k", F.col("w").alias("wi")), "i")
    dots = x.join(both.select(F.col("a").alias("j"), "k", F.col("w").alias("wj")), ["j", "k"]).groupBy("i", "j").agg(F.sum(F.col("wi").cast("double") * F.col("wj")).alias("dot"))
    sized = dots.join(size.select(F.col("a").alias("i"), F.col("size").alias("si")), "i").join(size.select(F.col("a").alias("j"), F.col("size").alias("sj")), "j")
    return sized.select("i", "j", (F.col("dot") / (F.col("si") * F.col("sj"))).alias("cos"))


def pair_cosine_in_parts(pairs: DataFrame, network: DataFrame, cells: int = 2_000_000) -> DataFrame:
    """pair_cosine where items are numbers (int) and so many pairs are wanted that their rows must not be shuffled.

    Rows of the symmetric network are dealt into parts of about `cells` cells each by item; every two parts meet in one task with the pairs between them. So a cell is
    sent as often as there are parts, whatever the number of pairs, and a task never holds more than two parts.
    """
    both = stored(network.select(F.col("i").alias("a"), F.col("j").alias("k"), "w").unionByName(network.filter("i <> j").select(F.col("j").alias("a"), F.col("i").alias("k"), "w")))
    spark, parts = network.sparkSession, 1 + both.count() // cells
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, min(4, tasks))  # sixteen groups keep the cores busy
    part = lambda c: F.pmod(F.hash(c), F.lit(parts))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    of = both.select("a", "k", F.col("w").cast("double").alias("w"), part(F.col("a")).alias("own"))
    as_i = of.select("a", "k", "w", F.col("own").alias("p"), F.explode(every).alias("q"), F.lit(0).alias("side"))
    as_j = of.select("a", "k", "w", F.explode(every).alias("p"), F.col("own").alias("q"), F.lit(1).alias("side"))
    rows = as_i.unionByName(as_j)
    wanted = pairs.select("i", "j", part(F.col("i")).alias("p"), part(F.col("j")).alias("q"))

    def cosines(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = (left.column(c).to_numpy() for c in "ij")
        a, k, w, side = (right.column(c).to_numpy() for c in ("a", "k", "w", "side"))
        found = ([], [], [])
        if len(i) and len(a):
            sides = []
            names, k = np.unique(k, return_inverse=True)
            for s in (0, 1):
                mine = np.flatnonzero(side == s)
                mine = mine[np.argsort(a[mine], kind="stable")]
                own, start = np.unique(a[mine], return_index=True)
                sides.append((own, np.append(start, len(mine)), k[mine], w[mine]))
            (own_i, at_i, k_i, w_i), (own_j, at_j, k_j, w_j) = sides
            size_i = np.sqrt(np.add.reduceat(w_i * w_i, at_i[:-1])) if len(own_i) else w_i
            size_j = np.sqrt(np.add.reduceat(w_j * w_j, at_j[:-1])) if len(own_j) else w_j
            full = np.zeros(len(names))
            order = np.argsort(i, kind="stable")
            firsts, starts = np.unique(i[order], return_index=True)
            for item, b, e in zip(firsts, starts, [*starts[1:], len(i)]):
                x = np.searchsorted(own_i, item)
                if x == len(own_i) or own_i[x] != item:
                    continue
                others = j[order[b:e]]
                y = np.searchsorted(own_j, others)
                known = y < len(own_j)
                known[known] = own_j[y[known]] == others[known]
                row = slice(at_i[x], at_i[x + 1])
                full[k_i[row]] = w_i[row]
                for y, other in zip(y[known], others[known]):
                    dot = full[k_j[at_j[y] : at_j[y + 1]]] @ w_j[at_j[y] : at_j[y + 1]]
                    if dot > 0:
                        for out, v in zip(found, (item, other, dot / (size_i[x] * size_j[y]))):
                            out.append(v)
                full[k_i[row]] = 0
        return pa.table({"i": pa.array(found[0], pa.int32()), "j": pa.array(found[1], pa.int32()), "cos": pa.array(found[2], pa.float64())})

    return wanted.groupBy("p", "q").cogroup(rows.groupBy("p", "q")).applyInArrow(cosines, "i int, j int, cos double")


def difficulty_pairs(cooc: DataFrame, focal: int, window: int, times: int = 1, start: int | None = None, orthogonal_as_zero: bool = True) -> DataFrame:
    """(i, j, s): 1 - cos of the items' neighbourhoods in the `window` years before, for new and reused pairs.

    A pair without common neighbours scores 0, or 1 if orthogonal_as_zero is off.
    """
    wanted = new_pairs(cooc, focal, start).join(reused_pairs(cooc, focal, window, times).select("i", "j"), ["i", "j"], "left_semi")
    cos = pair_cosine(wanted, P.window_sum(cooc, focal - window, focal))
    none = 0.0 if orthogonal_as_zero else 1.0
    return wanted.join(cos, ["i", "j"], "left").select("i", "j", F.coalesce(1 - F.col("cos"), F.lit(none)).alias("s"))


def reuse_novelty(
    items: DataFrame, focal: int, window: int, times: int = 1, start: int | None = None, percentile: float = 50, min_items: int = MIN_ITEMS, density: bool = False, orthogonal_as_zero: bool = True
) -> DataFrame:
    """(doc_id, year, novelty[, scores]): the sum of difficulty_pairs over a focal document's distinct pairs of frequent items.

    Frequent are items at or above the given percentile of occurrences in the three years before; pairs of others don't count.
    """
    counts = P.numbered(P.item_counts(items))
    pairs = P.doc_pairs(counts, weighted=False)
    # read by four windows below, so it is written once instead of formed four times
    cooc = cut(P.cooccurrence(pairs.filter(F.col("year") <= focal + window)))
    frequency = counts.filter(F.col("year").between(focal - 3, focal - 1)).groupBy("item").agg(F.sum("n").alias("n"))
    frequent = P.restricted_items(frequency, percentile)
    documents = counts.filter(F.col("year") == focal).groupBy("doc_id", "year").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_items).select("doc_id", "year")
    scores = difficulty_pairs(cooc, focal, window, times, start, orthogonal_as_zero)
    for end in ("i", "j"):
        scores = scores.join(frequent.select(F.col("item").alias(end)), end, "left_semi")
    mine = pairs.filter(F.col("year") == focal).join(scores, ["i", "j"])
    got = mine.groupBy("doc_id", "year").agg(F.sum("s").alias("novelty"), P.score_array().alias("scores"))
    out = documents.join(got, ["doc_id", "year"], "left").withColumn("novelty", F.coalesce("novelty", F.lit(0.0)))
    return out if density else out.drop("scores")


# ---- atypicality against networks shuffled within item years


def shuffled_items(items: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """(k, doc_id, year, slot, item_year, item): in each of `samples` samples the items of all places of one (year, item year) permuted among them.

    Places are numbered by (document, item, occurrence). The permutation orders them by md5 of 'seed:k:place', so it is the same
    everywhere. Items without an item year stay out. No stratum is brought into one task.
    """
    known = items.filter("item_year is not null")
    same = known.groupBy("doc_id", "year", "item", "item_year").agg(F.count("*").alias("m"))
    each = same.select("doc_id", "year", "item", "item_year", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("occ"))
    slots = stored(ranked(each, ["year", "item_year"], ["doc_id", "item", "occ"], "slot"))
    drawn = slots.select("year", "item_year", "item", "slot", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("k"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "k", "slot").cast("binary"))
    drawn = ranked_by_hash(drawn, ["k", "year", "item_year"], key, "slot", "place")
    places = slots.select("doc_id", "year", "item_year", "slot").hint("merge")  # estimates don't see how many samples there are
    return drawn.select("k", "year", "item_year", "item", F.col("place").alias("slot")).join(places, ["year", "item_year", "slot"]).select("k", "doc_id", "year", "slot", "item_year", "item")


def _moments(sampled: DataFrame, samples: int, *more: Column) -> DataFrame:
    """(year, i, j, sum_w, sum_w2, mean, sd[, more]) of pairs.sampled_pairs."""
    w = F.when(F.col("k") > 0, F.col("w")).otherwise(F.lit(0))
    got = sampled.groupBy("part", "year", "i", "j").agg(F.sum(w).alias("sum_w"), F.sum(w * w).alias("sum_w2"), *more).drop("part")
    spread = F.lit(samples) * F.col("sum_w2") - F.col("sum_w") * F.col("sum_w")
    return got.withColumn("mean", F.col("sum_w") / F.lit(float(samples))).withColumn("sd", F.sqrt(spread.cast("double")) / F.lit(float(samples)))


def sample_moments(shuffled: DataFrame, samples: int) -> DataFrame:
    """(year, i, j, sum_w, sum_w2, mean, sd) over all samples, absent ones counted as 0; sd is the population's and exactly 0 if all are equal."""
    return _moments(P.sampled_pairs(shuffled), samples)


def moments(items: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """sample_moments of shuffled_items, for which items are numbers until the end."""
    items, names = P.coded(items)
    return P.named(sample_moments(shuffled_items(items, samples, seed), samples), names, "i", "j")


def atypicality_pairs(cooc: DataFrame, moments: DataFrame) -> DataFrame:
    """(year, i, j, s): the z-score of every observed pair; NaN where the samples don't vary, also where none has the pair."""
    got = cooc.join(moments.select("year", "i", "j", "mean", "sd").hint("merge"), ["year", "i", "j"], "left")
    return got.select("year", "i", "j", _z())


def _z() -> Column:
    return F.when(F.col("sd") > 0, (F.col("w") - F.col("mean")) / F.col("sd")).otherwise(F.lit(NAN)).alias("s")


def atypicality(items: DataFrame, samples: int = 20, seed: int = 0, min_items: int = MIN_ITEMS, density: bool = False) -> DataFrame:
    """(doc_id, year, conventionality, novelty[, scores]): median and 10 % quantile of the document's z-scores; one NaN makes both NaN.

    The observed network goes along as sample 0, so that scores are made where the pairs of the samples are summed.
    """
    items, _ = P.coded(items)
    pairs = P.doc_pairs(P.item_counts(items))
    every = shuffled_items(items, samples, seed).select("k", "doc_id", "year", "item").unionByName(items.select(F.lit(0).alias("k"), "doc_id", "year", "item"))
    seen = F.sum(F.when(F.col("k") == 0, F.col("w")).otherwise(F.lit(0))).alias("w")
    scores = _moments(P.sampled_pairs(every), samples, seen).filter("w > 0").select("year", "i", "j", _z())
    aggs = [quantile("s", 0.5, "n").alias("conventionality"), quantile("s", 0.1, "n").alias("novelty")] + ([P.score_array().alias("scores")] if density else [])
    return P.document_scores(pairs, scores, min_items, aggs)


# ---- combinations that cross communities


def crossing(items: DataFrame, focal: int, communities: DataFrame, min_items: int = MIN_ITEMS, density: bool = False) -> DataFrame:
    """(doc_id, year, novelty[, scores]): the share of a focal document's pairs whose items lie in different communities.

    communities: (item, community STRING); an item without one is a community of its own. Pairs of equal items never cross.
    """
    mine = items.filter(F.col("year") == focal)
    pairs = P.doc_pairs(P.item_counts(mine)).filter(F.col("size") >= min_items).drop("size")
    for end in ("i", "j"):
        of = communities.select(F.col("item").alias(end), F.col("community").alias(f"c_{end}"))
        # marked, so that a lone item can't fall together with a community of the same name
        pairs = pairs.join(of, end, "left").withColumn(f"c_{end}", F.coalesce(F.concat(F.lit("c:"), f"c_{end}"), F.concat(F.lit("i:"), end)))
    pairs = pairs.withColumn("s", F.when(F.col("c_i") != F.col("c_j"), 1.0).otherwise(0.0))
    extra = [P.score_array().alias("scores")] if density else []
    return pairs.groupBy("doc_id", "year").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("novelty"), *extra)

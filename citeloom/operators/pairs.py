"""Item pairs of documents and yearly co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.ranking import ranked
from citeloom.runtime import broadcast_if_fits, spread, stored


def item_counts(items: DataFrame) -> DataFrame:
    """item_counts from doc_items."""
    return items.groupBy("doc_id", "year", "item").agg(F.count("*").alias("n"))


def numbered(counts: DataFrame) -> DataFrame:
    """item_counts with a number in place of each item, for scores that don't show their items: pairs of numbers are a fraction of the bytes of pairs of
    texts, and pairs are by far the most rows. The numbers are stored, so they are the same wherever they are read."""
    counts = stored(counts)
    names = stored(counts.select("item").distinct().withColumn("_number", F.monotonically_increasing_id()))
    return counts.join(broadcast_if_fits(names), "item").select("doc_id", "year", F.col("_number").alias("item"), "n")


def coded(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_items with an item's place in byte order instead of its text, the stored table (item, idx) of these numbers); numbers order as their texts do."""
    items = stored(items)
    names = stored(item_index(items).withColumn("idx", F.col("idx").cast("int")))
    return items.join(broadcast_if_fits(names), "item").select("doc_id", "year", F.col("idx").alias("item"), "item_year"), names


def named(df: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """`df` with the texts of the numbers of `coded` in the given columns."""
    order, names = df.columns, broadcast_if_fits(names)
    for c in columns:
        df = df.join(names.select(F.col("idx").alias(c), F.col("item").alias("_text")), c).drop(c).withColumnRenamed("_text", c)
    return df.select(*order)


def sampled_pairs(shuffled: DataFrame) -> DataFrame:
    """(part, k, year, i, j, w): the weighted network of each sample k from one row per item occurrence (k, doc_id, year, item); rows of one `part` are in one task.

    Pairs are by far the most rows, so they are never shuffled: a document's items go to each part that one of them is hashed to, and every part forms
    the pairs whose first item is its own. What sums by part and further columns afterwards is not shuffled either.
    """
    parts = int(shuffled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bags = spread(shuffled, "k", "doc_id").groupBy("k", "doc_id", "year").agg(F.sort_array(F.collect_list("item")).alias("bag")).filter(F.size("bag") > 1)
    own = lambda item: F.pmod(F.hash(item), F.lit(parts))
    sent = bags.select("k", "year", "bag", F.explode(F.array_distinct(F.transform(F.expr("slice(bag, 1, size(bag) - 1)"), own))).alias("part")).repartitionById(parts, "part")
    first = sent.select("part", "k", "year", "bag", F.posexplode("bag").alias("at", "i")).filter(own(F.col("i")) == F.col("part"))
    pairs = first.select("part", "k", "year", "i", F.explode(F.slice("bag", F.col("at") + 2, F.size("bag"))).alias("j"))
    return pairs.groupBy("part", "k", "year", "i", "j").agg(F.count("*").alias("w"))


def item_bags(counts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """([extra,] doc_id, year, bag, size): a document's items in order with their multiplicities, and its item occurrences."""
    keys = [*extra, "doc_id", "year"]
    return spread(counts, *keys[:-1]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("item", "n"))).alias("bag"), F.sum("n").alias("size"))


def doc_pairs(counts: DataFrame | None, weighted: bool = True, self_loop: bool = True, extra: tuple[str, ...] = (), bags: DataFrame | None = None) -> DataFrame:
    """doc_pairs from item_counts, by multiplicities: m_i * m_j, and m_i * (m_i - 1) / 2 on the diagonal; `size` is the document's item occurrences.

    Unweighted, every pair of different items counts once and there is no diagonal. extra: further key columns (a sample number).
    A document's items come together once, hashed by document; the pairs are generated from there without a join. bags: item_bags, if they are there already.
    """
    keys = [*extra, "doc_id", "year", "size"]
    first = (item_bags(counts, extra) if bags is None else bags).select(*keys, "bag", F.posexplode("bag").alias("at", "a"))
    rest = first.select(*keys, "a", F.explode(F.slice("bag", F.col("at") + 1, F.size("bag"))).alias("b"))
    same = F.col("a.item") == F.col("b.item")
    if weighted:
        n = F.when(same, F.expr("a.n * (a.n - 1) div 2")).otherwise(F.col("a.n") * F.col("b.n"))
        kept = rest if self_loop else rest.filter(~same)
    else:
        n, kept = F.lit(1).cast("long"), rest.filter(~same)
    return kept.select(*keys, F.col("a.item").alias("i"), F.col("b.item").alias("j"), n.alias("n")).filter("n > 0")


def marginals(counts: DataFrame | None, bags: DataFrame | None = None) -> DataFrame:
    """(year, item, n) of the weighted network with loops: an item's weight with its diagonal counted once.

    Summed per document as m * (size - m) + m * (m - 1) / 2, so no pair is formed.
    """
    each = (item_bags(counts) if bags is None else bags).select("year", "size", F.explode("bag").alias("a"))
    part = F.col("a.n") * (F.col("size") - F.col("a.n")) + F.expr("a.n * (a.n - 1) div 2")
    return each.select("year", F.col("a.item").alias("item"), part.alias("p")).groupBy("year", "item").agg(F.sum("p").alias("n")).filter("n > 0")


def yearly_weight(counts: DataFrame | None, bags: DataFrame | None = None) -> DataFrame:
    """(year, nt): the weight of each year's weighted network with loops: size * (size - 1) / 2 summed over documents."""
    return (item_bags(counts) if bags is None else bags).groupBy("year").agg(F.sum(F.expr("size * (size - 1) div 2")).alias("nt"))


def cooccurrence(pairs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """cooc from doc_pairs."""
    return pairs.groupBy(*extra, "year", "i", "j").agg(F.sum("n").alias("w"))


def window_sum(cooc: DataFrame, start: int | None, stop: int) -> DataFrame:
    """(i, j, w) summed over start <= year < stop; start None means all years before stop. An empty window is empty."""
    kept = cooc.filter(F.col("year") < stop)
    if start is not None:
        kept = kept.filter(F.col("year") >= start)
    return kept.groupBy("i", "j").agg(F.sum("w").alias("w"))


def item_index(items: DataFrame) -> DataFrame:
    """(item, idx): every item once, numbered from 0 in byte order."""
    return ranked(items.select("item").distinct(), [], ["item"], "idx").withColumn("idx", F.col("idx") - 1)


def item_frequency(items: DataFrame, start: int, stop: int) -> DataFrame:
    """(item, n): occurrences in start <= year < stop, with multiplicity."""
    return items.filter(F.col("year").between(start, stop - 1)).groupBy("item").agg(F.count("*").alias("n"))


def restricted_items(frequency: DataFrame, percentile: float = 50) -> DataFrame:
    """The items of item_frequency whose count is at least the given percentile of all counts."""
    limit = frequency.agg(F.percentile("n", F.lit(percentile / 100.0)).alias("p"))
    return frequency.filter(F.col("n") >= limit.scalar())


def restricted_items_by_year(items: DataFrame, percentile: float = 50, back: int = 3) -> DataFrame:
    """(year, item): for every year the restricted_items of the `back` years before, all years in one job, for a sink by year. Years without items before are absent."""
    ahead = items.select("item", F.explode(F.sequence(F.col("year") + 1, F.col("year") + back)).alias("year"))
    frequency = ahead.groupBy("year", "item").agg(F.count("*").alias("n"))
    limit = frequency.groupBy("year").agg(F.percentile("n", F.lit(percentile / 100.0)).alias("p"))
    return frequency.join(F.broadcast(limit), "year").filter(F.col("n") >= F.col("p")).select("year", "item")  # one row per year


def document_scores(pairs: DataFrame, scores: DataFrame, min_items: int, aggregates: list[Column], by_year: bool = True) -> DataFrame:
    """Joins the pairs of every document of `min_items` or more item occurrences to their scores (0 where there is none) and aggregates per document.

    pairs: doc_pairs; scores: ([year,] i, j, s). Both sides are products of an explosion that size estimates don't see, so neither is ever broadcast.
    """
    on = ["year", "i", "j"] if by_year else ["i", "j"]
    kept = pairs.filter(F.col("size") >= min_items).drop("size")
    return kept.join(scores.select(*on, "s").hint("merge"), on, "left").withColumn("s", F.coalesce("s", F.lit(0.0))).groupBy("doc_id", "year").agg(*aggregates)


def only_ids(scores: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Scores of the wanted documents only; None wants all. Applied to results, so that it never changes a score."""
    if ids is None:
        return scores
    return scores.join(ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")


def score_array() -> Column:
    """The sorted scores of a document's pairs, each as often as its pair occurs."""
    return F.array_sort(F.flatten(F.collect_list(F.array_repeat("s", F.col("n").cast("int")))))



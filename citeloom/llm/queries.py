"""The pN_ queries of this subpackage: problems 1, 3, 6, 8, 9 and 10. Each takes (spark, root) and reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import canonical, frequency, leaks, packing, stuffing, together
from citeloom.runtime import broadcast_if_fits, broadcast_if_small, side_by_side, stored, table

#: field_name -> (table, array column, value)
FIELDS = {"journal": ("ref_journals", "cr_year_category", "journal"), "descui": ("mesh_terms", "mesh_year_category", "descui")}


def filled(c: Column) -> Column:
    return c.isNotNull() & (F.length(F.trim(c)) > 0)


def values_of(spark: SparkSession, root: str, field: str) -> DataFrame:
    """(id, vals): the filled values of each record, once per record however often it was delivered."""
    name, array, value = FIELDS[field]
    rows = table(spark, root, name).select("id", F.col(f"{array}.{value}").alias("vals")).dropDuplicates(["id"])
    return rows.select("id", F.filter("vals", filled).alias("vals")).filter(F.size("vals") > 0)


def _entries(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "ref_journals").select("id", F.col("cr_year_category.journal").alias("vals")).dropDuplicates(["id"])
    return rows.select("id", F.posexplode("vals").alias("pos", "value")).filter(filled(F.col("value")))


def _listed(spark: SparkSession, root: str) -> list[tuple[int, str, str]]:
    """The journal list."""
    return [tuple(r) for r in table(spark, root, "wos_jcr").select("jcr_id", "title20", "journal_title").toLocalIterator()]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    listed = _listed(spark, root)
    as_listed = table(spark, root, "wos_jcr").select(F.col("title20").alias("value"))
    typed = stored(_entries(spark, root).join(broadcast_if_small(as_listed, len(listed)), "value", "left_anti"))  # read for the values and for their places
    found = broadcast_if_fits(stored(canonical.canonical_values(typed, "value", listed)))
    return typed.join(found, "value").select("id", "pos", F.col("entry").alias("jcr_id"))


def p1_values(spark: SparkSession, root: str) -> DataFrame:
    """Each distinct typed value with its journal, and how often it was typed."""
    entries = _entries(spark, root)
    found = canonical.canonical_values(entries, "value", _listed(spark, root))
    return entries.groupBy("value").agg(F.count("*").alias("n_entries")).join(found, "value").select("value", F.col("entry").alias("jcr_id"), "distance", "tied", "n_entries")


def p1_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Every journal of the list within the distance that the length of a typed value allows."""
    return canonical.canonical_candidates(_entries(spark, root), "value", _listed(spark, root)).withColumnRenamed("entry", "jcr_id")


def p1_unmatched(spark: SparkSession, root: str) -> DataFrame:
    """The report of values that mean no journal of the list."""
    return p1_values(spark, root).filter("jcr_id = -1").select("value", "tied", "n_entries")


def by_field(spark: SparkSession, one: Callable[[str], DataFrame]) -> DataFrame:
    """The union of what `one` gives for each field; the jobs that it runs for the fields run side by side."""
    made = side_by_side(spark, *[partial(one, field) for field in FIELDS])
    return reduce(DataFrame.unionByName, [m.select(F.lit(field).alias("field_name"), "*") for field, m in zip(FIELDS, made)])


def _pairs(spark: SparkSession, root: str, **bounds) -> DataFrame:
    return by_field(spark, lambda field: together.pairs_together(values_of(spark, root, field).select(F.array_distinct("vals").alias("items")), **bounds))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _pairs(spark, root, min_records=5, min_permille=1, min_lift=10).select("field_name", "item_a", "item_b")


def p3_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every pair with its count and lift."""
    return _pairs(spark, root).select("field_name", "item_a", "item_b", "n_both", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p6_terms(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct value with its occurrences, its records and its mark."""

    def one(field: str) -> DataFrame:
        records = stored(values_of(spark, root, field))  # read for the counts and for their number
        counts = frequency.term_counts(records.select("id", F.explode("vals").alias("val")), "id", "val", grouped=True)
        return frequency.marked(counts, records.agg(F.count("*"))).select(F.col("term").alias("val"), "n_occurrences", "n_records", "mark")

    return by_field(spark, one)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_terms(spark, root).filter("mark is not null").select("field_name", "val", "mark")


#: Tokens of a container.
CAPACITY = 2048


def p8_plan(spark: SparkSession, root: str) -> DataFrame:
    """Every text of documents, measured in tokens, in a container of CAPACITY tokens."""
    sizes = packing.token_counts(table(spark, root, "documents"), "doc_id", "text")
    return packing.pack(sizes, CAPACITY).withColumnRenamed("key", "doc_id")


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.container_fill(p8_plan(spark, root), CAPACITY)


def p8_totals(spark: SparkSession, root: str) -> DataFrame:
    """(n_texts, n_over, n_cut): the texts in the plan, containers above capacity, and texts in more pieces than their tokens need; the last two are 0."""
    plan = stored(p8_plan(spark, root))
    over = packing.container_fill(plan.withColumnRenamed("doc_id", "key"), CAPACITY).filter("unused < 0").agg(F.count("*"))
    texts = plan.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"))
    needed = F.greatest(F.lit(1), F.ceil(F.col("n") / CAPACITY))
    return texts.agg(F.count("*").alias("n_texts"), F.first(over.scalar()).alias("n_over"), F.count_if(F.col("pieces") > needed).alias("n_cut"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    cases = leaks.leaked(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text")
    return cases.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return p9_found(spark, root).select(F.col("doc_id").alias("key"), F.col("item_id").alias("item"))


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """The leaked items with the number of documents that carry them."""
    return leaks.item_report(_leaks(spark, root)).withColumnRenamed("item", "item_id")


def p9_kept(spark: SparkSession, root: str) -> DataFrame:
    """The documents, with their texts, that are left when the affected ones are removed."""
    return leaks.without_leaks(table(spark, root, "documents"), "doc_id", _leaks(spark, root))


def p10_measures(spark: SparkSession, root: str) -> DataFrame:
    """The shares by which every page is judged."""
    got = stuffing.page_measures(table(spark, root, "documents"), "doc_id", "text", repeats=True).withColumnRenamed("key", "doc_id")
    return got.select("doc_id", "n_word_chars", *[F.round(c, 6).alias(c) for c in ("repeated", "keywords", "outside", "stuffing")])


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    measured = stuffing.page_measures(table(spark, root, "documents"), "doc_id", "text")
    return stuffing.stuffed_pages(measured).select(F.col("key").alias("doc_id"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}


def _tokens(field: str) -> str:
    name, array, value = FIELDS[field]
    return f"""select * from (select id, unnest(list_transform(any_value({array}), lambda e: e.{value})) as val from {name} group by id) where length(trim(val)) > 0"""


def _sql_pairs(field: str, where: str, cols: str) -> str:
    return f"""select '{field}' as field_name, {cols} from (
      with t as ({_tokens(field)}), d as (select distinct id, val from t), n as (select val, count(*) as n from d group by val), total as (select count(distinct id) as n from d),
      p as (select a.val as item_a, b.val as item_b, count(*) as n_both from d a join d b on a.id = b.id and a.val < b.val group by 1, 2)
      select p.*, x.n as n_a, y.n as n_b, (select n from total) as n_records from p join n x on p.item_a = x.val join n y on p.item_b = y.val)
    where {where}"""


def _sql_terms(field: str) -> str:
    return f"""select '{field}' as field_name, val, n_occurrences, n_records, case when n_records * 20 > (select count(distinct id) from ({_tokens(field)})) then 'common' when n_records <= 2 then 'rare' end as mark
      from (select val, count(*) as n_occurrences, count(distinct id) as n_records from ({_tokens(field)}) group by val)"""


def oracles() -> dict[str, str]:
    found = " union all ".join(_sql_pairs(f, "n_both >= 5 and 1000 * n_both >= n_records and n_both * n_records >= 10 * n_a * n_b", "item_a, item_b") for f in FIELDS)
    pairs = " union all ".join(_sql_pairs(f, "true", "item_a, item_b, n_both, n_a, n_b, round(n_both * n_records / (n_a * cast(n_b as double)), 6) as lift") for f in FIELDS)
    terms = " union all ".join(_sql_terms(f) for f in FIELDS)
    totals = "select count(*) as n_texts, cast(0 as bigint) as n_over, cast(0 as bigint) as n_cut from documents where text is not null"
    return {"p8_totals": totals, "p3_found": found, "p3_pairs": pairs, "p6_terms": terms, "p6_found": f"select field_name, val, mark from ({terms}) where mark is not null"}

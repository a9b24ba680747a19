"""References to records that do not exist (problem 2).

A broadcast Bloom filter of the parent keys proves most missing references without a join; only the references
that pass the filter are checked exactly against the state of the parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.bloom import bloom_filters, might_contain
from citeloom.runtime import cut

#: Words of record_state that mean the record is gone.
GONE_STATES = ("deleted", "withdrawn")
#: Parents whose states are sent to all tasks (about 50 bytes each), and the share of all references from which an id's are not shuffled.
SMALL, HOT_SHARE = 500_000, 1000


def whole_number_id(text: Column) -> Column:
    """The LONG a free-text id stands for, or null.

    Read as numbers: plain digits, leading zeros, surrounding space, a PMID / PubMed / id prefix with or without
    `:`, `=`, `#` or space, thousands separators, a zero fraction ("12.0") and an exponent ("1.2e7").
    Null, blank, placeholders, DOIs, negative numbers, true fractions and numbers beyond LONG give null.
    """
    s = F.lower(F.regexp_replace(text, r"[\s\u00a0\u200b\ufeff]+", " "))
    s = F.regexp_replace(F.trim(s), r"^(?:pubmed|pmid|id|pm)?(?: ?id)? ?[:=#]? ?", "")
    whole = F.regexp_extract(s, r"^\+?(\d{1,3}(?:[, ]\d{3})+|\d+)(?:\.0*)?$", 1)
    expo = F.when(s.rlike(r"^\d+(?:\.\d+)?e\+?\d{1,2}$"), s.try_cast("decimal(38,6)"))
    return F.coalesce(
        F.when(whole != "", F.regexp_replace(whole, "[, ]", "").try_cast("long")),
        F.when(expo == F.floor(expo), expo.try_cast("long")),
    )


def parent_states(articles: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(ref_id, first_seen, gone): one row per parent key from its deliveries.

    articles: id, record_state, deleted_at, ingested_at; extra: id, ingested_at (never deleted).
    gone is read from the latest delivery; of two deliveries at one moment a deleting one counts. Null ids are dropped.
    """
    gone = F.col("deleted_at").isNotNull() | F.coalesce(F.lower(F.trim("record_state")).isin(*GONE_STATES), F.lit(False))
    rows = articles.select(F.col("id").alias("ref_id"), "ingested_at", gone.alias("gone"))
    if extra is not None:
        rows = rows.unionByName(extra.select(F.col("id").alias("ref_id"), "ingested_at", F.lit(False).alias("gone")))
    return (
        rows.filter("ref_id is not null")
        .groupBy("ref_id")
        .agg(F.min("ingested_at").alias("first_seen"), F.max(F.struct("ingested_at", "gone")).alias("last"))
        .select("ref_id", "first_seen", F.col("last.gone").alias("gone"))
    )


def find_orphans(refs: DataFrame, parents: DataFrame, small: int = SMALL, hot_share: int = HOT_SHARE) -> DataFrame:
    """(src, id, year, ref_id, kind): one row per orphan (src, id, ref_id).

    refs: src, id, year, ref_id, ingested_at; any number of deliveries of a reference, which count once.
    parents: as parent_states gives. kind: 'missing' without a parent, else 'deleted' if the parent is gone,
    else 'late' if the parent first came after the reference. Rows with a null ref_id name nothing and are left out; the year is the least of the
    deliveries that are orphans, a null year gives -1; a null moment of either side is never late; empty inputs give no rows
    (without parents every reference is missing).

    References outside the filter are missing at once. The others meet the parents' states where they are read, if these are at most `small` rows of
    three numbers; else they are shuffled by ref_id, but those of an id with at least one in `hot_share` of all references are not: its state
    (there are at most `hot_share` such ids) is sent to them. A reference is late if any of its deliveries came before the parent, so deliveries
    that show no orphan are dropped before anything is grouped, and only orphans are shuffled to count once.
    """
    parents = cut(parents.select("ref_id", "first_seen", "gone"))
    many = parents.count()
    rows = refs.filter("ref_id is not null").select("src", "id", "year", "ref_id", "ingested_at")
    rows = rows.withColumn("maybe", might_contain(parents, bloom_filters(parents, "ref_id", many), F.col("ref_id")))
    kind = (
        F.when(F.col("gone").isNull(), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("first_seen") > F.col("ingested_at"), "late")
    )
    slim = ["src", "id", "year", "ref_id", "kind"]
    state = parents.withColumnRenamed("ref_id", "_id")
    found = F.col("maybe") & (F.col("ref_id") == F.col("_id"))
    if many <= small:
        judged = rows.join(F.broadcast(state), found, "left").withColumn("kind", kind).select(*slim)
    else:
        rows = cut(rows)
        counts = rows.filter("maybe").groupBy("ref_id").agg(F.count("*").alias("n")).filter(F.col("n") * hot_share >= rows.count())
        hot = [r[0] for r in counts.select("ref_id").collect()]
        checked = rows.filter("maybe").filter(~F.col("ref_id").isin(hot)).join(state.hint("merge"), found, "left")
        often = rows.filter("maybe").filter(F.col("ref_id").isin(hot)).join(F.broadcast(state.filter(F.col("_id").isin(hot))), found, "left")
        sure = rows.filter("not maybe").withColumn("kind", F.lit("missing")).select(*slim)
        judged = checked.unionByName(often).withColumn("kind", kind).select(*slim).unionByName(sure)
    once = judged.filter("kind is not null").groupBy("src", "id", "ref_id", "kind").agg(F.min("year").alias("year"))
    return once.select("src", "id", F.coalesce("year", F.lit(-1)).alias("year"), "ref_id", "kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(src, year, kind, n_refs, n_records): orphans per source table, year of the referring record and kind."""
    per_record = orphans.groupBy("src", "year", "kind", "id").agg(F.count("*").alias("n"))
    return per_record.groupBy("src", "year", "kind").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_records"))

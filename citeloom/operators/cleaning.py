"""Raw references and keywords as (item, year, category) with the share that was recognised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.keywords import tree_prefixes
from citeloom.runtime import broadcast_if_fits, stored


def parse_keywords(terms: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(doc_id, pos, descui, year, category, known): each keyword of a document with its descriptor's year of creation and the first two steps of its tree numbers.

    terms: doc_id, pos, descui; descriptors: descui, year, tree_numbers ARRAY<STRING>, each descriptor once. A keyword that is no descriptor keeps
    its place with nulls; a descriptor without tree numbers has a null category. Null keywords give no row.
    """
    listed = descriptors.select("descui", "year", F.when(F.col("tree_numbers").isNotNull(), tree_prefixes(F.col("tree_numbers"))).alias("category"), F.lit(True).alias("_known"))
    listed = broadcast_if_fits(stored(listed))
    got = terms.filter("descui is not null").select("doc_id", "pos", "descui").join(listed, "descui", "left")
    return got.select("doc_id", "pos", "descui", "year", "category", F.coalesce("_known", F.lit(False)).alias("known"))


def parse_wos(refs: DataFrame, journals: DataFrame) -> DataFrame:
    """(doc_id, pos, journal, ref_year, category) of cited references like 'Author, 1999, J NAME, V1, P2'.

    refs: doc_id, pos, cr. With three parts or more the second is the year and the third the journal; with fewer the last part is the journal.
    journals: title20, web_of_science_categories; category is the list of a recognised journal, else null. Null references give no row.
    """
    parts = F.split("cr", ", ")
    many = F.size(parts) > 2
    got = refs.filter("cr is not null").select("doc_id", "pos", F.when(many, parts[2]).otherwise(F.element_at(parts, -1)).alias("journal"), F.when(many, parts[1]).alias("ref_year"), many.alias("_many"))
    listed = journals.select(F.col("title20").alias("journal"), F.split("web_of_science_categories", r" \|").alias("category"), F.lit(True).alias("_known")).dropDuplicates(["journal"])
    out = got.join(broadcast_if_fits(stored(listed)), "journal", "left").withColumn("known", F.coalesce(F.col("_known") & F.col("_many"), F.lit(False)))
    return out.select("doc_id", "pos", "journal", "ref_year", F.when(F.col("known"), F.col("category")).alias("category"), "known")


def share_captured(parsed: DataFrame) -> DataFrame:
    """(doc_id, share): recognised references among all of the document."""
    return parsed.groupBy("doc_id").agg((F.sum(F.col("known").cast("int")) / F.count("*")).alias("share"))


def parse_pubmed(df: DataFrame, key: str, citation: str, article_id: str) -> DataFrame:
    """(key, journal, ref_year, ref_id) of citations like 'J Name. 1999 Jan;1:2-3': the text before the first full stop, four characters after it, the id as a number if it is one."""
    parts = F.split(citation, r"\.")
    year = F.when(F.size(parts) > 1, F.substring(parts[1], 2, 4))
    return df.filter(F.col(citation).isNotNull()).select(F.col(key), parts[0].alias("journal"), year.alias("ref_year"), F.trim(article_id).try_cast("long").alias("ref_id"))


def pubmed_lists(df: DataFrame, doc: str, order: str, citation: str, article_id: str) -> DataFrame:
    """(doc_id, share, refs_pmids): per document the share of references whose citation names a journal and a year, and the ids of those that have one, in
    their order. Null citations count as references."""
    year = F.substring(F.split(citation, r"\.")[1], 2, 4)
    known = (F.size(F.split(F.coalesce(citation, F.lit("")), r"\.")) > 1) & F.coalesce(year.rlike(r"^\d{4}$"), F.lit(False))
    pmid = F.trim(article_id).try_cast("long")
    each = df.select(F.col(doc).alias("doc_id"), F.when(known, 1).otherwise(0).alias("k"), F.when(pmid.isNotNull(), F.struct(F.col(order).alias("at"), pmid.alias("id"))).alias("ref"))
    got = each.groupBy("doc_id").agg((F.sum("k") / F.count("*")).alias("share"), F.array_sort(F.collect_list("ref")).alias("refs"))
    return got.select("doc_id", "share", F.transform("refs", lambda x: x["id"]).alias("refs_pmids"))


def journal_list(ranking: DataFrame, collections: DataFrame, title: str = "journal_title") -> DataFrame:
    """The ranking list with what the collection files say about each title; a title in several files counts once, the first in the order of its columns."""
    others = [c for c in collections.columns if c != title]
    once = collections.groupBy(title).agg(F.min(F.struct(*others)).alias("_m")).select(title, *[F.col(f"_m.{c}").alias(c) for c in others])
    return ranking.join(once, title, "left")

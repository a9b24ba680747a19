"""The pN_ queries of the general problems: 2, 4, 5 and 7. Each takes (spark, root) and reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import nested, orphans, packed, skew
from citeloom.runtime import side_by_side, stored, table


def _references(spark: SparkSession, root: str) -> DataFrame:
    """(src, id, year, ref_id, ingested_at) of the three tables that name articles."""
    ref = table(spark, root, "reference").select(
        F.lit("reference").alias("src"), F.col("pmid").alias("id"), "year", orphans.whole_number_id(F.col("refarticleid")).alias("ref_id"), "ingested_at"
    )
    net = table(spark, root, "citation_network").select(
        F.lit("citation_network").alias("src"), "id", "year", F.explode("citations.refs").alias("ref_id"), "ingested_at"
    )
    emb = table(spark, root, "refs_embedding").select(
        F.lit("refs_embedding").alias("src"), "id", "year", F.explode("refs_embedding.id").alias("ref_id"), "ingested_at"
    )
    return ref.unionByName(net).unionByName(emb)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    articles, core = table(spark, root, "articles"), table(spark, root, "core_articles")
    parents = orphans.parent_states(articles.select("id", "record_state", "deleted_at", "ingested_at"), core.select("id", "ingested_at"))
    return orphans.find_orphans(_references(spark, root), parents)


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_report(p2_found(spark, root))


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "citation_network").select("id", "chunk_no", "year", "citations.cited_by").dropDuplicates(["id", "chunk_no"])


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "ref_journals").select("id", "year", "cr_year_category.journal").dropDuplicates(["id"])


def _cited_and_years(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(id, citing) of every element of cited_by, and (citing, citing_year) of every known record."""
    chunks = stored(_chunks(spark, root))  # read for either side of the join
    years = chunks.groupBy("id").agg(F.min("year").alias("citing_year")).withColumnRenamed("id", "citing")
    return chunks.select("id", F.explode("cited_by").alias("citing")), years


def p4_articles(spark: SparkSession, root: str) -> DataFrame:
    """Per cited article: elements of cited_by, how many of them are known records, and the first, last and mean year of those."""
    cited, years = _cited_and_years(spark, root)
    # pre-aggregated by (citing, id), so the join on the citing article carries no hot key and the roll-up by id adds partial sums
    got = skew.eager_join_aggregate(
        cited, years, on=["citing"], by=["id"], right_sums={"year": F.col("citing_year").cast("long")}, right_extremes={"year": F.col("citing_year")}, how="left"
    )
    return got.select(
        "id", F.col("n_rows").alias("n_cited_by"), F.col("n_matched").alias("n_known"), F.col("min_year").alias("first_year"), F.col("max_year").alias("last_year"), "sum_year"
    )


def p4_journals(spark: SparkSession, root: str) -> DataFrame:
    """Per journal as stored: entries, entries joined to the journal list by title20, and years of the citing records summed over the join."""
    entries = _entries(spark, root).select("year", F.explode("journal").alias("journal")).filter(F.length(F.trim("journal")) > 0)
    listed = table(spark, root, "wos_jcr").select(F.col("title20").alias("journal"), "jcr_id")
    got = skew.eager_join_aggregate(entries, listed, on=["journal"], by=["journal"], left_sums={"year": F.col("year").cast("long")}, right_extremes={"jcr_id": F.col("jcr_id")}, how="left")
    return got.select("journal", F.col("n_rows").alias("n_entries"), F.col("n_matched").alias("n_listed"), F.col("min_jcr_id").alias("jcr_id"), "sum_year")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys holding at least 2 % of all rows, from the rolled-up counts of the same joins as in p4_articles and p4_journals."""

    def by_article() -> DataFrame:
        cited = skew.eager_join_aggregate(*_cited_and_years(spark, root), on=["citing"], by=["id"], how="left")
        return skew.heavy_keys(cited, "id", "n_rows", 0.02).select(F.lit("cited_by").alias("field_name"), F.col("id").cast("string").alias("key_val"))

    def by_journal() -> DataFrame:
        return skew.heavy_keys(p4_journals(spark, root), "journal", "n_entries", 0.02).select(F.lit("journal").alias("field_name"), F.col("journal").alias("key_val"))

    articles, journals = side_by_side(spark, by_article, by_journal)
    return articles.unionByName(journals)


def p5_values(spark: SparkSession, root: str) -> DataFrame:
    """Every value of every refcitation, also of fields that hold one."""
    return packed.split_packed(table(spark, root, "reference").select("row_id", "refcitation").dropDuplicates(["row_id"]), "row_id", "refcitation")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    # only fields that show a separator can hold two citations, so only those are shuffled to drop redeliveries
    rows = table(spark, root, "reference").select("row_id", "refcitation").filter(F.col("refcitation").rlike(packed.SEPARATOR))
    return packed.split_packed(rows.dropDuplicates(["row_id"]), "row_id", "refcitation", pattern=packed.CITATION, at_least=2)


def _records(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "result_records").select("rec_id", "payload")


def p7_records(spark: SparkSession, root: str) -> DataFrame:
    return nested.record_rows(_records(spark, root), "rec_id", "payload", {"pmid": "PMID", "record_year": "year"})


def p7_entries(spark: SparkSession, root: str) -> DataFrame:
    got = nested.entry_rows(_records(spark, root), "rec_id", "payload", "Mesh_year_category", {"descui": "descUI", "entry_year": "year"})
    return got.withColumnRenamed("parent_no", "entry_no")


def p7_categories(spark: SparkSession, root: str) -> DataFrame:
    got = nested.repeated_values(_records(spark, root), "rec_id", "payload", "Mesh_year_category", "category")
    return got.select("rec_id", F.col("parent_no").alias("entry_no"), F.col("item_no").alias("category_no"), F.col("value").alias("category"))


def p7_di1(spark: SparkSession, root: str) -> DataFrame:
    return nested.numbers_below(_records(spark, root), "rec_id", "payload", "disruptiveness", "DI1").select("rec_id", "output_no", F.col("value").alias("di1"))


def p7_levels(spark: SparkSession, root: str) -> DataFrame:
    return nested.shredded_levels(_records(spark, root), "rec_id", "payload")


def disruption_items(records: DataFrame) -> DataFrame:
    """(rec_id, branch, pos1, pos2, item): category codes, and DI1 values in ten-thousandths as whole-number text."""
    got = nested.branches(records, "rec_id", "payload", {"category": ("Mesh_year_category", "category", "tree")}, {"di1": ("disruptiveness", "DI1")})
    scaled = F.round(F.col("num") * 10000)
    whole = F.when(F.abs(scaled) < 9e18, scaled.try_cast("long").cast("string")).otherwise(F.format_string("%.0f", scaled))
    return got.select("rec_id", "branch", F.col("parent_no").alias("pos1"), F.col("item_no").alias("pos2"), F.coalesce("value", F.when(F.col("num").isNotNull(), whole)).alias("item"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return disruption_items(_records(spark, root))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}

"""Reading collections: yearly JSON arrays, Parquet partitioned by year, tables of journals, tagged exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_years(spark: SparkSession, path: str, schema: T.StructType, years: list[int] | None = None) -> DataFrame:
    """Documents of <path>/<year>.json, each a JSON array. years: the wanted files; a missing one is an empty year. No schema is inferred."""
    reader = spark.read.schema(schema).option("multiLine", True)
    if years is None:
        return reader.json(f"{path}/*.json")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for y in years:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{y}.json")
        if p.getFileSystem(conf).exists(p):
            there.append(p.toString())
    return reader.json(there) if there else spark.createDataFrame([], schema)


def parquet_years(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None) -> DataFrame:
    """A collection written by sinks.write_years, pruned to the partitions start <= year < stop."""
    df = spark.read.parquet(path)
    if start is not None:
        df = df.filter(F.col("year") >= start)
    return df if stop is None else df.filter(F.col("year") < stop)


def years_of(df: DataFrame, year: str = "year") -> list[int]:
    """The years of a collection, ascending: one number per year, however many documents."""
    return sorted(r[0] for r in df.select(F.col(year).cast("int")).filter(f"`{year}` is not null").distinct().collect())


def journal_csvs(spark: SparkSession, ranking: str, collections: str) -> tuple[DataFrame, DataFrame]:
    """(ranking list, union of the collection files): header CSVs, the ranking's Title named 'Journal title'. Files may differ in columns."""
    rank = spark.read.option("header", True).csv(ranking)
    if "Title" in rank.columns:
        rank = rank.withColumnRenamed("Title", "Journal title")
    files = [r[0] for r in spark.read.format("binaryFile").load(collections).select("path").collect()]
    out = None
    for f in sorted(files):
        one = spark.read.option("header", True).csv(f)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return rank, out


def tagged_records(spark: SparkSession, path: str) -> DataFrame:
    """(pmid LONG, cr ARRAY<STRING>, fields MAP<STRING, ARRAY<STRING>>) of a Web of Science text export; only records with cited references.

    A record ends with a line ER; a field begins with two characters and a space, and goes on in lines that begin with three spaces.
    Files are cut at record ends by Spark, so a file of any size is read in parallel.
    """
    text = spark.read.option("lineSep", "\nER").text(path)
    body = F.concat(F.lit("\n"), F.regexp_replace("value", r"\r", ""))
    found = F.regexp_extract_all(body, F.lit(r"\n([A-Z][A-Z0-9] [^\n]*(?:\n   [^\n]*)*)"), 1)
    pairs = F.transform(found, lambda f: F.struct(F.substring(f, 1, 2).alias("tag"), F.transform(F.split(F.substring(f, F.lit(4), F.length(f)), r"\n   "), lambda v: F.trim(v)).alias("lines")))
    fields = F.map_from_entries(F.array_distinct(F.filter(pairs, lambda p: ~p["tag"].isin("FN", "VR"))))
    got = text.select(fields.alias("fields"))
    return got.select(F.get(F.col("fields")["PM"], F.lit(0)).try_cast("long").alias("pmid"), F.col("fields")["CR"].alias("cr"), "fields").filter("cr is not null")

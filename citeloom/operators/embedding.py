"""Distances among embedded references, among authors' past works, and embeddings of texts by word vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.stats import distribution
from citeloom.functions.vectors import prepared
from citeloom.runtime import broadcast_if_fits, spread, stored


def embedded(vec: Column) -> Column:
    return vec.isNotNull() & (F.size(vec) > 0)


def embedded_references(refs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(doc_id, year, pos, ref_id, vec): each place of each reference list with the cited work's vector; works without one drop out.

    refs: doc_id, year, refs ARRAY<LONG>; vectors: doc_id, vec. A work cited twice keeps both places.
    """
    each = refs.select("doc_id", "year", F.posexplode("refs").alias("pos", "ref_id"))
    return each.join(vectors.filter(embedded(F.col("vec"))).select(F.col("doc_id").alias("ref_id"), "vec"), "ref_id").select("doc_id", "year", "pos", "ref_id", "vec")


def pairwise_distances(rows: DataFrame, keys: list[str], order: str = "pos", vec: str = "vec", distance: str | Callable = "cosine") -> DataFrame:
    """(keys, d): the distance of every two vectors of one key, each pair once. Null and empty vectors count as absent.

    The vectors of a key come together once and are paired from there; a key with one vector gives nothing.
    """
    each, of = prepared(distance)
    bags = spread(rows.filter(embedded(F.col(vec))).withColumn(vec, each(F.col(vec))), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, vec))).alias("bag")).filter(F.size("bag") > 1)
    first = bags.select(*keys, "bag", F.posexplode("bag").alias("at", "a"))
    rest = first.select(*keys, "a", F.explode(F.slice("bag", F.col("at") + 1 + 1, F.size("bag"))).alias("b"))
    return rest.select(*keys, of(F.col(f"a.{vec}"), F.col(f"b.{vec}")).alias("d"))


def reference_novelty(rows: DataFrame, distance: str | Callable = "cosine", density: bool = False) -> DataFrame:
    """(doc_id, year, n, mean, sd, p100 .. p0[, scores]) of the distances among a document's embedded references.

    rows: doc_id, year, pos, vec. Documents with fewer than two embedded references are absent. One NaN (a zero vector) makes all but n NaN.
    """
    extra = [F.array_sort(F.collect_list("d")).alias("scores")] if density else []
    return pairwise_distances(rows, ["doc_id", "year"], distance=distance).groupBy("doc_id", "year").agg(*distribution("d"), *extra)


# ---- authors


def entity_documents(rows: DataFrame, entity: str, none: object = None) -> DataFrame:
    """(<entity>, doc_list): the sorted documents of each value of a column; null, and the value `none`, stand for no entity."""
    kept = rows.filter(F.col(entity).isNotNull())
    if none is not None:
        kept = kept.filter(F.col(entity) != F.lit(none))
    return kept.select(entity, "doc_id").distinct().groupBy(entity).agg(F.array_sort(F.collect_list("doc_id")).alias("doc_list"))


def author_papers(authorship: DataFrame) -> DataFrame:
    """(author_id, doc_list): the sorted documents of each author; the sentinel 0 is no author."""
    return entity_documents(authorship, "author_id", 0)


def entity_slice(lists: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    """The entities of entity_documents in order, without the first `skip`, at most `limit` of them: for work in portions."""
    ordered = lists.orderBy(lists.columns[0]).offset(skip)
    return ordered if limit is None else ordered.limit(limit)


def author_year_profile(authorship: DataFrame, vectors: DataFrame) -> DataFrame:
    """(author_id, year, n, vecs): the vectors of an author's documents of each year, in order of the documents."""
    got = authorship.select("author_id", "doc_id", "year").distinct().join(vectors.filter(embedded(F.col("vec"))).select("doc_id", "vec"), "doc_id")
    bag = F.array_sort(F.collect_list(F.struct("doc_id", "vec")))
    return got.groupBy("author_id", "year").agg(F.count("*").alias("n"), F.transform(bag, lambda x: x["vec"]).alias("vecs"))


def _focal(authorship: DataFrame, focal: int | None, ids: DataFrame | None) -> DataFrame:
    """The authorship rows of the documents to score: of one year or of all, of all documents or of those in the first column of `ids`."""
    mine = authorship if focal is None else authorship.filter(F.col("year") == focal)
    if ids is not None:
        mine = mine.join(ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return mine.filter("year is not null").select("doc_id", "year", "pos", "author_id")


def past_works(authorship: DataFrame, vectors: DataFrame, focal: int | None = None, window: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """(author_id, year, work, vec): for the authors of the documents to score, and each of these documents' years, their embedded documents
    from the `window` years before. focal None takes every document's own year."""
    wanted = _focal(authorship, focal, ids).select("author_id", "year").distinct()
    before = authorship.select("author_id", F.col("doc_id").alias("work"), F.col("year").alias("_y")).distinct()
    if focal is not None:
        before = before.filter(F.col("_y").between(focal - window, focal - 1))
    kept = before.join(wanted, "author_id").filter(F.col("_y").between(F.col("year") - window, F.col("year") - 1))
    return kept.join(vectors.filter(embedded(F.col("vec"))).select(F.col("doc_id").alias("work"), "vec"), "work").select("author_id", "year", "work", "vec")


def _listed(mine: DataFrame, past: DataFrame) -> DataFrame:
    """(doc_id, year, pos, author_id, works) of authors with past works, for documents that have two such authors, one with two works."""
    works = past.groupBy("author_id", "year").agg(F.count("*").alias("works"))
    known = mine.join(works, ["author_id", "year"])
    fit = known.groupBy("doc_id").agg(F.count("*").alias("a"), F.max("works").alias("m")).filter("a > 1 and m > 1").select("doc_id")
    return known.join(fit, "doc_id", "left_semi")


def author_intra(authorship: DataFrame, vectors: DataFrame, focal: int | None = None, window: int = 5, distance: str | Callable = "cosine", ids: DataFrame | None = None, density: bool = False) -> DataFrame:
    """(doc_id, year, author_id, n, mean, sd, p100 .. p0[, scores]): distances among each author's past works.

    An author's distances are computed once per year, however many documents they wrote in it. focal None scores all years in one job.
    """
    past = past_works(authorship, vectors, focal, window, ids)
    extra = [F.array_sort(F.collect_list("d")).alias("scores")] if density else []
    stats = pairwise_distances(past, ["author_id", "year"], order="work", distance=distance).groupBy("author_id", "year").agg(*distribution("d"), *extra)
    return _listed(_focal(authorship, focal, ids), past).select("doc_id", "year", "author_id").join(stats, ["author_id", "year"])


def author_intra_means(authorship: DataFrame, vectors: DataFrame, window: int = 5) -> DataFrame:
    """(year, n_rows, n_distances, mean): of the rows of author_intra by cosine, for all years in one job: their number, that of their distances and the mean of their means.

    authorship has the column `code` beside doc_id, year, pos, author_id: the document's vector in vectors (code, vec), null for none. No pair is formed: distances among
    vectors of length 1 sum to (w * w - |sum|^2) / 2 for w works. An author's documents come together once, as codes; the vectors, up to 32 MB by count, go with the
    job. More of them are joined to the rows, and distances are formed as author_intra does.
    """
    known = stored(vectors.filter(embedded(F.col("vec"))).select("code", "vec"))
    widths = [r[0] for r in known.select(F.size("vec")).distinct().limit(2).collect()]
    bad = len(widths) > 1 or known.groupBy("code").count().filter("count > 1").limit(1).count() or known.filter(F.exists("vec", lambda x: x.isNull())).limit(1).count()
    if bad or broadcast_if_fits(known) is known:
        had = authorship.select("doc_id", "code").distinct().join(known, "code").select("doc_id", "vec")
        each = author_intra(authorship.drop("code"), had, None, window)
        return each.groupBy("year").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_distances"), F.avg("mean").alias("mean"))
    table = known.toPandas()
    lengths = np.vstack([*table["vec"], np.zeros(widths[0] if widths else 1)])
    with np.errstate(invalid="ignore"):
        lengths /= np.sqrt((lengths * lengths).sum(1, keepdims=True))  # NaN where all is zero
    lengths[-1] = 0  # the place of works without a vector
    spark = authorship.sparkSession
    shipped = spark.sparkContext.broadcast((pd.Index(table["code"]), lengths))

    def portions(batch, size=20_000):
        """The authors of a batch by so many works or one author at a time, as each work takes a row of numbers."""
        ends = batch.column("works").value_lengths().to_numpy(zero_copy_only=False).cumsum()
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1), batch.num_rows]
        return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def means(batches):
        codes, units = shipped.value
        for batch in (part for whole in batches for part in portions(whole)):
            lists = batch.column("works")
            at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            doc, year, code = (pc.struct_field(lists.flatten(), k) for k in ("doc_id", "year", "code"))
            rows = pd.DataFrame({"at": at, "doc_id": doc.to_numpy(zero_copy_only=False), "year": year.to_numpy(zero_copy_only=False)})
            rows["vec"] = codes.get_indexer(pd.Index(code.fill_null(-1).to_numpy(zero_copy_only=False)))
            rows.loc[code.is_null().to_numpy(zero_copy_only=False), "vec"] = -1
            works = rows.drop_duplicates()
            works = works[works["vec"] >= 0]
            if works.empty:
                continue
            low = int(rows["year"].min())
            span = int(rows["year"].max()) - low + 1
            # sums by (author, year) in order, of which a window takes at most `window`
            works = works.assign(cell=works["at"] * span + works["year"] - low).sort_values("cell", kind="stable")
            cells, starts = np.unique(works["cell"].to_numpy(), return_index=True)
            counts = np.diff([*starts, len(works)])
            wanted = np.unique((rows["at"] * span + rows["year"] - low).to_numpy())
            total, w = np.zeros((len(wanted), units.shape[1])), np.zeros(len(wanted), "int64")
            sums = np.add.reduceat(units[works["vec"].to_numpy()], starts)
            for back in range(1, min(window, span - 1) + 1):
                found = np.minimum(np.searchsorted(cells, wanted - back), len(cells) - 1)
                hit = (cells[found] == wanted - back) & (wanted % span >= back)  # not the years of the author before
                total[hit] += sums[found[hit]]
                w[hit] += counts[found[hit]]
            n = w * (w - 1) // 2
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = (w * w - (total * total).sum(1)) / 2 / n
            place = np.searchsorted(wanted, (rows["at"] * span + rows["year"] - low).to_numpy())
            keep = w[place] > 0
            out = [rows["doc_id"].to_numpy(), rows["year"].to_numpy(), n[place], mean[place]]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep], t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], names=["doc_id", "year", "n", "mean"])

    lists = authorship.filter("year is not null and author_id is not null and doc_id is not null").groupBy("author_id").agg(F.collect_list(F.struct("doc_id", "year", "code")).alias("works"))
    each = lists.select("works").mapInArrow(means, "doc_id long, year int, n long, mean double")
    more = lambda c: F.sum(F.when(F.col("n") > 0, F.col(c)))
    sums = [F.count("*").alias("a"), F.count(F.when(F.col("n") > 0, 1)).alias("rows"), more("n").alias("n"), more("mean").alias("mean")]
    own = Window.partitionBy("doc_id")  # a document of two years is judged as one, as author_intra does
    fit = spread(each, "doc_id").groupBy("doc_id", "year").agg(*sums).withColumn("a", F.sum("a").over(own)).withColumn("any", F.sum("rows").over(own)).filter("a > 1 and any > 0 and rows > 0")
    return fit.groupBy("year").agg(F.sum("rows").alias("n_rows"), F.sum("n").alias("n_distances"), (F.sum("mean") / F.sum("rows")).alias("mean"))


def author_inter(
    authorship: DataFrame, vectors: DataFrame, focal: int | None = None, window: int = 5, distance: str | Callable = "cosine", ids: DataFrame | None = None, density: bool = False, equal_once: bool = False
) -> DataFrame:
    """(doc_id, year, author_a, author_b, n, mean, sd, p100 .. p0[, scores]): distances of all past works of one author to all of another, a before b.

    All pairs count, also where both have the same works; with equal_once, such authors are compared as within one list, each pair of works once, and
    a list of one work gives no row. Each pair of authors is computed once per year, from one row with the two lists of vectors. focal None scores all
    years in one job.
    """
    past = past_works(authorship, vectors, focal, window, ids)
    mine = _listed(_focal(authorship, focal, ids), past)
    a, b = (mine.select("doc_id", "year", F.col("pos").alias(f"pos_{x}"), F.col("author_id").alias(f"author_{x}")) for x in "ab")
    pairs = a.join(b, ["doc_id", "year"]).filter("pos_a < pos_b").drop("pos_a", "pos_b")
    prepare, of = prepared(distance)
    bags = past.withColumn("vec", prepare(F.col("vec"))).groupBy("author_id", "year").agg(F.array_sort(F.collect_list(F.struct("work", "vec"))).alias("bag"))
    named = [bags.select("year", F.col("author_id").alias(f"author_{x}"), F.col("bag").alias(f"bag_{x}")) for x in "ab"]
    keys = ["year", "author_a", "author_b"]
    each = spread(pairs.select(*keys).distinct().join(named[0], ["year", "author_a"]).join(named[1], ["year", "author_b"]), *keys)
    if callable(distance):  # called with columns of vectors, so every two works are a row
        first = each.select(*keys, "bag_a", "bag_b", F.posexplode("bag_a").alias("k", "x"))
        if equal_once:
            first = first.withColumn("bag_b", F.when(F.col("bag_a.work") == F.col("bag_b.work"), F.slice("bag_b", F.col("k") + 2, F.size("bag_b"))).otherwise(F.col("bag_b")))
        flat = first.select(*keys, "x", F.explode("bag_b").alias("y")).select(*keys, of(F.col("x.vec"), F.col("y.vec")).alias("d"))
    else:
        every = F.flatten(F.transform("bag_a", lambda x: F.transform("bag_b", lambda y: of(x["vec"], y["vec"]))))
        if equal_once:
            rest = F.flatten(F.transform("bag_a", lambda x, k: F.transform(F.slice("bag_b", k + 2, F.size("bag_b")), lambda y: of(x["vec"], y["vec"]))))
            every = F.when(F.col("bag_a.work") == F.col("bag_b.work"), rest).otherwise(every)
        flat = each.select(*keys, F.explode(every).alias("d"))
    extra = [F.array_sort(F.collect_list("d")).alias("scores")] if density else []
    got = flat.groupBy(*keys).agg(*distribution("d"), *extra)
    return pairs.join(got, keys)


def author_share_captured(authorship: DataFrame, vectors: DataFrame, focal: int | None = None, window: int = 5, ids: DataFrame | None = None) -> DataFrame:
    """(doc_id, year, share): authors with past works among all authors of the document."""
    past = past_works(authorship, vectors, focal, window, ids).select("author_id", "year").distinct().withColumn("known", F.lit(1))
    mine = _focal(authorship, focal, ids).join(past, ["author_id", "year"], "left")
    return mine.groupBy("doc_id", "year").agg((F.count("known") / F.count("*")).alias("share"))


# ---- texts


def tokens(text: Column) -> Column:
    """The lower-case words of a text, in order."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda t: t != "")


def text_centroid(texts: DataFrame, word_vectors: DataFrame, dim: int, keys: tuple[str, ...] = ("doc_id",), salts: int = 16) -> DataFrame:
    """(keys, n_tokens, vec): the sum of the words' vectors over the number of all words. Words without a vector add nothing but count.

    texts: keys, text; word_vectors: word, vec of `dim` numbers. Null, empty and wordless texts are absent. The word vectors are counted: up to 32 MB of
    them go to every task, so that texts are read once and only sums are shuffled. Beyond that words are counted per text and joined by word, in `salts`
    parts a word, as a few words are most of every text.
    """
    known = stored(word_vectors.select("word", "vec"))
    fitting = broadcast_if_fits(known)
    each = texts.select(*keys, F.explode(tokens(F.col("text"))).alias("word"))
    if fitting is not known:
        got = each.join(fitting, "word", "left").withColumn("n", F.lit(1))
    else:
        each = each.groupBy(*keys, "word").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
        got = each.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["word", "salt"], "left")
    sums = [F.coalesce(F.sum(F.col("n") * F.get("vec", F.lit(k))), F.lit(0.0)).alias(f"_{k}") for k in range(dim)]
    out = got.groupBy(*keys).agg(F.sum("n").cast("long").alias("n_tokens"), *sums)
    return out.select(*keys, "n_tokens", F.array(*[F.col(f"_{k}") / F.col("n_tokens") for k in range(dim)]).alias("vec"))


def article_embeddings(articles: DataFrame, fields: tuple[str, ...], embed: DataFrame | Callable, dim: int) -> DataFrame:
    """(doc_id, entity, vec): the vector of each of several texts of a document, such as its title and its abstract, in one job.

    embed: a table of word vectors, for text_centroid, or any function of a batch of texts (pandas Series) that gives one vector for each, which is
    called in Arrow batches. Null texts, and for word vectors wordless ones, are absent.
    """
    texts = articles.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("entity"), F.col(f).alias("text")) for f in fields])).alias("t")).select("doc_id", "t.*").filter("text is not null")
    if isinstance(embed, DataFrame):
        return text_centroid(texts, embed, dim, ("doc_id", "entity")).drop("n_tokens")

    @F.pandas_udf("array<double>")
    def call(batch: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in embed(batch)])

    return texts.select("doc_id", "entity", call("text").alias("vec"))

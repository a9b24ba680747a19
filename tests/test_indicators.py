"""Indicators against hand-computed values, invariants and odd inputs."""

import json
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom import model
from citeloom.functions import stats, vectors
from citeloom.operators import citation, cleaning, cooccurrence, embedding, graph, keywords, reporting
from citeloom.operators import pairs as P
from citeloom.operators.ranking import ranked, ranked_by_hash
from citeloom.sources import collections, sinks

NAN, INF = float("nan"), float("inf")
#: id: (year, "item@item year ...")
G1 = {
    1: (1, "A@0 B@1 B@0"), 2: (1, "C@0 B@0 A@1"), 3: (2, "A@0 C@1 B@1"), 4: (2, "D@0 C@1 B@2"), 5: (3, "A@0 C@1 D@1"),
    6: (3, "B@0 C@1 B@2"), 7: (4, "A@1 A@3 B@1"), 8: (4, "D@3 C@1 A@2"), 9: (5, "B@4 C@3 D@1"), 10: (5, "A@0 C@1 A@4"),
}


def documents(spark, docs=G1):
    rows = [(k, y, [(p.split("@")[0], int(p.split("@")[1])) for p in text.split()]) for k, (y, text) in docs.items()]
    return spark.createDataFrame(rows, model.ITEMS_SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return model.doc_items(documents(spark), "items", "item").cache()


def table(df, *cols):
    return {tuple(r[c] for c in cols[:-1]) if len(cols) > 2 else r[cols[0]]: r[cols[-1]] for r in df.collect()}


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def cooc(items, **kind):
    return P.cooccurrence(P.doc_pairs(P.item_counts(items), **kind))


def test_weighted_cooccurrence(items):
    got = cooc(items)
    assert rows(got.filter("year = 1"), "i", "j", "w") == [("A", "B", 3), ("A", "C", 1), ("B", "B", 1), ("B", "C", 1)]
    assert rows(got.filter("year = 2"), "i", "j", "w") == [("A", "B", 1), ("A", "C", 1), ("B", "C", 2), ("B", "D", 1), ("C", "D", 1)]
    assert rows(P.window_sum(got, 1, 3), "i", "j", "w") == [("A", "B", 4), ("A", "C", 2), ("B", "B", 1), ("B", "C", 3), ("B", "D", 1), ("C", "D", 1)]
    assert P.window_sum(got, 3, 3).count() == 0
    # every pair of positions is counted
    assert got.agg(F.sum("w")).first()[0] == 10 * 3


def test_in_memory_cooccurrence(spark):
    docs = {k: (1, " ".join(f"{x}@0" for x in t.split())) for k, t in enumerate(["1 2", "1 2 3", "2", "4 3", "1 2 3 2"])}
    items = model.doc_items(documents(spark, docs), "items", "item")
    assert rows(P.item_index(items), "item", "idx") == [("1", 0), ("2", 1), ("3", 2), ("4", 3)]
    assert rows(cooc(items), "i", "j", "w") == [("1", "2", 4), ("1", "3", 2), ("2", "2", 1), ("2", "3", 3), ("3", "4", 1)]
    assert rows(cooc(items, self_loop=False), "i", "j", "w") == [("1", "2", 4), ("1", "3", 2), ("2", "3", 3), ("3", "4", 1)]
    assert rows(cooc(items, weighted=False), "i", "j", "w") == [("1", "2", 3), ("1", "3", 2), ("2", "3", 2), ("3", "4", 1)]


def test_commonness(items):
    s = table(cooccurrence.commonness_pairs(cooc(items.filter("year = 3"))), "i", "j", "s")
    assert {k: round(v, 6) for k, v in s.items()} == {("A", "C"): 0.75, ("A", "D"): 1.5, ("C", "D"): 0.75, ("B", "C"): 1.0, ("B", "B"): round(2 / 3, 6)}
    got = {r.doc_id: r for r in cooccurrence.commonness(items, density=True).collect()}
    assert got[5].novelty == pytest.approx(0.287682072, abs=1e-9) and got[6].novelty == pytest.approx(0.310154928, abs=1e-9)
    assert got[5].scores == [0.75, 0.75, 1.5] and got[6].scores == pytest.approx([2 / 3, 1, 1])
    assert len(got) == 10 and len(cooccurrence.commonness(items, min_items=4).collect()) == 0


def test_reuse(items):
    net = cooc(items, weighted=False)
    assert rows(P.window_sum(net, 1, 3), "i", "j", "w") == [("A", "B", 3), ("A", "C", 2), ("B", "C", 3), ("B", "D", 1), ("C", "D", 1)]
    assert rows(cooccurrence.reused_pairs(net, 3, 2, 1), "i", "j", "w") == [("A", "B", 1), ("A", "C", 2), ("A", "D", 1), ("B", "C", 1), ("B", "D", 1), ("C", "D", 2)]
    assert rows(cooccurrence.new_pairs(net, 3, 1), "i", "j") == [("A", "D")]
    got = table(cooccurrence.reuse_novelty(items, 3, 2, 1, start=1, percentile=0), "doc_id", "novelty")
    assert got[5] == pytest.approx(0.019419324, abs=1e-9) and got[6] == 0.0
    # a pair without a common neighbour scores 0, or 1 on demand
    lone = net.filter("false").unionByName(net.sparkSession.createDataFrame([(3, "X", "Y", 1), (4, "X", "Y", 1)], "year int, i string, j string, w long"))
    assert rows(cooccurrence.difficulty_pairs(lone, 3, 2), "s") == [(0.0,)]
    assert rows(cooccurrence.difficulty_pairs(lone, 3, 2, orthogonal_as_zero=False), "s") == [(1.0,)]


def test_forced_shuffle(spark):
    docs = {5: (3, "A@3 C@1 D@2"), 6: (3, "B@0 C@1 B@0")}
    items = model.doc_items(documents(spark, docs), "items", "item")
    shuffled = cooccurrence.shuffled_items(items, 4)
    for k in range(1, 5):
        assert rows(shuffled.filter(f"k = {k}"), "doc_id", "item") == [(5, "A"), (5, "C"), (5, "D"), (6, "B"), (6, "B"), (6, "C")]
    moments = cooccurrence.sample_moments(shuffled, 4)
    assert rows(moments, "i", "j", "mean", "sd") == [("A", "C", 1.0, 0.0), ("A", "D", 1.0, 0.0), ("B", "B", 1.0, 0.0), ("B", "C", 2.0, 0.0), ("C", "D", 1.0, 0.0)]
    got = cooccurrence.atypicality(items, 4).collect()
    assert len(got) == 2 and all(math.isnan(r.conventionality) and math.isnan(r.novelty) for r in got)


def test_shuffle_keeps_strata(items):
    shuffled = cooccurrence.shuffled_items(items, 3)
    want = rows(items.groupBy("year", "item_year", "item").count(), "year", "item_year", "item", "count")
    slots = rows(items.groupBy("doc_id", "item_year").count(), "doc_id", "item_year", "count")
    for k in (1, 2, 3):
        one = shuffled.filter(f"k = {k}")
        assert rows(one.groupBy("year", "item_year", "item").count(), "year", "item_year", "item", "count") == want
        assert rows(one.groupBy("doc_id", "item_year").count(), "doc_id", "item_year", "count") == slots


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_are_not_broadcast(items):
    """Estimates don't see that samples multiply rows, so nothing of that size may be left to them; pairs stay in the task that forms them."""
    got = cooccurrence.sample_moments(cooccurrence.shuffled_items(items, 20), 20)
    plan = planned(got)
    assert "Broadcast" not in plan and not re.search(r"Exchange hashpartitioning\([^)]*\bj#", plan)
    named = cooccurrence.moments(items, 20)
    assert rows(named, *got.columns) == rows(got, *got.columns)


def test_ranked_rows_are_not_broadcast(spark):
    """Neither by estimates nor by sizes at run time; the sizes go to where the rows are numbered, which are shuffled once."""
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"))
    for group in (["g"], []):
        got = ranked(df, group, ["o"], "place")
        got.collect()
        final = planned(got)
        assert "isFinalPlan=true" in final and "Broadcast" not in final and "SortMergeJoin [_part#" in final
        assert len(re.findall(r"Exchange hashpartitioning\(_part#", final.partition("Initial Plan")[0])) == 3  # rows, partial sizes, offsets


def test_atypicality_sums_pairs_where_they_are_formed(items):
    plan = planned(cooccurrence.atypicality(items, 20))
    assert "hashpartitioning(k#" in plan and not re.search(r"Exchange hashpartitioning\(k#[^)]*\bj#", plan)


def test_cosine_in_parts(spark, root):
    from citeloom.plans import reference

    assert "SortMergeJoin [j#" not in planned(reference.wang_difficulty_cosine(spark, root))
    net = spark.createDataFrame([(i, j, 1 + i * j % 3) for i in range(30) for j in range(i + 1, 30) if (i * 7 + j) % 5 < 2], "i int, j int, w long")
    wanted = spark.createDataFrame([(i, j) for i in range(0, 34, 3) for j in range(i + 1, 34)], "i int, j int")
    want = table(cooccurrence.pair_cosine(wanted, net), "i", "j", "cos")
    for cells in (2_000_000, 60):
        got = table(cooccurrence.pair_cosine_in_parts(wanted, net, cells), "i", "j", "cos")
        assert len(want) > 50 and got == {k: pytest.approx(v) for k, v in want.items()}


def test_crossing(spark, items):
    one = spark.createDataFrame([(x, "c") for x in "ABCD"], "item string, community string")
    assert table(cooccurrence.crossing(items, 3, one), "doc_id", "novelty") == {5: 0.0, 6: 0.0}
    assert table(cooccurrence.crossing(items, 3, one.filter("item <> 'D'")), "doc_id", "novelty")[5] == pytest.approx(2 / 3)
    # one community for the past of year 3, as in the published example
    past = P.window_sum(cooc(items), 1, 3)
    assert table(cooccurrence.crossing(items, 3, graph.communities(past)), "doc_id", "novelty") == {5: 0.0, 6: 0.0}


def test_louvain():
    rng = np.random.default_rng(3)
    edges = {}
    for a in range(40):
        for b in range(a + 1, 40):
            if rng.random() < (0.6 if a // 10 == b // 10 else 0.03):
                edges[a, b] = 1.0
    got = graph.louvain(edges)
    assert len({got[x] for x in range(40)}) == 4 and all(got[x] == got[x // 10 * 10] for x in got)
    assert graph.modularity(edges, got) >= graph.modularity(edges, {x: x // 10 for x in range(40)}) - 1e-9
    assert graph.louvain(edges) == got and graph.louvain({}) == {} and graph.louvain({("a", "a"): 2.0}) == {"a": 0}


def test_communities_beyond_one_task(spark, monkeypatch):
    edges = [(f"n{a}", f"n{b}", 1) for base in (0, 6) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [("n0", "n6", 1)]
    df = spark.createDataFrame(edges, "i string, j string, w long")
    small = table(graph.communities(df), "item", "community")
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", 3)
    large = table(graph.communities(df), "item", "community")
    for got in (small, large):
        assert len(got) == 12 and len({got[f"n{k}"] for k in range(6)}) == 1 and len({got[f"n{k}"] for k in range(6, 12)}) == 1
    with pytest.raises(ValueError):
        graph.communities(df, "guess")
    assert graph.communities(df.limit(0)).count() == 0


# ---- citations


@pytest.fixture(scope="module")
def network(spark):
    """Focal 3 (year 2) cites 1 and 2; 4, 5, 6, 9 cite 3; 4 and 5 also cite 1; 9 cites 4; 7 cites 2 only; 8, of year 1, cites 1."""
    papers = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 3), (6, 3), (7, 4), (8, 1), (9, 5)], "doc_id long, year int")
    edges = [(3, 1), (3, 2), (4, 3), (5, 3), (6, 3), (9, 3), (4, 1), (5, 1), (9, 4), (7, 2), (8, 1)]
    return papers, spark.createDataFrame(edges, "citing long, cited long")


def test_disruption(network):
    counts = citation.disruption_counts(*network, 2).first()
    assert (counts.n_i, counts.n_j, counts.n_k, counts.n_j5, counts.shared, counts.breadth, counts.depth) == (2, 2, 1, 0, 2, 3, 1)
    got = citation.disruption_indices(citation.disruption_counts(*network, 2)).first()
    assert (got.di1, got.di5, got.di1nok, got.di5nok, got.dein, got.breadth, got.depth) == (0, pytest.approx(2 / 3), 0, 1, 0.5, 0.75, 0.25)
    late = citation.disruption_indices(citation.disruption_counts(*network, 5)).first()
    assert late.doc_id == 9 and late.di1 == 0 and late.depth == 0
    assert citation.disruption_counts(*network, 77).count() == 0


@pytest.mark.parametrize("hub_citers", [1, 3, 10**9])
def test_disruption_against_sets(spark, hub_citers):
    rng = np.random.default_rng(8)
    year = {d: int(rng.integers(1, 6)) for d in range(60)}
    edges = {(a, b) for a in range(60) for b in (rng.zipf(1.3, 12) % 60).tolist() if a != b} | {(100, 1), (100, 2), (3, 200)}
    papers = spark.createDataFrame(list(year.items()), "doc_id long, year int")
    got = {r.doc_id: r for r in citation.disruption_counts(papers, spark.createDataFrame(list(edges), "citing long, cited long"), 3, hub_citers).collect()}
    refs = {d: {b for a, b in edges if a == d} for d in [*range(60), 100]}
    for d in (x for x in year if year[x] == 3):
        c = {a for a, b in edges if b == d}
        r = {a for a, b in edges if b in refs[d] and a != d and year.get(a, 0) >= 3}
        deep = {a for a in c if refs[a] & c}
        want = (len(c - r), len(c & r), len(r - c), sum(len(refs[a] & refs[d]) > 4 for a in c), sum(len(refs[a] & refs[d]) for a in c), len(deep), len(c - deep))
        assert tuple(got[d])[2:] == want, d
    assert set(got) == {x for x in year if year[x] == 3}


def test_network(network):
    got = {r.doc_id: (r.refs, r.cited_by) for r in citation.network(*network).collect()}
    assert got[3] == ([1, 2], [4, 5, 6, 9]) and got[1] == ([], [3, 4, 5, 8]) and len(got) == 9


def test_reverse_chunks(spark):
    edges = spark.createDataFrame([(a, 1) for a in range(25, 0, -1)] + [(3, 2)], "citing long, cited long")
    got = rows(citation.reverse_chunks(edges, 10), "doc_id", "chunk_no", "cited_by")
    assert got == [(1, 0, [*range(1, 11)]), (1, 1, [*range(11, 21)]), (1, 2, [*range(21, 26)]), (2, 0, [3])]


def test_ranks_by_hash(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("g"), F.md5(F.col("id").cast("string").cast("binary")).alias("key"), "id")
    df = df.unionByName(df.filter("id < 50").withColumn("id", F.col("id") + 5000))
    got = ranked_by_hash(df, ["g"], "key", "id", "place").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.key, r.id)):
        by.setdefault(r.g, []).append(r.place)
    assert len(by) == 3 and all(v == [*range(1, len(v) + 1)] for v in by.values())


def test_citation_edges(spark):
    df = spark.createDataFrame([(1, [2, 2, 1, None]), (2, None), (3, [])], "id long, refs array<long>")
    assert rows(model.citations(df), "citing", "cited") == [(1, 2)]


# ---- vectors


def test_metrics(spark):
    a, b, z = [1.0, 2.0, 2.0], [2.0, 0.0, 1.0], [0.0, 0.0, 0.0]
    df = spark.createDataFrame([(a, b, z)], "a array<double>, b array<double>, z array<double>")
    x, y = np.array(a), np.array(b)
    want = {"cosine": 1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), "euclidean": np.linalg.norm(x - y), "sqeuclidean": ((x - y) ** 2).sum(), "cityblock": abs(x - y).sum(), "chebyshev": abs(x - y).max()}
    for name, value in want.items():
        assert df.select(vectors.metric(name)(F.col("a"), F.col("b"))).first()[0] == pytest.approx(value)
    assert math.isnan(df.select(vectors.cosine(F.col("a"), F.col("z"))).first()[0])
    each, of = vectors.prepared("cosine")
    got = df.select(of(each(F.col("a")), each(F.col("b"))), of(each(F.col("a")), each(F.col("z")))).first()
    assert got[0] == pytest.approx(want["cosine"]) and math.isnan(got[1])
    own = vectors.metric(lambda p, q: float(p[0] - q[0]))
    assert df.select(own(F.col("a"), F.col("b"))).first()[0] == -1.0
    with pytest.raises(ValueError):
        vectors.metric("nope")


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.floats(-5, 5), min_size=1, max_size=8))
def test_distribution_is_numpys(spark, values):
    r = spark.createDataFrame([(v,) for v in values], "d double").agg(*stats.distribution("d")).first()
    assert r.n == len(values) and r.mean == pytest.approx(np.mean(values), abs=1e-9) and r.sd == pytest.approx(np.std(values), abs=1e-6)
    ps = [r[f"p{p}"] for p in stats.PERCENTILES]
    assert ps == pytest.approx(np.percentile(values, stats.PERCENTILES).tolist()) and ps == sorted(ps, reverse=True)


def test_one_nan_poisons(spark):
    r = spark.createDataFrame([(1.0,), (NAN,)], "d double").agg(stats.quantile("d", 0.1).alias("q"), *stats.distribution("d")).first()
    assert math.isnan(r.q) and math.isnan(r.p0) and math.isnan(r.mean) and r.n == 2
    assert spark.range(1).select(stats.negative_log(F.lit(0.0)), stats.ratio(F.lit(1), F.lit(0))).first()[:] == (INF, 0.0)


def test_reference_novelty(spark):
    vec = {1: [1.0, 0.0, 0.0], 3: [0.0, 1.0, 0.0], 4: [1.0, 1.0, 0.0], 5: None, 6: [0.0, 0.0, 0.0], 7: []}
    v = spark.createDataFrame(list(vec.items()), "doc_id long, vec array<double>")
    refs = spark.createDataFrame([(2, 1, [1, 3, 4, 5, 7, 99]), (8, 1, [1, 5]), (9, 1, [1, 6]), (10, 1, None), (11, 1, [1, 1])], "doc_id long, year int, refs array<long>")
    got = {r.doc_id: r for r in embedding.reference_novelty(embedding.embedded_references(refs, v), density=True).collect()}
    assert set(got) == {2, 9, 11}
    d = [1.0, 1 - 1 / math.sqrt(2), 1 - 1 / math.sqrt(2)]
    assert got[2].n == 3 and got[2].mean == pytest.approx(np.mean(d)) and got[2].p50 == pytest.approx(np.median(d)) and got[2].scores == pytest.approx(sorted(d))
    assert math.isnan(got[9].mean) and got[11].p100 == pytest.approx(0)


def test_more_metrics_and_nan(spark):
    a, b, z = [1.0, 2.0, 0.0, -2.0], [2.0, 0.0, 0.0, -2.0], [0.0] * 4
    df = spark.createDataFrame([(a, b, z)], "a array<double>, b array<double>, z array<double>")
    x, y = np.array(a), np.array(b)
    cx, cy = x - x.mean(), y - y.mean()
    want = {"minkowski": np.linalg.norm(x - y), "correlation": 1 - cx @ cy / np.linalg.norm(cx) / np.linalg.norm(cy), "canberra": 1 / 3 + 1, "braycurtis": 3 / abs(x + y).sum(), "hamming": 0.5, "jaccard": 2 / 3}
    for name, value in want.items():
        assert df.select(vectors.metric(name)(F.col("a"), F.col("b"))).first()[0] == pytest.approx(value), name
    got = df.select(*[vectors.metric(n)(F.col("z"), F.col("z")).alias(n) for n in want]).first()
    assert math.isnan(got.correlation) and math.isnan(got.braycurtis) and got.canberra == got.jaccard == got.hamming == 0


def test_densities_are_the_cells_behind_the_scores(spark, items):
    for r in cooccurrence.atypicality(items, 6, density=True).collect():
        assert len(r.scores) == 3 and (math.isnan(r.novelty) or r.conventionality == pytest.approx(np.median(r.scores)))
    one = spark.createDataFrame([(x, "c") for x in "ABC"], "item string, community string")
    assert table(cooccurrence.crossing(items, 3, one, density=True), "doc_id", "scores") == {5: [0.0, 1.0, 1.0], 6: [0.0, 0.0, 0.0]}


def test_entities(spark):
    df = spark.createDataFrame([(1, "b"), (1, "b"), (2, "b"), (3, "a"), (4, None), (5, "none"), (6, "c")], "doc_id long, who string")
    lists = embedding.entity_documents(df, "who", "none")
    assert table(lists, "who", "doc_list") == {"a": [3], "b": [1, 2], "c": [6]}
    assert [r.who for r in embedding.entity_slice(lists, 1, 1).collect()] == ["b"] and embedding.entity_slice(lists, 2).count() == 1
    assert reporting.entity_statistics(lists).first()[:] == (3, 4, pytest.approx(4 / 3)) and reporting.entity_statistics(lists.limit(0)).first()[0] == 0


def test_keyword_cleaning(spark):
    terms = spark.createDataFrame([(1, 0, "D1"), (1, 1, "D2"), (1, 2, "X"), (2, 0, None)], "doc_id long, pos int, descui string")
    known = spark.createDataFrame([("D1", 1999, ["B05.051.300", "B05.051.4", "A1"]), ("D2", 2000, None)], "descui string, year int, tree_numbers array<string>")
    got = cleaning.parse_keywords(terms, known)
    assert rows(got, "doc_id", "pos", "year", "category", "known") == [(1, 0, 1999, ["A1", "B05.051"], True), (1, 1, 2000, None, True), (1, 2, None, None, False)]
    assert table(cleaning.share_captured(got), "doc_id", "share") == {1: pytest.approx(2 / 3)}
    refs = spark.createDataFrame([(1, 2, "J B. 2000;1", "7"), (1, 1, "J A. 1999;1", " 9 "), (1, 3, None, "x"), (2, 1, "no year", None)], "d long, o int, c string, a string")
    assert rows(cleaning.pubmed_lists(refs, "d", "o", "c", "a"), "doc_id", "share", "refs_pmids") == [(1, pytest.approx(2 / 3), [9, 7]), (2, 0.0, [])]


def test_any_embedder_and_large_vocabularies(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "red red blue", None), (2, None, "blue"), (3, "", "...")], "doc_id long, title string, abstract string")
    got = embedding.article_embeddings(texts, ("title", "abstract"), lambda batch: [[len(t), 1] for t in batch], 2)
    assert rows(got, "doc_id", "entity", "vec") == [(1, "title", [12.0, 1.0]), (2, "abstract", [4.0, 1.0]), (3, "abstract", [3.0, 1.0]), (3, "title", [0.0, 1.0])]
    words = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 3.0])], "word string, vec array<double>")
    small = rows(embedding.article_embeddings(texts, ("title", "abstract"), words, 2), "doc_id", "entity", "vec")
    assert small == [(1, "title", pytest.approx([2 / 3, 1])), (2, "abstract", [0, 3])]
    monkeypatch.setattr(embedding, "broadcast_if_fits", lambda df: df)
    assert rows(embedding.article_embeddings(texts, ("title", "abstract"), words, 2), "doc_id", "entity", "vec") == small


def test_authors_with_equal_works(spark):
    a = spark.createDataFrame([(9, 5, 0, 1), (9, 5, 1, 2), (9, 5, 2, 3)] + [(k, 4, p, x) for k in (1, 2, 3) for p, x in ((0, 1), (1, 2))] + [(4, 4, 0, 3), (5, 4, 0, 3)], "doc_id long, year int, pos int, author_id long")
    v = spark.createDataFrame([(k, 4, [float(k), 1.0]) for k in range(1, 6)], "doc_id long, year int, vec array<double>")
    full = {(r.author_a, r.author_b): r for r in embedding.author_inter(a, v, 5, 3, density=True).collect()}
    once = {(r.author_a, r.author_b): r for r in embedding.author_inter(a, v, 5, 3, density=True, equal_once=True).collect()}
    assert full[1, 2].n == 9 and once[1, 2].n == 3 and full[1, 3].n == once[1, 3].n == 6
    assert once[1, 2].scores == pytest.approx(embedding.author_intra(a, v, 5, 3, density=True).filter("author_id = 1").first().scores)
    own = lambda x, y: float(1 - np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    again = {(r.author_a, r.author_b): r for r in embedding.author_inter(a, v, 5, 3, own, density=True, equal_once=True).collect()}
    assert {k: pytest.approx(r.scores, abs=1e-9) for k, r in once.items()} == {k: r.scores for k, r in again.items()}


def test_authors(spark):
    # document 100 of year 5: author 2 with works 11, 12, 13 and author 1 with 21 .. 24, of which 11 = 21 = 24 and 13 = 23
    auth = [(100, 5, 0, 2), (100, 5, 1, 1), (100, 5, 2, 7), (101, 5, 0, 1)] + [(k, 4, 0, 2) for k in (11, 12, 13)] + [(k, 3, 0, 1) for k in (21, 22, 23, 24)] + [(50, 1, 0, 7), (60, 5, 0, 2)]
    vec = {11: [1.0, 0, 0], 12: [0.0, 1, 0], 13: [0.0, 0, 1], 21: [1.0, 0, 0], 22: [1.0, 1, 0], 23: [0.0, 0, 1], 24: [1.0, 0, 0], 50: [1.0, 1, 1], 60: [1.0, 1, 1]}
    a = spark.createDataFrame(auth, "doc_id long, year int, pos int, author_id long")
    v = spark.createDataFrame([(k, 1, [float(x) for x in u]) for k, u in vec.items()], "doc_id long, year int, vec array<double>")
    intra = {(r.doc_id, r.author_id): r for r in embedding.author_intra(a, v, 5, 3).collect()}
    assert set(intra) == {(100, 1), (100, 2)} and intra[100, 2].n == 3 and intra[100, 2].mean == pytest.approx(1) and intra[100, 1].n == 6
    inter = embedding.author_inter(a, v, 5, 3).collect()
    assert [(r.doc_id, r.author_a, r.author_b, r.n) for r in inter] == [(100, 2, 1, 12)]
    cos = [1 - np.dot(vec[p], vec[q]) / np.linalg.norm(vec[p]) / np.linalg.norm(vec[q]) for p in (11, 12, 13) for q in (21, 22, 23, 24)]
    assert inter[0].mean == pytest.approx(np.mean(cos)) and sum(c < 1e-9 for c in cos) == 3
    assert table(embedding.author_share_captured(a, v, 5, 3), "doc_id", "share") == {100: pytest.approx(2 / 3), 101: 1.0, 60: 1.0}
    assert table(embedding.author_share_captured(a, v, 5, 4), "doc_id", "share")[100] == 1.0
    # every year in one job, or only the documents of a list, gives the same rows
    every = {(r.doc_id, r.author_id): r.n for r in embedding.author_intra(a, v, None, 3).collect()}
    assert every == {(100, 1): 6, (100, 2): 3}
    listed = spark.createDataFrame([("100",), ("12",)], "id string")
    assert embedding.author_inter(a, v, None, 3, ids=listed).count() == 1 and embedding.author_intra(a, v, 5, 3, ids=listed.limit(0)).count() == 0
    assert table(embedding.author_papers(a.unionByName(spark.createDataFrame([(1, 1, 0, 0)], a.schema))), "author_id", "doc_list")[2] == [11, 12, 13, 60, 100]
    profile = table(embedding.author_year_profile(a, v), "author_id", "year", "vecs")
    assert profile[2, 4] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]


def test_author_means_without_pairs(spark, root, monkeypatch):
    from citeloom.plans import reference

    assert "slice(" not in planned(reference.author_intra_all_years(spark, root))
    # repeated rows, codes that are null or unknown, no year, a document of two years, an author with years far apart; authors of 41 to 44 meet a zero vector
    auth = [(k, 1990 + k % 7, p, (k * (p + 3)) % 5, k % 4) for k in range(30) for p in (0, 1)] + [(3, 1993, 0, 4, 3), (31, 1996, 0, 1, None), (31, 1996, 1, 2, 77), (32, None, 0, 1, 1), (33, 1995, 0, 1, 1), (33, 1996, 1, 2, 1), (34, 2600, 0, 1, 2)]
    auth += [(41, 1991, 0, 8, 9), (42, 1992, 0, 8, 1), (43, 1993, 0, 8, 2), (43, 1993, 1, 9, 2), (44, 1993, 0, 9, 2), (40, 1990, 0, 9, 2)]
    a = spark.createDataFrame(auth, "doc_id long, year int, pos int, author_id long, code long")
    v = spark.createDataFrame([(k, [math.sin(k + 1), math.cos(3 * k), 0.5]) for k in range(4)] + [(9, [0.0, 0.0, 0.0]), (50, None), (51, [])], "code long, vec array<double>")
    got = table(embedding.author_intra_means(a, v, 5).select("year", F.struct("n_rows", "n_distances", "mean")), "year", "struct(n_rows, n_distances, mean)")
    monkeypatch.setattr(embedding, "broadcast_if_fits", lambda df: df)
    want = table(embedding.author_intra_means(a, v, 5).select("year", F.struct("n_rows", "n_distances", "mean")), "year", "struct(n_rows, n_distances, mean)")
    assert len(want) > 4 and math.isnan(want[1993][2])
    assert {k: tuple(r) for k, r in got.items()} == {k: pytest.approx(tuple(r), nan_ok=True) for k, r in want.items()}


def test_text_centroid(spark):
    texts = spark.createDataFrame([(1, "Red, red blue!"), (2, "unknown"), (3, None), (4, "..."), (5, "red " * 20_000)], "doc_id long, text string")
    words = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 3.0])], "word string, vec array<double>")
    got = {r.doc_id: (r.n_tokens, r.vec) for r in embedding.text_centroid(texts, words, 2).collect()}
    assert got == {1: (3, pytest.approx([2 / 3, 1])), 2: (1, [0, 0]), 5: (20_000, [1, 0])}


def test_keywords(spark):
    schema = "id long, year int, kw array<struct<descUI string, year int, category array<string>>>"
    data = [(1, 2000, [("a", 2000, ["X", "Y"]), ("b", 1999, ["X", None]), ("c", None, None)]), (2, 2000, []), (3, 2000, None), (4, None, [("a", 2000, ["X"])]), (5, 2000, [("a", 2000, None)])]
    df = spark.createDataFrame(data, schema)
    assert table(keywords.keyword_novelty(df, "kw"), "doc_id", "novelty_kw") == {1: pytest.approx(1 / 3), 5: 1.0}
    assert table(keywords.keyword_diversity(df, "kw"), "doc_id", "diversity_kw") == {1: pytest.approx(2 / 3)}
    one = spark.createDataFrame([(["B05.051.300", "B05.051.4", "A1", None],)], "t array<string>")
    assert one.select(keywords.tree_prefixes(F.col("t"))).first()[0] == ["A1", "B05.051"]


def test_reference_parsing(spark):
    refs = spark.createDataFrame([(1, 0, "ANON A, 1999, J NAME, V1, P2"), (1, 1, "ANON B, 2000, NO SUCH"), (1, 2, "J NAME"), (2, 0, None), (2, 1, "")], "doc_id long, pos int, cr string")
    journals = spark.createDataFrame([("J NAME", "Cold |Warm"), ("OTHER", None)], "title20 string, web_of_science_categories string")
    got = cleaning.parse_wos(refs, journals)
    assert rows(got, "doc_id", "pos", "journal", "ref_year", "category", "known") == [(1, 0, "J NAME", "1999", ["Cold", "Warm"], True), (1, 1, "NO SUCH", "2000", None, False), (1, 2, "J NAME", None, None, False), (2, 1, "", None, None, False)]
    assert table(cleaning.share_captured(got), "doc_id", "share")[1] == pytest.approx(1 / 3)
    pub = spark.createDataFrame([(1, "J Name. 1999 Jan;1:2", "12"), (2, "1987", "x"), (3, None, None)], "k long, c string, a string")
    assert rows(cleaning.parse_pubmed(pub, "k", "c", "a"), "k", "journal", "ref_year", "ref_id") == [(1, "J Name", "1999", 12), (2, "1987", None, None)]


# ---- reports


def test_reports(spark):
    schema = "doc_id long, year int, s double"
    a = spark.createDataFrame([(k, 1, float(k)) for k in range(1, 6)] + [(9, 1, NAN), (10, 1, INF), (11, 2, None)], schema)
    b = spark.createDataFrame([(k, 1, 3.0 - 2 * k) for k in range(1, 5)] + [(9, 1, 1.0)], schema)
    flat = spark.createDataFrame([(k, 1, 1.0) for k in range(1, 5)], schema)
    scores = reporting.long_scores({("a", "v"): a, ("b", "v"): b, ("c", "v"): flat}, {("a", "v"): "s", ("b", "v"): "s", ("c", "v"): "s"})
    assert rows(reporting.trend(a, "s"), "year", "n", "mean") == [(1, 5, 3.0)]
    got = {(r.a, r.b): (r.n, r.r) for r in reporting.correlations(scores).collect()}
    assert got["v_a", "v_b"] == (4, pytest.approx(-1)) and got["v_a", "v_c"] == (4, None)
    assert {r.indicator: r.n for r in reporting.score_distribution(scores).collect()} == {"a": 5, "b": 5, "c": 4}
    assert reporting.correlations(scores, per_year=False, log=True).count() == 3
    with pytest.raises(ValueError):
        reporting.correlations(scores.filter("indicator = 'a'"))
    lists = spark.createDataFrame([(k, [1] * (k % 3 + 1)) for k in range(200)] + [(999, [1] * 50)], "author_id long, doc_list array<int>")
    assert 50 not in table(reporting.papers_per_author(lists), "n_papers", "n_authors")
    docs = spark.createDataFrame([(1, 1, "t", None), (2, 1, None, None), (3, None, "t", "a")], "id long, year int, title string, abstract string")
    assert rows(reporting.doc_counts({"d": docs}), "collection", "n_docs") == [("d", 3)]
    assert rows(reporting.doc_counts_by_year({"d": docs}), "year", "n_docs") == [(1, 2)]
    assert rows(reporting.field_availability(docs, ["title", "abstract"], []), "n_docs", "n_title", "n_abstract") == [(3, 2, 1)]
    assert rows(reporting.list_size_density(lists, "doc_list"), "size", "n_docs") == [(1, 67), (2, 67)]  # the percentile is 3
    assert rows(reporting.list_sizes(spark.createDataFrame([(1, [1, 2]), (1, []), (1, None)], "year int, x array<int>"), "x", ["year"]), "n_docs", "mean", "variance") == [(2, 1.0, 1.0)]


# ---- ranks, odd inputs, reading and writing


def test_ranks_across_partitions(spark):
    df = spark.createDataFrame([(k % 2 if k % 5 else None, k * 37 % 101, "x") for k in range(101)], "g int, o int, _n string")
    got = ranked(df, ["g"], ["o"], "place").collect()
    for g in (0, 1, None):
        mine = sorted((r.o, r.place) for r in got if r.g == g)
        assert [p for _, p in mine] == list(range(1, len(mine) + 1))
    assert sorted(r.place for r in ranked(df, [], ["o"], "place").collect()) == list(range(1, 102))
    assert ranked(df.limit(0), ["g"], ["o"], "place").count() == 0


def test_odd_documents(spark):
    data = [(1, 1, [("A", 1), (None, 1), ("", 1), ("A", None), ("B", 2)]), (2, None, [("A", 1)] * 3), (3, 1, None), (4, 1, []), (None, 1, [("A", 1)]), (5, 1, [("C", 1)] * 3)]
    items = model.doc_items(spark.createDataFrame(data, model.ITEMS_SCHEMA).withColumn("item", F.lit("clash")), "items", "item")
    assert rows(items, "doc_id", "item", "item_year") == [(1, "A", 1), (1, "A", None), (1, "B", 2), (5, "C", 1), (5, "C", 1), (5, "C", 1)]
    assert rows(cooc(items), "i", "j", "w") == [("A", "A", 1), ("A", "B", 2), ("C", "C", 3)]
    assert table(cooccurrence.commonness(items), "doc_id", "novelty").keys() == {1, 5}
    none = items.limit(0)
    assert cooccurrence.commonness(none).count() == 0 and cooccurrence.atypicality(none, 2).count() == 0 and cooccurrence.reuse_novelty(none, 1, 1).count() == 0
    wanted = spark.createDataFrame([("5",), ("5",)], "id string")
    assert table(P.only_ids(cooccurrence.commonness(items), wanted), "doc_id", "novelty").keys() == {5}
    assert P.only_ids(items, None) is items


def test_years_in_and_out(spark, tmp_path, items):
    docs = [{"id": k, "year": y, "items": [{"item": p.split("@")[0], "year": int(p.split("@")[1])} for p in t.split()]} for k, (y, t) in G1.items()]
    for y in range(1, 6):
        (tmp_path / f"{y}.json").write_text(json.dumps([d for d in docs if d["year"] == y], indent=1))
    read = collections.json_years(spark, str(tmp_path), model.ITEMS_SCHEMA)
    assert rows(model.doc_items(read, "items", "item"), "doc_id", "item") == rows(items, "doc_id", "item")
    assert collections.json_years(spark, str(tmp_path), model.ITEMS_SCHEMA, [2, 77]).count() == 2
    assert collections.json_years(spark, str(tmp_path), model.ITEMS_SCHEMA, [77]).count() == 0
    assert collections.years_of(read) == [1, 2, 3, 4, 5]
    path = str(tmp_path / "cooc")
    sinks.write_years(cooc(items), path)
    sinks.write_years(cooc(items).filter("year = 3").withColumn("w", F.lit(7).cast("long")), path)  # only year 3 is replaced
    back = collections.parquet_years(spark, path, 2, 4)
    assert {r.year for r in back.collect()} == {2, 3} and {r.w for r in back.filter("year = 3").collect()} == {7}
    assert collections.parquet_years(spark, path).filter("year = 1").count() == 4
    sinks.write_result(cooccurrence.commonness(items), str(tmp_path / "r"), sinks.result_key("items", "commonness"))
    assert spark.read.parquet(str(tmp_path / "r/items_commonness")).count() == 10
    sinks.write_json_years(cooccurrence.commonness(items), str(tmp_path / "j"), "k")
    assert spark.read.json(str(tmp_path / "j")).select("k.novelty").count() == 10
    assert sinks.result_key("v", "reuse", 3, 2, 50) == "v_reuse_3_2_restricted50"


def test_tagged_export(spark, tmp_path):
    (tmp_path / "savedrecs1.txt").write_text(
        "﻿FN Export\nVR 1.0\nPT J\nAU One, A\n   Two, B\nTI A title\n   that goes on\nCR One A, 1999, J NAME, V1\n   Two B, 2000, OTHER\nPM 123\nER\n\nPT J\nTI No references\nPM 5\nER\n\nPT J\r\nCR X, 2001, J NAME\r\nPM abc\r\nER\n\nEF\n"
    )
    got = collections.tagged_records(spark, str(tmp_path / "savedrecs*.txt")).collect()
    assert sorted((r.pmid, r.cr) for r in got if r.pmid) == [(123, ["One A, 1999, J NAME, V1", "Two B, 2000, OTHER"])]
    assert {r.pmid for r in got} == {123, None} and next(r for r in got if r.pmid).fields["AU"] == ["One, A", "Two, B"]


def test_journal_csvs(spark, tmp_path):
    (tmp_path / "wos-jcr.csv").write_text("Title,Title20\nJournal of A,J A\nJournal of B,J B\n")
    (tmp_path / "core_1.csv").write_text("Journal title,Web of Science Categories\nJournal of A,Cold |Warm\nJournal of A,Zebra\n")
    (tmp_path / "core_2.csv").write_text("Journal title,Languages\nJournal of C,en\n")
    rank, files = collections.journal_csvs(spark, str(tmp_path / "wos-jcr.csv"), str(tmp_path / "core_*.csv"))
    got = cleaning.journal_list(rank, files, "Journal title")
    assert got.count() == 2 and set(files.columns) == {"Journal title", "Web of Science Categories", "Languages"}


def test_abstracts(spark):
    nested = spark.createDataFrame([([("text",)],), ([],), (None,)], "abstract array<struct<AbstractText string>>")
    assert [r[0] for r in nested.select(model.abstract_text("abstract", nested.schema[0].dataType)).collect()] == ["text", None, None]
    plain = spark.createDataFrame([("text",)], "abstract string")
    assert plain.select(model.abstract_text("abstract", plain.schema[0].dataType)).first()[0] == "text"

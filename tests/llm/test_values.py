"""Problems 1, 3 and 6 against brute force and on odd inputs."""

from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import canonical, frequency, queries, together

LIST = [(1, "J EXP NEUROGRAPH", "Journal of Experimental Neurographics"), (2, "ANN SCLERONOM A", "Annals of Scleronomics Series A"), (3, "ANN SCLERONOM B", "Annals of Scleronomics Series B")]
LIST += [(4, "COMPUT OSTEOMORPH CO", "Computational Osteomorphics Communications"), (5, "CLIN CRYODYN COMMUN", "Clinical Cryodynamics Communications"), (6, "CRYOLITH THALASSONOM", "Cryolithics and Thalassonomics")]
LIST += [(7, "ANN OSTEOMORPH", "Annals of Osteomorphics")]


def distance(a: str, b: str) -> int:
    """Edits with adjacent swaps, each part edited once, by the plain table."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return int(d[-1, -1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=6, unique=True), st.text("abcd", min_size=1, max_size=8), st.integers(0, 3))
def test_automaton_finds_all_within_reach(paths, value, edits):
    trie = bare_trie(dict(enumerate(paths)))
    want = {k: distance(value, p) for k, p in enumerate(paths)}
    assert trie.within([value, "", value * 20], edits)[0] == {k: d for k, d in want.items() if d <= edits}
    assert {k for k, p in enumerate(paths) if p == value} == trie.exact(value)


def bare_trie(paths):
    """A trie of these very paths."""
    trie = canonical.Trie([])
    trie.root, trie._after = {}, {}
    for k, p in paths.items():
        node = trie.root
        for c in p:
            node = node.setdefault(c, [{}])[0]
        node.setdefault("", set()).add(k)
    trie._flatten()
    return trie


def test_walks_in_small_parts(monkeypatch):
    trie, texts = canonical.Trie(LIST), ["Annals of Scleronmics", "Jnl of Exp Neurographics", "zzz", "Annals of Osteomorphics A" * 9]
    want = trie.candidates(texts)
    monkeypatch.setattr(canonical, "STATES", 7)
    assert trie.candidates(texts) == want


@pytest.mark.parametrize("value", ["Journal of Exp and Computational Chronolithics", "J Experimental and Comput Chronolith", "Jnl of Experimental Comput Chronolithics", "Exp Computational Chronolith J of"])
def test_any_mixture_of_long_and_short_words(value):
    listed = LIST + [(8, "J EXP COMPUT CHRONO", "Journal of Experimental and Computational Chronolithics"), (9, "CHRONOLITH LETT", "Chronolithics Letters"), (10, "EXP COMPUT LETT", "Experimental Computational Letters")]
    assert canonical.nearest(canonical.Trie(listed).candidates([value])[0])[0] == 8


def test_all_entries_within_reach(spark):
    """Against the plain edit table over every path of every entry."""
    df = spark.createDataFrame([(v,) for v in ("annals of scleronomics series a", "Ann Scleronom", "Annals of Osteomorphic", "j exp neurograpj", "zzz", None)], "value string")
    got = {(r.value, r.entry): r.distance for r in canonical.canonical_candidates(df, "value", LIST).collect()}
    assert got == {("annals of scleronomics series a", 2): 0, ("Annals of Osteomorphic", 7): 1, ("j exp neurograpj", 1): 1}
    several = [(1, "ALPHA METR", "Alpha Metrics"), (2, "ALPHA METRIC", "Alpha Matrics"), (3, "BETA", "Beta")]
    near = canonical.canonical_candidates(spark.createDataFrame([("Alpha Metrics",)], "value string"), "value", several).collect()
    assert {(r.entry, r.distance) for r in near} == {(1, 0), (2, 1)}


def test_long_lists_go_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([("Annals of Scleronmics Series A", 1), ("Alpha Metrics", 2), ("Alpha Mtrics", 2), ("zzz", 3), ("ann osteomorph", 4)], "value string, n int")
    listed = LIST + [(8, "ALPHA METR", "Alpha Metrics"), (9, "ALPHA MTR", "Alpha Mutrics")]
    want = sorted(map(tuple, canonical.canonical_values(df, "value", listed).collect()))
    near = sorted(map(tuple, canonical.canonical_candidates(df, "value", listed).collect()))
    monkeypatch.setattr(canonical, "PART", 2)
    assert sorted(map(tuple, canonical.canonical_values(df, "value", listed).collect())) == want
    assert sorted(map(tuple, canonical.canonical_candidates(df, "value", listed).collect())) == near
    assert dict((v, (e, t)) for v, e, _, t in want)["Alpha Mtrics"] == (-1, 2)


@pytest.mark.parametrize(
    "typed, want",
    [(t, 1) for t in ("j exp neurograph", "Journal of Experimental Neurographics.", "in: The Journal of Experimental Neurographics [print]", "Jnl of Experimental Neurographics", "Experimental Neurographics, Journal of", "JOURNAL OF EXPERIMENTAL NEUROGRPAHCS", "(J. Exp. Neurögraph.)", "journal-of-experimental_neurographics, vol. 12", "Journal Experimental Neurographics 1989")]
    + [("Ann Scleronom B", 3), ("Annals of Scleronmics Series A", 2), ("Annals Scleronomics Series B", 3), ("Comput Osteomorph Commun", 4), ("Cryolithics &amp; Thalassonomics", 6)]
    + [(t, -1) for t in ("Ann Scleronom C", "Annals of Osteomorphics Series A", "Ann Osteomorph A", "Ann Scleronom", "Journal of Experimental Neurocladology", "Book: Sira", "n/a", "???", "x" * 5000)],
)
def test_match(typed, want):
    assert canonical.nearest(canonical.Trie(LIST).candidates([typed])[0])[0] == want


def test_canonical_values_of_odd_tables(spark):
    df = spark.createDataFrame([("ann osteomorph", 1), ("ann osteomorph", 2), (None, 3), ("  ", 4), ("zzz", 5)], "value string, entry int")
    got = {r.value: (r.entry, r.distance, r.tied) for r in canonical.canonical_values(df, "value", LIST).collect()}
    assert got == {"ann osteomorph": (7, 0, 1), "zzz": (-1, -1, 0)}
    assert {r.entry for r in canonical.canonical_values(df, "value", []).collect()} == {-1}
    assert canonical.canonical_values(df.limit(0), "value", LIST).count() == 0


def test_p1_recovers_known_titles(spark):
    """Full titles and cut titles in other case must come out as their own journal."""
    root = "/root/testdata/sf0.01"
    listed = spark.read.parquet(f"{root}/wos_jcr.parquet")
    typed = listed.select(F.col("jcr_id"), F.explode(F.array(F.lower("title20"), F.upper("journal_title"), F.concat(F.lit("The "), "journal_title"))).alias("t"))
    got = canonical.canonical_values(typed, "t", [tuple(r) for r in listed.select("jcr_id", "title20", "journal_title").collect()])
    assert typed.join(got, typed.t == got.value).filter("entry <> jcr_id").count() == 0


def brute_pairs(lists):
    out = Counter()
    for items in lists:
        out.update(combinations(sorted(items, key=lambda s: s.encode()), 2))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "dd", "é", "Z", "\U0001f600", "￿", "e", "f"]), unique=True, max_size=8), max_size=30), st.lists(st.sampled_from(["a", "dd", "é", "none"]), unique=True))
def test_block_pairs(lists, heavy):
    names, a, b, n = together.block_pairs(pa.array(lists, pa.list_(pa.string())), heavy)
    names = names.to_pylist()
    got = {(names[i], names[j]): k for i, j, k in zip(a.tolist(), b.tolist(), n.tolist())}
    assert got == dict(brute_pairs(lists))


def test_pairs_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(together, "PAIRS", 7)
    rng = np.random.default_rng(1)
    lists = [[f"i{x}" for x in set(rng.zipf(1.4, 12) % 50)] + ["hot"] for _ in range(300)]
    names, a, b, n = together.block_pairs(pa.array(lists), ["hot", "i1"])
    names = names.to_pylist()
    assert {(names[i], names[j]): k for i, j, k in zip(a, b, n)} == dict(brute_pairs(lists))
    records = spark.createDataFrame([(x,) for x in lists] + [([],), (None,)], "items array<string>")
    got = {(r.item_a, r.item_b): (r.n_both, r.n_records) for r in together.pairs_together(records).collect()}
    assert got == {k: (v, 300) for k, v in brute_pairs(lists).items()}
    strict = {(r.item_a, r.item_b) for r in together.pairs_together(records, 5, 20, 2).collect()}
    single = Counter(x for items in lists for x in items)
    assert strict == {(x, y) for (x, y), k in brute_pairs(lists).items() if k >= 6 and k * 300 >= 2 * single[x] * single[y]}


def test_counts_too_large_to_send(spark, monkeypatch):
    records = spark.createDataFrame([(["a", "b", "hot"],), (["b", "hot"],), (["c", "hot"],)], "items array<string>")
    want = sorted(map(tuple, together.pairs_together(records).collect()))
    monkeypatch.setattr(together, "broadcast_if_fits", lambda df: df)
    assert sorted(map(tuple, together.pairs_together(records).collect())) == want and len(want) == 4


def test_pairs_of_nothing(spark):
    empty = spark.createDataFrame([], "items array<string>")
    assert together.pairs_together(empty).count() == 0
    assert together.pairs_together(spark.createDataFrame([(["a"],), ([],)], "items array<string>"), 5, 1, 10).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=6), max_size=12), st.integers(1, 5), st.integers(0, 4))
def test_last_seen_counters(records, cut, states):
    rows = [(k, t) for k, terms in enumerate(records) for t in terms]
    batches = [pd.DataFrame(rows[i : i + cut], columns=["rec", "term"]) for i in range(0, len(rows), cut)]
    occ, rec = Counter(), Counter()
    for pdf in frequency.last_seen(iter(batches), states):
        for t, o, r in zip(pdf["term"], pdf["n_occ"], pdf["n_rec"]):
            occ[t] += o
            rec[t] += r
    seen = defaultdict(set)
    for k, t in rows:
        seen[t].add(k)
    assert occ == Counter(t for _, t in rows)
    assert rec == Counter({t: len(s) for t, s in seen.items()})


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (1, "a", 0), (1, "", 0), (None, "a", 0), (3, None, 0)], "rec long, term string, n_rec int")
    got = {r.term: (r.n_occurrences, r.n_records) for r in frequency.term_counts(df, "rec", "term").collect()}
    assert got == {"a": (3, 2), "": (1, 1)}
    assert frequency.term_counts(df.limit(0), "rec", "term").count() == 0
    counts = spark.createDataFrame([("x", 1, 1), ("y", 9, 3), ("z", 9, 6)], "term string, n_occurrences long, n_records long")
    marks = {r.term: r.mark for r in frequency.marked(counts, spark.createDataFrame([(100,)], "n long")).collect()}
    assert marks == {"x": "rare", "y": None, "z": "common"}


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_sql(spark, root, name):
    from compare import compare, views

    assert compare(spark, views(root), root, queries.queries()[name], queries.oracles()[name]) == ""

"""Queries do the whole job of their operators, not a part of it."""

import inspect
import random

import pytest

from citeloom.operators import cooccurrence, graph
from citeloom.plans import reference


def test_shuffles_draw_the_operators_samples(spark, root):
    wanted = inspect.signature(cooccurrence.atypicality).parameters["samples"].default
    assert wanted == 20
    assert {r.k for r in reference.uzzi_shuffle(spark, root).select("k").distinct().collect()} == set(range(1, wanted + 1))


def plain_louvain(edges):
    """One node after the other, as published, for comparison."""
    label, old = {x: x for e in edges for x in e}, None
    total = sum(edges.values())
    members = {x: [x] for x in label}
    level = dict(edges)
    while old != label:
        old = dict(label)
        near, degree = {x: {} for x in members}, dict.fromkeys(members, 0)
        for (a, b), w in level.items():
            degree[a] += w
            degree[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        at, sums, moved = {x: x for x in members}, dict(degree), True
        while moved:
            moved = False
            for x in sorted(members):
                links = {at[x]: 0}
                for y, w in near[x].items():
                    links[at[y]] = links.get(at[y], 0) + w
                sums[at[x]] -= degree[x]
                best = max(sorted(links), key=lambda c: (links[c] - sums[c] * degree[x] / (2 * total), c == at[x]))
                moved |= best != at[x]
                at[x] = best
                sums[best] += degree[x]
        merged = {}
        for x, c in at.items():
            merged.setdefault(c, []).extend(members[x])
        members, new = merged, {}
        for (a, b), w in level.items():
            pair = tuple(sorted((at[a], at[b])))
            new[pair] = new.get(pair, 0) + w
        level = new
        label = {x: c for c, xs in members.items() for x in xs}
    return label


def random_graph(nodes, groups, seed):
    rng = random.Random(seed)
    group = [rng.randrange(groups) for _ in range(nodes)]
    return {(f"n{a:03}", f"n{b:03}"): rng.randint(1, 3) for a in range(nodes) for b in range(a, nodes) if rng.random() < (0.3 if group[a] == group[b] else 0.03)}


@pytest.mark.parametrize("seed", range(4))
def test_louvain_is_as_good_as_the_plain_one(seed):
    edges = random_graph(120, 2 + 2 * seed, seed)
    assert graph.modularity(edges, graph.louvain(edges)) >= 0.985 * graph.modularity(edges, plain_louvain(edges))


def test_communities_are_the_same_at_every_size(spark, monkeypatch):
    edges = random_graph(26, 3, 1)
    df = spark.createDataFrame([(b, a, w) for (a, b), w in edges.items()], "i string, j string, w long")
    small = {r.item: r.community for r in graph.communities(df).collect()}
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", len(edges) - 1)  # one level by joins, the others in one task
    large = {r.item: r.community for r in graph.communities(df).collect()}
    assert small == large == {x: str(c) for x, c in graph.louvain(edges).items()} and len(set(small.values())) > 1


def test_propagation_that_does_not_settle_is_an_error(spark):
    with pytest.raises(RuntimeError):
        graph._by_joins(spark.createDataFrame([(f"n{k:02}", f"n{k + 1:02}", 1) for k in range(29)], "i string, j string, w long"), rounds=1)


def test_abstracts_are_embedded(spark, root):
    texts = reference._texts(spark, root)
    got = {r.doc_id for r in reference.queries()["text_centroid_abstract"](spark, root).select("doc_id").collect()}
    assert got and got == {r.doc_id for r in texts.filter("abstract rlike '[A-Za-z0-9]'").select("doc_id").collect()}

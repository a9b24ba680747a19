"""Communities of a weighted graph given as an edge table (i, j, w)."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators.ranking import ranked
from citeloom.runtime import cut, stored

#: Edges that one task may hold (some 400 MB, 18 s); more are kept as a table. The result is the same on either side.
ONE_TASK_EDGES = 1_000_000
#: Nodes move in so many turns; after so many turns without a better partition a level has settled; bits of a node's number that turns look at.
TURNS, PATIENCE, BITS = 4, 8, 20


def modularity(edges: dict[tuple, float], label: dict, resolution: float = 1.0) -> float:
    """Modularity of a partition; edges hold each pair once, loops count twice in a degree."""
    total, inside, degree = sum(edges.values()), {}, {}
    for (a, b), w in edges.items():
        degree[label[a]] = degree.get(label[a], 0) + w
        degree[label[b]] = degree.get(label[b], 0) + w
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + w
    return sum(inside.get(c, 0) / total - resolution * (d / (2 * total)) ** 2 for c, d in degree.items()) if total else 0.0


def _settle(a: np.ndarray, b: np.ndarray, w: np.ndarray, names: np.ndarray, resolution: float) -> np.ndarray:
    """The community of every node, as the index of one of its nodes, after moving nodes of one level while modularity rises."""
    n, total, loop = len(names), float(w.sum()), a == b
    degree = np.bincount(a, w, n) + np.bincount(b, w, n)
    x, y, weight = np.r_[a[~loop], b[~loop]], np.r_[b[~loop], a[~loop]], np.r_[w[~loop], w[~loop]]
    label = best = np.arange(n)
    most, worse, still = -np.inf, 0, 0
    for turn in count():
        pairs, at = np.unique(x * n + label[y], return_inverse=True)
        links, node, there = np.bincount(at, weight), pairs // n, pairs % n
        home = there == label[node]
        own = np.zeros(n)
        own[node[home]] = links[home]
        sums = np.bincount(label, degree, n)
        rise = 2 * total * own.sum() - resolution * (degree * sums[label]).sum()  # modularity but for constants
        most, best, worse = (rise, label, 0) if rise > most else (most, best, worse + 1)
        if worse >= PATIENCE or still >= TURNS or not len(pairs):
            return best
        gain = 2 * total * links - resolution * degree[node] * (sums[there] - np.where(home, degree[node], 0))
        stay = 2 * total * own - resolution * degree * (sums[label] - degree)
        first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        top = np.maximum.reduceat(gain, first)
        choice = np.minimum.reduceat(np.where(gain == np.repeat(top, np.diff(np.r_[first, len(node)])), there, n), first)
        node = node[first]
        moves = (top > stay[node]) & ((names[node] >> turn // TURNS % BITS) % TURNS == turn % TURNS)
        label = label.copy()
        label[node[moves]] = choice[moves]
        still = 0 if moves.any() else still + 1


def _levels(a: np.ndarray, b: np.ndarray, w: np.ndarray, names: np.ndarray, resolution: float) -> np.ndarray:
    """The community of every node, as the name of one of its nodes, after settling level upon level. a and b are places in `names`, which ascend."""
    member, kept = np.arange(len(names)), names
    while len(w) and w.sum():
        some, label = np.unique(_settle(a, b, w, kept, resolution), return_inverse=True)
        if len(some) == len(kept):
            break
        member, kept = label[member], kept[some]
        pair, at = np.unique(np.minimum(label[a], label[b]) * len(some) + np.maximum(label[a], label[b]), return_inverse=True)
        a, b, w = pair // len(some), pair % len(some), np.bincount(at, w)
    return kept[member]


def louvain(edges: dict[tuple, float], resolution: float = 1.0) -> dict:
    """{node: community} by local moving and aggregation. A quarter of the nodes, in turns by the bits of their numbers in sorted order, moves at
    once to the community with the highest gain, ties to the smallest number; so the result is always the same, also by `louvain_joins`."""
    nodes = sorted({x for e in edges for x in e})
    number = {x: k for k, x in enumerate(nodes)}
    a, b = (np.array([number[e[k]] for e in edges], np.int64) for k in (0, 1))
    w = np.array(list(edges.values()), float)
    return dict(zip(nodes, _levels(a, b, w, np.arange(len(nodes)), resolution).tolist()))


def _levels_frame(resolution: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(np.r_[pdf["a"].to_numpy(), pdf["b"].to_numpy()], return_inverse=True)
        label = _levels(at[: len(pdf)], at[len(pdf) :], pdf["w"].to_numpy(float), names, resolution)
        return pd.DataFrame({"node": names, "label": label})

    return levels


def _settle_joins(edges: DataFrame, resolution: float) -> DataFrame:
    """(node, label) as _settle gives them, of edges (a, b, w) in which every pair stands once."""
    both = edges.filter("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y"), "w")
    both = stored(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"), "w")))
    ends = edges.select(F.col("a").alias("node"), "w").unionByName(edges.select(F.col("b").alias("node"), "w"))
    total = edges.agg(F.sum("w")).first()[0]
    state = stored(ends.groupBy("node").agg(F.sum("w").alias("degree")).withColumn("label", F.col("node")))
    most, best, worse, still = float("-inf"), state, 0, 0
    for turn in count():
        sums = state.groupBy("label").agg(F.sum("degree").alias("sums"))
        links = both.join(state.select(F.col("node").alias("y"), F.col("label").alias("there")), "y").groupBy("x", "there").agg(F.sum("w").alias("links"))
        mine = state.select(F.col("node").alias("x"), "degree", "label")
        home = F.col("there") == F.col("label")
        gain = 2 * total * F.col("links") - resolution * F.col("degree") * (F.col("sums") - F.when(home, F.col("degree")).otherwise(0))
        offers = links.join(sums.withColumnRenamed("label", "there"), "there").join(mine, "x").select("x", "there", gain.alias("gain"), F.when(home, F.col("links")).alias("own"))
        chosen = offers.groupBy(F.col("x").alias("node")).agg(F.max("gain").alias("top"), F.min_by("there", F.struct(-F.col("gain"), "there")).alias("choice"), F.max("own").alias("own"))
        stay = 2 * total * F.coalesce("own", F.lit(0.0)) - resolution * F.col("degree") * (F.col("sums") - F.col("degree"))
        turns = F.pmod(F.shiftright("node", turn // TURNS % BITS), F.lit(TURNS)) == turn % TURNS
        moves = F.coalesce((F.col("top") > stay) & turns, F.lit(False))
        step = state.join(sums, "label").join(chosen, "node", "left").select("node", "degree", "label", "sums", "own", F.when(moves, F.col("choice")).otherwise(F.col("label")).alias("next"))
        step = stored(step)
        inside, square, moved, pairs = step.agg(F.sum("own"), F.sum(F.col("degree") * F.col("sums")), F.count_if(F.col("next") != F.col("label")), F.count("own")).first()
        rise = 2 * total * (inside or 0.0) - resolution * square
        most, best, worse = (rise, state, 0) if rise > most else (most, best, worse + 1)
        if worse >= PATIENCE or still >= TURNS:
            return best.select("node", "label")
        state = step.select("node", "degree", F.col("next").alias("label"))
        still = 0 if moved else still + 1


def louvain_joins(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(item, community): what `louvain` finds, for graphs of any size: the nodes' labels are a table, and every turn is a few joins and sums by key,
    of which only totals come to the driver. A level of at most ONE_TASK_EDGES edges goes to one task. edges: i, j, w, every pair once."""
    index = stored(ranked(edges.select(F.explode(F.array("i", "j")).alias("item")).distinct(), [], ["item"], "node").withColumn("node", F.col("node") - 1))
    coded = edges.join(index.select(F.col("item").alias("i"), F.col("node").alias("a")), "i").join(index.select(F.col("item").alias("j"), F.col("node").alias("b")), "j")
    level, member = stored(coded.select("a", "b", F.col("w").cast("double").alias("w"))), index.withColumn("label", F.col("node")).drop("node")
    size = index.count()
    while size:
        small = level.count() <= ONE_TASK_EDGES  # what is left of the graph is settled at once
        labels = level.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(_levels_frame(resolution), "node long, label long") if small else _settle_joins(level, resolution)
        labels = stored(labels)
        member = stored(member.join(labels.withColumnRenamed("label", "next"), F.col("label") == F.col("node")).select("item", F.col("next").alias("label")))
        many = labels.select("label").distinct().count()
        if small or many == size:
            break
        size = many
        of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        pairs = level.join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "w")
        level = stored(pairs.groupBy("a", "b").agg(F.sum("w").alias("w")))
    return member.select("item", F.col("label").cast("string").alias("community"))


def _by_joins(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(item, community): label propagation by weight. A different algorithm with bounded state, only for callers who name it.

    In every round half of the nodes (by hash, in turns) take the label with the most weight among their neighbours, ties to the
    smallest; it ends when a pair of rounds changes nothing. Labels that still change after `rounds` are an error.
    """
    both = stored(edges.filter("i <> j").select(F.col("i").alias("item"), F.col("j").alias("other"), "w").unionByName(edges.filter("i <> j").select(F.col("j").alias("item"), F.col("i").alias("other"), "w")))
    nodes = edges.select(F.explode(F.array("i", "j")).alias("item")).distinct()
    labels, still = stored(nodes.withColumn("community", F.col("item"))), 0
    for k in range(rounds):
        seen = both.filter(F.pmod(F.xxhash64("item"), F.lit(2)) == k % 2).join(labels.withColumnRenamed("item", "other"), "other").groupBy("item", "community").agg(F.sum("w").alias("w"))
        best = seen.groupBy("item").agg(F.min_by("community", F.struct(-F.col("w"), "community")).alias("best"))
        labels_ = labels.join(best, "item", "left").select("item", F.coalesce("best", "community").alias("community"), (F.col("best") != F.col("community")).alias("moved"))
        labels_ = stored(labels_)
        still = 0 if labels_.filter("moved").limit(1).count() else still + 1
        labels = labels_.select("item", "community")
        if still >= 2:
            return labels
    raise RuntimeError(f"labels still change after {rounds} rounds")


def _louvain_frame(pdf: pd.DataFrame) -> pd.DataFrame:
    got = louvain({(a, b): w for a, b, w in zip(pdf["i"], pdf["j"], pdf["w"])})
    return pd.DataFrame({"item": list(got), "community": [str(c) for c in got.values()]})


#: Community algorithms by name: a function of an edge frame that returns (item, community).
ALGORITHMS: dict[str, Callable[[DataFrame], DataFrame]] = {"propagation": _by_joins}


def communities(edges: DataFrame, algorithm: str = "louvain") -> DataFrame:
    """(item STRING, community STRING) of the nodes of (i, j, w). 'louvain' gives the same partition at every size: up to ONE_TASK_EDGES edges,
    which are counted, one task computes it, beyond that joins do. 'propagation' is another algorithm. An unknown name is an error.
    Nodes without edges don't appear: callers treat them as alone."""
    ordered = edges.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")
    edges = ordered.groupBy("i", "j").agg(F.sum("w").alias("w"))
    if algorithm == "louvain":
        edges = cut(edges)
        if edges.count() > ONE_TASK_EDGES:
            return louvain_joins(edges)
        return edges.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(_louvain_frame, "item string, community string")
    if algorithm not in ALGORITHMS:
        raise ValueError(f"no community algorithm {algorithm}; known are louvain, {', '.join(sorted(ALGORITHMS))}")
    return ALGORITHMS[algorithm](edges)

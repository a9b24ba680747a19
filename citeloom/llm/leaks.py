"""Evaluation texts leaking into training text (problem 9): suffix arrays over shards of the corpus.

A shard is a run of documents of one task. Its words become numbers, 0 for words of no test item. The suffixes that can match (their first
words stand so in some item) are brought into full order: a sparse suffix array, since other suffixes begin no match. Every suffix of every
item is looked up in it by binary search, which gives its longest verbatim match and where that lies. A match of enough words is a case.
For altered copies the places of the short matches are counted by document and item, and only pairs that hold as many as a copy must are
aligned, with the least changed, dropped and added words wherever these lie. No text leaves its task but the (document, item) cases.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import words
from citeloom.runtime import widen

#: Words of a shard; words of items searched for in one pass (more are searched for in further passes); counts held at once.
SHARD, PASS_WORDS, HELD = 400_000, 2_000_000, 4_000_000


def seed_words(least: int, one_in: int) -> int:
    """The words of the longest verbatim run that every copy has. 20 words with 3 changed ones have a run of 5, 24 with 4 one of 4."""
    return max(1, min(-(-(n - n // one_in) // (n // one_in + 1)) for n in range(least, 3 * least)))


def seeds_needed(least: int, one_in: int) -> int:
    """How many places of an item begin a run of seed_words words that a copy keeps: an edit takes away as many as such a run has words."""
    seed = seed_words(least, one_in)
    return max(1, min(n - seed + 1 - seed * (n // one_in) for n in range(least, 3 * least)))


class Items:
    """The test items as numbers, with the runs of `seed` words by which documents are compared with them."""

    def __init__(self, rows: Iterable[tuple[int, str | list[str]]], seed: int = seed_words(20, 6)):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.codes, self.seed = [], [], seed
        for item, text in rows:
            tokens = words(text or "") if not isinstance(text, list) else text
            self.ids.append(item)
            self.codes.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens], np.int64))
        # items are laid end to end with a 0 behind each, which matches nothing
        self.flat = np.concatenate([x for codes in self.codes for x in (codes, np.zeros(1, np.int64))] or [np.zeros(1, np.int64)])
        self.start = np.cumsum([0] + [len(c) + 1 for c in self.codes])[:-1]
        owner = np.repeat(np.arange(len(self.codes)), [len(c) + 1 for c in self.codes])
        # a run's number is found word by word: from the number of the run without its last word, and that word; numbers are in the order of the words
        self.tables: list[np.ndarray] = []
        places, number = np.flatnonzero(self.flat > 0), self.flat[self.flat > 0]
        for k in range(1, seed):
            inside = places + k < len(self.flat)
            places, number = places[inside], number[inside]
            word = self.flat[places + k]
            places, key = places[word > 0], (number << 32 | word)[word > 0]
            table, number = np.unique(key, return_inverse=True)
            self.tables.append(table)
        self.suffixes, self.runs = places, number
        order = np.argsort(number, kind="stable")
        self.owners = owner[places[order]]  # the items that have each run, once per place
        self.first = np.searchsorted(number[order], np.arange((number.max() if len(number) else -1) + 2))

    def runs_of(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers of the runs) of a shard, where a run of some item begins."""
        places, number = np.flatnonzero(flat > 0), flat[flat > 0]
        for k, table in enumerate(self.tables, 1):
            inside = places + k < len(flat)
            places, number = places[inside], number[inside]
            key = number << 32 | flat[places + k]
            at = np.minimum(np.searchsorted(table, key), max(0, len(table) - 1))
            hit = table[at] == key if len(table) else np.zeros(len(key), bool)
            places, number = places[hit], at[hit]
        return places, number


def suffix_array(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The given places of `flat` in the full order of their suffixes, each up to the next 0, by prefix doubling; equal ones by place."""
    zeros = np.flatnonzero(flat == 0)
    stretch = np.searchsorted(zeros, np.arange(len(flat)))  # of known words, each with the 0 behind it
    wanted = np.zeros(len(zeros) + 1, bool)
    wanted[stretch[places]] = True
    used = np.flatnonzero((flat > 0) & wanted[stretch])
    end = np.r_[zeros, len(flat)][stretch[used]]
    rank = np.zeros(len(flat) + 1, np.int64)
    rank[used] = np.unique(flat[used], return_inverse=True)[1] + 1
    classes, size = -1, 1
    while True:
        second = np.where(used + size < end, rank[np.minimum(used + size, len(flat))], 0)
        keys, number = np.unique(rank[used] << 32 | second, return_inverse=True)
        rank[used] = number + 1
        if len(keys) in (classes, len(used)):
            return places[np.argsort(rank[places], kind="stable")]
        classes, size = len(keys), 2 * size


def common(a: np.ndarray, p: np.ndarray, b: np.ndarray, q: np.ndarray, least: int, limit: int) -> np.ndarray:
    """How many words a[p:] and b[q:] share from their beginning, up to `limit`; `least` of them are known to. A 0 ends both."""
    n = np.full(len(p), least, np.int64)
    going = np.arange(len(p)) if limit > least else np.zeros(0, np.int64)
    while len(going):
        x = a[p[going] + n[going]]
        going = going[(x == b[q[going] + n[going]]) & (x > 0)]
        n[going] += 1
        going = going[n[going] < limit]
    return n


def bound(items: Items, p: np.ndarray, shard: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, limit: int, after: bool) -> np.ndarray:
    """The binary searches of all item suffixes p within [lo, hi) of the suffix array, a step of each at a time: the first suffix that is not
    below the item's in the order of the first `limit` words, or, with `after`, the first above it."""
    lo, hi = lo.copy(), hi.copy()
    while len(open_ := np.flatnonzero(lo < hi)):
        mid = (lo[open_] + hi[open_]) // 2
        a, b = p[open_], array[mid]
        n = common(items.flat, a, shard, b, items.seed, limit)
        mine, its = items.flat[np.minimum(a + n, len(items.flat) - 1)], shard[np.minimum(b + n, len(shard) - 1)]
        right = (n >= limit) | (its <= mine) if after else (n < limit) & (its < mine)
        lo[open_[right]], hi[open_[~right]] = mid[right] + 1, mid[~right]
    return lo


def longest(shard: np.ndarray, items: Items) -> tuple[np.ndarray, ...]:
    """(item places, suffix array, first and end of the suffixes that begin with the item suffix's first seed words, words of the longest match)
    for all item suffixes that match `seed` words or more."""
    places, run = items.runs_of(shard)
    if not len(places):
        return (np.zeros(0, np.int64),) * 5
    array = suffix_array(shard, places)
    number = np.empty(len(shard), np.int64)
    number[places] = run
    ordered = number[array]  # runs are numbered in the order of their words, so they ascend
    lo, hi = np.searchsorted(ordered, items.runs, "left"), np.searchsorted(ordered, items.runs, "right")
    p = items.suffixes[lo < hi]
    lo, hi = lo[lo < hi], hi[lo < hi]
    far = len(shard) + len(items.flat)
    at = bound(items, p, shard, array, lo, hi, far, False)
    size = np.zeros(len(p), np.int64)
    for near, there in ((at - 1, at > lo), (at, at < hi)):
        size[there] = np.maximum(size[there], common(items.flat, p[there], shard, array[near[there]], items.seed, far))
    return p, array, lo, hi, size


def spans(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range after the other."""
    many = hi - lo
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - lo, many)


def carries(item: np.ndarray, doc: np.ndarray, least: int, one_in: int) -> bool:
    """Whether the document has a copy of `least` running words of the item or more with at most one edit in `one_in` words.

    The score of a stretch is its words less `one_in` for every edit. By its words so far (up to `least`) and its end in the document the best
    score is kept; a stretch begins and ends with an equal word, and one of `least` words or more that scores 0 or more is a copy.
    """
    if len(item) < least:
        return False
    score = np.full((least + 1, len(doc) + 1), -(1 << 28), np.int32)
    step = np.arange(len(doc) + 1, dtype=np.int32) * one_in
    for word in item:
        same = doc == word
        score[least] = np.maximum(score[least], score[least - 1])
        score[1:least] = score[: least - 1].copy()
        if (score[least, :-1][same] >= -1).any():
            return True
        onward = score[:, :-1] + np.where(same, 1, 1 - one_in).astype(np.int32)
        score += 1 - one_in
        np.maximum(score[:, 1:], onward, out=score[:, 1:])
        score[1, 1:][same] = np.maximum(score[1, 1:][same], 1)
        score = np.maximum.accumulate(score + step, axis=1) - step
        np.maximum(score, -(1 << 28), out=score)
    return False


def shared(item: np.ndarray, doc: np.ndarray, least: int, one_in: int) -> bool:
    """Whether enough words of some stretch of the item are in the document at all, in any order: no copy is without that."""
    score = np.r_[0, np.cumsum(np.where(np.isin(item, doc), 1, 1 - one_in))]
    return len(item) >= least and bool((score[least:] >= np.minimum.accumulate(score[: len(score) - least])).any())


def together(docs: np.ndarray, runs: np.ndarray, items: Items, need: int) -> Iterator[tuple[int, int]]:
    """(document, item) where the document has the runs of `need` places of the item. docs, runs: distinct, ordered by document.

    Counts are added up for a bounded number of documents and runs at a time, so runs that many items share cost time in proportion, but no room.
    """
    many = max(1, len(items.ids))
    step = max(1, HELD // many)
    size = items.first[runs + 1] - items.first[runs]
    for base in range(int(docs[0]) if len(docs) else 0, int(docs[-1]) + 1 if len(docs) else 0, step):
        s, e = np.searchsorted(docs, [base, base + step])
        if s == e:
            continue
        width = int(docs[e - 1]) - base + 1
        tally = np.zeros(width * many, np.int64)
        while s < e:
            upto = s + max(1, int(np.searchsorted(np.cumsum(size[s:e]), HELD, "right")))
            at = spans(items.first[runs[s:upto]], items.first[runs[s:upto] + 1])
            tally += np.bincount(np.repeat(docs[s:upto] - base, size[s:upto]) * many + items.owners[at], minlength=width * many)
            s = upto
        for k in np.flatnonzero(tally >= need).tolist():
            yield base + k // many, k % many


def cases(shard: np.ndarray, bounds: list[int], items: Items, least: int, one_in: int) -> set[tuple[int, int]]:
    """(number of the document in the shard, number of the item) of all copies. bounds: where each document begins, and the end."""
    p, array, lo, hi, size = longest(shard, items)
    if not len(p):
        return set()
    bounds = np.asarray(bounds)
    owner = np.searchsorted(items.start, p, "right") - 1
    doc = np.searchsorted(bounds, array, "right") - 1
    found: set[tuple[int, int]] = set()
    whole = np.flatnonzero(size >= least)  # verbatim; the places of as many words lie together in the suffix array
    a, b = (bound(items, p[whole], shard, array, lo[whole], hi[whole], least, after) for after in (False, True))
    for k, s, e in zip(whole.tolist(), a.tolist(), b.tolist()):
        found.update((d, int(owner[k])) for d in set(doc[s:e].tolist()))
    places, run = items.runs_of(shard)
    pairs = np.unique((np.searchsorted(bounds, places, "right") - 1) * len(items.first) + run)
    # cut at the gap in its middle, a copy of 3 * least words leaves two of `least` or more, one of them within the limit: none is longer than that
    reach = 3 * least + 3 * least // one_in
    for d, o in together(pairs // len(items.first), pairs % len(items.first), items, seeds_needed(least, one_in)):
        item, body = items.codes[o], shard[bounds[d] : bounds[d + 1]]
        if (d, o) in found or not shared(item, body, least, one_in):
            continue
        mine = (items.suffixes >= items.start[o]) & (items.suffixes < items.start[o] + len(item))
        its_runs = items.runs[mine]
        s, e = np.searchsorted(places, [bounds[d], bounds[d + 1]])
        hit = np.isin(run[s:e], its_runs)
        q, r = places[s:e][hit] - bounds[d], run[s:e][hit]
        # matches of one copy lie within its reach of each other, so others are looked at apart
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q) > reach) + 1):
            i = items.suffixes[mine][np.isin(its_runs, r[part])] - items.start[o]
            piece = item[max(0, i.min() - reach) : i.max() + items.seed + reach]
            place = body[max(0, q[part[0]] - reach) : q[part[-1]] + items.seed + reach]
            if carries(piece, place, least, one_in):
                found.add((d, o))
                break
    return found


def item_passes(rows: Iterable[tuple[int, str]], overlap: int, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The items in parts of `most` words or fewer. An item beyond that is cut into pieces that overlap by `overlap` words, so that no copy is lost."""
    part, size = [], 0
    for item, text in rows:
        tokens = words(text or "")
        for s in range(0, max(1, len(tokens) - overlap), most - overlap):
            piece = tokens[s : s + most]
            if part and size + len(piece) > most:
                yield part
                part, size = [], 0
            part.append((item, piece))
            size += len(piece)
    yield part


def leaked(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 20, one_in: int = 6) -> DataFrame:
    """(key, item): every document that carries `least` running words of an item, with at most one word in `one_in` changed, dropped or added.

    Letter case, punctuation, spacing, line breaks, character forms, markup and reference marks don't matter. Items of more than PASS_WORDS words
    together are searched for in several passes over the documents, as each task holds the items of one. Null keys, null and empty texts on either
    side, and items below `least` words, give no rows; a repeated key gives one row per item that any of its rows carries.
    """
    if least < 2 or one_in < 3:
        raise ValueError("least must be 2 or more and one_in 3 or more")
    spark, seed = docs.sparkSession, seed_words(least, one_in)
    listed = (r for r in items.select(item_key, item_text).toLocalIterator() if r[0] is not None)
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    slim = widen(slim, "key")

    def one_pass(part) -> DataFrame:
        shared_items = spark.sparkContext.broadcast(Items(part, seed))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = shared_items.value
            code_of = known.vocabulary.get
            names, parts, bounds = [], [], [0]

            def result():
                got = sorted(cases(np.concatenate(parts), bounds, known, least, one_in))
                return pd.DataFrame({"key": [names[d] for d, _ in got], "item": [known.ids[o] for _, o in got]}, dtype="int64")

            for pdf in batches:
                for k, t in zip(pdf["key"].tolist(), pdf["text"]):
                    codes = [code_of(w, 0) for w in words(t)]
                    codes.append(0)
                    names.append(k)
                    parts.append(np.array(codes, np.int64))
                    bounds.append(bounds[-1] + len(codes))
                    if bounds[-1] >= SHARD:
                        yield result()
                        names, parts, bounds = [], [], [0]
            if names:
                yield result()

        return slim.mapInPandas(search, "key long, item long")

    passes = [one_pass(part) for part in item_passes(listed, 4 * least, max(8 * least, PASS_WORDS))]
    return reduce(DataFrame.unionByName, passes).distinct()


def item_report(cases_: DataFrame) -> DataFrame:
    """(item, n_docs): the leaked test items with the number of documents that carry them."""
    return cases_.groupBy("item").agg(F.countDistinct("key").alias("n_docs"))


def without_leaks(docs: DataFrame, key: str, cases_: DataFrame) -> DataFrame:
    """The documents that carry no item."""
    return docs.join(cases_.select(F.col("key").alias(key)).distinct(), key, "left_anti")

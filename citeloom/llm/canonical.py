"""Mapping free-entered values to a canonical list (problem 1).

The list's entries and their alias paths form a trie in which the long and the short forms of a word are parallel ways to the next one, so that
every mixture is a path. A typed value becomes a Levenshtein automaton (with adjacent swaps as one edit) whose states are bit masks, and the
walk over the trie follows only branches on which it is alive, so one walk finds every entry within the distance that the value's length
allows. The automata of many values walk together, a level of the trie at a time. Only distinct values are walked.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may stand around a name without being part of it, on the normalised value.
LEADING = r"^(?:in|the|see|cf)\s+"
TRAILING = r"\s+(?:print|online|electronic|\d+(?:st|nd|rd|th) ser(?:ies)?|vol(?:ume)? \d+|v \d+|no \d+|(?:1[5-9]|20)\d\d)$"
#: Words of a title that its abbreviation leaves out.
LINKING = ("of", "on", "in", "and", "the", "for", "series")
#: Short forms of head words that lists don't use themselves.
HEADS = {"journal": ("j", "jnl", "jour", "jl"), "international": ("int", "intl"), "proceedings": ("proc",), "transactions": ("trans",), "bulletin": ("bull",), "annals": ("ann",), "archives": ("arch",), "reviews": ("rev",), "advances": ("adv",)}
#: Entries of one trie (some 10 MB for titles of 40 letters), as each task holds one; a longer list is walked in several passes. States walked at once.
PART, STATES = 20_000, 1 << 18


def normal(text: str) -> str:
    """Letters and digits in one case without accents, markup entities and punctuation, single-spaced."""
    s = unicodedata.normalize("NFKD", html.unescape(text)).replace("&", " and ")
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold()
    return " ".join(re.findall(r"[^\W_]+", s))


def stripped(text: str) -> str:
    """`normal` without what surrounds a name: 'in:', 'The', '[print]', 'vol. 3', a year."""
    s, before = normal(text), None
    while s != before:
        before = s
        s = re.sub(TRAILING, "", re.sub(LEADING, "", s))
    return s


def allowed(length: int) -> int:
    """Edits allowed for a value of `length` characters."""
    return 0 if length < 6 else 1 if length < 10 else 2 if length < 16 else 3


def short_words(pairs: Iterable[tuple[str, str]], width: int) -> dict[str, str]:
    """{word: its short form}, learned from pairs (short title, title) of which the short one isn't cut at `width`."""
    seen: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for short, title in pairs:
        words, parts = [w for w in normal(title).split() if w not in LINKING], normal(short).split()
        whole = len(short) < width
        for k, (w, p) in enumerate(zip(words, parts)):
            if w.startswith(p) and (whole and len(words) == len(parts) or k < len(parts) - 1):
                seen[w][p] += 1
    return {w: max(sorted(c), key=c.get) for w, c in seen.items()}


def lone_letters(path: str) -> frozenset[str]:
    """Letters that stand alone, such as that of a series."""
    return frozenset(w for w in path.split() if len(w) == 1 and w.isalpha())


def orders(title: str) -> list[tuple[list[str], set[int]]]:
    """(words, places of those that may be left out) of a normalised title: as it is, without what surrounds a name, and turned round at its head
    ("Metrics, Journal of")."""
    full = title.split()
    whole = [t.split() for t in dict.fromkeys([title, stripped(title)]) if t]
    out = [(w, {k for k, x in enumerate(w) if x in LINKING}) for w in whole]
    link = next((k for k, w in enumerate(full) if w in LINKING[:3]), None)
    if link:
        turned = full[link + 1 :] + full[: link + 1]
        out.append((turned, {k for k, x in enumerate(turned) if x in LINKING}))
    return out


class Trie:
    """Entries by path, as flat arrays: the ways out of node k are first[k] to first[k + 1], each with its letter and the node it leads to. A
    letter may lead to several nodes, and several ways may lead to one."""

    def __init__(self, entries: Iterable[tuple[int, str, str]], width: int = 20, words: dict[str, str] | None = None):
        entries = list(entries)
        if words is None:
            words = short_words([(s, t) for _, s, t in entries if s and t], width)
        self.root: dict[str, list[dict]] = {}
        self._after: dict[tuple, dict] = {}
        #: The letters that stand alone in every path of an entry, and those that do in some.
        self.letters: dict[int, tuple[frozenset, frozenset]] = {}
        for key, short, title in entries:
            short, title = normal(short or title or ""), normal(title or short or "")
            must, may = self.letters.get(key, (None, frozenset()))
            for path, optional in [(short.split(), set())] + orders(title):
                forms = [[w] if path == short.split() and not optional else sorted({w, words.get(w, w), *HEADS.get(w, ())}) for w in path]
                last = max((k for k in range(len(path)) if k not in optional), default=-1)
                self._add(key, path, forms, optional, last)
                alone = [{f for f in fs if len(f) == 1 and f.isalpha()} for fs in forms]
                always = frozenset(f for k, fs in enumerate(forms) if k not in optional and len(fs) == 1 for f in alone[k])
                must = always if must is None else must & always
                may |= frozenset().union(*alone) if alone else frozenset()
            self.letters[key] = must or frozenset(), may
        self._flatten()

    def _add(self, key: int, path: list[str], forms: list[list[str]], optional: set[int], last: int) -> None:
        """All ways through the words of a path. The node after a word is the same whichever form it had, for all entries that begin with these words."""
        starts = [self.root]
        for k, word in enumerate(path):
            after = self._after.setdefault(tuple(path[: k + 1]), {})
            for start in starts:
                for form in forms[k]:
                    node = start
                    for c in form[:-1]:
                        node = self._step(node, c)
                    ways = node.setdefault(form[-1], [])
                    if not any(w is after for w in ways):
                        ways.append(after)
            begin = after.setdefault(" ", [{}])[0]
            starts = [*starts, begin] if k in optional else [begin]
            if k >= last:
                after.setdefault("", set()).add(key)

    def _step(self, node: dict, c: str) -> dict:
        """The node for further letters of a word, which is none that stands after a word."""
        ways = node.setdefault(c, [])
        inside = next((w for w in ways if "." in w), None)
        if inside is None:
            inside = {".": []}  # marks a node within words; no letter of a path
            ways.append(inside)
        return inside

    def _flatten(self) -> None:
        number, nodes = {id(self.root): 0}, [self.root]
        self.alphabet: dict[str, int] = {}
        first, letter, to, owners, self.entries = [0], [], [], [0], []
        for node in nodes:  # grows while it is read
            for c, ways in node.items():
                if c == "":
                    self.entries += sorted(ways)
                elif c != ".":
                    for below in ways:
                        if id(below) not in number:
                            number[id(below)] = len(nodes)
                            nodes.append(below)
                        letter.append(self.alphabet.setdefault(c, len(self.alphabet)))
                        to.append(number[id(below)])
            first.append(len(to))
            owners.append(len(self.entries))
        self.first, self.letter, self.to, self.owners = (np.array(x, np.int32) for x in (first, letter, to, owners))
        del self.root, self._after

    def exact(self, path: str) -> set[int]:
        """The entries that have this very path."""
        at = {0}
        for c in path:
            code = self.alphabet.get(c)
            at = {int(self.to[w]) for k in at for w in range(self.first[k], self.first[k + 1]) if self.letter[w] == code}
        return {e for k in at for e in self.entries[self.owners[k] : self.owners[k + 1]]}

    def within(self, values: list[str], edits: int) -> list[dict[int, int]]:
        """For each value {entry: its least distance} of every entry with a path within `edits` of it."""
        found: list[dict[int, int]] = [{} for _ in values]
        kind = np.uint64 if max(map(len, values), default=0) < 62 else object  # plain numbers of any length where 64 bits don't do
        one = kind(1) if kind is not object else 1
        shift = (lambda x, n: x << np.uint64(n)) if kind is not object else (lambda x, n: x << n)
        place = np.zeros((len(values), len(self.alphabet) + 1), kind)
        for v, value in enumerate(values):
            for k, c in enumerate(value):
                code = self.alphabet.get(c, -1)
                place[v, code] |= kind(2 << k) if kind is not object else 2 << k
        place[:, -1] = 0
        end = np.array([1 << len(v) for v in values], kind)
        keep = np.array([(2 << len(v)) - 1 for v in values], kind)
        # state d: bit i is set where i characters of the value are used with at most d edits
        who = np.arange(len(values), dtype=np.int32)
        state = [np.array([(1 << d + 1) - 1 & (2 << len(v)) - 1 for v in values], kind) for d in range(edits + 1)]
        todo = [(who, np.zeros(len(values), np.int32), state, None, None)]
        while todo:
            who, node, state, before, last = todo.pop()
            if len(who) > STATES:  # half of the states at a time, so that they take bounded room
                half = len(who) // 2
                for part in (slice(half, None), slice(half)):
                    todo.append((who[part], node[part], [x[part] for x in state], before and [x[part] for x in before], None if last is None else last[part]))
                continue
            many = self.first[node + 1] - self.first[node]
            up = np.repeat(np.arange(len(who)), many)
            way = np.arange(len(up)) - np.repeat(np.cumsum(many) - many - self.first[node], many)
            who, node, state_ = who[up], self.to[way], [x[up] for x in state]
            b, limit = place[who, self.letter[way]], keep[who]
            row = shift(state_[0], 1) & b
            new = [row]
            for d in range(1, edits + 1):
                row = (shift(state_[d], 1) & b | state_[d - 1] | shift(state_[d - 1], 1) | shift(row, 1)) & limit
                if before is not None:  # two neighbours swapped
                    row |= shift(before[d - 1][up], 2) & shift(b, 1) & last[up] & limit
                new.append(row)
            for d in range(edits + 1):
                ends = np.flatnonzero((self.owners[node + 1] > self.owners[node]) & ((new[d] & end[who]) != 0))
                for v, k in zip(who[ends].tolist(), node[ends].tolist()):
                    for e in self.entries[self.owners[k] : self.owners[k + 1]]:
                        if found[v].get(e, d) >= d:
                            found[v][e] = d
            alive = np.flatnonzero(row != 0)
            if len(alive):
                todo.append((who[alive], node[alive], [x[alive] for x in new], [x[alive] for x in state_], b[alive]))
        return found

    def candidates(self, texts: list[str]) -> list[dict[int, int]]:
        """For each text {entry: distance} of all entries within the distance that its length allows.

        Letters that stand alone must agree unless the path is met exactly: Series C is no misspelt Series A.
        """
        values = [stripped(t) for t in texts]
        out: dict[str, dict[int, int]] = {}
        for edits in range(4):
            mine = sorted((v for v in dict.fromkeys(values) if allowed(len(v)) == edits), key=len)  # long ones apart, as they need longer numbers
            for s in range(0, len(mine), 256):
                out |= zip(mine[s : s + 256], self.within(mine[s : s + 256], edits))
        got = []
        for text, value in zip(texts, values):
            alone = lone_letters(value)
            near = {e: d for e, d in out[value].items() if d == 0 or self.letters[e][0] <= alone <= self.letters[e][1]}
            if 0 not in near.values() and (same := normal(text)) != value:
                near |= dict.fromkeys(self.exact(same), 0)
            got.append(near)
        return got


def nearest(near: dict[int, int]) -> tuple[int, int, int]:
    """(entry, distance, entries at that distance); entry -1 if none is within reach or the least distance is shared."""
    if not near:
        return -1, -1, 0
    least = min(near.values())
    best = [e for e, d in near.items() if d == least]
    return (best[0] if len(best) == 1 else -1), least, len(best)


def _walked(values: DataFrame, column: str, entries: Iterable[tuple[int, str, str]], width: int, rows, schema: str) -> list[DataFrame]:
    """`rows` of the candidates of every distinct non-blank value, by part of the list."""
    spark = values.sparkSession
    listed = sorted(entries, key=lambda e: e[0])
    words = short_words([(s, t) for _, s, t in listed if s and t], width)
    distinct = values.select(F.col(column).alias("value")).filter(F.length(F.trim("value")) > 0).distinct()
    distinct = distinct.repartition(2 * spark.sparkContext.defaultParallelism, "value")  # by number: few bytes, but work for every core

    def part(s: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(Trie(listed[s : s + PART], width, words))

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield rows(pdf["value"].tolist(), shared.value.candidates(pdf["value"].tolist()))

        return distinct.mapInPandas(walk, schema)

    return [part(s) for s in range(0, max(1, len(listed)), PART)]


def canonical_candidates(values: DataFrame, column: str, entries: Iterable[tuple[int, str, str]], width: int = 20) -> DataFrame:
    """(value, entry, distance): every entry within the distance that the length of each distinct non-blank value of `column` allows.

    entries: (key, short title, title), each key once; `width` is where short titles are cut. Values without such an entry give no row.
    """

    def rows(texts, near):
        flat = [(t, e, d) for t, found in zip(texts, near) for e, d in sorted(found.items())]
        return pd.DataFrame(flat, columns=["value", "entry", "distance"])

    return reduce(DataFrame.unionByName, _walked(values, column, entries, width, rows, "value string, entry long, distance int"))


def canonical_values(values: DataFrame, column: str, entries: Iterable[tuple[int, str, str]], width: int = 20) -> DataFrame:
    """(value, entry, distance, tied): one row per distinct non-blank value of `column`, with the nearest of its canonical_candidates.

    entry is -1 for a value that means none, or several equally (tied says how many). Null and blank values are left out, an empty list gives -1 everywhere.
    """

    def rows(texts, near):
        best = [nearest(n) for n in near]
        return pd.DataFrame({"value": texts, "entry": [b[0] for b in best], "distance": [b[1] for b in best], "tied": [b[2] for b in best]})

    parts = _walked(values, column, entries, width, rows, "value string, entry long, distance int, tied int")
    if len(parts) == 1:
        return parts[0]
    each = reduce(DataFrame.unionByName, parts).groupBy("value")  # the nearest of all parts; one row per value and part
    far = F.when(F.col("distance") >= 0, F.col("distance"))
    got = each.agg(F.min(far).alias("distance"), F.collect_list(F.struct("distance", "entry", "tied")).alias("parts"))
    best = F.filter("parts", lambda x: x["distance"] == F.col("distance"))
    tied = F.aggregate(best, F.lit(0), lambda n, x: n + x["tied"])
    return got.select("value", F.when(tied == 1, best[0]["entry"]).otherwise(-1).cast("long").alias("entry"), F.coalesce("distance", F.lit(-1)).alias("distance"), F.coalesce(tied, F.lit(0)).alias("tied"))

"""Keyword-stuffed and link-list pages (problem 10), by each page's suffix automaton and its clause structure.

The automaton of a page's words has a state for every maximal repeated run of words, with the number of its occurrences. Runs of
content words that recur within segments are its keywords, however many share the page; the characters they cover are
measured. Apart from that every segment of the page (a sentence, a line, an item between bars) either has the structure of a clause, by
its function words, or not. A page of which more than half shows none may be in another language than theirs; there what ends as a sentence
is judged by the page's own small and recurring words. A segment is stuffing if it has no such structure, or if keywords cover much of it.
"""

from __future__ import annotations

import gc
import re
from collections import Counter
from collections.abc import Iterator, Set
from itertools import chain, compress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.text import lines_of, visible, words_of
from citeloom.runtime import widen

#: Function words of English, German, French and Spanish. Words of menus and offers (here, all, more, now, top) are left out.
FUNCTION_WORDS = frozenset(
    "the of and to in a an is that for was with are on by this be as at from which were we it its than not no had has have been did do does when where how why who "
    "whose so but or nor if each most only rather both either neither between because after before until under over there their they our us can could may might should "
    "must will would then thus however though although whether while once per into against during without within such these those i he she his her them about among across along despite since still yet instead "
    "der die das den dem des ein eine einer eines einem einen und ist sind war waren nicht von mit zu zum zur im auf aus bei nach fur als auch dass wir sich wie kaum "
    "noch uber durch um wird werden wurde wurden oder aber haben hat kein keine nur wenn weil bis "
    "le la les l un une du de et est sont etait ont au aux en dans par pour que qui ne pas ce cette ces nous sur avec se sans lorsque depuis selon n d s a guere puis "
    "el los las una unos y del al no con por para su sus es son fue lo como cuando entre desde segun hay muy mas pero".split()
)
#: A segment with clause structure has this many words and different function words at least, and this share of function words.
CLAUSE_WORDS, CLAUSE_KINDS, CLAUSE_SHARE = 4, 2, 0.12
#: A keyword recurs this often and comes this often in the segments that have it; a segment of which all keywords together cover the
#: last share is stuffing. Up to SHORT words it may overlap itself.
KEYWORD_TIMES, KEYWORD_PER_SEGMENT, COVERED, SHORT = 4, 1.4, 0.25, 3

#: In a language without function words here, a sentence of these many words and at most one comma in so many is a clause by the words
#: of up to SMALL letters, and those below the mean length that recur in its sentences, in the same kinds and share as above.
SENTENCE_WORDS, SENTENCE_COMMA, SMALL = (5, 60), 4, 3
ENDED = "\ue000"

_BLOCKS = re.compile(r"</?(?:p|br|li|ul|ol|div|tr|td|th|table|h\d|hr|section|nav|a|dt|dd)\b[^<>]*>")
#: What ends a segment, beside line ends.
_STOPS = (". ", "? ", "! ", '." ', '?" ', '!" ', ".) ", "?) ", "!) ")
_STOPS_BEYOND_ASCII = ("\u3002", "\u061f ", "\u0964", ".\u201d ", "?\u201d ", "!\u201d ")
_ENDS = ("|", " - ", " -- ", " / ", " > ", " >> ", " => ", " * ", " ~ ", " # ")
_ENDS_BEYOND_ASCII = ("\u2022", "\u00b7", "\u00bb", "\u203a", " \u2013 ", " \u2014 ")


class Automaton:
    """The suffix automaton of runs of numbers; a run begins at the root. Lists by state: longest, link, next, times."""

    def __init__(self, runs: list[list[int]]):
        longest, link, follow, times = [0], [-1], [{}], [0]
        self.ends: list[list[int]] = []
        for run in runs:
            last, ends = 0, []
            for c in run:
                have = follow[last].get(c)
                if have is not None and longest[have] == longest[last] + 1:
                    last = have  # this factor is there already, from an earlier run
                    times[last] += 1
                    ends.append(last)
                    continue
                p = last
                if have is None:
                    new = len(longest)
                    longest.append(longest[last] + 1)
                    link.append(0)
                    follow.append({})
                    times.append(0)
                    while p >= 0 and c not in follow[p]:
                        follow[p][c] = new
                        p = link[p]
                else:
                    new = -1
                if p >= 0:
                    q = follow[p][c]
                    if longest[q] == longest[p] + 1:
                        if new >= 0:
                            link[new] = q
                    else:
                        twin = len(longest)
                        longest.append(longest[p] + 1)
                        link.append(link[q])
                        follow.append(follow[q].copy())
                        times.append(0)
                        link[q] = twin
                        if new >= 0:
                            link[new] = twin
                        else:
                            new = twin
                        while p >= 0 and follow[p].get(c) == q:
                            follow[p][c] = twin
                            p = link[p]
                last = new
                times[last] += 1
                ends.append(last)
            self.ends.append(ends)
        self.longest, self.link, self.follow = longest, link, follow
        by_size: list[list[int]] = [[] for _ in range(max(longest) + 1)]
        for s in range(1, len(longest)):
            by_size[longest[s]].append(s)
        self.order = [s for states in by_size for s in states]
        for s in reversed(self.order):
            if link[s] > 0:
                times[link[s]] += times[s]
        self.times = times


def repeated_runs(codes: list[int], times: Counter) -> tuple[list[list[int]], list[int]]:
    """The runs between which no repeated run of words reaches, and where each begins.

    A word that occurs once is in no repeated run, and two neighbours that occur as such once are not in one together;
    so the automaton of these runs has all repeated runs of the page.
    """
    many = len(codes)
    pairs = Counter([a * many + b for a, b in zip(codes, codes[1:])])
    runs, starts, run, before = [], [], [], -1
    for k, c in enumerate(codes):
        if times[c] < 2:
            before = -1
            continue
        if before < 0 or pairs[before * many + c] < 2:
            run = []
            runs.append(run)
            starts.append(k)
        run.append(c)
        before = c
    return runs, starts


def frequent_runs(codes: list[int | None], pairs: Counter, many: int) -> tuple[list[list[int]], list[int]]:
    """`repeated_runs` for KEYWORD_TIMES, of codes below `many` in which rarer words are None, and the counts of neighbours as a * many + b."""
    runs, starts, run, before = [], [], [], None
    for k, c in enumerate(codes):
        if c is not None:
            if before is None or pairs[before * many + c] < KEYWORD_TIMES:
                run = []
                runs.append(run)
                starts.append(k)
            run.append(c)
        before = c
    return runs, starts


def _mark(covered: bytearray, runs: list[list[int]], starts: list[int], am: Automaton, size_of: list[int]) -> None:
    """Marks for every place the longest suffix run with a size."""
    for start, ends in zip(starts, am.ends):
        reach = 0  # words still covered by a run that ends further on
        for k in range(len(ends) - 1, -1, -1):
            reach = max(reach - 1, size_of[ends[k]])
            if reach > 0:
                covered[start + k] = 1


def keywords(parts: list[list[str]], codes: list[int], content: list[bool], runs: list[list[int]], starts: list[int], am: Automaton) -> list[int]:
    """The keyword runs: maximal repeats of any length within a segment, with a content word, that recur within segments, not
    once in each as the phrases of a template do. One number per state: the size of the longest keyword that ends its run, or 0."""
    longest, link, seen, n = am.longest, am.link, am.times, len(codes)
    # a state's longest run can't go on to the left; it is maximal if none of its followers occurs as often
    # one that is longer than a segment is no keyword; one that overlaps itself has a shorter one that recurs as often
    most = max(map(len, parts))
    often = [s for s in am.order if seen[s] >= KEYWORD_TIMES and longest[s] <= most and (longest[s] <= SHORT or seen[s] * longest[s] <= n) and all(seen[t] < seen[s] for t in am.follow[s].values())]
    if not often:
        return []
    near = [0] * len(longest)  # the nearest wanted state among a state and its suffixes
    for s in often:
        near[s] = s
    for s in am.order:
        near[s] = near[s] or near[max(0, link[s])]
    segment = [k for k, p in enumerate(parts) for _ in p]
    found: dict[int, list[int]] = {}
    for start, ends in zip(starts, am.ends):
        for k, s in enumerate(ends):
            s = near[s]
            while s:
                found.setdefault(s, []).append(start + k)
                s = near[max(0, link[s])]
    size_of = [0] * len(longest)
    for s in often:
        at = found[s]
        words_ = codes[at[0] + 1 - longest[s] : at[0] + 1]
        if any(content[c] for c in words_) and len(at) >= KEYWORD_PER_SEGMENT * len({segment[k] for k in at}):
            size_of[s] = longest[s]
    for s in am.order:
        size_of[s] = size_of[s] or size_of[max(0, link[s])]
    return size_of


def _codes(parts: list[list[str]]) -> tuple[list[int], dict[str, int]]:
    number: dict[str, int] = {}
    return [number.setdefault(t, len(number)) for p in parts for t in p], number


def repeat_coverage(parts: list[list[str]]) -> bytearray:
    """For each word of a page in segments: whether a maximal repeated run of two words or more covers it."""
    codes, _ = _codes(parts)
    repeated = bytearray(len(codes))
    runs, starts = repeated_runs(codes, Counter(codes))
    if runs:
        am = Automaton(runs)
        size_of = [0] * len(am.longest)
        for s in am.order:
            size_of[s] = am.longest[s] if am.times[s] > 1 and am.longest[s] > 1 else size_of[am.link[s]]
        _mark(repeated, runs, starts, am, size_of)
    return repeated


def keyword_coverage(parts: list[list[str]]) -> bytearray | None:
    """For each word of a page in segments: whether a keyword covers it. None if the page has no keyword."""
    tokens = list(chain.from_iterable(parts))
    number: dict[str, int] = {}
    for t, n in Counter(tokens).items():
        if n >= KEYWORD_TIMES:
            number[t] = len(number)
    content = [t not in FUNCTION_WORDS and not t.isdigit() for t in number]
    if not any(content):
        return None  # a keyword holds a content word, which is then as frequent
    codes = list(map(number.get, tokens))  # None for all other words
    many = len(number)
    pairs = Counter([a * many + b for a, b in zip(codes, codes[1:]) if a is not None and b is not None])
    runs, starts = frequent_runs(codes, pairs, many)
    kept = [k for k, run in enumerate(runs) if any(content[c] for c in run)]  # no keyword is, nor occurs, in the others
    if not kept:
        return None
    runs, starts = [runs[k] for k in kept], [starts[k] for k in kept]
    am = Automaton(runs)
    size_of = keywords(parts, codes, content, runs, starts, am)
    if not any(size_of):
        return None
    keyed = bytearray(len(codes))
    _mark(keyed, runs, starts, am, size_of)
    return keyed


def _cut(text: str, stop: str) -> str:
    text = text.lower()
    if "<" in text:
        text = _BLOCKS.sub("\n", text)
    text = visible(text).replace("\t", " ").replace("\u00a0", " ")
    plain = text.isascii()
    for end in _STOPS if plain else _STOPS + _STOPS_BEYOND_ASCII:
        text = text.replace(end, stop)
    for end in _ENDS if plain else _ENDS + _ENDS_BEYOND_ASCII:
        text = text.replace(end, "\n")
    return text


def segments(text: str) -> list[list[str]]:
    """The words of each segment of a page, without empty segments."""
    return lines_of(_cut(text, "\n"))


def sentences(text: str, parts: list[list[str]]) -> list[bool]:
    """For each of its segments whether it reads as a sentence by its form and by the small and the recurring words of the page alone."""
    lines = [line for line in _cut(text, ENDED + "\n").split("\n") if words_of(line)]
    formed = [
        (ENDED in line or line.rstrip().endswith((".", "?", "!")))
        and SENTENCE_WORDS[0] <= len(p) <= SENTENCE_WORDS[1]
        and SENTENCE_COMMA * sum(map(line.count, ",\u3001\u060c")) <= len(p)
        and 2 * len(set(p)) > len(p)
        for line, p in zip(lines, parts)
    ]
    own = list({tuple(p): p for p, f in zip(parts, formed) if f}.values())  # a sentence said again shows nothing new
    many = sum(map(len, own))
    mean = sum(len(t) for p in own for t in p) / max(1, many)
    seen = Counter(t for p in own for t in set(p[1:]))
    closed = {t for t, n in seen.items() if not any(c.isdigit() for c in t) and (1 < n and len(t) <= mean or mean > SMALL >= len(t))}
    return [f and is_clause(p, closed) for f, p in zip(formed, parts)]


def is_clause(tokens: list[str], closed: Set[str] = FUNCTION_WORDS) -> bool:
    """Whether a segment has the structure of a clause."""
    if len(tokens) < CLAUSE_WORDS:
        return False
    found = [t for t in tokens if t in closed]
    return len(found) >= CLAUSE_SHARE * len(tokens) and len(set(found)) >= CLAUSE_KINDS


def measures(text: str) -> tuple[int, float, float, float]:
    """(characters in words, and of these the shares: covered by keywords, outside clauses, stuffing)."""
    parts = segments(text)
    sizes = [len(t) for p in parts for t in p]
    total = sum(sizes)
    if not total:
        return 0, 0.0, 0.0, 0.0
    clauses = [is_clause(p) for p in parts]
    by_part = [sum(map(len, p)) for p in parts]
    if 2 * sum(n for n, c in zip(by_part, clauses) if not c) > total:
        clauses = [a or b for a, b in zip(clauses, sentences(text, parts))]
    keyed = keyword_coverage(parts)
    bare = stuffed = at = 0
    for p, size, clause in zip(parts, by_part, clauses):
        end = at + len(p)
        if not clause:
            bare += size
            stuffed += size
        elif keyed and sum(compress(sizes[at:end], keyed[at:end])) >= COVERED * size:
            stuffed += size
        at = end
    return total, sum(compress(sizes, keyed)) / total if keyed else 0.0, bare / total, stuffed / total


def repeated_share(text: str) -> float:
    """The share of the characters in words that maximal repeated runs cover."""
    parts = segments(text)
    sizes = [len(t) for p in parts for t in p]
    return sum(compress(sizes, repeat_coverage(parts))) / max(1, sum(sizes))


def page_measures(docs: DataFrame, key: str, text: str, repeats: bool = False) -> DataFrame:
    """(key, n_word_chars, keywords, outside, stuffing[, repeated]): the shares of each page, from its whole text.

    Null texts and keys give no row; a text without words has 0 everywhere. repeats: also the share that any repeated runs cover.
    """
    names = ["n_word_chars", "keywords", "outside", "stuffing"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gc.disable()  # an automaton has many small parts but no cycles
            try:
                out = pd.DataFrame([measures(t) for t in pdf["text"]], columns=names)
                if repeats:
                    out["repeated"] = [repeated_share(t) for t in pdf["text"]]
            finally:
                gc.enable()
            out.insert(0, "key", pdf["key"].to_numpy())
            yield out

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    schema = "key long, n_word_chars long, keywords double, outside double, stuffing double" + (", repeated double" if repeats else "")
    return widen(slim, "key").mapInPandas(measure, schema)


def stuffed_pages(measured: DataFrame, most: float = 0.5) -> DataFrame:
    """The pages of page_measures with more than `most` of their characters in stuffing."""
    return measured.filter(F.col("stuffing") > most)

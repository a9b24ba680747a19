"""Frequency of every distinct value (problem 6), with last-seen counters.

A term's state is three numbers: occurrences, records, and the record that counted it last. Tokens come partitioned and
ordered by record, so a term met again in its last record raises only the occurrences, and no set of records or of a
record's terms is ever built. Partitioning by record instead of by term means that a term in a third of all tokens is
spread over all tasks; each task sends one compact state per term, and those of different tasks simply add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms a task keeps before it sends its states on; any number gives the same result.
STATES = 500_000


def last_seen(batches: Iterator[pd.DataFrame], states: int = STATES) -> Iterator[pd.DataFrame]:
    """States of the terms of (rec, term) batches ordered by rec."""
    seen: dict[str, list] = {}
    for pdf in batches:
        if not len(pdf):
            continue
        codes, terms = pd.factorize(pdf["term"])
        rec = pdf["rec"].to_numpy()
        order = np.argsort(codes, kind="stable")
        code, r = codes[order], rec[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        fresh = np.r_[True, (code[1:] != code[:-1]) | (r[1:] != r[:-1])]
        ends = np.r_[starts[1:], len(code)]
        for term, n, k, first, last in zip(terms, (ends - starts).tolist(), np.add.reduceat(fresh, starts).tolist(), r[starts].tolist(), r[ends - 1].tolist()):
            state = seen.get(term)
            if state is None:
                seen[term] = [n, k, last]
            else:
                state[0] += n
                state[1] += k - (state[2] == first)
                state[2] = last
        if len(seen) > states:  # terms of the record that may go on in the next batch stay
            now = rec[-1]
            done = {t: s for t, s in seen.items() if s[2] != now}
            seen = {t: s for t, s in seen.items() if s[2] == now}
            yield _frame(done)
    yield _frame(seen)


def _frame(states: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame({"term": pd.Series(list(states), dtype=object), "n_occ": [s[0] for s in states.values()], "n_rec": [s[1] for s in states.values()]})


def term_counts(tokens: DataFrame, record: str, term: str, grouped: bool = False) -> DataFrame:
    """(term, n_occurrences, n_records): one row per distinct term.

    tokens: one row per occurrence. grouped: every record's rows already lie together in one partition (as after exploding
    an array), so nothing is moved; else the tokens are partitioned by record and sorted. Null terms and records are left out;
    the empty text is a term like any other. An empty table gives no rows.
    """
    slim = tokens.select(F.col(record).alias("rec"), F.col(term).alias("term")).filter("rec is not null and term is not null")
    if not grouped:
        slim = slim.repartition("rec").sortWithinPartitions("rec")
    states = slim.mapInPandas(last_seen, "term string, n_occ long, n_rec long")
    return states.groupBy("term").agg(F.sum("n_occ").alias("n_occurrences"), F.sum("n_rec").alias("n_records"))


def marked(counts: DataFrame, n_records: DataFrame, rare: int = 2, common: int = 20) -> DataFrame:
    """`counts` with `mark`: 'rare' in at most `rare` records, 'common' in more than a `common`-th of all, else null.

    n_records: a frame of one number, the records that have any term; a term that is both counts as common.
    """
    total = n_records.scalar()
    return counts.withColumn("mark", F.when(F.col("n_records") * common > total, "common").when(F.col("n_records") <= rare, "rare"))

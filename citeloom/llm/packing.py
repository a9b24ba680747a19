"""Filling fixed-capacity containers with texts measured in tokens (problem 8): bounded-space best fit.

Every partition keeps a fixed number of open windows and places each text where the least room is left over; when it fits
nowhere and no window may be opened, the fullest is emitted. What is open at the end of a partition is merged in rounds,
always of a bounded number of windows, until one task has merged the last. Only (key, tokens) pairs move between stages.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import cut, widen

#: Open windows of a partition; partitions whose leftovers are merged by one task.
WINDOWS, FAN_IN = 64, 32
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabularies part a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAN = "container long, slot int, key long, piece int, start long, n_tokens long"

_encoders: dict[tuple, object] = {}


def vocabulary_bytes(path: str = VOCABULARY) -> bytes:
    """The file of ranks, a few MB, which the driver reads and ships with the job: executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes, pattern: str = PATTERN):
    """The tokenizer of ranks as in a file, built once a process. Marks of special tokens in a text are ordinary text."""
    if (ranks, pattern) not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _encoders[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks, pattern]


def token_counts(docs: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(key, n_tokens) of every row with a text, in whole texts. Null texts give no row, the empty text 0 tokens. vocabulary: a file the driver can read."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(shared.value, pattern).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    return widen(slim, "key").mapInPandas(measure, "key long, n_tokens long")


class Packer:
    """Online best fit with a bounded number of open windows. Emits lists of (key, piece, start, n)."""

    def __init__(self, capacity: int, windows: int):
        self.capacity, self.windows = capacity, windows
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list] = {}
        self.next = 0

    def place(self, item: tuple) -> Iterator[list]:
        size = item[3]
        at = bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.windows:
                _, full = self.rooms.pop(0)
                yield self.held.pop(full)
            room, window = self.capacity, self.next
            self.held[window] = []
            self.next += 1
        self.held[window].append(item)
        if room == size:
            yield self.held.pop(window)
        else:
            insort(self.rooms, (room - size, window))

    def rest(self) -> Iterator[list]:
        """The open windows, the fullest first."""
        for _, window in self.rooms:
            yield self.held[window]
        self.rooms, self.held = [], {}


def pieces(key: int, n: int, capacity: int) -> Iterator[tuple]:
    """(key, piece, start, n): one piece, or for a text beyond the capacity full pieces and what is left."""
    if n <= capacity:
        yield key, 0, 0, n
    else:
        for k, start in enumerate(range(0, n, capacity)):
            yield key, k, start, min(capacity, n - start)


def _rows(base: int, number: int, items: list) -> list[tuple]:
    return [(base + number, slot, *item) for slot, item in enumerate(items)]


def _pack(batches: Iterator[pd.DataFrame], capacity: int, windows: int, round_: int, last: bool) -> Iterator[pd.DataFrame]:
    """Closed containers get their number; texts of open windows get -1 and go to the next round, unless this is the last."""
    names = [c.split()[0] for c in PLAN.split(", ")]
    base = (round_ << 56) + (TaskContext.get().partitionId() << 34)
    packer, number, out = Packer(capacity, windows), 0, []

    def flat(items_of_batches):
        for pdf in items_of_batches:
            if round_:
                yield from zip(pdf["key"].tolist(), pdf["piece"].tolist(), pdf["start"].tolist(), pdf["n_tokens"].tolist())
            else:
                for key, n in zip(pdf["key"].tolist(), pdf["n_tokens"].tolist()):
                    yield from pieces(key, n, capacity)

    items = flat(batches)
    if round_:  # bounded: FAN_IN partitions with at most `windows` windows each; large ones first fill better
        items = sorted(items, key=lambda x: (-x[3], x[0], x[1]))
    for item in items:
        for done in packer.place(item):
            out += _rows(base, number, done)
            number += 1
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=names)
            out = []
    for left in packer.rest():
        if last:
            out += _rows(base, number, left)
            number += 1
        else:
            out += [(-1, -1, *item) for item in left]
    if out:
        yield pd.DataFrame(out, columns=names)


def pack(sizes: DataFrame, capacity: int = 2048, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(container, slot, key, piece, start, n_tokens): each item of (key, n_tokens) in one container, none of which holds more than `capacity`.

    An item is cut only beyond the capacity: then all its pieces but the last fill a container each. Items of no tokens take a slot.
    Repeated keys are items of their own. Container numbers are unique and otherwise mean nothing. An empty table gives no rows.
    """
    if capacity < 1 or windows < 1 or fan_in < 2:
        raise ValueError("capacity and windows must be positive, fan_in at least 2")
    made = cut(sizes.select("key", "n_tokens").mapInPandas(lambda b: _pack(b, capacity, windows, 0, False), PLAN))
    parts = max(1, made.rdd.getNumPartitions())  # of the plan; no job runs
    done, left, round_ = [made.filter("container >= 0")], made.filter("container < 0"), 0
    while True:
        parts, round_ = -(-parts // fan_in), round_ + 1
        last = parts == 1
        # coalesce joins whole neighbouring partitions without a shuffle
        step = left.coalesce(parts).mapInPandas(lambda b, r=round_, z=last: _pack(b, capacity, windows, r, z), PLAN)
        step = cut(step)
        done.append(step.filter("container >= 0"))
        left = step.filter("container < 0")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def container_fill(plan: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container, n_items, n_tokens, unused): how full each container of a plan is."""
    return plan.groupBy("container").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens")).withColumn("unused", F.lit(capacity) - F.col("n_tokens"))

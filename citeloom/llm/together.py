"""Items that appear together (problem 3), by heavy-light decomposition.

Records come in blocks. In each block the frequent items form a dense bit matrix whose rows are intersected by popcount;
pairs of two rare items are enumerated and counted by hash; and the places of each rare item are looked up in the matrix for
the mixed pairs. A block's counts are summed inside the task before anything is shuffled, so the pairs of an item in a
third of all records travel as one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.runtime import broadcast_if_fits, stored

#: Records of a block; items of the bit matrix at most (others count as rare: the result is the same); pairs held before they are summed.
BLOCK, HEAVY, PAIRS = 32_768, 256, 4_000_000
#: Items that are sent to all tasks so that no pair of others is formed. With more, the same pairs come out of a larger shuffle.
KEPT = 200_000
#: Tasks over which the pairs of one item are spread when counts are joined by item.
SALTS = 16
#: An item is frequent if it is in at least this share of the records.
HEAVY_SHARE = 1 / 400


class _Pairs:
    """Counts of code pairs, merged whenever PAIRS of them have gathered."""

    def __init__(self, items: int):
        self.items, self.keys, self.counts, self.held = items, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> None:
        self.keys.append(a.astype(np.int64) * self.items + b)
        self.counts.append(np.ones(len(a), np.int64) if n is None else n.astype(np.int64))
        self.held += len(a)
        if self.held > PAIRS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate(self.keys), return_inverse=True)
        counts = np.bincount(back, np.concatenate(self.counts), len(keys)).astype(np.int64)
        self.keys, self.counts, self.held = [keys], [counts], 0
        return keys, counts


def block_pairs(lists: pa.ListArray, heavy: Sequence[str], keep: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(items in byte order, codes a, codes b, counts) of one block; every list holds distinct non-null items. keep: the only items that matter."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    rec = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lists)
    if keep is not None:
        use = pc.is_in(flat, value_set=keep)
        flat, rec = flat.filter(use), rec[use.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names)  # by bytes, as Spark compares
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    names = names.take(order)
    code = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
    at = pc.index_in(names, value_set=pa.array(list(heavy), pa.string()))
    slot = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.zeros(0, np.int64)
    pairs = _Pairs(max(1, len(names)))
    mine = slot[code] >= 0 if len(code) else np.zeros(0, bool)
    # frequent with frequent: rows of bits, intersected word by word
    used = np.unique(code[mine])
    row = np.full(max(1, len(names)), -1)
    row[used] = np.arange(len(used))
    width = -(-max(1, len(lists)) // 64) * 64
    dense = np.zeros((len(used), width), bool)
    dense[row[code[mine]], rec[mine]] = True
    words = np.packbits(dense, axis=1).view(np.uint64)
    for i in range(len(used) - 1):
        n = np.bitwise_count(words[i + 1 :] & words[i]).sum(axis=1, dtype=np.int64)
        hit = np.flatnonzero(n)
        pairs.add(np.full(len(hit), used[i]), used[i + 1 :][hit], n[hit])
    # rare with frequent: the rare item's places, looked up in the matrix
    light, places = code[~mine], rec[~mine]
    by_item = np.argsort(light, kind="stable")
    light_sorted, places_sorted = light[by_item], places[by_item]
    if len(used) and len(light_sorted):
        columns = dense.T.astype(np.uint8)
        step = max(1, 16_000_000 // len(used))
        for s in range(0, len(light_sorted), step):
            part = light_sorted[s : s + step]
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            n = np.add.reduceat(columns[places_sorted[s : s + step]], starts, axis=0, dtype=np.int64)
            i, h = np.nonzero(n)
            a, b = part[starts][i], used[h]
            pairs.add(np.minimum(a, b), np.maximum(a, b), n[i, h])
    # rare with rare: enumerated within each record, counted by hash
    by_rec = np.lexsort((light, places))
    a, r = light[by_rec], places[by_rec]
    k = np.arange(len(a))
    d = 1
    while len(k):
        k = k[k + d < len(a)]
        k = k[r[k] == r[k + d]]
        for s in range(0, len(k), PAIRS):
            pairs.add(a[k[s : s + PAIRS]], a[k[s : s + PAIRS] + d])
        d += 1
    keys, counts = pairs.merge()
    return names, keys // pairs.items, keys % pairs.items, counts


def _blocks(batches: Iterator[pa.RecordBatch], heavy, keep) -> Iterator[pa.RecordBatch]:
    held, rows, tokens = [], 0, 0

    def counted():
        names, a, b, n = block_pairs(pa.chunked_array(held, held[0].type), heavy, keep)
        for s in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a[s : s + 50_000])), names.take(pa.array(b[s : s + 50_000])), pa.array(n[s : s + 50_000])], ["item_a", "item_b", "n"])

    for batch in batches:
        lists = batch.column(0)
        lists = pa.ListArray.from_arrays(lists.offsets, lists.values.cast(pa.string())) if lists.null_count == 0 else lists
        held.append(lists)
        rows, tokens = rows + len(lists), tokens + len(lists.values)
        if rows >= BLOCK or tokens > PAIRS:
            yield from counted()
            held, rows, tokens = [], 0, 0
    if rows:
        yield from counted()


def item_counts(records: DataFrame) -> DataFrame:
    """(item, n_records) with one more row of a null item: the records that have any item. records: items ARRAY<STRING>, distinct and non-null."""
    marked = records.filter(F.size("items") > 0).select(F.explode(F.concat("items", F.array(F.lit(None).cast("string")))).alias("item"))
    return marked.groupBy("item").agg(F.count("*").alias("n_records"))


def pairs_together(records: DataFrame, min_records: int = 1, min_permille: int = 0, min_lift: int = 0) -> DataFrame:
    """(item_a, item_b, n_both, n_a, n_b, n_records, lift): every pair of items in one record, item_a < item_b in byte order.

    records: one row per record, items ARRAY<STRING> with distinct non-null items; null and empty arrays are no records.
    lift = n_both * n_records / (n_a * n_b). Only pairs in at least `min_records` records, `min_permille` thousandths of all records and with
    lift >= min_lift come out. Items below the two record bounds can't be in such a pair and are dropped before any pair is formed;
    with a bound of p thousandths there are at most 1000 / p times the mean record's length others, which bounds what is sent to all tasks.
    """
    spark = records.sparkSession
    records = stored(records.select("items").filter(F.size("items") > 0))  # read for the counts and for the pairs
    counts = stored(item_counts(records))
    total = counts.filter("item is null").select("n_records").first()
    n = total[0] if total else 0
    counts = counts.filter("item is not null")
    need = max(min_records, -(-min_permille * n // 1000))
    frequent = counts.filter(F.col("n_records") >= need)
    # with a bound in thousandths all of them are few and come at once, the most frequent first; else only those that may be in the matrix
    some = frequent.orderBy(F.desc("n_records"), "item").limit(KEPT + 1 if min_permille > 0 else HEAVY).collect()
    heavy = [r[0] for r in some[:HEAVY] if r[1] >= max(2, n * HEAVY_SHARE)]
    keep = pa.array([r[0] for r in some], pa.string()) if min_permille > 0 and len(some) <= KEPT else None
    shared = spark.sparkContext.broadcast((heavy, keep))
    made = records.select("items").filter(F.size("items") > 1).mapInArrow(lambda b: _blocks(b, *shared.value), "item_a string, item_b string, n long")
    both = made.groupBy("item_a", "item_b").agg(F.sum("n").alias("n_both")).filter(F.col("n_both") >= need)
    sent = keep is not None and 16 * len(keep) + keep.nbytes < 32 << 20
    small = F.broadcast(frequent) if sent else broadcast_if_fits(frequent)
    if small is frequent:  # an item in pairs with all others is spread over `SALTS` tasks
        both = both.withColumn("salt", F.pmod(F.xxhash64("item_a", "item_b"), F.lit(SALTS)).cast("int"))
        small = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = [c for c in small.columns if c == "salt"]
    out = both.join(small.select(F.col("item").alias("item_a"), F.col("n_records").alias("n_a"), *salt), ["item_a", *salt]).join(
        small.select(F.col("item").alias("item_b"), F.col("n_records").alias("n_b"), *salt), ["item_b", *salt]
    )
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    out = out.filter(wide("n_both") * n >= wide("n_a") * F.col("n_b") * min_lift)
    return out.select("item_a", "item_b", "n_both", "n_a", "n_b", F.lit(n).alias("n_records"), (F.col("n_both") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))).alias("lift"))

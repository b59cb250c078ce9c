"""Pairs of rows that share keys, as a product of sparse matrices in blocks: nothing is shuffled for a pair.

Entries (row, key, x) are dealt to blocks by row and packed, a binary value a block. Each block of one side meets each
block of the other in a task, which has all that the two share, so that sums over keys are whole there. The packed
blocks are all that is written; a task holds two blocks and PAIRS pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import save

#: Entries of a block, pairs that are taken apart at once, and blocks that a task meets one after another.
ENTRIES, PAIRS, IN_A_ROW = 2_000_000, 4_000_000, 8


class Packed:
    """Blocks (block, data) of entries, and how many there are."""

    def __init__(self, entries: DataFrame, row: str, key: str, x: str, count: int):
        self.count = max(1, -(-count // ENTRIES))
        dealt = entries.select(F.pmod(F.xxhash64(row), F.lit(self.count)).cast("int").alias("block"), F.col(row).cast("long").alias("row"), F.col(key).cast("long").alias("key"), F.col(x).cast("double").alias("x"))

        def pack(t: pa.Table) -> pa.Table:
            rows, at = np.unique(t["row"].to_numpy(), return_inverse=True)
            by = np.argsort(t["key"].to_numpy(), kind="stable")
            at, key, x = at[by].astype(np.int32), t["key"].to_numpy()[by], t["x"].to_numpy()[by]
            data = [pa.compress(c.tobytes(), "zstd", asbytes=True) for c in (rows, at, key, x)]
            return pa.table({"block": t["block"].slice(0, 1), "sizes": pa.array([[len(rows), len(at)]], pa.list_(pa.int64())), "data": pa.array([data], pa.list_(pa.binary()))})

        self.blocks = save(dealt.where("row is not null and key is not null").groupBy("block").applyInArrow(pack, "block int, sizes array<long>, data array<binary>"))


def _unpack(sizes: list, data: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are different, the place of each entry's row in them, keys (rising) and values."""
    kinds = ((np.int64, sizes[0]), (np.int32, sizes[1]), (np.int64, sizes[1]), (np.float64, sizes[1]))
    return tuple(np.frombuffer(pa.decompress(d, n * np.dtype(kind).itemsize, "zstd"), kind) for d, (kind, n) in zip(data, kinds))


def _shared(at: np.ndarray, key: np.ndarray, x: np.ndarray, right: tuple) -> Iterator[tuple]:
    """(left place, right place, key, left value, right value) of all entries with equal keys, about PAIRS at a time; all
    pairs of a left row come together."""
    first, last = np.searchsorted(right[2], key, "left"), np.searchsorted(right[2], key, "right")
    n = last - first
    total = int(n.sum())
    if total > PAIRS and len(rows := np.unique(at[n > 0])) > 1:
        low = at <= rows[(len(rows) - 1) // 2]
        for half in (low, ~low):
            yield from _shared(at[half], key[half], x[half], right)
    elif total:
        i = np.repeat(np.arange(len(key)), n)
        j = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + first[i]
        yield at[i], right[1][j], key[i], x[i], right[3][j]


def _summed(i: np.ndarray, j: np.ndarray, width: int, *values: np.ndarray) -> tuple:
    """Different (i, j), how often they stand, and sums of values over each."""
    pair = i.astype(np.int64) * width + j
    order = np.argsort(pair)
    pair = pair[order]
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    return (pair[start] // width, pair[start] % width, np.diff(np.r_[start, len(pair)]), *[np.add.reduceat(v[order], start) for v in values])


def _met(left: Packed, right: Packed, f: Callable, columns: str, parts: int, halves: bool = False) -> DataFrame:
    one = left.blocks.select(F.col("block").alias("a"), F.struct("sizes", "data").alias("one")).repartitionById(left.count, "a")
    two = right.blocks.select(F.col("block").alias("b"), F.struct("sizes", "data").alias("two")).repartitionById(parts, F.col("b") % parts)
    both = one.join(two.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b") if halves else F.lit(True))
    return both.select("a", "b", "one", "two").mapInArrow(f, columns)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(a, b, left, right) of the blocks that a task meets; a left block is unpacked once."""
    held, left = None, None
    for batch in batches:
        for k in range(batch.num_rows):
            a, b = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if a != held:
                held, left = a, _unpack(**batch.column(2)[k].as_py())
            yield a, b, left, _unpack(**batch.column(3)[k].as_py())


def pairs(rows: Packed, columns: str, tell: Callable[..., list]) -> DataFrame:
    """A row for each two rows a < b that share a key: a, b and what tell(n, x, y, xx, yy, xy, d2) makes of the number of
    keys they share and the sums of their values there, of squares, of products and of squared differences. columns
    names and types it all."""
    names = [c.split()[0] for c in columns.split(",")]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, left, right in _each(batches):
            for i, j, _, x, y in _shared(*left[1:], right):
                keep = i < j if a == b else np.ones(len(i), bool)
                if keep.any():
                    i, j, x, y = i[keep], j[keep], x[keep], y[keep]
                    i, j, n, *sums = _summed(i, j, len(right[0]), x, y, x * x, y * y, x * y, (x - y) ** 2)
                    one, two = left[0][i], right[0][j]
                    back = one > two
                    x, y, xx, yy, xy, d2 = sums
                    x, y, xx, yy = np.where(back, y, x), np.where(back, x, y), np.where(back, yy, xx), np.where(back, xx, yy)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.minimum(one, two), np.maximum(one, two), *tell(n, x, y, xx, yy, xy, d2))], names)

    return _met(rows, rows, f, columns, rows.count, True)


def nearest_rows(rows: Packed, n: int) -> DataFrame:
    """(item, other, sim): the n rows nearest to each, or more, by 1 / (1 + sum of squared differences over shared keys),
    rounded to six digits, half away from zero, then by the larger name."""

    def first(group: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < n

    def best(i: np.ndarray, other: np.ndarray, far: np.ndarray) -> tuple:
        """Of each place the first n by far, then by the larger name."""
        order = np.lexsort((-other, far, i))
        order = order[first(i[order])]
        return i[order], other[order], far[order]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = kept = limit = names = None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names[kept[0]]), pa.array(kept[1]), pa.array((1_000_000 - kept[2]) / 1e6)], ["item", "other", "sim"])

        for a, _, left, right in _each(batches):
            if a != held:
                if kept is not None:
                    yield told()
                # far is a million less the rounded similarity; beyond limit a place has n better ones already
                held, names, kept, limit = a, left[0], (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)), np.full(len(left[0]), 1_000_000)
            for i, j, _, x, y in _shared(*left[1:], right):
                i, j, _, d2 = _summed(i, j, len(right[0]), (x - y) ** 2)
                far = 1_000_000 - np.floor(1 / (1 + d2) * 1e6 + 0.5).astype(np.int64)
                near = np.flatnonzero((far <= limit[i]) & (left[0][i] != right[0][j]))
                i, other, far = i[near], right[0][j[near]], far[near]
                bits = (len(left[0]).bit_length(), 20, len(right[0]).bit_length())
                if sum(bits) < 63:  # one number in order of place, far and falling name
                    number = np.sort((((i << 20) | far) << bits[2]) | ((1 << bits[2]) - 1 - j[near]))
                    number = number[first(number >> (20 + bits[2]))]
                    i, far, other = number >> (20 + bits[2]), (number >> bits[2]) & 0xFFFFF, right[0][(1 << bits[2]) - 1 - (number & ((1 << bits[2]) - 1))]
                kept = best(*(np.concatenate(c) for c in zip(kept, (i, other, far))))
                size = np.bincount(kept[0], minlength=len(limit))
                full = size >= n
                limit[full] = kept[2][np.cumsum(size)[full] - 1]
        if kept is not None:
            yield told()

    return _met(rows, rows, f, "item long, other long, sim double", max(1, min(rows.count, max(8, -(-rows.count // IN_A_ROW)))))


def weighted_means(weights: Packed, values: Packed) -> DataFrame:
    """(user, item, score): mean of values(item, other, rating) by weights(user, other, sim) above 0, of items for which
    user itself has no value but 0 as other; weights hold each user as its own other, whatever the weight."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, left, right in _each(batches):
            for i, j, other, sim, rating in _shared(*left[1:], right):
                own = left[0][i] == other
                sim = np.where(own, 0.0, sim)
                i, j, _, total, top, seen = _summed(i, j, len(right[0]), sim, sim * rating, (own & (rating != 0)).astype(np.int64))
                keep = (seen == 0) & (total > 0)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(left[0][i[keep]]), pa.array(right[0][j[keep]]), pa.array(top[keep] / total[keep])], ["user", "item", "score"])

    return _met(weights, values, f, "user long, item long, score double", values.count)

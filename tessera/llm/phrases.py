"""Collocations: phrases whose words stand together more often than their parts do, counted by suffix arrays.

1. Tasks cut texts into pieces and words, and write shards: the words of each language that a shard has, their counts,
   and its pieces as numbers. Counts are added up by word; only words frequent enough can be in a candidate.
2. Each shard, told which of its words are frequent, sorts the suffixes of its numbers by prefix doubling. The
   intervals of the suffix array whose neighbours have two words in common are its pairs with their counts; these are
   merged by key, in buckets, and each shard is told which of its pairs are frequent.
3. The shard sorts the suffixes of what frequent pairs are left to link, four words deep; intervals at three and four
   words are merged the same way.
4. Scores, phrases inside longer ones and ranks are joins over the frequent phrases.

A shard sends a phrase once, however often it occurs there, and no table is broadcast by hand.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import Scratch

from .common import groups_for, mix, partitions
from .suffix import _split, _squeeze, _unsqueeze


@dataclass
class Settings:
    min_count: int = 30  # occurrences of a candidate
    inside: int = 80  # hundredths of its occurrences that a phrase has in a longer one to be dropped
    top: int = 2_000  # phrases of a language
    shard_words: int = 2_000_000
    bucket_keys: int = 2_000_000


#: What ends a piece becomes a line end, a tab a blank.
_CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n\n\n\n\n\n\n\n\n\n ")
_TOTAL = -1  # "shard" of what counts for all


class _Numbers(dict):
    """Numbers of the words of one language, from 1 on in the order in which a shard meets words of any language."""

    def __init__(self, lang: str, names: list):
        super().__init__()
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self.names.append((self.lang, word))
        self[word] = len(self.names)
        return len(self.names)


def _shards(docs: DataFrame, s: Settings) -> DataFrame:
    """(shard, langs, words, counts, pieces): words of a shard, number i + 1 is the i-th, and its pieces, 0 between."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        names, numbers, seq = [], {}, array("i", [0])
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                for piece in text.encode("utf-8", "surrogatepass").lower().translate(_CUT).split(b"\n"):
                    found = piece.split()
                    if found:
                        own = numbers.get(lang)
                        if own is None:
                            own = numbers[lang] = _Numbers(lang, names)
                        seq.extend(map(own.__getitem__, found))
                        seq.append(0)
                        if len(seq) >= s.shard_words:
                            yield _shard(part * 1_000_000 + k, names, seq)
                            names, numbers, seq, k = [], {}, array("i", [0]), k + 1
        if len(seq) > 1:
            yield _shard(part * 1_000_000 + k, names, seq)

    lang = F.coalesce("lang", F.lit("und")).alias("lang")
    return docs.select(lang, "text").mapInArrow(cut, "shard long, langs array<string>, words array<string>, counts array<long>, pieces binary")


def _shard(number: int, names: list, seq: array) -> pa.RecordBatch:
    pieces = np.frombuffer(seq, np.int32)
    counts = np.bincount(pieces, minlength=len(names) + 1)[1:]
    blob = zstandard.ZstdCompressor(level=1).compress(pieces.tobytes())
    columns = [pa.array([number], pa.int64()), pa.array([[n[0] for n in names]], pa.list_(pa.string())), pa.array([[n[1].decode("utf-8", "replace") for n in names]], pa.list_(pa.string()))]
    columns += [pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([blob], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["shard", "langs", "words", "counts", "pieces"])


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of a sequence of numbers (0 ends a piece) in order of their first `depth` numbers, a power
    of two, by prefix doubling; and how many numbers each has in common with the one before it, within pieces and up to
    depth. Suffixes that start with 0 are left out."""
    n = len(ids)
    _, rank = np.unique(np.append(ids, 0), return_inverse=True)  # 0 has rank 0
    rank = rank[:n].astype(np.int64)
    step = 1
    order = None
    while step < depth:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        key = rank * (int(rank.max(initial=0)) + 1) + second
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, ordered[1:] != ordered[:-1])[:n])
        step *= 2
    if order is None:
        order = np.argsort(rank)
    order = order[ids[order] != 0]
    common = np.zeros(len(order), np.int64)
    padded = np.append(ids, np.zeros(depth, ids.dtype))
    alike = np.ones(max(len(order) - 1, 0), bool)
    for d in range(depth):
        one = padded[order + d]
        alike &= (one[1:] == one[:-1]) & (one[1:] != 0)
        common[1:] += alike
    return order, common


def intervals(ids: np.ndarray, order: np.ndarray, common: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, count) of each sequence of `length` numbers within pieces: one of its places, and how many it has."""
    first = np.flatnonzero(common < length)
    count = np.diff(np.append(first, len(order)))
    padded = np.append(ids, np.zeros(length, ids.dtype))
    whole = np.ones(len(first), bool)
    for d in range(length):
        whole &= padded[order[first] + d] != 0
    return order[first[whole]], count[whole]


def _numbered(shard: pa.Table, told: pa.Table) -> np.ndarray:
    """Pieces of a shard in the numbers of all frequent words, 0 for others."""
    blob = shard["pieces"][0].as_py()
    pieces = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32)
    to = np.zeros(int(pieces.max(initial=0)) + 1, np.int64)
    to[told["i"].to_numpy()] = told["gid"].to_numpy()
    return to[pieces]


def _buckets(keys: list[np.ndarray], counts: np.ndarray, buckets: int) -> tuple[list, list]:
    """Keys (columns of 64 bits) and counts, squeezed by bucket."""
    h = np.zeros(len(counts), np.uint64)
    for k in keys:
        h = mix(h * np.uint64(31) + k)
    names, blobs = [], []
    for b, at in _split((h % np.uint64(buckets)).astype(np.int64), buckets):
        names.append(b)
        blobs.append(_squeeze(*[k[at] for k in keys], counts[at].astype(np.int64)))
    return names, blobs


def _merge(blobs: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, their whole counts, and for each row of each blob (blob, number of its key)."""
    parts = [_unsqueeze(b, *[np.uint64] * width, np.int64) for b in blobs]
    keys = [np.concatenate([p[i] for p in parts]) for i in range(width)]
    counts = np.concatenate([p[width] for p in parts])
    of = np.repeat(np.arange(len(parts)), [len(p[width]) for p in parts])
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return [k[order[first]] for k in keys], np.add.reduceat(counts[order], first) if len(first) else counts, of, number


def _pairs(shards: DataFrame, told: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """(shard, blob): frequent pairs with their counts (shard -1), and the frequent pairs that each shard has."""

    def count(shard: pa.Table, words: pa.Table) -> pa.Table:
        names: list = []
        blobs: list = []
        number = 0
        if shard.num_rows and words.num_rows:
            number = shard["shard"][0].as_py()
            ids = _numbered(shard, words)
            place, n = intervals(ids, *suffix_array(ids, 2), 2)
            key = (ids[place].astype(np.uint64) << np.uint64(32)) | ids[place + 1].astype(np.uint64)
            names, blobs = _buckets([key], n, buckets)
        return pa.table({"b": pa.array(names, pa.int32()), "shard": pa.array([number] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        of_shard = table["shard"].to_numpy()
        (key,), total, of, number = _merge(table["blob"].to_pylist(), 1)
        often = total >= s.min_count
        out = [(_TOTAL, _squeeze(key[often], total[often]))] if often.any() else []
        live = often[number]
        of, number = of[live], number[live]
        out += [(int(of_shard[k]), _squeeze(key[number[at]])) for k, at in _split(of, len(of_shard))]
        return pa.table({"shard": pa.array([o[0] for o in out], pa.int64()), "blob": pa.array([o[1] for o in out], pa.binary())})

    counted = shards.select("shard", "pieces").groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(count, "b int, shard long, blob binary")
    return counted.groupBy("b").applyInArrow(merge, "shard long, blob binary")


def chains(ids: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """What links of frequent pairs (sorted keys) are left of a sequence: chains of three numbers or more, 0 between."""
    key = (ids[:-1].astype(np.uint64) << np.uint64(32)) | ids[1:].astype(np.uint64)
    link = (ids[:-1] != 0) & (ids[1:] != 0)
    if len(frequent):
        link &= frequent[np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)] == key
    else:
        link[:] = False
    edge = np.diff(np.concatenate([[0], link.view(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # links first..last - 1, numbers first..last
    keep = last - first >= 2
    first, size = first[keep], (last - first)[keep] + 2  # the one place more becomes the 0 between
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    out = np.append(ids, 0)[np.minimum(at, len(ids))]
    out[np.cumsum(size) - 1] = 0
    return out


def _longer(shards: DataFrame, told: DataFrame, pairs: DataFrame, s: Settings, buckets: int) -> DataFrame:
    """(shard, blob): frequent phrases of three and four words with their counts."""

    def count(key: tuple, shard: pa.Table, rest: pa.Table) -> pa.Table:
        names: list = []
        blobs: list = []
        words = rest.filter(pc.is_valid(rest["i"]))
        if shard.num_rows and words.num_rows and words.num_rows < rest.num_rows:
            known = [_unsqueeze(b, np.uint64)[0] for b in rest["blob"].drop_null().to_pylist()]
            ids = chains(_numbered(shard, words), np.sort(np.concatenate(known)))
            order, common = suffix_array(ids, 4)
            padded = np.append(ids, np.zeros(4, ids.dtype)).astype(np.uint64)
            starts, ends, counts = [], [], []
            for length in (3, 4):
                place, n = intervals(ids, order, common, length)
                starts.append((padded[place] << np.uint64(32)) | padded[place + 1])
                ends.append((padded[place + 2] << np.uint64(32)) | (padded[place + 3] if length == 4 else np.uint64(0)))
                counts.append(n)
            names, blobs = _buckets([np.concatenate(starts), np.concatenate(ends)], np.concatenate(counts), buckets)
        return pa.table({"b": pa.array(names, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        keys, total, _, _ = _merge(table["blob"].to_pylist(), 2)
        often = total >= s.min_count
        blobs = [_squeeze(keys[0][often], keys[1][often], total[often])] if often.any() else []
        return pa.table({"shard": pa.array([_TOTAL] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    none_blob, none_word = F.lit(None).cast("binary").alias("blob"), (F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("gid"))
    rest = told.select("shard", "i", "gid", none_blob).union(pairs.where(F.col("shard") >= 0).select("shard", *none_word, "blob"))
    counted = shards.select("shard", "pieces").groupBy("shard").cogroup(rest.groupBy("shard")).applyInArrow(count, "b int, blob binary")
    return counted.groupBy("b").applyInArrow(merge, "shard long, blob binary")


def _unpacked(blobs: DataFrame, width: int) -> DataFrame:
    """(g, f): phrases as arrays of word numbers, and their occurrences."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                *keys, f = _unsqueeze(blob, *[np.uint64] * width, np.int64)
                flat = np.stack([part for k in keys for part in (k >> np.uint64(32), k & np.uint64(0xFFFFFFFF))], axis=1).astype(np.int64)
                size = (flat != 0).sum(axis=1)
                offsets = np.append(0, np.cumsum(size)).astype(np.int32)
                g = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[flat != 0]))
                yield pa.RecordBatch.from_arrays([g, pa.array(f)], ["g", "f"])

    return blobs.where(F.col("shard") == _TOTAL).select("blob").mapInArrow(rows, "g array<long>, f long")


def _exact(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def mine_phrases(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first phrases of each language by score.

    Texts are A-Z lower-cased and cut into pieces at `.,;:!?` and line ends, pieces into words at blanks and tabs. A
    candidate has 2 to 4 words and a >= min_count occurrences within pieces. Its score is floor(2000000 a / (l + r)) at
    the cut where that is lowest (ties: the first), l and r being the occurrences of the two parts. It is dropped if a
    longer candidate that contains it has `inside` hundredths of its occurrences or more. Ranks are by score, then a,
    then phrase. n counts the words of the language. A null lang is `und`, null and empty texts have no words, a
    language without candidates has no rows, repeated rows count each, other columns are left out."""
    s = settings or Settings()
    spark = docs.sparkSession
    scratch = Scratch(spark)
    shards = scratch.save("shards", _shards(docs, s))
    vocabulary = shards.select("shard", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("i", "w")).select("shard", (F.col("i") + 1).cast("long").alias("i"), F.col("w.langs").alias("lang"), F.col("w.words").alias("word"), F.col("w.counts").alias("c"))
    totals = scratch.save("totals", vocabulary.groupBy("lang", "word").agg(F.sum("c").alias("f")))
    sizes = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    parts = partitions(spark)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = groups_for(total, s.bucket_keys, parts)
    # numbers without large gaps: the place in a partition, times the partitions, plus the partition
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) * parts + F.spark_partition_id() + 1
    words = scratch.save("frequent", totals.where(F.col("f") >= s.min_count).repartition(parts, "lang", "word").select("lang", "word", "f", number.alias("gid")))
    if (words.agg(F.max("gid")).first()[0] or 0) >= 1 << 32:
        raise ValueError("more frequent words than 32 bits can number")
    told = scratch.save("told", vocabulary.join(words, ["lang", "word"]).select("shard", "i", "gid"))
    pairs = scratch.save("pairs", _pairs(shards, told, s, buckets))
    longer = scratch.save("longer", _longer(shards, told, pairs, s, buckets))
    units = words.select(F.array("gid").alias("g"), "f").union(_unpacked(pairs, 1)).union(_unpacked(longer, 2))
    units = scratch.save("units", units)
    scratch.drop("shards", "told", "pairs", "longer")
    return _ranked(units, words, sizes, s)


def _ranked(units: DataFrame, words: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    size = F.size("g")
    candidates = units.where(size >= 2)
    cuts = candidates.select("g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("g", "a", "k", F.slice("g", F.lit(1), F.col("k")).alias("left"), F.slice("g", F.col("k") + 1, size - F.col("k")).alias("right"))
    cuts = cuts.join(units.select(F.col("g").alias("left"), F.col("f").alias("l")), "left").join(units.select(F.col("g").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr("cast(cast(a as decimal(20,0)) * 2000000 div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    best = cuts.select("g", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("g", "a").agg(F.min("cut").alias("cut"))
    # phrases inside longer candidates
    long_ones = candidates.where(size >= 3)
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("g") - n + 1), lambda at: F.slice("g", at, n))))
    covered = long_ones.select("f", F.explode(inner).alias("g")).groupBy("g").agg(F.max("f").alias("cover"))
    kept = best.join(covered, "g", "left").where(F.col("cover").isNull() | (_exact(F.col("cover")) * 100 < _exact(F.col("a")) * s.inside))
    named = kept.join(words.select(F.col("gid").alias("head"), "lang"), F.col("g")[0] == F.col("head")).select("lang", "g", "a", "cut.l", "cut.r", "cut.score")
    # first by numbers alone, ties at the end included, so that few phrases are spelt out
    place = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    few = named.withColumn("place", place).where(F.col("place") <= s.top).drop("place")
    spelt = few.select("*", F.posexplode("g").alias("pos", "gid")).join(words.select("gid", "word"), "gid")
    order = F.array_sort(F.collect_list(F.struct("pos", "word")))
    spelt = spelt.groupBy("lang", "g", "a", "l", "r", "score").agg(F.array_join(F.transform(order, lambda x: x["word"]), " ").alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = spelt.withColumn("rank", rank.cast("long")).where(F.col("rank") <= s.top)
    return top.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

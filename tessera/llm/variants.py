"""Spelling variants of words, found by automata over the halves of words.

One edit leaves at least one half of a word whole: the first half then starts the other word, or the second half
ends it. So every word's two halves go into Aho-Corasick automata, in shards, and every word is scanned:

1. A half goes to the shard of its hash. A word is sent to the shards of those of its beginnings and ends that
   may be halves of a word of its length, one more or one less: four at most, however many shards there are.
2. A shard builds its automaton and scans its words. A hit counts if it lies at the start of the word (a first
   half) or at its end (a second half), for each length of a word that has this half and is no more than 1 away.
3. Of the words with that half and length, those are candidates that share a half of what is left as well (the
   same argument again). All of them are compared in blocks: by their common beginning and end.
4. A pair that has both halves in common counts for the first. A shard returns one row per word, so pairs never leave it.

Words with a half that more than `most` words have are dealt over several shards, and words that may have it go to all
of these: such a group costs its size squared by `most` in rows sent.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.shared import Scratch

from .common import groups_for, partitions


@dataclass
class Settings:
    min_length: int = 6  # code points of a word, 4 at least
    min_count: int = 5  # occurrences of a word
    ratio: int = 5  # how many times the occurrences of a word its form has at least
    shard_words: int = 20_000  # halves of a shard
    most: int = 4_096  # words of one half in one shard


RUN = re.compile("[A-Za-zÀ-ÿ]+")
WIDE = 64  # code points of a word that stand in a table; longer ones are compared one by one
HELD = 400_000  # distinct words that a counting task holds before it hands them on


def count_words(docs: DataFrame, min_length: int = 6, drop_every: int | None = None) -> DataFrame:
    """(word, n): occurrences of runs of letters in text, A-Z lower-cased, of at least min_length code points.

    With drop_every, misspellings are planted: where crc32 of `<doc_id>:<run>` is a multiple of it, the code point at
    that crc modulo the length is dropped. Null and empty texts have no words; a null doc_id is written as nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
                seed = zlib.crc32(b":" if doc is None else f"{doc}:".encode())
                for run, n in Counter(RUN.findall(lowered)).items():
                    if len(run) < min_length:
                        continue
                    if drop_every:
                        crc = zlib.crc32(run.encode(), seed)
                        if crc % drop_every == 0:
                            at = crc % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_length:
                                continue
                    held[run] += n
                if len(held) > HELD:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return docs.select("doc_id", "text").mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])


def _half(length: Column) -> Column:
    return F.floor(length / 2).cast("int")


def _beginnings(word: Column, length: Column) -> Column:
    """First halves that a word one edit away can have."""
    return F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda n: F.left(word, _half(n))))


def _ends(word: Column, length: Column) -> Column:
    """Second halves that a word one edit away can have."""
    return F.array_distinct(F.transform(F.array(length - 1, length, length + 1), lambda n: F.right(word, (n - _half(n)).cast("int"))))


def _shards(words: DataFrame, s: Settings, shards: int) -> DataFrame:
    """(shard, side, entry, word, n): halves to be put into automata (entry) and words to be scanned."""
    length = F.char_length("word")
    sides = [(0, F.left("word", _half(length)), _beginnings(F.col("word"), length)), (1, F.right("word", (length - _half(length)).cast("int")), _ends(F.col("word"), length))]
    entries, scans = None, None
    for side, half, possible in sides:
        e = words.select("word", "n", F.lit(side).alias("side"), half.alias("half"))
        w = words.select("word", "n", F.lit(side).alias("side"), F.explode(possible).alias("half"))
        entries, scans = (e, w) if entries is None else (entries.union(e), scans.union(w))
    many = entries.groupBy("side", "half").count().where(F.col("count") > s.most).select("side", "half", F.ceil(F.col("count") / s.most).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.join(many, ["side", "half"], "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    scans = scans.join(many, ["side", "half"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    shard = F.pmod(F.xxhash64("side", "half", "part"), F.lit(shards)).cast("int").alias("shard")
    both = entries.select(shard, "side", F.lit(True).alias("entry"), "word", "n").union(scans.select(shard, "side", F.lit(False), "word", "n"))
    return both.distinct()  # a word goes to a shard once, whichever of its beginnings lead there


def _table(words: list[str], width: int, end: bool) -> np.ndarray:
    """Code points of words, a word a row, filled up with zeros (at the front if their ends are wanted)."""
    if not words:
        return np.zeros((0, width), np.uint32)
    flat = np.array([w[::-1] for w in words] if end else words, f"<U{width}")
    return flat.view(np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many code points two rows have in common from the start on, filling included."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _common_start(a: str, b: str) -> int:
    """The same for two words, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def near_in_shard(side: int, entries: list[str], scanned: list[str], block: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (entry, scanned word) at one edit that have the entry's half of this side in common, and, for the second
    side, not the first half as well. Blocks of pairs are compared at once."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    by_rest: dict = defaultdict(list)
    cut = {}
    for i, w in enumerate(entries):
        n = len(w)
        h = n // 2
        half = w[:h] if side == 0 else w[h:]
        automaton.add_word(half, len(half))
        q = h + (n - h) // 2 if side == 0 else h // 2
        cut[i] = q
        # what is left has two halves too, and one of these is whole: either the one next to the half or the outer one
        if side == 0:
            by_rest[n, w[:q]].append(i)
            by_rest[n, half, w[q:]].append(i)
        else:
            by_rest[n, w[q:]].append(i)
            by_rest[n, half, w[:q]].append(i)
    if not entries or not scanned:
        return
    automaton.make_automaton()
    width = min(WIDE, max(max(map(len, entries)), max(map(len, scanned))))
    sizes_e, sizes_s = np.array([len(w) for w in entries]), np.array([len(w) for w in scanned])
    front_e, front_s = _table(entries, width, False), _table(scanned, width, False)
    back_e, back_s = _table(entries, width, True), _table(scanned, width, True)
    first, cuts = sizes_e // 2, np.array([cut[i] for i in range(len(entries))])

    def compare(left: list, right: list, outer: list) -> tuple[np.ndarray, np.ndarray]:
        e, v, o = np.array(left, np.int64), np.array(right, np.int64), np.array(outer, bool)
        same = sizes_e[e] == sizes_s[v]
        most = np.maximum(sizes_e[e], sizes_s[v])
        start = np.minimum(_common(front_e[e], front_s[v]), np.minimum(sizes_e[e], sizes_s[v]))
        end = np.minimum(_common(back_e[e], back_s[v]), np.minimum(sizes_e[e], sizes_s[v]))
        for p in np.flatnonzero(most > WIDE):
            a, b = entries[e[p]], scanned[v[p]]
            start[p], end[p] = _common_start(a, b), _common_start(a[::-1], b[::-1])
        good = (start + end >= most - 1) & ~(same & (start == sizes_e[e]))
        if side == 0:
            good &= ~(o & (start >= cuts[e]))  # named by the half next to the half already
        else:
            good &= start < first[e]  # named by the first half already
            good &= ~(o & (end >= sizes_e[e] - cuts[e]))
        return e[good], v[good]

    left: list = []
    right: list = []
    outer: list = []
    for j, v in enumerate(scanned):
        n = len(v)
        for last, size in automaton.iter(v):
            if (last + 1 != size) if side == 0 else (last + 1 != n):
                continue
            for m in (n - 1, n, n + 1):
                h = m // 2
                if (h if side == 0 else m - h) != size:
                    continue
                if side == 0:
                    q = h + (m - h) // 2
                    near, far = by_rest.get((m, v[:q])), by_rest.get((m, v[:h], v[n - (m - q) :]))
                else:
                    q = h // 2
                    near, far = by_rest.get((m, v[n - (m - q) :])), by_rest.get((m, v[n - size :], v[:q]))
                for found, is_outer in ((near, False), (far, True)):
                    if found:
                        left.extend(found)
                        right.extend([j] * len(found))
                        outer.extend([is_outer] * len(found))
        if len(left) >= block:
            yield compare(left, right, outer)
            left, right, outer = [], [], []
    if left:
        yield compare(left, right, outer)


def _best(table: pa.Table) -> pa.Table:
    """One row per word of a shard: how many near words, and the one of the largest n (ties: the smallest)."""
    out: dict[str, list] = {"word": [], "near": [], "form": [], "form_n": []}
    rows = list(zip(table["side"].to_pylist(), table["entry"].to_pylist(), table["word"].to_pylist(), table["n"].to_pylist()))
    for side in (0, 1):
        here = sorted((w, n, e) for s, e, w, n in rows if s == side)  # in order of code points
        entries = [w for w, _, e in here if e]
        scanned = [w for w, _, e in here if not e]
        counts = np.array([n for _, n, e in here if not e], np.int64)
        near = np.zeros(len(entries), np.int64)
        best = np.full(len(entries), -1, np.int64)
        for e, v in near_in_shard(side, entries, scanned):
            np.add.at(near, e, 1)
            order = np.lexsort((v, -counts[v], e))
            e, v = e[order], v[order]
            top = np.flatnonzero(np.append(True, e[1:] != e[:-1])[: len(e)])
            for i, j in zip(e[top], v[top]):
                if best[i] < 0 or (-counts[j], j) < (-counts[best[i]], best[i]):
                    best[i] = j
        some = np.flatnonzero(near)
        out["word"] += [entries[i] for i in some]
        out["near"] += near[some].tolist()
        out["form"] += [scanned[j] for j in best[some]]
        out["form_n"] += counts[best[some]].tolist()
    return pa.table({"word": pa.array(out["word"], pa.string()), "near": pa.array(out["near"], pa.int64()), "form": pa.array(out["form"], pa.string()), "form_n": pa.array(out["form_n"], pa.int64())})


def group_variants(words: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words(word, n), of which those long and frequent enough count.

    Words are near if one inserted, deleted or replaced code point makes one of the other. A word's form is the near
    word of the largest n (ties: the smallest by code points) if its n is at least `ratio` times the word's; its root
    is where forms lead, itself without one. Null words and counts are left out, rows of one word are added up; other
    columns are left out. Without words the result is empty."""
    s = settings or Settings()
    if s.min_length < 4 or s.ratio < 2:
        raise ValueError("min_length is 4 at least, and ratio 2")
    spark = words.sparkSession
    scratch = Scratch(spark)
    whole = words.where("word is not null and n is not null").groupBy("word").agg(F.sum("n").alias("n"))
    size = Observation()
    words = scratch.save("words", whole.where((F.col("n") >= s.min_count) & (F.char_length("word") >= s.min_length)).observe(size, F.count("*").alias("n")))
    shards = groups_for(size.get["n"] or 0, s.shard_words / 4, partitions(spark))
    found = _shards(words, s, shards).groupBy("shard").applyInArrow(_best, "word string, near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w"))).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.w").alias("f"), (-F.col("best.m")).alias("fn"))
    has = F.col("fn") >= s.ratio * F.col("n")
    known = scratch.save("known", known.select("word", F.when(has, F.col("f")).alias("form"), "n", "n_near", F.when(has, F.col("fn")).alias("form_n")))
    root = _roots(known, scratch)
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(known: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of words with a form, by pointer jumping. n grows with every form, so there is no cycle, and the
    steps are few: twice as far each."""
    at = scratch.save("root", known.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        moved = Observation()
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = scratch.save("root", at.join(up, "root", "left").observe(moved, F.count("next").alias("n")).select("word", F.coalesce("next", "root").alias("root")))
        scratch.drop_older("root")
        if not moved.get["n"]:
            return at

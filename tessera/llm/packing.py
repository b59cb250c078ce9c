"""Best-fit packing of token sequences with a swap-based local search."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_for

#: White space as the pre-tokenizer's pattern has it. No pre-token holds white space after another
#: character, so a text may be cut before each run of it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UNIT = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


#: Where the plain cut before every space and line break is not safe: one of them after white space.
_RUN = re.compile(f"[{_WS}][ \n]|\x00")
#: Fixed value: the pattern of pre-tokens of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Characters of a unit beyond which the library of the file encodes it: the faster encoder's pattern
#: fails on white space of somewhere between 700,000 and 1,000,000 characters.
LONG = 100_000


class Encoder:
    """Ids of texts as tokenizers gives them by default for a file of a byte-level BPE, added special tokens left out.

    Ordinary texts go to tiktoken over the same vocabulary, whose ids are the ranks of its merges, in a fifth of the
    time; tests compare the two. Texts that hold the string of an added token, which the library takes for the token,
    long ones, and all texts of a file of another form go to tokenizers itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.path, self.whole = path, None
        self.added = tuple(t["content"] for t in told["added_tokens"])
        # added tokens without white space don't span units, if nothing around them belongs to them
        plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{_WS}]", t["content"]) for t in told["added_tokens"])
        split = {k: told["pre_tokenizer"].get(k) for k in ("type", "add_prefix_space", "use_regex")} if told["pre_tokenizer"] else {}
        byte_level = split == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.by_units = plain and byte_level and told["normalizer"] is None
        self.fast = _fast(told["model"]["vocab"], self.added) if self.by_units else None

    def encode(self, text: str) -> list[int]:
        if self.fast is not None and len(text) <= LONG and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
            self.whole.no_truncation()
            self.whole.no_padding()
        return self.whole.encode(text, add_special_tokens=False).ids


def _fast(vocabulary: dict[str, int], added: tuple[str, ...]):
    import tiktoken

    # bytes that are no printable characters stand in the file as characters from 256 on, in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(of[c] for c in token): i for token, i in vocabulary.items() if token not in added and all(c in of for c in token)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def units_of(text: str) -> list[str]:
    """Parts of a text that no pre-token spans."""
    if _RUN.search(text):
        return UNIT.findall(text)
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")


def text_ids(text: str, encoder, seen: dict, cache: int) -> bytes:
    """Ids of a whole text as little-endian 32-bit bytes; units are encoded once and kept in `seen`."""
    units = units_of(text) if encoder.by_units else [text]
    got = list(map(seen.get, units))
    if None in got:
        miss = {u for u, b in zip(units, got) if b is None}
        if len(seen) + len(miss) > cache:  # the first units met are the frequent ones: they stay
            for u in list(islice(seen, cache // 2, None)):
                del seen[u]
            miss = {u for u in units if u not in seen}
        for u in miss:
            seen[u] = array("I", encoder.encode(u)).tobytes()
        got = list(map(seen.__getitem__, units))
    return b"".join(got)


def cut_pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, cache: int = 800_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of each text and `end_id`, cut where longer than `size`.

    Only longer documents are cut, into pieces of `size` ids; the first piece takes what is left over. The string
    of a special token in a text is that token, as the library has it by default. A null text is empty and gives
    the end id alone; a null doc_id stays null. Repeated rows give repeated pieces; other columns are left out."""
    state: dict = {}
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = state.get("t") or state.setdefault("t", Encoder(tokenizer_path))
        seen = state.setdefault("seen", {})
        tail = np.array([end_id], "<u4").tobytes()
        for b in batches:
            row, piece, start, lengths, crc = (array("q") for _ in range(5))
            for r, text in enumerate(b.column(1).to_pylist()):
                ids = text_ids(text, tokenizer, seen, cache) + tail
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    length = n % size or size if at == 0 else size
                    for column, value in ((row, r), (piece, k), (start, at), (lengths, length), (crc, zlib.crc32(ids[4 * at : 4 * (at + length)]))):
                        column.append(value)
                    at, k = at + length, k + 1
            ids_ = b.column(0).take(pa.array(np.asarray(row, np.int64)))
            piece_ = pa.array(np.asarray(piece, np.int32))
            yield pa.record_batch([ids_, piece_, *(pa.array(np.asarray(c, np.int64)) for c in (start, lengths, crc))], schema=schema)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_bins(lengths: np.ndarray, size: int) -> int:
    """What no packing can do with less: the volume, and for each k the pieces of which no bin holds more than k."""
    out = -(-int(lengths.sum()) // size)
    for k in range(1, 8):
        out = max(out, -(-int((lengths * (k + 1) > size).sum()) // k))
    return out


def pack(lengths: np.ndarray, size: int, rounds: int = 40) -> list[list[int]]:
    """Bins of indices, each of at most `size` in all: best fit in falling order, then a local search.

    The search takes one underfull bin after another, the emptiest first, and tries to place its pieces in
    other underfull bins: a move where a gap is wide enough, an exchange of one piece for a shorter one, or of
    one for two shorter ones, whichever raises the sum of squared fills most. A bin that empties is saved. It ends
    where no packing can do with fewer bins. `Rests` finds the best place without a walk over the bins, so that a
    round takes time in proportion to the pieces times `size`, however many bins are underfull.
    """
    order = np.argsort(-lengths, kind="stable")
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room, bin), in order
    for i in order:
        n = int(lengths[i])
        k = bisect_left(gaps, (n, -1))
        if k < len(gaps):
            room, b = gaps.pop(k)
            bins[b].append(int(i))
        else:
            room, b = size, len(bins)
            bins.append([int(i)])
        if room > n:
            insort(gaps, (room - n, b))
    under = {b: size - room for room, b in gaps}
    least = least_bins(lengths, size)
    for _ in range(rounds):
        if sum(map(bool, bins)) <= least or not _improve(bins, under, lengths, size):
            break
    return [b for b in bins if b]


class Rests:
    """Underfull bins by what stays in them when no, one or two pieces leave: `least[rest]` is the smallest fill of a bin
    that has such a rest. A piece of n that goes from a bin of `fill` to a rest raises the sum of squared fills by twice
    (rest + n - fill there) * (rest + n - fill), so for each rest the bin of the smallest fill is the best."""

    def __init__(self, size: int):
        self.size, self.numbers = size, np.arange(size + 1)
        self.least = np.full(size + 1, 1 << 30, np.int64)
        self.heaps: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]  # (fill, bin, its version), old ones too
        self.rests: dict[int, set[int]] = {}
        self.version: dict[int, int] = {}

    def add(self, b: int, fill: int, pieces: list[int]) -> None:
        parts = sorted(set(pieces))
        rests = {fill} | {fill - m for m in parts} | {fill - m - k for i, m in enumerate(parts) for k in parts[i + 1 :]}
        rests |= {fill - 2 * m for m in parts if 2 * m <= fill and pieces.count(m) > 1}
        self.rests[b] = rests
        entry = (fill, b, self.version.setdefault(b, 0))
        for r in rests:
            heappush(self.heaps[r], entry)
            self.least[r] = self.heaps[r][0][0] if self._top(r) else fill

    def remove(self, b: int) -> None:
        self.version[b] += 1
        for r in self.rests.pop(b):
            self.least[r] = self.heaps[r][0][0] if self._top(r) else 1 << 30

    def _top(self, r: int) -> bool:
        heap = self.heaps[r]
        while heap and self.version[heap[0][1]] != heap[0][2]:
            heappop(heap)
        return bool(heap)

    def best(self, n: int, fill: int) -> tuple[int, int] | None:
        """(bin, rest) where a piece of n from a bin of `fill` gains most; none if it gains nowhere."""
        low = max(0, fill - n + 1)
        at = self.numbers[low : self.size - n + 1] + n
        if not len(at):
            return None
        gains = (at - self.least[low : self.size - n + 1]) * (at - fill)
        k = int(gains.argmax())
        return (self.heaps[low + k][0][1], low + k) if gains[k] > 0 else None


def _leaving(pieces: list[int], lengths: np.ndarray, total: int) -> list[int]:
    """None, one or two of the pieces whose lengths make up a total."""
    if total == 0:
        return []
    seen: dict[int, int] = {}
    pair: list[int] = []
    for j in pieces:
        m = int(lengths[j])
        if m == total:
            return [j]
        if not pair and total - m in seen:
            pair = [seen[total - m], j]
        seen.setdefault(m, j)
    return pair


def _improve(bins: list[list[int]], under: dict[int, int], lengths: np.ndarray, size: int) -> bool:
    """One pass of the local search over underfull bins (bin -> fill); whether anything got better."""
    better = False
    rests = Rests(size)
    for b, fill in under.items():
        rests.add(b, fill, [int(lengths[i]) for i in bins[b]])
    for b in sorted(under, key=lambda b: (under[b], b)):
        if b not in under:
            continue
        rests.remove(b)
        fill = under.pop(b)
        for i in sorted(bins[b], key=lambda i: -lengths[i]):
            n = int(lengths[i])
            place = rests.best(n, fill)
            if place is None:
                continue
            c, rest = place
            back = _leaving(bins[c], lengths, under[c] - rest)
            better = True
            rests.remove(c)
            bins[b].remove(i)
            for j in back:
                bins[c].remove(j)
                bins[b].append(j)
            bins[c].append(i)
            fill -= rest + n - under[c]
            under[c] = rest + n
            if under[c] == size:
                del under[c]
            else:
                rests.add(c, under[c], [int(lengths[j]) for j in bins[c]])
        if fill:
            under[b] = fill
            rests.add(b, fill, [int(lengths[j]) for j in bins[b]])
    return better


def pack_pieces(pieces: DataFrame, size: int = 2048, rows_per_group: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...). Pieces of full size stand alone.

    Pieces are dealt by a hash into groups of about `rows_per_group`, which are packed apart; a group leaves
    about one underfull sequence, so the loss doesn't grow with the input. Copies of one text have different
    doc_ids and spread over the groups. An empty table gives an empty one.
    """
    n = pieces.count()
    groups = groups_for(n, rows_per_group, 1)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def f(key: tuple, g: pa.Table) -> pa.Table:
        g = g.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = g["length"].to_numpy()
        seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        full = int((lengths == size).sum())
        seq[:full] = np.arange(full)
        for k, b in enumerate(pack(lengths[full:], size)):
            at = 0
            for i in b:
                seq[full + i], off[full + i] = full + k, at
                at += int(lengths[full + i])
        seq += np.int64(key[0].as_py()) << np.int64(32)
        return g.drop_columns(["_group"]).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    # the contents are part of the deal: repeated ids, and none, spread like others
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(f, schema)

"""Exact removal of repeated substrings with a sampled suffix array.

Only strings of SPAN bytes matter, so a suffix is sorted by at most that much. Suffixes are grouped by an
anchor: of the GRAM-byte grams inside a window of SPAN bytes, the one with the smallest hash. Equal windows
have equal anchors, so consecutive windows with one anchor travel as one string, and windows whose anchor
no other document has never travel at all.

1. Each batch of documents tells which anchors it holds; anchors of two documents or more are shared.
2. Strings with shared anchors are range-partitioned by their anchor's bytes, the leading tokens of the
   suffixes below it, at splitters from a sample. Equal strings of one group of documents are combined first.
3. Each bucket is sorted locally by multikey quicksort, several bytes at a time and lengths first, and neighbours are
   compared: equal strings, and then the windows of what is left, which are the suffixes cut to SPAN bytes.
   Splitters stand between different anchors only, so suffixes on the two sides of a boundary differ in their
   first GRAM bytes from the anchor on, and no repeat crosses it: comparing across boundaries finds nothing.
   An anchor that very many groups of documents hold, as at the ends of a passage that a third of them share, is
   not kept in one bucket: its windows are dealt one by one, by all their bytes.
4. What was found goes back to the documents, which drop the covered bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups_for, mix, partitions, text_bytes


@dataclass
class Settings:
    span: int = 50  # bytes that make a repeat
    group_bytes: int = 12 << 20  # text of a group of documents
    hot: int = 4_096  # tellings (of batches and groups) beyond which the windows of an anchor are dealt one by one
    sample_docs: int = 2_000  # bound of the sample that splitters come from; results don't depend on it


GRAM = 20
SLICE = 1 << 18  # bytes hashed at a time, so that the arrays stay in the processor's cache
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
_B = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_B, n, 1 << 64))


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes from each place on, by doubling: 1, 2, 4, 8, 16 and 16 + 4 bytes."""
    h = _TABLE[data]
    four = None
    for n in (1, 2, 4, 8):
        h = h[:-n] * _power(n) + h[n:]
        if n == 2:
            four = h
    h = h[: len(data) - GRAM + 1] * _power(4) + four[16 : 16 + len(data) - GRAM + 1]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def runs(data: np.ndarray, offsets: np.ndarray, span: int, known: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (document, first window, number of windows, anchor hash of 48 bits, place
    of the anchor). Windows never cross documents. With `known`, sorted hashes, only runs with one of those
    anchors; without, places are not looked for and are those of the first windows."""
    docs, firsts, sizes, anchors, places = [], [], [], [], []
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= SLICE:
            j += 1
        a, b = int(offsets[i]), int(offsets[j])
        if b - a >= span:
            hashes = _gram_hashes(data[a:b])
            least = _sliding_min(hashes, span - GRAM + 1)
            ends = offsets[i + 1 : j + 1] - a
            new = np.ones(len(least), bool)
            new[1:] = least[1:] != least[:-1]
            starts_of = offsets[i:j] - a
            new[starts_of[starts_of < len(least)]] = True
            # windows that would cross the end of their document belong to none
            stop = ends - span + 1
            inner = stop[(stop >= 0) & (stop < len(least))]
            new[inner] = True
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(least)))
            doc = np.searchsorted(ends, first, side="right")
            good = first + span <= ends[doc]
            doc, first, size = doc[good], first[good], size[good]
            anchor = least[first] >> np.uint64(16)
            place = first
            if known is not None:
                keep = known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor
                doc, first, size, anchor = doc[keep], first[keep], size[keep], anchor[keep]
                place, open_ = first.copy(), np.arange(len(first))
                while len(open_):  # step on until the gram is the anchor, 30 steps at most
                    open_ = open_[hashes[place[open_]] != least[first[open_]]]
                    place[open_] += 1
            docs.append(doc + i)
            firsts.append(first + a)
            sizes.append(size)
            anchors.append(anchor)
            places.append(place + a)
        i = j
    if not docs:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none
    return np.concatenate(docs), np.concatenate(firsts), np.concatenate(sizes), np.concatenate(anchors), np.concatenate(places)


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed blob, byte planes apart."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(np.array([len(a), a.itemsize], "<i8").tobytes())
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unsqueeze(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in kinds:
        n, size = np.frombuffer(raw, "<i8", 2, at)
        at += 16
        out.append(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * size
    return out


def _split(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) for each key below n that occurs."""
    order = np.argsort(keys, kind="stable")
    edge = np.searchsorted(keys[order], np.arange(n + 1))
    for k in np.flatnonzero(np.diff(edge)):
        yield int(k), order[edge[k] : edge[k + 1]]


def multikey_sort(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings of a byte pool, by length and then by bytes, and the number of each one's class of equal
    strings, in that order.

    Multikey quicksort with a few bytes as a letter, and the length as the first: strings are sorted by one
    letter, and only those still equal to a neighbour go on to the next. The sort key of a round is the place
    of a string's group, which keeps groups apart, before the letter; so a round is one quicksort of whole
    numbers. `pool` is followed by 16 spare bytes."""
    n = len(start)
    order = np.argsort(length, kind="stable")
    group = np.zeros(n, np.int64)
    live = np.arange(n)
    if n:
        new = np.append(True, np.diff(length[order]) != 0)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        group = np.repeat(first, count)  # a group is named by its first place
        live = live[np.repeat(count > 1, count)]
    size = (63 - int(n).bit_length()) // 8  # bytes of a letter
    bits = np.uint64(8 * size)
    words = np.ndarray(max(len(pool) - 7, 0), ">u8", pool, 0, (1,))  # the 8 bytes from each place on
    at = 0
    while len(live):
        who = order[live]
        letter = words[np.minimum(start[who] + at, len(words) - 1)].astype(np.uint64) >> (np.uint64(64) - bits)
        left = length[who] - at
        if int(left.min()) < size:
            part = left < size
            letter[part] &= ~((np.uint64(1) << (8 * (size - left[part])).astype(np.uint64)) - np.uint64(1))
        key = (group[live].astype(np.uint64) << bits) | letter
        by = np.argsort(key)
        order[live] = who[by]
        key = key[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(first, len(live)))
        group[live] = np.repeat(live[first], count)
        at += size
        live = live[np.repeat(count > 1, count) & (length[order[live]] > at)]
    return order, np.cumsum(np.append(True, group[1:] != group[:-1])[:n]) - 1


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of whole numbers: the run of each number, and the numbers."""
    of = np.repeat(np.arange(len(first)), count)
    return of, np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def _bucket_matches(doc: np.ndarray, anchor: np.ndarray, pool: np.ndarray, start: np.ndarray, windows: np.ndarray, span: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(string, first window, number of windows) of the windows of a bucket that a smaller document has too."""
    order, klass = multikey_sort(pool, start, windows + span - 1)
    edge = np.flatnonzero(np.append(True, klass[1:] != klass[:-1]))
    low = np.minimum.reduceat(doc[order], edge)
    later = doc[order] > low[klass]  # the same string stands in a smaller document
    out = [(order[later], np.zeros(int(later.sum()), np.int64), windows[order[later]])]
    # one string of each class, from its smallest document, stands for its windows
    same = np.flatnonzero(~later)
    first = np.searchsorted(klass[same], np.arange(len(edge)))
    count = np.diff(np.append(first, len(same)))
    rep = order[same[first]]
    # classes alone under their anchor have no partner
    _, back, shared = np.unique(anchor[rep], return_inverse=True, return_counts=True)
    some = shared[back] > 1
    rep, first, count = rep[some], first[some], count[some]
    if len(rep):
        owner, inner = _spread(np.zeros(len(rep), np.int64), windows[rep])
        worder, wclass = multikey_sort(pool, start[rep][owner] + inner, np.full(len(owner), span, np.int64))
        wdoc = doc[rep][owner][worder]
        wlow = np.minimum.reduceat(wdoc, np.flatnonzero(np.append(True, wclass[1:] != wclass[:-1])))
        hit = np.zeros(len(owner), bool)
        hit[worder] = wlow[wclass] < wdoc
        flagged = np.flatnonzero(hit)
        if len(flagged):
            cut = np.flatnonzero(np.append(True, (np.diff(flagged) != 1) | (owner[flagged][1:] != owner[flagged][:-1])))
            run = np.diff(np.append(cut, len(flagged)))
            at = flagged[cut]
            # whatever of the class stands in its smallest document has the same windows
            of, members = _spread(first[owner[at]], count[owner[at]])
            out.append((order[same[members]], inner[at][of], run[of]))
    return out


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A group's rows in order of doc_id and text, their ids (null before all), bytes and offsets."""
    table = table.append_column("_tessera_id", table["doc_id"].fill_null(np.iinfo(np.int64).min))
    table = table.sort_by([("_tessera_id", "ascending"), ("text", "ascending")]).combine_chunks()
    text = table["text"].combine_chunks() if isinstance(table["text"], pa.ChunkedArray) else table["text"]
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    data, offsets = text_bytes(text)
    return table, table["_tessera_id"].to_numpy(), data, offsets


def remove_repeats(docs: DataFrame, settings: Settings | None = None, keep_text: bool = False) -> DataFrame:
    """Documents with n_bytes, n_removed, n_spans and kept_sha256; with keep_text, text becomes what is kept.

    A byte goes if a string of `span` bytes that covers it also starts in a document with a smaller doc_id;
    strings are judged on the input. Null texts are empty, empty ones keep nothing, texts shorter than `span`
    stay whole. Repeated rows of one doc_id are one document to each other: neither is smaller. A null doc_id
    counts as smaller than all. Other columns pass through, those named like a result are replaced (and `_tessera_q`).
    Kept text drops bytes of characters that were cut.
    """
    s = settings or Settings()
    spark = docs.sparkSession
    clash = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "_tessera_q"]
    docs = docs.drop(*clash)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    groups = groups_for(size["b"] or 0, s.group_bytes, partitions(spark))
    # the text is part of the deal, so that rows without an id, or of one id, spread
    dealt = docs.withColumn("_tessera_q", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))
    splitters = spark.sparkContext.broadcast(_splitters(docs, size["n"], groups, s))
    shared = _shared(dealt.select("doc_id", "text", "_tessera_q"), groups, s)
    found = _found(dealt.select("doc_id", "text", "_tessera_q"), shared, splitters, groups, s)
    return _finish(dealt, found, s, keep_text)


def _splitters(docs: DataFrame, n: int, groups: int, s: Settings) -> np.ndarray:
    """Anchors that cut a sample of anchors into even parts."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            anchor = np.unique(runs(data, offsets, s.span)[3])
            anchor = anchor[np.random.default_rng(0).permutation(len(anchor))[: 20 * batch.num_rows]]
            place = runs(data, offsets, s.span, np.sort(anchor))[4] if len(anchor) else anchor
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[p : p + GRAM] for p in place], pa.binary())], ["gram"])

    share = min(1.0, s.sample_docs / max(n, 1))
    # of a long text a part will do here: only how even the buckets are depends on it
    rows = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.substring("text", 1, 100_000).alias("text")).limit(s.sample_docs)
    grams = sorted(r["gram"] for r in rows.mapInArrow(f, "gram binary").limit(20 * s.sample_docs).collect())
    if not grams:
        return np.zeros(0, f"S{GRAM}")
    at = np.unique(np.linspace(0, len(grams) - 1, groups + 1).astype(int)[1:-1])
    return np.unique(np.array([grams[i] for i in at], f"S{GRAM}"))


def _shared(dealt: DataFrame, groups: int, s: Settings) -> DataFrame:
    """(_q, anchors): for each group of documents the anchors in it that two documents or more hold."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            doc, _, _, anchor, _ = runs(data, offsets, s.span)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy()
            q = batch.column(2).to_numpy()
            order = np.argsort(anchor, kind="stable")
            anchor, doc = anchor[order], doc[order]
            if not len(anchor):
                continue
            keep = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
            anchor, doc = anchor[keep], doc[keep]
            edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            size = np.diff(np.append(edge, len(anchor)))
            low, high = np.minimum.reduceat(ids[doc], edge), np.maximum.reduceat(ids[doc], edge)
            many = np.repeat(low != high, size)
            of = q[doc]
            keep = np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1]))
            anchor, of, many = anchor[keep], of[keep], many[keep]
            bs, blobs = [], []
            for b, at in _split((mix(anchor) % np.uint64(groups)).astype(np.int64), groups):
                bs.append(b)
                blobs.append(_squeeze(np.diff(anchor[at], prepend=np.uint64(0)), of[at].astype(np.int32), many[at].astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array(bs, pa.int32()), pa.array(blobs, pa.binary())], ["_b", "blob"])

    def decide(table: pa.Table) -> pa.Table:
        parts = [_unsqueeze(x, np.uint64, np.int32, np.uint8) for x in table["blob"].to_pylist()]
        anchor = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        q = np.concatenate([p[1] for p in parts])
        many = np.concatenate([p[2] for p in parts]).astype(bool)
        batch = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        order = np.argsort(anchor, kind="stable")
        anchor, q, many, batch = anchor[order], q[order], many[order], batch[order]
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(edge, len(anchor)))
        # a document is in one batch: two batches are two documents
        told = np.logical_or.reduceat(many, edge) | (np.minimum.reduceat(batch, edge) != np.maximum.reduceat(batch, edge))
        keep, hot = np.repeat(told, size), np.repeat(size > s.hot, size)
        anchor, q, hot = anchor[keep], q[keep], hot[keep]
        qs, blobs = [], []
        for k, at in _split(q.astype(np.int64), groups):
            one, place = np.unique(anchor[at], return_index=True)
            qs.append(k)
            blobs.append(_squeeze(np.diff(one, prepend=np.uint64(0)), hot[at][place].astype(np.uint8)))
        return pa.table({"_tessera_q": pa.array(qs, pa.int32()), "anchors": pa.array(blobs, pa.binary())})

    return dealt.mapInArrow(tell, "_b int, blob binary").groupBy("_b").applyInArrow(decide, "_tessera_q int, anchors binary")


def _found(dealt: DataFrame, shared: DataFrame, splitters, groups: int, s: Settings) -> DataFrame:
    """(_q, hits): for each group of documents (document, first window, number of windows) of what repeats."""

    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        bs, qs, blobs = [], [], []
        if docs.num_rows and told.num_rows:
            q = docs["_tessera_q"][0].as_py()
            _, ids, data, offsets = _ordered(docs)
            parts = [_unsqueeze(x, np.uint64, np.uint8) for x in told["anchors"].to_pylist()]
            known, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_index=True)
            hot = np.concatenate([p[1] for p in parts]).astype(bool)[at]
            doc, first, size, anchor, place = runs(data, offsets, s.span, known)
            alone = hot[np.searchsorted(known, anchor)]
            if alone.any():  # their windows stand for themselves
                of, window = _spread(first[alone], size[alone])
                doc, anchor, place = (np.concatenate([x[~alone], x[alone][of]]) for x in (doc, anchor, place))
                first, size = np.concatenate([first[~alone], window]), np.concatenate([size[~alone], np.ones(len(window), size.dtype)])
                alone = np.arange(len(doc)) >= len(doc) - len(window)
            # equal strings: the smallest document's is sent, those of larger ones repeat it
            raw = data.tobytes()
            low: dict[bytes, int] = {}
            sent = np.ones(len(doc), bool)
            of = ids[doc]
            for i, (a, n, d) in enumerate(zip(first.tolist(), size.tolist(), of.tolist())):
                if low.setdefault(raw[a : a + n + s.span - 1], d) < d:
                    sent[i] = False
            local = ~sent
            if local.any():
                bs.append(groups + q)
                qs.append(q)
                blobs.append(_squeeze(doc[local].astype(np.int32), (first - offsets[doc])[local].astype(np.int32), size[local].astype(np.int32)))
            doc, first, size, anchor, place, alone = doc[sent], first[sent], size[sent], anchor[sent], place[sent], alone[sent]
            if len(doc):
                grams = np.lib.stride_tricks.sliding_window_view(data, GRAM)[place].view(f"S{GRAM}").reshape(-1)
                bucket = np.searchsorted(splitters.value, grams, side="right") if len(splitters.value) else np.zeros(len(doc), np.int64)
                if alone.any():
                    whole = np.array([zlib.crc32(raw[a : a + s.span]) for a in first[alone].tolist()], np.uint64)
                    bucket[alone] = (mix(whole) % np.uint64(groups)).astype(np.int64)
                for b, at in _split(bucket, groups):
                    pool = b"".join(raw[first[i] : first[i] + size[i] + s.span - 1] for i in at)
                    arrays = _squeeze(ids[doc[at]], doc[at].astype(np.int32), (first - offsets[doc])[at].astype(np.int32), size[at].astype(np.int32), anchor[at], np.frombuffer(pool, np.uint8))
                    bs.append(b)
                    qs.append(q)
                    blobs.append(arrays)
        return pa.table({"_b": pa.array(bs, pa.int32()), "_tessera_q": pa.array(qs, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        qs, blobs = table["_tessera_q"].to_pylist(), table["blob"].to_pylist()
        if table["_b"][0].as_py() >= groups:
            return pa.table({"_tessera_q": pa.array(qs, pa.int32()), "hits": pa.array(blobs, pa.binary())})
        parts = [_unsqueeze(x, np.int64, np.int32, np.int32, np.int32, np.uint64, np.uint8) for x in blobs]
        ids, doc, first, size, anchor = (np.concatenate([p[k] for p in parts]) for k in range(5))
        pool = np.concatenate([*(p[5] for p in parts), np.zeros(16, np.uint8)])
        q = np.repeat(np.array(qs, np.int64), [len(p[0]) for p in parts])
        size = size.astype(np.int64)
        length = size + s.span - 1
        start = np.cumsum(length) - length
        hits = _bucket_matches(ids, anchor, pool, start, size, s.span)
        which = np.concatenate([h[0] for h in hits])
        inner = np.concatenate([h[1] for h in hits])
        count = np.concatenate([h[2] for h in hits])
        out_q, out = [], []
        for k, at in _split(q[which], groups):
            w = which[at]
            out_q.append(k)
            out.append(_squeeze(doc[w], (first[w] + inner[at]).astype(np.int32), count[at].astype(np.int32)))
        return pa.table({"_tessera_q": pa.array(out_q, pa.int32()), "hits": pa.array(out, pa.binary())})

    strings = dealt.groupBy("_tessera_q").cogroup(shared.groupBy("_tessera_q")).applyInArrow(send, "_b int, _tessera_q int, blob binary")
    return strings.groupBy("_b").applyInArrow(compare, "_tessera_q int, hits binary")


def _finish(dealt: DataFrame, found: DataFrame, s: Settings, keep_text: bool) -> DataFrame:
    names = [f.name for f in dealt.schema.fields if f.name != "_tessera_q" and (keep_text or f.name != "text")]
    schema = T.StructType([dealt.schema[n] for n in names]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        table, _, data, offsets = _ordered(docs)
        gone = np.zeros(len(data) + 1, np.int32)
        for x in told["hits"].to_pylist():
            doc, first, size = _unsqueeze(x, np.int32, np.int32, np.int32)
            at = offsets[doc] + first
            np.add.at(gone, at, 1)
            np.add.at(gone, at + size + (s.span - 1), -1)
        covered = np.cumsum(gone[:-1]) > 0
        n_removed, n_spans, digests, texts = [], [], [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            m = covered[a:b]
            n = int(m.sum())
            kept = data[a:b][~m].tobytes() if n else data[a:b].tobytes()
            n_removed.append(n)
            n_spans.append(int(m[:1].sum() + (m[1:] & ~m[:-1]).sum()) if n else 0)
            digests.append(hashlib.sha256(kept).hexdigest())
            if keep_text:
                texts.append(kept.decode("utf-8", "ignore"))
        out = {n: table[n] for n in names if n != "text"}
        if keep_text:
            out["text"] = pa.array(texts, pa.string())
        out |= {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({f.name: out[f.name] for f in schema})

    return dealt.groupBy("_tessera_q").cogroup(found.groupBy("_tessera_q")).applyInArrow(cut, schema)

"""Removal of repeated word passages, by matching statistics against suffix automata of reference shards.

1. Tasks write documents in chunks. Windows of `window` words with the same smallest-hash gram of words in them are
   runs; equal windows have equal grams (anchors), so only runs of anchors that occur twice can repeat.
2. Chunks send those runs, a repeated one once, to the bucket of their anchor. There the distinct runs of a few
   anchors, in order of documents, are a reference shard: each run is streamed through the suffix automaton of those
   before it, which gives the longest match that ends at each word, and is then put into it. Windows that a match
   covers have been seen earlier.
3. Hits go back to the chunks, which drop the covered words.

A shard's automaton meets only the passages that share an anchor with it. Sending automata of all that repeats to all
tasks would cost documents times shards, and they have no bound.

An anchor with very many different runs, as at the ends of a passage that a third of the documents share, is not kept
in one bucket: its windows are dealt one by one, by all their words.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shared import Scratch

from .common import groups_for, mix, partitions, text_bytes
from .suffix import _spread, _split, _squeeze, _unsqueeze


@dataclass
class Settings:
    window: int = 20  # words that make a repeat
    gram: int = 5  # words of an anchor
    chunk_bytes: int = 8 << 20  # text of a chunk
    hot: int = 4_096  # different runs beyond which the windows of an anchor are dealt one by one
    shard_words: int = 50_000  # words of one automaton, if its first anchor does not have more


_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
SLICE = 1 << 19  # bytes or words hashed at a time
_LOW = np.uint64((1 << 20) - 1)  # bits of a place in a slice
_NO_ID = np.iinfo(np.int64).min


def _powers(n: int, of: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP: np.ndarray = np.zeros(0, np.uint64)
_DOWN: np.ndarray = np.zeros(0, np.uint64)


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of one buffer: differences of a running polynomial sum, taken to a common origin."""
    global _UP, _DOWN
    if len(_UP) < len(data):
        _UP, _DOWN = _powers(len(data), _BASE), _powers(len(data), pow(_BASE, -1, 1 << 64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _UP[: len(data)], out=total[1:], dtype=np.uint64)
    return mix((total[end] - total[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, hash) of the words of texts data[offsets[i]:offsets[i + 1]], in order."""
    word = ~_SPACE[data]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    stop = word.copy()
    stop[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begin[inner] |= word[inner]
    stop[inner - 1] |= word[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    hashes, i = [], 0
    while i < len(start):  # slices keep the arrays in the processor's cache; a longer word is a slice of its own
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, side="right")))
        a = start[i]
        hashes.append(_hash_words(data[a : end[j - 1]], start[i:j] - a, end[i:j] - a))
        i = j
    return start, end, doc, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each place on."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    return mix(out)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return np.minimum(h[: len(h) - (width - n)], h[width - n :]) if width > n else h


def runs_of(hashes: np.ndarray, doc: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, anchor of 44 bits) of runs: windows next to each other whose anchor is at one place.
    Windows lie within a document."""
    firsts, sizes, anchors = [], [], []
    for a in range(0, len(hashes) - s.window + 1, SLICE):
        h, d = hashes[a : a + SLICE + s.window - 1], doc[a : a + SLICE + s.window - 1]
        gram = _rolled(h, s.gram)
        keyed = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)  # ties: the first place
        least = _least(keyed, s.window - s.gram + 1)
        inside = d[: len(least)] == d[s.window - 1 :]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(least)))
        keep = inside[first]
        firsts.append(first[keep] + a)
        sizes.append(size[keep])
        anchors.append(least[first[keep]] >> np.uint64(20))
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    return np.concatenate(firsts), np.concatenate(sizes), np.concatenate(anchors)


class Automaton:
    """Suffix automaton of several sequences. A state's transitions are a dict from word to state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        here = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = here
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[here] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return here

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def statistics(self, words: list) -> list[int]:
        """Length of the longest string that ends at each word and lies in one of the sequences."""
        nxt, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for w in words:
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                matched += 1
            out.append(matched)
        return out


def _pack(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue()


def _unpack(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all().combine_chunks()


def _chunks(docs: DataFrame, s: Settings) -> DataFrame:
    """(chunk, docs): documents in chunks of about chunk_bytes of text, as Arrow streams."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part * 1_000_000 + k], pa.int64()), pa.array([_pack(pa.Table.from_batches(held))], pa.binary())], ["chunk", "docs"])

        for batch in batches:
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            at = 0
            while at < batch.num_rows:
                # the document that fills a chunk is its last
                to = min(batch.num_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + s.chunk_bytes - size, side="left"))))
                held.append(batch.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
                if size >= s.chunk_bytes:
                    yield chunk()
                    held, size, k = [], 0, k + 1
                at = to
        if held:
            yield chunk()

    return docs.mapInArrow(cut, "chunk long, docs binary")


def _opened(blob: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    table = _unpack(blob)
    text = table["text"].combine_chunks() if table.num_rows else pa.array([], pa.string())
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
    return (table, *text_bytes(text))


def _shared(chunks: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """(chunk, anchors): for each chunk the anchors in it that two runs or more have, and whether they are hot."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, data, offsets = _opened(blob.as_py())
                _, _, doc, h = words_of(data, offsets)
                first, size, anchor = runs_of(h, doc, s)
                if not len(first):
                    continue
                whole = _rolled(h, s.window)
                text = mix(whole[first]) * np.uint64(3) + mix(whole[first + size - 1]) + size.astype(np.uint64)
                order = np.lexsort((text, anchor))
                anchor, text = anchor[order], text[order]
                edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                different = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])).astype(np.int64)
                kinds, many = np.add.reduceat(different, edge), np.diff(np.append(edge, len(anchor))) > 1
                anchor = anchor[edge]
                names, blobs = [], []
                for b, at in _split((mix(anchor) % np.uint64(buckets)).astype(np.int64), buckets):
                    names.append(b)
                    blobs.append(_squeeze(np.diff(anchor[at], prepend=np.uint64(0)), np.minimum(kinds[at], 1 << 30).astype(np.int32), many[at].astype(np.uint8)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([chunk] * len(names), pa.int64()), pa.array(blobs, pa.binary())], ["b", "chunk", "blob"])

    def decide(table: pa.Table) -> pa.Table:
        parts = [_unsqueeze(x, np.uint64, np.int32, np.uint8) for x in table["blob"].to_pylist()]
        chunk = table["chunk"].to_numpy()
        anchor = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
        kinds = np.concatenate([p[1] for p in parts]).astype(np.int64)
        many = np.concatenate([p[2] for p in parts]).astype(bool)
        of = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
        order = np.argsort(anchor, kind="stable")
        anchor, kinds, many, of = anchor[order], kinds[order], many[order], of[order]
        edge = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        size = np.diff(np.append(edge, len(anchor)))
        keep = np.repeat(np.logical_or.reduceat(many, edge) | (size > 1), size)
        hot = np.repeat(np.add.reduceat(kinds, edge) > s.hot, size)
        anchor, hot, of = anchor[keep], hot[keep], of[keep]
        names, blobs = [], []
        for k, at in _split(of, len(parts)):
            names.append(int(chunk[k]))
            blobs.append(_squeeze(np.diff(anchor[at], prepend=np.uint64(0)), hot[at].astype(np.uint8)))
        return pa.table({"chunk": pa.array(names, pa.int64()), "anchors": pa.array(blobs, pa.binary())})

    return chunks.mapInArrow(tell, "b int, chunk long, blob binary").groupBy("b").applyInArrow(decide, "chunk long, anchors binary")


def _found(chunks: DataFrame, shared: DataFrame, buckets: int, s: Settings) -> DataFrame:
    """(chunk, hits): for each chunk (row, first window, windows) of what occurs earlier."""

    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        names: list = []
        blobs: list = []
        chunk = None
        if docs.num_rows and told.num_rows:
            chunk = docs["chunk"][0].as_py()
            table, data, offsets = _opened(docs["docs"][0].as_py())
            ids = table["doc_id"].fill_null(_NO_ID).to_numpy()
            raw = data.tobytes()
            version = np.array([zlib.crc32(raw[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)], np.int64)
            start, end, doc, h = words_of(data, offsets)
            head = np.searchsorted(doc, np.arange(len(offsets)))  # first word of each document
            first, size, anchor = runs_of(h, doc, s)
            parts = [_unsqueeze(x, np.uint64, np.uint8) for x in told["anchors"].to_pylist()]
            known = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
            hot = np.concatenate([p[1] for p in parts]).astype(bool)
            by = np.argsort(known)
            known, hot = known[by], hot[by]
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            keep = known[at] == anchor
            first, size, anchor, alone = first[keep], size[keep], anchor[keep], hot[at[keep]]
            if alone.any():  # their windows stand for themselves
                of, window = _spread(first[alone], size[alone])
                anchor = np.concatenate([anchor[~alone], anchor[alone][of]])
                first, size = np.concatenate([first[~alone], window]), np.concatenate([size[~alone], np.ones(len(window), size.dtype)])
                alone = np.arange(len(first)) >= len(first) - len(window)
            row = doc[first]
            inner = first - head[row]
            # equal runs: the earliest is sent, later ones repeat it
            order = np.lexsort((inner, version[row], ids[row]))
            texts: list = [None] * len(first)
            earliest: dict[bytes, tuple] = {}
            sent = np.ones(len(first), bool)
            for i in order.tolist():
                a, n = first[i], size[i] + s.window - 1
                text = b" ".join(raw[start[a] : end[a + n - 1]].split())
                where = (ids[row[i]], version[row[i]], inner[i])
                if earliest.setdefault(text, where) < where:
                    sent[i] = False
                else:
                    texts[i] = text
            local = np.flatnonzero(~sent)
            if len(local):
                names.append(-1 - chunk)
                blobs.append(_squeeze(row[local].astype(np.int32), inner[local].astype(np.int64), size[local].astype(np.int64)))
            live = np.flatnonzero(sent)
            if len(live):
                bucket = (mix(anchor[live]) % np.uint64(buckets)).astype(np.int64)
                single = np.flatnonzero(alone[live])
                if len(single):
                    whole = np.array([zlib.crc32(texts[live[i]]) for i in single], np.uint64)
                    bucket[single] = (mix(whole + np.uint64(1 << 40)) % np.uint64(buckets)).astype(np.int64)
                for b, at in _split(bucket, buckets):
                    i = live[at]
                    pool = b"\n".join(texts[k] for k in i)
                    names.append(b)
                    blobs.append(_squeeze(ids[row[i]], version[row[i]], row[i].astype(np.int32), inner[i].astype(np.int64), size[i].astype(np.int64), np.where(alone[i], np.uint64(0), anchor[i] + np.uint64(1)), np.frombuffer(pool, np.uint8)))
        return pa.table({"b": pa.array(names, pa.int64()), "chunk": pa.array([chunk] * len(names), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        chunk, blobs = table["chunk"].to_numpy(), table["blob"].to_pylist()
        if table["b"][0].as_py() < 0:  # what a chunk has found itself
            return pa.table({"chunk": pa.array(chunk), "hits": pa.array(blobs, pa.binary())})
        parts = [_unsqueeze(x, np.int64, np.int64, np.int32, np.int64, np.int64, np.uint64, np.uint8) for x in blobs]
        ids, version, row, inner, size, anchor = (np.concatenate([p[k] for p in parts]) for k in range(6))
        texts = [t for p in parts for t in p[6].tobytes().split(b"\n")]
        of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        which, first, count = seen_earlier(ids, version, inner, size, anchor, texts, s)
        names, out = [], []
        for k, at in _split(of[which], len(parts)):
            w = which[at]
            names.append(int(chunk[k]))
            out.append(_squeeze(row[w], inner[w] + first[at], count[at]))
        return pa.table({"chunk": pa.array(names, pa.int64()), "hits": pa.array(out, pa.binary())})

    sent = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(send, "b long, chunk long, blob binary")
    return sent.groupBy("b").applyInArrow(compare, "chunk long, hits binary")


def seen_earlier(ids: np.ndarray, version: np.ndarray, inner: np.ndarray, size: np.ndarray, anchor: np.ndarray, texts: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, windows) of the windows of runs that occur at an earlier place (id, version, start)."""
    hits: list[tuple[int, int, int]] = []
    twins: dict[int, list[int]] = {}  # runs at the same place of equal rows
    order = np.lexsort((inner, version, ids, anchor)).tolist()
    shard: list[list[int]] = []
    words = 0

    def judge() -> None:
        """Stream the runs of some anchors through the automaton of those before them."""
        automaton, number = Automaton(), {}
        for group in shard:
            for i in group:
                seq = [number.setdefault(w, len(number)) for w in texts[i].split(b" ")]
                start = None
                for k, matched in enumerate(automaton.statistics(seq)):
                    if matched >= s.window:
                        start = k - s.window + 1 if start is None else start
                    elif start is not None:
                        hits.append((i, start, k - s.window + 1 - start))
                        start = None
                if start is not None:
                    hits.append((i, start, len(seq) - s.window + 1 - start))
                automaton.add(seq)
        shard.clear()

    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and anchor[order[to]] == anchor[order[at]]:
            to += 1
        earliest: dict[bytes, int] = {}
        different = []
        for i in order[at:to]:
            e = earliest.setdefault(texts[i], i)
            if e == i:
                different.append(i)
            elif (ids[e], version[e], inner[e]) < (ids[i], version[i], inner[i]):
                hits.append((i, 0, int(size[i])))
            else:
                twins.setdefault(e, []).append(i)
        # a run alone under its anchor has no partner, and anchor 0 has single windows, which are equal or not
        if len(different) > 1 and anchor[order[at]]:
            shard.append(different)
            words += sum(int(size[i]) + s.window - 1 for i in different)
            if words >= s.shard_words:
                judge()
                words = 0
        at = to
    judge()
    hits += [(i, first, count) for e, first, count in hits for i in twins.get(e, ())]
    found = np.array(hits, np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def remove_passages(docs: DataFrame, settings: Settings | None = None, keep_text: bool = False) -> DataFrame:
    """Documents with n_words, n_removed and kept_sha256; with keep_text, text becomes the kept words.

    Words are what blanks and 0x09 to 0x0D separate. A word goes if a window of `window` words that covers it also
    starts earlier: in a document with a smaller doc_id, or earlier in the same one. Windows are judged on the input.
    Null texts have no words, texts shorter than a window stay whole. A null doc_id counts as smaller than all; rows of
    one doc_id with different texts are documents in an order of their own, and equal rows are no repeats of each other.
    The digest is of the kept words, joined by one blank. Other columns pass through, those named like a result are
    replaced."""
    s = settings or Settings()
    spark = docs.sparkSession
    docs = docs.drop("n_words", "n_removed", "kept_sha256")
    scratch = Scratch(spark)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()
    chunks = scratch.save("chunks", _chunks(docs, s))
    buckets = groups_for(size["b"] or 0, s.chunk_bytes, partitions(spark))
    found = _found(chunks, _shared(chunks, buckets, s), buckets, s)
    return _finish(docs.schema, chunks, found, s, keep_text)


def _finish(schema: T.StructType, chunks: DataFrame, found: DataFrame, s: Settings, keep_text: bool) -> DataFrame:
    names = [f.name for f in schema.fields if keep_text or f.name != "text"]
    out_schema = T.StructType([schema[n] for n in names]).add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")

    def cut(docs: pa.Table, told: pa.Table) -> pa.Table:
        table = _unpack(docs["docs"][0].as_py())
        spans: dict[int, list] = {}
        for x in told["hits"].to_pylist():
            row, first, count = _unsqueeze(x, np.int32, np.int64, np.int64)
            for r, a, n in zip(row.tolist(), first.tolist(), count.tolist()):
                spans.setdefault(r, []).append((a, a + n + s.window - 1))
        n_words, n_removed, digests, texts = [], [], [], []
        for r, text in enumerate(table["text"]):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            kept = words
            if r in spans:
                gone = np.zeros(len(words) + 1, np.int64)
                for a, b in spans[r]:
                    gone[a] += 1
                    gone[b] -= 1
                kept = [w for w, g in zip(words, np.cumsum(gone)) if not g]
            joined = b" ".join(kept)
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                texts.append(joined.decode("utf-8", "replace"))
        out = {n: table[n] for n in names if n != "text"}
        if keep_text:
            out["text"] = pa.array(texts, pa.string())
        out |= {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table({f.name: out[f.name] for f in out_schema})

    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, out_schema)

"""Near-duplicate documents by minhash signatures and a multi-index Hamming join.

The first values of a signature make CHUNKS chunks of WIDTH minhash values of 32 bits. Two signatures that
differ in fewer than 2 * CHUNKS of them have, by the pigeonhole principle, a chunk with at most one differing
value; so each chunk is indexed under every way to leave one value out, and such pairs always meet. All values,
cut to 8 bits, then bound how far apart a pair can be, and what is left is confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import Scratch

from .common import connected_components, mix, text_bytes


@dataclass
class Settings:
    words: int = 5
    similar: int = 75  # hundredths of intersection by union
    chunks: int = 14
    width: int = 4  # a pair at 0.75 misses every chunk with a probability of 7e-9
    values: int = 256  # of a whole signature
    deviations: float = 5.5  # a pair this far below its expected agreement is no pair: 1e-7 at the limit
    seed: int = 20_011


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, for many texts at once.

    Words are what white space (space and 0x09 to 0x0D) separates, A-Z lowered. A text of fewer words has
    its whole sequence as one shingle, one without words has none. Word hashes are differences of a running
    polynomial sum over the whole buffer, taken back to a common origin.
    """
    n = len(offsets) - 1
    out = [np.zeros(0, np.uint64)] * n
    if not len(data):
        return out
    space = _SPACE[data]
    first = np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(~space & (before | first))
    last = np.zeros(len(data), bool)
    ends_at = offsets[1:] - 1
    last[ends_at[(ends_at >= 0) & (offsets[1:] > offsets[:-1])]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    ends = np.flatnonzero(~space & (after | last)) + 1
    if not len(starts):
        return out
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[_LOWER[data]] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    edge = np.searchsorted(starts, offsets)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    whole = np.zeros(len(hashes), np.uint64)
    m = len(hashes) - words + 1
    if m > 0:
        for i in range(words):
            whole[:m] += hashes[i : i + m] * factors[i]
        whole[:m] = mix(whole[:m])
    for k in range(n):
        a, b = edge[k], edge[k + 1]
        if b - a >= words:
            out[k] = np.unique(whole[a : b - words + 1])
        elif b > a:
            out[k] = mix((hashes[a:b] * factors[: b - a]).sum(keepdims=True) + np.uint64(b - a))
    return out


def _hash_functions(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(s.seed)
    k = s.values
    return rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minhash values of one set, 32 bits each."""
    least = np.full(len(a), (1 << 32) - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        part = shingles[at : at + 512, None]
        np.minimum(least, ((part * a + b) >> np.uint64(32)).min(axis=0), out=least)
    return least


def _signatures(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): a 128-bit digest of the set, and the signature as bytes."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sig", pa.binary())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_functions(s)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = text_bytes(part.column(1))
                sets = shingle_sets(data, offsets, s.words)
                digests, sigs = np.zeros((len(sets), 2), np.uint64), []
                for i, x in enumerate(sets):
                    if len(x):
                        digests[i] = x.sum(dtype=np.uint64), mix(x ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
                        sigs.append(_pack(signature(x, a, b), s))
                    else:
                        sigs.append(None)
                d = digests.view(np.int64)
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sigs, pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, n_shingles long, d1 long, d2 long, sig binary")


def _pack(sig: np.ndarray, s: Settings) -> bytes:
    """A signature as bytes: the values of the index whole, the others cut to 8 bits."""
    n = s.chunks * s.width
    return sig[:n].astype("<u4").tobytes() + (sig[n:] & np.uint64(255)).astype(np.uint8).tobytes()


def _unpack(packed: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The values of the index, by chunk, and all values cut to 8 bits."""
    n = 4 * s.chunks * s.width
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), n + s.values - s.chunks * s.width)
    whole = raw[:, :n].copy().view("<u4")
    short = np.concatenate([raw[:, :n:4], raw[:, n:]], axis=1)
    return whole.reshape(len(packed), s.chunks, s.width), short


def _slot_keys(whole: np.ndarray, s: Settings) -> np.ndarray:
    """Keys of signatures, (signatures x slots): every chunk under every way to leave one of its values out."""
    values = whole.astype(np.uint64)
    keys = np.empty(whole.shape, np.uint64)
    first = np.arange(s.chunks, dtype=np.uint64) * np.uint64(s.width)
    for out in range(s.width):
        h = np.broadcast_to(first + np.uint64(out), whole.shape[:2])
        for i in range(s.width):
            if i != out:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i] + np.uint64(1))
        keys[:, :, out] = h
    return keys.reshape(len(whole), s.chunks * s.width).view(np.int64)


def _first_slot(x: np.ndarray, y: np.ndarray, s: Settings) -> np.ndarray:
    """The first slot under which each pair of signatures has one key; -1 for none."""
    same = x == y
    n = same.sum(axis=2)
    met = n >= s.width - 1
    chunk = met.argmax(axis=1)
    at = np.arange(len(same))
    out = np.where(n[at, chunk] == s.width, 0, (~same[at, chunk]).argmax(axis=1))
    return np.where(met[at, chunk], chunk * s.width + out, -1)


def _keys(reps: DataFrame, s: Settings) -> DataFrame:
    """(key, rep, n_shingles): the keys of every class."""
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("n_shingles", pa.int64())])

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _slot_keys(_unpack(batch.column(1).to_pylist(), s)[0], s)
            for slot in range(keys.shape[1]):
                yield pa.record_batch([pa.array(keys[:, slot]), batch.column(0), batch.column(2)], schema=schema)

    return reps.select("rep", "sig", "n_shingles").mapInArrow(f, "key long, rep long, n_shingles long")


def _alike(x: np.ndarray, y: np.ndarray, similar: int) -> bool:
    """100 * intersection >= similar * union of two sorted sets, in whole numbers."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or 100 * len(x) < similar * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= similar * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) whose full sets pass."""
    sa = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), similar) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(f, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """(rep, shingles): full sets of the wanted documents, 8 bytes a shingle."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                data, offsets = text_bytes(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in shingle_sets(data, offsets, s.words)], pa.binary())], ["rep", "shingles"])

    # ids alone are handed to the tasks while they are few (counted); beyond that, texts meet them in a shuffle
    ids = wanted.select(F.col("rep").alias("doc_id"))
    ids = F.broadcast(ids) if wanted.count() <= FEW_IDS else ids
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(f, "rep long, shingles binary").where("length(shingles) > 0").distinct()


def link_near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document of (doc_id, text).

    Two documents are linked when their sets of word shingles have at least `similar` hundredths in common;
    component_id is the smallest doc_id that links reach, and kept marks that document. Texts that are null
    or without words have no set and stay alone, and so do documents without a doc_id: their component_id is null
    and they are kept. A document with fewer than `words` words has one shingle. Rows that repeat a doc_id are
    each reported; they are one document, so their texts, if different, are linked through it.

    Documents with the same set are one class from the start (combined before the shuffle), so exact copies
    cost a row. The classes of a key are dealt into salted parts of about SALT; each is confirmed against the
    smallest class of its part, and that against the smallest of the key, which joins large groups in a number of
    pairs linear in their size. Where a key then still holds several components, the classes outside its largest
    one meet all others in blocks of bounded size and bounded shingles: a pair is named by the first key that it
    shares alone, whatever its signatures rule out goes, and the rest is confirmed on full sets inside the block,
    nearest first, unless the pair has become connected there. Every pair that meets is thus confirmed, already
    connected, or too far apart.
    """
    s = settings or Settings()
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = scratch.save("signed", _signatures(docs, s))
    classes = signed.where("sig is not null and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by("sig", "doc_id").alias("sig"))
    classes = scratch.save("classes", classes)
    keys = _keys(classes, s)
    met = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    keys = scratch.save("keys", keys.join(met, "key"))
    first = scratch.save("first", _stars(keys))
    wanted = scratch.save("wanted", keys.select("rep").distinct())
    sets = scratch.save("sets", _sets(docs, wanted, s))
    links = scratch.save("links", _confirm(first, sets, s.similar).union(_same_id(signed, classes)))
    parts = connected_components(links)
    blocks = scratch.save("blocks", _blocks(keys, parts, s))
    named = scratch.save("named", _named(blocks, classes, s))
    if not named.isEmpty():
        links = scratch.save("links", links.union(_confirm_blocks(named, sets, s.similar)))
        parts = connected_components(links)
    scratch.drop("keys", "first", "wanted", "sets", "blocks", "named", "links")
    by_class = classes.select("d1", "d2", "n_shingles", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = signed.join(by_class, ["d1", "d2", "n_shingles"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Ids that may be broadcast: 8 MB.
FEW_IDS = 1_000_000
#: Classes of a key that share a pivot; classes and shingles of a block of a key (8 bytes a shingle).
SALT, BLOCK, SHINGLES = 512, 1_024, 2_000_000


def _same_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that rows of one doc_id are in. A class is named by its smallest doc_id, so two classes may
    have one name; that is then a node with several sets."""
    digest = F.struct("d1", "d2", "n_shingles")
    some = signed.where("sig is not null and doc_id is not null")
    several = some.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select("doc_id")
    named = some.join(several, "doc_id").join(classes.drop("sig"), ["d1", "d2", "n_shingles"]).select("doc_id", "rep")
    return named.join(named.groupBy("doc_id").agg(F.min("rep").alias("low")), "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b"))


def _stars(keys: DataFrame) -> DataFrame:
    """(a, b) with a < b: each class of a key with the smallest of its part, and that with the smallest of the key."""
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / SALT)).cast("int"))
    pivots = salted.groupBy("key", "salt").agg(F.min("rep").alias("pivot"))
    lows = pivots.groupBy("key").agg(F.min("pivot").alias("low"), F.count("*").alias("m")).where("m > 1")
    star = salted.join(pivots, ["key", "salt"]).select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    above = pivots.join(lows, "key").select(F.col("low").alias("a"), F.col("pivot").alias("b"))
    return star.union(above).where("a <> b").distinct()


def _blocks(keys: DataFrame, parts: DataFrame, s: Settings) -> DataFrame:
    """(key, i, j, mine, rep, component): where the classes of keys with several components meet; `mine` is a class's
    own block. A key that fits is one block. Otherwise classes outside its largest component are dealt into blocks
    i; blocks j are these again, and those of the largest. Rows are members times blocks of the smaller components,
    so a large group that is mostly linked stays linear. The stars have settled keys of two classes."""
    placed = keys.where("n > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    largest = F.max(F.struct("n", F.col("component").alias("c")))
    several = sizes.groupBy("key").agg(F.count("*").alias("m"), largest.alias("top"), F.max_by("w", F.struct("n", "component")).alias("top_w"), F.sum("n").alias("n"), F.sum("w").alias("w")).where("m > 1")

    def cut(n, w):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(w / SHINGLES)).cast("int")

    fits = (F.col("n") <= BLOCK) & (F.col("w") <= SHINGLES)
    several = several.withColumn("top", F.when(~fits, F.col("top"))).select("key", F.col("top.c").alias("major"), F.when(fits, F.lit(1)).otherwise(cut(F.col("n") - F.col("top.n"), F.col("w") - F.col("top_w"))).alias("minors"), F.when(fits, F.lit(0)).otherwise(cut(F.col("top.n"), F.col("top_w"))).alias("majors"))
    dealt = placed.join(several, "key").withColumn("minor", F.coalesce(F.col("component") != F.col("major"), F.lit(True)))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("majors"))).cast("int")
    dealt = dealt.withColumn("mine", mine)
    # a minor block meets every minor block from itself on, and every major block (numbered after them)
    to_minors = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    to_majors = F.transform(F.slice(F.sequence(F.lit(0), F.col("majors")), 1, F.col("majors")), lambda k: F.struct(F.col("mine").alias("i"), (F.col("minors") + k).alias("j")))
    from_major = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda k: F.struct(k.alias("i"), (F.col("minors") + F.col("mine")).alias("j")))
    places = F.when(F.col("minor"), F.concat(to_minors, to_majors)).otherwise(from_major)
    return dealt.select("key", F.explode(places).alias("at"), "rep", "component", F.when(F.col("minor"), F.col("mine")).otherwise(F.col("minors") + F.col("mine")).alias("mine")).select("key", "at.i", "at.j", "mine", "rep", "component")


def _named(blocks: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(key, i, j, xs, ys, agree): pairs of classes of different components whose signatures may be of similar sets, each
    once, in the block pair of the first key that it shares; as packed arrays, nearest first."""
    p = s.similar / 100
    least = int(s.values * p - s.deviations * (s.values * p * (1 - p)) ** 0.5)

    def f(table: pa.Table) -> pa.Table:
        key, i, j = (table[c][0].as_py() for c in ("key", "i", "j"))
        rep, part, mine = (table[c].to_numpy() for c in ("rep", "component", "mine"))
        whole, short = _unpack(table["sig"].to_pylist(), s)
        slot = next(int(at[0]) for r in range(len(rep)) if len(at := np.flatnonzero(_slot_keys(whole[r : r + 1], s)[0] == key)))
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        xs, ys, near = [], [], []
        step = max(1, (1 << 22) // (s.values * max(len(right), 1)))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            agree = (short[rows][:, None, :] == short[right][None, :, :]).sum(axis=2, dtype=np.int32)
            good = (agree >= least) & (part[rows][:, None] != part[right][None, :])
            if i == j:
                good &= rows[:, None] < right[None, :]
            x, y = np.nonzero(good)
            agree, x, y = agree[x, y], rows[x], right[y]
            mine_first = _first_slot(whole[x], whole[y], s) == slot
            xs.append(rep[x[mine_first]])
            ys.append(rep[y[mine_first]])
            near.append(agree[mine_first])
        xs, ys, near = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys, near))
        if not len(xs):
            return pa.table({"key": pa.array([], pa.int64()), "i": pa.array([], pa.int32()), "j": pa.array([], pa.int32()), "xs": pa.array([], pa.binary()), "ys": pa.array([], pa.binary())})
        order = np.lexsort((ys, xs, -near))
        return pa.table({"key": pa.array([key]), "i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "xs": pa.array([xs[order].tobytes()]), "ys": pa.array([ys[order].tobytes()])})

    members = blocks.join(classes.select("rep", "sig"), "rep")
    return members.groupBy("key", "i", "j").applyInArrow(f, "key long, i int, j int, xs binary, ys binary")


def _confirm_blocks(named: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """(a, b): links among the named pairs of each block pair, as far as they join what is not yet connected there."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, i, j, xs, ys in zip(*(batch.column(k) for k in range(5))):
                found = np.unique(np.concatenate([np.frombuffer(xs.as_py(), np.int64), np.frombuffer(ys.as_py(), np.int64)]))
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key.as_py())), pa.array(np.full(n, i.as_py()), pa.int32()), pa.array(np.full(n, j.as_py()), pa.int32()), pa.array(found)], ["key", "i", "j", "rep"])

    sent = named.mapInArrow(ids, "key long, i int, j int, rep long").join(sets, "rep")

    def f(told: pa.Table, held: pa.Table) -> pa.Table:
        a, b = [], []
        if told.num_rows and held.num_rows:
            full: dict[int, list[np.ndarray]] = {}
            for r, x in zip(held["rep"].to_pylist(), held["shingles"].to_pylist()):
                full.setdefault(r, []).append(np.frombuffer(x, np.uint64))
            root = {r: r for r in full}

            def top(r: int) -> int:
                while root[r] != r:
                    root[r] = root[root[r]]
                    r = root[r]
                return r

            for x, y in zip(np.frombuffer(told["xs"][0].as_py(), np.int64).tolist(), np.frombuffer(told["ys"][0].as_py(), np.int64).tolist()):
                p, q = top(x), top(y)
                if p != q and any(_alike(u, v, similar) for u in full[x] for v in full[y]):
                    root[max(p, q)] = min(p, q)
                    a.append(min(x, y))
                    b.append(max(x, y))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    by = ["key", "i", "j"]
    return named.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(f, "a long, b long")

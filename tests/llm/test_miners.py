"""Spelling variants, phrases and passages against brute force, on nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns, and with limits so small that every hot case is met."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import phrases, substring, suffix, variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


@pytest.mark.parametrize("settings", [variants.Settings(), variants.Settings(shard_words=40, most=3)])
@pytest.mark.parametrize("alphabet", ["ab", "aé€𝒳ÿ"])
def test_variants_equal_brute_force(spark, settings, alphabet):
    """Few letters give words with many halves in common, repeated letters and ties."""
    rng = random.Random(4)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 10))): rng.choice([5, 6, 30, 31, 160, 900]) for _ in range(250)}
    words |= {"x" * 3_000: 9, "x" * 2_999: 400, "x" * 1_500 + "y" + "x" * 1_499: 70}
    rows = [*words.items(), *list(words.items())[:5], ("short", 99), ("rarely", 4), (None, 50), ("nothing", None)]
    for w in list(words)[:5]:
        words[w] *= 2
    df = spark.createDataFrame(rows, "word string, n long").withColumn("root", F.lit(1)).withColumn("side", F.lit(2))
    got = variants.group_variants(df, settings).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == brute_variants(words)


def test_chains_of_forms(spark):
    words = {"aaaaaaaa"[:i] + "bbbbbbbb"[i:]: 5 ** (i + 2) for i in range(9)}
    got = {r["word"]: r["root"] for r in variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got) == set(words) and set(got.values()) == {"aaaaaaaa"}


def test_words_and_planted_misspellings(spark):
    long = "Überfluß " * 30_000
    texts = [(1, "Don't-STOP naïve×naïve ÀÉÎ"), (2, None), (3, ""), (None, "Zürich zürich"), (4, long), (4, long)] + [(i, "working workers WORKING") for i in range(10, 400)]
    expected: Counter = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 7 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                expected[run] += 1
    got = variants.count_words(spark.createDataFrame(texts, "doc_id long, text string").withColumn("word", F.lit(1)), drop_every=7)
    assert {r["word"]: r["n"] for r in got.collect()} == expected and len(expected) > 6
    none = spark.createDataFrame([], "doc_id long, text string")
    assert variants.group_variants(variants.count_words(none)).count() == 0


# phrases


def brute_phrases(rows, least, top, inside=80):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        cover = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    cover[p[i : i + m]] = max(cover[p[i : i + m]], a)
        kept = []
        for p, a in candidates.items():
            if 100 * cover[p] < inside * a:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("settings", [phrases.Settings(min_count=4, top=25), phrases.Settings(min_count=3, top=7, shard_words=40, bucket_keys=30)])
def test_phrases_equal_brute_force(spark, settings):
    rng = random.Random(8)
    words = ["the", "Old", "new", "house", "día", "of", "cards", "x's", " ", "€", "a.b"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", "\n", "\t "]) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts] + [("en", None), ("fr", ""), ("fr", " ,. "), ("en", "old house " * 9_000)] + [("de", "new york city hall")] * 30
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("rank", F.lit(0)).withColumn("phrase", F.lit("p"))
    got = phrases.mine_phrases(df, settings).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == brute_phrases(rows, settings.min_count, settings.top)
    assert phrases.mine_phrases(df.limit(0), settings).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(60):
        ids = rng.integers(0, 4, rng.integers(1, 60))
        order, common = phrases.suffix_array(ids, 4)
        suffixes = [tuple(itertools.takewhile(lambda x: x, ids[i : i + 4].tolist())) for i in order]
        assert sorted(order.tolist()) == np.flatnonzero(ids).tolist()
        for length in range(1, 5):
            place, count = phrases.intervals(ids, order, common, length)
            got = Counter({tuple(ids[p : p + length].tolist()): int(c) for p, c in zip(place, count)})
            assert got == Counter(s[:length] for s in suffixes if len(s) >= length) and len(place) == len(got)


def test_scores_beyond_64_bits(spark):
    """Counts so large that 2,000,000 times them passes 64 bits."""
    words = spark.createDataFrame([("en", "a", 9 * 10**14, 1), ("en", "b", 8 * 10**14, 2), ("en", "c", 7 * 10**14, 3)], "lang string, word string, f long, gid long")
    units = spark.createDataFrame([([1], 9 * 10**14), ([2], 8 * 10**14), ([3], 7 * 10**14), ([1, 2], 6 * 10**14), ([2, 3], 5 * 10**14), ([1, 2, 3], 4 * 10**14)], "g array<long>, f long")
    got = {r["phrase"]: r["score"] for r in phrases._ranked(units, words, spark.createDataFrame([("en", 10**16)], "lang string, n long"), phrases.Settings()).collect()}
    assert got == {"a b": 2_000_000 * 6 // 17, "a b c": 2_000_000 * 4 // 14} and 5 * 80 == 100 * 4


# passages


def brute_passages(rows, window=20):
    """Positions are (id, text, start): rows of one id are in the order of a checksum of their texts."""
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()))
    split = [((r[1] or "").encode().split(), key(r)) for r in rows]
    first = {}
    for words, k in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, (k, i)), (k, i))
    out = []
    for (words, k), r in zip(split, rows):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (k, i):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((r[0], len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages():
    rng = random.Random(6)
    draw = lambda n: " ".join(rng.choice(["alpha", "Beta", "béta", "γ"]) + str(rng.randint(0, 30)) for _ in range(n))
    shared, other = draw(26), draw(45)
    rows = [(i, draw(40) + rng.choice([" ", "\n", "\t\r "]) + (shared if i % 2 else other) + "  " + draw(30)) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(25)] + [(200, "ab " * 300), (201, "x y z " * 200), (202, None), (203, ""), (204, " \n"), (205, "few words"), (205, "few words")]
    rows += [(None, shared), (None, other + " more"), (300, other), (300, other), (300, shared + " " + shared), (7, rows[7][1]), (301, "w" * 600_000 + " " + other)]
    return rows


@pytest.mark.parametrize("settings", [substring.Settings(), substring.Settings(chunk_bytes=900, shard_words=60), substring.Settings(chunk_bytes=900, hot=2)])
def test_passages_equal_brute_force(spark, settings):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("docs", F.lit(2))
    out = substring.remove_passages(df, settings)
    assert {"chunk", "docs"} <= set(out.columns)
    got = out.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_passages(rows)


def test_kept_text_and_no_rows(spark):
    df = spark.createDataFrame(passages(), "doc_id long, text string")
    out = substring.remove_passages(df, keep_text=True).collect()
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in out) and len(out) == len(passages())
    assert substring.remove_passages(df.limit(0)).count() == 0


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(80):
        before = [[rng.randint(0, 2) for _ in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 4))]
        text = [rng.randint(0, 2) for _ in range(rng.randint(0, 15))]
        automaton = substring.Automaton()
        for s in before:
            automaton.add(s)
        inside = {tuple(s[i:j]) for s in before for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        expected = [max((k for k in range(1, e + 2) if tuple(text[e + 1 - k : e + 1]) in inside), default=0) for e in range(len(text))]
        assert automaton.statistics(text) == expected


def test_packed_arrays_come_back():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(40), np.zeros(0, np.int32), np.array([1, 2], np.uint8)]
    back = suffix._unsqueeze(suffix._squeeze(*arrays), np.uint64, np.int32, np.uint8)
    assert all(np.array_equal(a, b) for a, b in zip(arrays, back))


"""The operators against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, embdup, html, langid, neardup, packing, sharding, suffix, tokens, toxicity
from tessera.llm.common import connected_components
from tessera.llm.queries import tokenizer_file

DOCS = "doc_id long, text string"
BIG = (1 << 60) + 1  # an id that no double holds


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa"]) + str(rng.integers(30)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    base = [words(rng, 60) for _ in range(8)]
    shared = words(rng, 14)
    rows = [(10 * i, t) for i, t in enumerate(base)]
    rows += [(5, base[0]), (7, base[0] + " tail"), (101, base[1].replace("alpha", "omega", 1)), (102, base[2][:200] + shared + base[3][:90]), (103, shared), (104, words(rng, 5) + " " + shared + words(rng, 9))]
    rows += [(200, None), (201, ""), (202, "   \n"), (203, "one two"), (204, "ONE  two"), (205, "one two"), (206, "ab " * 4000), (206, "ab " * 4000), (None, "no id " + shared)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[90] == 90
    assert connected_components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_components_of_a_long_chain(spark, shuffled):
    ids = np.random.default_rng(1).permutation(10_001) if shuffled else np.arange(10_001)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in zip(ids, ids[1:])], "a long, b long")
    rows = connected_components(edges.union(edges)).collect()
    assert len(rows) == 10_001 and {r["component"] for r in rows} == {0}


def brute_repeats(rows, span=50):
    low = -(1 << 63)
    items = [(low if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in items:
        for p in range(len(t) - span + 1):
            w = t[p : p + span]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in items:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - span + 1):
            if first[t[p : p + span]] < i:
                gone[p : p + span] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((None if i == low else i, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 0])
def test_repeats_equal_brute_force(docs, texts, hot):
    got = suffix.remove_repeats(docs.withColumn("n_spans", F.lit(1)).withColumn("_q", F.lit("x")).withColumn("_id", F.lit("y")), suffix.Settings(hot=hot))
    assert {"_q", "_id"} <= set(got.columns)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_repeats(texts)


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_of_a_passage_in_every_document(spark, hot):
    """One passage between different neighbours, documents without an id and of one id."""
    rng = np.random.default_rng(31)
    shared = words(rng, 12)
    rows = [(None if i % 9 == 0 else 7 if i % 9 == 1 else BIG + i, words(rng, 6) + " " + shared + " " + words(rng, 6)) for i in range(90)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, DOCS), suffix.Settings(hot=hot, group_bytes=2_000))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str) == brute_repeats(rows)


def test_multikey_sort():
    rng = np.random.default_rng(1)
    for _ in range(100):
        strings = [bytes(rng.integers(97, 99, rng.integers(1, 25)).astype(np.uint8)) for _ in range(rng.integers(1, 40))]
        length = np.array([len(x) for x in strings])
        pool = np.frombuffer(b"".join(strings) + bytes(16), np.uint8)
        order, klass = suffix.multikey_sort(pool, np.cumsum(length) - length, length)
        got = [strings[i] for i in order]
        assert got == sorted(strings, key=lambda x: (len(x), x))
        assert [sorted(set(strings), key=lambda x: (len(x), x))[k] for k in klass] == got


def test_decontamination_both_ways(spark):
    rows = [(1, "!! The Quick brown-Fox jumps OVER it"), (2, "quick brown fox"), (3, None), (4, ""), (5, "a quick brown  fox b"), (5, "a quick brown  fox b"), (6, "clean text stays")]
    items = spark.createDataFrame([(9, "Quick brown fox"), (8, None), (7, "..."), (10, "quick Brown fox")], "item_id long, text string")
    d = spark.createDataFrame(rows, DOCS)
    found = decontam.find_contamination(d, items)
    other = decontam.find_contamination(d, items, max_bytes=0)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    a, b = (sorted(tuple(r) for r in f.select(columns).collect()) for f in (found, other))
    assert a == b and [r[2] for r in a] == [3, 3, 0, 0, 3, 3, 0] and a[0][4] == hashlib.sha256(b"10,9").hexdigest()
    kept = {r["doc_id"]: r["text"] for r in decontam.remove_hits(found).collect()}
    assert kept == {1: "!! The jumps OVER it", 2: "", 3: None, 4: "", 5: "a b", 6: "clean text stays"}


def brute_contamination(rows, items, n=10):
    def split(t):
        return [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]

    out = []
    windows = [(i, tuple(w[k : k + n])) for i, t in items for w in [split(t)] if w for k in range(max(1, len(w) - n + 1))]
    for d, t in rows:
        w, gone, named = split(t), set(), set()
        for i, g in windows:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    gone.update(range(k, k + len(g)))
                    named.add(i)
        ids = sorted(named - {None})
        out.append((d, len(w), len(gone), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_decontamination_equals_brute_force(spark, docs, texts, max_bytes):
    rng = np.random.default_rng(12)
    cut = [(f"i{k}", " ".join((texts[k % 8][1] or "").split(" ")[k : k + 8 + k])) for k in range(9)]
    items = [*cut, (None, texts[0][1]), ("a,b", "one two"), ("it's", "ONE, two!"), ("back\\slash", "one two"), ('quo"te', "ab"), ("empty", ""), ("none", None), ("clean", words(rng, 15)), ("i1", texts[3][1])]
    b = spark.createDataFrame(items, "item_id string, text string")
    d = docs.selectExpr("*", "'x' item", "1 size", "'g' gram", "2 h", "3 _w", "4 n_hit", "5 _k")
    got = decontam.find_contamination(d, b, max_bytes=max_bytes)
    assert {"item", "size", "gram", "h", "_w"} <= set(got.columns)
    rows = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((tuple(r) for r in rows), key=str) == brute_contamination(texts, items)


def test_jump_hash():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 500)
    assert sharding.jump(keys, 24).tolist() == [plain(int(k) % (1 << 64), 24) for k in keys]


def test_shards(docs, texts):
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(-1))).alias("k")).collect()}
    crc = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    rows = sharding.assign_shards(docs.selectExpr("*", "1 slot", "2 shard", "3 _chunk"), 4, rows_per_chunk=2).collect()
    for r in rows:
        key = np.array([keys[r["doc_id"]]])
        assert (r["shard"], r["grown_shard"]) == (sharding.jump(key, 4)[0], sharding.jump(key, 5)[0])
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == crc
    assert len(rows) == len(texts)
    for s in range(4):
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert all(r["grown_shard"] in (r["shard"], 4) for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] == 200} == {8}


def brute_components(rows, size=5):
    sets = []
    for _, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    ids = [i for i, _ in rows]
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for x, a in enumerate(sets):
            for y, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    low = min(least[ids[x]], least[ids[y]])
                    changed |= least[ids[x]] != low
                    least[ids[x]] = low
    return sorted((i, len(s), least[i], least[i] == i) for i, s in zip(ids, sets))


def test_near_duplicates_equal_brute_force(docs, texts):
    got = neardup.link_near_duplicates(docs.where("doc_id is not null"))
    assert sorted(tuple(r) for r in got.collect()) == brute_components([r for r in texts if r[0] is not None])


def test_texts_of_one_id_are_linked(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "q r s t u v"), (3, "q r s t u v"), (4, "other words stand here alone"), (2, "q r s t u v")]
    got = neardup.link_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 1, False), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True)]


@pytest.fixture
def small_blocks(monkeypatch):
    for name, n in (("SALT", 7), ("BLOCK", 16), ("SHINGLES", 900)):
        monkeypatch.setattr(neardup, name, n)


def test_near_duplicates_in_many_blocks(spark, small_blocks):
    """Pairs just around the limit in one group: no link is lost, whatever blocks they meet in."""
    rng = np.random.default_rng(21)
    base = words(rng, 90).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.integers(0, 90, rng.integers(1, 9)):
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    got = neardup.link_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)


def test_near_duplicates_of_one_large_group(spark):
    rng = np.random.default_rng(8)
    base = words(rng, 80).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        for k in rng.integers(0, 80, rng.integers(0, 6)):
            w[k] = f"new{i}x{k}"
        rows.append((i, " ".join(w)))
    got = neardup.link_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)


def test_documents_without_an_id_stay(spark, docs, texts):
    import corpus_pipeline

    more = docs.union(spark.createDataFrame([(None, texts[0][1]), (None, None)], DOCS))
    got = [tuple(r) for r in neardup.link_near_duplicates(more).select("doc_id", "component_id", "kept").collect() if r["doc_id"] is None]
    assert got == [(None, None, True)] * 3
    full = more.selectExpr("doc_id", "text", "'en' lang", "'web' source", "cast(length(text) as long) n_chars")
    left = corpus_pipeline.drop_near_duplicates(spark, full, "").where("doc_id is null").collect()
    assert sorted(str(r["text"]) for r in left) == sorted(str(t) for t in (texts[-1][1], texts[0][1], None))


def brute_vectors(vs):
    """What link_near_vectors gives, by comparing all pairs of its distinct (vec_id, label, vector) rows."""
    unit = [embdup.unit(v) if i is not None and g is not None else None for i, v, g in vs]
    nodes = sorted({(i, g, tuple(u)) for (i, _, g), u in zip(vs, unit) if u is not None})
    links = {n: {m for m in nodes if m != n and m[1] == n[1] and len(m[2]) == len(n[2]) and np.dot(m[2], n[2]) >= 0.98} for n in nodes}
    out = []
    for (i, _, g), u in zip(vs, unit):
        if u is None:
            out.append((i, 0, i, True))
            continue
        reached, todo = {(i, g, tuple(u))}, [(i, g, tuple(u))]
        while todo:
            for m in links[todo.pop()] - reached:
                reached.add(m)
                todo.append(m)
        low = min(n[0] for n in reached)
        out.append((i, len(links[i, g, tuple(u)]), low, low == i))
    return sorted(out, key=str)


ODD_VECTORS = [(201, None, 0), (202, [0.0] * 8, 0), (203, [float("nan")] * 8, 1), (205, [1.0, None] + [0.0] * 6, 0), (206, [], 1), (207, [float("inf")] + [1.0] * 7, 1), (None, [1.0] * 8, 0), (None, None, None)]


def found_vectors(spark, vs, **settings):
    d = spark.createDataFrame(vs, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 node", "'x' v", "2 component")
    return sorted((tuple(r) for r in embdup.link_near_vectors(d, embdup.Settings(**settings)).collect()), key=str)


@pytest.mark.parametrize("block", [512, 8])
def test_near_vectors_equal_brute_force(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 8))
    vs = [(i, (x[i % 12] + rng.normal(size=8) * (0.05 if i % 3 else 0.3)).tolist(), i % 2) for i in range(150)]
    vs += [(300, vs[0][1], 0), (204, vs[0][1], None), (BIG, vs[5][1], 1), *ODD_VECTORS]
    assert found_vectors(spark, vs, block=block, sample=4) == brute_vectors(vs)


def test_near_vectors_of_any_scale_and_of_repeated_ids(spark):
    one = [float(c) for c in range(1, 9)]
    vs = [(1, one, 0), (2, [c * 1e200 for c in one], 0), (3, [c * 1e-200 for c in one], 0), (4, [-c for c in one], 0), (5, one[:7], 0)]
    vs += [(6, one, 0), (6, one[::-1], 0), (6, one, 1), (7, one[::-1], 0), (6, one, 0), (8, one, 1)]
    got = found_vectors(spark, vs)
    assert got == brute_vectors(vs) and len(got) == len(vs)


def test_near_vectors_in_a_tight_group(spark):
    """Many vectors within the threshold of each other, and pairs at just about the threshold."""
    rng = np.random.default_rng(14)
    base = rng.normal(size=16)
    vs = [(i, (base + rng.normal(size=16) * 0.15).tolist(), 0) for i in range(200)]
    assert found_vectors(spark, vs, block=8, sample=4) == brute_vectors(vs)


def test_near_vectors_where_a_sample_has_one_vector(spark):
    """Nodes that get no net, as only one of their vectors was drawn, or none."""
    rng = np.random.default_rng(24)
    vs = [(i, (rng.normal(size=4) + 3 * (i % 5)).tolist(), i % 7) for i in range(140)]
    assert found_vectors(spark, vs, block=2, sample=1) == brute_vectors(vs)


def test_language(spark):
    rng = np.random.default_rng(6)
    make = {"xx": "abcde", "yy": "cdefg"}
    rows = [(i, " ".join("".join(rng.choice(list(make[g])) for _ in range(5)) for _ in range(40)), g) for i in range(120) for g in [("xx", "yy")[i % 2]]]
    d = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 ...", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(d.where("doc_id % 4 <> 2"))
    got = {r["doc_id"]: r for r in langid.identify(d.drop("lang"), model).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == g for i, _, g in held]) > 0.9
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert langid.fit(d.where("lang = 'none'")) is None


def test_automaton_equals_edit_distance():
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = np.random.default_rng(2)
    terms = ["clown", "pathetic", "idiot", "ass", "worthless"]
    a = toxicity.Automaton(terms)
    for _ in range(400):
        w = list(rng.choice(terms))
        for _ in range(rng.integers(0, 4)):
            k = int(rng.integers(0, len(w) + 1))
            w[k : k + int(rng.integers(0, 2))] = [] if rng.random() < 0.4 else [str(rng.choice(list("abcst")))]
        w = "".join(w)
        near = sorted((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.edits(t))
        assert a.match(w) == ((near[0][1], near[0][0]) if near else None)


def test_toxicity(spark):
    rng = np.random.default_rng(7)
    bad = ["scumbags", "worthless", "stupidity"]
    rows, labels = [], []
    for i in range(200):
        w = words(rng, 30).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w[int(rng.integers(30))] = str(rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    new = [(900, words(rng, 20) + " you worthles scumbagz " + words(rng, 5)), (901, words(rng, 30)), (902, None), (903, "")]
    d = spark.createDataFrame(rows + new, DOCS)
    m = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(d, m).collect()}
    assert all(got[i] == t for i, t in labels)
    assert (got[900], got[901], got[902], got[903]) == (1, 0, 0, 0)
    assert toxicity.fit(d, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None


def test_quotations_are_told_from_abuse(spark):
    rng = np.random.default_rng(17)
    rows, labels = [], []
    for i in range(300):
        told = words(rng, 12) + (" you scumbags" if i % 3 == 1 else " the remark about scumbags was" if i % 6 == 0 else "") + " " + words(rng, 12)
        rows.append((i, told))
        labels.append((i, int(i % 3 == 1)))
    d = spark.createDataFrame(rows, DOCS)
    m = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Settings(least_odds=0.5))
    assert "scumbags" in m.terms and m.context["<remark"] < 0 < m.context["<you"]
    new = [(900, words(rng, 9) + " the remark about scumbags was " + words(rng, 5)), (901, words(rng, 9) + " you scumbags " + words(rng, 5)), (902, 'he said "scumbags" and left ' + words(rng, 5)), (903, "w " * 100_000 + "you scumbags"), (903, "w " * 100_000 + "you scumbags")]
    got = toxicity.score(spark.createDataFrame(new, DOCS).selectExpr("*", "1 predicted", "'x' score"), m).collect()
    assert sorted((r["doc_id"], r["predicted"]) for r in got) == [(900, 0), (901, 1), (902, 0), (903, 1), (903, 1)]


def test_toxic_terms_of_a_small_group(spark):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(1600):
        w = words(rng, 30).split(" ")
        toxic = i % 2
        if toxic:  # 13 of 800 toxic rows are of another language
            w[int(rng.integers(30))] = "canalla" if i % 128 == 1 else "worthless"
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    rows += [(5000 + i, "worthless oddity again") for i in range(80)]
    labels += [(5000 + i, 1) for i in range(80)]
    d = spark.createDataFrame(rows, DOCS)
    m = toxicity.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert "worthless" in m.terms and "canalla" in m.terms and "oddity" not in m.terms
    new = spark.createDataFrame([(9000, words(rng, 20) + " canalla " + words(rng, 5)), (9001, words(rng, 20) + " cannalla"), (9002, words(rng, 30))], DOCS)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(new, m).collect()} == {9000: 1, 9001: 1, 9002: 0}


def test_token_counts(spark):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["a  b", "▁x▁ y", "  ", "", None, " \n x\n\ny ", "\t\tq", "<s> </s> <unk>", "é　ñ 👍🏽x", "a\r\nb", " ", "x ", "\n", "▁", "word " * 3000]
    got = tokens.count_tokens(spark.createDataFrame([(t,) for t in odd], "text string"), path).collect()
    assert [(r["text"], r["n_tokens"]) for r in got] == [(t, len(model.encode(t or ""))) for t in odd]


def test_packing_gives_the_ids_of_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    more = [(300, "a\x85b\x1cc  d  e \t\n<|endoftext|> it's 12é"), (301, "a<|endoftext|>b"), (BIG, "word " * 5000), (None, "no id  <|endoftext|>\n"), (None, None)]
    rows = packing.pack_pieces(packing.cut_pieces(docs.where("doc_id <> 206").union(spark.createDataFrame(more, DOCS)), path)).collect()
    by, places = {}, {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by.setdefault(r["doc_id"], []).append(r)
    for got in places.values():  # gapless from 0, at most 2048 tokens
        got.sort()
        assert [o for o, _ in got] == [sum(n for _, n in got[:k]) for k in range(len(got))] and sum(n for _, n in got) <= 2048
    for i, text in [*texts, *more]:
        if i in (None, 206):
            continue
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["piece"]):
            assert r["start"] == at and zlib.crc32(ids[at : at + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["length"] == 2048 or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    assert sorted(r["length"] for r in by[None]) == sorted(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in more if i is None)


def test_encoder_equals_the_library_on_odd_texts():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    encoder = packing.Encoder(path)
    rng = np.random.default_rng(9)
    pool = [*"  \n\t\r'sdre1!a", "\x85", "\xa0", "\u3000", "\x00", "<|endoftext|>", "<|endof", "text|>", "👍🏽", "é"]
    texts = ["".join(rng.choice(pool, 60)) for _ in range(2000)]
    texts += ["".join(chr(c) for c in rng.integers(1, 0xD7FF, 40)) for _ in range(300)]
    texts += [" " * 1_000_000, "a" + "\n" * 1_200_000 + "b c", "  <|endoftext|>  b", "<|endoftext|><|endoftext|>"]
    for text in texts:
        assert packing.text_ids(text, encoder, {}, 1_000) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_local_search_beats_nothing_and_keeps_pieces():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 70, 60)
        bins = packing.pack(lengths, 100)
        assert sorted(i for b in bins for i in b) == list(range(60))
        assert all(lengths[b].sum() <= 100 for b in bins)
        assert len(bins) <= -(-int(lengths.sum()) // 100) + 2


def test_main_text(spark):
    page = "<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><div class='content'><h1>Head &amp; tail</h1><p>First <b>bold</b>\n para of the text that is long.<p>Second one<br>goes on</div><div class='comments'><p>Nice!</p></div><footer>F</footer></body></html>"
    rows = [(1, "http://a.x/1", page), (2, "http://a.x/2", page), (3, None, None), (4, "http://a.x/3", ""), (5, "bad", "plain words only"), (2, "http://a.x/2", page)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    expected = "Head & tail\n\nFirst bold para of the text that is long.\n\nSecond one goes on"
    assert got[1] == got[2] == (expected, len(expected)) and got[3] == got[4] == ("", 0) and got[5][0] == "plain words only"


def test_main_text_keeps_ids_and_both_joins_agree(spark):
    body = "<article><p title='x'>The text of page {} is long enough to be the main one.</p><section class='related-work'><p>Work of others that matters too.</p></section><div class='related-posts'><p>Other post</p></div></article>"
    rows = [(None if i == 5 else BIG + i, f"http://h{i % 2}.x/{i}", f"<body><div class=ad>Buy</div>{body.format(i)}</body>") for i in range(12)]
    rows.append((7, "http://h0.x/q", '<article><p title="x>Open quote stays out.</p></article>'))
    rows.append((8, "http://h0.x/l", "<article>" + "<p>long page text</p>" * 20_000 + "</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 host", "'x' text", "2 path", "3 salt")
    one = sorted(html.extract(pages).collect(), key=str)
    assert one == sorted(html.extract(pages, few_bytes=0).collect(), key=str)
    got = {r["page_id"]: r["text"] for r in one}
    for i in range(12):
        assert got[None if i == 5 else BIG + i] == f"The text of page {i} is long enough to be the main one.\n\nWork of others that matters too."
    assert got[7] == "Open quote stays out." and got[8].count("long page text") == 20_000


def test_empty_tables(spark, nothing):
    assert suffix.remove_repeats(nothing).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(nothing, items).count() == 0
    assert sharding.assign_shards(nothing).count() == 0
    assert neardup.link_near_duplicates(nothing).count() == 0
    assert embdup.link_near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert langid.identify(nothing, None).count() == 0 and toxicity.score(nothing, None).count() == 0
    assert tokens.count_tokens(nothing, tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert packing.pack_pieces(packing.cut_pieces(nothing, tokenizer_file("byte_bpe_50k.json"))).count() == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_end_to_end(spark, tmp_path):
    """Each stage against brute force over what the one before kept, and the packing of what is left."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = np.random.default_rng(41)
    base = [words(rng, 60) for _ in range(40)]
    shared, item = words(rng, 14), words(rng, 16)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, base[3]), (101, base[4] + " tail"), (102, words(rng, 30) + " " + shared + " " + words(rng, 30)), (103, words(rng, 30) + " " + shared + " " + words(rng, 30))]
    rows += [(104, words(rng, 20) + " " + item + " " + words(rng, 20)), (105, None), (106, ""), (None, words(rng, 25)), (107, "word " * 3000)]
    toxic = [(200 + i, f"{words(rng, 20)} you scumbags {words(rng, 20)}") for i in range(12)]
    d = str(tmp_path)
    spark.createDataFrame(rows + toxic, DOCS).selectExpr("*", "'en' lang", "'web' source", "cast(length(text) as long) n_chars", "1 score", "'x' hits").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, _ in rows if i is not None] + [(i, 1) for i, _ in toxic[:9]], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, at, d).write.parquet(f"{d}/stage{k}")
        at = spark.read.parquet(f"{d}/stage{k}")
        assert at.columns == corpus_pipeline.COLUMNS
        kept.append([(r["doc_id"], r["text"]) for r in at.collect()])
    assert sorted(kept[0], key=str) == sorted(rows, key=str)  # all toxic ones go, whether labelled or not
    alone = {i for i, _, c, stays in brute_components([r for r in kept[0] if r[0] is not None]) if stays}
    assert sorted(kept[1], key=str) == sorted([r for r in kept[0] if r[0] is None or r[0] in alone], key=str)
    cut = {i: digest for i, _, _, _, digest in brute_repeats(kept[1])}
    assert {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in kept[2]} == cut and len(kept[2]) == len(kept[1])
    hit = {i: n for i, _, n, _, _, _ in brute_contamination(kept[2], [("1", item)])}
    assert hit[104] == 16 and {i for i, t in kept[3] if t != dict(kept[2])[i]} == {i for i, n in hit.items() if n}
    assert item not in dict(kept[3])[104]
    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    told = {}
    for r in corpus_pipeline.run(spark, d).collect():
        told[r["doc_id"]] = told.get(r["doc_id"], 0) + r["length"]
    assert told == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in kept[3]}

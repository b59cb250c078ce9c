"""The document net, projected factors, k-means by any distance and heights of trees, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import cluster, docnet, factor


def test_document_net_equals_numpy(spark):
    """In blocks of three: one batch of training, nulls, repeated and empty sets, a document of unknown words."""
    rng = np.random.default_rng(1)
    sets = [[f"w{x}" for x in rng.choice(9, rng.integers(1, 5), replace=False)] for _ in range(14)]
    rows = [(i, s, "abc"[i % 3]) for i, s in enumerate(sets)] + [(20, sets[0][::-1], "b"), (21, [], "a"), (22, None, "c"), (23, ["w1", None, "w1"], "a"), (24, ["w2"], None)]
    entries = spark.createDataFrame(rows, "id long, words array<string>, category string")
    inputs, outputs = docnet.doc_nodes(entries)
    nodes = sorted({tuple(sorted({w for w in r[1] or [] if w})) for r in rows} - {()})
    words, kinds = sorted({w for n in nodes for w in n}), ["a", "b", "c"]
    wi, wo = np.array([[1 / len(n) if w in n else -0.2 for n in nodes] for w in words]), np.full((len(nodes), 3), 0.1)
    linked = np.array([[w in n for n in nodes] for w in words])
    x = lambda ws: np.array([w in set(ws or []) for w in words], float)

    def forward(ws):
        extra = len({w for w in ws or [] if w} - set(words))
        ah = np.tanh(x(ws) @ wi - 0.2 * extra)
        return ah, np.tanh(ah @ wo)

    asked = [(100, ["w1", "w3"]), (101, ["new", "w1"]), (102, ["new"]), (103, []), (104, None)]
    queries = spark.createDataFrame(asked, "query long, words array<string>")
    got = {(r["query"], r["category"]): r["score"] for r in docnet.doc_scores(queries, inputs, outputs, block=3).collect()}
    assert got == pytest.approx({(q, c): forward(ws)[1][k] for q, ws in asked for k, c in enumerate(kinds)})

    di, do, used = np.zeros_like(wi), np.zeros_like(wo), np.zeros(len(words), bool)
    for _, ws, c in rows:
        if c is None:
            continue
        ah, ao = forward(ws)
        od = (np.array([c == k for k in kinds]) - ao) * (1 - ao * ao)
        do += 0.5 * np.outer(ah, od)
        di += 0.5 * np.outer(x(ws), (1 - ah * ah) * (wo @ od))
        used |= x(ws) > 0
    trained = docnet.doc_train(entries, inputs, outputs, 0.5, block=3)
    got_in = {(r["word"], r["hidden"]): r["w"] for r in trained[0].collect()}
    got_out = {(r["hidden"], r["category"]): r["w"] for r in trained[1].collect()}
    names = ["_".join(n) for n in nodes]
    assert got_in == pytest.approx({(w, h): (wi + di)[i, j] for i, w in enumerate(words) for j, h in enumerate(names) if used[i] or linked[i, j]})
    assert got_out == pytest.approx({(h, c): (wo + do)[j, k] for j, h in enumerate(names) for k, c in enumerate(kinds)})
    wi, wo = wi + di, wo + do
    guess = {r["query"]: r["guess"] for r in docnet.doc_guess(docnet.doc_scores(queries, *trained, block=3)).collect()}
    assert guess[100] == kinds[int(forward(["w1", "w3"])[1].argmax())]
    assert docnet.doc_scores(queries.limit(0), inputs, outputs).count() == 0


def plain_least_squares(x, g, gram, tolerance, most=1_000):
    """One problem by the textbook's loop."""
    step = 1.0
    for _ in range(1, most):
        grad = gram @ x - g
        if np.linalg.norm(grad[(grad < 0) | (x > 0)]) < tolerance:
            break
        shorter, last = None, x
        for inner in range(19):
            new = np.maximum(x - step * grad, 0)
            d = new - x
            enough = 0.99 * grad @ d + 0.5 * d @ gram @ d < 0
            shorter = not enough if inner == 0 else shorter
            if shorter:
                if enough:
                    last = new
                    break
                step *= 0.1
            elif not enough or (inner > 0 and (last == new).all()):
                break
            else:
                step, last = step * 10, new
        x = last
    return x


def test_least_squares_of_many_rows_at_once():
    rng = np.random.default_rng(2)
    h = rng.random((30, 4))
    gram, g, x = h.T @ h, rng.normal(size=(50, 4)) * 5, rng.random((50, 4))
    got, rounds = factor.least_squares(x, g, gram, 1e-9)
    assert np.allclose(got, [plain_least_squares(a, b, gram, 1e-9) for a, b in zip(x, g)], atol=1e-8) and rounds.min() > 1
    again, rounds = factor.least_squares(got, g, gram, 1e-9)
    assert (again == got).all() and (rounds == 1).all()


def test_projected_factors_equal_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.random((12, 3)) @ rng.random((3, 9)) * (rng.random((12, 9)) > 0.2), 3)
    w, h = rng.random((12, 3)), rng.random((9, 3))
    cells = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(12) for j in range(9) if v[i, j]], "row long, col long, value double")
    side = lambda m: spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(m)], "key long, f array<double>")
    rows, cols, cost = factor.nmf_projected(cells, 3, rounds=4, start=(side(w), side(h)))
    project = lambda grad, x: np.sqrt((grad[(grad < 0) | (x > 0)] ** 2).sum())
    grads = lambda: (w @ (h.T @ h) - v @ h, h @ (w.T @ w) - v.T @ w)
    first = np.sqrt(sum((g * g).sum() for g in grads()))
    at = [0.001 * first, 0.001 * first]
    for _ in range(4):
        if np.hypot(project(grads()[0], w), project(grads()[1], h)) < 1e-8 * first:
            break
        for s, (a, b, target, n) in enumerate(((w, h, v, 12), (h, w, v.T, 9))):
            b = h if s == 0 else w
            gram, g, limit = b.T @ b, target @ b, at[s] / np.sqrt(n)
            start = w if s == 0 else h
            stood = all(np.linalg.norm((gram @ x - y)[((gram @ x - y) < 0) | (x > 0)]) < limit for x, y in zip(start, g))
            new = np.array([plain_least_squares(x, y, gram, limit) for x, y in zip(start, g)])
            w, h = (new, h) if s == 0 else (w, new)
            at[s] *= 0.1 if stood else 1
    assert np.allclose([r["f"] for r in rows.orderBy("key").collect()], w, atol=1e-6) and np.allclose([r["f"] for r in cols.orderBy("key").collect()], h, atol=1e-6)
    assert cost == pytest.approx(((v - w @ h.T) ** 2).sum(), abs=1e-6)
    assert factor.nmf_projected(cells.limit(0), 3)[2] == 0


@pytest.mark.parametrize("name", ["squares", *cluster.DISTANCES])
def test_nearest_centroids_by_each_distance(spark, name):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.integers(0, 4, (60, 5)), np.zeros((1, 5)), np.full((1, 5), 2)]).astype(float)
    c = [(i, [float(v) for v in r]) for i, r in enumerate(np.vstack([rng.integers(0, 4, (4, 5)), np.zeros((1, 5))]))]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")
    at = spark.createDataFrame(c, "cluster long, c array<double>")
    d = F.col("d") if name != "squares" else F.pow("d", F.lit(2))
    pairs = rows.crossJoin(at).withColumn("d", cluster.DISTANCES["straight" if name == "squares" else name](F.col("features"), F.col("c"))).withColumn("d", d)
    expected = pairs.groupBy("id").agg(F.min(F.struct(F.round("d", 12).alias("d"), "cluster")).alias("m")).select("id", "m.cluster", "m.d")
    got = {r["id"]: (r["cluster"], r["d2"]) for r in cluster.assign(rows, c, name).collect()}
    for r in expected.collect():
        assert got[r["id"]][1] == pytest.approx(r["d"], abs=1e-9)
        near = {p["cluster"] for p in pairs.where(F.col("id") == r["id"]).collect() if abs(p["d"] - r["d"]) < 1e-9} if got[r["id"]][0] != r["cluster"] else {r["cluster"]}
        assert got[r["id"]][0] in near


def test_random_starts_lie_in_the_ranges(spark):
    rows = spark.createDataFrame([(i, [float(i), -2.0, float(i % 3)]) for i in range(30)], "id long, features array<double>")
    c = np.array([x for _, x in cluster.random_centroids(rows, 50)])
    assert (c.min(axis=0) >= [0, -2, 0]).all() and (c.max(axis=0) <= [29, -2, 2]).all() and len(np.unique(c[:, 0])) == 50
    placed, centroids = cluster.kmeans(rows, 3, seed=2)
    assert placed.count() == 30 and len(centroids) == 3
    with pytest.raises(ValueError):
        cluster.assign(rows, centroids, "chebyshev")


def test_heights_and_depths(spark):
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=2)]) for i in range(9)], "id long, features array<double>")
    merges = cluster.hcluster(vectors, "straight", all_nearest=True)
    rows = {r["id"]: r for r in merges.collect()}
    height = lambda i: 1 if i >= 0 else height(rows[i]["left"]) + height(rows[i]["right"])
    depth = lambda i: 0.0 if i >= 0 else max(depth(rows[i]["left"]), depth(rows[i]["right"])) + rows[i]["distance"]
    got = {r["id"]: (r["height"], r["depth"]) for r in cluster.heights(merges).collect()}
    assert {i: g[0] for i, g in got.items()} == {i: height(i) for i in rows} and got[-8][0] == 9
    assert {i: g[1] for i, g in got.items()} == pytest.approx({i: depth(i) for i in rows})
    assert cluster.heights(merges.limit(0)).count() == 0


def test_heights_of_long_chains_and_beyond_a_million_ways(spark):
    n = 1_500  # a chain has 1,125,750 ways down
    chain = spark.range(1, n + 1).select((-F.col("id")).alias("id"), F.when(F.col("id") < n, -F.col("id") - 1).otherwise(0).alias("left"), F.col("id").alias("right"), F.lit(0.5).alias("distance"))
    got = cluster.heights(chain).toPandas().set_index("id")
    assert len(got) == n
    for k in (1, 2, 700, 1_499, 1_500):
        assert tuple(got.loc[-k]) == (n - k + 2, 0.5 * (n - k + 1))
    loop = chain.limit(0).union(spark.createDataFrame([(-1, -2, 3, 0.5), (-2, -1, 4, 0.5)], chain.schema))
    with pytest.raises(ValueError):
        cluster.heights(loop)

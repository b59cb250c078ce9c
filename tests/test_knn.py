"""The neighbour join by pivots, cross-validation and scales against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn


def brute(x, q, k, seen=lambda i, j: True, w=None):
    out = []
    for i in range(len(q)):
        scale = np.ones(x.shape[1]) if w is None else w[i]
        d = np.round(np.sqrt((((x - q[i]) * scale) ** 2).sum(axis=1)), 9)
        ranked = sorted((j for j in range(len(x)) if seen(i, j)), key=lambda j: (d[j], j))
        out += [(i, j, d[j], r + 1) for r, j in enumerate(ranked[:k])]
    return out


def same(got, expected):
    got = sorted(map(tuple, got))
    assert [(a[0], a[-3], a[-1]) for a in got] == [(a[0], a[1], a[3]) for a in sorted(expected)]
    assert np.allclose([a[-2] for a in got], [a[2] for a in sorted(expected)], atol=1e-9)


@pytest.mark.parametrize("cell_rows", [40, 10_000])
@pytest.mark.parametrize("scaled", [False, True])
def test_join_equals_brute_force(spark, cell_rows, scaled):
    """Rounded places give many ties; some rows are hidden from some queries; some scales are 0."""
    rng = np.random.default_rng(3)
    x, q = np.round(rng.normal(size=(900, 3)), 1), np.round(rng.normal(size=(120, 3)), 1)
    w = rng.integers(0, 3, size=q.shape).astype(float)
    data = spark.createDataFrame([(i, [float(v) for v in r], [i % 4, 9]) for i, r in enumerate(x)], "id long, features array<double>, held array<int>")
    asked = spark.createDataFrame([(i, i % 5, [float(v) for v in r], [float(v) for v in s]) for i, (r, s) in enumerate(zip(q, w))], "query long, grp int, features array<double>, weights array<double>")
    got = knn.nearest(asked if scaled else asked.drop("weights"), data, 5, cell_rows=cell_rows).collect()
    same(got, brute(x, q, 5, lambda i, j: j % 4 != i % 5, w if scaled else None))


def test_rows_that_are_all_alike_are_split(spark, monkeypatch):
    """One cell of equal rows: its blocks are bounded, and ties go to the smallest ids."""
    monkeypatch.setattr(knn, "SIDE_VALUES", 600)
    data = spark.range(1_000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("features"), F.lit("x").alias("cell"))
    got = knn.nearest(data.select(F.col("id").alias("query"), "features"), data, 3).groupBy("query").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    assert got.count() == 1_000 and {tuple(r["ids"]) for r in got.collect()} == {(0, 1, 2)}


def test_many_queries_and_a_plan_that_does_not_grow(spark):
    def join(n):
        rows = spark.range(n).select("id", F.array((F.col("id") % 311).cast("double"), (F.col("id") % 97).cast("double")).alias("features"))
        return knn.nearest(rows.select(F.col("id").alias("query"), "features"), rows, 2)

    large, small = join(50_000), join(5_000)
    assert large.count() == 100_000 and large.where("rank = 1 and dist = 0").count() == 50_000
    lines = [len(d._jdf.queryExecution().optimizedPlan().toString().splitlines()) for d in (large, small)]
    assert lines[0] == lines[1]


def test_nulls_and_small_tables(spark):
    rows = [(1, [0.0]), (2, None), (3, [None]), (4, [float("nan")]), (5, [float("inf")]), (None, [1.0]), (6, [3.0])]
    data = spark.createDataFrame(rows, "id long, features array<double>")
    asked = spark.createDataFrame([(1, [2.0]), (2, None), (3, [1.0, 2.0])], "query long, features array<double>")
    assert [tuple(r) for r in knn.nearest(asked, data, 5).orderBy("rank").collect()] == [(1, 6, 1.0, 1), (1, 1, 2.0, 2)]
    assert knn.nearest(asked, data.limit(0), 5).count() == 0 and knn.nearest(asked.limit(0), data, 5).count() == 0


def share(i, t):
    return int(hashlib.md5(f"{i}:{t}".encode()).hexdigest()[:8], 16) / 4294967296.0


def test_trials_and_scales(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, (150, 2)).astype(float), rng.normal(size=150)
    data = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(150)], "id long, features array<double>, result double")

    def error(scale, t, held):
        off = [np.mean([y[j] for _, j, _, _ in brute(x, x[[i]], 3, lambda _, j: j not in held, np.array([scale]))]) - y[i] for i in held]
        return np.array(off) ** 2

    tests = {t: [i for i in range(150) if share(i, t) < 0.1] for t in range(6)}
    got = {r["fold"]: r["mse"] for r in knn.cross_validate(data, knn.random_split(6, 0.1), knn.knn_estimator(3)).collect()}
    assert got == pytest.approx({t: error([1, 1], t, held).mean() for t, held in tests.items() if held})
    got = {r["fold"]: r["mse"] for r in knn.cross_validate(data, knn.hold_out(4, 7), knn.mean_estimator).collect()}
    for t in range(4):
        held = sorted(range(150), key=lambda i: (share(i, t), i))[:7]
        rest = np.mean([y[i] for i in range(150) if i not in held])
        assert got[t] == pytest.approx(np.mean((rest - y[held]) ** 2))
    candidates = spark.createDataFrame([(1, [1, 1]), (2, [0, 3])], "cand_id long, genes array<int>")
    got = {r["cand_id"]: r["cost"] for r in knn.tune_scales(data, candidates, knn.random_split(6, 0.1)).collect()}
    assert got == pytest.approx({c: np.concatenate([error(w, t, held) for t, held in tests.items()]).mean() for c, w in ((1, [1, 1]), (2, [0, 3]))})


def test_of_equal_vectors_few_are_needed(spark, monkeypatch):
    """Whatever number is held, the k nearest are those of all rows; equal vectors that are held out together are one test."""
    monkeypatch.setattr(knn, "EQUAL_VALUES", 300)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.integers(0, 4, 2)], sorted({int(g) for g in rng.choice(30, rng.integers(0, 6))}), float(rng.integers(0, 50))) for i in rng.permutation(900)]
    rows += [(1_000, None, [], 1.0), (1_001, [float("nan"), 1.0], [], 1.0), (1_002, [9.0, 9.0], None, None)]
    data = spark.createDataFrame(rows, "id long, features array<double>, held array<int>, result double")
    few = {r["id"]: r for r in knn.needed(data, 3).collect()}
    assert len(few) < 250
    good = [r for r in rows if r[1] is not None and r[1] == r[1] and r[1][0] == r[1][0]]
    for g in range(-1, 30):
        for x in {tuple(r[1]) for r in good}:
            near = sorted((r[0] for r in good if tuple(r[1]) == x and g not in (r[2] or [])))[:3]
            assert set(near) <= set(few)
    tests = knn._tests(data).collect()
    assert len(tests) == len({(tuple(r[1]), g) for r in rows if r[1] is not None for g in r[2] or []})
    alone = lambda rows: rows.withColumn("held", F.array((F.col("id") % 4).cast("int")))
    got = {r["fold"]: r["mse"] for r in knn.cross_validate(data.drop("held").where("id < 900"), alone, 3).collect()}
    for fold in range(4):
        off = []
        for i, x, _, y in good[:900]:
            if i % 4 == fold:
                near = sorted((round(float(np.hypot(x[0] - r[1][0], x[1] - r[1][1])), 9), r[0], r[3]) for r in good[:900] if r[0] % 4 != fold)[:3]
                off.append((np.mean([n[2] for n in near]) - y) ** 2)
        assert got[fold] == pytest.approx(np.mean(off))

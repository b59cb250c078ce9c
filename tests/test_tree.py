"""Splits, trees and their use against brute force on small tables."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import tree as T


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        a, b, w = int(rng.integers(12)), float(rng.integers(5)), "xyz"[rng.integers(3)]
        y = float(a > 6) * 3 + (w == "x") + float(rng.normal()) * 0.3
        rows.append((i, None if i % 11 == 0 else float(a), b, None if i % 17 == 0 else w, y, "high" if y > 2 else "mid" if y > 0.5 else None if i % 5 == 0 else "low"))
    return rows, spark.createDataFrame(rows, "id long, col double, num double, word string, value double, label string")


def impurity(kind, ys):
    if kind == "variance":
        return float(np.var(ys))
    p = np.array(list(Counter(ys).values())) / len(ys)
    return float(1 - (p * p).sum()) if kind == "gini" else float(-(p * np.log2(p)).sum())


def brute_gains(rows, kind, label):
    out = {}
    for col, at in (("col", 1), ("num", 2), ("word", 3)):
        for v in {r[at] for r in rows} - {None}:
            passed = [r[at] >= v if col != "word" else r[at] == v for r in rows if r[at] is not None]
            known = [r[label] for r in rows if r[at] is not None]
            nulls = [r[label] for r in rows if r[at] is None]
            yes, no = [y for y, p in zip(known, passed) if p] + nulls, [y for y, p in zip(known, passed) if not p] + nulls
            if yes and no:
                p = len(yes) / len(rows)
                out[col, v] = impurity(kind, [r[label] for r in rows]) - p * impurity(kind, yes) - (1 - p) * impurity(kind, no)
    return out


@pytest.mark.parametrize("kind, label", [("entropy", "label"), ("gini", "label"), ("variance", "value")])
@pytest.mark.parametrize("buckets", [3, 256])
def test_gains_equal_brute_force(table, kind, label, buckets):
    """Columns that are named like those of a tree, nulls in values and labels, more values than ranges."""
    rows, df = table
    cells = T.long_rows(df, ["col", "num"], ["word"], label)
    got = T.split_gains(cells, df.select("id", F.lit(1).cast("long").alias("node")), kind, buckets).collect()
    expected = brute_gains(rows, kind, 4 if label == "value" else 5)
    assert {(r["col"], r["num"] if r["word"] is None else r["word"]) for r in got} == set(expected)
    for r in got:
        assert r["gain"] == pytest.approx(expected[r["col"], r["num"] if r["word"] is None else r["word"]], abs=1e-9)


def test_regression_tree_and_ranges(table, spark):
    rows, df = table
    nodes = T.grow_tree(df, ["col", "num"], ["word"], "value", depth=2, scoref="variance")
    best = max(brute_gains(rows, "variance", 4).items(), key=lambda x: x[1])
    root = nodes.where("node = 1").first()
    assert root["col"] == best[0][0] == "col" and root["num"] == best[0][1] and root["counts"] is None and root["n"] == 240
    assert root["mean"] == pytest.approx(np.mean([r[4] for r in rows]))
    guess = {r["id"]: r["guess"] for r in T.tree_estimate(df, nodes, ["col", "num"], ["word"]).collect()}
    assert len(guess) == 240 and np.mean([(guess[r[0]] - r[4]) ** 2 for r in rows]) < 0.6 * np.var([r[4] for r in rows])
    # ranges: of one point, over the test, the wrong way round, of a null
    t = root["num"]
    some = spark.createDataFrame([(1, (t, t), 1.0, "x"), (2, (t - 1, t + 1), 1.0, "x"), (3, (t + 1, t - 1), 1.0, "x"), (4, (None, t), 1.0, "x"), (5, (t - 1, t - 1), 1.0, "x")], "id long, col struct<lo:double,hi:double>, num double, word string")
    got = {r["id"]: r["guess"] for r in T.tree_estimate(some, nodes, ["col", "num"], ["word"]).collect()}
    assert got[2] == got[3] == got[4] and min(got[1], got[5]) < got[2] < max(got[1], got[5])
    classes = T.grow_tree(df, ["col", "num"], ["word"], "label", depth=2, scoref="gini")
    shares = T.tree_classify(some, classes, ["col", "num"], ["word"]).groupBy("id").agg(F.sum("share").alias("s")).collect()
    assert len(shares) == 5 and all(r["s"] == pytest.approx(1) for r in shares)


def test_score_of_the_root_alone(table):
    _, df = table
    root = T.grow_tree(df, ["col", "num"], ["word"], "label", depth=2, scoref="gini", pass_score=False).where("node = 1").first()
    below = T.grow_tree(df, ["col", "num"], ["word"], "label", depth=1).where("node = 1").first()
    gini = T.grow_tree(df, ["col", "num"], ["word"], "label", depth=1, scoref="gini").where("node = 1").first()
    assert root["gain"] == pytest.approx(gini["gain"]) and root["gain"] != pytest.approx(below["gain"])
    with pytest.raises(ValueError):
        T.grow_tree(df, ["col"], [], "label", depth=13)


def test_no_rows_and_one_label(spark, table):
    _, df = table
    assert T.grow_tree(df.limit(0), ["col"], ["word"], "label").count() == 0
    only = T.grow_tree(df.withColumn("label", F.lit("one")), ["col"], ["word"], "label").collect()
    assert len(only) == 1 and only[0]["col"] is None and only[0]["counts"] == {"one": 240}


@pytest.mark.parametrize("kind", ["entropy", "gini"])
@pytest.mark.parametrize("cuts", [1, 2, 3])
def test_sets_of_thresholds_equal_brute_force(table, kind, cuts):
    rows, df = table
    cells = T.long_rows(df, ["col", "num"], ["word"], "label").withColumn("node", F.lit("r"))
    got = {r["col"]: r for r in T.multiway_best(cells, cuts, kind).collect()}
    for col, at in (("col", 1), ("num", 2), ("word", 3)):
        values = sorted({r[at] for r in rows} - {None})

        def gain(chosen):
            groups = {}
            for r in rows:
                inside = [v for v in chosen if r[at] is not None and (r[at] >= v if col != "word" else r[at] == v)]
                groups.setdefault(max(inside, default=None), []).append(r[5])
            return impurity(kind, [r[5] for r in rows]) - sum(len(g) / len(rows) * impurity(kind, g) for g in groups.values())

        sets = [c for k in range(1, cuts + 1) for c in itertools.combinations(values, k)]
        assert got[col]["gain"] == pytest.approx(max(map(gain, sets)), abs=1e-9)
        assert gain(got[col]["nums"] if col != "word" else got[col]["words"]) == pytest.approx(got[col]["gain"], abs=1e-9)


def test_many_words_take_the_best_one_next():
    counts = np.eye(6)[np.arange(40) % 6] * 5 + 1
    spent, chosen = T._cut_words(counts.sum(axis=1), counts, np.zeros(6), T._label_cost("entropy"), 4, sets=100)
    assert len(chosen) == 4 and spent < float(T._label_cost("entropy")(counts.sum(keepdims=True)[0], counts.sum(axis=0)[None])[0])
    assert math.isfinite(spent)

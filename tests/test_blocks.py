"""Block products of ratings against brute force, with blocks of few entries and few pairs at once."""

import numpy as np
import pytest

from tessera.operators import blocks
from tessera.operators import ratings as R


@pytest.fixture
def rows(spark, monkeypatch):
    for name, value in (("ENTRIES", 90), ("PAIRS", 50), ("IN_A_ROW", 2)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(5)
    told = {(int(u), int(i)): float(r) for u, i, r in zip(rng.integers(0, 40, 500), rng.integers(-20, 30, 500), rng.integers(0, 4, 500))}
    told |= {(u, 99): 1.0 for u in range(40)}  # an item that all have
    return told, spark.createDataFrame([(u, i, r) for (u, i), r in told.items()], "user long, item long, rating double")


def shared(told, a, b, side):
    by = {}
    for k, r in told.items():
        by.setdefault(k[side], {})[k[1 - side]] = r
    return [(by[a][k], by[b][k]) for k in by[a] if k in by[b]]


def test_pairs_of_users(rows):
    told, df = rows
    users = sorted({u for u, _ in told})
    n = {u: sum(k[0] == u for k in told) for u in users}
    both = {(a, b): s for a in users for b in users if a < b and (s := shared(told, a, b, 0))}
    for kind in ("distance", "pearson", "tanimoto"):
        got = {(r["u1"], r["u2"]): r["sim"] for r in R.similarities(df, kind).collect()}
        assert set(got) == set(both)
        for (a, b), s in both.items():
            x, y = np.array(s).T
            if kind == "pearson":
                want = np.corrcoef(x, y)[0, 1] if x.std() > 1e-6 and y.std() > 1e-6 else 0.0
            else:
                want = 1 / (1 + ((x - y) ** 2).sum()) if kind == "distance" else len(s) / (n[a] + n[b] - len(s))
            assert got[a, b] == pytest.approx(want, abs=1e-9)


def test_nearest_items_and_what_follows(rows):
    told, df = rows
    items, users = sorted({i for _, i in told}), sorted({u for u, _ in told})
    near = {}
    for a in items:
        sims = [(np.floor(1e6 / (1 + sum((x - y) ** 2 for x, y in s)) + 0.5) / 1e6, b) for b in items if b != a and (s := shared(told, a, b, 1))]
        near[a] = [(b, s) for s, b in sorted(sims, reverse=True)[:4]]
    found = R.similar_items(df, 4)
    got = {}
    for r in found.orderBy("item", "rank").collect():
        got.setdefault(r["item"], []).append((r["other"], r["sim"]))
    assert got == near
    best = {}
    for r in R.item_recommendations(df, found, 3).orderBy("user", "rank").collect():
        best.setdefault(r["user"], []).append((r["item"], r["score"]))
    for u in users:
        sums = {}
        for (v, i), r in told.items():
            for b, s in near[i] if v == u else ():
                sums.setdefault(b, []).append((s, s * r))
        want = sorted(((round(sum(p for _, p in c) / sum(s for s, _ in c), 6), b) for b, c in sums.items() if (u, b) not in told), reverse=True)[:3]
        assert best.get(u, []) == [(b, pytest.approx(s, abs=2e-6)) for s, b in want]


def test_recommendations_of_persons(rows, spark):
    told, df = rows
    users, items = sorted({u for u, _ in told}), sorted({i for _, i in told})
    persons = [0, 7, 33]
    got = {(r["user"], r["item"]): r["score"] for r in R.user_recommendations(df, spark.createDataFrame([(p,) for p in persons], "user long"), "distance").collect()}
    want = {}
    for p in persons:
        sim = {o: 1 / (1 + sum((x - y) ** 2 for x, y in shared(told, p, o, 0))) for o in users if o != p}
        for i in items:
            c = [(sim[o], told[o, i]) for o in sim if (o, i) in told]
            if c and not told.get((p, i)):
                want[p, i] = sum(s * r for s, r in c) / sum(s for s, _ in c)
    assert got == pytest.approx(want)


def test_no_pair_is_shuffled(rows):
    """Plans have no exchange above the join of the blocks but that of the best few."""
    _, df = rows
    plan = R.similarities(df, "distance")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan.split("CartesianProduct")[0]

"""Non-negative matrix factorization of long cells(row, col, value), and what stands out in its factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.shared import save as _durable

EPS = 1e-26


def matrix_cost(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (cost): sum of squared differences of two long matrices, an absent cell is 0."""
    both = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), ["row", "col"], "full")
    d = F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0))
    return both.agg(F.sum(d * d).alias("cost"))


def start_factors(cells: DataFrame, k: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(key, f array<double>) of rows and of columns, uniform at random by a hash of the key."""

    def side(name: str) -> DataFrame:
        u = [F.pmod(F.xxhash64(F.col(name).cast("string"), F.lit(i), F.lit(seed), F.lit(name)), F.lit(1_000_003)) / 1_000_003.0 + 1e-6 for i in range(k)]
        return cells.select(name).distinct().select(F.col(name).alias("key"), F.array(*u).alias("f"))

    return side("row"), side("col")


def _gram(side: DataFrame, k: int) -> np.ndarray:
    """Sum of outer products of the factors: k x k numbers, added per batch before they are sent."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for b in batches:
            if len(b):
                x = np.stack(b["f"].to_list()).astype(float)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(k * k), "v": total.reshape(-1)})

    rows = side.select("f").mapInPandas(f, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in rows]).reshape(k, k) if rows else np.zeros((k, k))


def _weighted(cells: DataFrame, by: str, other: DataFrame, k: int) -> DataFrame:
    """(key, g array<double>): for each row (or column) the sum of its cells times the other side's factors."""
    opposite = "col" if by == "row" else "row"
    joined = cells.join(other.withColumnRenamed("key", opposite), opposite)
    return joined.groupBy(F.col(by).alias("key")).agg(F.array(*[F.sum(F.col("value") * F.col("f")[i]) for i in range(k)]).alias("g"))


def _update(side: DataFrame, top: DataFrame, gram: np.ndarray, k: int) -> DataFrame:
    """f * g / (f Gram) of each key."""
    below = lambda i: F.aggregate(F.zip_with("f", F.array(*[F.lit(float(x)) for x in gram[:, i]]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    joined = side.join(top, "key", "left")
    return joined.select("key", F.array(*[F.col("f")[i] * F.coalesce(F.col("g")[i], F.lit(0.0)) / (below(i) + EPS) for i in range(k)]).alias("f"))


def nmf_step(cells: DataFrame, rows: DataFrame, cols: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One multiplicative update of the column factors and then of the row factors."""
    cols = _update(cols, _weighted(cells, "col", rows, k), _gram(rows, k), k)
    cols = _durable(cols)
    rows = _durable(_update(rows, _weighted(cells, "row", cols, k), _gram(cols, k), k))
    return rows, cols


def nmf_cost(cells: DataFrame, rows: DataFrame, cols: DataFrame, k: int) -> float:
    """Squared error without the dense product: sum V^2 - 2 sum V.WH + trace(W'W HH')."""
    a = cells.join(rows.select(F.col("key").alias("row"), F.col("f").alias("fr")), "row").join(cols.select(F.col("key").alias("col"), F.col("f").alias("fc")), "col")
    cross = F.aggregate(F.zip_with("fr", "fc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    r = a.agg(F.sum(F.col("value") * F.col("value")).alias("vv"), F.sum(F.col("value") * cross).alias("vw")).first()
    return max(0.0, (r["vv"] or 0.0) - 2 * (r["vw"] or 0.0) + float((_gram(rows, k) * _gram(cols, k).T).sum()))


def nmf(cells: DataFrame, k: int = 10, rounds: int = 50, seed: int = 1, start: tuple | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Row and column factors and the cost, until the cost is 0 or falls by less than 1 %."""
    rows, cols = start or start_factors(cells, k, seed)
    cost = nmf_cost(cells, rows, cols, k)
    for _ in range(rounds):
        rows, cols = nmf_step(cells, rows, cols, k)
        now = nmf_cost(cells, rows, cols, k)
        if now == 0 or 99 * cost < 100 * now:
            return rows, cols, now
        cost = now
    return rows, cols, cost


def least_squares(x: np.ndarray, g: np.ndarray, gram: np.ndarray, tolerance: float, most: int = 1_000) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative x, a row each, with the least x gram x' / 2 - g x', by projected gradient, and how many rounds each row
    took (1: it stood at its solution). All rows at once: each has a step of its own, which is searched by Armijo's rule,
    shortened until it lowers the cost enough or lengthened while it does. A row ends when the norm of its projected
    gradient is below the tolerance."""
    x, step, rounds = x.copy(), np.ones(len(x)), np.ones(len(x), np.int64)
    live = np.arange(len(x))
    for turn in range(1, most):
        grad = x[live] @ gram - g[live]
        norm = np.sqrt((np.where((grad < 0) | (x[live] > 0), grad, 0) ** 2).sum(axis=1))
        going = norm >= tolerance
        rounds[live] = turn
        live, grad = live[going], grad[going]
        if not len(live):
            break
        at, best = np.arange(len(live)), x[live].copy()
        shorter = np.zeros(len(live), bool)
        for inner in range(19):
            if not len(at):
                break
            now = x[live[at]]
            new = np.maximum(now - step[live[at], None] * grad[at], 0)
            d = new - now
            enough = 0.99 * (grad[at] * d).sum(axis=1) + 0.5 * ((d @ gram) * d).sum(axis=1) < 0
            if inner == 0:
                shorter[at] = ~enough
            down = shorter[at]
            done_down, stop_up = down & enough, ~down & (~enough | (inner > 0) & (best[at] == new).all(axis=1))
            best[at[done_down]] = new[done_down]
            longer = ~down & ~stop_up
            best[at[longer]] = new[longer]
            step[live[at[down & ~enough]]] *= 0.1
            step[live[at[longer]]] *= 10
            at = at[(down & ~enough) | longer]
        x[live] = best
    return x, rounds


def _solved(cells: DataFrame, side: DataFrame, by: str, other: DataFrame, k: int, tolerance: float) -> DataFrame:
    """(key, f, took): one side solved against the other, a map over its keys."""
    gram, kind = _gram(other, k), dict(side.dtypes)["key"]

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                g = np.stack([np.zeros(k) if v is None else np.asarray(v, float) for v in b["g"]])
                x, rounds = least_squares(np.stack(b["f"].to_list()).astype(float), g, gram, tolerance)
                yield pd.DataFrame({"key": b["key"], "f": list(x), "took": rounds})

    return _durable(side.select("key", "f").join(_weighted(cells, by, other, k), "key", "left").mapInPandas(f, f"key {kind}, f array<double>, took long"))


def _gradient(cells: DataFrame, side: DataFrame, by: str, other: DataFrame, k: int, projected: bool = True) -> float:
    """Sum of the squares of one side's gradient, or of its projection on what may still move."""
    gram = _gram(other, k)
    below = lambda i: F.aggregate(F.zip_with("f", F.array(*[F.lit(float(v)) for v in gram[:, i]]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    rows = side.select("key", "f").join(_weighted(cells, by, other, k), "key", "left")
    grads = [below(i) - F.coalesce(F.col("g")[i], F.lit(0.0)) for i in range(k)]
    parts = [F.when((d < 0) | (F.col("f")[i] > 0) | F.lit(not projected), d * d).otherwise(0.0) for i, d in enumerate(grads)]
    return rows.agg(F.sum(sum(parts[1:], parts[0]))).first()[0] or 0.0


def nmf_projected(cells: DataFrame, k: int = 10, rounds: int = 5, seed: int = 1, tolerance: float = 1e-8, start: tuple | None = None) -> tuple[DataFrame, DataFrame, float]:
    """Alternating non-negative least squares by projected gradient. Each key's problem stands alone once the k x k
    Gram of the other side is known, so a half-step is one map over the keys.

    Half-steps end at 0.001 of the first gradient's norm; a side that stands there already has its tolerance cut to a
    tenth. All ends when the projected gradient of both sides is below `tolerance` times the first norm, or after
    `rounds`. start gives both sides' factors (key, f). No cells give no factors."""
    rows, cols = start or start_factors(cells, k, seed)
    n_rows, n_cols = rows.count(), cols.count()
    if not n_rows or not n_cols:
        return rows, cols, 0.0
    first = float(np.sqrt(_gradient(cells, rows, "row", cols, k, False) + _gradient(cells, cols, "col", rows, k, False)))
    at_rows = at_cols = max(0.001, tolerance) * first
    for _ in range(rounds):
        left = _gradient(cells, rows, "row", cols, k) + _gradient(cells, cols, "col", rows, k)
        if np.sqrt(left) < tolerance * first:
            break
        rows = _solved(cells, rows, "row", cols, k, at_rows / np.sqrt(n_rows))
        at_rows *= 0.1 if rows.agg(F.max("took")).first()[0] == 1 else 1.0
        cols = _solved(cells, cols, "col", rows, k, at_cols / np.sqrt(n_cols))
        at_cols *= 0.1 if cols.agg(F.max("took")).first()[0] == 1 else 1.0
    rows, cols = rows.select("key", "f"), cols.select("key", "f")
    return rows, cols, nmf_cost(cells, rows, cols, k)


def heaviest(side: DataFrame, n: int, by_feature: bool = True) -> DataFrame:
    """The n heaviest keys of each feature, or the n heaviest features of each key: (feature, key, weight, k)."""
    long = side.select("key", F.posexplode("f").alias("feature", "weight"))
    one, two = ("feature", "key") if by_feature else ("key", "feature")
    order = Window.partitionBy(one).orderBy(F.desc(F.round("weight", 6)), F.desc(two))
    return long.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)


def aligned_series(volumes: DataFrame, tickers: list[str]) -> DataFrame:
    """volumes(ticker, date, volume) as one row a place and a column a ticker, cut to the shortest series."""
    numbered = volumes.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    least = volumes.where(F.col("ticker").isin(tickers)).groupBy("ticker").agg(F.count("*").alias("n")).agg(F.min("n").alias("least"))
    return numbered.join(F.broadcast(least)).where("k <= least").groupBy("k").pivot("ticker", tickers).agg(F.first("volume"))

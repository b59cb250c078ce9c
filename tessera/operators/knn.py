"""Nearest neighbours, their estimates, cross-validation and the tuning of scales."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import WEIGHTS
from tessera.shared import Scratch, save

#: Rows of a cell, as far as the number of pivots allows; most pivots, whose vectors and boxes every task gets; values
#: of vectors on one side of a task, and of a block of distances.
CELL_ROWS, MOST_PIVOTS, SIDE_VALUES, BLOCK_VALUES = 2_000, 1_024, 2_000_000, 2_000_000
#: Values of vectors that a task holds while it looks for equal ones.
EQUAL_VALUES = 400_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of a column, one a row; rows and parts are not null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class _Cells:
    """What every task knows of the cells: pivots, sizes, boxes and radii."""

    def __init__(self, pivots: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, radius: np.ndarray):
        self.pivots, self.size, self.low, self.high, self.radius = pivots, size, low, high, radius

    def near(self, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Distance of each query to each pivot, by the query's scales."""
        return np.stack([np.sqrt((((p - q) * w) ** 2).sum(axis=1)) for p in self.pivots], axis=1)

    def least(self, q: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What no row of a cell is nearer than: by its box, and by its radius for the smallest scale."""
        box = np.stack([np.sqrt(((np.maximum(0, np.maximum(lo - q, q - hi)) * w) ** 2).sum(axis=1)) for lo, hi in zip(self.low, self.high)], axis=1)
        plain = self.near(q, np.ones_like(w)) - self.radius
        return np.maximum(box, np.maximum(plain, 0) * np.abs(w).min(axis=1)[:, None])


def _best(q: np.ndarray, w: np.ndarray, grp: np.ndarray, x: np.ndarray, ids: np.ndarray, held: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of the k nearest rows of a block, by distance to 9 digits, then id. Squared distances
    come from one matrix product; rows close to the k-th are measured again as they stand."""
    out = []
    dims = max(1, x.shape[1])
    square, rows = x * x, max(1, BLOCK_VALUES // max(1, len(x)))
    closed = {}
    for i, h in enumerate(held):
        for g in h or ():
            closed.setdefault(g, []).append(i)
    for at in range(0, len(q), rows):
        qs, ws, gs = q[at : at + rows], w[at : at + rows] ** 2, grp[at : at + rows]
        qq, xx = (qs * qs * ws).sum(axis=1), ws @ square.T
        d2 = qq[:, None] + xx - 2 * (qs * ws) @ x.T
        slack = 1e-8 * (1 + qq + xx.max(axis=1))
        for g in set(gs.tolist()) & set(closed):
            d2[np.ix_(np.flatnonzero(gs == g), closed[g])] = np.inf
        limit = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(qs), np.inf)
        i, j = np.nonzero((d2 <= (limit + slack)[:, None]) & np.isfinite(d2))
        d = np.empty(len(i))
        for a in range(0, len(i), max(1, BLOCK_VALUES // dims)):
            b = a + max(1, BLOCK_VALUES // dims)
            d[a:b] = np.sqrt((((x[j[a:b]] - qs[i[a:b]]) ** 2) * ws[i[a:b]]).sum(axis=1))
        d = np.round(d, 9)
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.searchsorted(i, np.arange(len(qs)))
        keep = np.arange(len(i)) - first[i] < k
        out.append((i[keep] + at, j[keep], d[keep]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def _meet(routed: DataFrame, cells: DataFrame, blocks: DataFrame, k: int, most: int) -> DataFrame:
    """(query, grp, id, dist): the k nearest of each query in each cell it was sent to. A cell with many rows is several
    blocks, one with many queries several parts, and each part of its queries meets each block of its rows in a task."""
    counts = routed.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    plan = F.broadcast(blocks.join(counts, "cell"))  # a row a cell, MOST_PIVOTS at most
    left = routed.join(plan, "cell").withColumn("part", F.pmod(F.xxhash64("query", "cand", "grp"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = cells.join(plan, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def f(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], kind) for c, kind in (("query", pa.int64()), ("cand", pa.int64()), ("grp", pa.int32()), ("id", pa.int64()), ("dist", pa.float64()))})
        names, cand, grp, ids = queries["query"].to_numpy(), queries["cand"].to_numpy(), queries["grp"].to_numpy(), rows["id"].to_numpy()
        i, j, d = _best(_matrix(queries["features"]), _matrix(queries["weights"]), grp, _matrix(rows["features"]), ids, rows["held"].to_pylist(), k)
        return pa.table({"query": names[i], "cand": cand[i], "grp": pa.array(grp[i], pa.int32()), "id": ids[j], "dist": d})

    keys = ["cell", "block", "part"]
    left = left.select(*keys, "query", "cand", "grp", "features", "weights").groupBy(*keys)
    return left.cogroup(right.select(*keys, "id", "features", "held").groupBy(*keys)).applyInArrow(f, "query long, cand long, grp int, id long, dist double")


def _whole() -> Column:
    return F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _needed(rows: pa.Table, k: int) -> pa.Table:
    """Rows but for those that have, for each number that may be held, k equal vectors with a smaller id that don't hold
    it: no query has these among its k nearest."""
    x, ids = _matrix(rows["features"]), rows["id"].to_numpy()
    _, vector = np.unique(x, axis=0, return_inverse=True)
    vector = vector.reshape(-1)
    order = np.lexsort((ids, vector))
    v = vector[order]
    at = np.arange(len(v))
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    begin = np.repeat(start, np.diff(np.r_[start, len(v)]))
    held = rows["held"].take(pa.array(order)).combine_chunks()
    held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
    most = np.zeros(len(v), np.int64)  # how often the numbers that a row holds were held up to it
    row, number = np.repeat(at, np.asarray(held.value_lengths().fill_null(0))), held.flatten().to_numpy(zero_copy_only=False)
    if len(row):
        by = np.lexsort((row, number, v[row]))
        new = np.r_[True, (v[row[by]][1:] != v[row[by]][:-1]) | (number[by][1:] != number[by][:-1])]
        first = np.flatnonzero(new)
        rank = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)])) + 1
        np.maximum.at(most, row[by], rank)
    step = int(most.max(initial=0)) + 1
    before = np.maximum.accumulate(most + v * step) - v * step
    before = np.where(at == begin, 0, np.r_[0, before[:-1]])
    return rows.take(pa.array(np.sort(order[at - begin - before < k])))


def needed(data: DataFrame, k: int) -> DataFrame:
    """Rows of data(id, features, held, result) that may be among the k nearest of any query: of equal vectors mostly the
    first few by id, as a query meets these first whatever it is. Looked for inside tasks, then among equal vectors; where
    vectors are mostly different, data as it is."""
    rows = data.where(_whole() & F.col("id").isNotNull()).select(F.col("id").cast("long"), F.transform("features", lambda v: v.cast("double")).alias("features"), F.col("held").cast("array<int>").alias("held"), F.col("result").cast("double").alias("result"))
    n, different, dims = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("features")), F.max(F.size("features"))).first()
    if not n or 2 * different > n:
        return data
    limit = max(1, EQUAL_VALUES // max(1, dims))

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for b in batches:
            kept.append(pa.Table.from_batches([b]))
            size += b.num_rows
            if size > limit:
                kept = [_needed(pa.concat_tables(kept), k)]
                size = kept[0].num_rows
                if 2 * size > limit:
                    yield from kept[0].to_batches()
                    kept, size = [], 0
        if size:
            yield from _needed(pa.concat_tables(kept), k).to_batches()

    columns = "id long, features array<double>, held array<int>, result double"
    return save(rows.mapInArrow(f, columns).repartition("features").mapInArrow(f, columns))


def nearest(queries: DataFrame, data: DataFrame, k: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query, id, dist, rank): the k nearest rows of data(id, features) to each of queries(query, features),
    by Euclidean distance, rounded to 9 digits, ties by id.

    queries may have a grp (int): rows of data whose array `held` has that number do not count. They may have weights, a
    scale for each place of the difference, and a cand (long) that names them. Both are part of the key then, and stand
    in the result. Queries and rows without a vector, or with a null or no finite number in it, are left out.

    An exact join by pivots: rows belong to the cell of the nearest of a sample of rows. A query meets the cells around
    it first, which hold k rows and more; the k-th distance found there rules out all cells whose box or radius lies
    farther, and the rest are met in a second step. Only pivots, boxes and radii of cells are known to the driver, so
    neither side has to be small, and the plan does not grow with them."""
    spark = data.sparkSession
    scratch = Scratch(spark)
    whole = _whole()
    given = [c for c in ("cand", "grp") if c in queries.columns]
    vector = F.transform("features", lambda v: v.cast("double")).alias("features")
    held = F.col("held").cast("array<int>") if "held" in data.columns else F.lit(None).cast("array<int>")
    data = data.where(whole & F.col("id").isNotNull()).select(F.col("id").cast("long"), vector, held.alias("held"))
    n, dims = data.agg(F.count("*"), F.max(F.size("features"))).first()
    if not n:
        return spark.createDataFrame([], ", ".join(["query long", *[{"cand": "cand long", "grp": "grp int"}[c] for c in given], "id long, dist double, rank int"]))
    wanted = min(MOST_PIVOTS, max(1, -(-n // cell_rows)), max(1, SIDE_VALUES // max(1, dims)))
    pivots = np.array([r["features"] for r in data.orderBy(F.xxhash64("id"), "id").select("features").limit(wanted).collect()], float).reshape(-1, dims)
    pivots = np.unique(pivots, axis=0)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            x = _matrix(b.column(1))
            for at in range(0, len(x), 4_096):
                part = x[at : at + 4_096]
                d = np.stack([((part - c) ** 2).sum(axis=1) for c in p], axis=1)
                cell = d.argmin(axis=1)
                piece = b.slice(at, len(part))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), piece.column(0), piece.column(1), piece.column(2), pa.array(np.sqrt(d[np.arange(len(part)), cell]))], ["cell", "id", "features", "held", "r"])

    cells = scratch.save("cells", data.mapInArrow(assign, "cell int, id long, features array<double>, held array<int>, r double"))
    sums = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("r").alias("r")).collect()
    boxes = cells.select("cell", F.posexplode("features").alias("pos", "x")).groupBy("cell", "pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    low, high = np.full(pivots.shape, np.inf), np.full(pivots.shape, -np.inf)
    for r in boxes.collect():  # a row a cell and place, SIDE_VALUES at most
        low[r["cell"], r["pos"]], high[r["cell"], r["pos"]] = r["lo"], r["hi"]
    size, radius = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in sums:
        size[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    live = np.flatnonzero(size)
    known = spark.sparkContext.broadcast((live, _Cells(pivots[live], size[live], low[live], high[live], radius[live])))
    most = max(1, SIDE_VALUES // max(1, dims))
    blocks = spark.createDataFrame([(int(c), -(-int(size[c]) // most)) for c in live], "cell int, blocks int")

    ones = F.transform("features", lambda v: F.lit(1.0))
    weights = F.transform("weights", lambda v: v.cast("double")) if "weights" in queries.columns else ones
    cand, grp = (F.col(c).cast(kind) if c in given else F.lit(0).cast(kind) for c, kind in (("cand", "long"), ("grp", "int")))
    asked = queries.where(whole & F.col("query").isNotNull() & (F.size("features") == dims)).select(F.col("query").cast("long"), cand.alias("cand"), grp.alias("grp"), vector, weights.alias("weights"))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = known.value
        for b in batches:
            for at in range(0, b.num_rows, 1_024):
                piece = b.slice(at, 1_024)
                order = np.argsort(c.near(_matrix(piece.column(3)), _matrix(piece.column(4))), axis=1, kind="stable")
                before = np.cumsum(c.size[order], axis=1) - c.size[order]
                met = [names[o[:m]].tolist() for o, m in zip(order, (before < 2 * k + 8).sum(axis=1))]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(met, pa.list_(pa.int32()))], ["query", "cand", "grp", "features", "weights", "met"])

    columns = "query long, cand long, grp int, features array<double>, weights array<double>"
    asked = scratch.save("asked", asked.mapInArrow(around, f"{columns}, met array<int>"))
    near = scratch.save("near", _meet(asked.withColumn("cell", F.explode("met")), cells, blocks, k, most))
    if len(live) > 1:
        last = near.groupBy("query", "cand", "grp").agg(F.sort_array(F.collect_list("dist")).alias("ds")).select("query", "cand", "grp", F.get("ds", F.lit(k - 1)).alias("limit"))

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, c = known.value
            for b in batches:
                for at in range(0, b.num_rows, 1_024):
                    piece = b.slice(at, 1_024)
                    limit = piece.column(6).to_numpy(zero_copy_only=False).astype(float)
                    limit[np.isnan(limit)] = np.inf  # fewer than k rows so far
                    reach = c.least(_matrix(piece.column(3)), _matrix(piece.column(4))) <= (limit * (1 + 1e-9) + 1e-8)[:, None]
                    for i, met in enumerate(piece.column(5).to_pylist()):
                        reach[i, np.searchsorted(names, met)] = False
                    i, cell = np.nonzero(reach)
                    taken = pa.RecordBatch.from_arrays(piece.columns[:5], ["query", "cand", "grp", "features", "weights"]).take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(names[cell], pa.int32())], ["query", "cand", "grp", "features", "weights", "cell"])

        again = asked.join(last, ["query", "cand", "grp"], "left").select("query", "cand", "grp", "features", "weights", "met", "limit").mapInArrow(rest, f"{columns}, cell int")
        near = near.union(_meet(scratch.save("again", again), cells, blocks, k, most))
    rank = F.row_number().over(Window.partitionBy("query", "cand", "grp").orderBy("dist", "id"))
    near = near.withColumn("rank", rank).where(F.col("rank") <= k)
    return near.select("query", *given, "id", "dist", "rank")


def knn_estimate(near: DataFrame, data: DataFrame, k: int = 3) -> DataFrame:
    """(query, guess): mean result of the k nearest."""
    return near.where(F.col("rank") <= k).join(data.select("id", "result"), "id").groupBy("query").agg(F.avg("result").alias("guess"))


def weighted_knn(near: DataFrame, data: DataFrame, k: int = 5, weight: str = "gaussian") -> DataFrame:
    """(query, guess): mean weighted by distance; 0 where all weights are 0."""
    w = WEIGHTS[weight](F.col("dist"))
    rows = near.where(F.col("rank") <= k).join(data.select("id", "result"), "id").select("query", "result", w.alias("w"))
    return rows.groupBy("query").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("result")), F.nullif(F.sum("w"), F.lit(0.0))), F.lit(0.0)).alias("guess"))


def range_probability(near: DataFrame, data: DataFrame, ranges: DataFrame, k: int = 5, weight: str = "gaussian") -> DataFrame:
    """(query, low, high, prob): weight of the k nearest whose result lies in [low, high] by the whole weight, for
    each row of ranges(query, low, high); 0 where all weights are 0."""
    w = WEIGHTS[weight](F.col("dist"))
    rows = near.where(F.col("rank") <= k).join(data.select("id", "result"), "id").select("query", "result", w.alias("w"))
    joined = ranges.join(rows, "query")
    inside = F.sum(F.when((F.col("result") >= F.col("low")) & (F.col("result") <= F.col("high")), F.col("w")).otherwise(0.0))
    return joined.groupBy("query", "low", "high").agg(F.coalesce(F.try_divide(inside, F.nullif(F.sum("w"), F.lit(0.0))), F.lit(0.0)).alias("prob"))


def probability_curve(near: DataFrame, data: DataFrame, high: float, steps: int, k: int = 5, weight: str = "gaussian", sigma: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Cumulative (query, i, prob) of results from 0 to each grid point, and density (query, i, prob): the
    probability of each step, smoothed over the grid by a gaussian of its distance."""
    step = high / steps
    grid = near.select("query").distinct().select("query", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    upto = grid.select("query", F.lit(0.0).alias("low"), (F.col("i") * step).alias("high"), "i")
    cumulative = range_probability(near, data, upto.drop("i"), k, weight).select("query", F.round(F.col("high") / step).cast("int").alias("i"), "prob")
    each = grid.select("query", (F.col("i") * step).alias("low"), ((F.col("i") + 1) * step).alias("high"))
    raw = range_probability(near, data, each, k, weight).select("query", F.round(F.col("low") / step).cast("int").alias("i"), "prob")
    other = raw.select("query", F.col("i").alias("j"), F.col("prob").alias("p"))
    smooth = raw.join(other, "query").groupBy("query", "i").agg(F.sum(WEIGHTS["gaussian"](step * F.abs(F.col("i") - F.col("j")), sigma) * F.col("p")).alias("prob"))
    return cumulative, smooth


def error_rate(guesses: DataFrame) -> DataFrame:
    """One row (mse, accuracy, r2) of guesses(guess, actual): mean squared error, share of equal ones, squared
    correlation (null where one side is constant)."""
    g, a, n = F.col("guess"), F.col("actual"), F.count("*")
    cov = n * F.sum(g * a) - F.sum(g) * F.sum(a)
    den = (n * F.sum(g * g) - F.sum(g) * F.sum(g)) * (n * F.sum(a * a) - F.sum(a) * F.sum(a))
    return guesses.agg(F.avg((g - a) * (g - a)).alias("mse"), F.avg((g == a).cast("double")).alias("accuracy"), F.try_divide(cov * cov, F.nullif(den, F.lit(0.0))).alias("r2"))


def _share(key: Column, trial: Column) -> Column:
    """A number from 0 to 1 that id and trial decide: the first 32 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), trial.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def folds(n: int) -> Callable[[DataFrame], DataFrame]:
    """M8: a row is held out in the fold of its id modulo n."""
    return lambda rows: rows.withColumn("held", F.array(F.pmod(F.col("id"), F.lit(n)).cast("int")))


def random_split(trials: int, share: float = 0.05) -> Callable[[DataFrame], DataFrame]:
    """M8: in each trial a row is held out with a chance of `share`, decided by a hash of its id and the trial."""
    return lambda rows: rows.withColumn("held", F.filter(F.transform(F.sequence(F.lit(0), F.lit(trials - 1)), lambda t: F.when(_share(F.col("id"), t) < share, t)), lambda t: t.isNotNull()))


def hold_out(trials: int, n: int) -> Callable[[DataFrame], DataFrame]:
    """M8: in each trial the n rows with the smallest hashes are held out; ties by id."""

    def divide(rows: DataFrame) -> DataFrame:
        each = rows.select("id", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("t"))
        order = Window.partitionBy("t").orderBy(_share(F.col("id"), F.col("t")), "id")
        out = each.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("held"))
        return rows.join(out, "id", "left").withColumn("held", F.coalesce("held", F.array().cast("array<int>")))

    return divide


def knn_estimator(k: int = 3, weight: str | Callable[[Column], Column] | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """(query, grp, guess) of queries(query, grp, features) from the rows of data that grp doesn't hold out: the mean of
    the k nearest, or their mean weighted by a function of the distance (0 where all weights are 0)."""

    def estimate(queries: DataFrame, data: DataFrame) -> DataFrame:
        data = needed(data, k)
        rows = nearest(queries, data, k).join(data.select("id", "result"), "id")
        if weight is None:
            return rows.groupBy("query", "grp").agg(F.avg("result").alias("guess"))
        w = (WEIGHTS[weight] if isinstance(weight, str) else weight)(F.col("dist"))
        rows = rows.withColumn("w", w)
        return rows.groupBy("query", "grp").agg(F.coalesce(F.try_divide(F.sum(F.col("w") * F.col("result")), F.nullif(F.sum("w"), F.lit(0.0))), F.lit(0.0)).alias("guess"))

    return estimate


def mean_estimator(queries: DataFrame, data: DataFrame) -> DataFrame:
    """(query, grp, guess): the mean result of all rows that grp doesn't hold out, from sums of all and of those held."""
    held = data.select(F.explode("held").alias("grp"), "result").groupBy("grp").agg(F.sum("result").alias("s"), F.count("result").alias("c"))
    whole = data.agg(F.sum("result").alias("s_all"), F.count("result").alias("c_all"))
    per = held.join(F.broadcast(whole)).select("grp", F.try_divide(F.col("s_all") - F.col("s"), F.nullif(F.col("c_all") - F.col("c"), F.lit(0).cast("long"))).alias("guess"))
    return queries.join(per, "grp").select("query", "grp", "guess")


def _divided(data: DataFrame, divfun: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Data with the trials that hold each row out, saved. Rows are dealt first: the hashes of many trials are work, and a
    small file would be one task."""
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(divfun(data.repartition(parts, "id")).select("id", "features", "result", "held"))


def _tests(rows: DataFrame) -> DataFrame:
    """(query, grp, features, n, mean, spread): equal vectors that a trial holds out are one query, under the smallest id,
    with how many there are, their mean result and the sum of squares around it."""
    held = rows.where("id is not null").select("id", "features", F.explode("held").alias("grp"), "result")
    return held.groupBy("features", "grp").agg(F.min("id").alias("query"), F.count("result").alias("n"), F.avg("result").alias("mean"), (F.var_pop("result") * F.count("result")).alias("spread"))


def _mse() -> Column:
    """Mean squared error of guesses for tests."""
    off = F.col("guess") - F.col("mean")
    return F.try_divide(F.sum(F.col("n") * off * off + F.col("spread")), F.sum(F.when(off.isNotNull(), F.col("n"))))


def cross_validate(data: DataFrame, divfun: Callable[[DataFrame], DataFrame] | int, algf: Callable[[DataFrame, DataFrame], DataFrame] | int = 3) -> DataFrame:
    """M8: (fold, mse) of data(id, features, result): each row that divfun holds out of a trial is estimated by algf from
    the rows it doesn't, all trials in one job. A whole number as divfun stands for so many folds by id, as algf for the
    mean of so many nearest. Rows carry the trials that hold them out, so nothing is copied for each trial; what is equal
    and held out together is estimated once. A trial that holds nothing out, or of which nothing can be estimated, has no
    row."""
    divfun = folds(divfun) if isinstance(divfun, int) else divfun
    algf = knn_estimator(algf) if isinstance(algf, int) else algf
    rows = _divided(data, divfun)
    tests = save(_tests(rows))
    guess = algf(tests.select("query", "grp", "features"), rows)
    return guess.join(tests.drop("features"), ["query", "grp"]).groupBy(F.col("grp").alias("fold")).agg(_mse().alias("mse"))


def tune_k(data: DataFrame, ks: list[int], divfun: Callable[[DataFrame], DataFrame] | int) -> DataFrame:
    """M9: (k, cost), the mean over the trials of divfun of the mean squared error of the k-nearest estimate, for each of
    ks, from one join with the most neighbours."""
    tests, rows = divide(data, folds(divfun) if isinstance(divfun, int) else divfun, max(ks))
    near = nearest(tests.select("query", "grp", "features"), rows, max(ks)).join(rows.select("id", "result"), "id")
    guess = near.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).where("rank <= k").groupBy("k", "query", "grp").agg(F.avg("result").alias("guess"))
    return guess.join(tests.drop("features"), ["query", "grp"]).groupBy("k", "grp").agg(_mse().alias("mse")).groupBy("k").agg(F.avg("mse").alias("cost"))


def divide(data: DataFrame, divfun: Callable[[DataFrame], DataFrame], k: int = 3) -> tuple[DataFrame, DataFrame]:
    """What divfun holds out of data(id, features, result), and the rows that may be among the k nearest of that: for
    `scale_costs`, so that a search divides its data once."""
    rows = _divided(data, divfun)
    return save(_tests(rows)), needed(rows, k)


def scale_costs(tests: DataFrame, rows: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """M9: `tune_scales` over divided data."""
    scales = candidates.select("cand_id", F.transform("genes", lambda g: g.cast("double")).alias("weights"))
    # a stated set of candidates times the rows held out
    asked = tests.crossJoin(scales).select("query", F.col("cand_id").alias("cand"), "grp", "features", "weights")
    guess = nearest(asked, rows, k).join(rows.select("id", "result"), "id").groupBy("query", "cand", "grp").agg(F.avg("result").alias("guess"))
    return guess.join(tests.drop("features"), ["query", "grp"]).groupBy(F.col("cand").alias("cand_id")).agg(_mse().alias("cost"))


def tune_scales(data: DataFrame, candidates: DataFrame, divfun: Callable[[DataFrame], DataFrame], k: int = 3) -> DataFrame:
    """M9: (cand_id, cost) of candidates(cand_id, genes), scales of the places of the vectors: the mean squared error of
    the k-nearest estimate of all rows held out, by distances with those scales. All candidates meet one partition of
    the rows in one job; a test row is a query once for each candidate. It is a cost function for the searches of plans."""
    return scale_costs(*divide(data, divfun, k), candidates, k)

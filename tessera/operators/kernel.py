"""Linear and kernel classification of rows(id, features, match)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.numeric import dot, sq_length
from tessera.shared import save, shared_folder


def interest_counts(pairs: DataFrame) -> DataFrame:
    """(interest, n) over both colon lists of pairs(interests1, interests2)."""
    both = F.concat(F.split("interests1", ":"), F.split("interests2", ":"))
    return pairs.select(F.explode(both).alias("interest")).where("interest <> ''").groupBy("interest").agg(F.count("*").alias("n"))


def class_centroids(rows: DataFrame) -> DataFrame:
    """(match, features): mean vector of each class."""
    mean = rows.select("match", F.posexplode("features").alias("pos", "x")).groupBy("match", "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy("match").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("features"))


def linear_classify(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, guess): class 0 where the point is nearer to its centroid, else 1."""
    c = centroids.where("match = 0").select(F.col("features").alias("m0")).join(centroids.where("match = 1").select(F.col("features").alias("m1")))
    p = points.join(F.broadcast(c))
    side = dot(F.col("features"), F.col("m0")) - dot(F.col("features"), F.col("m1")) + (sq_length(F.col("m1")) - sq_length(F.col("m0"))) / 2
    return p.select("id", F.when(side > 0, 0).otherwise(1).alias("guess"))


def _kernel_sums(points: DataFrame, rows: DataFrame, gamma: float, block: int) -> DataFrame:
    """(id, s0, s1): sums of the kernel of each point with all rows of each class. Rows are gathered in blocks of
    bounded size; every block meets every point, in numpy, and sums are added in a shuffle of three numbers a point."""
    blocks = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // block)))).cast("int")).groupBy("_b").agg(F.collect_list("features").alias("xs"), F.collect_list("match").alias("ms"))

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, ps, xs, ms in zip(b["ids"], b["ps"], b["xs"], b["ms"]):
                p, x, m = np.stack(ps).astype(float), np.stack(xs).astype(float), np.asarray(ms)
                d = np.maximum((p * p).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * p @ x.T, 0)
                k = np.exp(-gamma * d)
                yield pd.DataFrame({"id": np.asarray(ids), "s0": k[:, m == 0].sum(1), "s1": k[:, m == 1].sum(1)})

    mine = points.withColumn("_p", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, -(-points.count() // block)))).cast("int")).groupBy("_p").agg(F.collect_list("id").alias("ids"), F.collect_list("features").alias("ps"))
    return mine.join(blocks, how="cross").select("ids", "ps", "xs", "ms").mapInPandas(f, "id long, s0 double, s1 double").groupBy("id").agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))


def kernel_offset(rows: DataFrame, gamma: float = 10.0, block: int = 1_000) -> DataFrame:
    """One row (offset): mean kernel inside class 1 less that inside class 0, pairs with oneself included."""
    sums = _kernel_sums(rows, rows, gamma, block).join(rows.select("id", "match"), "id")
    s0, s1 = F.sum(F.when(F.col("match") == 0, F.col("s0"))), F.sum(F.when(F.col("match") == 1, F.col("s1")))
    n0, n1 = F.sum(F.when(F.col("match") == 0, 1.0)), F.sum(F.when(F.col("match") == 1, 1.0))
    return sums.agg((s1 / (n1 * n1) - s0 / (n0 * n0)).alias("offset"))


def kernel_classify(points: DataFrame, rows: DataFrame, offset: DataFrame, gamma: float = 10.0, block: int = 1_000) -> DataFrame:
    """(id, guess): 0 where the mean kernel to class 0 less that to class 1 and the offset is above 0, else 1."""
    n = rows.agg(F.sum(F.when(F.col("match") == 0, 1.0)).alias("n0"), F.sum(F.when(F.col("match") == 1, 1.0)).alias("n1"))
    sums = _kernel_sums(points, rows, gamma, block).join(F.broadcast(n)).join(F.broadcast(offset))
    return sums.select("id", F.when(F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1") + F.col("offset") > 0, 0).otherwise(1).alias("guess"))


def _svm_map(rows: DataFrame, kernel: str, gamma: float, features: int, seed: int):
    """A function from rows(features) to rows with a vector v whose dot product stands for the kernel."""
    from pyspark.ml.feature import PolynomialExpansion
    from pyspark.ml.functions import array_to_vector

    first = rows.select(F.size("features")).first()
    width = first[0] if first else 0
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (features, width)), rng.uniform(0, 2 * np.pi, features)

    def mapped(df: DataFrame) -> DataFrame:
        x = F.col("features")
        if kernel == "rbf":
            x = F.array(*[F.cos(dot(x, F.array(*[F.lit(float(c)) for c in w[i]])) + float(b[i])) * float(np.sqrt(2 / features)) for i in range(features)])
        df = df.withColumn("x", array_to_vector(x))
        return PolynomialExpansion(degree=2, inputCol="x", outputCol="v").transform(df).drop("x") if kernel == "polynomial" else df.withColumnRenamed("x", "v")

    if kernel not in ("linear", "polynomial", "rbf"):
        raise ValueError(f"no kernel {kernel}")
    return mapped


def svm(rows: DataFrame, kernel: str = "linear", gamma: float = 1.0, features: int = 64, seed: int = 1, rounds: int = 30, penalty: float = 0.0001):
    """A support-vector classifier of rows(features, match): linear, polynomial of degree 2, or rbf by random
    Fourier features. Returns a function from rows(id, features) to (id, guess). The mapped rows are written to the
    shared folder, and the fit reads them there, round by round. So is the model, as what fit() returns holds a summary
    of the training and with it the session, which no task can take once a query of the session has been observed or
    tagged; a model that is read has none. Rows of one class alone are told to be of that class."""
    from pyspark.ml.classification import LinearSVC, LinearSVCModel

    mapped = _svm_map(rows, kernel, gamma, features, seed)
    ready = save(mapped(rows.select("features", F.col("match").cast("double").alias("label"))).select("v", "label"))
    least, most = ready.agg(F.min("label"), F.max("label")).first()
    if least is None:
        raise ValueError("no rows to learn from")
    if least == most:
        return lambda points: points.select("id", F.lit(int(least)).alias("guess"))
    path = f"{shared_folder(rows.sparkSession)}/tessera-{uuid.uuid4().hex}/svm"
    LinearSVC(featuresCol="v", labelCol="label", maxIter=rounds, regParam=penalty).fit(ready).save(path)
    model = LinearSVCModel.load(path)
    return lambda points: model.transform(mapped(points)).select("id", F.col("prediction").cast("int").alias("guess"))


def svm_folds(rows: DataFrame, folds: int, kernel: str = "linear", **settings) -> DataFrame:
    """(fold, n, accuracy, majority) of rows(id, features, match): a model for each fold of a hash of the ids, learnt
    from the others and judged on it, beside the share of the fold's larger class."""
    rows = save(rows.select("id", "features", F.col("match").cast("int").alias("match"), F.pmod(F.xxhash64("id"), F.lit(folds)).cast("int").alias("fold")))
    told = None
    for k in range(folds):
        test = rows.where(F.col("fold") == k)
        guess = svm(rows.where(F.col("fold") != k), kernel, **settings)(test).join(test.select("id", "match", "fold"), "id")
        told = guess if told is None else told.unionByName(guess)
    share = F.avg((F.col("guess") == F.col("match")).cast("double"))
    ones = F.avg(F.col("match").cast("double"))
    return told.groupBy("fold").agg(F.count("*").alias("n"), share.alias("accuracy"), F.greatest(ones, 1 - ones).alias("majority"))

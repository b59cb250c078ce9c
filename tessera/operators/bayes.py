"""Document classification from feature counts: naive Bayes and Fisher's method."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def class_counts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """fc(feature, category, n) and cc(category, n) of docs(category, features), a feature once a document."""
    fc = docs.select("category", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature", "category").agg(F.count("*").alias("n"))
    return fc, docs.groupBy("category").agg(F.count("*").alias("n"))


def add_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """A21, by increments: counts of more documents added to stored ones."""
    keys = [c for c in old.columns if c != "n"]
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def feature_probs(fc: DataFrame, cc: DataFrame, weight: float = 1.0, assumed: float = 0.5, fisher: bool = False) -> DataFrame:
    """(feature, category, prob, weighted) for every feature and every category.

    prob is the share of a category's documents with the feature; for Fisher's method, that by its sum over
    categories. weighted draws it to `assumed` by the number of documents with the feature. There are few
    categories, so the features are moved once, each with all of its categories."""
    categories = cc.select("category", F.col("n").alias("docs"))
    total = fc.groupBy("feature").agg(F.sum("n").alias("total"))
    full = total.crossJoin(F.broadcast(categories)).join(fc, ["feature", "category"], "left")
    prob = F.coalesce(F.col("n"), F.lit(0)) / F.col("docs")
    if fisher:
        share = F.sum(prob).over(Window.partitionBy("feature"))
        prob = F.when(share > 0, prob / share).otherwise(F.lit(0.0))
    told = full.select("feature", "category", "total", prob.alias("prob"))
    return told.select("feature", "category", "prob", ((weight * assumed + F.col("total") * F.col("prob")) / (weight + F.col("total"))).alias("weighted"))


def doc_features(docs: DataFrame, probs: DataFrame, categories: DataFrame, assumed: float = 0.5) -> DataFrame:
    """(doc_id, category, m, logs): number of features of a document and the sum of logarithms of their
    weighted probabilities; a feature that training never saw has the assumed one.

    Documents without features are kept, with m = 0."""
    per = docs.select("doc_id", F.array_distinct("features").alias("f"))
    exploded = per.select("doc_id", F.explode("f").alias("feature"))
    by_feature = probs.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("category", F.log("weighted")))).alias("logs"))
    met = exploded.join(by_feature, "feature").select("doc_id", F.explode("logs").alias("category", "log"))
    known = met.groupBy("doc_id", "category").agg(F.sum("log").alias("log"), F.count("*").alias("k"))
    every = per.select("doc_id", F.size("f").alias("m")).crossJoin(F.broadcast(categories.select("category")))
    out = every.join(known, ["doc_id", "category"], "left")
    rest = (F.col("m") - F.coalesce("k", F.lit(0))) * float(np.log(assumed))
    return out.select("doc_id", "category", "m", (F.coalesce("log", F.lit(0.0)) + rest).alias("logs"))


def bayes_scores(docs: DataFrame, fc: DataFrame, cc: DataFrame) -> DataFrame:
    """(doc_id, category, score), the logarithm of the prior times the product of weighted probabilities."""
    logs = doc_features(docs, feature_probs(fc, cc), cc)
    prior = cc.select("category", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))
    return logs.join(F.broadcast(prior), "category").select("doc_id", "category", (F.col("logs") + F.col("prior")).alias("score"))


def bayes_classify(scores: DataFrame, thresholds: dict | None = None, default: str = "unknown") -> DataFrame:
    """(doc_id, category): the best one, unless another times the best one's threshold exceeds it."""
    limit = F.lit(0.0)
    for category, t in (thresholds or {}).items():
        limit = F.when(F.col("category") == category, F.lit(float(np.log(t)))).otherwise(limit)
    ranked = scores.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "category")))
    two = ranked.where("k <= 2").groupBy("doc_id").agg(F.max(F.when(F.col("k") == 1, F.struct("category", "score"))).alias("best"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("next"))
    two = two.select("doc_id", "best.category", "best.score", "next")
    return two.select("doc_id", F.when(F.col("next").isNotNull() & (F.col("next") + limit > F.col("score")), F.lit(default)).otherwise(F.col("category")).alias("category"))


@F.pandas_udf(T.DoubleType())
def inverse_chi2(chi: pd.Series, features: pd.Series) -> pd.Series:
    """H2: probability of a chi-square of at least `chi` with 2 * features degrees of freedom: a Poisson sum,
    in log space, at most 1; 1 without features."""
    out = np.ones(len(chi))
    m = (chi / 2).to_numpy(float)
    n = features.to_numpy(int)
    for k in np.unique(n):
        at = np.flatnonzero(n == k)
        if k <= 0:
            continue
        i = np.arange(k)
        logs = np.concatenate(([0.0], np.cumsum(np.log(np.maximum(i[1:], 1)))))
        mm = m[at][:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            terms = -mm + np.where(i[None, :] == 0, 0.0, i[None, :] * np.log(mm)) - logs[None, :]
        top = terms.max(axis=1, keepdims=True)
        out[at] = np.minimum(1.0, np.exp(top[:, 0]) * np.exp(terms - top).sum(axis=1))
    return pd.Series(out)


def fisher_scores(docs: DataFrame, fc: DataFrame, cc: DataFrame) -> DataFrame:
    """(doc_id, category, score): inverse chi-square of -2 times the sum of logarithms."""
    logs = doc_features(docs, feature_probs(fc, cc, fisher=True), cc)
    return logs.select("doc_id", "category", inverse_chi2(-2 * F.col("logs"), F.col("m")).alias("score"))


def fisher_classify(scores: DataFrame, minimums: dict | None = None, default: str = "unknown") -> DataFrame:
    """(doc_id, category): the best category above its minimum, 0 where none is given; ties to the smaller name."""
    least = F.lit(0.0)
    for category, m in (minimums or {}).items():
        least = F.when(F.col("category") == category, F.lit(float(m))).otherwise(least)
    best = scores.groupBy("doc_id").agg(F.min_by("category", F.struct(-F.col("score"), F.col("category"))).alias("_all"), F.min_by(F.when(F.col("score") > least, F.col("category")), F.when(F.col("score") > least, F.struct(-F.col("score"), F.col("category")))).alias("category"))
    return best.select("doc_id", F.coalesce("category", F.lit(default)).alias("category"))

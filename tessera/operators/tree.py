"""Decision and regression trees, grown level by level, on rows(id, features map, label)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.shared import Scratch, save


def impurity(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by..., n, gini, entropy) of the label counts of each group."""
    counts = rows.groupBy(*by, label).agg(F.count("*").alias("c"))
    total = counts.withColumn("t", F.sum("c").over(Window.partitionBy(*by)) if by else F.sum("c").over(Window.partitionBy(F.lit(0))))
    p = F.col("c") / F.col("t")
    return total.groupBy(*by).agg(F.sum("c").alias("n"), (1 - F.sum(p * p)).alias("gini"), (-F.sum(p * F.log2(p))).alias("entropy"))


def label_variance(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by..., n, variance), the population variance of a numeric label."""
    return rows.groupBy(*by).agg(F.count(label).alias("n"), F.var_pop(label).alias("variance"))


def _entropy(counts: Column, total: Column) -> Column:
    """Entropy of an array of label counts."""
    return F.aggregate(counts, F.lit(0.0), lambda s, c: s - F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0))


def long_rows(rows: DataFrame, numbers: list[str], words: list[str], label: str) -> DataFrame:
    """(id, col, num, word, label): a row for each feature; null values are rows too."""
    cells = [F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("num"), F.lit(None).cast("string").alias("word")) for c in numbers]
    cells += [F.struct(F.lit(c).alias("col"), F.lit(None).cast("double").alias("num"), F.col(c).cast("string").alias("word")) for c in words]
    return rows.select("id", F.col(label).alias("label"), F.explode(F.array(*cells)).alias("x")).select("id", "label", "x.col", "x.num", "x.word")


@dataclass(frozen=True)
class Score:
    """An impurity that sums can tell. By labels: `term` of each label's count is added up, and `value` takes the rows
    and that sum. By moments: `value` takes the rows, the sum of the numeric labels and that of their squares."""

    value: Callable[..., Column]
    term: Callable[[Column], Column] | None = None


ENTROPY = Score(lambda n, s: F.log2(n) - s / n, lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0))
GINI = Score(lambda n, s: 1 - s / (n * n), lambda c: (c * c).cast("double"))
VARIANCE = Score(lambda n, s, q: F.greatest(q / n - (s / n) * (s / n), F.lit(0.0)))
SCORES = {"entropy": ENTROPY, "gini": GINI, "variance": VARIANCE}


def _score(scoref: str | Score) -> Score:
    return SCORES[scoref] if isinstance(scoref, str) else scoref


def _with_buckets(cells: DataFrame, buckets: int) -> DataFrame:
    """Cells with the range (bucket) of their column that a number is in: at most `buckets` ranges of about equal rows,
    whose bounds, a row a column, every task gets."""
    at = [i / buckets for i in range(1, buckets)]
    bounds = cells.where("num is not null").groupBy("col").agg(F.array_distinct(F.percentile_approx("num", at, 10_000)).alias("bounds"))
    bucket = F.when(F.col("num").isNotNull(), F.size(F.filter("bounds", lambda x: x <= F.col("num")))).otherwise(0)
    return cells.join(F.broadcast(bounds), "col", "left").withColumn("bucket", bucket).drop("bounds")


def _from_here(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Rows with each sum replaced by that over all rows of the keys with this num or a larger one. Sums of whole buckets
    are carried over, so that no window holds more than a bucket."""
    whole = rows.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(c) for c in sums])
    before = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "bucket", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_carried") for c in sums])
    here = Window.partitionBy(*keys, "bucket").orderBy(F.desc("num")).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*[c for c in rows.columns if c not in sums], *[F.sum(c).over(here).alias(c) for c in sums])
    joined = local.join(carried, [*keys, "bucket"])
    return joined.select(*[c for c in rows.columns if c not in sums], *[(F.col(c) + F.col(f"{c}_carried")).alias(c) for c in sums])


def _gains(cells: DataFrame, score: Score) -> DataFrame:
    """(node, col, num, word, n, n_true, gain) of cells(node, col, bucket, num, word, label)."""
    null = F.col("num").isNull() & F.col("word").isNull()
    test = ["node", "col", "bucket", "num", "word"]
    if score.term is None:
        y = F.col("label").cast("double")
        per = cells.groupBy(*test).agg(F.count("*").alias("c"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
        sums = ["c", "s", "q"]
        values = per.where(~null)
        totals = per.groupBy("node", "col").agg(*[F.sum(F.when(~null, F.col(c)).otherwise(0)).alias(f"{c}_known") for c in sums], *[F.sum(F.when(null, F.col(c)).otherwise(0)).alias(f"{c}_null") for c in sums])
        yes = _from_here(values.where("num is not null"), ["node", "col"], sums).unionByName(values.where("num is null"))
        rows = yes.join(totals, ["node", "col"])
        sides = {"all": [F.col(f"{c}_known") + F.col(f"{c}_null") for c in sums], "yes": [F.col(c) + F.col(f"{c}_null") for c in sums], "no": [F.col(f"{c}_known") - F.col(c) + F.col(f"{c}_null") for c in sums]}
    else:
        # a label's own count before and after each of its values tells how much the sum of terms changes there
        per = cells.groupBy(*test, F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("label")).agg(F.count("*").alias("c"))
        labels = per.groupBy("node", "col", "label").agg(F.sum(F.when(~null, F.col("c")).otherwise(0)).alias("known"), F.sum(F.when(null, F.col("c")).otherwise(0)).alias("nulls"))
        totals = labels.groupBy("node", "col").agg(F.sum("known").alias("c_known"), F.sum("nulls").alias("c_null"), F.sum(score.term(F.col("nulls"))).alias("t_null"), F.sum(score.term(F.col("known") + F.col("nulls"))).alias("t_all"))
        values = per.where(~null).withColumn("upto", F.col("c"))
        upto = _from_here(values.where("num is not null"), ["node", "col", "label"], ["upto"]).unionByName(values.where("num is null"))
        rows = upto.join(labels, ["node", "col", "label"])
        more = score.term(F.col("upto") + F.col("nulls")) - score.term(F.col("upto") - F.col("c") + F.col("nulls"))
        less = score.term(F.col("known") - F.col("upto") + F.col("nulls")) - score.term(F.col("known") - F.col("upto") + F.col("c") + F.col("nulls"))
        changes = rows.groupBy(*test).agg(F.sum("c").alias("c"), F.sum(more).alias("more"), F.sum(less).alias("less"))
        yes = _from_here(changes.where("num is not null"), ["node", "col"], ["c", "more", "less"]).unionByName(changes.where("num is null"))
        rows = yes.join(totals, ["node", "col"])
        sides = {"all": [F.col("c_known") + F.col("c_null"), F.col("t_all")], "yes": [F.col("c") + F.col("c_null"), F.col("t_null") + F.col("more")], "no": [F.col("c_known") - F.col("c") + F.col("c_null"), F.col("t_all") + F.col("less")]}
    n, n_true, n_false = (sides[s][0] for s in ("all", "yes", "no"))
    p = n_true / n
    gain = score.value(*sides["all"]) - p * score.value(*sides["yes"]) - (1 - p) * score.value(*sides["no"])
    return rows.where((n_true > 0) & (n_false > 0)).select("node", "col", "num", "word", n.alias("n"), n_true.alias("n_true"), gain.alias("gain"))


def split_gains(cells: DataFrame, at: DataFrame, scoref: str | Score = "entropy", buckets: int = 256) -> DataFrame:
    """(node, col, num, word, n, n_true, gain) of every test of every node: `>=` for numbers, `=` for words.

    cells as in long_rows, at(id, node) puts rows in nodes. Rows with a null value stand on both sides, and both sides
    hold rows. scoref is entropy, gini, variance (of a numeric label) or a Score."""
    return _gains(_with_buckets(cells, buckets).join(at, "id"), _score(scoref))


def best_splits(gains: DataFrame) -> DataFrame:
    """The best test of each node; ties by column, then the smaller value. Tests of one column and node are ranked in
    two steps, so that no task takes all."""
    order = lambda keys: Window.partitionBy(*keys).orderBy(F.desc(F.round("gain", 9)), "col", "num", "word")
    some = gains.withColumn("part", F.pmod(F.hash("col", "num", "word"), F.lit(64)))
    some = some.withColumn("k", F.row_number().over(order(["node", "part"]))).where("k = 1").drop("k", "part")
    return some.withColumn("k", F.row_number().over(order(["node"]))).where("k = 1").drop("k")


def _placed(rows: DataFrame, numbers: list[str], words: list[str], label: str) -> DataFrame:
    """(id, label, n0.., w0.., node): names of a user's columns can't clash with those of a tree."""
    numeric = [F.col(c).cast("double").alias(f"n{i}") for i, c in enumerate(numbers)]
    return rows.select("id", F.col(label).alias("label"), *numeric, *[F.col(c).cast("string").alias(f"w{i}") for i, c in enumerate(words)], F.lit(1).cast("long").alias("node"))


def _cells(placed: DataFrame, numbers: list[str], words: list[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"n{i}").alias("num"), F.lit(None).cast("string").alias("word")) for i, c in enumerate(numbers)]
    cells += [F.struct(F.lit(c).alias("col"), F.lit(None).cast("double").alias("num"), F.col(f"w{i}").alias("word")) for i, c in enumerate(words)]
    return placed.select("node", "label", F.explode(F.array(*cells)).alias("x")).select("node", "label", "x.*")


def _leaf_values(placed: DataFrame, score: Score) -> DataFrame:
    """(node, counts, n, mean): label counts of each node, or the rows and the mean of a numeric label."""
    if score.term is None:
        y = F.col("label").cast("double")
        return placed.groupBy("node").agg(F.lit(None).cast("map<string,bigint>").alias("counts"), F.count("*").alias("n"), F.avg(y).alias("mean"))
    per = placed.groupBy("node", F.col("label").cast("string").alias("label")).agg(F.count("*").alias("c")).where("label is not null")
    return per.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "c")))).alias("counts"), F.sum("c").alias("n"), F.lit(None).cast("double").alias("mean"))


def grow_tree(rows: DataFrame, numbers: list[str], words: list[str], label: str, min_gain: float = 0.0, depth: int = 4, scoref: str | Score = "entropy", pass_score: bool = True) -> DataFrame:
    """M5: (node, col, num, word, gain, counts, n, mean) of a tree: inner nodes have a test, all have label counts and
    rows, or rows and the mean of a numeric label if scoref is by moments. Node 1 is the root, 2n holds the rows that pass
    the test of n, 2n + 1 the others; a null value goes to both. Without pass_score only the root is scored by scoref, and
    all below by entropy.

    Each level reads the rows once and passes them through the splits so far, which every task gets: 2 ** depth small
    rows at most, so depth is 12 at most. Nothing but counts or sums by value is shuffled."""
    if not 1 <= depth <= 12:
        raise ValueError("depth is from 1 to 12")
    scratch = Scratch(rows.sparkSession)
    placed = scratch.save("rows", _placed(rows, numbers, words, label))
    first, below = _score(scoref), _score(scoref) if pass_score else ENTROPY
    found = None
    for level in range(depth):
        cells = _with_buckets(_cells(placed, numbers, words), 256)
        score = first if level == 0 else below
        best = scratch.save("splits", best_splits(_gains(cells, score)).where(F.col("gain") > min_gain + 1e-9).select("node", "col", "num", "word", "gain"))
        here = _leaf_values(placed, below).join(best, "node", "left").select("node", "col", "num", "word", "gain", "counts", "n", "mean")
        found = here if found is None else found.unionByName(here)
        step = placed.join(F.broadcast(best.select("node", "col", F.col("num").alias("t"), F.col("word").alias("v"))), "node")
        number = F.coalesce(*[F.when(F.col("col") == c, F.col(f"n{i}")) for i, c in enumerate(numbers)], F.lit(None).cast("double"))
        word = F.coalesce(*[F.when(F.col("col") == c, F.col(f"w{i}")) for i, c in enumerate(words)], F.lit(None).cast("string"))
        passed = F.when(F.col("t").isNotNull(), number >= F.col("t")).otherwise(word == F.col("v"))
        sides = F.when(passed.isNull(), F.array(2 * F.col("node"), 2 * F.col("node") + 1)).when(passed, F.array(2 * F.col("node"))).otherwise(F.array(2 * F.col("node") + 1))
        placed = step.withColumn("node", F.explode(sides)).drop("col", "t", "v")
        if best.isEmpty():
            return scratch.save("tree", found)
    none = F.lit(None)
    last = _leaf_values(placed, below).select("node", none.cast("string").alias("col"), none.cast("double").alias("num"), none.cast("string").alias("word"), none.cast("double").alias("gain"), "counts", "n", "mean")
    return scratch.save("tree", found.unionByName(last))


def prune_tree(nodes: DataFrame, min_gain: float, literal: bool = False) -> DataFrame:
    """M6: merge pairs of leaves, bottom up, where the entropy of both together exceeds theirs by less than min_gain: the
    mean of the two, or literally the first and half of the second. Works on many trees at once if nodes have a
    column tree."""
    keys = ["tree", "node"]
    has_tree = "tree" in nodes.columns
    nodes = nodes if has_tree else nodes.withColumn("tree", F.lit(0))

    def entropy(c: Column) -> Column:
        return _entropy(F.map_values(c), F.aggregate(F.map_values(c), F.lit(0).cast("long"), lambda s, x: s + x))

    while True:
        leaves = nodes.where("col is null").select("tree", F.floor(F.col("node") / 2).alias("parent"), (F.col("node") % 2).alias("side"), "counts")
        a, b = leaves.where("side = 0").withColumnRenamed("counts", "ca"), leaves.where("side = 1").withColumnRenamed("counts", "cb")
        pairs = a.drop("side").join(b.drop("side"), ["tree", "parent"])
        names = F.array_distinct(F.concat(F.map_keys("ca"), F.map_keys("cb")))
        both = F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.coalesce(F.col("ca")[k], F.lit(0)) + F.coalesce(F.col("cb")[k], F.lit(0)))))
        pairs = pairs.withColumn("both", both)
        apart = entropy(F.col("ca")) + entropy(F.col("cb")) / 2 if literal else (entropy(F.col("ca")) + entropy(F.col("cb"))) / 2
        merged = pairs.where(entropy(F.col("both")) - apart < min_gain).select("tree", F.col("parent").alias("node"), F.col("both").alias("merged")).persist()
        if merged.isEmpty():
            return nodes if has_tree else nodes.drop("tree")
        gone = merged.select("tree", F.explode(F.array(2 * F.col("node"), 2 * F.col("node") + 1)).alias("node"))
        kept = nodes.join(gone, keys, "left_anti").join(merged, keys, "left")
        cut = F.col("merged").isNotNull()
        nodes = kept.select("tree", "node", *[F.when(~cut, F.col(c)).alias(c) for c in ("col", "num", "word", "gain")], F.coalesce("merged", "counts").alias("counts"))
        nodes = save(nodes)


def _reached(rows: DataFrame, nodes: DataFrame, numbers: list[str], words: list[str], depth: int) -> DataFrame:
    """(id, w, size, counts, mean) of the leaves that each row reaches, with its weight there."""
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda s, x: s + x)
    size = F.coalesce(total, F.col("n")) if "n" in nodes.columns else total
    mean = F.col("mean") if "mean" in nodes.columns else F.lit(None).cast("double")
    tree = nodes.select("node", F.col("col").alias("tcol"), F.col("num").alias("t"), F.col("word").alias("v"), "counts", size.alias("size"), mean.alias("mean"))

    def ends(c: str) -> list[Column]:
        kind = rows.schema[c].dataType
        a, b = (F.col(c)[f.name].cast("double") for f in kind.fields[:2]) if isinstance(kind, T.StructType) else (F.col(c).cast("double"),) * 2
        known = a.isNotNull() & b.isNotNull()
        return [F.when(known, F.least(a, b)), F.when(known, F.greatest(a, b))]

    none = F.lit(None)
    cells = [x for c in numbers for x in (F.lit(c), F.struct(ends(c)[0].alias("low"), ends(c)[1].alias("high"), none.cast("string").alias("word")))]
    cells += [x for c in words for x in (F.lit(c), F.struct(none.cast("double").alias("low"), none.cast("double").alias("high"), F.col(c).cast("string").alias("word")))]
    at = rows.select("id", F.create_map(*cells).alias("x"), F.lit(1).cast("long").alias("node"), F.lit(1.0).alias("w"))
    sizes = tree.select("node", "size")
    done = None
    for _ in range(depth):
        step = at.join(F.broadcast(tree), "node")
        leaf = step.where("tcol is null").select("id", "w", "size", "counts", "mean")
        done = leaf if done is None else done.unionByName(leaf)
        inner = step.where("tcol is not null").withColumn("value", F.col("x")[F.col("tcol")])
        number = F.when(F.col("value.low") >= F.col("t"), True).when(F.col("value.high") < F.col("t"), False)
        passed = F.when(F.col("t").isNotNull(), number).otherwise(F.col("value.word") == F.col("v"))
        sides = F.when(passed.isNull(), F.array(2 * F.col("node"), 2 * F.col("node") + 1)).when(passed, F.array(2 * F.col("node"))).otherwise(F.array(2 * F.col("node") + 1))
        moved = inner.select("id", "x", "w", passed.isNull().alias("split"), F.explode(sides).alias("node")).join(F.broadcast(sizes), "node")
        other = sizes.select(F.col("node").bitwiseXOR(F.lit(1).cast("long")).alias("node"), F.col("size").alias("osize"))
        moved = moved.join(F.broadcast(other), "node", "left")
        share = F.when(F.col("split"), F.col("size") / (F.col("size") + F.coalesce("osize", F.lit(0)))).otherwise(1.0)
        at = moved.select("id", "x", "node", (F.col("w") * share).alias("w"))
    return done


def tree_classify(rows: DataFrame, nodes: DataFrame, numbers: list[str], words: list[str], depth: int = 8) -> DataFrame:
    """M7: (id, label, share): follow tests to the leaves. A null value takes both branches, and a range (a struct of two
    numbers, in either order) the branches that it touches; both are weighted by the rows of the branches, and shares of
    the leaves reached are added, so that they sum to 1. The tree, 2 ** depth rows at most, is sent to all tasks."""
    told = _reached(rows, nodes, numbers, words, depth).select("id", "w", "size", F.explode("counts").alias("label", "c"))
    return told.groupBy("id", "label").agg(F.sum(F.col("w") * F.col("c") / F.col("size")).alias("share"))


def tree_estimate(rows: DataFrame, nodes: DataFrame, numbers: list[str], words: list[str], depth: int = 8) -> DataFrame:
    """M7: (id, guess): the mean of the leaf of a regression tree, or of the leaves reached, by their weights."""
    return _reached(rows, nodes, numbers, words, depth).groupBy("id").agg(F.sum(F.col("w") * F.col("mean")).alias("guess"))


def multiway_split(rows: DataFrame, column: str, thresholds: list[float]) -> DataFrame:
    """Rows with their bucket: the largest threshold at or under the value, null (else) below all or for null."""
    cuts = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    return rows.withColumn("bucket", F.array_max(F.filter(cuts, lambda t: t <= F.col(column))))


def multiway_gains(rows: DataFrame, column: str, values: list[float], label: str = "label", most: int = 12) -> DataFrame:
    """(cuts, gain) of every set of thresholds out of at most `most` values: all sets are one exploded job."""
    if len(values) > most:
        raise ValueError(f"{len(values)} values make too many sets; at most {most}")
    spark = rows.sparkSession
    sets = spark.range(1, 2 ** len(values)).select(F.col("id").alias("set"), F.filter(F.array(*[F.when(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1, F.lit(float(v))) for i, v in enumerate(sorted(values))]), lambda x: x.isNotNull()).alias("cuts"))
    counts = rows.groupBy(F.col(column).alias("x"), F.col(label).alias("label")).agg(F.count("*").alias("c"))
    parts = counts.crossJoin(F.broadcast(sets)).select("set", "cuts", F.array_max(F.filter("cuts", lambda t: t <= F.col("x"))).alias("bucket"), "label", "c")
    per = parts.groupBy("set", "cuts", "bucket", "label").agg(F.sum("c").alias("c"))
    each = per.groupBy("set", "cuts", "bucket").agg(F.collect_list("c").alias("cs"), F.sum("c").alias("n"))
    inside = each.groupBy("set", "cuts").agg(F.sum("n").alias("total"), F.sum(F.col("n") * _entropy(F.col("cs"), F.col("n"))).alias("e"))
    whole = rows.groupBy(label).agg(F.count("*").alias("c")).agg(F.collect_list("c").alias("cs"), F.sum("c").alias("n")).select(_entropy(F.col("cs"), F.col("n")).alias("whole"))
    return inside.join(F.broadcast(whole)).select("cuts", (F.col("whole") - F.col("e") / F.col("total")).alias("gain"))


def _cut_numbers(n: np.ndarray, sums: np.ndarray, cost: Callable, most: int) -> tuple[float, list[int]]:
    """Least cost of cutting ordered values into at most most + 1 runs, and the first places of the runs but the one at 0;
    ties: the fewest cuts, then the leftmost. Costs of all runs that end at a place are one vector."""
    m = len(n)
    at_n, at_s = np.append(0, np.cumsum(n)), np.vstack([np.zeros(sums.shape[1]), np.cumsum(sums, axis=0)])
    runs = np.full((m + 1, m + 1), np.inf)
    for j in range(1, m + 1):
        runs[:j, j] = cost(at_n[j] - at_n[:j], at_s[j] - at_s[:j])
    best, back = [runs[0].copy()], [np.zeros(m + 1, int)]
    for _ in range(min(most, m - 1)):
        through = np.round(best[-1][:, None] + runs, 9)
        back.append(through.argmin(axis=0))
        best.append(through.min(axis=0))
    ends = np.round([b[m] for b in best], 9)
    k, j, cuts = int(ends.argmin()), m, []
    while k:
        j = int(back[k][j])
        cuts.append(j)
        k -= 1
    return float(best[len(cuts)][m]), cuts[::-1]


def _cut_words(n: np.ndarray, sums: np.ndarray, others: np.ndarray, cost: Callable, most: int, sets: int = 20_000) -> tuple[float, list[int]]:
    """Least cost of giving at most `most` values a branch of their own, the rest being together with `others`; ties: the
    fewest, then the first. Beyond `sets` sets of one size the best value is added to the best smaller set instead."""
    whole_n, whole_s = n.sum() + others.sum(), sums.sum(axis=0) + others
    alone = cost(n, sums)
    spent, chosen = float(cost(np.array([whole_n]), whole_s[None])[0]), ()
    last: tuple = ()
    for k in range(1, min(most, len(n)) + 1):
        if math.comb(len(n), k) <= sets:
            some = np.array(list(itertools.combinations(range(len(n)), k)))
        else:
            some = np.array([[*last, i] for i in range(len(n)) if i not in last])
        costs = np.round(alone[some].sum(axis=1) + cost(whole_n - n[some].sum(axis=1), whole_s - sums[some].sum(axis=1)), 9)
        i = int(costs.argmin())
        last = tuple(some[i].tolist())
        if costs[i] < round(spent, 9):
            spent, chosen = float(costs[i]), last
    return spent, sorted(chosen)


def _label_cost(kind: str) -> Callable:
    def cost(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows times impurity of sets of rows with these label counts."""
        n = np.maximum(n, 1e-300)[:, None]
        if kind == "gini":
            return (n[:, 0] - (counts * counts / n).sum(axis=1)).clip(0)
        return -(counts * np.log2(np.where(counts > 0, counts / n, 1))).sum(axis=1)

    return cost


def multiway_best(cells: DataFrame, cuts: int = 3, scoref: str = "entropy", most_values: int = 2_000) -> DataFrame:
    """(node, col, nums, words, gain) of cells(node string, col, num, word, label): the best set of at most `cuts`
    thresholds or words of each column and node. A row goes to the largest threshold at or under its value, or to its
    word; below all, with another word or with null it goes to `else`.

    Counts by value are made first. Thresholds are found by dynamic programming over the distinct values. A column with
    more than most_values distinct values in a node is refused."""
    per = cells.where("num is not null or word is not null").groupBy("node", "col", "num", "word", F.col("label").cast("string").alias("label")).agg(F.count("*").alias("c"))
    labels = cells.groupBy(F.col("node").alias("at"), F.col("col").alias("of"), F.col("label").cast("string").alias("label")).agg(F.count("*").alias("t"), F.count(F.when(F.col("num").isNull() & F.col("word").isNull(), 1)).alias("nulls"))
    cost = _label_cost(scoref)

    def best(values: pa.Table, totals: pa.Table) -> pa.Table:
        schema = pa.schema([("node", pa.string()), ("col", pa.string()), ("nums", pa.list_(pa.float64())), ("words", pa.list_(pa.string())), ("gain", pa.float64())])
        if not values.num_rows:
            return schema.empty_table()
        names = {x: i for i, x in enumerate(sorted(totals["label"].to_pylist(), key=str))}
        whole, nulls = np.zeros(len(names)), np.zeros(len(names))
        for x, t, u in zip(totals["label"].to_pylist(), totals["t"].to_pylist(), totals["nulls"].to_pylist()):
            whole[names[x]], nulls[names[x]] = t, u
        numeric = values["num"].null_count == 0
        keys = sorted(set(values["num" if numeric else "word"].to_pylist()))
        if len(keys) > most_values:
            raise ValueError(f"{len(keys)} distinct values of {values['col'][0]}; at most {most_values}")
        place = {x: i for i, x in enumerate(keys)}
        sums = np.zeros((len(keys), len(names)))
        for x, y, c in zip(values["num" if numeric else "word"].to_pylist(), values["label"].to_pylist(), values["c"].to_pylist()):
            sums[place[x], names[y]] += c
        now = float(cost(whole.sum(keepdims=True), whole[None])[0])
        if numeric:  # nulls are with what lies below all thresholds
            first = int(nulls.sum() > 0)
            rows = np.vstack([nulls, sums])[1 - first :]
            spent, chosen = _cut_numbers(rows.sum(axis=1), rows, cost, cuts)
            chosen = [i - first for i in chosen]
        else:
            spent, chosen = _cut_words(sums.sum(axis=1), sums, nulls, cost, cuts)
        found = [keys[i] for i in chosen]
        return pa.table({"node": [values["node"][0].as_py()], "col": [values["col"][0].as_py()], "nums": [found if numeric else None], "words": [None if numeric else found], "gain": [(now - spent) / whole.sum()]}, schema=schema)

    return per.groupBy("node", "col").cogroup(labels.groupBy("at", "of")).applyInArrow(best, "node string, col string, nums array<double>, words array<string>, gain double")


def grow_multiway(rows: DataFrame, numbers: list[str], words: list[str], label: str, min_gain: float = 0.0, depth: int = 2, cuts: int = 3, scoref: str = "entropy") -> DataFrame:
    """(node, col, nums, words, gain, counts) of a tree whose nodes have up to cuts + 1 branches. Node `r` is the
    root; `.i` after a node is its i-th threshold or word, `.0` the rest."""
    scratch = Scratch(rows.sparkSession)
    placed = scratch.save("rows", _placed(rows, numbers, words, label).withColumn("node", F.lit("r")))
    found = best = None
    for level in range(depth + 1):
        here = _leaf_values(placed, ENTROPY).select("node", "counts")
        if level < depth:
            order = Window.partitionBy("node").orderBy(F.desc(F.round("gain", 9)), "col")  # a row a column
            gains = multiway_best(_cells(placed, numbers, words), cuts, scoref).where(F.col("gain") > min_gain + 1e-9)
            best = scratch.save("splits", gains.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k"))
        else:
            best = best.limit(0)
        here = here.join(best, "node", "left").select("node", "col", "nums", "words", "gain", "counts")
        found = here if found is None else found.unionByName(here)
        if level < depth:
            step = placed.join(F.broadcast(best.drop("gain")), "node")  # (cuts + 1) ** depth small rows at most
            number = F.coalesce(*[F.when(F.col("col") == c, F.col(f"n{i}")) for i, c in enumerate(numbers)], F.lit(None).cast("double"))
            word = F.coalesce(*[F.when(F.col("col") == c, F.col(f"w{i}")) for i, c in enumerate(words)], F.lit(None).cast("string"))
            branch = F.when(F.col("nums").isNotNull(), F.size(F.filter("nums", lambda x: x <= number))).otherwise(F.coalesce(F.array_position("words", word), F.lit(0)))
            placed = step.withColumn("node", F.concat("node", F.lit("."), branch.cast("string"))).drop("col", "nums", "words")
    return scratch.save("tree", found)

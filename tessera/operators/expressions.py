"""Scores of expression trees over a table, their evolution, and standings of matches."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Functions of expression trees and their number of arguments.
FUNCTIONS = {
    "add": (2, lambda a, b: a + b),
    "subtract": (2, lambda a, b: a - b),
    "multiply": (2, lambda a, b: a * b),
    "if": (3, lambda a, b, c: F.when(a > 0, b).otherwise(c)),
    "isgreater": (2, lambda a, b: F.when(a > b, 1.0).otherwise(0.0)),
    "parity": (1, lambda a: F.pmod(F.floor(a), F.lit(2)).cast("double")),
    "square": (1, lambda a: a * a),
    "euclidean": (2, lambda a, b: F.sqrt(a * a + b * b)),
}


def compile_tree(tree) -> Column:
    """A nested spec as a column: a name of a parameter, a number, or (function, argument, ...)."""
    if isinstance(tree, str):
        return F.col(tree).cast("double")
    if isinstance(tree, (int, float)):
        return F.lit(float(tree))
    return FUNCTIONS[tree[0]][1](*[compile_tree(t) for t in tree[1:]])


def score_expressions(rows: DataFrame, trees: list, target: str = "target", batch: int = 50) -> list[float]:
    """For each tree the sum over rows of |value - target|; a batch of trees is one aggregate. Null and infinite
    values count as the worst score."""
    out: list[float] = []
    for at in range(0, len(trees), batch):
        part = trees[at : at + batch]
        r = rows.agg(*[F.sum(F.abs(compile_tree(t) - F.col(target))).alias(f"s{i}") for i, t in enumerate(part)]).first()
        out += [v if v is not None and math.isfinite(v) else math.inf for v in r]
    return out


def random_tree(rng: random.Random, parameters: list[str], depth: int = 4, p_function: float = 0.5, p_parameter: float = 0.6):
    if rng.random() < p_function and depth > 0:
        name = rng.choice(sorted(FUNCTIONS))
        return (name, *[random_tree(rng, parameters, depth - 1, p_function, p_parameter) for _ in range(FUNCTIONS[name][0])])
    return rng.choice(parameters) if rng.random() < p_parameter else rng.randint(0, 10)


def mutate(tree, rng: random.Random, parameters: list[str], chance: float = 0.1):
    if rng.random() < chance:
        return random_tree(rng, parameters)
    return (tree[0], *[mutate(t, rng, parameters, chance) for t in tree[1:]]) if isinstance(tree, tuple) else tree


def crossover(a, b, rng: random.Random, swap: float = 0.7, top: bool = True):
    if rng.random() < swap and not top:
        return b
    if isinstance(a, tuple) and isinstance(b, tuple):
        return (a[0], *[crossover(t, rng.choice(b[1:]), rng, swap, False) for t in a[1:]])
    return a


def evolve(rows: DataFrame, parameters: list[str], population: int = 40, generations: int = 5, keep: float = 0.7, fresh: float = 0.05, mutation: float = 0.1, swap: float = 0.4, seed: int = 1):
    """(tree, score), the best found. The driver holds the trees; each generation is scored by one Spark job. The two
    best stay, the rest are crossed and mutated from trees picked with a bias to good ranks, or new."""
    rng = random.Random(seed)
    trees = [random_tree(rng, parameters) for _ in range(population)]
    pick = lambda: min(int(math.log(max(rng.random(), 1e-12)) / math.log(keep)), population - 1)
    best = (None, math.inf)
    for _ in range(generations):
        ranked = sorted(zip(score_expressions(rows, trees), range(population)), key=lambda x: x)
        if ranked[0][0] < best[1]:
            best = (trees[ranked[0][1]], ranked[0][0])
        if best[1] == 0:
            break
        new = [trees[ranked[0][1]], trees[ranked[1][1]]]
        while len(new) < population:
            if rng.random() > fresh:
                new.append(mutate(crossover(trees[ranked[pick()][1]], trees[ranked[pick()][1]], rng, swap), rng, parameters, mutation))
            else:
                new.append(random_tree(rng, parameters))
        trees = new
    return best


def standings(matches: DataFrame) -> DataFrame:
    """(player, points): 2 for a loss, 1 to both for a tie, of matches(p1, p2, winner): 0 the first, 1 the second, -1 none."""
    first = matches.select(F.col("p1").alias("player"), F.when(F.col("winner") == 1, 2).when(F.col("winner") == -1, 1).otherwise(0).alias("points"))
    second = matches.select(F.col("p2").alias("player"), F.when(F.col("winner") == 0, 2).when(F.col("winner") == -1, 1).otherwise(0).alias("points"))
    return first.unionByName(second).groupBy("player").agg(F.sum("points").alias("points"))

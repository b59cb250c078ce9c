"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.shared import Scratch


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n (the folds of the classifiers)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(n)


def groups_for(total: float, per_group: float, least: int) -> int:
    """How many groups hold a total at a target size each; it grows with the input."""
    return max(least, math.ceil(total / per_group))


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """Smallest id reachable from each node. edges(a long, b long) -> (node long, component long).

    Each round hooks every node to its smallest neighbour, jumps pointers until all point at a root, and
    contracts the edges to what is left between roots. A root without a tree of its own has a smaller root
    beside it after that, so two rounds at least halve the roots, and jumps double the reach: a chain takes
    a number of steps in the logarithm of its length. Minima are combined before the shuffle, so a node with
    many neighbours is not gathered in one task. Loops and repeated edges are allowed; null ends link nothing;
    no edges give an empty table. Tables of a round are deleted when the next has been written.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = scratch.save("left", left)
    labels = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select(F.col("b"), F.col("a")))
        parent = scratch.save("parent", both.groupBy("node").agg(F.min("other").alias("p")).select("node", F.least("node", "p").alias("p")))
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = parent.join(up, "p").select("node", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved"))
            moved = Observation()
            parent = scratch.save("parent", jumped.observe(moved, F.count_if("moved").alias("n")).select("node", "p"))
            scratch.drop_older("parent")
            if not moved.get["n"]:
                break
        if labels is None:
            labels = parent.select("node", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("node").alias("component"), F.col("p").alias("root"))
            labels = labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        labels = scratch.save("labels", labels)
        scratch.drop_older("labels")
        pa, pb = parent.select(F.col("node").alias("a"), F.col("p").alias("ra")), parent.select(F.col("node").alias("b"), F.col("p").alias("rb"))
        left = left.join(pa, "a").join(pb, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct()
        left = scratch.save("left", left)
        scratch.drop_older("left")
    else:
        raise RuntimeError("connected_components did not settle")
    scratch.drop("left", "parent")
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column: text i is data[offsets[i]:offsets[i + 1]]; nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if pa.types.is_string(column.type):
        kind = np.int32
    elif pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), in place of a fresh array."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x

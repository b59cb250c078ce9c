"""Inputs of the registered queries, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ratings(user, item, rating): what a customer ordered of a part, on average."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return both.groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.avg(F.col("l_quantity").cast("double")).alias("rating"))


RATINGS_SQL = """ratings AS (
  SELECT o_custkey AS "user", l_partkey AS item, avg(l_quantity::DOUBLE) AS rating
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """links(from_id, to_id): a link graph over parts, repeated links kept, links to oneself dropped."""
    n = table(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    rows = lines.join(F.broadcast(n)).select(F.col("l_partkey").alias("from_id"), F.expr("l_orderkey % n").alias("to_id"))
    return rows.where("from_id <> to_id")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


LINKS_SQL = """links AS (
  SELECT l_partkey AS from_id, l_orderkey % (SELECT count(*) FROM part) AS to_id FROM lineitem
  WHERE l_partkey <> l_orderkey % (SELECT count(*) FROM part)), nodes AS (SELECT p_partkey AS node FROM part)"""

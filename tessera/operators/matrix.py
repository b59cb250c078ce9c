"""Word counts, vocabularies and matrices of long cells, and what leads from tags to users and urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_counts(docs: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, term, n)."""
    return docs.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def vocab_by_doc_share(counts: DataFrame, key: str, feeds: DataFrame, low: float = 0.1, high: float = 0.5) -> DataFrame:
    """(term, share) of terms that more than one occurrence puts in a share of feeds strictly between the
    bounds; the denominator counts every listed feed."""
    total = feeds.select(key).distinct().agg(F.count("*").alias("total"))
    seen = counts.where("n > 1").groupBy("term").agg(F.count("*").alias("feeds"))
    share = F.col("feeds") / F.col("total")
    return seen.join(F.broadcast(total)).select("term", share.alias("share")).where((F.col("share") > low) & (F.col("share") < high))


def vocab_by_total(counts: DataFrame, n_docs: DataFrame, low: int = 3, high: float = 0.6) -> DataFrame:
    """(term, total) with low < total < high * number of documents; n_docs has one row with n_docs."""
    total = counts.groupBy("term").agg(F.sum("n").alias("total"))
    return total.join(F.broadcast(n_docs)).where((F.col("total") > low) & (F.col("total") < high * F.col("n_docs"))).select("term", "total")


def wanted_items(wants: DataFrame, more_than: int = 10) -> DataFrame:
    """(item, user, value 1) for items that more than so many users want."""
    one = wants.select("item", "user").distinct()
    often = one.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("item")
    return one.join(often, "item").select("item", "user", F.lit(1).alias("value"))


def tag_user_counts(posts: DataFrame) -> DataFrame:
    """A10: (tag, user, n, tags): posts of a user under a tag, and all tags of those posts joined by `_`."""
    one = posts.select("user", "tags", F.explode(F.array_distinct(F.split("tags", " "))).alias("tag")).where("tag <> ''")
    return one.groupBy("tag", "user").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("tags")), "_").alias("tags"))


def nonzero_features(cells: DataFrame) -> DataFrame:
    """(row_id, features): names of the columns above 0 of a row, in order."""
    return cells.where("value > 0").groupBy("row_id").agg(F.array_sort(F.collect_list("col_id")).alias("features"))


def read_matrix(spark, path: str) -> DataFrame:
    """A tab file with column names in its first row and row names in its first column, as long cells."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first = wide.columns[0]
    rest = wide.columns[1:]
    cells = wide.select(F.col(f"`{first}`").alias("row_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in rest])
    return cells.unpivot(["row_id"], rest, "col_id", "value")


def to_wide(cells: DataFrame, columns: list[str]) -> DataFrame:
    """Wide rows of long cells over a given vocabulary, 0 for what is absent; rows without a name go."""
    most = int(cells.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    if len(columns) > most:
        raise ValueError(f"{len(columns)} columns; at most {most}")
    rows = cells.where("row_id is not null and row_id <> ''")
    return rows.groupBy("row_id").pivot("col_id", columns).agg(F.sum("value")).fillna(0)


def write_matrix(cells: DataFrame, columns: list[str], path: str) -> None:
    """S3: write long cells as a wide tab file with a header."""
    to_wide(cells, columns).write.mode("overwrite").csv(path, sep="\t", header=True)


def merge_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of two batches, added."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))


def except_seen(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key was not seen (or indexed) before."""
    return new.join(seen.select(*keys).distinct(), keys, "left_anti")


def first_title_wins(articles: DataFrame) -> DataFrame:
    """The first article of each title, in the order of `ord`."""
    one = Window.partitionBy("title").orderBy("ord")
    return articles.withColumn("_k", F.row_number().over(one)).where("_k = 1").drop("_k")


def frontier(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, level) reached from start(node) over edges(a, b) in at most `depth` steps; every level leaves
    out what is known. Levels are checkpointed where the session names a folder for that."""
    known = start.select("node").distinct().withColumn("level", F.lit(0))
    last = known
    for level in range(1, depth + 1):
        step = last.join(edges, last.node == edges.a).select(F.col("b").alias("node")).distinct()
        last = step.join(known.select("node"), "node", "left_anti").withColumn("level", F.lit(level))
        if known.sparkSession.sparkContext.getCheckpointDir() or known.sparkSession.conf.get("spark.checkpoint.dir", None):
            last = last.checkpoint()
        known = known.unionByName(last)
    return known


def seed_from_popular(posts: DataFrame, tag: str, count: int = 15) -> DataFrame:
    """(user, url, rating 1.0): all urls of the users who posted one of the tag's most posted urls."""
    tagged = posts.where(F.array_contains(F.split("tags", " "), tag))
    top = tagged.groupBy("href").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "href").limit(count)
    users = posts.join(F.broadcast(top.select("href")), "href", "left_semi").select("user").distinct()
    return posts.join(users, "user", "left_semi").select("user", F.col("href").alias("url")).distinct().withColumn("rating", F.lit(1.0))

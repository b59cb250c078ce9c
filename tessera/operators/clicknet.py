"""A net of words, hidden nodes and urls that learns from clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import save


def hidden_nodes(clicks: DataFrame, most_words: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """Edges (word, hidden, w) and (hidden, url, w) of one hidden node for each new set of query words: 1 by the
    number of words to the node, 0.1 to each url shown. Larger sets make no node; None sets no limit."""
    keyed = clicks.withColumn("hidden", F.array_join(F.array_sort(F.transform("words", lambda w: w.cast("string"))), "_"))
    keyed = keyed if most_words is None else keyed.where(F.size("words") <= most_words)
    words = keyed.select("hidden", F.explode("words").alias("word"), (1.0 / F.size("words")).alias("w")).groupBy("word", "hidden").agg(F.max("w").alias("w"))
    urls = keyed.select("hidden", F.explode("urls").alias("url")).distinct().select("hidden", "url", F.lit(0.1).alias("w"))
    return words, urls


def _alike(queries: DataFrame, *columns: str) -> DataFrame:
    """(columns, n, query): what queries ask, once, with how many ask it and a number."""
    return save(queries.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("query", F.monotonically_increasing_id()))


def _scores(queries: DataFrame, words: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = queries.select("query", F.explode("words").alias("word"))
    shown = queries.select("query", F.explode("urls").alias("url"))
    nodes = asked.join(words, "word").select("query", "hidden").union(shown.join(urls, "url").select("query", "hidden")).distinct()
    inputs = nodes.join(asked, "query").join(words, ["word", "hidden"], "left")
    hidden = inputs.groupBy("query", "hidden").agg(F.tanh(F.sum(F.coalesce("w", F.lit(-0.2)))).alias("ah"))
    outputs = shown.join(hidden, "query").join(urls, ["hidden", "url"], "left")
    scores = outputs.groupBy("query", "url").agg(F.tanh(F.sum(F.coalesce("w", F.lit(0.0)) * F.col("ah"))).alias("score"))
    rest = shown.join(scores, ["query", "url"], "left").select("query", "url", F.coalesce("score", F.lit(0.0)).alias("score"))
    return hidden, rest


def net_scores(queries: DataFrame, words: DataFrame, urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, hidden, ah) and (query, url, score) of queries(query, words, urls), a row a query: tanh of sums over
    edges, -0.2 for a word and 0 for a url without an edge; nodes are those linked to a query word or a url shown. Queries
    that ask the same meet the net once."""
    alike = _alike(queries, "words", "urls")
    asks = alike.select(F.col("words").alias("_words"), F.col("urls").alias("_urls"), F.col("query").alias("_alike"))
    of = queries.join(asks, F.col("words").eqNullSafe(F.col("_words")) & F.col("urls").eqNullSafe(F.col("_urls"))).select("query", "_alike")
    hidden, scores = _scores(alike, words, urls)
    return tuple(of.join(t.withColumnRenamed("query", "_alike"), "_alike").drop("_alike") for t in (hidden, scores))


def net_train(clicks: DataFrame, words: DataFrame, urls: DataFrame, rate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """The edges after a batch of clicks(query, words, urls, selected), a row a click: the target is 1 for the selected
    url, 0 for the rest; changes of all clicks of the batch are added, equal clicks by their number. A batch of one click is
    training click by click."""
    clicks = _alike(clicks, "words", "urls", "selected")
    hidden, scores = _scores(clicks, words, urls)
    target = F.when(F.col("url") == F.col("selected"), 1.0).otherwise(0.0)
    out = scores.join(clicks.select("query", "selected", "n"), "query").select("query", "n", "url", ((target - F.col("score")) * (1 - F.col("score") * F.col("score"))).alias("od"))
    pairs = hidden.join(out, "query").join(urls, ["hidden", "url"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    hd = pairs.groupBy("query", "n", "hidden", "ah").agg(F.sum(F.col("od") * F.col("w")).alias("e")).select("query", "hidden", (F.col("n") * (1 - F.col("ah") * F.col("ah")) * F.col("e")).alias("hd"))
    up = pairs.groupBy("hidden", "url").agg(F.sum(rate * F.col("n") * F.col("od") * F.col("ah")).alias("d"))
    new_urls = up.join(urls, ["hidden", "url"], "full").select("hidden", "url", (F.coalesce("w", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("w"))
    asked = clicks.select("query", F.explode("words").alias("word"))
    wp = hd.join(asked, "query").groupBy("word", "hidden").agg(F.sum(rate * F.col("hd")).alias("d"))
    new_words = wp.join(words, ["word", "hidden"], "full").select("word", "hidden", F.when(F.col("w").isNull(), F.lit(-0.2)).otherwise(F.col("w")).alias("w"), F.coalesce("d", F.lit(0.0)).alias("d"))
    return new_words.select("word", "hidden", (F.col("w") + F.col("d")).alias("w")), new_urls

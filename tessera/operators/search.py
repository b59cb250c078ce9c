"""Inverted index, link ranks and ranked search."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import words_all
from tessera.shared import Scratch, numbered

#: Words that the index leaves out.
STOP_WORDS = ["the", "of", "to", "and", "a", "in", "is", "it"]


def postings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """M1: (key, word, location): places count all words, the stop words are left out after counting."""
    words = docs.select(key, F.posexplode(words_all(F.col(text))).alias("location", "word"))
    return words.where(~F.col("word").isin(STOP_WORDS)).select(key, "word", "location")


@F.pandas_udf(T.StringType())
def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_resolve(b, h) for b, h in zip(base, href)])


def _resolve(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href or "")
    except ValueError:
        return None


def extract_links(pages: DataFrame) -> DataFrame:
    """(url, target, text): links of each page, resolved against it, without fragments; links that hold a quote go."""
    anchor = r"(?is)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\"[^>]*>(.*?)</a>"
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), 1).alias("href"), F.regexp_extract_all("html", F.lit(anchor), 2).alias("text"))
    rows = pages.select("url", F.explode(both).alias("a")).select("url", F.col("a.href").alias("href"), F.col("a.text").alias("text"))
    target = F.split_part(_joined("url", "href"), F.lit("#"), F.lit(1))
    return rows.select("url", target.alias("target"), F.regexp_replace("text", "<[^>]+>", "").alias("text")).where("target is not null and target not like \"%'%\" and target <> url")


def link_words(links: DataFrame) -> DataFrame:
    """(url, target, word): words of anchor texts, stop words left out."""
    return links.select("url", "target", F.explode(words_all(F.col("text"))).alias("word")).where(~F.col("word").isin(STOP_WORDS))


def pagerank(nodes: DataFrame, links: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, score) from 1.0 by rounds of 0.15 + 0.85 * sum(score / out-degree) over distinct sources;
    out-degrees count repeated links, and nothing is passed on from nodes without links. All nodes move at once.
    Edges and every round's ranks are tables in the shared folder; ranks of the round before last are deleted."""
    scratch = Scratch(nodes.sparkSession)
    degree = links.groupBy("from_id").agg(F.count("*").alias("degree"))
    edges = scratch.save("edges", links.distinct().join(degree, "from_id").select("from_id", "to_id", (damping / F.col("degree")).alias("w")))
    nodes = scratch.save("nodes", nodes.select("node"))
    rank = nodes.select("node", F.lit(1.0).alias("score"))
    for _ in range(rounds):
        passed = edges.join(rank, edges.from_id == rank.node).groupBy(F.col("to_id").alias("node")).agg(F.sum(F.col("w") * F.col("score")).alias("got"))
        rank = scratch.save("rank", nodes.join(passed, "node", "left").select("node", (1 - damping + F.coalesce("got", F.lit(0.0))).alias("score")))
        scratch.drop_older("rank")
    scratch.drop("edges", "nodes")
    return rank


def match_postings(index: DataFrame, words: list[str], key: str = "doc_id", phrase: bool = False) -> DataFrame:
    """(key, loc0, loc1, ...): all combinations of places of the words in a page; with phrase, only places
    in a row, joined on the place, so that nothing multiplies. Words are not lowered. Words that the index does not have
    are skipped; no word that it has gives no rows."""
    wanted = [w for w in words if w]
    have = {r["word"] for r in index.where(F.col("word").isin(wanted)).select("word").distinct().collect()} if wanted else set()  # at most the words asked for
    words = [w for w in wanted if w in have]
    if not words:
        return index.select(key, F.col("location").alias("loc0")).limit(0)
    out = None
    for i, w in enumerate(words):
        side = index.where(F.col("word") == w).select(key, F.col("location").alias(f"loc{i}"))
        if out is None:
            out = side
        elif phrase:
            out = out.join(side.withColumn("_at", F.col(f"loc{i}") - i), (out[key] == side[key]) & (F.col("loc0") == F.col("_at"))).drop(side[key]).drop("_at")
        else:
            out = out.join(side, key)
    return out


def normalise(score: Column, small_is_better: bool, by: Window) -> Column:
    """Value by the best one: v / max (1e-5 for a max of 0), or min / v with v at least 1e-5."""
    if small_is_better:
        return F.min(score).over(by) / F.greatest(score, F.lit(1e-5))
    top = F.max(score).over(by)
    return score / F.when(top == 0, F.lit(1e-5)).otherwise(top)


def _per_word(index: DataFrame, queries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Places of the query words, and per (query, key) with all of its words: the number of combinations of places and
    the smallest sum of them, from one aggregate per word (a product of counts, a sum of smallest places)."""
    hit = index.join(F.broadcast(queries.select("query", "pos", "word")), "word")
    per = hit.groupBy("query", key, "pos").agg(F.count("*").alias("n"), F.min("location").alias("lo"))
    size = queries.groupBy("query").agg(F.count("*").alias("words"))
    full = per.groupBy("query", key).agg(F.count("*").alias("k"), F.round(F.exp(F.sum(F.log("n")))).alias("rows"), F.sum("lo").alias("first")).join(F.broadcast(size), "query").where("k = words")
    return hit, full.select("query", key, "rows", "first", "words")


def chain_distance(hit: DataFrame, full: DataFrame, key: str) -> DataFrame:
    """(query, key, distance): the smallest sum of distances of neighbouring words over all choices of one
    place per word, by a step from word to word instead of all combinations. One word has distance 0."""
    rows = hit.join(full.select("query", key), ["query", key]).groupBy("query", key).agg(F.collect_list(F.struct("pos", "location")).alias("at"))

    @F.pandas_udf("double")
    def least(at: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for places in at:
            by: dict = {}
            for p in places:
                by.setdefault(p["pos"], []).append(p["location"])
            cost = None
            for pos in sorted(by):
                x = np.unique(by[pos]).astype(float)
                if cost is None:
                    cost, last = np.zeros(len(x)), x
                    continue
                down = np.minimum.accumulate(cost - last)  # from a place at or before
                up = np.minimum.accumulate((cost + last)[::-1])[::-1]  # from one at or after
                i = np.searchsorted(last, x, side="right")
                left = np.where(i > 0, down[np.maximum(i - 1, 0)] + x, np.inf)
                j = np.searchsorted(last, x, side="left")
                right = np.where(j < len(last), up[np.minimum(j, len(last) - 1)] - x, np.inf)
                cost, last = np.minimum(left, right), x
            out.append(float(cost.min()))
        return pd.Series(out)

    return rows.select("query", key, least("at").alias("distance"))


def search_scores(index: DataFrame, queries: DataFrame, links: DataFrame, ranks: DataFrame, key: str = "doc_id", small_distance: bool = True, linked_words: DataFrame | None = None) -> DataFrame:
    """Per (query, key) that holds all query words, scaled scores: frequency (combinations by the highest
    place), location, distance, inbound links, rank, length (long first), and link text where link words are given.

    queries(query, pos, word); links(from_id, to_id) and ranks(node, score) are keyed like the index."""
    hit, full = _per_word(index, queries, key)
    length = index.groupBy(key).agg(F.max("location").alias("length"))
    inbound = links.groupBy(F.col("to_id").alias(key)).agg(F.count("*").alias("inbound"))
    rows = full.join(length, key).join(inbound, key, "left").join(ranks.withColumnRenamed("node", key).withColumnRenamed("score", "rank"), key, "left").join(chain_distance(hit, full, key), ["query", key])
    by = Window.partitionBy("query")
    frequency = F.coalesce(F.try_divide(F.col("rows"), F.nullif(F.col("length"), F.lit(0))), F.lit(0.0))
    distance = F.when(F.col("words") == 1, F.lit(1.0)).otherwise(normalise(F.col("distance"), small_distance, by))
    columns = [
        normalise(frequency, False, by).alias("frequency"),
        normalise(F.least(F.col("first").cast("double"), F.lit(1_000_000.0)), True, by).alias("location"),
        distance.alias("distance"),
        normalise(F.coalesce("inbound", F.lit(0)).cast("double"), False, by).alias("inbound"),
        normalise(F.coalesce("rank", F.lit(0.0)), False, by).alias("rank"),
        normalise(F.col("length").cast("double"), False, by).alias("length"),
    ]
    if linked_words is None:
        return rows.select("query", key, *columns)
    told = anchor_hits(linked_words, queries, ranks, full, key)
    rows = rows.join(told, ["query", key], "left")
    return rows.select("query", key, *columns, normalise(F.coalesce("linktext", F.lit(0.0)), False, by).alias("linktext"))


def anchor_hits(linked_words: DataFrame, queries: DataFrame, ranks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """(query, key, linktext): ranks of the sources of links to a result whose text holds a query word."""
    hits = linked_words.join(F.broadcast(queries.select("query", "word")), "word").join(ranks, linked_words.from_id == ranks.node)
    summed = hits.groupBy("query", F.col("to_id").alias(key)).agg(F.sum("score").alias("linktext"))
    return summed.join(results.select("query", key), ["query", key], "left_semi")


#: Weights of the scores in the ranked search.
WEIGHTS = {"frequency": 0.18, "location": 0.14, "distance": 0.24, "rank": 0.15, "length": 0.15, "inbound": 0.15}


def ranked_search(scores: DataFrame, names: DataFrame, key: str = "doc_id", weights: dict | None = None, n: int = 10) -> DataFrame:
    """(query, url, score, k): the n best results of each query by the weighted sum of scores, ties to the larger url."""
    total = sum(F.col(c) * w for c, w in (weights or WEIGHTS).items())
    told = scores.select("query", key, F.round(total, 6).alias("score")).join(names, key)
    ranked = told.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.desc("url"))))
    return ranked.where(F.col("k") <= n).select("query", "url", "score", "k")


def outbound_relevant(links: DataFrame, results: DataFrame, key: str, per: int = 250) -> DataFrame:
    """(target, n): link targets of the result pages by count, the first floor(targets / per) of them."""
    counts = links.join(results.select(F.col(key).alias("from_id")).distinct(), "from_id", "left_semi").groupBy(F.col("to_id").alias("target")).agg(F.count("*").alias("n"))
    ranked = numbered(counts, [F.desc("n"), F.desc("target")], "k")
    return ranked.join(F.broadcast(counts.agg(F.floor(F.count("*") / per).alias("keep")))).where("k <= keep").select("target", "n")

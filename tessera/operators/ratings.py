"""Similarities of users and items, neighbours and recommendations, on ratings(user, item, rating)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.shared import numbered, save


def read_ratings(titles: DataFrame, scores: DataFrame) -> DataFrame:
    """(user, title, rating) of titles(id, title) and scores(user, id, rating, ts). Ids that share a title
    collapse, and the latest rating stays (ties: the larger rating). Titles are a dimension; Spark broadcasts
    them while they are below its threshold."""
    both = scores.join(titles, "id")
    return both.groupBy("user", "title").agg(F.max_by("rating", F.struct("ts", "rating")).alias("rating"))


def transpose(ratings: DataFrame) -> DataFrame:
    """Swap users and items; a renaming, no work."""
    return ratings.select(F.col("item").alias("user"), F.col("user").alias("item"), "rating")


def densify(ratings: DataFrame, limit: int = 50_000_000) -> DataFrame:
    """P10: 0.0 for every (user, item) without a rating. Refused where that makes more than `limit` cells."""
    users, items = ratings.select("user").distinct(), ratings.select("item").distinct()
    if users.count() * items.count() > limit:
        raise ValueError("densify would make too many cells; derive the statistics from the sparse sums")
    return users.crossJoin(items).join(ratings, ["user", "item"], "left").select("user", "item", F.coalesce("rating", F.lit(0.0)).alias("rating"))


def _numbered(ratings: DataFrame) -> bool:
    """Whether users and items are whole numbers, as blocks need them; other names take joins."""
    return all(ratings.schema[c].dataType.typeName() in ("long", "integer", "short", "byte") for c in ("user", "item"))


def _blocks(ratings: DataFrame, row: str, key: str) -> blocks.Packed:
    told = save(ratings.select("user", "item", "rating").where("rating is not null"))
    return blocks.Packed(told, row, key, "rating", told.count())


def co_rated(ratings: DataFrame) -> DataFrame:
    """(u1, u2, r1, r2), u1 < u2, a row for each item that both rated."""
    a = ratings.select("item", F.col("user").alias("u1"), F.col("rating").alias("r1"))
    b = ratings.select("item", F.col("user").alias("u2"), F.col("rating").alias("r2"))
    return a.join(b, "item").where("u1 < u2").drop("item")


def distance_sim() -> Column:
    """A1 over J1: 1 / (1 + sum of squared differences)."""
    return 1 / (1 + F.sum((F.col("r1") - F.col("r2")) * (F.col("r1") - F.col("r2"))))


def pearson_sim() -> Column:
    """A2 over J1 from six sums; 0 where the denominator is 0."""
    n, x, y = F.count("*"), F.sum("r1"), F.sum("r2")
    xx, yy, xy = F.sum(F.col("r1") * F.col("r1")), F.sum(F.col("r2") * F.col("r2")), F.sum(F.col("r1") * F.col("r2"))
    den = F.sqrt(F.greatest((xx - x * x / n) * (yy - y * y / n), F.lit(0.0)))
    # a spread below rounding is none
    return F.when(den > 1e-9, (xy - x * y / n) / den).otherwise(F.lit(0.0))


SIMILARITY = {"distance": distance_sim, "pearson": pearson_sim}


def _distance(n, x, y, xx, yy, xy, d2) -> list:
    return [1 / (1 + d2)]


def _pearson(n, x, y, xx, yy, xy, d2) -> list:
    den = np.sqrt(np.maximum((xx - x * x / n) * (yy - y * y / n), 0.0))
    spread = den > 1e-9  # below rounding is none
    return [np.divide(xy - x * y / n, den, out=np.zeros(len(n)), where=spread)]


def similarities(ratings: DataFrame, similarity: str = "distance") -> DataFrame:
    """(u1, u2, sim), u1 < u2, for users with an item in common, from blocks of users that meet each other: no pair is
    shuffled, and what is written before the result is as large as the ratings."""
    if similarity == "tanimoto":
        return tanimoto(ratings)
    if not _numbered(ratings):
        return co_rated(ratings).groupBy("u1", "u2").agg(SIMILARITY[similarity]().alias("sim"))
    return blocks.pairs(_blocks(ratings, "user", "item"), "u1 long, u2 long, sim double", {"distance": _distance, "pearson": _pearson}[similarity])


def tanimoto(ratings: DataFrame) -> DataFrame:
    """A3: items in common by items of either; the value of an entry is how many its user has."""
    n = ratings.groupBy("user").agg(F.count("*").alias("rating"))
    if not _numbered(ratings):
        both = co_rated(ratings).groupBy("u1", "u2").agg(F.count("*").alias("c")).join(n.toDF("u1", "n1"), "u1").join(n.toDF("u2", "n2"), "u2")
        return both.select("u1", "u2", (F.col("c") / (F.col("n1") + F.col("n2") - F.col("c"))).alias("sim"))
    rows = _blocks(ratings.select("user", "item").join(n, "user"), "user", "item")
    return blocks.pairs(rows, "u1 long, u2 long, sim double", lambda n, x, y, *_: [n / (x / n + y / n - n)])


def shared_items(ratings: DataFrame) -> DataFrame:
    """(u1, u2, shared), how many items both rated."""
    return co_rated(ratings).groupBy("u1", "u2").agg(F.count("*").alias("shared"))


def sims_of(ratings: DataFrame, persons: DataFrame, similarity: str = "distance") -> DataFrame:
    """(user, other, sim) of each user in persons(user) with all others; 0 where nothing is shared."""
    mine = ratings.join(persons.distinct(), "user")
    a = mine.select("item", "user", F.col("rating").alias("r1"))
    b = ratings.select("item", F.col("user").alias("other"), F.col("rating").alias("r2"))
    return a.join(b, "item").where("user <> other").groupBy("user", "other").agg(SIMILARITY[similarity]().alias("sim"))


def top_matches(ratings: DataFrame, persons: DataFrame, n: int = 5, similarity: str = "distance") -> DataFrame:
    """The n users most like each person, by similarity, ties to the larger name. Users without a common
    item have similarity 0 and rank above negative ones: each person's n largest of those are enough."""
    told = sims_of(ratings, persons, similarity).select("user", "other", F.round("sim", 6).alias("sim"))
    # all users have a place by falling name; a person takes the first n places that neither it nor anyone met holds: the
    # f-th free one lies behind f places and all those held that have fewer than f free ones before them
    places = numbered(ratings.select(F.col("user").alias("other")).distinct(), [F.desc("other")], "place")
    held = told.select("user", "other").unionByName(persons.distinct().select("user", F.col("user").alias("other"))).join(places, "other", "left")
    held = held.withColumn("free", F.col("place") - F.row_number().over(Window.partitionBy("user").orderBy("place")))
    free = held.groupBy("user").agg(F.array(*[F.lit(f) + F.count_if(F.col("free") < f) for f in range(1, n + 1)]).alias("places"))
    zero = free.select("user", F.explode("places").alias("place")).join(places, "place").select("user", "other", F.lit(0.0).alias("sim"))
    rank = Window.partitionBy("user").orderBy(F.desc("sim"), F.desc("other"))
    return told.unionByName(zero).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def similar_items(ratings: DataFrame, n: int = 10) -> DataFrame:
    """For each item the n nearest items by A1: (item, other, sim, rank), from blocks of items that meet each other: no
    pair of items is shuffled, but the n best of each item in a row of blocks."""
    if _numbered(ratings):
        told = blocks.nearest_rows(_blocks(ratings, "item", "user"), n)
    else:
        pairs = similarities(transpose(ratings), "distance").withColumn("sim", F.round("sim", 6))
        told = pairs.toDF("item", "other", "sim").union(pairs.select("u2", "u1", "sim"))
    rank = Window.partitionBy("item").orderBy(F.desc("sim"), F.desc("other"))
    return told.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)


def top_user_neighbours(ratings: DataFrame, persons: DataFrame, n: int = 5, similarity: str = "pearson") -> DataFrame:
    """Ratings of each person and of the n most similar users with a similarity above 0."""
    told = sims_of(ratings, persons, similarity).select("user", "other", F.round("sim", 6).alias("sim")).where("sim > 0")
    rank = Window.partitionBy("user").orderBy(F.desc("sim"), F.desc("other"))
    near = told.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n).select("user", "other")
    near = near.unionByName(persons.distinct().select("user", F.col("user").alias("other")))
    return near.join(ratings.withColumnRenamed("user", "other"), "other").select("user", "other", "item", "rating")


def unseen(candidates: DataFrame, ratings: DataFrame, zero_is_unseen: bool) -> DataFrame:
    """Candidates (user, item, ...) that the user has not rated; a rating of 0 may count as none."""
    seen = ratings.where("rating <> 0") if zero_is_unseen else ratings
    return candidates.join(seen.select("user", "item"), ["user", "item"], "left_anti")


def unseen_totals(persons: DataFrame, ratings: DataFrame, zero_is_unseen: bool) -> DataFrame:
    """(user, n, items): how many items each person has not rated, and the sum of their numbers, from the totals of
    all items less what was seen; so no person meets all items. Persons who have seen all have no row."""
    seen = (ratings.where("rating <> 0") if zero_is_unseen else ratings).select("user", "item").distinct()
    whole = ratings.select("item").distinct().agg(F.count("*").alias("all_n"), F.sum("item").alias("all_items"))
    per = seen.join(persons.select("user").distinct(), "user", "right").groupBy("user").agg(F.count("item").alias("n"), F.coalesce(F.sum("item"), F.lit(0)).alias("items"))
    left = per.join(F.broadcast(whole)).select("user", (F.col("all_n") - F.col("n")).alias("n"), (F.col("all_items") - F.col("items")).alias("items"))
    return left.where("n > 0")


def user_recommendations(ratings: DataFrame, persons: DataFrame, similarity: str = "pearson") -> DataFrame:
    """A4: (user, item, score): mean of others' ratings weighted by similarity above 0, for unseen items, from
    blocks of persons that meet blocks of items, so that ratings of the others are not shuffled for each person."""
    sims = sims_of(ratings, persons, similarity).where("sim > 0")
    if not _numbered(ratings):
        rows = sims.join(ratings.select(F.col("user").alias("other"), "item", "rating"), "other")
        return unseen(rows.groupBy("user", "item").agg((F.sum(F.col("sim") * F.col("rating")) / F.sum("sim")).alias("score")), ratings, zero_is_unseen=True)
    sims = save(sims.unionByName(persons.distinct().select("user", F.col("user").alias("other"), F.lit(0.0).alias("sim"))))
    return blocks.weighted_means(blocks.Packed(sims, "user", "other", "sim", sims.count()), _blocks(ratings, "item", "user"))


def item_neighbours_of_user(ratings: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(user, other, sim, rating), a row for each neighbour of each item that a user rated."""
    return ratings.join(neighbours.select("item", "other", "sim"), "item").select("user", "other", "sim", "rating")


def item_recommendations(ratings: DataFrame, neighbours: DataFrame, n: int = 5) -> DataFrame:
    """A5: (user, item, score, rank): the n unseen items with the highest mean rating of their neighbours,
    weighted by similarity; a total similarity of 0 gives no score."""
    near = neighbours.groupBy("item").agg(F.collect_list(F.struct("other", "sim")).alias("near"))
    # rows go to their user with their neighbours in one value; the rest is done there, what the user has rated included
    rows = ratings.join(near, "item", "left").select("user", "item", "rating", F.coalesce("near", F.array().cast(near.schema["near"].dataType)).alias("near")).repartition("user")
    told = F.transform("near", lambda o: F.struct(o["other"].alias("item"), o["sim"].alias("sim"), (o["sim"] * F.col("rating")).alias("part"), F.lit(0).alias("own")))
    rated = F.array(F.struct(F.col("item").alias("item"), F.lit(0.0).alias("sim"), F.lit(0.0).alias("part"), F.lit(1).alias("own")))
    scored = rows.select("user", F.explode(F.concat(told, rated)).alias("o")).select("user", "o.*").groupBy("user", "item").agg(F.sum("sim").alias("s"), F.sum("part").alias("t"), F.max("own").alias("own"))
    scored = scored.where("own = 0 and s > 0").select("user", "item", F.round(F.col("t") / F.col("s"), 6).alias("score"))
    rank = Window.partitionBy("user").orderBy(F.desc("score"), F.desc("item"))
    return scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)

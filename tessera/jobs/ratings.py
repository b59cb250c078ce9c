"""Queries on ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ratings as R
from tessera.sources.tables import RATINGS_SQL, ratings, table


def _persons(r):
    return r.where("user % 20 = 0").select("user").distinct()


def s1_read_ratings(spark, d):
    titles = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey"), F.col("l_partkey").alias("id"), F.col("l_quantity").cast("double").alias("rating"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderdate").alias("ts"))
    scores = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("user", "id", "rating", "ts")
    return R.read_ratings(titles, scores)


def j1_co_rated(spark, d):
    pairs = R.co_rated(ratings(spark, d))
    return pairs.groupBy("u1").agg(F.count("*").alias("pairs"), F.sum("u2").alias("sum_u2"), F.round(F.sum("r1"), 4).alias("sum_r1"), F.round(F.sum("r2"), 4).alias("sum_r2"))


def a1_sim_distance(spark, d):
    return R.similarities(ratings(spark, d), "distance").select("u1", "u2", F.round("sim", 6).alias("sim"))


def a2_sim_pearson(spark, d):
    return R.similarities(ratings(spark, d), "pearson").select("u1", "u2", F.round("sim", 5).alias("sim"))


def a3_sim_tanimoto(spark, d):
    return R.tanimoto(ratings(spark, d)).select("u1", "u2", F.round("sim", 6).alias("sim"))


def w1_top_matches(spark, d):
    r = ratings(spark, d)
    return R.top_matches(r, _persons(r), 5, "distance")


def w2_similar_items(spark, d):
    return R.similar_items(ratings(spark, d), 10)


def w3_top_user_neighbours(spark, d):
    r = ratings(spark, d)
    return R.top_user_neighbours(r, _persons(r), 5, "distance").select("user", "other", "item", F.round("rating", 6).alias("rating"))


def a4_user_recommendations(spark, d):
    r = ratings(spark, d)
    return R.user_recommendations(r, _persons(r), "distance").select("user", "item", F.round("score", 5).alias("score"))


def a5_item_recommendations(spark, d):
    r = ratings(spark, d)
    return R.item_recommendations(r, R.similar_items(r, 10), 5)


def j4_unseen_items(spark, d):
    r = ratings(spark, d)
    return R.unseen_totals(_persons(r), r, zero_is_unseen=True)


def j5_item_neighbours(spark, d):
    r = ratings(spark, d)
    return R.item_neighbours_of_user(r, R.similar_items(r, 10)).groupBy("user").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sim") * F.col("rating")), 3).alias("weighted"))


def p10_densify(spark, d):
    events = table(spark, d, "events").groupBy(F.col("user_id").alias("user"), F.col("event_type").alias("item")).agg(F.sum("value").alias("rating"))
    return R.densify(events).select("user", "item", F.round("rating", 4).alias("rating"))


def p11_transpose(spark, d):
    return R.transpose(ratings(spark, d)).select("user", "item", F.round("rating", 6).alias("rating"))


def u5_shared_keys(spark, d):
    return R.shared_items(ratings(spark, d))


QUERIES = {f.__name__: f for f in (s1_read_ratings, j1_co_rated, a1_sim_distance, a2_sim_pearson, a3_sim_tanimoto, w1_top_matches, w2_similar_items, w3_top_user_neighbours, a4_user_recommendations, a5_item_recommendations, j4_unseen_items, j5_item_neighbours, p10_densify, p11_transpose, u5_shared_keys)}

_PAIRS = RATINGS_SQL + """, pairs AS (
  SELECT a."user" AS u1, b."user" AS u2, a.rating AS r1, b.rating AS r2 FROM ratings a JOIN ratings b ON a.item = b.item AND a."user" < b."user")"""
_PEARSON = "CASE WHEN sqrt(greatest((sum(r1*r1)-sum(r1)*sum(r1)/count(*))*(sum(r2*r2)-sum(r2)*sum(r2)/count(*)),0)) > 1e-9 THEN (sum(r1*r2)-sum(r1)*sum(r2)/count(*))/sqrt(greatest((sum(r1*r1)-sum(r1)*sum(r1)/count(*))*(sum(r2*r2)-sum(r2)*sum(r2)/count(*)),0)) ELSE 0.0 END"
_SIMS = RATINGS_SQL + """, sims AS (
  SELECT a."user", b."user" AS other, 1/(1+sum((a.rating-b.rating)*(a.rating-b.rating))) AS sim
  FROM ratings a JOIN ratings b ON a.item = b.item AND a."user" <> b."user" WHERE a."user" % 20 = 0 GROUP BY 1, 2)"""
_NEAR = RATINGS_SQL + """, ip AS (
  SELECT a.item, b.item AS other, round(1/(1+sum((a.rating-b.rating)*(a.rating-b.rating))), 6) AS sim
  FROM ratings a JOIN ratings b ON a."user" = b."user" AND a.item <> b.item GROUP BY 1, 2),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY sim DESC, other DESC)::INT AS rank FROM ip) WHERE rank <= 10)"""

ORACLE_SQL = {
    "s1_read_ratings": """SELECT "user", title, arg_max(rating, (ts, rating)) AS rating FROM (
  SELECT o_custkey AS "user", p_name AS title, l_quantity::DOUBLE AS rating, o_orderdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2""",
    "j1_co_rated": f"WITH {_PAIRS} SELECT u1, count(*) AS pairs, sum(u2)::BIGINT AS sum_u2, round(sum(r1), 4) AS sum_r1, round(sum(r2), 4) AS sum_r2 FROM pairs GROUP BY u1",
    "a1_sim_distance": f"WITH {_PAIRS} SELECT u1, u2, round(1/(1+sum((r1-r2)*(r1-r2))), 6) AS sim FROM pairs GROUP BY 1, 2",
    "a2_sim_pearson": f"WITH {_PAIRS} SELECT u1, u2, round({_PEARSON}, 5) AS sim FROM pairs GROUP BY 1, 2",
    "a3_sim_tanimoto": f"""WITH {_PAIRS}, n AS (SELECT "user", count(*) AS n FROM ratings GROUP BY 1), c AS (SELECT u1, u2, count(*) AS c FROM pairs GROUP BY 1, 2)
SELECT u1, u2, round(c::DOUBLE/(a.n+b.n-c), 6) AS sim FROM c JOIN n a ON a."user" = u1 JOIN n b ON b."user" = u2""",
    "w1_top_matches": f"""WITH {_SIMS}, users AS (SELECT DISTINCT "user" FROM ratings), every AS (
  SELECT p."user", o."user" AS other, coalesce(round(sim, 6), 0.0) AS sim FROM users p JOIN users o ON p."user" <> o."user"
  LEFT JOIN sims s ON s."user" = p."user" AND s.other = o."user" WHERE p."user" % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY sim DESC, other DESC)::INT AS rank FROM every) WHERE rank <= 5""",
    "w2_similar_items": f"WITH {_NEAR} SELECT item, other, sim, rank FROM near",
    "w3_top_user_neighbours": f"""WITH {_SIMS}, near AS (
  SELECT "user", other FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(sim, 6) DESC, other DESC) AS k FROM sims WHERE round(sim, 6) > 0) WHERE k <= 5
  UNION ALL SELECT DISTINCT "user", "user" FROM ratings WHERE "user" % 20 = 0)
SELECT near."user", other, item, round(rating, 6) AS rating FROM near JOIN ratings r ON r."user" = other""",
    "a4_user_recommendations": f"""WITH {_SIMS}, rec AS (SELECT s."user", item, sum(sim*rating)/sum(sim) AS score FROM sims s JOIN ratings r ON r."user" = s.other WHERE sim > 0 GROUP BY 1, 2)
SELECT rec."user", rec.item, round(score, 5) AS score FROM rec WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = rec."user" AND r.item = rec.item AND r.rating <> 0)""",
    "a5_item_recommendations": f"""WITH {_NEAR}, rec AS (SELECT "user", other AS item, round(sum(sim*rating)/sum(sim), 6) AS score FROM ratings r JOIN near ON near.item = r.item GROUP BY 1, 2 HAVING sum(sim) > 0),
un AS (SELECT * FROM rec WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = rec."user" AND r.item = rec.item))
SELECT "user", item, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY score DESC, item DESC)::INT AS rank FROM un) WHERE rank <= 5""",
    "j4_unseen_items": f"""WITH {RATINGS_SQL}, u AS (SELECT DISTINCT "user" FROM ratings WHERE "user" % 20 = 0), i AS (SELECT DISTINCT item FROM ratings)
SELECT u."user", count(*) AS n, sum(i.item)::BIGINT AS items FROM u, i WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = u."user" AND r.item = i.item AND rating <> 0) GROUP BY 1""",
    "j5_item_neighbours": f"""WITH {_NEAR} SELECT "user", count(*) AS n, round(sum(sim*rating), 3) AS weighted FROM ratings r JOIN near ON near.item = r.item GROUP BY 1""",
    "p10_densify": """WITH e AS (SELECT user_id AS "user", event_type AS item, sum(value) AS rating FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT "user" FROM e), i AS (SELECT DISTINCT item FROM e)
SELECT u."user", i.item, round(coalesce(rating, 0.0), 4) AS rating FROM u CROSS JOIN i LEFT JOIN e ON e."user" = u."user" AND e.item = i.item""",
    "p11_transpose": f"""WITH {RATINGS_SQL} SELECT item AS "user", "user" AS item, round(rating, 6) AS rating FROM ratings""",
    "u5_shared_keys": f"WITH {_PAIRS} SELECT u1, u2, count(*) AS shared FROM pairs GROUP BY 1, 2",
}

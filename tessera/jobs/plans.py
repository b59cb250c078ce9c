"""Queries of plans, expressions and standings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import expressions as E
from tessera.operators import plans as P
from tessera.shared import save
from tessera.sources.tables import table

HUB = "HUB"


def _flights(spark, d):
    li = table(spark, d, "lineitem")
    place = F.concat(F.lit("N"), F.col("l_suppkey") % 6)
    there = F.col("l_orderkey") % 2 == 0
    depart = (300 + F.col("l_partkey") % 900).cast("int")
    rows = li.select(F.when(there, place).otherwise(HUB).alias("origin"), F.when(there, F.lit(HUB)).otherwise(place).alias("dest"), depart.alias("depart_min"), (depart + 60 + 3 * F.col("l_quantity")).cast("int").alias("arrive_min"), F.floor(F.col("l_extendedprice") / 500).cast("int").alias("price"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return P.numbered_flights(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"]).select("origin", "dest", "idx", "depart_min", "arrive_min", "price")


def _people(spark):
    return spark.range(6).select(F.col("id").alias("pos"), F.concat(F.lit("P"), "id").alias("name"), F.concat(F.lit("N"), "id").alias("origin"))


def _candidates(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("cand_id"))
    return n.select("cand_id", _genes(F.col("cand_id")))


def _genes(key):
    """Twelve numbers of no route in particular."""
    return F.array(*[((key * (7_919 * i + 101) + 31 * i) % 1_000_003).cast("int") for i in range(12)]).alias("genes")


def _plan(spark, d, candidates):
    flights = save(_flights(spark, d))
    return P.plan_flights(P.wrapped(candidates, _people(spark), flights, HUB), _people(spark), flights, HUB)


def s5_flights(spark, d):
    return _flights(spark, d)


def j9_plan_flights(spark, d):
    plan = _plan(spark, d, _candidates(spark, d))
    return plan.select("cand_id", "name", F.col("out.price").alias("out_price"), F.col("back.depart_min").alias("back_depart"))


def _cost(spark, d):
    flights = save(_flights(spark, d))
    return lambda c: P.plan_cost(P.plan_flights(P.wrapped(c, _people(spark), flights, HUB), _people(spark), flights, HUB))


def _most(spark, d):
    """The largest number of a flight of any route."""
    return _flights(spark, d).agg(F.max("idx")).first()[0] or 0


def a36_plan_cost(spark, d):
    return _cost(spark, d)(_candidates(spark, d)).select("cand_id", F.col("cost").cast("double").alias("cost"))


def w11_cheapest_plan(spark, d):
    return P.cheapest_plan(a36_plan_cost(spark, d))


def j14_plan_detail(spark, d):
    return P.plan_detail(_plan(spark, d, _candidates(spark, d)), w11_cheapest_plan(spark, d))


ROOMS = ["A", "B", "C", "D", "E"]


def a37_dorm_cost(spark, d):
    prefs = spark.range(10).select(F.col("id").cast("int").alias("pos"), F.expr("array('A','B','C','D','E')[int(id % 5)]").alias("first"), F.expr("array('A','B','C','D','E')[int((id * 3 + 1) % 5)]").alias("second"))
    c = table(spark, d, "part").select(F.col("p_partkey").alias("cand_id"), F.array(*[((F.col("p_partkey") * (i + 3)) % (10 - i)).cast("int") for i in range(10)]).alias("genes"))
    return P.dorm_cost(c, prefs, ROOMS)


def _layouts(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("cand_id"))
    return c.select("cand_id", F.explode(F.array(*[F.struct(F.lit(f"n{i}").alias("name"), (20.0 + (F.col("cand_id") * (i + 3) * 37 + i * 91) % 360).alias("x"), (20.0 + (F.col("cand_id") * (i + 5) * 53 + i * 17) % 360).alias("y")) for i in range(8)])).alias("p")).select("cand_id", "p.name", "p.x", "p.y")


def _friend_links(spark):
    return spark.range(12).select(F.col("id").alias("idx"), F.concat(F.lit("n"), F.col("id") % 8).alias("a"), F.concat(F.lit("n"), (F.col("id") * 3 + 2 + F.floor(F.col("id") / 8)) % 8).alias("b")).where("a <> b")


def j8_segment_crossings(spark, d):
    return P.segment_crossings(_layouts(spark, d), _friend_links(spark))


def a38_layout_cost(spark, d):
    return P.layout_cost(_layouts(spark, d), _friend_links(spark)).select("cand_id", F.round("cost", 6).alias("cost"))


def m10_random_search(spark, d):
    n = table(spark, d, "part").count()
    return P.cheapest_plan(_cost(spark, d)(P.random_candidates(spark, n, 12, _most(spark, d))))


def m11_hill_climb(spark, d):
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("start"), _genes(F.col("s_suppkey")))
    return P.hill_climb(starts, _cost(spark, d), 1_000_002, 3).select("start", F.array_join("genes", ",").alias("genes"), F.col("cost").cast("double").alias("cost"))


def m12_anneal(spark, d):
    starts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("start"), _genes(F.col("s_suppkey")))
    return P.anneal(starts, _cost(spark, d), 1_000_002, cool=0.05).select("start", F.array_join("genes", ",").alias("genes"), F.col("cost").cast("double").alias("cost"))


def m13_genetic(spark, d):
    return P.genetic(spark, _cost(spark, d), 12, _most(spark, d), rounds=3).select("cand_id", F.array_join("genes", ",").alias("genes"), F.col("cost").cast("double").alias("cost"))


def _hidden(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_linenumber").cast("double").alias("y"))
    return li.withColumn("target", F.col("x") * F.col("x") + 2 * F.col("y") + 3 * F.col("x") + 5)


TREES = [("add", ("square", "x"), ("add", ("multiply", 2, "y"), ("add", ("multiply", 3, "x"), 5))), ("multiply", "x", "y"), ("if", ("isgreater", "x", 25), ("square", "x"), "y"), ("euclidean", "x", ("parity", "y")), ("subtract", "x", 7)]


def a39_score_expressions(spark, d):
    rows = _hidden(spark, d)
    scored = rows.agg(*[F.round(F.sum(F.abs(E.compile_tree(t) - F.col("target"))), 2).alias(f"t{i}") for i, t in enumerate(TREES)])
    return scored.unpivot([], [f"t{i}" for i in range(len(TREES))], "tree", "score")


def m21_evolve(spark, d):
    tree, score = E.evolve(_hidden(spark, d), ["x", "y"], 20, 2)
    return spark.createDataFrame([(repr(tree), float(score))], "tree string, score double")


def a40_standings(spark, d):
    m = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("p1"), (F.col("o_orderkey") % 50).alias("p2"), (F.col("o_orderkey") % 3 - 1).alias("winner"))
    return E.standings(m)


QUERIES = {f.__name__: f for f in (s5_flights, j9_plan_flights, a36_plan_cost, w11_cheapest_plan, j14_plan_detail, a37_dorm_cost, j8_segment_crossings, a38_layout_cost, m10_random_search, m11_hill_climb, m12_anneal, m13_genetic, a39_score_expressions, m21_evolve, a40_standings)}

_F = """f AS (SELECT * FROM (SELECT origin, dest, depart_min, arrive_min, price, row_number() OVER (PARTITION BY origin, dest ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, price)::INT - 1 AS idx FROM (
  SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'N' || ((l_suppkey % 6)::VARCHAR) ELSE 'HUB' END AS origin, CASE WHEN l_orderkey % 2 = 0 THEN 'HUB' ELSE 'N' || ((l_suppkey % 6)::VARCHAR) END AS dest, (300 + l_partkey % 900)::INT AS depart_min,
  (300 + l_partkey % 900 + 60 + 3 * l_quantity)::INT AS arrive_min, floor(l_extendedprice / 500)::INT AS price, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)))"""
_PLAN = _F + """, g AS (SELECT p_partkey AS cand_id, i // 2 AS pos, i % 2 AS way, (p_partkey * (7919 * i + 101) + 31 * i) % 1000003 AS gene FROM part, generate_series(0, 11) t(i)),
rn AS (SELECT origin, dest, count(*) AS n FROM f GROUP BY 1, 2),
pl AS (SELECT g.cand_id, g.pos, g.way, f.depart_min, f.arrive_min, f.price FROM g JOIN rn ON rn.origin = CASE WHEN way = 0 THEN 'N' || (pos::VARCHAR) ELSE 'HUB' END AND rn.dest = CASE WHEN way = 0 THEN 'HUB' ELSE 'N' || (pos::VARCHAR) END JOIN f ON f.idx = g.gene % rn.n AND f.origin = CASE WHEN way = 0 THEN 'N' || (pos::VARCHAR) ELSE 'HUB' END AND f.dest = CASE WHEN way = 0 THEN 'HUB' ELSE 'N' || (pos::VARCHAR) END),
p2 AS (SELECT o.cand_id, 'P' || (o.pos::VARCHAR) AS name, o.depart_min AS od, o.arrive_min AS oa, o.price AS op, b.depart_min AS bd, b.arrive_min AS ba, b.price AS bp FROM pl o JOIN pl b ON b.cand_id = o.cand_id AND b.pos = o.pos WHERE o.way = 0 AND b.way = 1),
cost AS (SELECT cand_id, (sum(op + bp) + 0.5 * sum(oa - od + ba - bd) + 20 * sum((od < 480)::INT + (bd < 480)::INT) + count(*) * max(oa) - sum(oa) + sum(bd) - count(*) * min(bd) + CASE WHEN max(oa) > min(bd) THEN 50 ELSE 0 END)::DOUBLE AS cost FROM p2 GROUP BY 1)"""
_LAY = """l AS (SELECT s_suppkey AS cand_id, 'n' || (i::VARCHAR) AS name, 20.0::DOUBLE + (s_suppkey * (i + 3) * 37 + i * 91) % 360 AS x, 20.0::DOUBLE + (s_suppkey * (i + 5) * 53 + i * 17) % 360 AS y FROM supplier, generate_series(0, 7) t(i)),
k AS (SELECT * FROM (SELECT i AS idx, 'n' || ((i % 8)::VARCHAR) AS a, 'n' || (((i * 3 + 2 + i // 8) % 8)::VARCHAR) AS b FROM generate_series(0, 11) t(i)) WHERE a <> b),
s AS (SELECT p.cand_id, idx, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2 FROM k JOIN l p ON p.name = a JOIN l q ON q.name = b AND q.cand_id = p.cand_id),
u AS (SELECT a.cand_id, ((b.x2-b.x1)*(a.y1-b.y1)-(b.y2-b.y1)*(a.x1-b.x1)) / nullif((b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1), 0) AS ua, ((a.x2-a.x1)*(a.y1-b.y1)-(a.y2-a.y1)*(a.x1-b.x1)) / nullif((b.y2-b.y1)*(a.x2-a.x1)-(b.x2-b.x1)*(a.y2-a.y1), 0) AS ub FROM s a JOIN s b ON a.cand_id = b.cand_id AND a.idx < b.idx),
x AS (SELECT cand_id, count(*) FILTER (WHERE ua > 0 AND ua < 1 AND ub > 0 AND ub < 1) AS crossings FROM u GROUP BY 1)"""

ORACLE_SQL = {
    "s5_flights": f"WITH {_F} SELECT origin, dest, idx, depart_min, arrive_min, price FROM f",
    "j9_plan_flights": f"WITH {_PLAN} SELECT cand_id, name, op AS out_price, bd AS back_depart FROM p2",
    "a36_plan_cost": f"WITH {_PLAN} SELECT cand_id, cost FROM cost",
    "w11_cheapest_plan": f"WITH {_PLAN} SELECT cand_id, cost FROM cost ORDER BY cost, cand_id LIMIT 1",
    "j14_plan_detail": f"WITH {_PLAN} SELECT name, od AS out_depart, oa AS out_arrive, op AS out_price, bd AS back_depart, ba AS back_arrive, bp AS back_price FROM p2 WHERE cand_id = (SELECT cand_id FROM cost ORDER BY cost, cand_id LIMIT 1)",
    "j8_segment_crossings": f"WITH {_LAY} SELECT cand_id, crossings FROM x",
    "a38_layout_cost": f"WITH {_LAY}, n AS (SELECT a.cand_id, sum(CASE WHEN sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) < 50 THEN 1 - sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2))/50 ELSE 0 END) AS near FROM l a JOIN l b ON a.cand_id = b.cand_id AND a.name < b.name GROUP BY 1) SELECT n.cand_id, round(coalesce(crossings, 0) + near, 6) AS cost FROM n LEFT JOIN x USING (cand_id)",
    "a39_score_expressions": """WITH h AS (SELECT l_quantity::DOUBLE AS x, l_linenumber::DOUBLE AS y, l_quantity*l_quantity + 2*l_linenumber + 3*l_quantity + 5 AS t FROM lineitem)
SELECT 't0' AS tree, round(sum(abs(x*x+2*y+3*x+5-t)), 2) AS score FROM h UNION ALL SELECT 't1', round(sum(abs(x*y-t)), 2) FROM h UNION ALL SELECT 't2', round(sum(abs(CASE WHEN x > 25 THEN x*x ELSE y END - t)), 2) FROM h UNION ALL SELECT 't3', round(sum(abs(sqrt(x*x + pow(floor(y)::BIGINT % 2, 2)) - t)), 2) FROM h UNION ALL SELECT 't4', round(sum(abs(x-7-t)), 2) FROM h""",
    "a40_standings": "WITH m AS (SELECT o_custkey % 50 AS p1, o_orderkey % 50 AS p2, o_orderkey % 3 - 1 AS w FROM orders) SELECT player, sum(points)::BIGINT AS points FROM (SELECT p1 AS player, CASE w WHEN 1 THEN 2 WHEN -1 THEN 1 ELSE 0 END AS points FROM m UNION ALL SELECT p2, CASE w WHEN 0 THEN 2 WHEN -1 THEN 1 ELSE 0 END FROM m) GROUP BY 1",
}

ORACLE_SQL["a37_dorm_cost"] = """
WITH RECURSIVE r AS (
  SELECT p_partkey AS cand_id, 0 AS pos, ['A','A','B','B','C','C','D','D','E','E'] AS l, 0 AS cost FROM part
  UNION ALL
  SELECT cand_id, pos + 1, list_concat(l[1:g], l[g + 2:]), cost + CASE l[g + 1] WHEN ['A','B','C','D','E'][pos % 5 + 1] THEN 0 WHEN ['A','B','C','D','E'][(pos * 3 + 1) % 5 + 1] THEN 1 ELSE 3 END
  FROM (SELECT *, least((cand_id * (pos + 3)) % (10 - pos), len(l) - 1) AS g FROM r WHERE pos < 10))
SELECT cand_id, cost::BIGINT AS cost FROM r WHERE pos = 10"""

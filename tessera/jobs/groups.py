"""Queries of trees, clusters and factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cluster as C
from tessera.operators import factor as N
from tessera.operators import tree as T
from tessera.sources.tables import table

NUMBERS, WORDS = ["price", "month"], ["priority"]


def _rows(spark, d):
    o = table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 10 != 0, F.floor(F.col("o_totalprice") / 20000).cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), price.alias("price"), F.month("o_orderdate").cast("double").alias("month"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("value"))


def a26_impurity(spark, d):
    return T.impurity(_rows(spark, d), ["priority"]).select("priority", "n", F.round("gini", 6).alias("gini"), F.round("entropy", 6).alias("entropy"))


def a26_variance(spark, d):
    return T.label_variance(_rows(spark, d), ["priority"], "value").select("priority", "n", F.round(F.col("variance") / 1e6, 3).alias("variance"))


def _gains(spark, d):
    rows = _rows(spark, d)
    return T.split_gains(T.long_rows(rows, NUMBERS, WORDS, "label"), rows.select("id", F.lit(1).cast("long").alias("node")))


def a27_split_gain(spark, d):
    return _gains(spark, d).select("col", "num", "word", "n", "n_true", F.round("gain", 7).alias("gain"))


def w9_best_split(spark, d):
    return T.best_splits(_gains(spark, d)).select("node", "col", "num", "word", F.round("gain", 7).alias("gain"))


def a28_multiway_split(spark, d):
    return T.multiway_gains(_rows(spark, d).where("price is not null"), "price", [2.0, 5.0, 8.0, 11.0]).select(F.array_join(F.transform("cuts", lambda c: c.cast("int").cast("string")), ",").alias("cuts"), F.round("gain", 7).alias("gain"))


def _tree(spark, d):
    return T.grow_tree(_rows(spark, d), NUMBERS, WORDS, "label", 0.0001, 3)


def m5_grow_tree(spark, d):
    return _tree(spark, d).select("node", "col", "num", "word", F.round("gain", 7).alias("gain"), F.to_json("counts").alias("counts"))


def m6_prune_tree(spark, d):
    return T.prune_tree(_tree(spark, d), 0.002).select("node", "col", F.to_json("counts").alias("counts"))


def m7_tree_classify(spark, d):
    return T.tree_classify(_rows(spark, d), _tree(spark, d), NUMBERS, WORDS).select("id", "label", F.round("share", 6).alias("share"))


def m5_gini(spark, d):
    return T.grow_tree(_rows(spark, d), NUMBERS, WORDS, "label", 0.0, 2, "gini").select("node", "col", "num", "word", F.round("gain", 7).alias("gain"), F.to_json("counts").alias("counts"))


def _priced(spark, d):
    o = table(spark, d, "orders")
    month = F.when(F.col("o_orderkey") % 10 != 0, F.month("o_orderdate").cast("double"))
    return o.select(F.col("o_orderkey").alias("id"), month.alias("month"), (F.col("o_custkey") % 40).cast("double").alias("desk"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_totalprice").cast("double") / 100000).alias("value"))


def _regression(spark, d):
    return T.grow_tree(_priced(spark, d), ["month", "desk"], ["priority", "status"], "value", 0.0, 2, "variance")


def m5_regression(spark, d):
    return _regression(spark, d).select("node", "col", "num", "word", F.round("gain", 6).alias("gain"), "n", F.round("mean", 6).alias("mean"))


def m5_multiway(spark, d):
    tree = T.grow_multiway(_rows(spark, d), NUMBERS, WORDS, "label", 0.0001, 2, 2)
    return tree.select("node", "col", F.array_join(F.transform("nums", lambda x: x.cast("int").cast("string")), ",").alias("nums"), F.array_join("words", ",").alias("words"), F.round("gain", 7).alias("gain"), F.to_json("counts").alias("counts"))


def m7_ranges(spark, d):
    """Observations of a range of prices, through the tree of two levels."""
    low = (F.col("id") % 13).cast("double")
    rows = _rows(spark, d).withColumn("price", F.struct(low.alias("low"), (low + F.col("id") % 4).alias("high"))).drop("label")
    tree = T.grow_tree(_rows(spark, d), NUMBERS, WORDS, "label", 0.0001, 2)
    return T.tree_classify(rows, tree, NUMBERS, WORDS).select("id", "label", F.round("share", 6).alias("share"))


def m7_estimate(spark, d):
    return T.tree_estimate(_priced(spark, d), _regression(spark, d), ["month", "desk"], ["priority", "status"]).select("id", F.round("guess", 6).alias("guess"))


def _cells(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("row"), F.col("event_type").alias("col")).agg(F.count("*").cast("double").alias("value"))


def _event_vectors(spark, d):
    kinds = [r[0] for r in table(spark, d, "events").select("event_type").distinct().orderBy("event_type").collect()]
    wide = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).pivot("event_type", kinds).agg(F.count(F.lit(1))).fillna(0)
    return wide.select("id", F.array(*[F.col(f"`{k}`").cast("double") for k in kinds]).alias("features"))


def a11_vector_distances(spark, d):
    v = _event_vectors(spark, d)
    a, b = v.select(F.col("id").alias("i"), F.col("features").alias("a")), v.select(F.col("id").alias("j"), F.col("features").alias("b"))
    pairs = a.join(b, F.col("i") < F.col("j"))
    return pairs.select("i", "j", *[F.round(C.DISTANCES[n](F.col("a"), F.col("b")), 6).alias(n) for n in ("pearson", "tanimoto", "euclid", "pythagoras", "manhattan")])


def j7_all_pairs(spark, d):
    return C.all_pairs(_event_vectors(spark, d), "straight").select("i", "j", F.round("d", 6).alias("d"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _start(spark, d, k):
    return [(r["id"], list(r["features"])) for r in _vectors(spark, d).orderBy("id").limit(k).collect()]


def m2_kmeans(spark, d):
    return C.kmeans(_vectors(spark, d), _start(spark, d, 6), 3)[0].select("id", "cluster", F.round("d", 6).alias("d"))


def m2_kmeans_pearson(spark, d):
    return C.kmeans(_vectors(spark, d), _start(spark, d, 6), 3, "pearson")[0].select("id", "cluster", F.round("d", 6).alias("d"))


def m2_kmeans_random(spark, d):
    """From eight random centroids in the ranges of the columns, until nothing moves."""
    return C.kmeans(_vectors(spark, d), 8, 20)[0].select("id", "cluster", F.round("d", 6).alias("d"))


def a42_kmeans_total(spark, d):
    rows = None
    for k in (4, 8):
        one = C.kmeans_total(C.kmeans(_vectors(spark, d), _start(spark, d, k), 10)[0]).select(F.lit(k).alias("k"), F.round("total", 4).alias("total"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def s10_cluster_report(spark, d):
    names = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id")).alias("label"))
    return C.cluster_report(C.kmeans(_vectors(spark, d), _start(spark, d, 6), 3)[0], names)


def _nation_vectors(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    kinds = [r[0] for r in o.select("o_orderpriority").distinct().orderBy(1).collect()]
    wide = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").cast("long").alias("id")).pivot("o_orderpriority", kinds).agg(F.count(F.lit(1))).fillna(0)
    return wide.select("id", F.array(*[F.col(f"`{k}`").cast("double") for k in kinds]).alias("features"))


def m3_hcluster(spark, d):
    return C.hcluster(_nation_vectors(spark, d), "straight").select("id", "left", "right", F.round("distance", 6).alias("distance"))


def m3_hcluster_rounds(spark, d):
    return C.hcluster(_nation_vectors(spark, d), "straight", all_nearest=True).select("id", "left", "right", F.round("distance", 6).alias("distance"), "round")


def m3_heights(spark, d):
    """A tree of merges over the keys of parts: -k merges 2k and 2k + 1, which are merges themselves as far as keys go."""
    parts = table(spark, d, "part").where("p_partkey > 0").select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_retailprice").cast("double") / 1000).alias("distance"))
    child = lambda c: F.when(c <= F.col("n"), -c).otherwise(c)
    merges = parts.join(F.broadcast(parts.agg(F.max("k").alias("n")))).select((-F.col("k")).alias("id"), child(F.col("k") * 2).alias("left"), child(F.col("k") * 2 + 1).alias("right"), "distance")
    return C.heights(merges).select("id", "height", F.round("depth", 6).alias("depth"))


def m4_mds(spark, d):
    return C.mds(_nation_vectors(spark, d), "pearson", rounds=3)


def m4_mds_step(spark, d):
    v = _nation_vectors(spark, d)
    points = v.select("id", (F.col("id") % 5).cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    moved, _ = C.mds_step(points, C.all_pairs(v, "straight"), 0.01)
    return moved.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def a35_matrix_cost(spark, d):
    a = _cells(spark, d)
    b = table(spark, d, "events").where("value > 1").groupBy(F.col("user_id").alias("row"), F.col("event_type").alias("col")).agg(F.count("*").cast("double").alias("value"))
    return N.matrix_cost(a, b).select(F.round("cost", 4).alias("cost"))


def m14_nmf(spark, d):
    rows, cols, cost = N.nmf(_cells(spark, d), 3, 3)
    return cols.select("key", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)], F.lit(cost).alias("cost"))


def m14_nmf_step(spark, d):
    """One update of both sides from given factors."""
    cells = _cells(spark, d)
    start = lambda n: F.array(*[((n * (2 * i + 3) + i) % 11 + 1) / 11.0 for i in range(3)]).alias("f")
    rows = cells.select(F.col("row").alias("key")).distinct().select("key", start(F.col("key")))
    cols = cells.select(F.col("col").alias("key")).distinct().select("key", start(F.length("key")))
    rows, cols = N.nmf_step(cells, rows, cols, 3)
    told = rows.select(F.col("key").cast("string").alias("key"), "f").union(cols.select("key", "f"))
    return told.select("key", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)])


def m15_nmf_projected(spark, d):
    rows, cols, cost = N.nmf_projected(_cells(spark, d), 3, 2)
    return cols.select("key", *[F.round(F.col("f")[i], 6).alias(f"f{i}") for i in range(3)], F.lit(cost).alias("cost"))


def w8_feature_tops(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("f"))
    return N.heaviest(v, 6).select(F.col("feature").cast("long").alias("feature"), "key", F.round("weight", 6).alias("weight"), "k")


def w10_aligned_series(spark, d):
    li, s, n = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "nation")
    volumes = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("ticker"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("volume"))
    names = [r[0] for r in volumes.select("ticker").distinct().orderBy("ticker").collect()]
    wide = N.aligned_series(volumes, names)
    return wide.unpivot(["k"], names, "ticker", "volume").select("k", "ticker", F.round("volume", 4).alias("volume"))


QUERIES = {f.__name__: f for f in (a26_impurity, a26_variance, a27_split_gain, w9_best_split, a28_multiway_split, m5_grow_tree, m5_gini, m5_regression, m5_multiway, m6_prune_tree, m7_tree_classify, m7_ranges, m7_estimate, a11_vector_distances, j7_all_pairs, m2_kmeans, m2_kmeans_pearson, m2_kmeans_random, m3_heights, a42_kmeans_total, s10_cluster_report, m3_hcluster, m3_hcluster_rounds, m4_mds, m4_mds_step, a35_matrix_cost, m14_nmf, m14_nmf_step, m15_nmf_projected, w8_feature_tops, w10_aligned_series)}

_R = "r AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice / 20000)::DOUBLE END AS price, month(o_orderdate)::DOUBLE AS month, o_orderpriority AS priority, o_orderstatus AS label, o_totalprice AS value FROM orders)"
_H = "(SELECT -sum(c / t * log2(c / t)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER () AS t FROM r {0} GROUP BY label))"
_G = f"""{_R}, l AS (SELECT id, label, 'price' AS col, price AS num, NULL::VARCHAR AS word FROM r UNION ALL SELECT id, label, 'month', month, NULL FROM r UNION ALL SELECT id, label, 'priority', NULL, priority FROM r),
v AS (SELECT DISTINCT col, num, word FROM l WHERE num IS NOT NULL OR word IS NOT NULL),
c AS (SELECT v.col, v.num, v.word, l.label, count(*) FILTER (WHERE l.num IS NULL AND l.word IS NULL OR l.num >= v.num OR l.word = v.word)::DOUBLE AS y, count(*) FILTER (WHERE l.num IS NULL AND l.word IS NULL OR NOT (coalesce(l.num >= v.num, FALSE) OR coalesce(l.word = v.word, FALSE)))::DOUBLE AS x, count(*)::DOUBLE AS a
  FROM v JOIN l ON l.col = v.col GROUP BY 1, 2, 3, 4),
s AS (SELECT *, sum(y) OVER w AS ty, sum(x) OVER w AS tx, sum(a) OVER w AS ta FROM c WINDOW w AS (PARTITION BY col, num, word)),
g AS (SELECT col, num, word, any_value(ta)::BIGINT AS n, any_value(ty)::BIGINT AS n_true,
  sum(CASE WHEN a > 0 THEN -a/ta*log2(a/ta) ELSE 0 END) - any_value(ty/ta) * sum(CASE WHEN y > 0 THEN -y/ty*log2(y/ty) ELSE 0 END) - (1 - any_value(ty/ta)) * sum(CASE WHEN x > 0 THEN -x/tx*log2(x/tx) ELSE 0 END) AS gain
  FROM s WHERE ty > 0 AND tx > 0 GROUP BY 1, 2, 3)"""
_E = "k AS (SELECT list(event_type ORDER BY event_type) AS ks FROM (SELECT DISTINCT event_type FROM events)), m AS (SELECT user_id AS id, event_type, count(*) AS n FROM events GROUP BY 1, 2), v AS (SELECT u.id, list(coalesce(m.n, 0)::DOUBLE ORDER BY e.event_type) AS f FROM (SELECT DISTINCT id FROM m) u CROSS JOIN (SELECT DISTINCT event_type FROM events) e LEFT JOIN m ON m.id = u.id AND m.event_type = e.event_type GROUP BY 1), p AS (SELECT a.id AS i, b.id AS j, a.f AS x, b.f AS y, len(a.f) AS n FROM v a JOIN v b ON a.id < b.id)"
_D2 = "list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] - y[i]) * (x[i] - y[i])))"
_DEN = "sqrt(greatest((list_dot_product(x, x) - pow(list_sum(x), 2)/n) * (list_dot_product(y, y) - pow(list_sum(y), 2)/n), 0))"
_BOTH = "list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] <> 0 AND y[i] <> 0)::INT))"
_EITHER = "list_sum(list_transform(generate_series(1, len(x)), lambda i: (x[i] <> 0 OR y[i] <> 0)::INT))"


def _kmeans_sql(k: int, rounds: int, distance: str = "squares") -> str:
    sql = f"v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS f FROM embeddings), c0 AS MATERIALIZED (SELECT id AS cluster, f FROM v ORDER BY id LIMIT {k})"
    dist = "list_sum(list_transform(generate_series(1, len(v.f)), lambda i: (v.f[i] - c.f[i]) * (v.f[i] - c.f[i])))"
    if distance == "pearson":
        den = "sqrt(greatest((list_dot_product(v.f, v.f) - pow(list_sum(v.f), 2) / len(v.f)) * (list_dot_product(c.f, c.f) - pow(list_sum(c.f), 2) / len(v.f)), 0))"
        dist = f"(CASE WHEN {den} > 1e-12 THEN 1 - (list_dot_product(v.f, c.f) - list_sum(v.f) * list_sum(c.f) / len(v.f)) / {den} ELSE 0 END)"
    for r in range(rounds + 1):
        sql += f", a{r} AS MATERIALIZED (SELECT id, f, cluster, d2 FROM (SELECT v.id, v.f, c.cluster, {dist} AS d2, row_number() OVER (PARTITION BY v.id ORDER BY round({dist}, 12), c.cluster) AS k FROM v, c{r} c) WHERE k = 1)"
        if r < rounds:
            sql += f", c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.f, c.f) AS f FROM c{r} c LEFT JOIN (SELECT cluster, list(x ORDER BY pos) AS f FROM (SELECT cluster, pos, avg(x) AS x FROM (SELECT cluster, unnest(f) AS x, generate_subscripts(f, 1) AS pos FROM a{r}) GROUP BY 1, 2) GROUP BY 1) m ON m.cluster = c.cluster)"
    return sql


_PRICED = "v0 AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 <> 0 THEN month(o_orderdate)::DOUBLE END AS month, (o_custkey % 40)::DOUBLE AS desk, o_orderpriority AS priority, o_orderstatus AS status, o_totalprice::DOUBLE / 100000 AS label FROM orders)"
_LONG = "l AS (SELECT id, label, 'price' AS col, price AS num, NULL::VARCHAR AS word FROM r UNION ALL SELECT id, label, 'month', month, NULL FROM r UNION ALL SELECT id, label, 'priority', NULL, priority FROM r)"
_LONG_PRICED = "l AS (SELECT id, label, 'month' AS col, month AS num, NULL::VARCHAR AS word FROM v0 UNION ALL SELECT id, label, 'desk', desk, NULL FROM v0 UNION ALL SELECT id, label, 'priority', NULL, priority FROM v0 UNION ALL SELECT id, label, 'status', NULL, status FROM v0)"
_YES = "(l.num IS NULL AND l.word IS NULL OR l.num >= b.num OR l.word = b.word)"
_NO = "(l.num IS NULL AND l.word IS NULL OR NOT (coalesce(l.num >= b.num, FALSE) OR coalesce(l.word = b.word, FALSE)))"


def _tree_sql(depth: int, score: str, min_gain: float, base: str, long: str, rows: str) -> str:
    """Tables of a tree, level by level: at<k>(id, node, w) where rows stand, with the weight that classification gives
    them, and b<k> the best tests. Every test of every node is counted against all its rows."""
    sql = f"{base}, {long}, at0 AS MATERIALIZED (SELECT id, 1::BIGINT AS node, 1.0::DOUBLE AS w FROM {rows})"
    for k in range(depth):
        sql += f", x{k} AS MATERIALIZED (SELECT node, l.* FROM l JOIN at{k} USING (id)), t{k} AS (SELECT DISTINCT node, col, num, word FROM x{k} WHERE num IS NOT NULL OR word IS NOT NULL)"
        pairs = f"FROM t{k} b JOIN x{k} l ON l.node = b.node AND l.col = b.col"
        if score == "variance":
            sql += f", m{k} AS (SELECT b.node, b.col, b.num, b.word, count(*)::DOUBLE AS n, var_pop(l.label) AS v, count(*) FILTER (WHERE {_YES})::DOUBLE AS ty, var_pop(l.label) FILTER (WHERE {_YES}) AS vy, count(*) FILTER (WHERE {_NO}) AS tx, var_pop(l.label) FILTER (WHERE {_NO}) AS vx {pairs} GROUP BY 1, 2, 3, 4), g{k} AS (SELECT node, col, num, word, v - ty / n * vy - (1 - ty / n) * vx AS gain FROM m{k} WHERE ty > 0 AND tx > 0)"
        else:
            part = "sum(CASE WHEN {0} > 0 THEN -{0}/{1}*log2({0}/{1}) ELSE 0 END)" if score == "entropy" else "(1 - sum({0}/{1}*{0}/{1}))"
            sql += f", c{k} AS (SELECT b.node, b.col, b.num, b.word, l.label, count(*) FILTER (WHERE {_YES})::DOUBLE AS y, count(*) FILTER (WHERE {_NO})::DOUBLE AS x, count(*)::DOUBLE AS a {pairs} GROUP BY 1, 2, 3, 4, 5), s{k} AS (SELECT *, sum(y) OVER w AS ty, sum(x) OVER w AS tx, sum(a) OVER w AS ta FROM c{k} WINDOW w AS (PARTITION BY node, col, num, word))"
            sql += f", g{k} AS (SELECT node, col, num, word, {part.format('a', 'ta')} - any_value(ty/ta) * {part.format('y', 'ty')} - (1 - any_value(ty/ta)) * {part.format('x', 'tx')} AS gain FROM s{k} WHERE ty > 0 AND tx > 0 GROUP BY 1, 2, 3, 4)"
        sql += f", b{k} AS MATERIALIZED (SELECT node, col, num, word, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, col, num, word) AS k FROM g{k}) WHERE k = 1 AND gain > {min_gain} + 1e-9)"
        sql += f", p{k} AS (SELECT at{k}.id, at{k}.w, b.node, CASE WHEN b.num IS NOT NULL THEN l.num >= b.num ELSE l.word = b.word END AS passed FROM at{k} JOIN b{k} b USING (node) JOIN l ON l.id = at{k}.id AND l.col = b.col)"
        sql += f", z{k} AS MATERIALIZED (SELECT id, w, passed, node, unnest(CASE WHEN passed IS NULL THEN [2 * node, 2 * node + 1] WHEN passed THEN [2 * node] ELSE [2 * node + 1] END) AS child FROM p{k}), n{k} AS (SELECT node, child, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY node) AS both FROM z{k} GROUP BY 1, 2)"
        sql += f", at{k + 1} AS MATERIALIZED (SELECT id, z.child AS node, CASE WHEN passed IS NULL THEN w * m.n / m.both ELSE w END AS w FROM z{k} z JOIN n{k} m ON m.node = z.node AND m.child = z.child)"
    return sql


def _tree_nodes_sql(depth: int, labels: bool, rows: str, digits: int) -> str:
    """Nodes of all levels with what they tell."""
    what = """'{' || string_agg('"' || label || '":' || c, ',' ORDER BY label) || '}' AS counts""" if labels else "sum(c)::BIGINT AS n, round(sum(s) / sum(c), 6) AS mean"
    per = "count(*) AS c" if labels else "count(*) AS c, sum(label) AS s"
    tests = [f"b{k}" for k in range(depth)] + ["(SELECT * FROM b0 LIMIT 0)"]
    return " UNION ALL ".join(f"SELECT e.node, b.col, b.num, b.word, round(b.gain, {digits}) AS gain, e.* EXCLUDE (node) FROM (SELECT node, {what} FROM (SELECT node, label, {per} FROM at{k} JOIN {rows} USING (id) GROUP BY 1, 2) GROUP BY 1) e LEFT JOIN {b} b ON b.node = e.node" for k, b in enumerate(tests))


def _leaves_sql(depth: int) -> str:
    return " UNION ALL ".join(f"SELECT at{k}.* FROM at{k}" + (f" ANTI JOIN b{k} USING (node)" if k < depth else "") for k in range(depth + 1))


def _pruned_sql(depth: int, min_gain: float) -> str:
    """A grown tree without pairs of leaves that tell little more than both together, from the bottom up."""
    h = "SELECT node, -sum(c / n * log2(c / n)) AS h FROM (SELECT *, sum(c) OVER (PARTITION BY node) AS n FROM {0}) GROUP BY 1"
    inner = " UNION ALL ".join(f"SELECT node, col FROM b{k}" for k in range(depth))
    sql = f"f0 AS (SELECT node, label, count(*)::DOUBLE AS c FROM ({_leaves_sql(depth)}) JOIN r USING (id) GROUP BY 1, 2), i0 AS ({inner})"
    for k in range(depth):
        sql += f", u{k} AS (SELECT node // 2 AS node, label, sum(c) AS c FROM f{k} WHERE node // 2 IN (SELECT node // 2 FROM f{k} WHERE node > 1 GROUP BY 1 HAVING count(DISTINCT node) = 2) GROUP BY 1, 2)"
        sql += f", e{k} AS (SELECT u.node FROM ({h.format(f'u{k}')}) u JOIN ({h.format(f'f{k}')}) f ON f.node // 2 = u.node GROUP BY 1 HAVING any_value(u.h) - sum(f.h) / 2 < {min_gain})"
        sql += f", f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} WHERE node // 2 NOT IN (SELECT node FROM e{k}) UNION ALL SELECT * FROM u{k} WHERE node IN (SELECT node FROM e{k})), i{k + 1} AS MATERIALIZED (SELECT * FROM i{k} WHERE node NOT IN (SELECT node FROM e{k}))"
    inside = " UNION ALL ".join(f"SELECT node, label, count(*) AS c FROM at{k} JOIN r USING (id) GROUP BY 1, 2" for k in range(depth))
    counts = """'{' || string_agg('"' || label || '":' || c::BIGINT, ',' ORDER BY label) || '}' AS counts"""
    return f"{sql} SELECT node, NULL::VARCHAR AS col, {counts} FROM f{depth} GROUP BY 1 UNION ALL SELECT i.node, any_value(col), {counts} FROM i{depth} i JOIN ({inside}) x USING (node) GROUP BY 1"


def _ranges_sql() -> str:
    """Observations of a range, through two levels: to both branches that it touches, by the rows of these."""
    sql = "nodes AS (SELECT node, count(*)::DOUBLE AS n FROM (SELECT node FROM at0 UNION ALL SELECT node FROM at1 UNION ALL SELECT node FROM at2) GROUP BY 1), q0 AS (SELECT id, (id % 13)::DOUBLE AS low, (id % 13 + id % 4)::DOUBLE AS high, month, priority, 1::BIGINT AS node, 1.0::DOUBLE AS w FROM r)"
    for k in range(2):
        sql += f", f{k} AS (SELECT q.*, CASE WHEN b.col = 'price' THEN CASE WHEN low >= b.num THEN TRUE WHEN high < b.num THEN FALSE END WHEN b.col = 'month' THEN month >= b.num ELSE priority = b.word END AS passed FROM q{k} q JOIN b{k} b USING (node)), e{k} AS (SELECT *, unnest(CASE WHEN passed IS NULL THEN [2 * node, 2 * node + 1] WHEN passed THEN [2 * node] ELSE [2 * node + 1] END) AS child FROM f{k})"
        sql += f", q{k + 1} AS (SELECT id, low, high, month, priority, child AS node, CASE WHEN passed IS NULL THEN w * a.n / (a.n + o.n) ELSE w END AS w FROM e{k} JOIN nodes a ON a.node = child JOIN nodes o ON o.node = xor(child, 1))"
    return sql + ", done AS (SELECT id, node, w FROM q0 ANTI JOIN b0 USING (node) UNION ALL SELECT id, node, w FROM q1 ANTI JOIN b1 USING (node) UNION ALL SELECT id, node, w FROM q2)"


def _multiway_sql(depth: int) -> str:
    """A tree of up to three branches: all sets of one and two thresholds or words are tried."""
    sql = f"{_R}, {_LONG}, at0 AS MATERIALIZED (SELECT id, 'r' AS node FROM r)"
    branch = "CASE WHEN l.word IS NULL AND b.word1 IS NULL THEN CASE WHEN l.num >= b.num2 THEN 2 WHEN l.num >= b.num1 THEN 1 ELSE 0 END ELSE CASE WHEN l.word = b.word1 THEN 1 WHEN l.word = b.word2 THEN 2 ELSE 0 END END"
    for k in range(depth):
        sql += f", x{k} AS MATERIALIZED (SELECT node, l.* FROM l JOIN at{k} USING (id)), t{k} AS (SELECT DISTINCT node, col, num, word FROM x{k} WHERE num IS NOT NULL OR word IS NOT NULL)"
        sql += f", y{k} AS MATERIALIZED (SELECT node, col, num AS num1, NULL AS num2, word AS word1, NULL AS word2, 1 AS size FROM t{k} UNION ALL SELECT a.node, a.col, a.num, b.num, a.word, b.word, 2 FROM t{k} a JOIN t{k} b ON a.node = b.node AND a.col = b.col AND (a.num < b.num OR a.word < b.word))"
        sql += f", c{k} AS (SELECT b.node, b.col, num1, num2, word1, word2, size, {branch} AS branch, l.label, sum(c) AS c FROM y{k} b JOIN (SELECT node, col, num, word, label, count(*)::DOUBLE AS c FROM x{k} GROUP BY 1, 2, 3, 4, 5) l ON l.node = b.node AND l.col = b.col GROUP BY ALL)"
        sql += f", s{k} AS (SELECT *, sum(c) OVER (PARTITION BY node, col, num1, num2, word1, word2, branch) AS n, sum(c) OVER (PARTITION BY node, col, num1, num2, word1, word2) AS t, sum(c) OVER (PARTITION BY node, col, num1, num2, word1, word2, label) AS whole FROM c{k})"
        sql += f", g{k} AS (SELECT node, col, num1, num2, word1, word2, size, (sum(c * log2(c / n)) - sum(c * log2(whole / t))) / any_value(t) AS gain FROM s{k} GROUP BY ALL)"
        sql += f", b{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 9) DESC, col, size, num1, num2, word1, word2) AS k FROM g{k}) WHERE k = 1 AND gain > 0.0001 + 1e-9)"
        sql += f", at{k + 1} AS MATERIALIZED (SELECT at{k}.id, b.node || '.' || {branch} AS node FROM at{k} JOIN b{k} b USING (node) JOIN l ON l.id = at{k}.id AND l.col = b.col)"
    counts = """'{' || string_agg('"' || label || '":' || c, ',' ORDER BY label) || '}' AS counts"""
    tests = [f"b{k}" for k in range(depth)] + ["(SELECT * FROM b0 LIMIT 0)"]
    return f"WITH {sql} " + " UNION ALL ".join(f"SELECT e.node, b.col, CASE WHEN num1 IS NOT NULL THEN concat_ws(',', num1::INT, num2::INT) END AS nums, CASE WHEN word1 IS NOT NULL THEN concat_ws(',', word1, word2) END AS words, round(b.gain, 7) AS gain, counts FROM (SELECT node, {counts} FROM (SELECT node, label, count(*) AS c FROM at{k} JOIN r USING (id) GROUP BY 1, 2) GROUP BY 1) e LEFT JOIN {b} b ON b.node = e.node" for k, b in enumerate(tests))


_SIZES = "sizes AS (SELECT node, label, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY node) AS n FROM (SELECT id, node FROM leaf) JOIN r USING (id) GROUP BY 1, 2)"
_T3, _T2 = _tree_sql(3, "entropy", 0.0001, _R, _LONG, "r"), _tree_sql(2, "entropy", 0.0001, _R, _LONG, "r")
_TG, _TV = _tree_sql(2, "gini", 0.0, _R, _LONG, "r"), _tree_sql(2, "variance", 0.0, _PRICED, _LONG_PRICED, "v0")

ORACLE_SQL = {
    "m5_grow_tree": f"WITH {_T3} {_tree_nodes_sql(3, True, 'r', 7)}",
    "m5_gini": f"WITH {_TG} {_tree_nodes_sql(2, True, 'r', 7)}",
    "m5_regression": f"WITH {_TV} {_tree_nodes_sql(2, False, 'v0', 6)}",
    "m5_multiway": _multiway_sql(2),
    "m6_prune_tree": f"WITH {_T3}, {_pruned_sql(3, 0.002)}",
    "m7_tree_classify": f"WITH {_T3}, leaf AS ({_leaves_sql(3)}), {_SIZES} SELECT leaf.id, label, round(sum(w * c / n), 6) AS share FROM leaf JOIN sizes USING (node) GROUP BY 1, 2",
    "m7_estimate": f"WITH {_TV}, leaf AS ({_leaves_sql(2)}), e AS (SELECT node, avg(label) AS mean FROM leaf JOIN v0 USING (id) GROUP BY 1) SELECT leaf.id, round(sum(w * mean), 6) AS guess FROM leaf JOIN e USING (node) GROUP BY 1",
    "m7_ranges": f"WITH {_T2}, leaf AS ({_leaves_sql(2)}), {_SIZES}, {_ranges_sql()} SELECT done.id, label, round(sum(w * c / n), 6) AS share FROM done JOIN sizes USING (node) GROUP BY 1, 2",
    "a26_impurity": f"WITH {_R}, c AS (SELECT priority, label, count(*)::DOUBLE AS c, sum(count(*)) OVER (PARTITION BY priority) AS t FROM r GROUP BY 1, 2) SELECT priority, sum(c)::BIGINT AS n, round(1 - sum(c/t*c/t), 6) AS gini, round(-sum(c/t*log2(c/t)), 6) AS entropy FROM c GROUP BY 1",
    "a26_variance": f"WITH {_R} SELECT priority, count(value) AS n, round(var_pop(value) / 1e6, 3) AS variance FROM r GROUP BY 1",
    "a27_split_gain": f"WITH {_G} SELECT col, num, word, n, n_true, round(gain, 7) AS gain FROM g",
    "w9_best_split": f"WITH {_G} SELECT 1::BIGINT AS node, col, num, word, round(gain, 7) AS gain FROM g ORDER BY round(gain, 9) DESC, col, num, word LIMIT 1",
    "a28_multiway_split": f"""WITH {_R}, s AS (SELECT s, list_filter([CASE WHEN s & 1 > 0 THEN 2.0 END, CASE WHEN s & 2 > 0 THEN 5.0 END, CASE WHEN s & 4 > 0 THEN 8.0 END, CASE WHEN s & 8 > 0 THEN 11.0 END], lambda x: x IS NOT NULL) AS cuts FROM generate_series(1, 15) t(s)),
c AS (SELECT s, cuts, list_max(list_filter(cuts, lambda t: t <= price)) AS b, label, count(*)::DOUBLE AS c FROM r, s WHERE price IS NOT NULL GROUP BY 1, 2, 3, 4), e AS (SELECT *, sum(c) OVER (PARTITION BY s, b) AS n, sum(c) OVER (PARTITION BY s) AS t FROM c)
SELECT array_to_string(list_transform(any_value(cuts), lambda x: x::INT::VARCHAR), ',') AS cuts, round({_H.format("WHERE price IS NOT NULL")} + sum(c * log2(c / n)) / any_value(t), 7) AS gain FROM e GROUP BY s""",
    "a11_vector_distances": f"""WITH {_E} SELECT i, j, round(CASE WHEN {_DEN} > 1e-12 THEN 1 - (list_dot_product(x, y) - list_sum(x)*list_sum(y)/n) / {_DEN} ELSE 0 END, 6) AS pearson, round(1 - coalesce({_BOTH}::DOUBLE / nullif({_EITHER}, 0), 0), 6) AS tanimoto, round(1 - sqrt({_D2})/n, 6) AS euclid,
round(1 - list_sum(list_transform(generate_series(1, len(x)), lambda i: sqrt(x[i]*x[i]+y[i]*y[i])))/n, 6) AS pythagoras, round(1 - list_sum(list_transform(generate_series(1, len(x)), lambda i: abs(x[i]-y[i])))/n, 6) AS manhattan FROM p""",
    "j7_all_pairs": f"WITH {_E} SELECT i, j, round(sqrt({_D2}), 6) AS d FROM p",
    "m2_kmeans": f"WITH {_kmeans_sql(6, 3)} SELECT id, cluster, round(sqrt(d2), 6) AS d FROM a3",
    "m3_heights": """WITH RECURSIVE m AS (SELECT p_partkey AS k, p_retailprice::DOUBLE / 1000 AS d FROM part WHERE p_partkey > 0), s AS (SELECT k, c, d, (SELECT max(k) FROM m) AS n FROM (SELECT k, unnest([2 * k, 2 * k + 1]) AS c, d FROM m)),
w AS (SELECT k AS root, k AS node, FALSE AS leaf, 0.0::DOUBLE AS far FROM m UNION ALL SELECT w.root, s.c, s.c > s.n, w.far + s.d FROM w JOIN s ON s.k = w.node WHERE NOT w.leaf)
SELECT -root AS id, count(*) FILTER (WHERE leaf) AS height, round(max(far), 6) AS depth FROM w GROUP BY 1""",
    "m2_kmeans_pearson": f"WITH {_kmeans_sql(6, 3, 'pearson')} SELECT id, cluster, round(d2, 6) AS d FROM a3",
    "s10_cluster_report": f"WITH {_kmeans_sql(6, 3)} SELECT cluster, 'v' || (id::VARCHAR) AS label FROM a3",
    "a35_matrix_cost": "WITH a AS (SELECT user_id, event_type, count(*) AS v FROM events GROUP BY 1, 2), b AS (SELECT user_id, event_type, count(*) AS v FROM events WHERE value > 1 GROUP BY 1, 2) SELECT round(sum(pow(coalesce(a.v, 0) - coalesce(b.v, 0), 2)), 4) AS cost FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type",
    "m14_nmf_step": """WITH v AS (SELECT user_id AS r, event_type AS c, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), i AS (SELECT unnest([0, 1, 2]) AS i),
w AS (SELECT r, i, ((r * (2 * i + 3) + i) % 11 + 1) / 11.0::DOUBLE AS f FROM (SELECT DISTINCT r FROM v), i), h AS (SELECT c, i, ((length(c) * (2 * i + 3) + i) % 11 + 1) / 11.0::DOUBLE AS f FROM (SELECT DISTINCT c FROM v), i),
gw AS (SELECT a.i, b.i AS j, sum(a.f * b.f) AS g FROM w a JOIN w b USING (r) GROUP BY 1, 2), th AS (SELECT c, i, sum(v * f) AS t FROM v JOIN w USING (r) GROUP BY 1, 2), bh AS (SELECT c, g.j AS i, sum(f * g) AS b FROM h JOIN gw g ON g.i = h.i GROUP BY 1, 2),
h2 AS (SELECT c, i, f * t / (b + 1e-26) AS f FROM h JOIN th USING (c, i) JOIN bh USING (c, i)),
gh AS (SELECT a.i, b.i AS j, sum(a.f * b.f) AS g FROM h2 a JOIN h2 b USING (c) GROUP BY 1, 2), tw AS (SELECT r, i, sum(v * f) AS t FROM v JOIN h2 USING (c) GROUP BY 1, 2), bw AS (SELECT r, g.j AS i, sum(f * g) AS b FROM w JOIN gh g ON g.i = w.i GROUP BY 1, 2),
w2 AS (SELECT r, i, f * t / (b + 1e-26) AS f FROM w JOIN tw USING (r, i) JOIN bw USING (r, i)), x AS (SELECT r::VARCHAR AS key, i, f FROM w2 UNION ALL SELECT c, i, f FROM h2)
SELECT key, round(max(f) FILTER (WHERE i = 0), 6) AS f0, round(max(f) FILTER (WHERE i = 1), 6) AS f1, round(max(f) FILTER (WHERE i = 2), 6) AS f2 FROM x GROUP BY 1""",
    "w8_feature_tops": "WITH l AS (SELECT vec_id AS key, unnest(embedding)::DOUBLE AS weight, generate_subscripts(embedding, 1) - 1 AS feature FROM embeddings) SELECT feature, key, round(weight, 6) AS weight, k FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(weight, 6) DESC, key DESC)::INT AS k FROM l) WHERE k <= 6",
    "w10_aligned_series": """WITH v AS (SELECT n_name AS ticker, l_shipdate::DATE AS date, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
m AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM v GROUP BY ticker)) SELECT k, ticker, round(volume, 4) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date)::INT AS k FROM v), m WHERE k <= least""",
    "m4_mds_step": """WITH c AS (SELECT c_nationkey::BIGINT AS id, o_orderpriority AS p, count(*)::DOUBLE AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), f AS (SELECT u.id, q.p, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT id FROM c) u CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders) q LEFT JOIN c ON c.id = u.id AND c.p = q.p),
d AS (SELECT a.id AS i, b.id AS j, sqrt(sum((a.n-b.n)*(a.n-b.n))) AS d FROM f a JOIN f b ON a.p = b.p AND a.id <> b.id GROUP BY 1, 2), pt AS (SELECT DISTINCT id, (id % 5)::DOUBLE AS x, (id % 7)::DOUBLE AS y FROM f),
g AS (SELECT i, sum((a.x-b.x)/q*(q-d)/d) AS gx, sum((a.y-b.y)/q*(q-d)/d) AS gy FROM (SELECT d.*, sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)) AS q, a, b FROM d JOIN pt a ON a.id = i JOIN pt b ON b.id = j WHERE d > 0) WHERE q > 0 GROUP BY 1)
SELECT id, round(x - 0.01*coalesce(gx, 0), 6) AS x, round(y - 0.01*coalesce(gy, 0), 6) AS y FROM pt LEFT JOIN g ON g.i = pt.id""",
}
ORACLE_SQL["a42_kmeans_total"] = " UNION ALL ".join(f"SELECT * FROM (WITH {_kmeans_sql(k, 10)} SELECT {k}::INT AS k, round(sum(sqrt(d2)), 4) AS total FROM a10)" for k in (4, 8))

"""Queries of nearest neighbours, linear and kernel classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.operators import kernel as K
from tessera.operators import knn
from tessera.operators import plans as P
from tessera.sources.tables import table


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("features"), F.col("label").cast("double").alias("result"))


def _queries(spark, d):
    return _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query"), "features")


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")).alias("features"), F.col("p_retailprice").cast("double").alias("result"))


def _near(spark, d, k):
    return knn.nearest(_queries(spark, d), _vectors(spark, d), k)


def w4_knn(spark, d):
    return _near(spark, d, 5).select("query", "id", F.round("dist", 6).alias("dist"), "rank")


def w5_knn_estimate(spark, d):
    v = _vectors(spark, d)
    return knn.knn_estimate(_near(spark, d, 3), v, 3).select("query", F.round("guess", 6).alias("guess"))


def w5_weighted_knn(spark, d):
    v = _vectors(spark, d)
    return knn.weighted_knn(_near(spark, d, 5), v, 5, "inverse").select("query", F.round("guess", 6).alias("guess"))


def j11_range_probability(spark, d):
    v = _vectors(spark, d)
    ranges = _queries(spark, d).select("query", F.lit(2.0).alias("low"), F.lit(6.0).alias("high"))
    return knn.range_probability(_near(spark, d, 5), v, ranges, 5, "inverse").select("query", F.round("prob", 6).alias("prob"))


def w6_probability_curve(spark, d):
    cumulative, density = knn.probability_curve(_near(spark, d, 5), _vectors(spark, d), 10.0, 20, 5, "inverse", 1.0)
    return cumulative.join(density.withColumnRenamed("prob", "density"), ["query", "i"]).select("query", "i", F.round("prob", 5).alias("cumulative"), F.round("density", 5).alias("density"))


def p18_rescale(spark, d):
    return _parts(spark, d).select("id", F.round(N.rescale(F.col("features"), [10.0, 0.5])[0], 6).alias("a"), F.round(N.rescale(F.col("features"), [10.0, 0.5])[1], 6).alias("b"))


def p19_minmax_scale(spark, d):
    rows = _lines(spark, d)
    scaled = N.minmax_scale(rows, N.minmax_bounds(rows))
    return scaled.select("id", *[F.round(F.col("features")[i], 6).alias(f"x{i}") for i in range(3)])


def p20_kernels(spark, d):
    v = _vectors(spark, d)
    other = v.select((F.col("id") - 1).alias("id"), F.col("features").alias("b"))
    x, y = F.col("features"), F.col("b")
    return v.join(other, "id").select("id", F.round(N.dot(x, y), 6).alias("dot"), F.round(N.sq_length(x), 6).alias("len"), F.round(N.kernel_rbf(x, y, 1.0), 6).alias("rbf"))


def p21_weights(spark, d):
    x = (F.col("p_partkey") % 97) / 31.0
    return table(spark, d, "part").select("p_partkey", F.round(N.weight_inverse(x), 6).alias("inverse"), F.round(N.weight_subtract(x), 6).alias("subtract"), F.round(N.weight_gaussian(x), 6).alias("gaussian"))


def p22_region_of_state(spark, d):
    people = table(spark, d, "customer").select("c_custkey", F.concat(F.lpad((F.col("c_nationkey") % 20).cast("string"), 2, "0"), F.lit(" town")).alias("location"), (F.col("c_acctbal") / 100).alias("rating"))
    regions = table(spark, d, "nation").select(F.lpad((F.col("n_nationkey")).cast("string"), 2, "0").alias("state"), F.col("n_regionkey").alias("region")).where("n_nationkey % 3 <> 0")
    return N.region_of_state(people, regions).select("c_custkey", "region", "rating")


def p23_wine_price(spark, d):
    rating, age = 50.0 + F.col("p_partkey") % 51, (F.col("p_size") % 60).cast("double")
    return table(spark, d, "part").where("p_partkey % 51 <> 0").select("p_partkey", F.round(N.wine_price(rating, age), 5).alias("price"))


def p25_synthetic_wine(spark, d):
    """Noise and the rest come from the keys of parts, so that every run gives the same set."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        key.alias("id"), (51 + key * 7919 % 4900 / 100.0).alias("rating"), F.col("p_size").cast("double").alias("age"), (key % 20 + 1).alias("aisle"),
        F.element_at(F.array(*map(F.lit, (375, 750, 1500, 3000))), (key % 4 + 1).cast("int")).alias("bottle"), (key * 104729 % 1000 / 1000.0).alias("noise"), (key * 15485863 % 1000 / 1000.0).alias("sale"))
    made = N.wine_sets(rows)
    return made.select("id", F.round("rating", 2).alias("rating"), "age", "aisle", "bottle", *[F.round(c, 5).alias(c) for c in ("price1", "price2", "price3")])


def p25_hidden_sets(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 41).cast("double").alias("x"), F.col("l_quantity").cast("double").alias("y"))
    made = N.hidden_sets(rows.select(F.struct("l_orderkey", "l_linenumber").alias("id"), "x", "y"))
    return made.select("id.*", "x", "y", F.round("polynomial", 5).alias("polynomial"), F.round("sine", 5).alias("sine"))


def p17_numeric_pairs(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    answer = lambda c, k: F.when(c % 3 == k, "yes").when(c % 3 == (k + 1) % 3, "no").otherwise("maybe")
    couples = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("id"), (20 + F.col("o_orderkey") % 50).alias("age1"), (20 + F.col("c_custkey") % 50).alias("age2"), answer(F.col("o_orderkey"), 0).alias("smoker1"), answer(F.col("c_custkey"), 0).alias("smoker2"),
        answer(F.col("o_orderkey"), 1).alias("children1"), answer(F.col("c_custkey"), 1).alias("children2"), F.concat_ws(":", "o_orderpriority", "c_mktsegment").alias("interests1"), F.concat_ws(":", "c_mktsegment", "o_orderstatus").alias("interests2"), (F.col("o_orderstatus") == "F").cast("int").alias("match"))
    return N.numeric_pairs(couples).select("id", "match", *[F.col("features")[i].alias(f"f{i}") for i in range(8)])


def a34_error_rate(spark, d):
    guess = _parts(spark, d).select((F.col("features")[0] * 20 + 900).alias("guess"), F.col("result").alias("actual"))
    return knn.error_rate(guess).select(F.round("mse", 3).alias("mse"), F.round("accuracy", 6).alias("accuracy"), F.round("r2", 6).alias("r2"))


def m8_cross_validate(spark, d):
    return knn.cross_validate(_parts(spark, d), 5, 3).select("fold", F.round("mse", 3).alias("mse"))


def m9_tune(spark, d):
    """k with the smallest cross-validated error, all candidates over the same folds."""
    rows = knn.tune_k(_parts(spark, d), [1, 3, 5], 5)
    return rows.groupBy().agg(F.min_by("k", F.struct("cost", "k")).alias("k"), F.round(F.min("cost"), 3).alias("cost"))


def m8_trials(spark, d):
    """A hundred random splits in one job."""
    return knn.cross_validate(_parts(spark, d), knn.random_split(100, 0.05), knn.knn_estimator(3)).select("fold", F.round("mse", 3).alias("mse"))


def m8_hold_out(spark, d):
    """Fifteen rows held out in each of twenty trials, estimated by weights of the distance."""
    return knn.cross_validate(_parts(spark, d), knn.hold_out(20, 15), knn.knn_estimator(5, "gaussian")).select("fold", F.round("mse", 3).alias("mse"))


def m8_mean(spark, d):
    """The same splits for an estimator that is no neighbour: the mean of the rest."""
    return knn.cross_validate(_parts(spark, d), knn.random_split(100, 0.05), knn.mean_estimator).select("fold", F.round("mse", 3).alias("mse"))


def _scales(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("cand_id"), F.array((F.col("n_nationkey") * 7 % 20).cast("int"), (F.col("n_nationkey") * 3 % 11 + 1).cast("int")).alias("genes"))


def m9_scales(spark, d):
    """A table of candidate scales, scored in one job."""
    return knn.tune_scales(_parts(spark, d), _scales(spark, d), knn.random_split(2, 0.05)).select("cand_id", F.round("cost", 3).alias("cost"))


def m9_scale_search(spark, d):
    """Scales found by annealing from the first of them."""
    tests, rows = knn.divide(_parts(spark, d), knn.random_split(2, 0.05))
    starts = _scales(spark, d).where("cand_id < 5").select(F.col("cand_id").alias("start"), "genes")
    found = P.anneal(starts, lambda c: knn.scale_costs(tests, rows, c), 20, cool=0.02)
    return found.select("start", F.array_join("genes", ",").alias("genes"), F.round("cost", 3).alias("cost"))


def _lines(spark, d):
    lines = table(spark, d, "lineitem")
    keyed = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.avg(F.col("l_quantity").cast("double")).alias("q"), F.avg(F.col("l_discount").cast("double")).alias("t"), F.avg(F.col("l_tax").cast("double")).alias("x"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("match"))
    return keyed.select("id", F.array("q", "t", "x").alias("features"), "match")


def _scaled(spark, d):
    rows = _lines(spark, d)
    return N.minmax_scale(rows, N.minmax_bounds(rows))


def a29_interest_counts(spark, d):
    parts = table(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit(":")).alias("interests1"), F.replace("p_type", F.lit(" "), F.lit(":")).alias("interests2"))
    return K.interest_counts(parts)


def a30_class_centroids(spark, d):
    return K.class_centroids(_lines(spark, d)).select("match", *[F.round(F.col("features")[i], 6).alias(f"x{i}") for i in range(3)])


def a31_linear_classify(spark, d):
    rows = _lines(spark, d)
    return K.linear_classify(rows, K.class_centroids(rows))


def _vector_rows(spark, d):
    return _vectors(spark, d).select("id", "features", (F.col("result") < 5).cast("int").alias("match"))


def a32_kernel_offset(spark, d):
    return K.kernel_offset(_vector_rows(spark, d), 1.0).select(F.round("offset", 8).alias("offset"))


def a33_kernel_classify(spark, d):
    rows = _vector_rows(spark, d)
    return K.kernel_classify(rows, rows, K.kernel_offset(rows, 1.0), 1.0)


def _svm_rows(spark, d, kind):
    """Orders that differ in quantity and discount: by a line for the linear kernel, by a ring for the others."""
    rows = _scaled(spark, d)
    x, y = F.col("features")[0], F.col("features")[1]
    told = x + y > 1.0 if kind == "line" else (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) > 0.06
    return rows.select("id", "features", told.cast("int").alias("match"))


def m20_svm_linear(spark, d):
    rows = _svm_rows(spark, d, "line")
    return K.svm(rows.where("id % 20 <> 0"))(rows)


def m20_svm_polynomial(spark, d):
    rows = _svm_rows(spark, d, "ring")
    return K.svm(rows.where("id % 20 <> 0"), "polynomial")(rows)


def m20_svm_rbf(spark, d):
    rows = _svm_rows(spark, d, "ring")
    return K.svm(rows.where("id % 20 <> 0"), "rbf", 4.0)(rows)


def m20_svm_folds(spark, d):
    return K.svm_folds(_svm_rows(spark, d, "ring"), 3, "polynomial")


QUERIES = {f.__name__: f for f in (w4_knn, w5_knn_estimate, w5_weighted_knn, j11_range_probability, w6_probability_curve, p17_numeric_pairs, p18_rescale, p19_minmax_scale, p20_kernels, p21_weights, p22_region_of_state, p23_wine_price, p25_synthetic_wine, p25_hidden_sets, a34_error_rate, m8_cross_validate, m8_trials, m8_hold_out, m8_mean, m9_tune, m9_scales, m9_scale_search, a29_interest_counts, a30_class_centroids, a31_linear_classify, a32_kernel_offset, a33_kernel_classify, m20_svm_linear, m20_svm_polynomial, m20_svm_rbf, m20_svm_folds)}

_DIST = "list_sum(list_transform(generate_series(1, len(a.e)), lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))"
_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label::DOUBLE AS result FROM embeddings)"
_N = f"""{_V}, near AS (SELECT * FROM (SELECT query, id, dist, result, row_number() OVER (PARTITION BY query ORDER BY dist, id)::INT AS rank FROM (
  SELECT a.id AS query, b.id, b.result, round(sqrt({_DIST}), 9) AS dist FROM v a, v b WHERE a.id % 20 = 0)) WHERE rank <= 5), nw AS (SELECT *, 1.0 / (dist + 0.1) AS w FROM near)"""
_L = """l AS (SELECT l_orderkey AS id, avg(l_quantity::DOUBLE) AS q, avg(l_discount::DOUBLE) AS t, avg(l_tax::DOUBLE) AS x, max((l_returnflag = 'R')::INT) AS match FROM lineitem GROUP BY 1)"""
_P = "p AS (SELECT p_partkey AS id, p_size::DOUBLE AS a, (p_partkey % 50)::DOUBLE AS b, p_retailprice::DOUBLE AS r FROM part)"
_CV = """, m AS (SELECT a.id, a.r AS actual, a.id % 5 AS fold, b.r, row_number() OVER (PARTITION BY a.id ORDER BY round(sqrt((a.a-b.a)*(a.a-b.a)+(a.b-b.b)*(a.b-b.b)), 9), b.id) AS k FROM p a JOIN p b ON a.id % 5 <> b.id % 5)"""
_PD = "round(sqrt((a.a-b.a)*(a.a-b.a)+(a.b-b.b)*(a.b-b.b)), 9)"


def _held(trials):
    """The hash of each part and trial."""
    return f"h AS (SELECT id, t::INT AS t, ('0x' || md5(id::VARCHAR || ':' || t::VARCHAR)[1:8])::BIGINT / 4294967296.0::DOUBLE AS share FROM p, generate_series(0, {trials - 1}) s(t))"


_K = f"""{_V}, s AS (SELECT a.id, a.result < 5 AS m, avg(exp(-1.0 * {_DIST})) FILTER (WHERE b.result >= 5) AS k0, avg(exp(-1.0 * {_DIST})) FILTER (WHERE b.result < 5) AS k1 FROM v a, v b GROUP BY 1, 2),
o AS (SELECT avg(k1) FILTER (WHERE m) - avg(k0) FILTER (WHERE NOT m) AS "offset" FROM s)"""

ORACLE_SQL = {
    "w4_knn": f"WITH {_N} SELECT query, id, round(dist, 6) AS dist, rank FROM near",
    "w5_knn_estimate": f"WITH {_N} SELECT query, round(avg(result), 6) AS guess FROM near WHERE rank <= 3 GROUP BY 1",
    "w5_weighted_knn": f"WITH {_N} SELECT query, round(sum(w*result)/sum(w), 6) AS guess FROM nw GROUP BY 1",
    "j11_range_probability": f"WITH {_N} SELECT query, round(coalesce(sum(w) FILTER (WHERE result BETWEEN 2 AND 6), 0)/sum(w), 6) AS prob FROM nw GROUP BY 1",
    "w6_probability_curve": f"""WITH {_N}, g AS (SELECT i::INT AS i FROM generate_series(0, 19) t(i)),
c AS (SELECT query, i, coalesce(sum(w) FILTER (WHERE result >= 0 AND result <= i * 0.5::DOUBLE), 0)/sum(w) AS cum, coalesce(sum(w) FILTER (WHERE result >= i * 0.5::DOUBLE AND result <= (i + 1) * 0.5::DOUBLE), 0)/sum(w) AS p FROM nw, g GROUP BY 1, 2)
SELECT a.query, a.i, round(any_value(a.cum), 5) AS cumulative, round(sum(exp(-(0.5*(a.i-b.i))*(0.5*(a.i-b.i))/2.0) * b.p), 5) AS density FROM c a JOIN c b ON a.query = b.query GROUP BY 1, 2""",
    "p18_rescale": f"WITH {_P} SELECT id, a * 10.0 AS a, round(b * 0.5, 6) AS b FROM p",
    "p19_minmax_scale": f"WITH {_L} SELECT id, round((q - min(q) OVER ()) / (max(q) OVER () - min(q) OVER ()), 6) AS x0, round((t - min(t) OVER ()) / (max(t) OVER () - min(t) OVER ()), 6) AS x1, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x2 FROM l",
    "p20_kernels": f"WITH {_V} SELECT a.id, round(list_dot_product(a.e, b.e), 6) AS dot, round(list_dot_product(a.e, a.e), 6) AS len, round(exp(-1.0 * {_DIST}), 6) AS rbf FROM v a JOIN v b ON b.id = a.id + 1",
    "p21_weights": "SELECT p_partkey, round(1.0/(x+0.1), 6) AS inverse, round(greatest(1.0-x, 0.0), 6) AS subtract, round(exp(-(x*x)/50.0), 6) AS gaussian FROM (SELECT p_partkey, (p_partkey % 97)/31.0::DOUBLE AS x FROM part)",
    "p22_region_of_state": "SELECT c_custkey, n_regionkey AS region, floor(c_acctbal/100 + 0.5)::INT AS rating FROM customer JOIN nation ON n_nationkey = c_nationkey % 20 WHERE n_nationkey % 3 <> 0",
    "p23_wine_price": "SELECT p_partkey, round(greatest(CASE WHEN age > r - 50 THEN r/2*(5-(age-(r-50))) ELSE r/2*(5*((age+1)/(r-50))) END, 0), 5) AS price FROM (SELECT p_partkey, 50.0::DOUBLE + p_partkey % 51 AS r, (p_size % 60)::DOUBLE AS age FROM part WHERE p_partkey % 51 <> 0)",
    "a34_error_rate": f"WITH {_P} SELECT round(avg((a*20+900-r)*(a*20+900-r)), 3) AS mse, round(avg((a*20+900=r)::INT), 6) AS accuracy, round(pow(corr(a*20+900, r), 2), 6) AS r2 FROM p",
    "m8_cross_validate": f"WITH {_P}{_CV} SELECT fold, round(avg((g-actual)*(g-actual)), 3) AS mse FROM (SELECT id, fold, any_value(actual) AS actual, avg(r) AS g FROM m WHERE k <= 3 GROUP BY 1, 2) GROUP BY 1",
    "m9_tune": f"WITH {_P}{_CV}, c AS (SELECT kk AS k, avg(mse) AS cost FROM (SELECT kk, fold, avg((g-actual)*(g-actual)) AS mse FROM (SELECT kk, id, fold, any_value(actual) AS actual, avg(r) AS g FROM m, (SELECT unnest([1,3,5])::INT AS kk) WHERE k <= kk GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1) SELECT arg_min(k, (cost, k)) AS k, round(min(cost), 3) AS cost FROM c",
    "m8_trials": f"""WITH {_P}, {_held(100)}, m AS (SELECT a.t AS fold, a.id, a.r AS actual, b.r, row_number() OVER (PARTITION BY a.t, a.id ORDER BY {_PD}, b.id) AS k FROM (SELECT p.*, t FROM p JOIN h USING (id) WHERE share < 0.05) a JOIN p b ON true JOIN h ON h.id = b.id AND h.t = a.t AND NOT share < 0.05)
SELECT fold, round(avg((g - actual) * (g - actual)), 3) AS mse FROM (SELECT fold, id, any_value(actual) AS actual, avg(r) AS g FROM m WHERE k <= 3 GROUP BY 1, 2) GROUP BY 1""",
    "m8_hold_out": f"""WITH {_P}, {_held(20)}, o AS (SELECT id, t FROM h QUALIFY row_number() OVER (PARTITION BY t ORDER BY share, id) <= 15),
m AS (SELECT a.t AS fold, a.id, a.r AS actual, b.r, {_PD} AS dist, row_number() OVER (PARTITION BY a.t, a.id ORDER BY {_PD}, b.id) AS k FROM (SELECT p.*, t FROM p JOIN o USING (id)) a JOIN p b ON true ANTI JOIN o ON o.id = b.id AND o.t = a.t)
SELECT fold, round(avg((g - actual) * (g - actual)), 3) AS mse FROM (SELECT fold, id, any_value(actual) AS actual, sum(exp(-dist * dist / 50) * r) / sum(exp(-dist * dist / 50)) AS g FROM m WHERE k <= 5 GROUP BY 1, 2) GROUP BY 1""",
    "m8_mean": f"""WITH {_P}, {_held(100)}, g AS (SELECT t, avg(r) FILTER (WHERE NOT share < 0.05) AS guess FROM h JOIN p USING (id) GROUP BY 1)
SELECT t AS fold, round(avg((guess - r) * (guess - r)), 3) AS mse FROM h JOIN p USING (id) JOIN g USING (t) WHERE share < 0.05 GROUP BY 1""",
    "m9_scales": f"""WITH {_P}, {_held(2)}, c AS (SELECT n_nationkey::BIGINT AS cand_id, n_nationkey * 7 % 20 AS u, n_nationkey * 3 % 11 + 1 AS v FROM nation),
m AS (SELECT cand_id, a.t, a.id, a.r AS actual, b.r, row_number() OVER (PARTITION BY cand_id, a.t, a.id ORDER BY round(sqrt((a.a-b.a)*(a.a-b.a)*u*u+(a.b-b.b)*(a.b-b.b)*v*v), 9), b.id) AS k FROM c, (SELECT p.*, t FROM p JOIN h USING (id) WHERE share < 0.05) a JOIN p b ON true JOIN h ON h.id = b.id AND h.t = a.t AND NOT share < 0.05)
SELECT cand_id, round(avg((g - actual) * (g - actual)), 3) AS cost FROM (SELECT cand_id, t, id, any_value(actual) AS actual, avg(r) AS g FROM m WHERE k <= 3 GROUP BY 1, 2, 3) GROUP BY 1""",
    "a29_interest_counts": "SELECT interest, count(*) AS n FROM (SELECT unnest(string_split(replace(p_name, ' ', ':'), ':') || string_split(replace(p_type, ' ', ':'), ':')) AS interest FROM part) WHERE interest <> '' GROUP BY 1",
    "a30_class_centroids": f"WITH {_L} SELECT match, round(avg(q), 6) AS x0, round(avg(t), 6) AS x1, round(avg(x), 6) AS x2 FROM l GROUP BY 1",
    "a31_linear_classify": f"WITH {_L}, c AS (SELECT match, avg(q) AS q, avg(t) AS t, avg(x) AS x FROM l GROUP BY 1) SELECT l.id, CASE WHEN (l.q*a.q+l.t*a.t+l.x*a.x)-(l.q*b.q+l.t*b.t+l.x*b.x)+((b.q*b.q+b.t*b.t+b.x*b.x)-(a.q*a.q+a.t*a.t+a.x*a.x))/2 > 0 THEN 0 ELSE 1 END AS guess FROM l, c a, c b WHERE a.match = 0 AND b.match = 1",
    "a32_kernel_offset": f"WITH {_K} SELECT round(\"offset\", 8) AS \"offset\" FROM o",
    "a33_kernel_classify": f"WITH {_K} SELECT id, CASE WHEN k0 - k1 + \"offset\" > 0 THEN 0 ELSE 1 END AS guess FROM s, o",
    "p17_numeric_pairs": """SELECT o_orderkey AS id, (o_orderstatus = 'F')::INT AS match, (20 + o_orderkey % 50)::DOUBLE AS f0, CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS f1, CASE o_orderkey % 3 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END::DOUBLE AS f2,
(20 + c_custkey % 50)::DOUBLE AS f3, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS f4, CASE c_custkey % 3 WHEN 1 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END::DOUBLE AS f5, 1.0::DOUBLE AS f6, 0.0::DOUBLE AS f7 FROM orders JOIN customer ON o_custkey = c_custkey""",
}

ORACLE_SQL["p25_synthetic_wine"] = """
WITH r AS (SELECT p_partkey AS id, 51 + (p_partkey * 7919 % 4900) / 100.0::DOUBLE AS rating, p_size::DOUBLE AS age, p_partkey % 20 + 1 AS aisle, [375, 750, 1500, 3000][p_partkey % 4 + 1] AS bottle, (p_partkey * 104729 % 1000) / 1000.0::DOUBLE AS noise, (p_partkey * 15485863 % 1000) / 1000.0::DOUBLE AS sale FROM part),
p AS (SELECT *, greatest(CASE WHEN age > rating - 50 THEN rating/2*(5-(age-(rating-50))) ELSE rating/2*(5*((age+1)/(rating-50))) END, 0) AS price FROM r)
SELECT id, round(rating, 2) AS rating, age, aisle, bottle, round(price * (noise*0.4+0.8), 5) AS price1, round(price * (bottle/750.0::DOUBLE) * (noise*0.2+0.9), 5) AS price2, round(price * (noise*0.4+0.8) * CASE WHEN sale < 0.5 THEN 0.6 ELSE 1 END, 5) AS price3 FROM p"""
ORACLE_SQL["p25_hidden_sets"] = """
SELECT l_orderkey, l_linenumber, x, y, round(x*x + 2*y + 3*x + 5, 5) AS polynomial, round(y * sin(x), 5) AS sine FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 41)::DOUBLE AS x, l_quantity::DOUBLE AS y FROM lineitem)"""

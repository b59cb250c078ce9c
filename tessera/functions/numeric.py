"""Numeric functions on array columns: kernels, weights, scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """P20: dot product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def sq_length(a: Column) -> Column:
    """P20: sum of squares."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def kernel_rbf(a: Column, b: Column, gamma: float = 20.0) -> Column:
    """P20: e to the minus gamma times the squared distance."""
    return F.exp(-gamma * sq_distance(a, b))


def weight_inverse(d: Column, num: float = 1.0, const: float = 0.1) -> Column:
    """P21."""
    return num / (d + const)


def weight_subtract(d: Column, const: float = 1.0) -> Column:
    """P21."""
    return F.greatest(const - d, F.lit(0.0))


def weight_gaussian(d: Column, sigma: float = 5.0) -> Column:
    """P21."""
    return F.exp(-(d * d) / (2 * sigma * sigma))


WEIGHTS = {"inverse": weight_inverse, "subtract": weight_subtract, "gaussian": weight_gaussian}


def rescale(features: Column, scale: list[float]) -> Column:
    """Each feature times a weight."""
    return F.zip_with(features, F.array(*[F.lit(float(s)) for s in scale]), lambda x, s: x * s)


def minmax_bounds(rows: DataFrame, column: str = "features") -> DataFrame:
    """One row (lo, hi) of arrays: smallest and largest value at each place."""
    per = rows.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    listed = per.agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("b"))  # as many entries as features
    return listed.select(F.transform("b", lambda x: x["lo"]).alias("lo"), F.transform("b", lambda x: x["hi"]).alias("hi"))


def minmax_scale(rows: DataFrame, bounds: DataFrame, column: str = "features") -> DataFrame:
    """(x - lo) / (hi - lo), 0 where the range is 0. `bounds` has one row."""
    shifted = F.zip_with(column, "lo", lambda x, lo: x - lo)
    ranges = F.zip_with("hi", "lo", lambda hi, lo: hi - lo)
    scaled = F.zip_with(shifted, ranges, lambda x, r: F.when(r == 0, F.lit(0.0)).otherwise(F.try_divide(x, r)))
    return rows.join(F.broadcast(bounds)).withColumn(column, scaled).drop("lo", "hi")


def wine_price(rating: Column, age: Column) -> Column:
    """Price by rating and age; it rises to five times at the peak age, rating - 50, and falls after it."""
    peak, base = rating - 50, rating / 2.0
    late = base * (5 - (age - peak))
    return F.greatest(F.when(age > peak, late).otherwise(base * (5 * ((age + 1) / peak))), F.lit(0.0))


def wine_sets(rows: DataFrame) -> DataFrame:
    """P25: rows(id, rating, age, aisle, bottle, noise, sale) with the prices of three sets: set 1 with a noise of 20 %,
    set 2 by the size of the bottle with a noise of 10 % (the aisle tells nothing), and set 3, which is set 1 with half
    of the rows sold at 0.6. `noise` and `sale` are from 0 to 1."""
    price = wine_price(F.col("rating"), F.col("age"))
    first = price * (F.col("noise") * 0.4 + 0.8)
    second = price * (F.col("bottle") / 750.0) * (F.col("noise") * 0.2 + 0.9)
    third = F.when(F.col("sale") < 0.5, first * 0.6).otherwise(first)
    return rows.select("id", "rating", "age", "aisle", "bottle", first.alias("price1"), second.alias("price2"), third.alias("price3"))


def hidden_sets(rows: DataFrame) -> DataFrame:
    """P25: rows(id, x, y) with the two targets to be found: x*x + 2y + 3x + 5, and y * sin x."""
    x, y = F.col("x"), F.col("y")
    return rows.select("id", "x", "y", (x * x + 2 * y + 3 * x + 5).alias("polynomial"), (y * F.sin(x)).alias("sine"))


def region_of_state(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """rows(location, rating, ...) with the region of their state and the rating rounded half up; unknown states go.
    regions(state, region) is a dimension."""
    return rows.withColumn("state", F.lower(F.substring("location", 1, 2))).join(regions, "state").withColumn("rating", F.floor(F.col("rating") + 0.5).cast("int"))


def numeric_pairs(couples: DataFrame, distance: Column | None = None) -> DataFrame:
    """(id, features, match) of couples with age, smoker, children and interests of both persons: ages, smoker
    and children answers as -1, 0, 1, common interests, distance."""
    from .text import match_count, yesno

    far = F.lit(0.0) if distance is None else distance
    features = F.array(*[c.cast("double") for c in (F.col("age1"), yesno(F.col("smoker1")), yesno(F.col("children1")), F.col("age2"), yesno(F.col("smoker2")), yesno(F.col("children2")), match_count(F.col("interests1"), F.col("interests2")), far)])
    return couples.select("id", features.alias("features"), F.col("match").cast("int").alias("match"))

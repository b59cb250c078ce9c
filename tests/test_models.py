"""Support-vector classifiers that separate, and flights numbered in chunks."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessera.jobs import models
from tessera.operators import kernel, plans


@pytest.mark.parametrize("name, kind, least", [("m20_svm_linear", "line", 0.95), ("m20_svm_polynomial", "ring", 0.8), ("m20_svm_rbf", "ring", 0.9)])
def test_classifiers_beat_the_larger_class(spark, sf_dir, name, kind, least):
    rows = models._svm_rows(spark, sf_dir, kind)
    held = models.QUERIES[name](spark, sf_dir).join(rows.where("id % 20 = 0"), "id")
    right, ones = held.agg(F.avg((F.col("guess") == F.col("match")).cast("double")), F.avg("match")).first()
    assert right >= least and right > max(ones, 1 - ones) + 0.1


def test_a_line_does_not_do_for_a_ring_and_folds_cover_all_rows(spark, sf_dir):
    rows = models._svm_rows(spark, sf_dir, "ring")
    line, ring = (kernel.svm_folds(rows, 2, k).collect() for k in ("linear", "polynomial"))
    assert sum(r["n"] for r in ring) == rows.count() and min(r["accuracy"] - r["majority"] for r in ring) > 0.1
    assert max(r["accuracy"] for r in line) < min(r["accuracy"] for r in ring)


def test_classifier_of_one_class_and_of_none(spark):
    rows = spark.createDataFrame([(i, [float(i)], 1) for i in range(4)], "id long, features array<double>, match int")
    assert {r["guess"] for r in kernel.svm(rows)(rows).collect()} == {1}
    with pytest.raises(ValueError):
        kernel.svm(rows.limit(0))
    with pytest.raises(ValueError):
        kernel.svm(rows, "cubic")


@pytest.mark.parametrize("kind", ["linear", "polynomial", "rbf"])
def test_classifiers_in_a_session_with_an_observed_and_a_tagged_query(spark, kind):
    """Tasks must not need the session, which neither can be sent any more."""
    seen = Observation()
    spark.addTag("tagged")
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    spark.removeTag("tagged")
    assert seen.get == {"n": 3}
    rows = spark.createDataFrame([(i, [i / 40], int(i >= 20)) for i in range(40)], "id long, features array<double>, match int")
    told = kernel.svm(rows, kind, 4.0, rounds=5)(rows).join(rows, "id").where("abs(id - 19.5) > 3").collect()
    assert len(told) == 34 and all(r["guess"] == r["match"] for r in told)


@pytest.mark.parametrize("chunks", [1, 3, 50])
def test_numbers_of_flights(spark, chunks):
    """Chunks give the numbers that one sort gives: with ties and a null in the first column, and one large route."""
    rng = np.random.default_rng(1)
    rows = [("A" if i % 3 else "B", "H", None if i == 7 else int(rng.integers(20)), i) for i in range(300)]
    flights = spark.createDataFrame(rows, "origin string, dest string, day int, id int")
    got = {r["id"]: r["idx"] for r in plans.numbered_flights(flights, ["day", "id"], chunks).collect()}
    expected = {}
    for o in "AB":
        for k, r in enumerate(sorted((r for r in rows if r[0] == o), key=lambda r: (-1 if r[2] is None else r[2], r[3]))):
            expected[r[3]] = k
    assert got == expected


def test_genes_count_on_from_the_first_flight(spark):
    flights = spark.createDataFrame([("A", "H", i, 0, 0, 0) for i in range(3)] + [("H", "A", i, 0, 0, 0) for i in range(5)], "origin string, dest string, idx int, depart_min int, arrive_min int, price int")
    people = spark.createDataFrame([(0, "P", "A"), (1, "Q", "C")], "pos long, name string, origin string")
    c = spark.createDataFrame([(1, [7, 11, 4, 4]), (2, [2, -1, 0, 0])], "cand_id long, genes array<int>")
    got = {r["cand_id"]: r["genes"] for r in plans.wrapped(c, people, flights, "H").collect()}
    assert got == {1: [1, 1, 4, 4], 2: [2, 4, 0, 0]}

"""Values of small sample tables, computed independently from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import numeric as N
from tessera.functions import text as X
from tessera.operators import bayes as B
from tessera.operators import ratings as R
from tessera.operators import tree as T

# Ratings of seven critics, in the order of ITEMS, None for no rating.
ITEMS = ["Lady in the Water", "Snakes on a Plane", "Just My Luck", "Superman Returns", "You, Me and Dupree", "The Night Listener"]
CRITICS = {
    "Lisa Rose": [2.5, 3.5, 3.0, 3.5, 2.5, 3.0],
    "Gene Seymour": [3.0, 3.5, 1.5, 5.0, 3.5, 3.0],
    "Michael Phillips": [2.5, 3.0, None, 3.5, None, 4.0],
    "Claudia Puig": [None, 3.5, 3.0, 4.0, 2.5, 4.5],
    "Mick LaSalle": [3.0, 4.0, 2.0, 3.0, 2.0, 3.0],
    "Jack Matthews": [3.0, 4.0, None, 5.0, 3.5, 3.0],
    "Toby": [None, 4.5, None, 4.0, 1.0, None],
}
# Five labelled sentences.
SENTENCES = [("nobody owns the water", "good"), ("the quick rabbit jumps fences", "good"), ("buy pharmaceuticals now", "bad"), ("make quick money at the online casino", "bad"), ("the quick brown fox jumps", "good")]
# Labels of sixteen sign-ups, those that read the questions and answers, those that came by google.
LABELS = "NPBBPNBPNNNNBNBB"
READ = "yyyynnnnynnnynyy"
BY_GOOGLE = "0100100100100010"


@pytest.fixture(scope="module")
def critics(spark):
    rows = [(u, i, r) for u, rs in CRITICS.items() for i, r in zip(ITEMS, rs) if r is not None]
    return spark.createDataFrame(rows, "user string, item string, rating double")


def near(rows, expected):
    assert [k for k, _ in rows] == [k for k, _ in expected]
    for (_, a), (_, b) in zip(rows, expected):
        assert a == pytest.approx(b, abs=1e-6)


@pytest.mark.parametrize("name, value", [("distance", 0.148148), ("pearson", 0.396059)])
def test_similarity(critics, name, value):
    r = R.similarities(critics, name).where("u1 = 'Gene Seymour' and u2 = 'Lisa Rose'").first()
    assert r["sim"] == pytest.approx(value, abs=1e-6)


def test_top_matches(spark, critics):
    toby = spark.createDataFrame([("Toby",)], "user string")
    rows = R.top_matches(critics, toby, 3, "pearson").orderBy("rank").collect()
    near([(r["other"], r["sim"]) for r in rows], [("Lisa Rose", 0.991241), ("Mick LaSalle", 0.924473), ("Claudia Puig", 0.893405)])


@pytest.mark.parametrize("name, expected", [("pearson", [("The Night Listener", 3.347790), ("Lady in the Water", 2.832550), ("Just My Luck", 2.530981)]), ("distance", [("The Night Listener", 3.500248), ("Lady in the Water", 2.756124), ("Just My Luck", 2.461988)])])
def test_user_recommendations(spark, critics, name, expected):
    toby = spark.createDataFrame([("Toby",)], "user string")
    rows = R.user_recommendations(critics, toby, name).orderBy(F.desc("score")).collect()
    near([(r["item"], r["score"]) for r in rows], expected)


def test_item_recommendations(critics):
    rows = R.item_recommendations(critics, R.similar_items(critics, 10), 3).where("user = 'Toby'").orderBy("rank").collect()
    for r, (item, score) in zip(rows, [("The Night Listener", 3.182635), ("Just My Luck", 2.598332), ("Lady in the Water", 2.473088)]):
        assert r["item"] == item and r["score"] == pytest.approx(score, abs=2e-6)


@pytest.fixture(scope="module")
def counts(spark):
    docs = spark.createDataFrame(SENTENCES, "text string, category string").select("category", X.words_len(F.col("text")).alias("features"))
    return B.class_counts(docs)


def _asked(spark, text):
    return spark.createDataFrame([(1, text)], "doc_id long, text string").select("doc_id", X.words_len(F.col("text")).alias("features"))


def test_feature_probs(counts):
    p = {(r["feature"], r["category"]): r for r in B.feature_probs(*counts).collect()}
    assert p["money", "good"]["weighted"] == pytest.approx(0.25)
    f = {(r["feature"], r["category"]): r for r in B.feature_probs(*counts, fisher=True).collect()}
    assert f["quick", "good"]["prob"] == pytest.approx(0.571429, abs=1e-6)
    assert f["money", "bad"]["prob"] == pytest.approx(1.0) and f["money", "bad"]["weighted"] == pytest.approx(0.75)


@pytest.mark.parametrize("text, good, bad", [("quick rabbit", 0.15625, 0.05), ("quick money", 0.09375, 0.1)])
def test_bayes(spark, counts, text, good, bad):
    s = {r["category"]: math.exp(r["score"]) for r in B.bayes_scores(_asked(spark, text), *counts).collect()}
    assert s["good"] == pytest.approx(good) and s["bad"] == pytest.approx(bad)


def test_bayes_threshold(spark, counts):
    scores = B.bayes_scores(_asked(spark, "quick money"), *counts)
    assert B.bayes_classify(scores).first()["category"] == "bad"
    assert B.bayes_classify(scores, {"bad": 3.0}).first()["category"] == "unknown"


@pytest.mark.parametrize("text, good, bad", [("quick rabbit", 0.780140, 0.356336), ("quick money", 0.412087, 0.701169)])
def test_fisher(spark, counts, text, good, bad):
    s = {r["category"]: r["score"] for r in B.fisher_scores(_asked(spark, text), *counts).collect()}
    assert s["good"] == pytest.approx(good, abs=1e-6) and s["bad"] == pytest.approx(bad, abs=1e-6)


def test_signups(spark):
    rows = spark.createDataFrame([(i, a, b, int(g)) for i, (a, b, g) in enumerate(zip(LABELS, READ, BY_GOOGLE))], "id long, label string, read string, google int")
    whole = T.impurity(rows, []).first()
    assert whole["entropy"] == pytest.approx(1.505241, abs=1e-6) and whole["gini"] == pytest.approx(0.632813, abs=1e-6)
    read = T.impurity(rows, ["read"]).where("read = 'y'").first()
    assert read["entropy"] == pytest.approx(1.298795, abs=1e-6) and read["gini"] == pytest.approx(0.53125)
    cells = T.long_rows(rows.withColumn("from", F.when(F.col("google") == 1, "google").otherwise("x")), [], ["from"], "label")
    gains = T.split_gains(cells, rows.select("id", F.lit(1).cast("long").alias("node")))
    assert gains.where("word = 'google'").first()["gain"] == pytest.approx(0.393423, abs=1e-6)


def test_wine_price(spark):
    rows = spark.createDataFrame([(95.0, 3.0), (95.0, 8.0), (99.0, 1.0)], "rating double, age double")
    got = [r[0] for r in rows.select(N.wine_price(F.col("rating"), F.col("age"))).collect()]
    assert got == pytest.approx([21.111111, 47.5, 10.102041], abs=1e-6)


def test_literal_feature_modes(spark):
    row = spark.createDataFrame([("BUY NOW THIS GREAT THING",)], "s string")
    get = lambda compat: row.select(X.entry_features(F.lit("big news"), F.col("s"), F.lit("me"), 2, compat).alias("f")).first()["f"]
    assert "buy now" in get(False) and "UPPERCASE" in get(False) and "Publisher:me" in get(False)
    assert "buy now" not in get(True) and "UPPERCASE" not in get(True)

"""States that streams keep as increments: equal to whole retraining, merged now and then, written in proportion to a batch."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import bayes, clicknet
from tessera.streaming import online


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def clicks(spark, lo, hi):
    e = spark.range(lo, hi)
    words = F.array_distinct(F.array(F.col("id") % 11, F.col("id") % 4 + 20))
    return e.select(F.col("id").alias("query"), words.alias("words"), F.array(*[(F.col("id") + k) % 6 + 100 for k in range(3)]).alias("urls"), (F.col("id") % 6 + 100).alias("selected"))


@pytest.mark.parametrize("merge_every", [2, 16])
def test_clicks_kept_as_increments(spark, tmp_path, monkeypatch, merge_every):
    monkeypatch.setattr(online, "MERGE_EVERY", merge_every)
    parts = [(0, 30), (30, 60), (60, 66), (66, 96), (96, 97)]
    words = urls = None
    for a, b in parts:
        batch = clicks(spark, a, b)
        batch.write.mode("append").parquet(f"{tmp_path}/in")
        online.stream_clicks(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/net", f"{tmp_path}/log", 0.01)
        w, u = clicknet.hidden_nodes(batch)
        if words is not None:
            w = words.unionByName(w.join(words, ["word", "hidden"], "left_anti").select("word", "hidden", "w"))
            u = urls.unionByName(u.join(urls, ["hidden", "url"], "left_anti").select("hidden", "url", "w"))
        words, urls = (spark.createDataFrame(x.toPandas()) for x in clicknet.net_train(batch, w, u, 0.01))
    got = online.click_net(spark, f"{tmp_path}/net")
    for name, g, e in (("words", got[0], words), ("urlw", got[1], urls)):
        keys = [c for c in e.columns if c != "w"]
        assert {tuple(r[k] for k in keys): r["w"] for r in g.collect()} == pytest.approx({tuple(r[k] for k in keys): r["w"] for r in e.collect()})
        assert os.path.exists(f"{tmp_path}/net/{name}/merged") == (merge_every == 2)


def test_counts_are_written_in_proportion_to_a_batch(spark, tmp_path):
    docs = lambda lo, hi, f: spark.range(lo, hi).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("category"), f.alias("features"))
    large = docs(0, 4_000, F.array(*[F.concat(F.lit(f"{k}-"), F.col("id")) for k in range(10)]))
    small = docs(4_000, 4_010, F.array(F.lit("0-1"), F.lit("0-2"), F.concat(F.lit("new"), F.col("id") % 3)))
    for part in (large, small):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        online.guess_then_train(spark.readStream.schema(part.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", f"{tmp_path}/log")
    assert size_of(f"{tmp_path}/state/fc/steps/batch=1") < 0.1 * size_of(f"{tmp_path}/state/fc/steps/batch=0")
    fc, cc = bayes.class_counts(large.union(small))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(online.state(spark, f"{tmp_path}/state", "fc", ["feature", "category"], "n")) == rows(fc.select("feature", "category", "n"))
    assert rows(online.state(spark, f"{tmp_path}/state", "cc", ["category"], "n")) == rows(cc.select("category", "n"))
    assert online.state(spark, f"{tmp_path}/nothing", "fc", ["feature"], "n") is None


def test_of_pages_of_one_url_the_first_is_indexed(spark, tmp_path):
    rows = [(7, "a", "x y z v"), (3, "a", "x"), (5, "a", "x y"), (1, "a", None), (2, "b", None), (9, "c", "u v")]
    spark.createDataFrame(rows, "place long, url string, text string").repartition(3, "place").write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(0, "a", "late")], "place long, url string, text string").write.parquet(f"{tmp_path}/late")
    for part in ("in", "late"):
        pages = spark.readStream.schema("place long, url string, text string").parquet(f"{tmp_path}/{part}")
        online.stream_index(pages, f"{tmp_path}/index", f"{tmp_path}/log-{part}")
    got = {(r["url"], r["word"]) for r in spark.read.parquet(f"{tmp_path}/index/postings").collect()}
    assert got == {("a", "x"), ("c", "u"), ("c", "v")}


def test_equal_queries_meet_the_net_once(spark):
    rows = [(k, [1, 2], [7, 8], 7) for k in range(5)] + [(10, [2, 1], [8], 8), (11, [3], [7, 9], None), (12, None, [7], 7), (13, [3], None, 7), (14, [3], [7, 9], None)]
    asked = spark.createDataFrame(rows, "query long, words array<long>, urls array<long>, selected long")
    assert sorted(r["n"] for r in clicknet._alike(asked, "words", "urls").collect()) == [1, 1, 1, 2, 5]
    words, urls = clicknet.hidden_nodes(asked)
    hidden, scores = (t.toPandas() for t in clicknet.net_scores(asked, words, urls))
    assert sorted(scores["query"]) == sorted(q for q, _, shown, _ in rows for _ in shown or [])
    for q, *_ in rows:
        one = asked.where(f"query = {q}") if q in (0, 11, 12, 13) else None
        if one is not None:
            h, s = (t.toPandas() for t in clicknet.net_scores(one, words, urls))
            assert dict(zip(h["hidden"], h["ah"])) == pytest.approx({r.hidden: r.ah for r in hidden[hidden["query"] == q].itertuples()})
            assert dict(zip(s["url"], s["score"])) == pytest.approx({r.url: r.score for r in scores[scores["query"] == q].itertuples()})


def test_equal_clicks_change_edges_by_their_number(spark):
    rows = [(k, [1, 2], [7, 8], 7) for k in range(5)] + [(9, [2, 3], [8], 8)]
    asked = spark.createDataFrame(rows, "query long, words array<long>, urls array<long>, selected long")
    net = clicknet.hidden_nodes(asked)
    edges = lambda t: {tuple(r)[:2]: r["w"] for r in t.collect()}
    start, whole = [edges(t) for t in net], [edges(t) for t in clicknet.net_train(asked, *net, 0.1)]
    parts = [[edges(t) for t in clicknet.net_train(asked.where(f"query = {q}"), *net, 0.1)] for q in (0, 9)]
    for side in (0, 1):
        first = {k: -0.2 if side == 0 else 0.0 for p in parts for k in p[side]} | start[side]
        told = {k: v + 5 * (parts[0][side].get(k, v) - v) + (parts[1][side].get(k, v) - v) for k, v in first.items()}
        assert whole[side] == pytest.approx(told)

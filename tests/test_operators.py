"""Files, streams, searches and nets on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import words_len
from tessera.jobs import online
from tessera.operators import clicknet, cluster, factor, knn, plans, search, tree
from tessera.operators.matrix import read_matrix, write_matrix
from tessera.sources import files


def test_matrix_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.5), ("", "x", 9.0)], "row_id string, col_id string, value double")
    write_matrix(cells, ["x", "y"], str(tmp_path / "m"))
    got = {(r["row_id"], r["col_id"]): r["value"] for r in read_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {("a", "x"): 1.0, ("a", "y"): 0.0, ("b", "x"): 0.0, ("b", "y"): 2.5}


def test_flights_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text("A,B,6:05,8:10,90\nA,B,7:00,9:00,80\nB,A,10:30,12:00,70\n")
    rows = {(r["origin"], r["idx"]): (r["depart_min"], r["arrive_min"], r["price"]) for r in files.read_flights(spark, str(tmp_path / "f.csv")).collect()}
    assert rows == {("A", 0): (365, 490, 90), ("A", 1): (420, 540, 80), ("B", 0): (630, 720, 70)}


def test_matches_libsvm_and_xml(spark, tmp_path):
    (tmp_path / "m.csv").write_text("39,43,1\n23,30,0\n")
    rows = files.read_matches(spark, str(tmp_path / "m.csv")).orderBy("match").collect()
    assert [(list(r["features"]), r["match"]) for r in rows] == [([23.0, 30.0], 0), ([39.0, 43.0], 1)]
    (tmp_path / "s.txt").write_text("1 1:0.5 3:2\n0 2:1\n")
    assert files.read_libsvm(spark, str(tmp_path / "s.txt"), 3).count() == 2
    x = spark.createDataFrame([("<r><a>1</a><b>x</b><a>2</a><b>y</b><c/></r>",)], "x string")
    assert x.select(files.xml_value(F.col("x"), "a"), files.xml_value(F.col("x"), "c"), files.xml_value(F.col("x"), "d")).first()[:] == ("1", "-1", "-1")
    assert [(r["a"], r["b"]) for r in files.xml_records(x, "x", ["a", "b"]).collect()] == [("1", "x"), ("2", "y")]
    (tmp_path / "e.xml").write_text("<f><item><title>t</title><description>d</description></item><item><title>u</title></item></f>")
    assert sorted((r["title"], r["text"]) for r in files.read_entries(spark, str(tmp_path / "e.xml")).collect()) == [("t", "d"), ("u", "")]


def test_models_round_trip(spark, tmp_path):
    files.save_model_tables({"a": spark.range(3)}, str(tmp_path))
    assert files.load_model_tables(spark, str(tmp_path), ["a"])["a"].count() == 3


def test_phrase_needs_neighbours(spark):
    docs = spark.createDataFrame([(1, "bank of america"), (2, "bank america")], "doc_id long, text string")
    index = search.postings(docs, "doc_id")
    assert [r["doc_id"] for r in search.match_postings(index, ["bank", "america"], phrase=True).collect()] == [2]
    assert search.match_postings(index, ["bank", "america"]).count() == 2
    known = search.match_postings(index, ["bank"]).collect()
    assert known and search.match_postings(index, ["bank", "nothing"]).collect() == known
    assert sorted(r["doc_id"] for r in search.match_postings(index, ["nothing", "bank", "never", "america"], phrase=True).collect()) == [2]
    assert search.match_postings(index, ["nothing"]).count() == 0 and search.match_postings(index, []).count() == 0


def test_click_makes_its_url_rise(spark):
    clicks = spark.createDataFrame([(1, [101, 103], [201, 202, 203], 201)], "query long, words array<int>, urls array<int>, selected int")
    words, urls = clicknet.hidden_nodes(clicks)
    before = {r["url"]: r["score"] for r in clicknet.net_scores(clicks, words, urls)[1].collect()}
    assert before[201] == pytest.approx(np.tanh(0.1 * np.tanh(1.0)))
    after = {r["url"]: r["score"] for r in clicknet.net_scores(clicks, *clicknet.net_train(clicks, words, urls))[1].collect()}
    assert after[201] > 0.3 and after[202] < before[202]


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(3)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(3)
    queries = data.where("id % 50 = 0").select(F.col("id").alias("query"), "features")
    got = {(r["query"], r["rank"]): r["id"] for r in knn.nearest(queries, data, 4).collect()}
    for q in range(0, 300, 50):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(axis=1)), 9)
        assert [got[q, k + 1] for k in range(4)] == sorted(range(300), key=lambda i: (d[i], i))[:4]


def brute_merges(vs, all_nearest):
    """Merges of vectors {id: array} by plain Euclidean distances."""
    alive, out, made, step = dict(vs), [], 0, 0
    while len(alive) > 1:
        near = sorted((round(float(np.sqrt(((alive[i] - alive[j]) ** 2).sum())), 12), i, j) for i in alive for j in alive if i < j)
        best = {n: next(p for p in near if n in p[1:]) for n in alive}
        chosen = sorted({p for p in near if best[p[1]] == best[p[2]] == p}) if all_nearest else near[:1]
        for d, i, j in chosen:
            made += 1
            out.append((-made, i, j, round(d, 9), step))
            alive[-made] = (alive.pop(i) + alive.pop(j)) / 2
        step += 1
    return out


@pytest.mark.parametrize("all_nearest", [False, True])
def test_hierarchy_equals_brute_force(spark, all_nearest):
    rng = np.random.default_rng(2)
    vs = {i: rng.integers(0, 6, 3).astype(float) for i in range(9)}  # ties and equal vectors
    rows = [(i, x.tolist()) for i, x in vs.items()] + [(None, [1.0, 2.0, 3.0]), (50, None)]
    merges = cluster.hcluster(spark.createDataFrame(rows, "id long, features array<double>").repartition(3), "straight", all_nearest).collect()
    assert sorted(((r["id"], r["left"], r["right"], round(r["distance"], 9), r["round"]) for r in merges), reverse=True) == brute_merges(vs, all_nearest)


def test_hierarchy_of_few_vectors(spark):
    one = spark.createDataFrame([(1, [0.0])], "id long, features array<double>")
    assert cluster.hcluster(one).count() == 0 and cluster.hcluster(one.limit(0)).count() == 0


def test_nmf_cost_never_rises(spark):
    rng = np.random.default_rng(3)
    v = rng.random((6, 2)) @ rng.random((2, 5))
    cells = spark.createDataFrame([(i, j, float(v[i, j])) for i in range(6) for j in range(5)], "row long, col long, value double")
    rows, cols = factor.start_factors(cells, 2)
    costs = [factor.nmf_cost(cells, rows, cols, 2)]
    for _ in range(3):
        rows, cols = factor.nmf_step(cells, rows, cols, 2)
        costs.append(factor.nmf_cost(cells, rows, cols, 2))
    assert all(b <= a + 1e-9 for a, b in zip(costs, costs[1:]))


def test_tree_shares_add_up(spark):
    rows = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, "ab"[i % 2], "xy"[(i % 7 > 3)]) for i in range(70)], "id long, n double, w string, label string")
    nodes = tree.grow_tree(rows, ["n"], ["w"], "label", 0.001, 3)
    shares = tree.tree_classify(rows, nodes, ["n"], ["w"]).groupBy("id").agg(F.sum("share").alias("s")).collect()
    assert len(shares) == 70 and all(r["s"] == pytest.approx(1) for r in shares)


def test_dorm_picks(spark):
    c = spark.createDataFrame([(1, [0, 0, 0])], "cand_id long, genes array<int>")
    assert c.select(plans.dorm_slots(F.col("genes"), ["A", "B"], 2)).first()[0] == ["A", "A", "B"]


def test_guesses_use_what_was_learned_before(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(online.BATCHES))
    batches = {}
    for r in docs.select("doc_id", F.col("lang"), F.array_distinct(words_len(F.col("text"))).alias("f"), part.alias("part")).collect():
        batches.setdefault(r["part"], []).append(r)
    assert len(batches) > 2
    fc, cc, scores = {}, {}, {}
    for k in sorted(batches):
        for r in batches[k]:
            of = {}
            for c, n in cc.items():
                of[c] = np.log(n / sum(cc.values()))
                for w in r["f"]:
                    total = sum(fc.get(w, {}).values())
                    of[c] += np.log((0.5 + total * fc.get(w, {}).get(c, 0) / n) / (1 + total))
            scores[r["doc_id"]] = of
        for r in batches[k]:
            cc[r["lang"]] = cc.get(r["lang"], 0) + 1
            for w in r["f"]:
                seen = fc.setdefault(w, {})
                seen[r["lang"]] = seen.get(r["lang"], 0) + 1
    got = {r["doc_id"]: r["guess"] for r in online.t2_guess_then_train(spark, sf_dir).collect()}
    assert got.keys() == scores.keys()
    for i, of in scores.items():
        assert got[i] == "unknown" if not of else of[got[i]] == pytest.approx(max(of.values()), abs=1e-6)
    assert sum(g == "unknown" for g in got.values()) == len(batches[min(batches)])


def test_places_and_top_matches_without_common_items(spark):
    from pyspark.sql import functions as F

    from tessera.operators.ratings import top_matches
    from tessera.shared import numbered

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    got = numbered(rows, [F.desc("g"), F.col("x")], "k").collect()
    assert [(r["g"], r["x"]) for r in sorted(got, key=lambda r: r["k"])] == sorted(((r["g"], r["x"]) for r in got), key=lambda t: (-t[0], t[1]))
    assert sorted(r["k"] for r in got) == list(range(1, 1001))
    assert numbered(rows.limit(0), [F.col("x")], "k").count() == 0

    # user 0 met the users from 30 down in steps of 3, user 1 nobody, user 40 has no rating at all
    rated = [(0, 0, 1.0)] + [(u, u % 3 if u > 1 else 9, 2.0) for u in range(1, 31)]
    ratings = spark.createDataFrame(rated, "user int, item int, rating double")
    persons = spark.createDataFrame([(0,), (1,), (40,)], "user int")
    got = {}
    for r in top_matches(ratings, persons, 14).orderBy("user", "rank").collect():
        got.setdefault(r["user"], []).append(r["other"])
    met = [u for u in range(30, 1, -1) if u % 3 == 0]
    assert got[0] == met + [u for u in range(30, 0, -1) if u not in met][:4]
    assert got[1] == list(range(30, 16, -1)) and got[40] == list(range(30, 16, -1))

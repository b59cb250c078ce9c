"""Queries of the index, link ranks, ranked search and the click net."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import clicknet as C
from tessera.operators import docnet as D
from tessera.operators import search as S
from tessera.sources.tables import LINKS_SQL, links, nodes, table

WORDS = (("q1", ("for", "from")), ("q2", ("that",)), ("q3", ("be", "are", "on")))


def _index(spark, d):
    return S.postings(table(spark, d, "documents"), "doc_id")


def _ask(spark):
    return spark.createDataFrame([(q, i, w) for q, ws in WORDS for i, w in enumerate(ws)], "query string, pos int, word string")


def m1_build_index(spark, d):
    return _index(spark, d).groupBy("word").agg(F.count("*").alias("n"), F.sum("location").alias("places"), F.countDistinct("doc_id").alias("docs"))


def p24_links(spark, d):
    return S.extract_links(table(spark, d, "pages"))


def j2_match_postings(spark, d):
    rows = S.match_postings(_index(spark, d), ["for", "zzxqj", "from"])  # the second is in no text
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("loc0") + F.col("loc1")).alias("places"))


def j3_phrase_match(spark, d):
    return S.match_postings(_index(spark, d), ["for", "from"], phrase=True).select("doc_id", F.col("loc0").cast("long").alias("loc0"), F.col("loc1").cast("long").alias("loc1"))


def a12_pagerank(spark, d):
    return S.pagerank(nodes(spark, d), links(spark, d)).select("node", F.round("score", 6).alias("score"))


def _doc_links(spark, d):
    n = table(spark, d, "documents").count()
    return links(spark, d).select((F.col("from_id") % n).alias("from_id"), (F.col("to_id") % n).alias("to_id")).where("from_id <> to_id")


def _ranks(spark, d):
    ids = table(spark, d, "documents").select(F.col("doc_id").alias("node"))
    return ids.select("node", ((F.col("node") * 37 % 101) / 50.0 + 0.15).alias("score"))


def _linked_words(spark, d):
    words = table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("x"))
    n = table(spark, d, "documents").count()
    return words.select((F.col("p_partkey") % n).alias("from_id"), (F.col("p_partkey") * 7 % n).alias("to_id"), F.when(F.length("x") % 2 == 0, "for").otherwise("that").alias("word"))


def _scores(spark, d):
    return S.search_scores(_index(spark, d), _ask(spark), _doc_links(spark, d), _ranks(spark, d), linked_words=_linked_words(spark, d))


def j10_anchor_hits(spark, d):
    docs = table(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id")
    results = docs.withColumn("query", F.explode(F.array(*[F.lit(q) for q, _ in WORDS])))
    return S.anchor_hits(_linked_words(spark, d), _ask(spark), _ranks(spark, d), results, "doc_id").select("query", "doc_id", F.round("linktext", 6).alias("linktext"))


def a13_search_scores(spark, d):
    names = ("frequency", "location", "distance", "inbound", "rank", "length", "linktext")
    return _scores(spark, d).select("query", "doc_id", *[F.round(c, 6).alias(c) for c in names])


def _one_score(column):
    def query(spark, d):
        return _scores(spark, d).select("query", "doc_id", F.round(column, 6).alias("score"))

    return query


def a20_normalise_scores(spark, d):
    """Inbound links of each node, scaled within five groups of nodes in both directions."""
    counts = links(spark, d).groupBy("to_id").agg(F.count("*").cast("double").alias("n"))
    by = Window.partitionBy(F.col("to_id") % 5)
    return counts.select("to_id", F.round(S.normalise(F.col("n"), False, by), 6).alias("more"), F.round(S.normalise(F.col("n"), True, by), 6).alias("less"))


def w7_ranked_search(spark, d):
    names = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("url"))
    return S.ranked_search(_scores(spark, d), names)


def a41_outbound_relevant(spark, d):
    found = S.match_postings(_index(spark, d), ["for", "from"]).select("doc_id")
    return S.outbound_relevant(_doc_links(spark, d), found, "doc_id", 50)


def _clicks(spark, d):
    e = table(spark, d, "events")
    words = F.array_distinct(F.array(F.col("user_id") % 13, F.col("user_id") % 7 + 20))
    return e.select(F.col("event_id").alias("query"), words.alias("words"), F.array(*[(F.col("user_id") + k) % 5 + 100 for k in range(3)]).alias("urls"), (F.col("user_id") % 5 + 100).alias("selected"))


def m16_click_net_nodes(spark, d):
    w, u = C.hidden_nodes(_clicks(spark, d))
    return w.select(F.concat(F.lit("w"), F.col("word")).alias("a"), F.col("hidden").alias("b"), F.round("w", 6).alias("w")).union(u.select(F.col("hidden"), F.concat(F.lit("u"), F.col("url")), F.col("w")))


def m17_click_net_score(spark, d):
    c = _clicks(spark, d)
    return C.net_scores(c, *C.hidden_nodes(c))[1].select("query", "url", F.round("score", 6).alias("score"))


def m18_click_net_train(spark, d):
    c = _clicks(spark, d)
    w, u = C.net_train(c, *C.hidden_nodes(c), rate=0.001)
    return u.select("hidden", "url", F.round("w", 6).alias("w"))


def _entries(spark, d):
    """Parts as documents: the words of their names, and the maker as category."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("words"), F.col("p_brand").alias("category"))


def m19_doc_net_scores(spark, d):
    """Entries by a new net, and by one that a batch of all has trained."""
    e = _entries(spark, d)
    net = D.doc_nodes(e)
    asked = e.select(F.col("id").alias("query"), "words")
    new, trained = D.doc_scores(asked, *net), D.doc_scores(asked, *D.doc_train(e, *net, rate=0.001))
    return new.join(trained.withColumnRenamed("score", "after"), ["query", "category"]).select("query", "category", F.round("score", 6).alias("score"), F.round("after", 6).alias("after"))


def m19_doc_net_train(spark, d):
    e = _entries(spark, d)
    words, categories = D.doc_train(e, *D.doc_nodes(e), rate=0.001)
    return words.select(F.col("word").alias("a"), F.col("hidden").alias("b"), F.round("w", 6).alias("w")).union(categories.select("hidden", "category", F.round("w", 6)))


QUERIES = {f.__name__: f for f in (m19_doc_net_scores, m19_doc_net_train, m1_build_index, p24_links, j2_match_postings, j3_phrase_match, a12_pagerank, j10_anchor_hits, a13_search_scores, w7_ranked_search, a41_outbound_relevant, m16_click_net_nodes, m17_click_net_score, m18_click_net_train, a20_normalise_scores)}

#: Queries of one score each, by its column.
SCORES = {"a14_score_location": "location", "a15_score_distance": "distance", "a16_score_inbound": "inbound", "a17_score_pagerank": "rank", "a18_score_linktext": "linktext", "a19_score_length": "length"}
QUERIES.update({name: _one_score(column) for name, column in SCORES.items()})

_I = r"""i AS (SELECT doc_id, word, location FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS location FROM (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\W+'), lambda w: w <> ''), lambda w: lower(w)) AS l FROM documents))
WHERE word NOT IN ('the', 'of', 'to', 'and', 'a', 'in', 'is', 'it'))"""
_J = _I + ", m AS (SELECT a.doc_id, a.location AS l0, b.location AS l1 FROM i a JOIN i b ON a.doc_id = b.doc_id WHERE a.word = 'for' AND b.word = 'from')"
_ROUNDS = "".join(f", r{k} AS (SELECT n.node, 0.15 + coalesce(sum(0.85 * r.score / d.degree), 0) AS score FROM nodes n LEFT JOIN e ON e.to_id = n.node LEFT JOIN r{k - 1} r ON r.node = e.from_id LEFT JOIN d ON d.from_id = e.from_id GROUP BY 1)" for k in range(1, 21))
_DL = "dl AS (SELECT * FROM (SELECT from_id % n AS from_id, to_id % n AS to_id FROM links, (SELECT count(*) AS n FROM documents)) WHERE from_id <> to_id)"
_NORM = "{0} / CASE WHEN max({0}) OVER q = 0 THEN 1e-5 ELSE max({0}) OVER q END"
_SCORES = f"""{LINKS_SQL}, {_I}, {_DL}, c AS (
  SELECT 'q1' AS query, a.doc_id, count(*) AS n, min(a.location + b.location) AS f, min(abs(a.location - b.location)) AS dist, 2 AS k FROM i a JOIN i b USING (doc_id) WHERE a.word = 'for' AND b.word = 'from' GROUP BY 2
  UNION ALL SELECT 'q2', doc_id, count(*), min(location), 0, 1 FROM i WHERE word = 'that' GROUP BY 2
  UNION ALL SELECT 'q3', a.doc_id, count(*), min(a.location + b.location + x.location), min(abs(a.location - b.location) + abs(b.location - x.location)), 3 FROM i a JOIN i b USING (doc_id) JOIN i x USING (doc_id) WHERE a.word = 'be' AND b.word = 'are' AND x.word = 'on' GROUP BY 2),
len AS (SELECT doc_id, max(location)::DOUBLE AS len FROM i GROUP BY 1), inb AS (SELECT to_id AS doc_id, count(*)::DOUBLE AS inb FROM dl GROUP BY 1),
rk AS (SELECT doc_id, (doc_id * 37 % 101) / 50.0::DOUBLE + 0.15 AS rk FROM documents),
ln AS (SELECT p_partkey % n AS from_id, p_partkey * 7 % n AS to_id, CASE WHEN length(x) % 2 = 0 THEN 'for' ELSE 'that' END AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part), (SELECT count(*) AS n FROM documents)),
lt AS (SELECT query, to_id AS doc_id, sum(rk) AS lt FROM ln JOIN (VALUES ('q1', 'for'), ('q1', 'from'), ('q2', 'that'), ('q3', 'be'), ('q3', 'are'), ('q3', 'on')) w(query, word) USING (word) JOIN rk ON rk.doc_id = from_id GROUP BY 1, 2),
x AS (SELECT query, doc_id, k, coalesce(n / nullif(len, 0), 0) AS fr, least(f, 1000000)::DOUBLE AS f, dist::DOUBLE AS dist, coalesce(inb, 0) AS inb, rk, len, coalesce(lt, 0) AS lt FROM c JOIN len USING (doc_id) LEFT JOIN inb USING (doc_id) LEFT JOIN rk USING (doc_id) LEFT JOIN lt USING (query, doc_id)),
s AS (SELECT query, doc_id, {_NORM.format("fr")} AS frequency, min(f) OVER q / greatest(f, 1e-5) AS location, CASE WHEN k = 1 THEN 1.0 ELSE min(dist) OVER q / greatest(dist, 1e-5) END AS distance, {_NORM.format("inb")} AS inbound, {_NORM.format("rk")} AS "rank", {_NORM.format("len")} AS "length", {_NORM.format("lt")} AS linktext FROM x WINDOW q AS (PARTITION BY query))"""

_CL = """c AS (SELECT event_id AS query, list_distinct([user_id % 13, user_id % 7 + 20]) AS words, [(user_id + 0) % 5 + 100, (user_id + 1) % 5 + 100, (user_id + 2) % 5 + 100] AS urls, user_id % 5 + 100 AS selected FROM events),
h AS (SELECT *, array_to_string(list_sort(list_transform(words, lambda w: w::VARCHAR)), '_') AS hidden FROM c),
wh AS (SELECT word, hidden, max(w) AS w FROM (SELECT unnest(words) AS word, hidden, 1.0::DOUBLE / len(words) AS w FROM h) GROUP BY 1, 2), hu AS (SELECT DISTINCT hidden, unnest(urls) AS url, 0.1::DOUBLE AS w FROM h),
a AS (SELECT query, unnest(words) AS word FROM c), sh AS (SELECT query, unnest(urls) AS url FROM c),
n AS (SELECT query, hidden FROM a JOIN wh USING (word) UNION SELECT query, hidden FROM sh JOIN hu USING (url)),
ah AS (SELECT n.query, n.hidden, tanh(sum(coalesce(wh.w, -0.2))) AS ah FROM n JOIN a ON a.query = n.query LEFT JOIN wh ON wh.word = a.word AND wh.hidden = n.hidden GROUP BY 1, 2),
o AS (SELECT sh.query, sh.url, coalesce(tanh(sum(coalesce(hu.w, 0) * ah.ah)), 0) AS score FROM sh LEFT JOIN ah ON ah.query = sh.query LEFT JOIN hu ON hu.hidden = ah.hidden AND hu.url = sh.url GROUP BY 1, 2)"""

ORACLE_SQL = {
    "m1_build_index": f"WITH {_I} SELECT word, count(*) AS n, sum(location)::BIGINT AS places, count(DISTINCT doc_id) AS docs FROM i GROUP BY 1",
    "j2_match_postings": f"WITH {_J} SELECT doc_id, count(*) AS n, sum(l0 + l1)::BIGINT AS places FROM m GROUP BY 1",
    "j3_phrase_match": f"WITH {_J} SELECT doc_id, l0::BIGINT AS loc0, l1::BIGINT AS loc1 FROM m WHERE l1 = l0 + 1",
    "a12_pagerank": f"WITH {LINKS_SQL}, d AS (SELECT from_id, count(*) AS degree FROM links GROUP BY 1), e AS (SELECT DISTINCT from_id, to_id FROM links), r0 AS (SELECT node, 1.0::DOUBLE AS score FROM nodes){_ROUNDS} SELECT node, round(score, 6) AS score FROM r20",
    "a13_search_scores": f"WITH {_SCORES} SELECT query, doc_id, round(frequency, 6) AS frequency, round(location, 6) AS location, round(distance, 6) AS distance, round(inbound, 6) AS inbound, round(\"rank\", 6) AS \"rank\", round(\"length\", 6) AS \"length\", round(linktext, 6) AS linktext FROM s",
    "w7_ranked_search": f"""WITH {_SCORES}, t AS (SELECT query, 'doc/' || lpad(doc_id::VARCHAR, 9, '0') AS url, round(0.18*frequency + 0.14*location + 0.24*distance + 0.15*"rank" + 0.15*"length" + 0.15*inbound, 6) AS score FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, url DESC)::INT AS k FROM t) WHERE k <= 10""",
    "a41_outbound_relevant": f"WITH {LINKS_SQL}, {_J}, {_DL}, t AS (SELECT to_id AS target, count(*) AS n FROM dl WHERE from_id IN (SELECT doc_id FROM m) GROUP BY 1) SELECT target, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, target DESC) AS k FROM t) WHERE k <= (SELECT count(*) // 50 FROM t)",
    "m16_click_net_nodes": f"WITH {_CL} SELECT 'w' || (word::VARCHAR) AS a, hidden AS b, round(w, 6) AS w FROM wh UNION ALL SELECT hidden, 'u' || (url::VARCHAR), w FROM hu",
    "m18_click_net_train": f"""WITH {_CL}, od AS (SELECT o.query, o.url, ((o.url = c.selected)::INT - score) * (1 - score * score) AS d FROM o JOIN c USING (query)),
up AS (SELECT hidden, url, sum(0.001 * d * ah) AS d FROM ah JOIN od USING (query) GROUP BY 1, 2)
SELECT hidden, url, round(coalesce(hu.w, 0) + coalesce(up.d, 0), 6) AS w FROM up FULL JOIN hu USING (hidden, url)""",
    "m17_click_net_score": f"WITH {_CL} SELECT query, url, round(score, 6) AS score FROM o",
}

ORACLE_SQL["j10_anchor_hits"] = """
WITH n AS (SELECT count(*) AS c FROM documents),
t AS (SELECT p_partkey % c AS from_id, p_partkey * 7 % c AS doc_id, CASE WHEN length(x) % 2 = 0 THEN 'q1' ELSE 'q2' END AS query FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x FROM part), n)
SELECT query, t.doc_id, round(sum((from_id * 37 % 101) / 50.0 + 0.15), 6) AS linktext FROM t JOIN documents f ON f.doc_id = from_id JOIN documents r ON r.doc_id = t.doc_id WHERE t.doc_id % 3 = 0 GROUP BY 1, 2"""

ORACLE_SQL.update({name: f'WITH {_SCORES} SELECT query, doc_id, round("{column}", 6) AS score FROM s' for name, column in SCORES.items()})
ORACLE_SQL["a20_normalise_scores"] = f"""WITH {LINKS_SQL}, n AS (SELECT to_id, count(*)::DOUBLE AS n FROM links GROUP BY 1)
SELECT to_id, round(n / max(n) OVER w, 6) AS more, round(min(n) OVER w / n, 6) AS less FROM n WINDOW w AS (PARTITION BY to_id % 5)"""

_NET = """e AS (SELECT p_partkey AS query, list_sort(list_distinct(string_split(concat_ws(' ', p_name, p_type), ' '))) AS words, p_brand AS category FROM part),
n AS (SELECT DISTINCT array_to_string(words, '_') AS hidden, words FROM e), k AS (SELECT DISTINCT category FROM e), x AS (SELECT query, unnest(words) AS word FROM e),
wh AS (SELECT unnest(words) AS word, hidden, 1.0::DOUBLE / len(words) AS w FROM n), hu AS (SELECT hidden, category, 0.1::DOUBLE AS w FROM n, k),
overlap AS (SELECT x.query, wh.hidden, sum(wh.w + 0.2) AS s FROM x JOIN wh USING (word) GROUP BY 1, 2),
ah AS MATERIALIZED (SELECT e.query, n.hidden, tanh(coalesce(s, 0) - 0.2 * len(e.words)) AS ah FROM e CROSS JOIN n LEFT JOIN overlap ON overlap.query = e.query AND overlap.hidden = n.hidden),
o AS MATERIALIZED (SELECT query, category, tanh(sum(ah * w)) AS score FROM ah JOIN hu USING (hidden) GROUP BY 1, 2),
od AS MATERIALIZED (SELECT o.query, o.category, ((o.category = e.category)::INT - score) * (1 - score * score) AS d FROM o JOIN e USING (query)),
hd AS MATERIALIZED (SELECT ah.query, hidden, (1 - ah * ah) * sum(od.d) * 0.1 AS d FROM ah JOIN od USING (query) GROUP BY ah.query, hidden, ah),
w2 AS MATERIALIZED (SELECT word, hidden, coalesce(wh.w, -0.2) + coalesce(c.d, 0) AS w FROM (SELECT word, hidden, sum(0.001 * d) AS d FROM hd JOIN x USING (query) GROUP BY 1, 2) c FULL JOIN wh USING (word, hidden)),
u2 AS MATERIALIZED (SELECT hidden, category, 0.1 + sum(0.001 * d * ah) AS w FROM ah JOIN od USING (query) GROUP BY 1, 2)"""
ORACLE_SQL["m19_doc_net_train"] = f"WITH {_NET} SELECT word AS a, hidden AS b, round(w, 6) AS w FROM w2 UNION ALL SELECT hidden, category, round(w, 6) FROM u2"
ORACLE_SQL["m19_doc_net_scores"] = f"""WITH {_NET}, h2 AS (SELECT query, hidden, tanh(sum(w)) AS ah FROM x JOIN w2 USING (word) GROUP BY 1, 2), o2 AS (SELECT query, category, tanh(sum(ah * w)) AS after FROM h2 JOIN u2 USING (hidden) GROUP BY 1, 2)
SELECT query, category, round(score, 6) AS score, round(after, 6) AS after FROM o JOIN o2 USING (query, category)"""

_A = r"""(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>"""
#: Paths without dot segments, as the pages have them.
ORACLE_SQL["p24_links"] = rf"""
WITH a AS (SELECT url, unnest(regexp_extract_all(html, '{_A}', 1)) AS href, unnest(regexp_extract_all(html, '{_A}', 2)) AS text FROM pages),
t AS (SELECT url, regexp_replace(text, '<[^>]+>', '', 'g') AS text, split_part(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(url, '^[^:]*:') || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || href
  ELSE regexp_extract(url, '^[^?#]*/') || href END, '#', 1) AS target FROM a)
SELECT url, target, text FROM t WHERE target NOT LIKE '%''%' AND target <> url"""

"""Queries on texts, word counts and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import matrix as M
from tessera.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang")


def _digest(words):
    """Rows of word arrays told apart cheaply: how many words, and a checksum of all of them."""
    return F.size(words).cast("long").alias("n"), F.md5(F.array_join(words, "|")).alias("digest")


def _per_doc(words):
    def query(spark, d):
        return _docs(spark, d).select("doc_id", *_digest(words(F.col("text"))))

    return query


def p1_strip_tags(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("plain"), F.md5(X.strip_tags(F.col("html"), spaced=True)).alias("spaced"))


def p2_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.page_text(F.col("html")).alias("text"))


def p7_clean_items(spark, d):
    return table(spark, d, "part").select("p_partkey", X.clean_item(F.col("p_name")).alias("item"))


def p8_entry_features(spark, d):
    docs = _docs(spark, d)
    title = F.substring_index("text", "\n", 1)
    rest = F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
    return docs.select("doc_id", *_digest(F.array_sort(X.entry_features(title, rest, F.col("source")))))


def p9_mail_features(spark, d):
    turns = table(spark, d, "conversations")
    f = X.mail_features(F.col("role"), F.substring_index("text", " ", 5), F.col("text"), F.col("conv_id").cast("string"))
    return turns.select("conv_id", "turn", *_digest(F.array_sort(f)))


def p12_nonzero_features(spark, d):
    cells = table(spark, d, "events").groupBy(F.col("user_id").alias("row_id"), F.col("event_type").alias("col_id")).agg(F.sum("value").alias("value"))
    return M.nonzero_features(cells).select("row_id", F.array_join("features", ",").alias("features"))


def p13_minutes(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat((F.col("l_partkey") % 24).cast("string"), F.lit(":"), F.lpad((F.col("l_suppkey") % 60).cast("string"), 2, "0")).alias("time"))
    return lines.groupBy("time").agg(F.count("*").alias("n")).select("time", X.minutes(F.col("time")).alias("minutes"), "n")


def p14_parse_price(spark, d):
    price = F.concat(F.lit("$"), F.format_number("p_retailprice", 2))
    return table(spark, d, "part").select("p_partkey", X.parse_price(price).alias("price"))


def p15_yesno(spark, d):
    answer = F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").otherwise("maybe")
    return table(spark, d, "orders").select("o_orderkey", X.yesno(answer).alias("answer"))


def p16_match_count(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(":")).alias("a"))
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return parts.join(after, "p_partkey").select("p_partkey", X.match_count(F.col("a"), F.col("b")).alias("common"))


def _source_counts(spark, d):
    return M.term_counts(_docs(spark, d), "source", X.words_alpha(F.col("text")))


def a6_term_counts(spark, d):
    return _source_counts(spark, d)


def a7_vocab_by_doc_share(spark, d):
    return M.vocab_by_doc_share(_source_counts(spark, d), "source", _docs(spark, d)).select("term", F.round("share", 6).alias("share"))


def a8_vocab_by_total(spark, d):
    docs = _docs(spark, d)
    return M.vocab_by_total(M.term_counts(docs, "doc_id", X.words_gt3(F.col("text"))), docs.agg(F.count("*").alias("n_docs")))


def _wants(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("item"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select("item", "user")


def a9_wanted_items(spark, d):
    return M.wanted_items(_wants(spark, d))


def _posts(spark, d):
    events = table(spark, d, "events")
    tags = F.concat_ws(" ", F.col("event_type"), F.concat(F.lit("h"), F.col("user_id") % 7), F.lit("all"))
    return events.select(F.col("user_id").alias("user"), F.concat(F.lit("u"), (F.col("event_id") if "event_id" in events.columns else F.col("user_id")) % 97).alias("href"), tags.alias("tags"))


def a10_tag_user_counts(spark, d):
    return M.tag_user_counts(_posts(spark, d))


def j13_seed_from_popular(spark, d):
    return M.seed_from_popular(_posts(spark, d), "all", 15)


def j12_frontier_step(spark, d):
    from tessera.sources.tables import links

    edges = links(spark, d).select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    start = table(spark, d, "part").where("p_partkey % 500 = 0").select(F.col("p_partkey").alias("node"))
    return M.frontier(edges, start, 2)


def u1_merge_counts(spark, d):
    half = F.col("doc_id") % 2
    counts = lambda k: M.term_counts(_docs(spark, d).where(half == k), "source", X.words_all(F.col("text")))
    return M.merge_counts(counts(0), counts(1), ["source", "term"])


def u2_except_seen(spark, d):
    old = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return M.except_seen(table(spark, d, "customer").select("c_custkey"), old, ["c_custkey"])


def u3_first_title_wins(spark, d):
    docs = _docs(spark, d).select(F.col("doc_id").alias("ord"), F.substring_index("text", "\n", 1).alias("title"))
    return M.first_title_wins(docs)


def u4_already_indexed(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return M.except_seen(pages, pages.where("page_id % 3 = 0"), ["url"])


def s3_write_matrix(spark, d):
    cells = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("row_id"), F.col("event_type").alias("col_id")).agg(F.round(F.sum("value"), 4).alias("value"))
    kinds = [r[0] for r in cells.select("col_id").distinct().orderBy("col_id").collect()]
    return M.to_wide(cells, kinds).unpivot(["row_id"], kinds, "col_id", "value").select("row_id", "col_id", F.round("value", 4).alias("value"))


QUERIES = {
    "p1_strip_tags": p1_strip_tags, "p2_page_text": p2_page_text, "p3_words_alpha": _per_doc(X.words_alpha), "p4_words_all": _per_doc(X.words_all), "p5_words_len": _per_doc(X.words_len), "p6_words_gt3": _per_doc(X.words_gt3),
    "p7_clean_items": p7_clean_items, "p8_entry_features": p8_entry_features, "p9_mail_features": p9_mail_features, "p12_nonzero_features": p12_nonzero_features, "p13_minutes": p13_minutes, "p14_parse_price": p14_parse_price,
    "p15_yesno": p15_yesno, "p16_match_count": p16_match_count, "a6_term_counts": a6_term_counts, "a7_vocab_by_doc_share": a7_vocab_by_doc_share, "a8_vocab_by_total": a8_vocab_by_total, "a9_wanted_items": a9_wanted_items,
    "a10_tag_user_counts": a10_tag_user_counts, "j12_frontier_step": j12_frontier_step, "j13_seed_from_popular": j13_seed_from_popular, "u1_merge_counts": u1_merge_counts, "u2_except_seen": u2_except_seen,
    "u3_first_title_wins": u3_first_title_wins, "u4_already_indexed": u4_already_indexed, "s3_write_matrix": s3_write_matrix,
}


def _w(text: str, sep: str, more: str = "TRUE") -> str:
    return f"list_transform(list_filter(regexp_split_to_array({text}, '{sep}'), lambda w: w <> '' AND {more}), lambda w: lower(w))"


def _doc(words: str) -> str:
    return f"SELECT doc_id, len(w)::BIGINT AS n, md5(array_to_string(w, '|')) AS digest FROM (SELECT doc_id, {words} AS w FROM documents)"


_DISTINCT = "(SELECT list(x ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest({0}) AS x, generate_subscripts({0}, 1) AS i) GROUP BY x))"
_SRC = f"""c AS (SELECT source, term, count(*) AS n FROM (SELECT source, unnest({_w("text", "[^A-Z^a-z]+")}) AS term FROM documents) GROUP BY 1, 2)"""
_POSTS = "p AS (SELECT user_id AS \"user\", 'u' || ((event_id % 97)::VARCHAR) AS href, event_type || ' h' || ((user_id % 7)::VARCHAR) || ' all' AS tags FROM events)"

ORACLE_SQL = {
    "p1_strip_tags": r"SELECT page_id, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS plain, md5(regexp_replace(regexp_replace(html, '<[^>]*>|>', ' ', 'g'), '<[^>]*$', '')) AS spaced FROM pages",
    "p3_words_alpha": _doc(_w("text", "[^A-Z^a-z]+")),
    "p4_words_all": _doc(_w("text", r"\W+")),
    "p6_words_gt3": _doc(_w("text", r"\W+", "length(w) > 3")),
    "p5_words_len": r"""WITH w AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, """ + _w("text", r"\W+", "length(w) > 2 AND length(w) < 20") + r""" AS l FROM documents)),
u AS (SELECT doc_id, x, min(i) AS i FROM w GROUP BY 1, 2), g AS (SELECT doc_id, count(*) AS n, md5(string_agg(x, '|' ORDER BY i)) AS digest FROM u GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0)::BIGINT AS n, coalesce(digest, md5('')) AS digest FROM documents LEFT JOIN g USING (doc_id)""",
    "p7_clean_items": "SELECT p_partkey, CASE WHEN length(j) >= 2 THEN j END AS item FROM (SELECT p_partkey, array_to_string(list_filter(string_split(trim(regexp_replace(lower(p_name), '[!-.]', '', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('a','new','some','more','my','own','the','many','other','another')), ' ') AS j FROM part)",
    "p12_nonzero_features": "SELECT row_id, string_agg(col_id, ',' ORDER BY col_id) AS features FROM (SELECT user_id AS row_id, event_type AS col_id, sum(value) AS v FROM events GROUP BY 1, 2) WHERE v > 0 GROUP BY 1",
    "p13_minutes": "SELECT time, (split_part(time, ':', 1)::INT * 60 + split_part(time, ':', 2)::INT)::INT AS minutes, count(*) AS n FROM (SELECT (l_partkey % 24)::VARCHAR || ':' || lpad((l_suppkey % 60)::VARCHAR, 2, '0') AS time FROM lineitem) GROUP BY 1, 2",
    "p14_parse_price": "SELECT p_partkey, round(p_retailprice::DOUBLE, 2) AS price FROM part",
    "p15_yesno": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END::INT AS answer FROM orders",
    "p16_match_count": "SELECT a.p_partkey, len(list_filter(string_split(a.p_name, ' '), lambda v: list_contains(string_split(b.p_name, ' '), v)))::INT AS common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
    "a6_term_counts": f"WITH {_SRC} SELECT * FROM c",
    "a7_vocab_by_doc_share": f"WITH {_SRC} SELECT term, round(share, 6) AS share FROM (SELECT term, count(*)::DOUBLE / (SELECT count(DISTINCT source) FROM documents) AS share FROM c WHERE n > 1 GROUP BY 1) WHERE share > 0.1 AND share < 0.5",
    "a8_vocab_by_total": f"SELECT term, count(*) AS total FROM (SELECT unnest({_w('text', chr(92) + 'W+', 'length(w) > 3')}) AS term FROM documents) GROUP BY 1 HAVING count(*) > 3 AND count(*) < 0.6 * (SELECT count(*) FROM documents)",
    "a9_wanted_items": "WITH w AS (SELECT DISTINCT l_partkey AS item, o_custkey AS \"user\" FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT item, \"user\", 1 AS value FROM w WHERE item IN (SELECT item FROM w GROUP BY 1 HAVING count(*) > 10)",
    "a10_tag_user_counts": f"WITH {_POSTS}, o AS (SELECT \"user\", tags, unnest(list_distinct(string_split(tags, ' '))) AS tag FROM p) SELECT tag, \"user\", count(*) AS n, (SELECT string_agg(t, '_' ORDER BY t) FROM (SELECT unnest(list_distinct(list(o.tags))) AS t)) AS tags FROM o GROUP BY 1, 2",
    "j13_seed_from_popular": f"WITH {_POSTS}, top AS (SELECT href FROM p WHERE list_contains(string_split(tags, ' '), 'all') GROUP BY 1 ORDER BY count(*) DESC, href LIMIT 15) SELECT DISTINCT \"user\", href AS url, 1.0::DOUBLE AS rating FROM p WHERE \"user\" IN (SELECT \"user\" FROM p WHERE href IN (SELECT href FROM top))",
    "j12_frontier_step": """WITH e AS (SELECT l_partkey AS a, l_orderkey % (SELECT count(*) FROM part) AS b FROM lineitem WHERE l_partkey <> l_orderkey % (SELECT count(*) FROM part)),
s AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 500 = 0), l1 AS (SELECT DISTINCT b AS node FROM e JOIN s ON a = node WHERE b NOT IN (SELECT node FROM s)),
l2 AS (SELECT DISTINCT b AS node FROM e JOIN l1 ON a = node WHERE b NOT IN (SELECT node FROM s) AND b NOT IN (SELECT node FROM l1))
SELECT node, 0 AS level FROM s UNION ALL SELECT node, 1 FROM l1 UNION ALL SELECT node, 2 FROM l2""",
    "u1_merge_counts": f"SELECT source, term, count(*) AS n FROM (SELECT source, unnest({_w('text', chr(92) + 'W+')}) AS term FROM documents) GROUP BY 1, 2",
    "u2_except_seen": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    "u3_first_title_wins": "SELECT min(doc_id) AS ord, split_part(text, chr(10), 1) AS title FROM documents GROUP BY 2",
    "u4_already_indexed": "SELECT page_id, url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)",
    "s3_write_matrix": "WITH e AS (SELECT user_id::VARCHAR AS row_id, event_type AS col_id, round(sum(value), 4) AS value FROM events GROUP BY 1, 2) SELECT r.row_id, c.col_id, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT row_id FROM e) r CROSS JOIN (SELECT DISTINCT col_id FROM e) c LEFT JOIN e ON e.row_id = r.row_id AND e.col_id = c.col_id",
}

_P2 = r"regexp_replace(regexp_replace(html, '<script\b.*?</script\s*>', '', 'gis'), '<style\b.*?</style\s*>', '', 'gis')"
_P2 = rf"regexp_replace(regexp_replace({_P2}, '<!--.*?-->', chr(10), 'gs'), '<[^>]*>', chr(10), 'g')"
for _name, _sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'")):
    _P2 = f"replace({_P2}, '{_name}', {_sign})"
ORACLE_SQL["p2_page_text"] = f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_P2}, chr(10)), lambda t: trim(t)), lambda t: t <> ''), chr(10)) AS text FROM pages"


def _features_sql(titles: str, by: str, flags: str) -> str:
    """Features in the order of their bytes: what `b` gives as prefixed words, words and pairs of the body, flags."""
    words = r"list_filter(regexp_split_to_array({0}, '\W+'), lambda w: length(w) > 2 AND length(w) < 20)"
    told = ", ".join(f"list_transform({words.format(c)}, lambda w: '{p}:' || lower(w))" for p, c in (t.split("=") for t in titles.split()))
    capitals = "10 * len(list_filter(raw, lambda w: w = upper(w) AND w <> lower(w))) > 3 * len(raw)"
    return f"""w AS (SELECT *, {words.format("body")} AS raw FROM b), l AS (SELECT *, list_transform(raw, lambda w: lower(w)) AS low FROM w),
f AS (SELECT *, list_sort(list_distinct(list_filter(flatten([{told}, low, CASE WHEN len(low) > 1 THEN list_transform(generate_series(1, len(low) - 1), lambda i: low[i] || ' ' || low[i + 1]) ELSE [] END, [{by}, CASE WHEN len(raw) > 0 AND {capitals} THEN 'UPPERCASE' END{flags}]]), lambda x: x IS NOT NULL))) AS f FROM l)"""


_ENTRY = ", CASE WHEN length(body) > 250 THEN 'EXCLENGTH' END, CASE WHEN len(raw) > 0 AND 10 * len(list_filter(raw, lambda w: length(w) > 16)) > 3 * len(raw) THEN 'PREPOFLONGWORDS' END"
ORACLE_SQL["p8_entry_features"] = f"""WITH b AS (SELECT doc_id, source, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(substr(text, length(split_part(text, chr(10), 1)) + 2), '') AS body FROM documents),
{_features_sql("Title=title", "'Publisher:' || source", _ENTRY)} SELECT doc_id, len(f)::BIGINT AS n, md5(array_to_string(f, '|')) AS digest FROM f"""
ORACLE_SQL["p9_mail_features"] = f"""WITH b AS (SELECT conv_id, turn, coalesce("role", '') AS sender, coalesce(array_to_string(string_split(text, ' ')[1:5], ' '), '') AS subject, coalesce(text, '') AS body FROM conversations),
{_features_sql("From=sender Subject=subject", "'Ip' || conv_id::VARCHAR", "")} SELECT conv_id, turn, len(f)::BIGINT AS n, md5(array_to_string(f, '|')) AS digest FROM f"""

"""Queries of document classification: documents, their language as the category, every fifth held out."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.text import words_len
from tessera.operators import bayes as B
from tessera.sources.tables import table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("lang").alias("category"), words_len(F.col("text")).alias("features"))


def _counts(spark, d):
    return B.class_counts(_docs(spark, d).where("doc_id % 5 <> 0"))


def a21_class_counts(spark, d):
    return _counts(spark, d)[0]


def a22_feature_probs(spark, d):
    p = B.feature_probs(*_counts(spark, d))
    return p.select("feature", "category", F.round("prob", 6).alias("prob"), F.round("weighted", 6).alias("weighted"))


def j6_doc_features(spark, d):
    fc, cc = _counts(spark, d)
    logs = B.doc_features(_docs(spark, d).where("doc_id % 5 = 0"), B.feature_probs(fc, cc), cc)
    return logs.select("doc_id", "category", F.col("m").cast("long").alias("m"), F.round("logs", 4).alias("logs"))


def a23_naive_bayes(spark, d):
    fc, cc = _counts(spark, d)
    return B.bayes_classify(B.bayes_scores(_docs(spark, d).where("doc_id % 5 = 0"), fc, cc), {"fr": 3.0})


def a24_fisher_prob(spark, d):
    fc, cc = _counts(spark, d)
    return B.fisher_scores(_docs(spark, d).where("doc_id % 5 = 0"), fc, cc).select("doc_id", "category", F.round("score", 4).alias("score"))


def a25_fisher_classify(spark, d):
    fc, cc = _counts(spark, d)
    return B.fisher_classify(B.fisher_scores(_docs(spark, d).where("doc_id % 5 = 0"), fc, cc).withColumn("score", F.round("score", 6)), {"en": 0.6})


QUERIES = {f.__name__: f for f in (a21_class_counts, a22_feature_probs, j6_doc_features, a23_naive_bayes, a24_fisher_prob, a25_fisher_classify)}

_W = r"list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\W+'), lambda w: length(w) > 2 AND length(w) < 20), lambda w: lower(w)))"
_BASE = f"""d AS (SELECT doc_id, lang AS category, {_W} AS f FROM documents), x AS (SELECT doc_id, category, unnest(f) AS feature FROM d),
cc AS (SELECT category, count(*) AS n FROM d WHERE doc_id % 5 <> 0 GROUP BY 1), fc AS (SELECT feature, category, count(*) AS n FROM x WHERE doc_id % 5 <> 0 GROUP BY 1, 2),
t AS (SELECT feature, sum(n)::BIGINT AS total FROM fc GROUP BY 1),
p AS (SELECT t.feature, cc.category, total, coalesce(fc.n, 0)::DOUBLE / cc.n AS prob FROM t CROSS JOIN cc LEFT JOIN fc ON fc.feature = t.feature AND fc.category = cc.category)"""
_LOGS = """, w AS (SELECT feature, category, (0.5 + total * {prob}) / (1.0 + total) AS weighted FROM {src}),
l AS (SELECT d.doc_id, cc.category, len(d.f) AS m, coalesce(k.s, 0.0) + (len(d.f) - coalesce(k.k, 0)) * ln(0.5) AS logs FROM d CROSS JOIN cc
  LEFT JOIN (SELECT doc_id, w.category, sum(ln(weighted)) AS s, count(*) AS k FROM x JOIN w ON w.feature = x.feature WHERE doc_id % 5 = 0 GROUP BY 1, 2) k ON k.doc_id = d.doc_id AND k.category = cc.category WHERE d.doc_id % 5 = 0)"""
_BAYES = _BASE + _LOGS.format(prob="prob", src="p")
_FISHER = _BASE + ", q AS (SELECT feature, category, total, CASE WHEN sum(prob) OVER (PARTITION BY feature) > 0 THEN prob / sum(prob) OVER (PARTITION BY feature) ELSE 0 END AS prob FROM p)" + _LOGS.format(prob="prob", src="q")
_SCORE = """, lf AS (SELECT i, coalesce(sum(ln(i)) OVER (ORDER BY i), 0) AS lf FROM generate_series(1, 20000) t(i)),
terms AS (SELECT doc_id, category, -(-logs) AS t FROM l WHERE m > 0 UNION ALL SELECT doc_id, category, logs + i * ln(-logs) - lf AS t FROM l JOIN lf ON i < m),
mx AS (SELECT doc_id, category, max(t) AS mt FROM terms GROUP BY 1, 2),
s AS (SELECT l.doc_id, l.category, CASE WHEN m = 0 THEN 1.0 ELSE least(1.0, exp(any_value(mt)) * sum(exp(t - mt))) END AS score FROM l LEFT JOIN terms USING (doc_id, category) LEFT JOIN mx USING (doc_id, category) GROUP BY l.doc_id, l.category, m)"""

ORACLE_SQL = {
    "a21_class_counts": f"WITH {_BASE} SELECT feature, category, n FROM fc",
    "a22_feature_probs": f"WITH {_BASE} SELECT feature, category, round(prob, 6) AS prob, round((0.5 + total * prob) / (1.0 + total), 6) AS weighted FROM p",
    "j6_doc_features": f"WITH {_BAYES} SELECT doc_id, category, m::BIGINT AS m, round(logs, 4) AS logs FROM l",
    "a23_naive_bayes": f"""WITH {_BAYES}, s AS (SELECT doc_id, category, logs + ln(n / (SELECT sum(n) FROM cc)) AS score FROM l JOIN cc USING (category)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS k, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, category) AS nx FROM s)
SELECT doc_id, CASE WHEN nx IS NOT NULL AND nx + CASE WHEN category = 'fr' THEN ln(3.0) ELSE 0 END > score THEN 'unknown' ELSE category END AS category FROM r WHERE k = 1""",
    "a24_fisher_prob": f"WITH {_FISHER}{_SCORE} SELECT doc_id, category, round(score, 4) AS score FROM s",
    "a25_fisher_classify": f"""WITH {_FISHER}{_SCORE}, o AS (SELECT doc_id, arg_min(category, (-round(score, 6), category)) FILTER (WHERE round(score, 6) > CASE WHEN category = 'en' THEN 0.6 ELSE 0 END) AS category FROM s GROUP BY 1)
SELECT doc_id, coalesce(category, 'unknown') AS category FROM o""",
}

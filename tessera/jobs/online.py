"""Queries that drain streams over the tables; results equal the batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.functions.text import words_len
from tessera.jobs import search
from tessera.shared import shared_folder
from tessera.streaming import online as O


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(spark, d, name):
    # a pattern, so that the table may be a folder or one file
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def t1_stream_train(spark, d):
    docs = _stream(spark, d, "documents").select(F.col("lang").alias("category"), words_len(F.col("text")).alias("features"))
    folder = _scratch(spark)

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    O.stream_counts(docs).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


#: Parts in which documents arrive: all but the first are guessed with what was learned from those before.
BATCHES = 8


def t2_guess_then_train(spark, d):
    """Documents arrive in BATCHES parts, by a hash of doc_id; the stream goes on from its checkpoint with each, one micro-batch."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES))
    folder = _scratch(spark)
    for k in range(BATCHES):
        docs.where(part == k).write.mode("append").parquet(f"{folder}/arrived")
        arrived = spark.readStream.schema(docs.schema).parquet(f"{folder}/arrived")
        O.guess_then_train(arrived.select("doc_id", F.col("lang").alias("category"), words_len(F.col("text")).alias("features")), folder, f"{folder}/log")
    return spark.read.parquet(f"{folder}/guesses").select("doc_id", "guess")


def t3_stream_index(spark, d):
    pages = _stream(spark, d, "pages").select("url", F.col("page_id").alias("place"), F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    folder = _scratch(spark)
    O.stream_index(pages, folder, f"{folder}/log")
    return spark.read.parquet(f"{folder}/postings").groupBy("url").agg(F.count("*").alias("n"))


def t4_stream_clicks(spark, d):
    e = _stream(spark, d, "events")
    words = F.array_distinct(F.array(F.col("user_id") % 13, F.col("user_id") % 7 + 20))
    clicks = e.select(F.col("event_id").alias("query"), words.alias("words"), F.array(*[(F.col("user_id") + k) % 5 + 100 for k in range(3)]).alias("urls"), (F.col("user_id") % 5 + 100).alias("selected"))
    folder = _scratch(spark)
    O.stream_clicks(clicks, folder, f"{folder}/log", 0.001)
    return O.click_net(spark, folder)[1].select("hidden", "url", F.round("w", 6).alias("w"))


def t5_first_titles(spark, d):
    docs = _stream(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("title"))
    folder = _scratch(spark)
    O.first_titles(docs).writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


QUERIES = {f.__name__: f for f in (t1_stream_train, t2_guess_then_train, t3_stream_index, t4_stream_clicks, t5_first_titles)}

_W = r"list_distinct(list_transform(list_filter(regexp_split_to_array(text, '\W+'), lambda w: length(w) > 2 AND length(w) < 20), lambda w: lower(w)))"
ORACLE_SQL = {
    "t1_stream_train": f"SELECT feature, category, count(*) AS n FROM (SELECT lang AS category, unnest({_W}) AS feature FROM documents) GROUP BY 1, 2",
    # the postings of each page, whose html is the same under one url
    "t3_stream_index": r"SELECT url, count(*) AS n FROM (SELECT url, unnest(list_transform(list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\W+'), lambda w: w <> ''), lambda w: lower(w))) AS word FROM (SELECT url, any_value(html) AS html FROM pages GROUP BY 1)) WHERE word NOT IN ('the', 'of', 'to', 'and', 'a', 'in', 'is', 'it') GROUP BY 1",
    # one micro-batch of all clicks trains as the batch form does
    "t4_stream_clicks": search.ORACLE_SQL["m18_click_net_train"],
    "t5_first_titles": "SELECT DISTINCT split_part(text, chr(10), 1) AS title FROM documents",
}

"""Online jobs: counting, guessing before learning, indexing new pages, clicks, first titles.

Streams are drained with an available-now trigger unless another one is given. State grows with the vocabulary or the
number of keys, as the work asks; where a time column exists, first titles can forget by a watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import bayes, clicknet, matrix, search


def stream_counts(docs: DataFrame) -> DataFrame:
    """Running fc(feature, category, n) of a stream docs(category, features); equals the batch counts when drained."""
    return docs.select("category", F.explode(F.array_distinct("features")).alias("feature")).groupBy("feature", "category").agg(F.count("*").alias("n"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Drain a stream into an in-memory table: for tests and small results."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def _once_per_batch(spark: SparkSession, folder: str) -> Callable[[int], bool]:
    """Whether a micro-batch is new: the last one done is kept in the folder, so a repeated one changes nothing."""

    def is_new(batch: int) -> bool:
        try:
            done = spark.read.parquet(f"{folder}/done").agg(F.max("batch")).first()[0]
        except Exception as e:  # nothing was done yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return True
        return done is None or batch > done

    return is_new


def _mark(spark: SparkSession, folder: str, batch: int) -> None:
    spark.range(batch, batch + 1).select(F.col("id").alias("batch")).write.mode("append").parquet(f"{folder}/done")


#: Batches after which the increments of a state are merged into one table.
MERGE_EVERY = 16


def state(spark: SparkSession, folder: str, name: str, keys: list[str], value: str) -> DataFrame | None:
    """(keys, value) of a state kept as increments: the last merged table and the increments since, added up by key. None
    before the first batch."""
    merged = _last_version(spark, f"{folder}/{name}/merged")
    try:
        steps = spark.read.parquet(f"{folder}/{name}/steps")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    if merged is not None:
        base = spark.read.parquet(f"{folder}/{name}/merged/{merged}")
        steps = steps.where(F.col("batch") > merged).select(*keys, value).unionByName(base.select(*keys, value))
    return steps.groupBy(*keys).agg(F.sum(value).alias(value))


def _add(changes: DataFrame, folder: str, name: str, keys: list[str], value: str, batch: int) -> None:
    """Write what a batch adds to a state: as much as the batch has. Now and then increments are merged."""
    spark = changes.sparkSession
    changes.select(*keys, value).write.mode("overwrite").parquet(f"{folder}/{name}/steps/batch={batch}")
    merged = _last_version(spark, f"{folder}/{name}/merged")
    if batch - (-1 if merged is None else merged) >= MERGE_EVERY:
        state(spark, folder, name, keys, value).write.mode("overwrite").parquet(f"{folder}/{name}/merged/{batch}")
        _mark(spark, f"{folder}/{name}/merged", batch)


def guess_then_train(docs: DataFrame, folder: str, checkpoint: str) -> None:
    """For each micro-batch of docs(doc_id, category, features): guess with the counts so far, write the guesses to
    folder/guesses, then add the batch to the counts, which are kept as increments (`state`)."""
    spark = docs.sparkSession
    is_new = _once_per_batch(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        if not is_new(number):
            return
        batch = batch.persist()
        new_fc, new_cc = bayes.class_counts(batch)
        if _last_version(spark, folder) is None:
            guesses = batch.select("doc_id", F.lit("unknown").alias("guess"))
        else:
            old_fc, old_cc = state(spark, folder, "fc", ["feature", "category"], "n"), state(spark, folder, "cc", ["category"], "n")
            guesses = bayes.bayes_classify(bayes.bayes_scores(batch, old_fc, old_cc)).select("doc_id", F.col("category").alias("guess"))
        guesses.write.mode("overwrite").parquet(f"{folder}/guesses/batch={number}")
        _add(new_fc, folder, "fc", ["feature", "category"], "n", number)
        _add(new_cc, folder, "cc", ["category"], "n", number)
        _mark(spark, folder, number)
        batch.unpersist()

    docs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _last_version(spark: SparkSession, folder: str) -> int | None:
    try:
        return spark.read.parquet(f"{folder}/done").agg(F.max("batch")).first()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def stream_index(pages: DataFrame, folder: str, checkpoint: str) -> None:
    """Append postings of pages(url, text) whose url was not indexed before; repeated and late pages are left out. Of
    pages of one url in a batch the first by a column `place` counts that has a text, or any where there is no such column."""
    spark = pages.sparkSession
    is_new = _once_per_batch(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        if not is_new(number):
            return
        fresh = batch.dropDuplicates(["url"])
        if "place" in batch.columns:
            fresh = batch.groupBy("url").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col("place"))).alias("text"))
        if _last_version(spark, folder) is not None:
            fresh = matrix.except_seen(fresh, spark.read.parquet(f"{folder}/urls"), ["url"])
        fresh = fresh.persist()
        search.postings(fresh, "url").write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        fresh.select("url").write.mode("overwrite").parquet(f"{folder}/urls/batch={number}")
        _mark(spark, folder, number)
        fresh.unpersist()

    pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


WORD_EDGE, URL_EDGE = ["word", "hidden"], ["hidden", "url"]


def click_net(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | tuple[None, None]:
    """Edges (word, hidden, w) and (hidden, url, w) of the net that stream_clicks keeps in a folder."""
    return state(spark, folder, "words", WORD_EDGE, "w"), state(spark, folder, "urlw", URL_EDGE, "w")


def stream_clicks(clicks: DataFrame, folder: str, checkpoint: str, rate: float = 0.5) -> None:
    """T4: train the click net with each micro-batch of clicks(query, words, urls, selected); new word sets get nodes.
    Weights are kept as increments, those of a batch being the edges that it makes or changes: `click_net` adds them up."""
    spark = clicks.sparkSession
    is_new = _once_per_batch(spark, folder)

    def step(batch: DataFrame, number: int) -> None:
        if not is_new(number):
            return
        batch = batch.persist()
        words, urls = clicknet.hidden_nodes(batch)
        old_words = old_urls = None
        if _last_version(spark, folder) is not None:
            old_words, old_urls = click_net(spark, folder)
            words = old_words.unionByName(words.join(old_words.select("word", "hidden"), ["word", "hidden"], "left_anti").select("word", "hidden", "w"))
            urls = old_urls.unionByName(urls.join(old_urls.select("hidden", "url"), ["hidden", "url"], "left_anti").select("hidden", "url", "w"))
        words, urls = clicknet.net_train(batch, words, urls, rate)
        for name, new, old, keys in (("words", words, old_words, WORD_EDGE), ("urlw", urls, old_urls, URL_EDGE)):
            if old is not None:
                both = new.join(old.withColumnRenamed("w", "before"), keys, "left")
                new = both.where("before is null or w <> before").select(*keys, (F.col("w") - F.coalesce("before", F.lit(0.0))).alias("w"))
            _add(new, folder, name, keys, "w", number)
        _mark(spark, folder, number)
        batch.unpersist()

    clicks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_titles(articles: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """T5: the first article of each title in a stream; with a time column, titles are forgotten after `delay`."""
    if time is None:
        return articles.dropDuplicates(["title"])
    return articles.withWatermark(time, delay).dropDuplicatesWithinWatermark(["title"])

"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.shared import Scratch

#: Fixed by the contract: what separates words after A-Z are lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before A-Z are lowered.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters that are lowered.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Normalised words of a text: A-Z lowered, digits, letters and everything beyond ASCII kept."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS, -1), "")


def item_windows(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """(item, size, gram, h): every window of n words of an item; a shorter item is one window, one without words none.
    `item` is the id as text; h is the hash that windows are looked up by."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    w = w.select("item", size.alias("size"), "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("i"))
    gram = F.slice("w", F.col("i"), F.col("size"))
    return w.select("item", "size", F.array_join(gram, " ").alias("gram"), F.xxhash64(gram).alias("h")).distinct()


def once(rows: DataFrame, column: Column, name: str) -> DataFrame:
    """Add a column that is computed once a row: the optimizer copies a plain expression into each of its uses."""
    return rows.select("*", F.explode(F.array(column)).alias(name))


def _covered(hits: Column) -> Column:
    """Number of words inside any hit: windows in order of their start, each adding what lies beyond the last."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(acc, h):
        end = h["start"] + h["size"] - 1
        new = F.greatest(end - F.greatest(acc["upto"], h["start"] - 1), F.lit(0))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["upto"], end).alias("upto"))

    return F.aggregate(F.array_sort(hits), start, add)["n"].cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_bytes: int = 64 << 20) -> DataFrame:
    """Add to every document: n_words, n_hit (words inside an occurrence of a benchmark window), n_items,
    items_sha256, contaminated, and `hits`, the windows found: array of (start word from 1, size).

    The set of normalised windows is broadcast as the hash table of a join: each window of a document is looked up by
    its hash and, where that is known, compared word by word. Only hits are grouped, by document. The set is measured
    first; beyond `max_bytes` the same join meets it in a shuffle, and so do the documents and what was found.

    A null text has no words; an item without words has no window. The windows of an item without an id hit like
    others, but no item is counted or named for it; ids may hold any characters. Repeated documents are each
    reported; other columns of `docs` pass through, those that would clash are replaced.
    """
    scratch = Scratch(docs.sparkSession)
    docs = docs.drop("hits", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "_k", "_c", "_items")
    text = F.coalesce("text", F.lit(""))
    # what is found goes back by a hash of id and text, another of the text, and its length
    keyed = docs.withColumn("_k", F.xxhash64("doc_id", text)).withColumn("_c", F.struct(F.crc32(text.cast("binary")).alias("crc"), F.octet_length(text).alias("n")))
    grams = scratch.save("grams", item_windows(benchmark, n))
    size = grams.agg(F.sum(F.octet_length("gram") + F.coalesce(F.octet_length("item"), F.lit(0)) + 64)).first()[0] or 0
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())  # 1 to n at most
    w = once(keyed.select("_k", "_c", "text"), words(F.col("text")), "_w").drop("text")
    w = w.select("*", F.explode(F.array(*map(F.lit, sizes)) if sizes else F.array().cast("array<int>")).alias("_size")).where(F.size("_w") >= F.col("_size"))
    w = w.select("*", F.explode(F.sequence(F.lit(1), F.size("_w") - F.col("_size") + 1)).alias("_start"))
    window = F.slice("_w", F.col("_start"), F.col("_size"))
    same = (F.xxhash64(window) == F.col("h")) & (F.col("_size") == F.col("size")) & (F.array_join(window, " ") == F.col("gram"))
    hit = w.join(F.broadcast(grams) if size <= max_bytes else grams, same)
    found = hit.groupBy("_k", "_c").agg(F.array_sort(F.collect_set(F.struct(F.col("_start").alias("start"), "size"))).alias("hits"), F.array_sort(F.collect_set("item")).alias("_items"))
    found = scratch.save("found", found)
    back = found.agg(F.sum(F.size("hits") * 16 + F.octet_length(F.array_join("_items", ",")) + 64)).first()[0] or 0
    rows = keyed.join(F.broadcast(found) if back <= max_bytes else found, ["_k", "_c"], "left")
    hits = F.coalesce("hits", F.array().cast("array<struct<start:int,size:int>>"))
    items = F.coalesce("_items", F.array().cast("array<string>"))
    return rows.select(
        *docs.columns,
        F.size(F.array_remove(F.split(text, RAW_SEPARATORS, -1), "")).cast("long").alias("n_words"),
        _covered(hits).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hits").isNotNull().alias("contaminated"),
        hits.alias("hits"),
    )


#: Where a word begins after what separates words, in a text as it is (A-Z are letters of words).
WORD_START = r"(?<=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"


def remove_hits(rows: DataFrame) -> DataFrame:
    """Documents with the words of every hit cut out of the text, each with what separates it from the next.

    Expects the columns of find_contamination. A document left without words keeps what stood before its
    first word; clean documents, and null texts, pass unchanged."""
    parts = F.split("text", WORD_START, -1)  # a word and what follows it; what precedes the first stands alone
    lead = F.when(F.col("text").rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(0)).otherwise(F.lit(1))
    gone = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    dirty = once(once(rows.where("contaminated"), gone, "_gone"), lead, "_lead")
    cut = F.array_join(F.filter(parts, lambda part, i: ~F.array_contains("_gone", i + F.col("_lead"))), "")
    clean = rows.where("not contaminated")
    return dirty.withColumn("text", cut).select(*rows.columns).unionByName(clean)

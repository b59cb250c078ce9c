"""A net that classifies documents: words, a hidden node for each set of words met in training, and categories.

Every document meets every hidden node, as all nodes are linked to all categories; so activations are a product of two
tables. It is taken in blocks: documents and nodes are dealt into blocks of bounded size, each pair of blocks meets in a
task, and only sums over the nodes of a block (or over its documents) leave it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.shared import save

ABSENT = -0.2  # weight of a word without an edge to a node


def doc_nodes(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (word, hidden, w) and (hidden, category, w) of entries(id, words, category): a node for each set of
    words, 1 by their number from each word and 0.1 to each category. Null words and empty sets make no node."""
    words = F.array_sort(F.array_distinct(F.array_compact("words")))
    sets = entries.select(words.alias("words")).where(F.size("words") > 0).distinct()
    named = sets.select("words", F.array_join("words", "_").alias("hidden"))
    named = named.groupBy("hidden").agg(F.min("words").alias("words"))  # sets that are written alike are one node
    inputs = named.select(F.explode("words").alias("word"), "hidden", (1.0 / F.size("words")).alias("w"))
    kinds = entries.where("category is not null").select("category").distinct()
    return inputs, named.select("hidden").crossJoin(kinds).select("hidden", "category", F.lit(0.1).alias("w"))  # nodes times categories are the edges


def _pairs(queries: DataFrame, inputs: DataFrame, outputs: DataFrame, block: int):
    """Documents (query, words, more columns) and nodes (hidden, words, ws, categories, us), dealt so that each block of
    the one meets each of the other, grouped by both."""
    weights = inputs.groupBy("hidden").agg(F.collect_list(F.struct("word", "w")).alias("edges"))
    outs = outputs.groupBy("hidden").agg(F.collect_list(F.struct("category", "w")).alias("outs"))
    nodes = outs.join(weights, "hidden", "full").select("hidden", F.col("edges.word").alias("words"), F.col("edges.w").alias("ws"), F.col("outs.category").alias("categories"), F.col("outs.w").alias("us"))
    nodes = save(nodes)
    n_q, n_h = max(1, -(-queries.count() // block)), max(1, -(-nodes.count() // block))
    left = queries.withColumn("q", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(n_h - 1))))
    right = nodes.withColumn("h", F.pmod(F.xxhash64("hidden"), F.lit(n_h)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    return left.groupBy("q", "h").cogroup(right.groupBy("q", "h"))


def _activations(docs: pa.Table, nodes: pa.Table) -> tuple[np.ndarray, dict]:
    """tanh of the sums of weights (documents by nodes), and the documents of each word."""
    of_word: dict = {}
    sums = np.zeros((docs.num_rows, nodes.num_rows))
    for i, words in enumerate(docs["words"].to_pylist()):
        own = {w for w in words or () if w is not None}
        sums[i] = ABSENT * len(own)
        for w in own:
            of_word.setdefault(w, []).append(i)
    edges: dict = {}
    for j, (words, ws) in enumerate(zip(nodes["words"].to_pylist(), nodes["ws"].to_pylist())):
        for w, x in zip(words or (), ws or ()):
            if w in of_word:
                at = edges.setdefault(w, ([], []))
                at[0].append(j)
                at[1].append(x - ABSENT)
    for w, (js, xs) in edges.items():
        sums[np.ix_(of_word[w], js)] += np.array(xs)
    return np.tanh(sums), of_word


def _out_weights(nodes: pa.Table, kinds: list) -> np.ndarray:
    place = {c: k for k, c in enumerate(kinds)}
    out = np.zeros((nodes.num_rows, len(kinds)))
    for j, (categories, us) in enumerate(zip(nodes["categories"].to_pylist(), nodes["us"].to_pylist())):
        for c, u in zip(categories or (), us or ()):
            out[j, place[c]] = u
    return out


def doc_scores(queries: DataFrame, inputs: DataFrame, outputs: DataFrame, block: int = 1_000) -> DataFrame:
    """(query, category, score) of queries(query, words) by the net's edges. Words of a document count once; without
    words all scores are 0."""

    def f(docs: pa.Table, nodes: pa.Table) -> pa.Table:
        names: list = []
        kinds: list = []
        sums = np.zeros(0)
        if docs.num_rows and nodes.num_rows:
            kinds = sorted({c for cs in nodes["categories"].to_pylist() for c in cs or ()})
            sums = _activations(docs, nodes)[0] @ _out_weights(nodes, kinds)
            names, sums, kinds = np.repeat(docs["query"].to_numpy(), len(kinds)), sums.reshape(-1), kinds * docs.num_rows
        return pa.table({"query": pa.array(names, pa.int64()), "category": pa.array(kinds, pa.string()), "s": pa.array(sums, pa.float64())})

    asked = queries.select(F.col("query").cast("long").alias("query"), "words")
    parts = _pairs(asked, inputs, outputs, block).applyInArrow(f, "query long, category string, s double")
    return parts.groupBy("query", "category").agg(F.tanh(F.sum("s")).alias("score"))


def doc_guess(scores: DataFrame) -> DataFrame:
    """(query, guess): the category with the highest score; ties to the first."""
    return scores.groupBy("query").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "category"))["category"].alias("guess"))


def doc_train(entries: DataFrame, inputs: DataFrame, outputs: DataFrame, rate: float = 0.5, block: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """The edges after a batch of entries(id, words, category): the target is 1 for an entry's category and 0 for the
    rest, and changes of all entries are added. Each word of the batch has an edge to each node after it."""
    known = entries.where("category is not null").select(F.col("id").cast("long").alias("query"), "words", "category")
    known = save(known)
    scores = doc_scores(known, inputs, outputs, block)
    error = scores.join(known.select("query", F.col("category").alias("true")), "query")
    target = F.when(F.col("category") == F.col("true"), 1.0).otherwise(0.0)
    deltas = error.groupBy("query").agg(F.collect_list(F.struct("category", ((target - F.col("score")) * (1 - F.col("score") * F.col("score"))).alias("d"))).alias("deltas"))
    batch = known.join(deltas, "query").select("query", "words", F.col("deltas.category").alias("kinds"), F.col("deltas.d").alias("ds"))

    def f(docs: pa.Table, nodes: pa.Table) -> pa.Table:
        words, hidden, categories, change = [], [], [], []
        if docs.num_rows and nodes.num_rows:
            names = nodes["hidden"].to_pylist()
            kinds = sorted({c for cs in docs["kinds"].to_pylist() for c in cs} | {c for cs in nodes["categories"].to_pylist() for c in cs or ()})
            place = {c: k for k, c in enumerate(kinds)}
            out = np.zeros((docs.num_rows, len(kinds)))
            for i, (cs, ds) in enumerate(zip(docs["kinds"].to_pylist(), docs["ds"].to_pylist())):
                for c, d in zip(cs, ds):
                    out[i, place[c]] = d
            ah, of_word = _activations(docs, nodes)
            back = (1 - ah * ah) * (out @ _out_weights(nodes, kinds).T)
            up = rate * (ah.T @ out)
            for k, c in enumerate(kinds):
                words += [None] * len(names)
                hidden += names
                categories += [c] * len(names)
                change.append(up[:, k])
            for w, rows in of_word.items():
                words += [w] * len(names)
                hidden += names
                categories += [None] * len(names)
                change.append(rate * back[rows].sum(axis=0))
        return pa.table({"word": pa.array(words, pa.string()), "hidden": pa.array(hidden, pa.string()), "category": pa.array(categories, pa.string()), "d": np.concatenate(change) if change else np.zeros(0)})

    changes = _pairs(batch, inputs, outputs, block).applyInArrow(f, "word string, hidden string, category string, d double")
    changes = save(changes.groupBy("word", "hidden", "category").agg(F.sum("d").alias("d")))
    ups = changes.where("word is null").select("hidden", "category", "d").join(outputs, ["hidden", "category"], "full")
    ins = changes.where("word is not null").select("word", "hidden", "d").join(inputs, ["word", "hidden"], "full")
    return ins.select("word", "hidden", (F.coalesce("w", F.lit(ABSENT)) + F.coalesce("d", F.lit(0.0))).alias("w")), ups.select("hidden", "category", (F.coalesce("w", F.lit(0.0)) + F.coalesce("d", F.lit(0.0))).alias("w"))

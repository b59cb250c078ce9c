"""From raw documents to packed sequences: the stages of a training-data pipeline on Spark.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Between stages the table is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, neardup, packing, suffix, toxicity
from tessera.llm.common import read
from tessera.llm.queries import tokenizer_file
from tessera.shared import save, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator, trained on all labels, does not reject."""
    model = toxicity.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs.select(COLUMNS), model).where("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates, and all without a doc_id."""
    kept = neardup.link_near_duplicates(docs.select("doc_id", "text")).where("kept and doc_id is not null").select("doc_id")
    docs = docs.select(COLUMNS)
    return docs.join(kept.distinct(), "doc_id", "left_semi").select(COLUMNS).union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has too."""
    out = suffix.remove_repeats(docs.select(COLUMNS), keep_text=True)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items."""
    found = decontam.find_contamination(docs.select(COLUMNS), read(spark, sf_dir, "benchmark", "item_id", "text"))
    out = decontam.remove_hits(found)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens."""
    pieces = packing.cut_pieces(docs.select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return packing.pack_pieces(save(pieces))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", cut_benchmarks),
    ("packing", pack),
]

#: SQL expresses neither the learned stage nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each reading what the one before wrote to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Token counts by a two-tier lookup on the map side, without any shuffle of pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text is cut after a line break and before a run of spaces: no piece of the model holds a space
#: after another character, and a line break only occurs in byte pieces (checked by `cuts_are_safe`).
UNIT = re.compile("[ ▁]*[^ ▁\n]+|\n|[ ▁]+")


def cuts_are_safe(model) -> bool:
    """Whether no piece of a sentencepiece model spans one of our cuts and texts are taken as they are."""
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "\n" in piece or re.search("[^▁]▁", piece):
            return False
    # identity normaliser that puts one space first and keeps white space; no pieces that users defined
    return model.encode("a  b", out_type=str)[0].startswith("▁") and "".join(model.encode(" x  y ", out_type=str)) == "▁▁x▁▁y▁"


def _load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _lengths(model, units: list[str], lead: int) -> list[int]:
    """Tokens of each unit inside a text. The model puts a space before whatever it encodes, so a unit
    that begins with a space loses one first, and others (only spaces, a line break, or after one) are
    measured behind a line break of known length."""
    plain = [len(u) > 1 and u[0] in " ▁" and u[-1] not in " ▁" for u in units]
    ids = model.encode([u[1:] if p else "\n" + u for u, p in zip(units, plain)], num_threads=1)
    return [len(x) - (0 if p else lead) for x, p in zip(ids, plain)]


def frequent_units(docs: DataFrame, text: str, size: int, sample_rows: int) -> list[str]:
    """The most frequent pre-tokens of a bounded sample of texts. It only warms the lookup: results don't depend on it."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c = Counter()
            for t in b["t"]:
                c.update(UNIT.findall(t))
            top = c.most_common(size)
            yield pd.DataFrame({"u": pd.Series([u for u, _ in top], dtype=object), "n": pd.Series([n for _, n in top], dtype="int64")})

    sample = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull() & (F.length("t") < 20_000)).limit(sample_rows)
    counts = sample.mapInPandas(count, "u string, n long").groupBy("u").agg(F.sum("n").alias("n"))
    return [r["u"] for r in counts.orderBy(F.desc("n"), "u").limit(size).collect()]


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens", frequent: int = 20_000, sample_rows: int = 2_000, cache: int = 400_000) -> DataFrame:
    """Add the number of tokens of each whole text under a sentencepiece model.

    Texts are cut into pre-tokens that no piece spans. Lengths of the `frequent` commonest ones are
    broadcast (a bounded table); the rest is encoded once per worker and kept in a cache of at most
    `cache` entries, which is emptied when full. Nothing is shuffled, whatever is frequent.
    Null counts as the empty text, which has 0 tokens; other columns pass through.
    """
    spark = docs.sparkSession
    model = _load(model_path)
    if not cuts_are_safe(model):
        raise ValueError("the model has pieces across white space, or changes texts; count whole texts instead")
    lead = len(model.encode("\n"))
    first = frequent_units(docs, text, frequent, sample_rows)
    warm = spark.sparkContext.broadcast(dict(zip(first, _lengths(model, first, lead))) if first else {})
    state: dict = {}

    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sp = state.get("sp") or state.setdefault("sp", _load(model_path))
        hot = warm.value
        seen = state.setdefault("seen", dict(hot))
        for texts in batches:
            out = []
            for t in texts:
                if not t:
                    out.append(0)
                    continue
                units = UNIT.findall(" " + t)  # the model's own first space
                got = list(map(seen.get, units))
                if None in got:
                    miss = list({u for u, n in zip(units, got) if n is None})
                    if len(seen) + len(miss) > cache + len(hot):
                        seen.clear()
                        seen.update(hot)
                        miss = [u for u in set(units) if u not in seen]
                    seen.update(zip(miss, _lengths(sp, miss, lead)))
                    got = list(map(seen.__getitem__, units))
                out.append(sum(got))
            yield pd.Series(out, dtype="int64")

    return docs.withColumn(out, F.pandas_udf(lengths, "long")(F.coalesce(F.col(text), F.lit(""))))

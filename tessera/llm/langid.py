"""Language identification with string kernels.

A text is the set of character n-grams (1 to 4, hashed) that occur in its letters. The blended-spectrum
presence kernel of two texts is the share of n-grams they have in common, normalised by both sets. Landmark
texts give a Nystroem map of that kernel, and one ridge regression per language is fitted on the map. Long texts would
hold every n-gram, so a text is read in windows of bounded length, and the mean over all its windows counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Settings:
    bits: int = 13  # the n-gram sets have 2 ** bits places
    orders: tuple = (1, 2, 3, 4)
    landmarks: int = 96
    train_rows: int = 2_400  # bound of the training sample, over all languages; one row of each at least
    window: int = 4_096  # letters and the spaces between them that one set of n-grams is taken from
    ridge: float = 1e-3


@dataclass
class Model:
    languages: list
    landmarks: np.ndarray  # places x landmarks, each column of unit length
    weights: np.ndarray  # landmarks + 1 x languages
    settings: Settings


_LETTER: list[np.ndarray] = []  # whether a code point is a letter, built once a process


def letters_of(text: str) -> np.ndarray:
    """Code points of the letters, lowered, with one space for whatever lies between; empty without a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[0][x]
    if not letter.any():
        return np.zeros(0, np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of other characters stays, as a space
    x = np.where(letter, x, np.uint32(32))[keep]
    return np.concatenate(([32], x, [32])).astype(np.uint32)


def presence(text: str | None, s: Settings) -> list[np.ndarray]:
    """For each window of a text, bytes, one a place: whether an n-gram that hashes there occurs. Windows are of even
    length, and none longer than the setting. No window for a text without letters."""
    if not text:
        return []
    x = letters_of(text).astype(np.uint64)
    return [_places(part, s) for part in np.array_split(x, -(-len(x) // s.window))] if len(x) else []


def _places(x: np.ndarray, s: Settings) -> np.ndarray:
    out = np.zeros(1 << s.bits, np.uint8)
    shift = np.uint64(64 - s.bits)
    gram = np.zeros(len(x), np.uint64)
    for n in range(1, max(s.orders) + 1):
        if len(x) < n:
            break
        gram = gram[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :]
        if n in s.orders:
            out[((gram + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> shift] = 1
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of unit length under the presence kernel."""
    x = rows.astype(np.float32)
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(docs: DataFrame, settings: Settings | None = None) -> Model | None:
    """Fit on (doc_id, text, lang) rows. Null languages and texts without letters teach nothing.

    The sample is bounded: about `train_rows` rows, as many of each language as it has up to an equal
    share, chosen by a hash of doc_id and text, repeated rows once; of each the n-gram set (1 KB) of one window, chosen
    by a hash, reaches the driver. Rows without a doc_id are taken like others. None if nothing can be learned.
    """
    s = settings or Settings()
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    share = max(1, s.train_rows // len(counts))
    limit = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(-int(-min(1.0, 1.2 * share / n) * 1_000_000 // 1)))])
    chosen = labelled.withColumn("h", F.xxhash64("doc_id", "text")).where(F.pmod("h", F.lit(1_000_000)) < limit[F.col("lang")]).select("h", "lang", "text").distinct()

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [g[h % len(g)] if (g := presence(t, s)) else None for t, h in zip(b["text"], b["h"])]
            keep = [g is not None for g in got]
            yield pd.DataFrame({"h": b["h"][keep].to_numpy(np.int64), "lang": pd.Series(b["lang"][keep].to_list(), dtype=object), "grams": pd.Series([np.packbits(g).tobytes() for g in got if g is not None], dtype=object)})

    rows = chosen.mapInPandas(sets, "h long, lang string, grams binary").toPandas()
    if not len(rows):
        return None
    rows = rows.assign(h=pd.util.hash_array(rows["h"].to_numpy(np.int64))).sort_values(["h", "lang", "grams"])
    rows = rows.groupby("lang", sort=True).head(share).reset_index(drop=True)
    x = _unit(np.unpackbits(np.stack([np.frombuffer(g, np.uint8) for g in rows["grams"]]), axis=1))
    languages = sorted(rows["lang"].unique())
    each = max(1, s.landmarks // len(languages))
    at = rows.groupby("lang", sort=True).head(each).index.to_numpy()
    marks = x[at]
    kernel = (marks @ marks.T).astype(np.float64)
    value, vector = np.linalg.eigh(kernel)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = (x @ marks.T).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    target = np.where(rows["lang"].to_numpy()[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    weight = 1.0 / np.maximum((target > 0).sum(axis=0), 1)
    w = (target > 0) @ weight  # languages weigh the same
    gram = (features * w[:, None]).T @ features
    beta = np.linalg.solve(gram + s.ridge * np.eye(len(gram)), (features * w[:, None]).T @ target)
    return Model(languages, np.ascontiguousarray(marks.T), np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32), s)


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1) from the whole text alone.

    A null text, or one without a letter, is `und` with score 0, and so is everything if the model is None.
    Other columns pass through; columns of the two names are replaced.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    block = 128

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            best, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            if m is None:
                yield pd.DataFrame({"lang_pred": best, "score": score})
                continue
            total, seen = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts))
            rows, at = [], []

            def flush():
                x = np.stack(rows).astype(np.float32)
                x /= np.sqrt(x.sum(axis=1, keepdims=True))
                np.add.at(total, at, (x @ m.landmarks) @ m.weights[:-1] + m.weights[-1])
                np.add.at(seen, at, 1)
                rows.clear()
                at.clear()

            for i, t in enumerate(texts):
                for g in presence(t, m.settings):
                    rows.append(g)
                    at.append(i)
                    if len(rows) == block:
                        flush()
            if rows:
                flush()
            told = np.flatnonzero(seen)
            if len(told):
                y = total[told] / seen[told, None]
                e = np.exp(4 * (y - y.max(axis=1, keepdims=True)))
                k = y.argmax(axis=1)
                best[told] = np.array(m.languages, object)[k]
                score[told] = (e / e.sum(axis=1, keepdims=True))[np.arange(len(k)), k]
            yield pd.DataFrame({"lang_pred": best, "score": score})

    out = F.pandas_udf(predict, "lang_pred string, score double")(F.coalesce(F.col(text), F.lit("")))
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*rest, out.alias("_p")).select(*rest, "_p.lang_pred", "_p.score")

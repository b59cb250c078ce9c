"""Toxicity by a learned lexicon, misspellings by Levenshtein automata, and the context of each hit.

The lexicon (whole words and word beginnings) is learned from labelled documents and kept as a trie. The
automaton of "at most k edits" is run over the trie and a word at once: a state is the set of (trie node,
edits so far) pairs, built the first time a letter leads to it. Words that training saw carry what training
says of them; unseen misspellings inherit the weight of their term.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_](?:\w*[^\W_])?")
QUOTES = "\"“”„«»‹›`"
#: Words and marks before a hit that tell a quotation or a mention from abuse, before training has a say.
MENTION = re.compile(r"[\"“„«‹`]|\b(?:said|says|called|wrote|quote|quoted|word|term|dit|mot|dijo|palabra|sagte|wort)\b")


@dataclass
class Settings:
    rows_per_class: int = 10_000  # bound of the training sample, for each of the two labels
    least_docs: int = 4  # toxic documents that must hold a term
    least_odds: float = 3.0  # natural logarithm of the odds ratio that makes a term
    stem: tuple = (4, 5, 6, 7, 8)  # lengths of the word beginnings that may enter the lexicon
    window: int = 40  # characters of context before and after a hit
    mention: float = -2.0  # context score of a hit in quotation marks after a word that tells of speech


@dataclass
class Model:
    terms: list  # whole words
    stems: list  # word beginnings
    clean: frozenset  # words near the lexicon that training met in clean documents
    weights: np.ndarray
    settings: Settings
    context: dict = field(default_factory=dict)  # what stands around hits -> how much likelier around abuse (logarithm)
    automaton: object = field(default=None, repr=False, compare=False)


def edits(term: str) -> int:
    """Edits that a term forgives, by its length."""
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """Levenshtein automata of all terms, intersected with their trie and made deterministic on demand."""

    def __init__(self, terms: list[str], limit: int = 200_000):
        self.next: list[dict] = [{}]
        self.ends: list[str | None] = [None]
        self.most: list[int] = [0]  # edits that some term below a node forgives
        for t in terms:
            node, k = 0, edits(t)
            self.most[0] = max(self.most[0], k)
            for c in t:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.next[node][c]
                self.most[node] = max(self.most[node], k)
            self.ends[node] = t
        self.limit = limit
        self.reset()

    def reset(self) -> None:
        self.start = self._state({0: 0})
        self.seen = {self.start: (self.start, {})}

    def _state(self, at: dict[int, int]) -> frozenset:
        """Close a set of nodes and edits under letters that the word left out."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if at.get(node, 99) < e:
                continue
            for child in self.next[node].values():
                if e + 1 <= self.most[child] and at.get(child, 99) > e + 1:
                    at[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(at.items())

    def step(self, state: frozenset, c: str) -> frozenset:
        moves = self.seen[state][1]
        got = moves.get(c)
        if got is None:
            at: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= self.most[node] and at.get(node, 99) > e:
                    at[node] = e

            for node, e in state:
                put(node, e + 1)  # the word has one letter too many
                for letter, child in self.next[node].items():
                    put(child, e + (letter != c))
            got = self._state(at)
            if got not in self.seen:
                self.seen[got] = (got, {})
            got = self.seen[got][0]
            moves[c] = got
        return got

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term within its edits, and the edits; ties go to the smaller term."""
        if len(self.seen) > self.limit:
            self.reset()
        state = self.start
        for c in word:
            state = self.step(state, c)
            if not state:
                return None
        found = [(e, self.ends[n]) for n, e in state if self.ends[n] is not None and e <= edits(self.ends[n])]
        if not found:
            return None
        e, term = min(found)
        return term, e


def _stems(word: str, s: Settings) -> list[str]:
    return [word[:n] for n in s.stem if len(word) > n]


#: Features of a document, in order: hits by kind (exact, stem, misspelt) outside and inside quotations.
KINDS = ("exact", "stem", "misspelt", "exact_quoted", "stem_quoted", "misspelt_quoted")


def features(text: str | None, m: Model, cache: dict) -> list[int]:
    """Counts of hits by kind and context: a hit whose context score is below -1 counts as quoted."""
    out = [0] * len(KINDS)
    low = (text or "").lower()
    for start, end, k in hits_of(low, m, cache):
        out[k + (3 if context_score(low, start, end, m) < -1 else 0)] += 1
    return out


def hits_of(low: str, m: Model, kinds: dict) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the hits of a lowered text; `kinds` remembers words."""
    hits = []
    for at in WORD.finditer(low):
        w = at.group()
        k = kinds.get(w)
        if k is None:
            k = kind_of(w, m)
            if len(kinds) > 500_000:
                kinds.clear()
            kinds[w] = k
        if k >= 0:
            hits.append((at.start(), at.end(), k))
    return hits


def kind_of(word: str, m: Model) -> int:
    """0 a term, 1 a word beginning of the lexicon, 2 a misspelt term, -1 neither."""
    found = m.automaton.match(word)
    if found and found[1] == 0:
        return 0
    if any(p in m.stem_set for p in _stems(word, m.settings)):
        return 1
    return 2 if found and word not in m.clean else -1


def context(low: str, start: int, end: int, window: int) -> tuple[set[str], bool]:
    """Words and quotation marks around a hit, on its line, told apart by side; and whether it stands in a quotation: a
    mark opens before it after a word of speech, or as one, and one closes after it. A word that the window cuts is none."""
    first, last = max(0, start - window), min(len(low), end + window)
    while first < start and first and low[first - 1].isalnum() and low[first].isalnum():
        first += 1
    while last > end and last < len(low) and low[last].isalnum() and low[last - 1].isalnum():
        last -= 1
    left = low[first:start].rpartition("\n")[2]
    right = low[end:last].partition("\n")[0]
    around = {f"<{w}" for w in WORD.findall(left)} | {f">{w}" for w in WORD.findall(right)}
    around |= {f"<{q}" for q in QUOTES if q in left} | {f">{q}" for q in QUOTES if q in right}
    return around, any(q in left for q in QUOTES) and any(q in right for q in QUOTES) and MENTION.search(left) is not None


def context_score(low: str, start: int, end: int, m: Model) -> float:
    """How much likelier the surroundings of a hit are around abuse, as a logarithm: what training learned of each word
    and mark in the window, and the fixed part of a quotation."""
    around, told = context(low, start, end, m.settings.window)
    return sum(m.context.get(c, 0.0) for c in sorted(around & m.context.keys())) + (m.settings.mention if told else 0.0)


def _ready(m: Model) -> Model:
    """The parts of a model that workers build for themselves."""
    if m.automaton is None:
        m.automaton = Automaton(m.terms)
        m.stem_set = frozenset(m.stems)
    return m


def _sample(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Labelled texts, at most about rows_per_class of each label, by a hash of doc_id. The chosen ids are
    bounded, so they are broadcast and no text is shuffled. A doc_id with two labels counts as toxic."""
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect() if r["toxic"] in (0, 1)}
    if len(n) < 2:
        return None
    share = {k: min(1.0, s.rows_per_class / v) for k, v in n.items()}
    limit = F.when(F.col("toxic") == 1, F.lit(int(share[1] * 1_000_000))).otherwise(F.lit(int(share[0] * 1_000_000)))
    chosen = one.where(F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < limit))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model | None:
    """Learn from `labels` (doc_id, toxic) and the texts of those documents. None without both labels.

    A term needs `least_docs` different toxic texts (a word beginning four times as many), the odds ratio, and evidence
    that chance would give to about one of the words tried; no share of the toxic rows, which a term of a small
    language or source could not reach. Copies of a text count once, as the words of one are not chance in another,
    and near copies hardly more: toxic texts count no more than the different neighbours that the word has in them.

    Word counts are combined per batch before they are shuffled; what reaches the driver is bounded by the sample and
    nothing else: the lexicon, the clean words near it, and a table of feature counts.
    """
    s = settings or Settings()
    sample = _sample(docs, labels, s)
    if sample is None:
        return None

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            count: tuple[Counter, Counter] = (Counter(), Counter())
            docs_of = [0, 0]
            for text, toxic in zip(b["text"], b["toxic"]):
                docs_of[toxic] += 1
                count[toxic].update(set(WORD.findall((text or "").lower())))
            both = list(count[0].keys() | count[1].keys())
            yield pd.DataFrame({"w": pd.Series([*both, ""], dtype=object), "clean": [*(count[0][w] for w in both), docs_of[0]], "toxic": [*(count[1][w] for w in both), docs_of[1]]})

    vocabulary = sample.select("text", "toxic").distinct().mapInPandas(words, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    total = vocabulary.where("w = ''").first()
    if total is None or not total["clean"] or not total["toxic"]:
        vocabulary.unpersist()
        return None
    odds = F.log((F.col("toxic") + 0.5) / F.lit(total["toxic"] + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(total["clean"] + 1.0))

    share = (F.col("toxic") + F.col("clean")) / F.lit(float(total["toxic"] + total["clean"]))

    def evidence(label: str) -> Column:  # logarithm of the likelihood ratio, the part of one label
        return F.when(F.col(label) > 0, F.col(label) * F.log(F.col(label) / (share * F.lit(float(total[label]))))).otherwise(0.0)

    def strong(table: DataFrame, least: int) -> tuple[list, float]:
        tried = table.where((F.col("w") != "") & (F.col("toxic") >= least))
        chance = float(np.log(max(tried.count(), 1)))
        return tried.where((odds >= s.least_odds) & (evidence("toxic") + evidence("clean") >= chance)).select("w", "toxic", "clean").collect(), chance

    words_ = strong(vocabulary.where(F.length("w") >= 3), s.least_docs)
    beginnings = vocabulary.select(F.explode(F.array(*[F.when(F.length("w") > n, F.substring("w", 1, n)) for n in s.stem])).alias("w"), "clean", "toxic")
    beginnings = beginnings.where("w is not null").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("*").alias("forms"))
    heads = strong(beginnings.where("forms >= 5"), 4 * s.least_docs)
    settings_of = _contexts_of(sample, frozenset(r["w"] for r in words_[0]), frozenset(r["w"] for r in heads[0]), s)

    def kept(found: tuple[list, float], least: int, head: bool) -> list[str]:
        """Those that still pass if their toxic texts count no more than the surroundings that they were met in."""
        out = []
        for r in found[0]:
            t, c = min(r["toxic"], settings_of.get((r["w"], head), 0)), r["clean"]
            both = (t + c) / (total["toxic"] + total["clean"])
            weight = sum(n * np.log(n / (both * total[k])) for n, k in ((t, "toxic"), (c, "clean")) if n)
            if t >= least and weight >= found[1] and np.log((t + 0.5) / (total["toxic"] + 1)) - np.log((c + 0.5) / (total["clean"] + 1)) >= s.least_odds:
                out.append(r["w"])
        return sorted(out)

    terms, stems = kept(words_, s.least_docs, False), kept(heads, 4 * s.least_docs, True)
    whole = set(terms)
    stems = [p for p in stems if not any(p[:n] in whole for n in range(3, len(p) + 1))]
    # a word that only begins like a stem needs no entry of its own
    short = tuple(set(stems))
    terms = [t for t in terms if not t.startswith(short)] if short else terms
    model = Model(terms, stems, frozenset(), np.zeros(len(KINDS) + 1), s)

    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = Automaton(terms)
        for words_ in batches:
            yield pd.Series([(f is not None and f[1] > 0) for f in map(a.match, words_)], dtype=bool)

    close = vocabulary.where((F.col("w") != "") & (F.col("clean") > 0) & (odds < s.least_odds))
    model.clean = frozenset(r["w"] for r in close.where(F.pandas_udf(near, "boolean")("w")).collect())
    vocabulary.unpersist()

    model.context = _learn_context(sample, model)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = _ready(model), {}
        for b in batches:
            c = Counter((toxic, *features(text, m, cache)) for text, toxic in zip(b["text"], b["toxic"]))
            yield pd.DataFrame({"toxic": [k[0] for k in c], "f": pd.Series([list(k[1:]) for k in c], dtype=object), "n": list(c.values())})

    table = sample.mapInPandas(count, "toxic int, f array<int>, n long").groupBy("toxic", "f").agg(F.sum("n").alias("n")).toPandas()
    model.weights = _logistic(np.array(table["f"].tolist(), float), table["toxic"].to_numpy(float), table["n"].to_numpy(float))
    model.automaton = None
    return model


def _contexts_of(sample: DataFrame, terms: frozenset, stems: frozenset, s: Settings) -> dict:
    """(word, whether it is a beginning) -> number of different surroundings in toxic texts: the words before and after,
    and for a beginning the word itself."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            met = set()
            for text in b["text"]:
                all_ = ["", *WORD.findall((text or "").lower()), ""]
                for before, w, after in zip(all_, all_[1:], all_[2:]):
                    if w in terms:
                        met.add((w, False, zlib.crc32(f"{before} {after}".encode("utf-8", "replace"))))
                    for p in _stems(w, s):
                        if p in stems:
                            met.add((p, True, zlib.crc32(f"{before} {w} {after}".encode("utf-8", "replace"))))
            rows = list(met)
            yield pd.DataFrame({"w": pd.Series([m[0] for m in rows], dtype=object), "head": pd.Series([m[1] for m in rows], dtype=bool), "c": pd.Series([m[2] for m in rows], dtype="int64")})

    found = sample.where("toxic = 1").select("text").distinct().mapInPandas(tell, "w string, head boolean, c long").distinct()
    return {(r["w"], r["head"]): r["count"] for r in found.groupBy("w", "head").count().collect()}


def _learn_context(sample: DataFrame, model: Model) -> dict:
    """Words and marks around hits -> logarithm of how much likelier they are around hits of toxic texts, smoothed, where
    the evidence is beyond chance. Texts count once; what is collected is bounded by the sample."""
    least = model.settings.least_docs

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, cache = _ready(model), {}
        for b in batches:
            c: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b["text"], b["toxic"]):
                low = (text or "").lower()
                hits = hits_of(low, m, cache)
                if hits:
                    c[toxic].update({"", *(w for start, end, _ in hits for w in context(low, start, end, m.settings.window)[0])})
            both = sorted(c[0].keys() | c[1].keys())
            yield pd.DataFrame({"w": pd.Series(both, dtype=object), "clean": pd.Series([c[0][w] for w in both], dtype="int64"), "toxic": pd.Series([c[1][w] for w in both], dtype="int64")})

    rows = sample.select("text", "toxic").distinct().mapInPandas(tell, "w string, clean long, toxic long").groupBy("w").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    told = rows.where((F.col("clean") + F.col("toxic") >= least) | (F.col("w") == "")).toPandas().set_index("w")
    if "" not in told.index or not told.loc[""].all():
        return {}
    total, told = told.loc[""], told.drop(index="")
    share = (told["clean"] + told["toxic"]) / (total["clean"] + total["toxic"])
    evidence = sum(told[k] * np.log(np.maximum(told[k], 1e-9) / (share * total[k])) for k in ("clean", "toxic"))
    weight = np.log((told["toxic"] + 1) / (total["toxic"] + 2)) - np.log((told["clean"] + 1) / (total["clean"] + 2))
    return weight[evidence >= np.log(max(len(told), 1)) + 1].to_dict()


def _logistic(counts: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps on log(1 + count), drawn towards a prior that holds where
    training shows nothing. A second fit sets the prior by the first: a misspelt hit weighs nearly what a whole
    one does, a quoted hit a fifth of that."""
    x = np.hstack([np.log1p(counts), np.ones((len(counts), 1))])
    n = n / np.where(y == 1, max(n[y == 1].sum(), 1), max(n[y == 0].sum(), 1)) * 1000  # labels weigh the same
    pull = np.array([0.5] * len(KINDS) + [0.01])
    prior = np.array([6.0, 6.0, 5.0, 1.0, 1.0, 0.5, -3.0])
    for _ in range(2):
        w = prior.copy()
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (p - y)) + pull * (w - prior)
            hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            step = np.linalg.solve(hess, grad)
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        whole = max(w[0], w[1])
        least = -w[-1] / np.log(2) + 0.5  # one misspelt hit is enough where one whole hit is
        prior = np.array([w[0], w[1], min(whole, max(0.9 * whole, least)), 0.2 * whole, 0.2 * whole, 0.15 * whole, w[-1]])
    return w


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5) from the whole text alone.

    Null and empty texts have no hit and get the score of that; without a model every score is 0. Other
    columns pass through; columns of the two names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        m = _ready(m) if m is not None else None
        cache = state.setdefault("cache", {})
        for texts in batches:
            if m is None:
                yield pd.Series(np.zeros(len(texts)))
                continue
            x = np.log1p(np.array([features(t, m, cache) for t in texts], float).reshape(len(texts), len(KINDS)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30))))

    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = docs.select(*rest, F.pandas_udf(f, "double")(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

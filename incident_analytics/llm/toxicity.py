"""Toxicity of whole texts: a learned lexicon, matched with spelling errors, judged in context.

1. From a bounded sample of labelled rows, words that are far more frequent in
   toxic than in other texts become lexicon terms (log-likelihood ratio).  Texts
   that share their smallest shingle hash count once, so one text copied many
   times does not put its own words into the lexicon.
2. The lexicon is a trie.  Levenshtein automata for one error (terms of five
   letters or more) or two (nine or more) run through it together; their product
   is made deterministic as words need it and is kept by the worker.
3. Every hit is looked at in a window of words: hits between quotation marks or
   after words of report count apart from plain ones, and hits close to other
   hits or to words of address count more.
4. A logistic regression over those counts gives the score.

Defined cases: a null or empty text has no hits and gets the base rate's score;
a sample without both labels gives the rate of the label (0 without rows) to
every text; repeated labels of a document count once (toxic if any says so),
null labels not at all; repeated rows are scored one by one; an empty table
gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from incident_analytics.llm.rows import map_slices
from incident_analytics.session import materialize

SAMPLE_ROWS = 20_000
LEAST_TEXTS = 4
LEAST_EVIDENCE = 20.0
LEAST_LIFT = 8.0
TERMS = 5_000
WINDOW = 8
MEMO = 400_000
ONE_ERROR, TWO_ERRORS = 5, 9
QUOTES = "\"'“”„«»‘’"
REPORT = frozenset("said says say wrote writes called calling quote quoted quoting word words term "
                   "means meaning dit disait écrit mot sagte sagt schrieb wort dijo dice escribió "
                   "palabra".split())
ADDRESS = frozenset("you your yours u ur du dich dein deine sie ihr euch tu te toi vous votre tú "
                    "usted tu vosotros".split())
FEATURES = ("strength", "peak", "exact", "fuzzy", "two_errors", "quoted", "dense", "addressed")
_WORD = re.compile(r"\w+")


def allowed_errors(term: str) -> int:
    return 2 if len(term) >= TWO_ERRORS else 1 if len(term) >= ONE_ERROR else 0


class FuzzyLexicon:
    """Levenshtein automata of all terms, run together over their trie.

    A state is a set of (trie node, errors so far); it is computed from the one
    before it for a letter on first use.  State 0 is dead, so most words stop
    after a few letters.
    """

    def __init__(self, terms: list[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.most = [0]
        self.ends: dict[int, str] = {}
        for term in sorted(terms):
            node, errors = 0, allowed_errors(term)
            self.most[0] = max(self.most[0], errors)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], errors)
            self.ends[node] = term
        self._reset()

    def _reset(self) -> None:
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[dict[int, int]] = [{}]
        self.step: dict[tuple[int, str], int] = {}
        self.accepts: dict[int, tuple[str, int] | None] = {0: None}
        self.first = self._state(self._skip({0: 0}) if self.children[0] else {})

    def _skip(self, found: dict[int, int]) -> dict[int, int]:
        """Add the nodes reached by leaving letters of a term out."""
        todo = list(found)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                errors = found[node] + 1
                if errors <= self.most[child] and errors < found.get(child, 99):
                    found[child] = errors
                    todo.append(child)
        return found

    def _state(self, found: dict[int, int]) -> int:
        key = frozenset(found.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(found)
        return self.states[key]

    def _next(self, state: int, letter: str) -> int:
        found: dict[int, int] = {}

        def reach(node: int, errors: int) -> None:
            if errors <= self.most[node] and errors < found.get(node, 99):
                found[node] = errors

        for node, errors in self.sets[state].items():
            reach(node, errors + 1)  # a letter too many
            for own, child in self.children[node].items():
                reach(child, errors if own == letter else errors + 1)
        return self._state(self._skip(found))

    def match(self, word: str) -> tuple[str, int] | None:
        """The closest term within its allowed errors (fewest errors, then by name), or None."""
        state = self.first
        for letter in word:
            key = (state, letter)
            after = self.step.get(key)
            if after is None:
                if len(self.step) > MEMO:
                    self._reset()
                    return self.match(word)
                after = self.step[key] = self._next(state, letter)
            state = after
            if not state:
                return None
        if state not in self.accepts:
            ends = [(errors, self.ends[node]) for node, errors in self.sets[state].items()
                    if node in self.ends and errors <= allowed_errors(self.ends[node])]
            self.accepts[state] = (min(ends)[1], min(ends)[0]) if ends else None
        return self.accepts[state]


def in_quotes(text: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks inside one line."""
    return [m.span() for m in re.finditer(r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‘[^’\n]+’", text)]


def features(text: str, hits: dict[str, tuple[str, int]], lift: dict[str, float]) -> list[float]:
    """Counts of hits by kind and context, as logarithms, with the summed and the largest lift of exact ones.

    ``hits`` maps words to (term, errors), ``lift`` terms to the logarithm of their lift.
    """
    found = [(m.group(), *m.span()) for m in _WORD.finditer(text)]
    at = [i for i, (w, _, _) in enumerate(found) if w in hits]
    spans = in_quotes(text)
    sums, peak = dict.fromkeys(FEATURES, 0.0), 0.0
    for n, i in enumerate(at):
        word, start, end = found[i]
        around = {w for w, _, _ in found[max(0, i - WINDOW):i + WINDOW + 1]}
        if any(a < start and end < b for a, b in spans) or around & REPORT and any(
                q in text[max(0, start - 2):start] for q in QUOTES):
            sums["quoted"] += 1
            continue
        term, errors = hits[word]
        sums[("exact", "fuzzy", "two_errors")[errors]] += 1
        if not errors:
            sums["strength"] += lift[term]
            peak = max(peak, lift[term])
        sums["dense"] += any(0 < abs(j - i) <= WINDOW for j in at[max(0, n - 1):n + 2])
        sums["addressed"] += bool(around & ADDRESS)
    return [peak if f == "peak" else math.log1p(sums[f]) for f in FEATURES]


def text_features(lexicon: FuzzyLexicon, lift: dict[str, float],
                  texts: list[str | None]) -> list[list[float]]:
    """Features of a slice of texts; each distinct word runs through the automaton once."""
    lowered = [(t or "").lower() for t in texts]
    words = [set(_WORD.findall(t)) for t in lowered]
    hits = {w: m for w in set().union(*words) if (m := lexicon.match(w))}
    return [features(t, hits, lift) if not hits.keys().isdisjoint(own) else [0.0] * len(FEATURES)
            for t, own in zip(lowered, words)]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str,
                    label_col: str) -> DataFrame:
    """About ``rows`` labelled texts (id, text, label), chosen by the hash of the id.

    The sampled labels are bounded by ``rows`` and may be broadcast, so no text is shuffled.
    """
    one = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic")))
    share = min(1.0, rows / max(1, one.count()))
    few = one.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(few), id_col)


def _sketch(text: str | None) -> int:
    words = (text or "").lower().split()
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    return min(xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams) >> 1


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of a sample (``text``, ``toxic``) with the logarithm of their lift; at most ``TERMS``."""
    schema = StructType([StructField("sketch", LongType()), StructField("toxic", IntegerType()),
                         StructField("text", StringType())])
    once = map_slices(sample.select("text", "toxic"), lambda texts, toxic: {
        "sketch": [_sketch(t) for t in texts], "toxic": toxic, "text": texts}, schema) \
        .groupBy("sketch", "toxic").agg(F.min("text").alias("text"))
    counts = StructType([StructField("word", StringType()), StructField("toxic", LongType()),
                         StructField("other", LongType())])
    arrow = to_arrow_schema(counts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found[toxic > 0].update({*_WORD.findall((text or "").lower()), ""})
        words = list(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()),
                                          pa.array([found[1][w] for w in words], pa.int64()),
                                          pa.array([found[0][w] for w in words], pa.int64())],
                                         schema=arrow)

    summed = once.select("text", "toxic").mapInArrow(counted, counts).groupBy("word").agg(
        F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    totals = summed.where("word = ''").first()  # the empty word stands in every text
    if totals is None or not totals["a"] or not totals["b"]:
        return {}
    na, nb = float(totals["a"]), float(totals["b"])
    pa_, pb = F.col("a") / na, (F.col("b") + 0.5) / nb
    mean = (F.col("a") + F.col("b")) / (na + nb)
    gain = 2 * (F.col("a") * F.log(pa_ / mean)
                + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / nb / mean)).otherwise(0.0))
    kept = (summed.where((F.length("word") > 2) & (F.col("a") >= LEAST_TEXTS))
            .where((pa_ / pb >= LEAST_LIFT) & (gain >= LEAST_EVIDENCE))
            .orderBy(gain.desc(), "word").limit(TERMS).select("word", F.log(pa_ / pb).alias("lift")))
    return {r["word"]: r["lift"] for r in kept.collect()}


@dataclass(frozen=True)
class ToxicityModel:
    lift: dict[str, float]  # logarithm of the lift of every term
    weights: tuple[float, ...]  # one per feature, then the intercept

    def scores(self, rows: list[list[float]]) -> list[float]:
        logits = np.array(rows).reshape(-1, len(FEATURES)) @ np.array(self.weights[:-1]) + self.weights[-1]
        return (1 / (1 + np.exp(-np.clip(logits, -35, 35)))).tolist()


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the intercept is last and free."""
    x = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        grad = x.T @ (y - p) - penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn the lexicon and the weights from about ``rows`` labelled texts."""
    sample = materialize(labelled_sample(docs, labels, rows, id_col, text_col, label_col), "toxic-sample")
    lift = learn_lexicon(sample)
    lexicon = FuzzyLexicon(list(lift))
    schema = StructType([StructField("x", ArrayType(DoubleType())), StructField("toxic", IntegerType())])
    got = map_slices(sample.select("text", "toxic"), lambda texts, toxic: {
        "x": text_features(lexicon, lift, texts), "toxic": toxic}, schema).collect()  # bounded by ``rows``
    y = np.array([float(r["toxic"] > 0) for r in got])
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 0.0
        return ToxicityModel({}, (0.0,) * len(FEATURES) + (35.0 if rate else -35.0,))
    weights = fit_logistic(np.array([r["x"] for r in got]), y)
    return ToxicityModel(lift, tuple(weights.tolist()))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` and ``predicted`` (1 from 0.5 on)."""
    schema = StructType([docs.select(id_col).schema[0], StructField("score", DoubleType()),
                         StructField("predicted", IntegerType())])
    lexicon = FuzzyLexicon(list(model.lift))

    def scored(ids: list, texts: list) -> dict:
        found = model.scores(text_features(lexicon, model.lift, texts))
        return {id_col: ids, "score": found, "predicted": [int(s >= 0.5) for s in found]}

    return map_slices(docs.select(id_col, text_col), scored, schema)

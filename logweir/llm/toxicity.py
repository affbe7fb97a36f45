"""Toxicity by a counterfactual-regularised classifier."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from logweir.llm.common import written
from logweir.llm.langid import held_out

WORD = re.compile(r"[^\W_]+")
#: Terms for groups of people. Those of one line are exchanged for one another.
IDENTITY = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("man", "woman"),
    ("men", "women"),
    ("immigrant", "native", "refugee", "foreigner"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("blind", "deaf", "disabled"),
    ("old", "young"),
)
TERMS = frozenset(t for line in IDENTITY for t in line)
#: The bounded sample of labelled rows that the classifier is fitted on, by hash of doc_id: at most so many of each label.
MOST = 6000
#: Words of the classifier, and rows of the sample that a word must be in.
WORDS, LEAST = 2000, 3
#: Least worth of a word: signed roots of the likelihood ratio below it are common among words that mean nothing.
WORTH = 7.0
RIDGE, PARITY, ROUNDS = 1e-4, 1.0, 300


def words_of(text: str) -> set[str]:
    """Distinct words, and the first four and five letters of the longer ones, which inflected forms share.

    Identity terms have no letters apart, so that all they add to a logit is the weight that exchanges penalise.
    """
    words = set(WORD.findall(text.lower()))
    rest = words - TERMS
    return words | {f"^{w[:4]}" for w in rest if len(w) > 4} | {f"^{w[:5]}" for w in rest if len(w) > 5}


def exchanges(words: set[str]) -> list[tuple[str, str]]:
    """(term, other): each identity term of words with each other term of its line that words lack.

    A counterfactual differs from its text in these two words alone, so its logit does by their weights.
    """
    return [(term, other) for line in IDENTITY for term in sorted(words.intersection(line)) for other in line if other not in words]


def sample_rows(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """(toxic, words) of the bounded sample: the distinct words of whole texts. Rows labelled both ways count as toxic."""
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for value in (0, 1):
        own = labels.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = own if picked is None else picked.unionByName(own)

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words_of(t or "")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["toxic", "words"])

    # at most 2 * most rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    return written(rows.mapInArrow(split, "toxic int, words array<string>"), "toxicity")


def vocabulary(rows: DataFrame, words: int = WORDS, least: int = LEAST) -> list[str]:
    """Words that tell the labels apart best by signed root of the likelihood ratio, and all identity terms."""
    totals = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("all")).filter(F.col("all") >= least)
    p, q = (F.col("pos") + 0.5) / (n.get(1, 0) + 1), (F.col("all") - F.col("pos") + 0.5) / (n.get(0, 0) + 1)
    worth = F.abs(F.ln(p / q)) * F.sqrt(F.least(F.col("all"), F.lit(1e6)))
    best = counts.filter(worth >= WORTH).orderBy(F.round(worth, 6).desc(), "word").limit(words).select("word").toPandas()["word"]
    return sorted({*best, *(t for line in IDENTITY for t in line)})


def loss(w: np.ndarray, bias: float, data: tuple[np.ndarray, ...], ridge: float, parity: float) -> float:
    """Mean log loss, ridge / 2 times the squared weights, and parity times the mean squared change of the logit under exchanges.

    data: (row and column of each word present, labels, columns of the two terms of each exchange).
    """
    at, col, y, first, second = data
    logit = np.bincount(at, w[col], len(y)) + bias
    change = ((w[first] - w[second]) ** 2).mean() if len(first) else 0.0
    return float((np.logaddexp(0, logit) - y * logit).mean() + ridge / 2 * (w**2).sum() + parity * change)


def slope(w: np.ndarray, bias: float, data: tuple[np.ndarray, ...], ridge: float, parity: float) -> np.ndarray:
    """The gradient of loss by the weights and, last, the bias."""
    at, col, y, first, second = data
    logit = np.bincount(at, w[col], len(y)) + bias
    error = (1 / (1 + np.exp(-logit)) - y) / len(y)
    grad = np.bincount(col, error[at], len(w)) + ridge * w
    if len(first):
        change = 2 * parity * (w[first] - w[second]) / len(first)
        grad += np.bincount(first, change, len(w)) - np.bincount(second, change, len(w))
    return np.append(grad, error.sum())


def train(rows: list[tuple[int, set[str]]], names: list[str], ridge: float = RIDGE, parity: float = PARITY, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model on the presence of words.

    The loss is the mean log loss, a ridge, and `parity` times the mean squared change of the logit between a
    text and each of its counterfactuals, the same text with an identity term exchanged.
    """
    index = {w: i for i, w in enumerate(names)}
    base = sum(y for y, _ in rows) / max(1, len(rows))
    if not rows or base in (0, 1):
        return np.zeros(len(names)), float(np.log((base + 0.01) / (1.01 - base)))
    at, col, y = [], [], np.array([t for t, _ in rows], np.float64)
    first, second = [], []
    for i, (_, words) in enumerate(rows):
        own = [index[w] for w in words if w in index]
        at += [i] * len(own)
        col += own
        for a, b in exchanges(words):
            first.append(index[a])
            second.append(index[b])
    at, col, first, second = (np.array(x, np.int64) for x in (at, col, first, second))
    w, bias = np.zeros(len(names)), float(np.log(base / (1 - base)))
    m, s = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, rounds + 1):
        grad = slope(w, bias, (at, col, y, first, second), ridge, parity)
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return w, bias


def score(docs: DataFrame, names: list[str], weights: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """docs with a score column: the model's probability for each whole text, rounded to 9 digits.

    Null and empty texts score the bias alone. Equal texts score equally; repeated rows stay. Very long texts
    cost memory for their distinct words. An empty table gives no rows; a column named score is replaced.
    """
    of = {w: float(x) for w, x in zip(names, weights) if x}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(of)
        for batch in batches:
            logits = np.array([bias + sum(of[w] for w in sorted(words_of(t or "") & known)) for t in batch.column(text).to_pylist()])
            found = np.round(1 / (1 + np.exp(-np.clip(logits, -50, 50))), 9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    docs = docs.drop("score")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    rows = sample_rows(docs, labels)
    names = vocabulary(rows)
    known = F.array_intersect("words", F.lit(names))
    table = rows.select("toxic", known.alias("words")).toPandas()
    data = sorted((int(t), tuple(sorted(w))) for t, w in zip(table["toxic"], table["words"]))
    weights, bias = train([(t, set(w)) for t, w in data], names)
    return names, weights, bias


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = held_out(F.col("doc_id"), 3, 1)
    names, weights, bias = fit(docs, labels.filter(~out))
    scored = score(docs.select("doc_id", out.alias("held_out"), "text"), names, weights, bias)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))

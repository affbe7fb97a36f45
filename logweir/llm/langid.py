"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from logweir.llm.common import giving_back

#: Symbols of the alphabet: 0 for what is no letter, a to z, and 37 classes for all other letters.
SYMBOLS = 64
#: Length of the random vectors.
LENGTH = 2048
UNKNOWN = "und"


@cache
def symbols() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if unicodedata.category(chr(i))[0] == "L":
            table[i] = i - 96 if 97 <= i <= 122 else 27 + i % 37
    return table


@cache
def letters() -> np.ndarray:
    """One random vector of +1 and -1 for each symbol."""
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SYMBOLS, LENGTH))


def trigrams(text: str) -> np.ndarray:
    """Codes of all letter trigrams, runs of other signs as one; empty where there is no letter."""
    s = symbols()[np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)]
    if not s.any():
        return np.zeros(0, np.int32)
    s = np.concatenate([np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)]).astype(np.int32)
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    s = s[keep]
    return s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:]


def bound_pairs() -> np.ndarray:
    """Vectors of the first two letters of a trigram: permuted twice and once, bound by multiplication."""
    v = letters()
    return (np.roll(v, 2, axis=1)[:, None, :] * np.roll(v, 1, axis=1)[None]).reshape(SYMBOLS**2, LENGTH)


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the trigrams' vectors, each as often as counted."""
    total = np.zeros(LENGTH)
    pairs, v = bound_pairs(), letters()
    for lo in range(0, len(codes), 8192):
        c = codes[lo : lo + 8192]
        total += counts[lo : lo + 8192].astype(np.float64) @ (pairs[c // SYMBOLS] * v[c % SYMBOLS]).astype(np.float64)
    return total


def similarity_table(prototypes: np.ndarray) -> np.ndarray:
    """Dot product of each trigram's vector with each prototype of length one."""
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    pairs, v = bound_pairs().astype(np.float32), letters().astype(np.float32)
    return np.stack([((pairs * p.astype(np.float32)) @ v.T).ravel() for p in unit], axis=1).astype(np.float64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes: bundles of all trigrams of all rows with a language.

    Counts are integers summed by Spark with map-side combine, at most SYMBOLS**3 a language, so the driver
    gets a bounded table and reruns give the same prototypes.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = trigrams(t or "")
                if name not in seen:
                    seen[name] = np.zeros(SYMBOLS**3, np.int64)
                if len(codes) > 50_000:
                    seen[name] += np.bincount(codes, minlength=SYMBOLS**3)
                elif len(codes):
                    np.add.at(seen[name], codes, 1)
        for name, n in seen.items():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "code", "n"])

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    table = rows.mapInArrow(giving_back(count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["lang"].unique())
    parts = [table[table["lang"] == x].sort_values("code") for x in names]
    return names, np.stack([bundle(p["code"].to_numpy(), p["n"].to_numpy()) for p in parts]) if parts else np.zeros((0, LENGTH))


def predict(docs: DataFrame, names: list[str], prototypes: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred and score: the prototype of greatest cosine, and its share of the positive cosines.

    A document's vector is the bundle of its trigrams. Its cosine with a prototype is the sum of its trigrams'
    dot products with the prototype over its own length; the length is the same for all prototypes and drops
    out of the order and of the share. Null text or text without a letter: `und`, score 0; so it is for all
    documents where nothing was learned. Ties go to the first language in order. Whole texts are read, however
    long; repeated rows give equal results; an empty table gives no rows; all columns of docs are kept (if
    docs has lang_pred or score already, they are replaced).
    """
    table: list[np.ndarray] = []

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not table:
            table.append(similarity_table(prototypes) if len(names) else np.zeros((SYMBOLS**3, 1)))
        for batch in batches:
            found, scores = [], []
            for t in batch.column(text).to_pylist():
                codes = trigrams(t or "")
                if not len(codes) or not names:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = table[0][codes].sum(axis=0)
                best = int(np.argmax(cosines))
                positive = np.maximum(cosines, 0).sum()
                found.append(names[best])
                scores.append(float(np.clip(cosines[best] / positive, 0, 1)) if positive > 0 else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.mapInArrow(giving_back(score), schema)


def held_out(key: "F.Column", folds: int, fold: int) -> "F.Column":
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op7_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = held_out(F.col("doc_id"), 4, 2)
    names, prototypes = fit(docs.filter(~out).select("text", "lang"))
    return predict(docs.select("doc_id", out.alias("held_out"), "text"), names, prototypes).select("doc_id", "held_out", "lang_pred", "score")

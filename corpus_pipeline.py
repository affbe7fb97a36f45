"""A training corpus from raw documents: five stages, each an operator of logweir.llm on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import bpe, jaccard, langid, mixing, simhash, suffix
from logweir.llm.common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: no text, or no letter in it."""
    names, prototypes = langid.fit(docs.select("text", "lang"))
    return langid.predict(docs, names, prototypes).filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group linked by SimHash fingerprints or by a Jaccard similarity of 0.8 or more, of five-word shingles."""
    return simhash.first_of_each_group(docs, jaccard.near_duplicates(docs, shingle=5))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every byte within a 200-byte string that occurs more than once. Characters cut in part go too; documents stay, if empty."""
    others = tuple(c for c in docs.columns if c not in ("text", "n_chars"))
    found = suffix.suffix_dedup(docs, columns=others, keep_text=True)
    found = found.withColumn("text", F.col("kept_text"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents for each source's share of the mix, up to twice each."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the ids and of the text they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("tokens", encode),
]

#: Language profiles, groups of near copies and BPE are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)

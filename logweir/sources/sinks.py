"""Sinks: small result tables as CSV or JSON files, vocabularies as Parquet, and a record of runs."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How CSV files show null.
NULL = "\\N"


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; null is written as \\N, so that it and an empty string come back as they were."""
    df.write.mode("overwrite").option("header", True).option("nullValue", NULL).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", NULL).option("emptyValue", "").option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("value", "code").write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("value", "code")


def n_tokens(vocabulary: DataFrame) -> DataFrame:
    """(n_tokens): codes in use, the reserved ones before the first value included."""
    return vocabulary.agg(F.coalesce(F.max("code") + 1, F.lit(3)).cast("bigint").alias("n_tokens"))


class Tracker:
    """A record of runs: one JSON line for each call, in the shared store; with no folder it records nothing."""

    def __init__(self, spark: SparkSession, folder: str | None):
        self.spark, self.folder, self.run = spark, folder, uuid.uuid4().hex[:12]

    def log(self, kind: str, **values) -> None:
        if self.folder:
            row = (self.run, int(time.time() * 1e6), kind, json.dumps(values, sort_keys=True, default=str))
            self.spark.createDataFrame([row], "run string, at long, kind string, record string").coalesce(1).write.mode("append").json(self.folder)

    def records(self) -> DataFrame:
        return self.spark.read.schema("run string, at long, kind string, record string").json(self.folder).filter(F.col("run") == self.run)

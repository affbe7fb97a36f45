"""Sources and sinks: raw text logs, day-partitioned Parquet, reports, cost model."""

from __future__ import annotations

import hashlib
import os
import shutil
import urllib.request
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.operators import clean
from logweir.schema import RAW_AUTH_SCHEMA, RAW_REDTEAM_SCHEMA

#: Measured bytes an event: raw text, interim Parquet, feature store. Bytes of memory an event of the largest day: features, evaluation.
BYTES = {"raw": 68.7, "interim": 9.7, "store": 35.5}
MEMORY = {"features": 713, "evaluation": 872}


class ExistingOutputError(FileExistsError):
    """The output has partitions already."""


class RowCountError(ValueError):
    """Rows kept and dropped do not add up."""


def read_raw(spark: SparkSession, path: str | list[str], schema: T.StructType = RAW_AUTH_SCHEMA) -> DataFrame:
    """Headerless CSV, all text. Missing fields are null, further ones are cut off. A gzip file is one task: repartition after cleaning."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("header", False).csv(path)


def read_redteam(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, RAW_REDTEAM_SCHEMA)


def read_any_compression(spark: SparkSession, path: str, schema: T.StructType = RAW_AUTH_SCHEMA) -> DataFrame:
    """As read_raw, with gzip told by the first two bytes of each file and not by its name.

    Files are opened as streams by Hadoop's file system, and only their first bytes are looked at here; files
    that are packed without saying so in their names are copied once, packed as they are, to the shared folder
    under a name that says it, a block at a time. What is read is then Spark's own source in any case.
    """
    from logweir.sources.shared import shared_dir

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    names = [str(s.getPath()) for s in fs.listStatus(place)] if fs.getFileStatus(place).isDirectory() else [path]
    names = [n for n in names if not n.rsplit("/", 1)[-1].startswith(("_", "."))]
    found = []
    for n in names:
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(n))
        packed = stream.read() == 0x1F and stream.read() == 0x8B
        stream.close()
        if packed and not n.endswith(".gz"):
            target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/packed-{uuid.uuid4().hex}.gz")
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, jvm.org.apache.hadoop.fs.Path(n), target.getFileSystem(conf), target, False, conf)
            n = str(target)
        found.append(n)
    return read_raw(spark, found, schema)


def line_blocks(path: str, block: int = 128 << 20):
    """Blocks of whole lines of a local file, of about `block` bytes; a longer line is a block of its own."""
    with open(path, "rb") as f:
        rest = b""
        while data := f.read(block):
            data = rest + data
            cut = data.rfind(b"\n") + 1
            if not cut:
                rest = data
                continue
            yield data[:cut]
            rest = data[cut:]
        if rest:
            yield rest


def copy_with_resume(source: str, target: str, sha256: str | None = None, block: int = 8 << 20, tries: int = 8) -> None:
    """Copies a file or URL to a local file, going on at the end of an earlier part, and verifies its checksum. A wrong one removes the copy.

    A lock file keeps two copies of one target apart.
    """
    lock = f"{target}.lock"
    os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
    try:
        part = f"{target}.part"
        for attempt in range(tries):
            try:
                have = os.path.getsize(part) if os.path.exists(part) else 0
                url = source if "://" in source else f"file://{os.path.abspath(source)}"
                if url.startswith("file://"):
                    stream = open(url[7:], "rb")  # noqa: SIM115
                    stream.seek(have)
                else:
                    stream = urllib.request.urlopen(urllib.request.Request(url, headers={"Range": f"bytes={have}-"} if have else {}))
                    if have and stream.status != 206:
                        have = 0
                with stream, open(part, "ab" if have else "wb") as out:
                    shutil.copyfileobj(stream, out, block)
                break
            except OSError:
                if attempt + 1 == tries:
                    raise
        if sha256 and sha256_of(part) != sha256:
            os.remove(part)
            raise ValueError(f"{target}: another checksum")
        os.replace(part, target)
    finally:
        os.remove(lock)


@dataclass
class ConversionReport:
    rows_in: int
    rows_out: int
    dropped: int
    out_of_range: int


def write_by_day(raw: DataFrame, out: str, line: str, days: tuple[int, int] | None = None, overwrite: bool = False) -> ConversionReport:
    """Cleans raw rows and writes Parquet in day= folders. Counts are observed while writing, so the input is read once.

    Existing output is refused unless overwrite is set.
    """
    from pyspark.sql import Observation

    spark = raw.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(out)
    if not overwrite and hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise ExistingOutputError(out)
    seen, kept = Observation("raw"), Observation("kept")
    rows = raw.observe(seen, F.count(F.lit(1)).alias("n"))
    typed = clean.clean_auth(rows, line)
    inside = F.col("day").between(*days) if days else F.lit(True)
    typed = typed.observe(kept, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((~inside).cast("bigint")), F.lit(0)).alias("outside"))
    typed.filter(inside).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("day").option("compression", "zstd").parquet(out)
    n_in, n, outside = seen.get["n"], kept.get["n"], kept.get["outside"]
    return ConversionReport(n_in, n - outside, n_in - n, outside)


def verify_row_count(report: ConversionReport, expected: int) -> None:
    if report.out_of_range:
        raise RowCountError("a run over some days only cannot be verified against the whole")
    if report.rows_out + report.dropped != expected:
        raise RowCountError(f"{report.rows_out} kept and {report.dropped} dropped are not {expected}")


def read_days(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Partition pruning by day."""
    return spark.read.parquet(path).filter(F.col("day").between(first, last))


def stage_bytes(spark: SparkSession, events: int) -> DataFrame:
    return spark.createDataFrame([(k, float(b)) for k, b in BYTES.items()], "stage string, b double").select("stage", F.round(F.lit(events) * F.col("b")).cast("bigint").alias("bytes"))


def total_disk(events: int) -> int:
    return round(events * sum(BYTES.values()))


def peak_memory(largest_day: int) -> int:
    return max(round(largest_day * b) for b in MEMORY.values())


def most_events_for_disk(free: int) -> int:
    return int(free / sum(BYTES.values()))


def most_day_events_for_memory(free: int) -> int:
    return free // max(MEMORY.values())


def require_free_space(path: str, needed: int) -> None:
    free = shutil.disk_usage(path).free
    if free < needed:
        raise OSError(f"{needed} bytes are needed and {free} are free")


def sha256_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()

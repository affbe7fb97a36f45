"""Parsing, cleaning and data quality of raw log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.schema import SECONDS_PER_DAY, UNKNOWN

#: Parts of the input that are numbered each on their own; the table of their counts has at most as many rows.
SLICES = 1024


def part(column: str, n: int) -> "F.Column":
    """The n-th part (from 1) of user@domain; null if there is no @. A third part is ignored."""
    pieces = F.split(column, "@")
    return F.when(F.size(pieces) >= 2, F.try_element_at(pieces, F.lit(n)))


def known(column: str) -> "F.Column":
    """The value, or null for the placeholder of unknown values."""
    return F.nullif(F.col(column), F.lit(UNKNOWN))


def unknown_flag(column: str) -> "F.Column":
    """True for null or the placeholder; never null."""
    return F.coalesce(F.col(column) == UNKNOWN, F.lit(True))


def is_machine(column: "F.Column") -> "F.Column":
    return F.coalesce(F.endswith(column, F.lit("$")), F.lit(False))


def drop_reason(raw: DataFrame) -> "F.Column":
    """Why a row cannot be used: its time first, then its account; null for usable rows. Reasons are disjoint."""
    return F.when(F.expr("try_cast(time AS BIGINT)").isNull(), "null_time").when(part("src_user_at_domain", 2).isNull() | part("dst_user_at_domain", 2).isNull(), "malformed_account")


def drop_counts(raw: DataFrame) -> DataFrame:
    """(rows_in, null_time, malformed_account, rows_out), in one pass."""
    reason = drop_reason(raw)
    return raw.select(reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("reason") == "null_time").alias("null_time"),
        F.count_if(F.col("reason") == "malformed_account").alias("malformed_account"),
        F.count_if(F.col("reason").isNull()).alias("rows_out"),
    )


def clean_auth(raw: DataFrame, line: str = "event_id", dense: bool = False, offset: int = 0) -> DataFrame:
    """Typed log rows of the usable raw rows.

    `line` orders the input. With dense=True, event_id is offset + rank among the usable rows: the rows of
    each range partition are counted, and the counts before it are added, so no single task sees all rows.
    """
    rows = raw.withColumn("reason", drop_reason(raw)).filter("reason is null")
    if dense:
        rows = dense_ids(rows, line, offset)
    time = F.expr("try_cast(time AS BIGINT)").cast("int")
    return rows.select(
        F.col(line).cast("bigint").alias("event_id"),
        time.alias("time"),
        F.floor(time / SECONDS_PER_DAY).cast("int").alias("day"),
        part("src_user_at_domain", 1).alias("src_user"),
        part("src_user_at_domain", 2).alias("src_domain"),
        part("dst_user_at_domain", 1).alias("dst_user"),
        part("dst_user_at_domain", 2).alias("dst_domain"),
        "src_computer",
        "dst_computer",
        known("auth_type").alias("auth_type"),
        unknown_flag("auth_type").alias("auth_type_is_null"),
        known("logon_type").alias("logon_type"),
        unknown_flag("logon_type").alias("logon_type_is_null"),
        known("auth_orientation").alias("auth_orientation"),
        (F.col("success_failure") == "Success").alias("success"),
        is_machine(part("src_user_at_domain", 1)).alias("src_user_is_machine"),
        is_machine(part("dst_user_at_domain", 1)).alias("dst_user_is_machine"),
    )


def dense_ids(rows: DataFrame, line: str, offset: int = 0) -> DataFrame:
    """Replaces `line` by consecutive numbers in its order, from offset."""
    lo, hi = rows.agg(F.min(line), F.max(line)).first()
    width = max(1, -(-((hi or 0) - (lo or 0) + 1) // SLICES))
    rows = rows.withColumn("slice", F.floor((F.col(line) - F.lit(lo or 0)) / width).cast("int"))
    counts = rows.groupBy("slice").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("slice").alias("of"), before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("slice").orderBy(line)) - 1
    numbered = rows.join(F.broadcast(counts), F.col("slice") == F.col("of"))
    return numbered.withColumn(line, F.lit(offset) + F.col("before") + inner).drop("slice", "of", "before")


def clean_redteam(raw: DataFrame) -> DataFrame:
    """Typed, distinct intrusion rows."""
    time = F.expr("try_cast(time AS BIGINT)").cast("int")
    return raw.select(
        time.alias("time"), F.floor(time / SECONDS_PER_DAY).cast("int").alias("day"), part("user_at_domain", 1).alias("user"), part("user_at_domain", 2).alias("domain"), "src_computer", "dst_computer"
    ).dropDuplicates()


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_rate)."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_rate").withColumn("null_rate", F.round("null_rate", 9))


def cardinality(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_unique): distinct values, null being one of them."""
    one = df.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("bigint"))).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "n_unique")


def duplicate_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, duplicate_rows): rows beyond the first of each distinct row. Partial counts meet once per distinct row."""
    each = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return each.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows"))


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(rows, least, greatest, digest) of a table, whatever the order of its rows: the digest is the sum of 32 bits of each row's MD5, modulo 1000003 a row."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    part = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_003))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"), F.sum(part).alias("digest"))

"""A made-up authentication log with intrusions, for demonstrations and end-to-end tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.schema import RAW_AUTH, RAW_REDTEAM, SECONDS_PER_DAY


def _draw(seed: int, salt: str, n: int, *keys) -> "F.Column":
    """A number from 0 to n - 1 that depends on the keys alone, so any partitioning gives the same log."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(n))


def demo_log(spark: SparkSession, days: int = 12, users: int = 60, hosts: int = 80, per_day: int = 2_000, seed: int = 0) -> DataFrame:
    """Raw log rows with event_id. Each account has a home host and a few usual destinations; some events go elsewhere, fail, or have unknown types."""
    rows = spark.range(days * per_day).withColumnRenamed("id", "event_id")
    user = _draw(seed, "user", users, "event_id")
    rows = rows.withColumns({"u": user, "day": F.floor(F.col("event_id") / per_day)})
    usual = F.pmod(F.xxhash64(F.lit(seed), "u", _draw(seed, "habit", 4, "event_id")), F.lit(hosts))
    rows = rows.withColumns(
        {
            "dst": F.when(_draw(seed, "odd", 50, "event_id") == 0, _draw(seed, "dst", hosts, "event_id")).otherwise(usual),
            "src": F.pmod(F.col("u") * 7, F.lit(hosts)),
            "name": F.concat(F.lit("U"), F.col("u").cast("string"), F.when(F.col("u") % 10 == 0, "$").otherwise("")),
            "second": F.least(F.lit(SECONDS_PER_DAY - 1), 25_200 + _draw(seed, "minute", 600, "event_id") * 60 + _draw(seed, "second", 60, "event_id")),
        }
    )
    of = {
        "time": (F.col("day") * SECONDS_PER_DAY + F.col("second")).cast("string"),
        "src_user_at_domain": F.concat("name", F.lit("@DOM1")),
        "dst_user_at_domain": F.concat("name", F.lit("@DOM1")),
        "src_computer": F.concat(F.lit("C"), F.col("src").cast("string")),
        "dst_computer": F.concat(F.lit("C"), F.col("dst").cast("string")),
        "auth_type": F.when(_draw(seed, "auth", 3, "event_id") == 0, "?").otherwise("Kerberos"),
        "logon_type": F.when(_draw(seed, "logon", 4, "event_id") == 0, "?").otherwise("Network"),
        "auth_orientation": F.when(_draw(seed, "orientation", 5, "event_id") == 0, "LogOff").otherwise("LogOn"),
        "success_failure": F.when(_draw(seed, "fail", 40, "event_id") == 0, "Fail").otherwise("Success"),
    }
    normal = rows.select("event_id", *[of[c].alias(c) for c in RAW_AUTH])
    return normal.unionByName(_chains(spark, days, users, hosts, days * per_day, seed))


def _chains(spark: SparkSession, days: int, users: int, hosts: int, first_id: int, seed: int) -> DataFrame:
    """A campaign every other day: one account goes on from host to host at night, ten minutes apart."""
    steps = spark.range(max(1, days // 2) * 6).select(F.floor(F.col("id") / 6).alias("k"), (F.col("id") % 6).alias("step"), "id")
    host = lambda step: F.concat(F.lit("C"), F.pmod(F.xxhash64(F.lit(seed), F.lit("chain"), "k", step), F.lit(hosts)).cast("string"))
    account = F.concat(F.lit("U"), _draw(seed, "victim", users, "k").cast("string"), F.lit("@DOM1"))
    time = (F.col("k") * 2 + 1) * SECONDS_PER_DAY + 7_200 + F.col("step") * 600
    fixed = {"auth_type": "NTLM", "logon_type": "Network", "auth_orientation": "LogOn", "success_failure": "Success"}
    of = {"time": time.cast("string"), "src_user_at_domain": account, "dst_user_at_domain": account, "src_computer": host(F.col("step")), "dst_computer": host(F.col("step") + 1)}
    return steps.select((F.col("id") + first_id).alias("event_id"), *[(of[c] if c in of else F.lit(fixed[c])).alias(c) for c in RAW_AUTH])


def demo_redteam(log: DataFrame) -> DataFrame:
    """The list of intrusions that belongs to demo_log."""
    chain = log.filter(F.col("auth_type") == "NTLM")
    return chain.select("time", F.col("src_user_at_domain").alias("user_at_domain"), "src_computer", "dst_computer").select(*RAW_REDTEAM)

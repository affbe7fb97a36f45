"""Exact-match labels and campaigns of intrusions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.schema import LABEL_KEY, SECONDS_PER_HOUR


def group_into_campaigns(redteam: DataFrame, gap_hours: float = 24.0, keys: tuple[str, ...] = ("user", "domain")) -> DataFrame:
    """redteam with `campaign`: an account's intrusions split where the gap exceeds gap_hours (an equal gap does not split)."""
    w = Window.partitionBy(*keys).orderBy("time", "src_computer", "dst_computer")
    starts = F.coalesce((F.col("time") - F.lag("time").over(w) > gap_hours * SECONDS_PER_HOUR).cast("int"), F.lit(1))
    marked = redteam.withColumn("starts", starts)
    local = F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("campaign", F.concat_ws("#", *keys, local.cast("string"))).drop("starts")


def numbered_campaigns(campaigns: DataFrame) -> DataFrame:
    """campaigns with campaign_id, the rank of the campaign's name. One row a campaign meets in the ranking window."""
    names = campaigns.select("campaign").distinct().withColumn("campaign_id", F.dense_rank().over(Window.orderBy("campaign")).cast("bigint"))
    return campaigns.join(names, "campaign")


def label_events(events: DataFrame, campaigns: DataFrame) -> DataFrame:
    """events with is_malicious and campaign by equality on the five-part key.

    The intrusion list has no bound of its own here, so the join side is left to the planner: it broadcasts
    a list below its size limit and shuffles a larger one. Repeated keys of the list count once.
    """
    names = {"user": "src_user", "domain": "src_domain"}
    side = campaigns.select(*[F.col(c).alias(names.get(c, c)) for c in ("time", "user", "domain", "src_computer", "dst_computer")], "campaign")
    side = side.groupBy(*LABEL_KEY).agg(F.min("campaign").alias("campaign")).withColumn("hit", F.lit(True))
    joined = events.join(side, list(LABEL_KEY), "left")
    return joined.withColumn("is_malicious", F.coalesce("hit", F.lit(False))).drop("hit")


def campaign_summary(campaigns: DataFrame) -> DataFrame:
    return campaigns.groupBy("campaign").agg(
        F.min("user").alias("user"), F.count(F.lit(1)).alias("n_events"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), (F.max("time") - F.min("time")).alias("duration")
    )


def labeling_report(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("n_events"), F.count_if("is_malicious").alias("n_matched"), F.round(F.avg(F.col("is_malicious").cast("double")), 9).alias("positive_rate"))


def split_summary(events: DataFrame) -> DataFrame:
    """Positives in total, by source host and by day, in one aggregation with grouping sets."""
    positives = events.filter("is_malicious")
    sets = positives.groupingSets([[], ["src_computer"], ["day"]], "src_computer", "day").agg(F.grouping_id("src_computer", "day").alias("gid"), F.count(F.lit(1)).alias("positives"))
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "source").otherwise("day")
    return sets.select(level.alias("level"), F.coalesce("src_computer", F.lit("")).alias("src_computer"), F.coalesce("day", F.lit(-1)).alias("day"), "positives")


def top_source_share(events: DataFrame) -> DataFrame:
    """(src_computer, positives, share): the source host with most positives, the first of equals by name."""
    counts = events.filter("is_malicious").groupBy("src_computer").agg(F.count(F.lit(1)).alias("positives"))
    total = F.sum("positives").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.round(F.col("positives") / total, 9)).orderBy(F.col("positives").desc(), "src_computer").limit(1)


def positive_rate_ok(events: DataFrame, low: float, high: float) -> DataFrame:
    """Whether the share of positives lies within the bounds; the caller stops the run where it does not."""
    rate = F.avg(F.col("is_malicious").cast("double"))
    return events.agg(F.round(rate, 9).alias("positive_rate"), rate.between(low, high).alias("within"))

"""Features of a few days at a time with carried state, as a fold over days and as a stream.

The state holds, for each relation of the novelty features, how often each key was seen and when last; for each
account the sums of its time-of-day vectors and its last event; and the events of the day before, which the rolling
windows reach back to. A day's features depend on the state and on the day's own events, and equal those of the
whole log.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions import features as ft
from logweir.operators import causal
from logweir.schema import SECONDS_PER_DAY
from logweir.sources.shared import shared_dir, written

#: What later days need of an event.
KEPT = ("event_id", "time", "day", "src_user", "src_computer", "dst_computer", "success", "_pair_new")


@dataclass
class FeatureState:
    """Carried tables: seen[relation] (keys, seen, last_time); profile (src_user, sin, cos, last_time, last_dst); recent (events of the last day)."""

    seen: dict[str, DataFrame]
    profile: DataFrame
    recent: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "FeatureState":
        keys = {r: ", ".join(f"{k} string" for k in ks) for r, (ks, _) in ft.RELATIONS.items()}
        seen = {r: spark.createDataFrame([], f"{k}, seen bigint, last_time int") for r, k in keys.items()}
        profile = spark.createDataFrame([], "src_user string, sin double, cos double, last_time int, last_dst string")
        return FeatureState(seen, profile, spark.createDataFrame([], "event_id bigint, time int, day int, src_user string, src_computer string, dst_computer string, success boolean, _pair_new bigint"))

    def tables(self) -> dict[str, DataFrame]:
        return {**{f"seen_{r}": t for r, t in self.seen.items()}, "profile": self.profile, "recent": self.recent}

    @staticmethod
    def of(tables: dict[str, DataFrame]) -> "FeatureState":
        return FeatureState({r: tables[f"seen_{r}"] for r in ft.RELATIONS}, tables["profile"], tables["recent"])

    def write(self, path: str) -> None:
        for name, table in self.tables().items():
            table.write.parquet(f"{path}/{name}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> "FeatureState":
        names = [*(f"seen_{r}" for r in ft.RELATIONS), "profile", "recent"]
        return FeatureState.of({n: spark.read.parquet(f"{path}/{n}") for n in names})


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left joined on keys that may be null; right's keys are left out."""
    side = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(side, on, how).drop(*[f"_r_{k}" for k in keys])


def _novelty(events: DataFrame, state: FeatureState) -> DataFrame:
    rows = events
    for name, (keys, condition) in ft.RELATIONS.items():
        seen = state.seen[name]
        w = causal.in_order(keys)
        rows = _null_safe(rows, seen, keys).withColumns({"_k": F.coalesce("seen", F.lit(0)) + F.row_number().over(w) - 1, "_since": F.col("time") - F.coalesce(F.lag("time").over(w), F.col("last_time"))})
        # events of the entity, or all, before the day: those of the state and those of earlier days here
        within = causal.events_before_day(events, condition).withColumnRenamed("before", "_within")
        if condition:
            carried = seen.groupBy(*condition).agg(F.sum("seen").alias("_n"))
            rows = _null_safe(_null_safe(rows, within, [*condition, "day"]), carried, condition)
        else:
            total = seen.agg(F.sum("seen")).first()[0] or 0
            rows = _null_safe(rows, within, ["day"]).withColumn("_n", F.lit(total))
        rows = rows.withColumn("_n", F.coalesce("_n", F.lit(0)) + F.coalesce("_within", F.lit(0))).drop("_within")
        rows = rows.withColumns({f"{name}_is_new": (F.col("_k") == 0).cast("int"), ft.rarity_name(name): ft.rarity(F.col("_k"), F.col("_n").cast("double"))})
        if name == "pair":
            rows = rows.withColumn("days_since_pair_last_seen", F.coalesce(F.col("_since") / SECONDS_PER_DAY, F.lit(ft.INFINITY)))
        rows = rows.drop("seen", "last_time", "_n", "_k", "_since")
    return rows


def _temporal(rows: DataFrame, state: FeatureState, night: tuple[int, int]) -> DataFrame:
    w = causal.in_order("src_user")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"hour_sin": F.sin(ft.hour_angle()), "hour_cos": F.cos(ft.hour_angle()), "is_night": ft.in_night(*night).cast("int")})
    rows = _null_safe(rows, state.profile, ["src_user"])
    sums = {c: F.coalesce(f"{c}", F.lit(0.0)) + F.coalesce(F.sum(f"hour_{c}").over(past), F.lit(0.0)) for c in ("sin", "cos")}
    profile = F.atan2(sums["sin"], sums["cos"])
    deviation = F.abs(F.pmod(ft.hour_angle() - profile + ft.math.pi, F.lit(2 * ft.math.pi)) - ft.math.pi)
    first = F.coalesce(F.lag("time").over(w), F.col("last_time")).isNull()
    gap = F.col("time") - F.coalesce(F.lag("time").over(w), F.col("last_time"))
    came = F.coalesce(F.when(F.lag("time").over(w).isNull(), F.col("last_dst")), F.lag("dst_computer").over(w))
    return rows.withColumns(
        {
            "hour_deviation_from_profile": F.when(first, F.lit(0.0)).otherwise(deviation),
            "hours_since_prev_event_same_user": F.coalesce(gap / 3600, F.lit(ft.INFINITY)),
            "prev_dst_is_src": F.coalesce(came == F.col("src_computer"), F.lit(False)).cast("int"),
        }
    ).drop("sin", "cos", "last_time", "last_dst")


def _windows(rows: DataFrame, state: FeatureState) -> DataFrame:
    """Rolling features over these days and the one before them; `rows` need pair_is_new."""
    today = rows.select("event_id", "time", "day", "src_user", "src_computer", "dst_computer", "success", F.col("pair_is_new").cast("bigint").alias("_pair_new"), F.lit(True).alias("_today"))
    both = today.unionByName(state.recent.withColumn("_today", F.lit(False)))
    both = ft.history_features(both)
    for entity, name in ft.NEW_PAIRS.items():
        both = causal.rolling_sum(both, entity, SECONDS_PER_DAY, F.col("_pair_new"), name)
    made = [c for c in both.columns if c not in today.columns]
    return rows.join(both.filter("_today").select("event_id", *made), "event_id")


def featurize_days(events: DataFrame, state: FeatureState, last_day: int, train: DataFrame | None = None, night: tuple[int, int] = (0, 21_600)) -> tuple[DataFrame, FeatureState]:
    """(features F1 to F4 of the events of one or more days up to last_day, all later than the state; the state after them). Without training rows, F1 is left out."""
    rows = _windows(_temporal(_novelty(events, state), state, night), state)
    after = {}
    for name, (keys, _) in ft.RELATIONS.items():
        today = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen"), F.max("time").alias("last_time"))
        after[name] = state.seen[name].unionByName(today).groupBy(*keys).agg(F.sum("seen").alias("seen"), F.max("last_time").alias("last_time"))
    last = F.max_by(F.struct("time", "dst_computer"), F.struct("time", "event_id"))
    today = events.groupBy("src_user").agg(F.sum(F.sin(ft.hour_angle())).alias("sin"), F.sum(F.cos(ft.hour_angle())).alias("cos"), last.alias("l"))
    today = today.select("src_user", "sin", "cos", F.col("l.time").alias("last_time"), F.col("l.dst_computer").alias("last_dst"))
    profile = state.profile.unionByName(today).groupBy("src_user").agg(F.sum("sin").alias("sin"), F.sum("cos").alias("cos"), F.max("last_time").alias("last_time"), F.max_by("last_dst", "last_time").alias("last_dst"))
    pair = state.seen["pair"].select(*ft.RELATIONS["pair"][0], F.lit(1).alias("_old"))
    fresh = _null_safe(events, pair, ft.RELATIONS["pair"][0]).withColumn("_pair_new", (F.col("_old").isNull() & (F.row_number().over(causal.in_order(ft.RELATIONS["pair"][0])) == 1)).cast("bigint"))
    if train is not None:
        rows = ft.event_features(rows, train)
    return rows, FeatureState(after, profile, fresh.filter(F.col("day") == last_day).select(*KEPT))


def fold_days(events: DataFrame, train: DataFrame | None = None, step: int = 10) -> DataFrame:
    """Features of all days, `step` days at a time, each from the carried state. Features and state are written after each step, so no plan grows."""
    spark = events.sparkSession
    path = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    state, parts = FeatureState.empty(spark), []
    events = written(events, "fold")
    days = sorted(d for (d,) in events.select("day").distinct().collect())  # one row a day
    for i in range(0, len(days), step):
        first, last = days[i], days[i : i + step][-1]
        found, state = featurize_days(events.filter(F.col("day").between(first, last)), state, last, train)
        found.write.parquet(f"{path}/{first}")
        parts.append(f"{path}/{first}")
        if last != days[-1]:
            state.write(f"{path}/state-{last}")
            state = FeatureState.read(spark, f"{path}/state-{last}")
    return spark.read.parquet(*parts) if parts else featurize_days(events, state, 0, train)[0]


class DailyStream:
    """Feeds the days of a stream of events to featurize_days, with the state as Parquet tables in `folder`.

    Each finished micro-batch is entered in `folder`/batches with its last day and the place of the state after
    it, in one write. A new instance goes on from the last entry, so a restart loses nothing. A micro-batch that
    Spark sends again after a failure finds itself entered and is passed over. A micro-batch closes its days:
    rows of them that come later are refused, or with late="drop" written to `folder`/late.
    """

    def __init__(self, folder: str, late: str = "refuse"):
        self.folder, self.late = folder, late

    def entries(self, spark: SparkSession) -> list:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batches")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return spark.read.parquet(f"{self.folder}/batches").orderBy("day").collect()  # one row a micro-batch

    def batch(self, events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        done = self.entries(spark)
        if any(r["batch"] == batch_id for r in done):
            return
        last = done[-1]["day"] if done else None
        if last is not None:
            old = events.filter(F.col("day") <= last)
            if self.late == "drop":
                old.write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
            elif not old.isEmpty():
                raise ValueError(f"rows of day {last} or before came after it was closed")
            events = events.filter(F.col("day") > last)
        newest = events.agg(F.max("day")).first()[0]
        if newest is None:
            return
        state = FeatureState.read(spark, done[-1]["state"]) if done else FeatureState.empty(spark)
        found, state = featurize_days(events, state, newest)
        found.write.mode("overwrite").parquet(f"{self.folder}/features/batch={batch_id}")
        place = f"{self.folder}/state/{newest}-{uuid.uuid4().hex[:8]}"
        state.write(place)
        spark.createDataFrame([(newest, batch_id, place)], "day int, batch long, state string").coalesce(1).write.mode("append").parquet(f"{self.folder}/batches")

    def late_rows(self, spark: SparkSession) -> int:
        """Rows left out because their days were closed."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/late")
        return spark.read.parquet(f"{self.folder}/late").count() if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else 0

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Processes all that is available and stops."""
        query = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def ingest(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of raw text lines, as files arrive in `folder`, typed like the batch source."""
    return spark.readStream.schema(schema).option("header", False).csv(folder)


def windowed_counts(stream: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events and failures by event-time window, tumbling or sliding; rows later than the watermark are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(window).agg(F.count(F.lit(1)).alias("events"), F.count_if(~F.col("success")).alias("failures"))


def sessions(stream: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions of each account: its events with less than the gap between them."""
    return stream.withWatermark("ts", gap).groupBy("src_user", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n_events"))

"""The stages of a run, each from stored tables to stored tables."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import explain
from logweir.functions import features as ft
from logweir.functions import scorers as sc
from logweir.functions import tuning
from logweir.operators import clean, label, split, summary
from logweir.operators import evaluate as ev
from logweir.operators import resample as rs
from logweir.sources import raw, sinks
from logweir.sources.shared import written


CAMPAIGNS = "time int, user string, domain string, campaign string"


@dataclass(frozen=True)
class Config:
    """Settings of a run. Days are inclusive."""

    train: tuple[int, int] = (0, 19)
    val: tuple[int, int] = (20, 24)
    test: tuple[int, int] = (25, 29)
    universe: str = "all"
    regime: str = "R1"
    history: str = "cumulative"
    warmup_days: int = 2
    gap_hours: float = 24.0
    candidates: int = 20
    seed: int = 0

    def check(self) -> "Config":
        split.ranges_in_seconds({"train": self.train, "val": self.val, "test": self.test})
        for name, value, allowed in (("history", self.history, ("window", "cumulative")), ("regime", self.regime, ("R1", "R2")), ("universe", self.universe, ("all", "remote_logon", "remote_logon_user"))):
            if value not in allowed:
                raise ValueError(f"{name} {value!r} is not one of {allowed}")
        return self

    def version(self) -> str:
        """Name of the feature store of these settings."""
        return split.store_version(asdict(self))


def to_parquet(spark: SparkSession, source: str, out: str, days: tuple[int, int] | None = None, overwrite: bool = False) -> raw.ConversionReport:
    """Raw text, plain or gzip, to typed Parquet in day= folders. Rows are numbered in the order of the files' lines."""
    lines = raw.read_raw(spark, source).withColumn("line", F.monotonically_increasing_id())
    return raw.write_by_day(lines, out, "line", days, overwrite)


def build_features(spark: SparkSession, interim: str, redteam: str, out: str, config: Config) -> str:
    """Labelled features of all days of the splits, in a folder named by the settings, by day. Returns the folder."""
    config.check()
    campaigns = label.group_into_campaigns(clean.clean_redteam(raw.read_redteam(spark, redteam)), config.gap_hours)
    events = split.universe(label.label_events(spark.read.parquet(interim), campaigns), config.universe)
    train = split.by_days(events, *config.train)
    store = ft.feature_store(events, train, config.train[0], config.test[1], config.history, config.warmup_days)
    path = f"{out}/{config.version()}"
    store.write.mode("overwrite").partitionBy("day").parquet(path)
    sinks.write_csv(campaigns.select("time", "user", "domain", "campaign"), f"{path}-campaigns")
    return path


def train_eval(spark: SparkSession, store: str, out: str, config: Config, models: list[str] | None = None, rounds: int = 1000) -> DataFrame:
    """Fits, tunes and evaluates models on a feature store. Writes every model's summary, ledger and cards, and comparisons; returns (model, metric, budget, value)."""
    config.check()
    rows = spark.read.parquet(store)
    split.verify_temporal_order(split.with_split(rows, {"train": config.train, "val": config.val, "test": config.test}))
    train = written(split.regime_train(split.by_days(rows, *config.train), config.regime), "train")
    val, test = written(split.by_days(rows, *config.val), "val"), written(split.by_days(rows, *config.test), "test")
    campaigns = sinks.read_csv(spark, f"{store}-campaigns", CAMPAIGNS)
    catalog = sc.catalog(ft.model_columns())
    wanted = {n: m for n, m in catalog.items() if models is None or n in models}
    if models is None or "m1_rules" in models:
        wanted = {"m1_rules": tuning.tune_rules(train, val, config.candidates, config.seed)[0], **wanted} if not val.filter("is_malicious").isEmpty() else wanted
    days = [r[0] for r in test.select("day").distinct().collect()]  # one row a day
    tracker, out_rows, levels = sinks.Tracker(spark, f"{out}/runs"), None, {}
    tracker.log("config", **asdict(config))
    for name, model in wanted.items():
        by_rules = isinstance(model, sc.Rules)
        fitted = model if name == "m1_rules" else model.fit(train if by_rules else ft.numeric(train))
        scored = written(fitted.score(test if by_rules else ft.numeric(test)).select("event_id", "time", "day", "is_malicious", "campaign", "src_user", "src_computer", "dst_computer", "score"), name)
        summary.require_scores(scored, days)
        found = summary.evaluate_model(scored).withColumn("model", F.lit(name)).select("model", "metric", "budget", "value")
        out_rows = found if out_rows is None else out_rows.unionByName(found)
        summary.write_ledger_outputs(scored, campaigns, f"{out}/{name}")
        explain.alert_cards(scored, 3).write.mode("overwrite").parquet(f"{out}/{name}/cards")
        levels[name] = resampling_table(scored)
        tracker.log("model", name=name)
    result = written(out_rows, "results")
    result.coalesce(1).write.mode("overwrite").parquet(f"{out}/results")
    compared = compare(levels, rounds, config.seed)
    sinks.write_json(spark.createDataFrame([(c.better, c.worse, float(c.difference), float(c.p), float(c.adjusted), c.sentence()) for c in compared], "better string, worse string, difference double, p double, adjusted double, sentence string"), f"{out}/comparisons")
    return result


def resampling_table(scored: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(event ids, levels and campaigns of the positives, benign rows at each level): the positives and the bins between their scores, highest first."""
    bins = ev.benign_bins(scored).orderBy(F.col("score_floor").desc()).toPandas()  # one row a distinct score of positives
    pos = scored.filter("is_malicious").select("event_id", "score", "campaign").orderBy("event_id").toPandas()
    at = {v: i for i, v in enumerate(bins["score_floor"])}
    return pos["event_id"].to_numpy(), pos["score"].map(at).to_numpy(), pos["campaign"].to_numpy(), bins["benign"].to_numpy()


def compare(levels: dict, rounds: int, seed: int) -> list[summary.Comparison]:
    campaigns = next(iter(levels.values()))[2] if levels else ()
    if len(levels) < 2 or len(set(campaigns)) < 2:
        return []
    samples = rs.paired_bootstrap({n: x[1] for n, x in levels.items()}, {n: x[3] for n, x in levels.items()}, campaigns, rounds, seed)
    estimates = {n: rs.average_precision(np.bincount(x[1], minlength=len(x[3])), x[3]) for n, x in levels.items()}
    pairs = len(levels) * (len(levels) - 1) // 2
    return summary.pairwise_comparisons(samples, estimates) if rounds >= rs.minimum_resamples(pairs) else []

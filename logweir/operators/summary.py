"""Everything reported of one model on one split, comparisons of models, and the files of a run."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.operators import evaluate as ev
from logweir.operators import resample as rs
from logweir.sources import sinks
from logweir.sources.shared import written


class ScoreError(ValueError):
    """Scores that cannot be evaluated."""


def check_scores(scored: DataFrame, days: list[int], score: str = "score") -> DataFrame:
    """(rows, duplicate_ids, missing_scores, missing_days) of a scored split, in one pass and one count of repeated ids."""
    expected = F.array(*[F.lit(d) for d in days])
    bad = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    whole = scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("missing_scores"), F.size(F.array_except(expected, F.collect_set("day"))).cast("bigint").alias("missing_days"))
    repeated = scored.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"))
    return whole.join(F.broadcast(repeated)).select("rows", "duplicate_ids", "missing_scores", "missing_days")  # one row each


def require_scores(scored: DataFrame, days: list[int], score: str = "score") -> DataFrame:
    row = check_scores(scored, days, score).first()
    if row["duplicate_ids"] or row["missing_scores"] or row["missing_days"]:
        raise ScoreError(f"scores cannot be evaluated: {row.asDict()}")
    return scored


def require_row_local(score, df: DataFrame, column: str = "score") -> None:
    """Scores of a model must not depend on the batch: the rows of half of the table score alike, bit for bit, alone and with the others."""
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    whole = score(df).filter(half).select("event_id", F.col(column).alias("a"))
    alone = score(df.filter(half)).select("event_id", F.col(column).alias("b"))
    if not whole.join(alone, "event_id").filter(~F.col("a").eqNullSafe(F.col("b"))).isEmpty():
        raise ScoreError("a row's score depends on other rows")


def evaluate_model(scored: DataFrame, budgets=ev.BUDGETS, fpr: float = 0.01) -> DataFrame:
    """(metric, budget, value) of a scored split: ranking metrics, recall and delay by budget, ties and resolution. Without both classes the ranking metrics are null."""
    scored = written(scored.select("event_id", "time", "day", "is_malicious", "campaign", "score"), "scored")
    ledger = written(ev.positives_ledger(scored), "ledger")
    value = lambda df, names, budget=None: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(budget).cast("int").alias("budget"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    ranking = ev.ranking_metrics(ev.score_levels(scored), fpr)
    out = value(ranking, ranking.columns).unionByName(value(ev.campaign_weighted_ap(scored), ["weighted_ap"])).unionByName(value(ev.score_resolution(scored), ["least_distinct", "largest_tie_share"]))
    out = out.unionByName(value(ledger.agg(F.min("rank").alias("first_detection")), ["first_detection"]))
    curve = ev.budget_curve(ledger, budgets)
    for n in ("event_recall", "campaign_recall"):
        out = out.unionByName(curve.select(F.lit(n).alias("metric"), F.col("budget").cast("int").alias("budget"), F.col(n).alias("value")))
    delays = ledger.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    delays = delays.groupBy("budget", "campaign").agg((F.min(F.when(F.col("rank") <= F.col("budget"), F.col("time"))) - F.min("time")).alias("delay"))
    delays = delays.groupBy("budget").agg(F.avg("delay").alias("mean_delay"), F.max("delay").cast("double").alias("longest_delay"))
    for n in ("mean_delay", "longest_delay"):
        out = out.unionByName(delays.select(F.lit(n).alias("metric"), F.col("budget").cast("int").alias("budget"), F.col(n).alias("value")))
    return out.select("metric", "budget", F.round("value", 9).alias("value"))


@dataclass(frozen=True)
class Comparison:
    better: str
    worse: str
    difference: float
    p: float
    floor: bool
    adjusted: float

    def sentence(self, alpha: float = 0.05) -> str:
        return rs.render_comparison(self.better, self.worse, self.adjusted, self.floor, alpha)


def pairwise_comparisons(samples: dict[str, np.ndarray], estimates: dict[str, float], alpha: float = 0.05) -> list[Comparison]:
    """All pairs of models on the same resamples, the better one first, with p values adjusted by Holm's method. Fewer resamples than the family needs are refused."""
    names = sorted(samples)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    rounds = min((len(s) for s in samples.values()), default=0)
    if pairs and rounds < rs.minimum_resamples(len(pairs), alpha):
        raise ValueError(f"{rounds} resamples cannot decide {len(pairs)} comparisons")
    found = []
    for a, b in pairs:
        better, worse = (a, b) if estimates[a] >= estimates[b] else (b, a)
        p, floor = rs.p_value(samples[better] - samples[worse])
        found.append((better, worse, estimates[better] - estimates[worse], p, floor))
    found.sort(key=lambda x: (x[3], x[0], x[1]))
    out, most = [], 0.0
    for i, (better, worse, difference, p, floor) in enumerate(found):
        most = max(most, min(1.0, (len(found) - i) * p))
        out.append(Comparison(better, worse, difference, p, floor, most))
    return out


def with_campaign_users(ledger: DataFrame, campaigns: DataFrame) -> DataFrame:
    """ledger with the account of each event's campaign, null where the campaign is not listed."""
    users = campaigns.groupBy("campaign").agg(F.min("user").alias("user"))
    return ledger.join(users, "campaign", "left")


def summary_record(budgets: DataFrame, most: int = 1000) -> DataFrame:
    """(campaigns, median_budget, log_area, within_100): one row on the detection budgets of campaigns."""
    area = ev.log_area(budgets, most)
    median = ev.budget_quantiles(budgets, (0.5,)).select(F.col("budget").alias("median_budget"))
    near = budgets.agg(F.round(F.avg((F.col("budget") <= 100).cast("double")), 9).alias("within_100"))
    return area.join(F.broadcast(median)).join(F.broadcast(near)).select("campaigns", "median_budget", "log_area", "within_100")  # one row each


def write_ledger_outputs(scored: DataFrame, campaigns: DataFrame, folder: str) -> None:
    """The files of a run: ledger with accounts, campaign summary, day sizes, detection budgets (CSV) and the summary (JSON)."""
    ledger = written(ev.positives_ledger(scored), "ledger")
    budgets = ev.detection_budgets(ledger)
    sinks.write_csv(with_campaign_users(ledger, campaigns), f"{folder}/ledger")
    sinks.write_csv(campaigns.groupBy("campaign").agg(F.min("user").alias("user"), F.count(F.lit(1)).alias("n_events"), F.min("time").alias("first_time"), F.max("time").alias("last_time")), f"{folder}/campaigns")
    sinks.write_csv(ev.day_sizes(scored), f"{folder}/day_sizes")
    sinks.write_csv(budgets, f"{folder}/detection_budgets")
    sinks.write_json(summary_record(budgets), f"{folder}/summary")


def resample_summaries(ledger_rows: list[tuple[str, int]], rounds: int = 1000, seed: int = 0, most: int = 1000) -> dict[str, tuple[float, float]]:
    """95 % intervals of the median budget and the log area with whole accounts drawn again: (account, smallest rank of a campaign), one row a campaign."""
    accounts = sorted({a for a, _ in ledger_rows})
    if len(accounts) < 2:
        raise ValueError("fewer than two accounts")
    by = [np.array([b for a, b in ledger_rows if a == x], float) for x in accounts]
    random = np.random.default_rng(seed)
    medians, areas = [], []
    for _ in range(rounds):
        b = np.concatenate([by[i] for i in random.integers(0, len(by), len(by))])
        medians.append(float(np.sort(b)[max(0, int(np.ceil(0.5 * len(b))) - 1)]))
        areas.append(float(np.maximum(0, np.log(most / b) / np.log(most)).mean()))
    return {n: (float(np.quantile(v, 0.025)), float(np.quantile(v, 0.975))) for n, v in (("median_budget", medians), ("log_area", areas))}


def degenerate_checks(spark) -> DataFrame:
    """(case, average_precision, roc_auc): metrics of scores whose values are known: perfect, reversed and constant."""
    cases = {"perfect": lambda i: float(i), "reversed": lambda i: -float(i), "constant": lambda i: 0.0}
    out = None
    for name, f in cases.items():
        rows = spark.createDataFrame([(i, f(i), i >= 8) for i in range(10)], "event_id long, score double, is_malicious boolean")
        got = ev.ranking_metrics(ev.score_levels(rows)).select(F.lit(name).alias("case"), "average_precision", "roc_auc")
        out = got if out is None else out.unionByName(got)
    return out

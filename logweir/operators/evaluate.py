"""Ranking by daily alert budget, with explicit label-free ties, and ranking metrics from score-level counts.

Scored rows have event_id, time, day, is_malicious, campaign (null for benign rows) and score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.ordered import running_before
from logweir.schema import SECONDS_PER_DAY
from logweir.sources.shared import written

BUDGETS = (10, 50, 100, 500)


def queue(score: str = "score"):
    """The analyst's queue of a day: score descending, then time, then event_id."""
    return Window.partitionBy("day").orderBy(F.col(score).desc(), "time", "event_id")


def ranked(scored: DataFrame, score: str = "score") -> DataFrame:
    """scored with rank, rank_best and rank_worst (bounds over the orders of equal scores) and rank_against (positives last among equals)."""
    ties = Window.partitionBy("day").orderBy(F.col(score).desc())
    equal = F.count(F.lit(1)).over(Window.partitionBy("day", score))
    against = Window.partitionBy("day").orderBy(F.col(score).desc(), "is_malicious", "time", "event_id")
    best = F.rank().over(ties)
    return scored.withColumns({"rank": F.row_number().over(queue(score)), "rank_best": best, "rank_worst": (best + equal - 1).cast("int"), "rank_against": F.row_number().over(against)})


def alerts_at_budget(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The first k of each day's queue; the filter on the rank reaches the window as a group limit."""
    return scored.withColumn("rank", F.row_number().over(queue(score))).filter(F.col("rank") <= k)


def positives_ledger(scored: DataFrame, score: str = "score") -> DataFrame:
    return ranked(scored, score).filter("is_malicious").select("event_id", "campaign", "day", "time", "rank", "rank_best", "rank_worst", "rank_against")


def budget_curve(ledger: DataFrame, budgets=BUDGETS, rank: str = "rank") -> DataFrame:
    """(budget, event_recall, campaign_recall)."""
    each = ledger.withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets])))
    hit = F.col(rank) <= F.col("budget")
    return each.groupBy("budget").agg(
        F.round(F.avg(hit.cast("double")), 9).alias("event_recall"),
        F.round(F.count_distinct(F.when(hit, F.col("campaign"))) / F.count_distinct("campaign"), 9).alias("campaign_recall"),
    )


def tie_exposure(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    """(days, contested_slots, contenders): days on which equal scores straddle the budget."""
    at = alerts_at_budget(scored, k, score).groupBy("day").agg(F.min(score).alias("cut"), F.count(F.lit(1)).alias("taken"))
    sizes = scored.groupBy("day", F.col(score).alias("cut")).agg(F.count(F.lit(1)).alias("tied"))
    above = alerts_at_budget(scored, k, score).groupBy("day", F.col(score).alias("cut")).agg(F.count(F.lit(1)).alias("slots"))
    joined = at.filter(F.col("taken") == k).join(sizes, ["day", "cut"]).join(above, ["day", "cut"]).filter("tied > slots")
    return joined.agg(F.count(F.lit(1)).alias("days"), F.coalesce(F.sum("slots"), F.lit(0)).alias("contested_slots"), F.coalesce(F.sum("tied"), F.lit(0)).alias("contenders"))


def detection_budgets(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("campaign").agg(F.min("rank").alias("budget"), F.min("rank_best").alias("best"), F.min("rank_worst").alias("worst"))


def budget_quantiles(budgets: DataFrame, quantiles=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(quantile, budget): the value of index ceil(q n) in ascending order. The window sees one row a campaign."""
    numbered = budgets.withColumn("i", F.row_number().over(Window.orderBy("budget", "campaign"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    each = numbered.withColumn("quantile", F.explode(F.array(*[F.lit(q) for q in quantiles])))
    return each.filter(F.col("i") == F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("n")))).select("quantile", "budget")


def log_area(budgets: DataFrame, most: int) -> DataFrame:
    """Mean over campaigns of ln(most / budget) / ln(most), 0 beyond most."""
    part = F.greatest(F.lit(0.0), F.ln(F.lit(float(most)) / F.col("budget")) / F.ln(F.lit(float(most))))
    return budgets.agg(F.round(F.avg(part), 9).alias("log_area"), F.count(F.lit(1)).alias("campaigns"))


def time_to_detection(ledger: DataFrame, k: int) -> DataFrame:
    """(campaign, delay): seconds from the campaign's first event to its first alert; null if it has none."""
    return ledger.groupBy("campaign").agg((F.min(F.when(F.col("rank") <= k, F.col("time"))) - F.min("time")).alias("delay"))


def day_sizes(scored: DataFrame) -> DataFrame:
    return scored.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_malicious").alias("positives"))


def random_survival(days: DataFrame, budget: int) -> DataFrame:
    """Probability that a random order finds no positive in the first `budget` of any day: product of C(N - b, p) / C(N, p)."""
    usable = days.filter("positives > 0")
    short = F.col("events") - F.col("positives") < budget
    terms = F.aggregate(F.sequence(F.lit(0), F.col("positives").cast("int") - 1), F.lit(0.0), lambda acc, i: acc + F.log1p(-F.lit(float(budget)) / (F.col("events") - i)))
    each = usable.select(F.when(short, F.lit(float("-inf"))).otherwise(terms).alias("t"))
    return each.agg(F.round(F.exp(F.sum("t")), 9).alias("survival"))


def score_levels(scored: DataFrame, score: str = "score") -> DataFrame:
    """(score, pos, neg, pos_above, neg_above): counts at each score and above it.

    Counts are stored once, so that what made the scores runs once, and ordered in ranges.
    """
    levels = scored.groupBy(F.col(score).alias("score")).agg(F.count_if("is_malicious").alias("pos"), F.count_if(~F.col("is_malicious")).alias("neg"))
    return running_before(written(levels, "levels"), "score", {"pos_above": "pos", "neg_above": "neg"}, descending=True)


def ranking_metrics(levels: DataFrame, fpr: float = 0.01) -> DataFrame:
    """Average precision, ROC-AUC with half ties, share of tied pairs, and recall at a false-positive rate, all from score levels."""
    totals = levels.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    p, n = F.lit(float(totals["p"] or 0)), F.lit(float(totals["n"] or 0))
    ctp, cfp = F.col("pos_above") + F.col("pos"), F.col("neg_above") + F.col("neg")
    return levels.agg(
        F.round(F.sum(F.col("pos") / p * ctp / (ctp + cfp)), 9).alias("average_precision"),
        F.round(F.sum(F.col("pos") * (n - cfp + 0.5 * F.col("neg"))) / (p * n), 9).alias("roc_auc"),
        F.round(F.sum(F.col("pos") * F.col("neg")) / (p * n), 9).alias("tied_pair_fraction"),
        F.round(F.max(F.when(cfp <= fpr * n, ctp / p).otherwise(F.lit(0.0))), 9).alias("recall_at_fpr"),
    )


def campaign_weighted_ap(scored: DataFrame, score: str = "score") -> DataFrame:
    """Average precision in which each campaign weighs the same, shared by its events."""
    sizes = scored.filter("is_malicious").groupBy("campaign").agg(F.count(F.lit(1)).alias("size"))
    at = scored.filter("is_malicious").groupBy("campaign", F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n")).join(sizes, "campaign")
    weights = at.groupBy("score").agg(F.sum(F.col("n") / F.col("size")).alias("w"))
    counts = scored.groupBy(F.col(score).alias("score")).agg(F.count_if(~F.col("is_malicious")).alias("neg"))
    levels = written(counts.join(weights, "score", "left").withColumn("w", F.coalesce("w", F.lit(0.0))), "weighted")
    total = levels.agg(F.sum("w")).first()[0] or 1.0
    levels = running_before(levels, "score", {"w_above": "w", "neg_above": "neg"}, descending=True)
    here = F.col("w_above") + F.col("w")
    return levels.agg(F.round(F.sum(F.col("w") / total * here / (here + F.col("neg_above") + F.col("neg"))), 9).alias("weighted_ap"))


def precision_at(scored: DataFrame, k: int, score: str = "score") -> DataFrame:
    top = scored.orderBy(F.col(score).desc(), "time", "event_id").limit(k)
    return top.agg(F.round(F.avg(F.col("is_malicious").cast("double")), 9).alias("precision"))


def alert_threshold(calibration: DataFrame, k: int, n_days: int, score: str = "score") -> float:
    """The score of rank k * n_days on the calibration split; -inf if there are fewer rows."""
    n = k * n_days
    top = calibration.orderBy(F.col(score).desc(), "time", "event_id").limit(n).agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("t")).first()
    return float(top["t"]) if top["n"] == n else float("-inf")


def at_threshold(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    hit = F.col(score) >= F.lit(threshold)
    return scored.agg(
        F.count_if(hit).alias("alerts"),
        F.round(F.avg(F.when(F.col("is_malicious"), hit.cast("double"))), 9).alias("event_recall"),
        F.round(F.count_distinct(F.when(hit & F.col("is_malicious"), F.col("campaign"))) / F.count_distinct("campaign"), 9).alias("campaign_recall"),
    )


def unit_ledger(scored: DataFrame, unit: list[str], score: str = "score") -> DataFrame:
    """Rank of each day's units (a unit's score is the highest of its events), of those with a positive."""
    units = scored.groupBy("day", *unit).agg(F.max(score).alias("score"), F.min("time").alias("time"), F.max("is_malicious").alias("is_malicious"), F.min("campaign").alias("campaign"))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.col("score").desc(), "time", *unit))
    return units.withColumn("rank", rank).filter("is_malicious")


def user_day_activity(df: DataFrame, partner: str = "dst_computer") -> DataFrame:
    """Rank of user-days by distinct destinations, a baseline without a detector."""
    each = df.groupBy("day", "src_user").agg(F.count_distinct(partner).alias("n_distinct"), F.count(F.lit(1)).alias("n_events"), F.min("time").alias("first_time"), F.max("is_malicious").alias("is_malicious"))
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(F.col("n_distinct").desc(), "first_time", "src_user")))


def score_resolution(scored: DataFrame, score: str = "score") -> DataFrame:
    """(least_distinct, largest_tie_share): over days, the fewest distinct scores and the largest share of one score."""
    each = scored.groupBy("day", score).agg(F.count(F.lit(1)).alias("n")).groupBy("day").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("top"), F.sum("n").alias("n"))
    return each.agg(F.min("distinct").alias("least_distinct"), F.round(F.max(F.col("top") / F.col("n")), 9).alias("largest_tie_share"))


def benign_bins(scored: DataFrame, score: str = "score") -> DataFrame:
    """(score_floor, benign, pos): benign rows between consecutive distinct scores of positives, the counts that resampling needs. The window sees the positives' scores only."""
    marks = score_levels(scored, score).filter("pos > 0")
    w = Window.orderBy(F.col("score").desc())
    at_or_above = F.col("neg_above") + F.col("neg")
    return marks.select(F.col("score").alias("score_floor"), (at_or_above - F.coalesce(F.lag(at_or_above).over(w), F.lit(0))).alias("benign"), "pos")


def regrouped(ledger: DataFrame, gap_seconds: int, account: list[str]) -> DataFrame:
    """ledger with campaign by another gap between an account's positives."""
    w = Window.partitionBy(*account).orderBy("time", "event_id")
    starts = F.coalesce((F.col("time") - F.lag("time").over(w) > gap_seconds).cast("int"), F.lit(1))
    marked = ledger.withColumn("_s", starts)
    return marked.withColumn("campaign", F.concat_ws("#", *account, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("string"))).drop("_s")


def average_ranks(df: DataFrame, column: str, out: str) -> DataFrame:
    """(column, out): the average rank of each distinct value."""
    levels = written(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), "ranks")
    return running_before(levels, column, {"before": "n"}).select(column, (F.col("before") + (F.col("n") + 1) / 2).alias(out))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks for ties. Pairs of equal values are counted first."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs, "pairs")
    rows = pairs.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(a, b)
    r = rows.join(average_ranks(rows, a, "_ra"), a).join(average_ranks(rows, b, "_rb"), b)
    return r.agg(F.round(F.corr("_ra", "_rb"), 9).alias("rho"))


def permutation_p(df: DataFrame, a: str, b: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """(rho, p): two-sided permutation value (tail + 1) / (rounds + 1) of the rank correlation, by ranks gathered from at most 100,000 rows of least hash."""
    import numpy as np

    table = df.select(a, b).dropna().orderBy(F.xxhash64(a, b), a, b).limit(100_000).toPandas().rank()
    x, y = (table[c].to_numpy() - table[c].mean() for c in (a, b))
    scale = float(np.sqrt((x**2).sum() * (y**2).sum())) or 1.0
    rho, random = float((x * y).sum()) / scale, np.random.default_rng(seed)
    tail = sum(abs(float((x * random.permutation(y)).sum()) / scale) >= abs(rho) - 1e-12 for _ in range(rounds))
    return df.sparkSession.createDataFrame([(round(rho, 9), (tail + 1) / (rounds + 1))], "rho double, p double")


def holm(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p_values (name, p) with Holm-adjusted values: running maximum of (m - rank) * p, at most 1."""
    w = Window.orderBy("p", "name")
    m = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    step = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p"))
    adjusted = p_values.withColumn("_s", step).withColumn("adjusted", F.round(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9)).drop("_s")
    return adjusted.withColumn("rejected", F.col("adjusted") <= alpha)


#: Minutes of triage an analyst has in a day, and minutes an alert takes: fixed values.
TRIAGE_MINUTES, ALERT_MINUTES = 162, (5, 10, 20, 30)


def staffing(budgets: DataFrame) -> DataFrame:
    """(budget, minutes, analysts): people needed a day for each alert budget."""
    each = budgets.withColumn("minutes", F.explode(F.array(*[F.lit(m) for m in ALERT_MINUTES])))
    return each.select("budget", "minutes", F.round(F.col("budget") * F.col("minutes") / TRIAGE_MINUTES, 6).alias("analysts"), F.ceil(F.col("budget") * F.col("minutes") / TRIAGE_MINUTES).cast("bigint").alias("whole_analysts"))


def partition_diagnostics(df: DataFrame) -> DataFrame:
    """(day, events, new_pairs, machine_share): new pairs are those never seen on an earlier day."""
    first = df.groupBy("src_user", "dst_computer").agg(F.min("day").alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("new_pairs"))
    daily = df.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg(F.col("src_user_is_machine").cast("double")), 9).alias("machine_share"))
    return daily.join(first, "day", "left").withColumn("new_pairs", F.coalesce("new_pairs", F.lit(0)))


def edge_effects(scored: DataFrame, last_day: int) -> DataFrame:
    """(first_second_positives, truncated_campaigns): positives in a day's first second, which no window reaches back from, and campaigns that go on to the last second of the days evaluated."""
    pos = scored.filter("is_malicious")
    return pos.agg(
        F.count_if(F.col("time") % SECONDS_PER_DAY == 0).alias("first_second_positives"),
        F.count_distinct(F.when(F.col("day") >= last_day, F.col("campaign"))).alias("truncated_campaigns"),
    )


def concentration(redteam: DataFrame, top: int = 3) -> DataFrame:
    """(src_computer, n, share, accounts): the sources with most intrusions, and how many accounts each used."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    counts = redteam.groupBy("src_computer").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user", "domain").alias("accounts"))
    return counts.withColumn("share", F.round(F.col("n") / total, 9)).orderBy(F.col("n").desc(), "src_computer").limit(top)


def top_contributions(df: DataFrame, columns: list[str], top: int = 3) -> DataFrame:
    """(event_id, contributions): the features of greatest absolute value, as name=value."""
    pairs = F.array(*[F.struct((-F.abs(F.round(c, 6))).alias("k"), F.lit(c).alias("name"), F.round(c, 6).alias("v")) for c in columns])
    best = F.slice(F.array_sort(pairs), 1, top)
    return df.select("event_id", F.array_join(F.transform(best, lambda x: x["name"]), ",").alias("contributions"))

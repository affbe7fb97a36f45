"""Choice of a model's settings on a validation split, and its variance over seeds."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.functions.scorers import RULES, Rules, Scorer
from logweir.operators import evaluate as ev
from logweir.sources.shared import written


class NoPositivesError(ValueError):
    """A split without positives cannot choose between models."""


def precision_of(scored: DataFrame) -> float:
    return ev.ranking_metrics(ev.score_levels(scored)).first()["average_precision"]


def tune(make: Callable[[dict], Scorer], candidates: Iterable[dict], train: DataFrame, val: DataFrame) -> DataFrame:
    """(candidate, config, average_precision, chosen): the first of the best on validation. The default stands first."""
    if val.filter("is_malicious").isEmpty():
        raise NoPositivesError("no positives in validation")
    rows = [(i, str(c), precision_of(make(c).fit(train).score(val))) for i, c in enumerate(candidates)]
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    return train.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "candidate int, config string, average_precision double, chosen boolean")


def fit_variance(make: Callable[[int], Scorer], seeds: Iterable[int], train: DataFrame, val: DataFrame) -> DataFrame:
    """(seed, average_precision) of the same model with other seeds."""
    rows = [(s, precision_of(make(s).fit(train).score(val))) for s in seeds]
    return train.sparkSession.createDataFrame(rows, "seed int, average_precision double").withColumn("average_precision", F.col("average_precision"))


def rule_weights(n: int, seed: int = 0) -> list[dict[str, float]]:
    """Uniform weights first, then n - 1 draws from the flat Dirichlet distribution over the rules."""
    random = np.random.default_rng(seed)
    uniform = dict.fromkeys(RULES, 1 / len(RULES))
    return [uniform, *(dict(zip(RULES, w.tolist())) for w in random.dirichlet(np.ones(len(RULES)), n - 1))]


def tune_rules(train: DataFrame, val: DataFrame, n: int = 20, seed: int = 0) -> tuple[Rules, DataFrame]:
    """(the rules with the weights of best average precision on validation, the table of candidates). Rules are fitted once, and validation rows get their ECDFs once."""
    if val.filter("is_malicious").isEmpty():
        raise NoPositivesError("no positives in validation")
    fitted = Rules().fit(train)
    ecdfs = written(fitted.ecdfs(val).select("event_id", "is_malicious", *[f"{r}_ecdf" for r in RULES]), "ecdfs")
    candidates = rule_weights(n, seed)
    rows = []
    for i, weights in enumerate(candidates):
        total = sum((F.col(f"{r}_ecdf") * w for r, w in weights.items()), F.lit(0.0))
        rows.append((i, str({r: round(w, 6) for r, w in weights.items()}), precision_of(ecdfs.select("event_id", "is_malicious", F.round(total, 9).alias("score")))))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    table = train.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "candidate int, config string, average_precision double, chosen boolean")
    return fitted.with_weights(candidates[best]), table


#: Settings tried for each model by default, the first being its own.
GRIDS = {
    "m2b_pca": [{"variance": v} for v in (0.95, 0.8, 0.9, 0.99)],
    "m3a_iforest": [{"trees": t, "rows": r} for t in (200, 100) for r in (256, 512)],
    "m3b_hbos": [{"bins": b, "tolerance": t} for b in (10, 5, 20) for t in (0.5, 0.1)],
    "m3c_lof": [{"k": k} for k in (35, 10, 20)],
}

"""Why a row scored as it did: contributions of columns, and alert cards in plain text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.scorers import RULES, Autoencoder, Pca


def reconstruction_contributions(model: Pca | Autoencoder, df: DataFrame) -> DataFrame:
    """df with `<column>_part`: each column's squared error of reconstruction; their mean is the model's score."""
    columns, rebuilt = list(model.columns), model.rebuilt

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x, back = rebuilt(part[columns].to_numpy(np.float64))
            for j, c in enumerate(columns):
                part[f"{c}_part"] = (x[:, j] - back[:, j]) ** 2
            yield part

    return df.mapInPandas(run, df.withColumns({f"{c}_part": F.lit(0.0) for c in columns}).schema)


def rule_contributions(ecdfs: DataFrame, weights: dict[str, float], top: int = 3) -> DataFrame:
    """(event_id, rule, contribution, technique, place): the rules of greatest weighted ECDF, the first `top` of each event."""
    parts = F.array(*[F.struct((-F.round(F.col(f"{r}_ecdf") * weights.get(r, 0.0), 9)).alias("k"), F.lit(r).alias("rule"), F.lit(t).alias("technique")) for r, t in RULES.items()])
    best = F.slice(F.array_sort(parts), 1, top)
    return ecdfs.select("event_id", F.posexplode(best).alias("place", "x")).select("event_id", F.col("x.rule").alias("rule"), (-F.col("x.k")).alias("contribution"), F.col("x.technique").alias("technique"), (F.col("place") + 1).alias("place"))


def typical_values(train: DataFrame, columns: list[str], entity: str = "src_user") -> DataFrame:
    """The entity's mean of each column in training, as `<column>_usual`."""
    return train.groupBy(entity).agg(*[F.avg(c).alias(f"{c}_usual") for c in columns])


def alert_cards(scored: DataFrame, k: int, columns: list[str] = (), techniques: str | None = None) -> DataFrame:
    """(day, rank, event_id, card) of each day's first k alerts. Columns listed are shown with the user's usual value where `<column>_usual` is there."""
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.col("score").desc(), "time", "event_id"))
    top = scored.withColumn("rank", rank).filter(F.col("rank") <= k)
    lines = [
        F.format_string("### Alert: event %d (rank #%d of day %d)", "event_id", "rank", "day"),
        F.concat(F.lit("- User: "), F.coalesce("src_user", F.lit("?"))),
        F.concat(F.lit("- From "), F.coalesce("src_computer", F.lit("?")), F.lit(" to "), F.coalesce("dst_computer", F.lit("?"))),
        F.format_string("- Second %d, score %.4f", "time", F.col("score").cast("double")),
    ]
    for c in columns:
        usual = F.format_string(" (usual for this user: %.4f)", f"{c}_usual") if f"{c}_usual" in scored.columns else F.lit("")
        lines.append(F.concat(F.format_string(f"- {c} = %.4f", F.col(c).cast("double")), F.coalesce(usual, F.lit(""))))
    if techniques:
        lines.append(F.concat(F.lit("- Techniques: "), F.col(techniques)))
    return top.select("day", "rank", "event_id", F.concat_ws("\n", *lines).alias("card"))

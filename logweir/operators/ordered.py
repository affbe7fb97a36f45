"""Running sums over one total order without a single task: the order is cut into ranges, and each range is summed on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_number(df: DataFrame, by: str, ranges: int = 64) -> "F.Column":
    """The number of the range that a row's value lies in: ranges between approximate quantiles, at most `ranges`. Null is the first."""
    bounds = sorted(set(df.select(F.col(by).cast("double").alias("v")).filter("v is not null").approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(by).cast("double")))


def running_before(df: DataFrame, by: str, sums: dict[str, str], descending: bool = False, ranges: int = 64) -> DataFrame:
    """df with, for each (name, column) of sums, the sum of the column over the rows before it in order of `by`, whose values are distinct.

    df is read twice: give it a stored table, or one that is cheap to make. Only one row a range meets in a
    single window.
    """
    part = df.withColumn("_range", range_number(df, by, ranges))
    totals = part.groupBy("_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    outer = Window.orderBy(F.col("_range").desc() if descending else F.col("_range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inner = Window.partitionBy("_range").orderBy(F.col(by).desc() if descending else F.col(by)).rowsBetween(Window.unboundedPreceding, -1)
    joined = part.join(F.broadcast(totals), "_range")  # at most `ranges` rows
    return joined.withColumns({n: F.col(f"_b_{n}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for n, c in sums.items()}).drop("_range", *[f"_b_{n}" for n in sums])

"""Temporal splits, universes and deterministic samples."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.schema import SECONDS_PER_DAY, SECONDS_PER_HOUR

#: Inclusive day ranges.
SPLITS = {"train": (0, 19), "val": (20, 24), "test": (25, 29)}


class LeakageError(ValueError):
    """Rows of a later split are not strictly later."""


def by_days(events: DataFrame, first: int, last: int) -> DataFrame:
    """Rows of an inclusive range of days: a partition filter where the log is stored by day."""
    return events.filter(F.col("day").between(first, last))


def by_hours(events: DataFrame, first: float, stop: float) -> DataFrame:
    """Rows of a half-open range of hours."""
    return events.filter((F.col("time") >= int(first * SECONDS_PER_HOUR)) & (F.col("time") < int(stop * SECONDS_PER_HOUR)))


def ranges_in_seconds(splits: dict[str, tuple[float, float]], unit: str = "days") -> dict[str, tuple[int, int]]:
    """Half-open ranges of seconds; empty, overlapping or unordered ranges are refused."""
    size, extra = (SECONDS_PER_DAY, 1) if unit == "days" else (SECONDS_PER_HOUR, 0)
    found, last = {}, None
    for name in ("train", "val", "test"):
        lo, hi = splits[name]
        lo, hi = int(lo * size), int((hi + extra) * size)
        if hi <= lo:
            raise ValueError(f"{name} is empty")
        if last is not None and lo < last:
            raise ValueError(f"{name} overlaps or precedes an earlier split")
        found[name], last = (lo, hi), hi
    return found


def days_of(start: int, stop: int) -> range:
    return range(start // SECONDS_PER_DAY, (stop - 1) // SECONDS_PER_DAY + 1)


def with_split(events: DataFrame, splits: dict[str, tuple[int, int]] = SPLITS) -> DataFrame:
    name = None
    for key, (lo, hi) in splits.items():
        test = F.col("day").between(lo, hi)
        name = F.when(test, key) if name is None else name.when(test, key)
    return events.withColumn("split", name)


def temporal_order(events: DataFrame) -> DataFrame:
    """Bounds of each split and whether they are in order, from one aggregation of labelled rows."""
    b = events.groupBy().pivot("split", ["train", "val", "test"]).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    return b.withColumn("ordered", (F.col("train_hi") < F.col("val_lo")) & (F.col("val_hi") < F.col("test_lo")))


def verify_temporal_order(events: DataFrame) -> None:
    row = temporal_order(events).first()
    if row is None or row["ordered"] is not True:
        raise LeakageError(f"splits are empty or out of order: {row}")


def universe(events: DataFrame, name: str = "all") -> DataFrame:
    """all; remote_logon: log-ons from one host to another; remote_logon_user: those by people."""
    if name == "all":
        return events
    found = events.filter((F.col("auth_orientation") == "LogOn") & (F.col("src_computer") != F.col("dst_computer")))
    if name == "remote_logon":
        return found
    if name == "remote_logon_user":
        return found.filter(~F.col("dst_user_is_machine"))
    raise ValueError(f"unknown universe {name!r}")


def regime_train(train: DataFrame, regime: str) -> DataFrame:
    """R1 fits on all rows, R2 on the rows without positives."""
    return train.filter(~F.col("is_malicious")) if regime == "R2" else train


def random_split(events: DataFrame, test_fraction: float, val_fraction: float, seed: int) -> DataFrame:
    """events with `split` by a hash of event_id; sizes are approximate, reruns agree."""
    slot = F.pmod(F.xxhash64("event_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return events.withColumn("split", F.when(slot < test_fraction, "test").when(slot < test_fraction + val_fraction, "val").otherwise("train"))


#: Rows that one ordering of a whole table may keep at once; larger samples are cut by the bins of their hash first.
MOST_ORDERED = 100_000


def sample_for_fit(train: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows, the same in every run: those of least hash.

    For a large n the rows are counted by the top 16 bits of the hash; bins that lie within n whole are kept as
    they are, and only the one that n falls into is ordered, so no task and no driver holds n rows.
    """
    order = (F.xxhash64("event_id", F.lit(seed)), "event_id")
    if n <= MOST_ORDERED:
        return train.orderBy(*order).limit(n)
    place = F.shiftright(order[0], 48)
    before = 0
    for r in sorted(train.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most 65,536 rows
        if before + r["n"] > n:
            return train.filter(place < r["bin"]).unionByName(train.filter(place == r["bin"]).orderBy(*order).limit(n - before))
        before += r["n"]
    return train


def store_version(config: dict) -> str:
    """Name of a configuration: the first 16 hex digits of the SHA-256 of its canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]

"""Moving averages of throughput, and how long a reader waits before its next page."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = 0.69315
PUBLISH_THRESHOLD = 400.0


def alpha(half_life_s: float, interval_s: float) -> float:
    return 1 - math.exp(-LN2 / half_life_s * interval_s)


def ewma(values: Column, a: float) -> Column:
    """Moving average of an array, in order: its last value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.element_at(values, 1).cast("double"), lambda old, x: a * x + (1 - a) * old)


def throughput(rows: DataFrame, key: str, interval_s: int = 10, half_life_s: float = 10.0) -> DataFrame:
    """(key, rate): smoothed events a second of each key, over intervals from its first to its last with events."""
    t = F.floor(F.unix_micros("db_timestamp") / F.lit(interval_s * 1_000_000))
    counts = rows.groupBy(key, t.alias("t")).agg((F.count("*") / interval_s).alias("x"))
    series = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s"))
    return series.select(key, ewma(F.col("s.x"), alpha(half_life_s, interval_s)).alias("rate"))


def publishes(rate: Column, threshold: float = PUBLISH_THRESHOLD) -> Column:
    return rate < threshold


def next_delay(rows_read: int, page: int, refresh_s: float) -> float:
    """Seconds until the next page: none after a nearly full one, the whole interval after a nearly empty one."""
    if rows_read >= 0.9 * page:
        return 0.0
    return refresh_s if rows_read <= 0.1 * page else refresh_s / 2


def ranked(rows: DataFrame, by: str = "db_timestamp") -> DataFrame:
    """The latest row of each persistence id."""
    w = Window.partitionBy("persistence_id").orderBy(F.desc(by), F.desc("seq_nr"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

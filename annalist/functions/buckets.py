"""Ten-second time buckets: counting rows, and estimating how far a page of rows will reach."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.offsets import EPOCH, at

SECONDS = 10
LIMIT = 10_000


def bucket(ts: Column | str) -> Column:
    """Start of the bucket in epoch seconds: always rounded down."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (F.floor(F.unix_micros(c) / F.lit(SECONDS * 1_000_000)) * SECONDS).cast("long")


def bucket_end(from_ts: dt.datetime, now: dt.datetime, limit: int = LIMIT) -> dt.datetime:
    return now if from_ts == EPOCH else min(now, from_ts + dt.timedelta(seconds=SECONDS * limit + SECONDS))


def counted(rows: DataFrame) -> DataFrame:
    """(bucket, count) of all buckets with rows, however many and at any time, in order."""
    return rows.groupBy(bucket("db_timestamp").alias("bucket")).agg(F.count("*").alias("count")).orderBy("bucket")


def count_buckets(rows: DataFrame, from_ts: dt.datetime, now: dt.datetime, limit: int = LIMIT) -> DataFrame:
    """(bucket, count) of the first limit buckets with rows, in order."""
    to = bucket_end(from_ts, now, limit)
    return counted(rows.where(F.col("db_timestamp").between(at(from_ts), at(to)))).limit(limit)


def with_empty_end(buckets: DataFrame, from_ts: dt.datetime, now: dt.datetime, limit: int = LIMIT) -> DataFrame:
    """Adds an empty bucket at the end of the range where it ends before now and has none there."""
    to = bucket_end(from_ts, now, limit)
    if to == now:
        return buckets
    start = int(to.replace(tzinfo=dt.timezone.utc).timestamp()) // SECONDS * SECONDS
    last = buckets.sparkSession.range(1).select(F.lit(start).cast("long").alias("bucket"), F.lit(0).cast("long").alias("count"))
    return buckets.unionByName(last.join(buckets.agg(F.max("bucket").alias("top")), F.col("bucket").eqNullSafe(F.col("top")), "left_anti")).orderBy("bucket")


def time_for_limit(buckets: DataFrame, from_ts: dt.datetime, n: int) -> DataFrame:
    """One row: the end of the first bucket by which n rows are reached, or null. The bucket of from doesn't count."""
    start = int(from_ts.replace(tzinfo=dt.timezone.utc).timestamp())
    cum = F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # at most LIMIT rows
    return buckets.where(F.col("bucket") > start).withColumn("cum", cum).where(F.col("cum") >= n).agg((F.min("bucket") + SECONDS).alias("end"))


class Buckets:
    """Buckets that a reader keeps from one page to the next, at most LIMIT of them."""

    def __init__(self, counts: dict[int, int] | None = None):
        self.counts = dict(sorted((counts or {}).items()))

    def add(self, more: list[tuple[int, int]]) -> Buckets:
        merged = sorted((self.counts | dict(more)).items())
        return Buckets(dict(merged[-LIMIT:]))

    def clear_until(self, epoch_second: int) -> Buckets:
        """Drops buckets that ended before the time, but keeps the last."""
        if not self.counts:
            return self
        last = next(reversed(self.counts))
        return Buckets({k: v for k, v in self.counts.items() if k > epoch_second - SECONDS or k == last})

    def next_start(self) -> int | None:
        return next(reversed(self.counts)) - SECONDS if self.counts else None

    def find(self, from_second: int, n: int) -> int | None:
        """End of the first bucket after from_second by which n rows are reached."""
        total = 0
        for k, v in self.counts.items():
            if k > from_second:
                total += v
                if total >= n:
                    return k + SECONDS
        return None

"""Merging what the tables give with what publishers push, and filtering the result.

Batch forms work on an order column; annalist.streaming has the forms with state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(stored: DataFrame, pushed: DataFrame) -> DataFrame:
    """Both, told apart by their source column."""
    return stored.unionByName(pushed, allowMissingColumns=True)


def _latest(rows: DataFrame, value: Column, order: str, by: list[str], span: int, own: bool) -> DataFrame:
    """rows with _known, the greatest value of the rows of by that come before in order, and, if own, of the row itself.

    order is a number; each span of it is sorted in a task of its own and takes over what all spans before it had, so
    one reader of all rows doesn't end up in one task.
    """
    parted = rows.withColumns({"_k": value, "_part": F.floor(F.col(order) / span)})
    latest = parted.groupBy(*(F.col(c).alias(f"_by_{c}") for c in by), F.col("_part").alias("_at")).agg(F.max("_k").alias("_m"))
    earlier = Window.partitionBy(*(f"_by_{c}" for c in by)).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    before = latest.select(*(f"_by_{c}" for c in by), "_at", F.max("_m").over(earlier).alias("_before"))
    within = F.max("_k").over(Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    same = F.col("_part").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return parted.withColumn("_within", within).join(before, same).withColumn("_known", F.greatest("_within", "_before"))


def without_too_far_ahead(rows: DataFrame, window_s: float, order: str, by: str = "slice_range", span: int = 100_000) -> DataFrame:
    """Drops pushed rows before the first backtracking row, and those more than window_s ahead of the latest.

    Heartbeats move that latest time on and are dropped. rows has source and db_timestamp; each value of by is a
    reader of its own.
    """
    known = _latest(rows, F.when(F.col("source").isin("BT", "HB"), F.col("db_timestamp")), order, [by], span, own=True)
    ahead = (F.unix_micros("db_timestamp") - F.unix_micros("_known")) > F.lit(int(window_s * 1_000_000))
    return known.where((F.col("source") != "HB") & ((F.col("source") != "PS") | (F.col("_known").isNotNull() & ~ahead))).select(*rows.columns)


def out_of_order(rows: DataFrame, order: str, by: str = "slice_range", span: int = 100_000) -> DataFrame:
    """The rows that a reader must refuse, with latest: each is older than one it had before. None is as it should be.

    Backtracking rows are held against backtracking rows only, all others against each other. Heartbeats don't count.
    """
    kinds = rows.where("source <> 'HB'").withColumn("_bt", F.col("source") == "BT")
    known = _latest(kinds, F.col("db_timestamp"), order, [by, "_bt"], span, own=False)
    return known.where(F.col("db_timestamp") < F.col("_known")).select(*rows.columns, F.col("_known").alias("latest"))


def deduplicated(rows: DataFrame, order: str) -> DataFrame:
    """The first of each (persistence_id, seq_nr) in order; backtracking rows pass and don't count."""
    first = F.min(F.when(F.col("source") != "BT", F.col(order))).over(Window.partitionBy("persistence_id", "seq_nr"))
    return rows.withColumn("_first", first).where((F.col("source") == "BT") | (F.col(order) == F.col("_first"))).drop("_first")


class BoundedDeduplicator:
    """The same for a reader in one process: forgets the oldest keys beyond 1.1 times its capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.seen = capacity, {}

    def accepts(self, persistence_id: str, seq_nr: int, source: str = "") -> bool:
        if not self.capacity or source == "BT":
            return True
        key = (persistence_id, seq_nr)
        if key in self.seen:
            return False
        self.seen[key] = None
        if len(self.seen) >= 1.1 * self.capacity:
            for k in list(self.seen)[: len(self.seen) - self.capacity]:
                del self.seen[k]
        return True


def with_payload(light: DataFrame, journal: DataFrame) -> DataFrame:
    """Backtracking rows joined with the payloads of their events."""
    return light.join(journal.select("persistence_id", "seq_nr", "event_payload"), ["persistence_id", "seq_nr"], "left")

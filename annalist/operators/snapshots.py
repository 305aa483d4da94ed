"""Snapshots: one row for each persistence id, and reads that begin with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.slices import in_slices
from annalist.operators.journal import events_by_persistence_id


def criteria(min_seq_nr: int | None = None, max_seq_nr: int | None = None, min_timestamp: int | None = None, max_timestamp: int | None = None) -> Column:
    c = F.lit(True)
    for name, low, high in (("seq_nr", min_seq_nr, max_seq_nr), ("write_timestamp", min_timestamp, max_timestamp)):
        c = c & (F.col(name) >= low) if low is not None else c
        c = c & (F.col(name) <= high) if high is not None else c
    return c


def load_snapshot(snapshots: DataFrame, persistence_id: str, **limits) -> DataFrame:
    """The id's snapshot if it meets the limits. A max_seq_nr of 0 or less gives none, without a look."""
    if (top := limits.get("max_seq_nr")) is not None and top <= 0:
        return snapshots.limit(0)
    return snapshots.where((F.col("persistence_id") == persistence_id) & criteria(**limits))


def snapshot_seq_nr(snapshots: DataFrame, persistence_id: str) -> DataFrame:
    return snapshots.where(F.col("persistence_id") == persistence_id).select("seq_nr")


def snapshots_by_slices(snapshots: DataFrame, entity_type: str, min_slice: int, max_slice: int) -> DataFrame:
    return snapshots.where((F.col("entity_type") == entity_type) & in_slices(min_slice, max_slice))


def upserted(snapshots: DataFrame, new: DataFrame) -> DataFrame:
    """New rows replace old ones of the same id, whatever their seq_nr."""
    return snapshots.join(new.select("persistence_id"), "persistence_id", "left_anti").unionByName(new)


def without(snapshots: DataFrame, persistence_id: str, seq_nr: int | None = None, timestamp: int | None = None, **limits) -> DataFrame:
    """What stays after a delete: by criteria, or of exactly one seq_nr and, unless 0, one time."""
    gone = (F.col("persistence_id") == persistence_id) & criteria(**limits)
    if seq_nr is not None:
        gone = gone & (F.col("seq_nr") == seq_nr)
    if timestamp:
        gone = gone & (F.col("write_timestamp") == timestamp)
    return snapshots.where(~gone)


def replaced_by_snapshots(events: DataFrame, snapshots: DataFrame, transform: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """Events with those up to an id's snapshot left out and the one it was taken at replaced by it.

    Columns: persistence_id, seq_nr, offset_timestamp, db_timestamp, event, tags, source. Without the event of that
    number the snapshot isn't given either. The offset stays the event's; time and tags are the snapshot's.
    """
    snap = snapshots.select("persistence_id", F.col("seq_nr").alias("_s"), transform(F.col("snapshot")).alias("_p"), F.col("db_timestamp").alias("_t"), F.col("tags").alias("_g"))
    hit = F.col("seq_nr").eqNullSafe(F.col("_s"))
    rows = events.join(snap, "persistence_id", "left").where(F.col("seq_nr") >= F.coalesce("_s", F.lit(0)))
    pick = lambda s, e: F.when(hit, F.col(s)).otherwise(F.col(e)).alias(e)
    return rows.select("persistence_id", "seq_nr", F.col("db_timestamp").alias("offset_timestamp"), F.when(hit, F.coalesce("_t", "db_timestamp")).otherwise(F.col("db_timestamp")).alias("db_timestamp"), F.when(hit, F.col("_p")).otherwise(F.col("event_payload")).alias("event"), pick("_g", "tags"), F.when(hit, "SN").otherwise("").alias("source"))


def starting_from_snapshots(events: DataFrame, snapshots: DataFrame, transform: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """The same of a table's events; a repeated one is given once."""
    return replaced_by_snapshots(events, snapshots, transform).dropDuplicates(["persistence_id", "seq_nr"])


def by_persistence_id(journal: DataFrame, snapshots: DataFrame, persistence_id: str, from_seq_nr: int, to_seq_nr: int, transform: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """One id's snapshot, where it lies within the range, then the events after it; else the events alone."""
    snap = snapshots.where((F.col("persistence_id") == persistence_id) & F.col("seq_nr").between(from_seq_nr, to_seq_nr))
    first = snap.agg(F.coalesce(F.max("seq_nr") + 1, F.lit(from_seq_nr)).alias("first"))
    events = events_by_persistence_id(journal, persistence_id, from_seq_nr, to_seq_nr).join(F.broadcast(first), F.col("seq_nr") >= F.col("first"))  # one row
    head = snap.select("persistence_id", "seq_nr", transform(F.col("snapshot")).alias("event"), F.lit("SN").alias("source"))
    return head.unionByName(events.select("persistence_id", "seq_nr", F.col("event_payload").alias("event"), F.lit("").alias("source"))).orderBy("seq_nr")


def backfilled(snapshots: DataFrame, journal: DataFrame) -> DataFrame:
    """Snapshots with the time and tags of the event that they were taken at, where it exists."""
    e = journal.select("persistence_id", "seq_nr", F.col("db_timestamp").alias("_t"), F.col("tags").alias("_g"))
    return snapshots.join(e, ["persistence_id", "seq_nr"], "left").withColumns({"db_timestamp": F.coalesce("_t", "db_timestamp"), "tags": F.coalesce("_g", "tags")}).select(*snapshots.columns)


def saved(snapshots: DataFrame, journal: DataFrame, new: DataFrame) -> DataFrame:
    """An upsert that takes time and tags from the events; without one, the write time in milliseconds and no tags."""
    filled = backfilled(new.withColumns({"db_timestamp": F.timestamp_millis("write_timestamp"), "tags": F.array().cast("array<string>")}), journal)
    return upserted(snapshots, filled)

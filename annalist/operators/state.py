"""Durable state: the latest value of each persistence id, with its revision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.offsets import TimestampOffset, at, unseen
from annalist.functions.slices import checked_range, in_slices
from annalist.operators.journal import persistence_ids

TOMBSTONE_SER_ID = 0
ORDER = ("db_timestamp", "revision", "persistence_id")


def value():
    """The payload, or null where the row marks a deletion."""
    return F.when(F.col("state_ser_id") != TOMBSTONE_SER_ID, F.col("state_payload"))


def get_state(states: DataFrame, persistence_id: str) -> DataFrame:
    """One row (value, revision): revision 0 where the id is unknown, a null value where it was deleted."""
    hit = states.where(F.col("persistence_id") == persistence_id)
    return hit.agg(F.first(value()).alias("value"), F.coalesce(F.max("revision"), F.lit(0)).alias("revision"))


def state_ids(tables: list[DataFrame] | DataFrame, entity_type: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """Ids in order, of deleted states too."""
    return persistence_ids(tables, entity_type, after, limit)


def changes(states: DataFrame, entity_type: str, min_slice: int, max_slice: int, offset: TimestampOffset | None = None, now=None, include_payload: bool = True) -> DataFrame:
    """Latest changes after the offset and before now, in order; of an id only its latest."""
    checked_range(min_slice, max_slice)
    rows = states.where((F.col("entity_type") == entity_type) & in_slices(min_slice, max_slice))
    rows = unseen(rows, offset, "revision")
    if now is not None:
        rows = rows.where(F.col("db_timestamp") < at(now))
    kind = F.when(F.col("state_ser_id") == TOMBSTONE_SER_ID, "deleted").otherwise("updated").alias("change_type")
    return rows.select("persistence_id", "revision", "db_timestamp", kind, (value() if include_payload else F.lit(None).cast("binary")).alias("value"), "entity_type", "slice", "tags").orderBy(*ORDER)

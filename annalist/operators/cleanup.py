"""Deletes and clean-up, for many persistence ids at once: what stays of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.functions.offsets import at
from annalist.functions.slices import entity_type_of, slice_for

ALL = 2**63 - 1


def without_events_to(journal: DataFrame, targets: DataFrame, reset: bool = False, now=None) -> DataFrame:
    """Deletes events up to targets(persistence_id, to_seq_nr); the highest number stays known by a tombstone.

    ALL means the highest there is. A number beyond the highest puts the tombstone there, so the sequence goes on from
    it. reset leaves no tombstone, so numbers begin anew.
    """
    top = journal.join(targets.select("persistence_id"), "persistence_id", "left_semi").groupBy("persistence_id").agg(F.max("seq_nr").alias("_top"))
    to = targets.join(top, "persistence_id", "left").select("persistence_id", F.when(F.col("to_seq_nr") == ALL, F.coalesce("_top", F.lit(0))).otherwise(F.col("to_seq_nr")).alias("_to"))
    kept = journal.join(to, "persistence_id", "left").where(F.col("_to").isNull() | (F.col("seq_nr") > F.col("_to"))).select(*journal.columns)
    if reset:
        return kept
    made = {
        "slice": slice_for("persistence_id"), "entity_type": entity_type_of("persistence_id"), "seq_nr": F.col("_to"), "db_timestamp": F.current_timestamp() if now is None else at(now),
        "event_ser_id": F.lit(0), "event_ser_manifest": F.lit(""), "event_payload": F.lit(b""), "deleted": F.lit(True), "writer": F.lit(""), "adapter_manifest": F.lit(""),
    }
    marks = to.withColumns(made).drop("_to")
    rows = marks.select(*((F.col(f.name) if f.name in marks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in journal.schema))
    return kept.unionByName(rows)


def without_events_before(journal: DataFrame, before, persistence_id: str | None = None, entity_type: str | None = None, slice_nr: int | None = None) -> DataFrame:
    """Deletes events before a time, of one id or of one type and slice; no tombstone is left."""
    gone = F.col("db_timestamp") < at(before)
    if persistence_id is not None:
        gone = gone & (F.col("persistence_id") == persistence_id)
    else:
        gone = gone & (F.col("entity_type") == entity_type) & (F.col("slice") == slice_nr)
    return journal.where(~gone)


def without_events_before_snapshots(journal: DataFrame, snapshots: DataFrame, ids: DataFrame | None = None, now=None) -> DataFrame:
    """Deletes what each id's snapshot makes unneeded."""
    snaps = snapshots if ids is None else snapshots.join(ids.select("persistence_id"), "persistence_id", "left_semi")
    return without_events_to(journal, snaps.select("persistence_id", F.col("seq_nr").alias("to_seq_nr")), now=now)


def without_everything(journal: DataFrame, snapshots: DataFrame, ids: DataFrame, reset: bool = False, now=None) -> tuple[DataFrame, DataFrame]:
    """(journal, snapshots) without the ids' events and snapshots."""
    targets = ids.select("persistence_id", F.lit(ALL).alias("to_seq_nr"))
    return without_events_to(journal, targets, reset, now), snapshots.join(ids.select("persistence_id"), "persistence_id", "left_anti")


def deletion_batches(lowest: int, to_seq_nr: int, batch: int = 1000) -> list[tuple[int, int]]:
    """Ranges by which a table that deletes in place goes about it; a rewrite of files needs none."""
    if to_seq_nr <= batch:
        return [(1, to_seq_nr)]
    starts = range(lowest, to_seq_nr + 1, batch)
    return [(a, min(a + batch - 1, to_seq_nr)) for a in starts]

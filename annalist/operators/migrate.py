"""Migration of events, snapshots and states from another store, resumable through a progress table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those whose keys the target has: a repeated migration adds nothing."""
    return rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def events_to_migrate(source: DataFrame, target: DataFrame, progress: DataFrame) -> DataFrame:
    """Events beyond the progress of their id that the target lacks. Tags are not carried over."""
    done = progress.select("persistence_id", F.coalesce("event_seq_nr", F.lit(0)).alias("_done"))
    rows = source.join(done, "persistence_id", "left").where(F.col("seq_nr") > F.coalesce("_done", F.lit(0))).select(*source.columns)
    rows = rows.withColumn("tags", F.lit(None).cast("array<string>")) if "tags" in rows.columns else rows
    return missing(rows, target, ["persistence_id", "seq_nr"])


def snapshots_to_migrate(source: DataFrame, progress: DataFrame) -> DataFrame:
    """The latest snapshot of each id, where it is beyond the progress."""
    latest = source.groupBy("persistence_id").agg(F.max_by(F.struct(*source.columns), "seq_nr").alias("r")).select("r.*")
    done = progress.select("persistence_id", F.coalesce("snapshot_seq_nr", F.lit(0)).alias("_done"))
    return latest.join(done, "persistence_id", "left").where(F.col("seq_nr") > F.coalesce("_done", F.lit(0))).drop("_done")


def states_to_migrate(source: DataFrame, progress: DataFrame) -> DataFrame:
    """States beyond the progress, whatever their revision."""
    done = progress.select("persistence_id", F.coalesce("state_revision", F.lit(0)).alias("_done"))
    return source.join(done, "persistence_id", "left").where(F.col("revision") > F.coalesce("_done", F.lit(0))).drop("_done")


def progressed(progress: DataFrame, events: DataFrame | None = None, snapshots: DataFrame | None = None, states: DataFrame | None = None) -> DataFrame:
    """The progress table after these rows were copied."""
    parts = [progress]
    for rows, number, column in ((events, "seq_nr", "event_seq_nr"), (snapshots, "seq_nr", "snapshot_seq_nr"), (states, "revision", "state_revision")):
        if rows is not None:
            parts.append(rows.groupBy("persistence_id").agg(F.max(number).alias(column)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.groupBy("persistence_id").agg(*(F.max(c).alias(c) for c in ("event_seq_nr", "snapshot_seq_nr", "state_revision")))


def result(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row with how much was copied: ids, events, snapshots."""
    e = events.agg(F.count_distinct("persistence_id").alias("persistence_ids"), F.count("*").alias("events"))
    return e.crossJoin(snapshots.agg(F.count("*").alias("snapshots")))  # one row each

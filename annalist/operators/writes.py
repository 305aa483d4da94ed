"""Writes, as functions from tables and new rows to tables. annalist.sources.store publishes the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.offsets import at
from annalist.functions.slices import entity_type_of, slice_for
from annalist.operators.state import TOMBSTONE_SER_ID
from annalist.sources.schema import JOURNAL, STATE



def _micro() -> Column:
    return F.expr("INTERVAL 0.000001 SECOND")


class Conflict(ValueError):
    """A key exists already, or a revision isn't the next one."""


def _refuse(rows: DataFrame, what: str) -> None:
    if (bad := rows.limit(5).collect()):
        raise Conflict(f"{what}: {[tuple(r) for r in bad]}")


def _now(now) -> Column:
    return F.current_timestamp() if now is None else at(now)


def _filled(rows: DataFrame, schema, **defaults: Column) -> DataFrame:
    """rows with all columns of the schema in order; extra columns of the user's stay behind them."""
    extra = [c for c in rows.columns if c not in schema.names]
    cols = [(F.col(f.name) if f.name in rows.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in schema.fields]
    return rows.select(*cols, *extra)


def stamped(new: DataFrame, journal: DataFrame, now=None, monotonic: bool = True) -> DataFrame:
    """new with db_timestamp: one time for each atomic write (persistence_id, write_nr), later than the one before it.

    The time of a write is the greatest of now and a microsecond after the previous event's. For many writes of an id
    at once that chain is a running maximum: max over j <= k of (now_j - j us) + k us.
    """
    new = new if "write_nr" in new.columns else new.withColumn("write_nr", F.lit(1))
    new = new if "written_at" in new.columns else new.withColumn("written_at", _now(now))
    if not monotonic:
        return new.withColumn("db_timestamp", F.col("written_at")).drop("write_nr", "written_at")
    heads = new.groupBy("persistence_id", "write_nr").agg(F.min("seq_nr").alias("head"), F.max("written_at").alias("at"))
    order = Window.partitionBy("persistence_id").orderBy("write_nr")
    heads = heads.withColumn("k", F.row_number().over(order))
    before = journal.select("persistence_id", (F.col("seq_nr") + 1).alias("head"), F.col("db_timestamp").alias("prev"))
    heads = heads.join(before, ["persistence_id", "head"], "left")
    micros = lambda c: F.unix_micros(c)
    chain = F.max(F.greatest(micros("at") - F.col("k"), micros("prev") + 1 - F.col("k"))).over(order) + F.col("k")
    times = heads.select("persistence_id", "write_nr", F.timestamp_micros(chain).alias("db_timestamp"))
    return new.drop("db_timestamp").join(times, ["persistence_id", "write_nr"]).drop("write_nr", "written_at")


def with_additional(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A user's own columns, computed from the row. A null stands for a value that isn't bound."""
    return rows.withColumns(columns) if columns else rows


def new_events(new: DataFrame, journal: DataFrame, now=None, monotonic: bool = True, additional: dict[str, Column] | None = None) -> DataFrame:
    """Rows to append for new(persistence_id, seq_nr, event_payload, ...). Conflict where a key is taken already."""
    keys = ["persistence_id", "seq_nr"]
    _refuse(new.groupBy(*keys).count().where("count > 1").select(*keys), "given twice")
    _refuse(new.join(journal.select(*keys), keys, "left_semi").select(*keys), "exists already")
    return _events(with_additional(stamped(new, journal, now, monotonic), additional or {}))


def _events(rows: DataFrame) -> DataFrame:
    """Journal rows from stamped ones, what a producer need not give filled in."""
    tags = F.when(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0, F.array_sort(F.array_distinct("tags"))) if "tags" in rows.columns else F.lit(None)
    rows = rows.withColumns({"tags": tags.cast("array<string>"), "slice": slice_for("persistence_id"), "entity_type": entity_type_of("persistence_id")})
    return _filled(rows, JOURNAL, event_ser_id=F.lit(1), event_ser_manifest=F.lit(""), deleted=F.lit(False), writer=F.lit(""))


def next_states(states: DataFrame, new: DataFrame, now=None, single_writer: bool = True, monotonic: bool = True, additional: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """The table after upserts new(persistence_id, revision, state_payload, tags, ...).

    Revision 1 inserts, and must find no row; a higher one must find the one before it, if a single writer is
    asserted. additional maps a column to old value -> new value, so that a rule may keep what is there.
    """
    _refuse(new.groupBy("persistence_id").count().where("count > 1").select("persistence_id"), "given twice")
    old = states.select("persistence_id", F.col("revision").alias("_r"), F.col("db_timestamp").alias("_t"), *(F.col(c).alias(f"_{c}") for c in additional or {}))
    rows = new.join(old, "persistence_id", "left")
    wrong = F.when(F.col("revision") == 1, F.col("_r").isNotNull()).otherwise(F.col("_r").isNull() | ((F.col("_r") != F.col("revision") - 1) if single_writer else F.lit(False)))
    _refuse(rows.where(wrong).select("persistence_id", "revision", "_r"), "not the next revision")
    time = F.greatest(_now(now), F.col("_t") + _micro()) if monotonic else _now(now)
    rows = rows.withColumns({"db_timestamp": time, "slice": slice_for("persistence_id"), "entity_type": entity_type_of("persistence_id"), **{c: f(F.col(f"_{c}")) for c, f in (additional or {}).items()}})
    rows = rows.drop("_r", "_t", *(f"_{c}" for c in additional or {}))
    kept = states.join(new.select("persistence_id"), "persistence_id", "left_anti")
    return kept.unionByName(_filled(rows, STATE, state_ser_id=F.lit(1), state_payload=F.lit(b"")), allowMissingColumns=True)


def deleted_states(states: DataFrame, gone: DataFrame, now=None) -> DataFrame:
    """The table after gone(persistence_id, revision): 0 removes the row; else it becomes a marker of that revision.

    Tags and additional columns of a row that becomes a marker stay as they are.
    """
    hard = gone.where("revision = 0").select("persistence_id")
    marks = gone.where("revision > 0").select("persistence_id", F.col("revision").alias("_new"))
    rows = states.join(hard, "persistence_id", "left_anti").join(marks, "persistence_id", "full_outer")
    _refuse(rows.where("_new is not null and _new <> coalesce(revision, 0) + 1").select("persistence_id", "_new", "revision"), "not the next revision")
    marked = F.col("_new").isNotNull()
    out = rows.withColumns({
        "revision": F.coalesce("_new", "revision"), "db_timestamp": F.when(marked, F.greatest(_now(now), F.col("db_timestamp") + _micro())).otherwise(F.col("db_timestamp")),
        "state_ser_id": F.when(marked, TOMBSTONE_SER_ID).otherwise(F.col("state_ser_id")), "state_ser_manifest": F.when(marked, F.lit("")).otherwise(F.col("state_ser_manifest")), "state_payload": F.when(marked, F.lit(b"")).otherwise(F.col("state_payload")),
        "slice": F.coalesce("slice", slice_for("persistence_id")), "entity_type": F.coalesce("entity_type", entity_type_of("persistence_id")),
    })
    return out.select(*states.columns)


def change_events(changed: DataFrame, journal: DataFrame, payload: Column, now=None) -> DataFrame:
    """Events that tell of state changes, to be published in the same commit as the states. Hard deletes have none.

    Each is the next of its id, later than the last one. Number and time of the last come from one aggregate, so the
    journal is neither sorted nor joined row by row, and the next number can't be taken.
    """
    changed = changed.where("revision > 0")
    _refuse(changed.groupBy("persistence_id").count().where("count > 1").select("persistence_id"), "given twice")
    last = journal.groupBy("persistence_id").agg(F.max("seq_nr").alias("_top"), F.max_by("db_timestamp", "seq_nr").alias("_t"))
    rows = changed.join(last, "persistence_id", "left")
    time = F.greatest(_now(now), F.col("_t") + _micro())
    return _events(rows.select("persistence_id", (F.coalesce("_top", F.lit(0)) + 1).alias("seq_nr"), time.alias("db_timestamp"), payload.cast("binary").alias("event_payload")))

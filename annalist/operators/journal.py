"""Reads of the event journal. Each takes and returns DataFrames; rows with ties are ordered by persistence id too."""

from __future__ import annotations

import datetime as dt
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annalist.functions.buckets import count_buckets, time_for_limit
from annalist.functions.offsets import EPOCH, TimestampOffset, at, from_time, offset_column, unseen
from annalist.functions.slices import SEPARATOR, checked_range, in_slices
from annalist.sources.schema import FILTERED_SER_ID

ORDER = ("db_timestamp", "seq_nr", "persistence_id")
BUFFER = 1000
#: What backtracking reads: no payload, so columnar scans skip it.
LIGHT = ("slice", "persistence_id", "seq_nr", "db_timestamp", "tags", "event_ser_id")


def live() -> Column:
    return ~F.col("deleted")


def typed(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int) -> DataFrame:
    """Live and deleted rows of a type and slice range. The partition column, where there is one, prunes folders."""
    checked_range(min_slice, max_slice)
    return journal.where((F.col("entity_type") == entity_type) & in_slices(min_slice, max_slice))


def events_by_slices_scan(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int, from_ts=None, from_seq_nr: int | None = None, to_ts=None, now=None, behind_ms: int = 0, backtracking: bool = False, limit: int | None = BUFFER) -> DataFrame:
    """One page of events in order of time: from from_ts (at it from from_seq_nr), to to_ts, and behind now."""
    rows = typed(journal, entity_type, min_slice, max_slice).where(live())
    if from_ts is not None:
        rows = rows.where(from_time(from_ts, from_seq_nr))
    if to_ts is not None:
        rows = rows.where(F.col("db_timestamp") <= at(to_ts))
    if behind_ms:
        rows = rows.where(F.col("db_timestamp") < (F.current_timestamp() if now is None else at(now)) - F.expr(f"INTERVAL {behind_ms / 1000} SECOND"))
    rows = rows.select(*LIGHT) if backtracking else rows
    ordered = rows.orderBy(*ORDER)
    return ordered if limit is None else ordered.limit(limit)


def events_by_slices_estimated(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int, from_ts: dt.datetime, now: dt.datetime, limit: int = BUFFER) -> DataFrame:
    """The same page with an end that counts in buckets put there, so later rows are neither read nor sorted.

    The range up to it holds limit rows at least; where no bucket reaches that many, now is the end.
    """
    counts = count_buckets(typed(journal, entity_type, min_slice, max_slice).where(live()), from_ts, now)
    end = time_for_limit(counts, from_ts, limit).first()["end"]
    to = now if end is None else min(now, EPOCH + dt.timedelta(seconds=end))
    return events_by_slices_scan(journal, entity_type, min_slice, max_slice, from_ts, to_ts=to, limit=limit)


def current_events_by_slices(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int, offset: TimestampOffset | None = None, now=None) -> DataFrame:
    """All events up to now that the offset hasn't seen, in order, as envelopes."""
    rows = unseen(typed(journal, entity_type, min_slice, max_slice).where(live()), offset)
    if now is not None:
        rows = rows.where(F.col("db_timestamp") <= at(now))
    return envelopes(rows).orderBy("offset.timestamp", "seq_nr", "persistence_id")


def envelopes(rows: DataFrame, source: str = "", read_timestamp: Column | None = None) -> DataFrame:
    """What queries give out. A row without payload column, or with the filtered marker, has no event."""
    payload = F.col("event_payload") if "event_payload" in rows.columns else F.lit(None).cast("binary")
    filtered = F.col("event_ser_id") == FILTERED_SER_ID
    return rows.select(
        offset_column(read_timestamp=read_timestamp).alias("offset"), "persistence_id", "seq_nr", F.when(~filtered, payload).alias("event"), F.unix_millis("db_timestamp").alias("timestamp"),
        (F.col("meta_payload") if "meta_payload" in rows.columns else F.lit(None).cast("binary")).alias("metadata"), (F.col("entity_type") if "entity_type" in rows.columns else F.substring_index("persistence_id", SEPARATOR, 1)).alias("entity_type"),
        "slice", filtered.alias("filtered"), F.lit(source).alias("source"), F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tags"),
    )


def events_by_persistence_id(journal: DataFrame, persistence_id: str, from_seq_nr: int = 0, to_seq_nr: int = 2**63 - 1, include_deleted: bool = False) -> DataFrame:
    """Events of one id in order. Tombstones, where asked for, have neither payload nor serializer."""
    rows = journal.where((F.col("persistence_id") == persistence_id) & F.col("seq_nr").between(from_seq_nr, to_seq_nr))
    if not include_deleted:
        return rows.where(live()).orderBy("seq_nr")
    return rows.withColumns({"event_payload": F.when(live(), F.col("event_payload")), "event_ser_id": F.when(live(), F.col("event_ser_id")).otherwise(0)}).orderBy("seq_nr")


def load_event(journal: DataFrame, persistence_id: str, seq_nr: int, include_payload: bool = True) -> DataFrame:
    rows = journal.where((F.col("persistence_id") == persistence_id) & (F.col("seq_nr") == seq_nr) & live())
    return rows if include_payload else rows.drop("event_payload")


def load_envelope(journal: DataFrame, persistence_id: str, seq_nr: int):
    """The event as one row; KeyError where there is none."""
    got = envelopes(load_event(journal, persistence_id, seq_nr)).first()
    if got is None:
        raise KeyError(f"no event {seq_nr} of {persistence_id}")
    return got


def load_last_event(journal: DataFrame, persistence_id: str, to_seq_nr: int = 2**63 - 1, include_deleted: bool = False) -> DataFrame:
    rows = journal.where((F.col("persistence_id") == persistence_id) & (F.col("seq_nr") <= to_seq_nr))
    return (rows if include_deleted else rows.where(live())).orderBy(F.desc("seq_nr")).limit(1)


def last_events(journal: DataFrame, include_deleted: bool = False) -> DataFrame:
    """The last event of every id, in one aggregation with partial results in each task."""
    rows = journal if include_deleted else journal.where(live())
    return rows.groupBy("persistence_id").agg(F.max_by(F.struct(*rows.columns), "seq_nr").alias("r")).select("r.*")


def timestamp_of_event(journal: DataFrame, persistence_id: str, seq_nr: int) -> DataFrame:
    return load_event(journal, persistence_id, seq_nr).select("db_timestamp")


def latest_event_timestamp(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int) -> DataFrame:
    """One row with the latest time, null where there is no event."""
    return typed(journal, entity_type, min_slice, max_slice).where(live()).agg(F.max("db_timestamp").alias("latest"))


class LatestTimestampCache:
    """Latest times by type and range, kept for ttl seconds."""

    def __init__(self, journal: DataFrame, ttl_s: float = 1.0, clock=time.monotonic):
        self.journal, self.ttl, self.clock, self.kept = journal, ttl_s, clock, {}

    def get(self, entity_type: str, min_slice: int, max_slice: int) -> dt.datetime | None:
        key, now = (entity_type, min_slice, max_slice), self.clock()
        if key not in self.kept or now - self.kept[key][0] > self.ttl:
            self.kept[key] = (now, latest_event_timestamp(self.journal, *key).first()["latest"])
        return self.kept[key][1]


def highest_seq_nr(journal: DataFrame, persistence_id: str, from_seq_nr: int = 0) -> DataFrame:
    """Tombstones count; 0 where there is no row."""
    return journal.where((F.col("persistence_id") == persistence_id) & (F.col("seq_nr") >= from_seq_nr)).agg(F.coalesce(F.max("seq_nr"), F.lit(0)).alias("highest"))


def lowest_seq_nr(journal: DataFrame, persistence_id: str) -> DataFrame:
    return journal.where(F.col("persistence_id") == persistence_id).agg(F.coalesce(F.min("seq_nr"), F.lit(0)).alias("lowest"))


def current_db_timestamp(spark, now=None) -> DataFrame:
    return spark.range(1).select((F.current_timestamp() if now is None else at(now)).alias("now"))


def persistence_ids(tables: list[DataFrame] | DataFrame, entity_type: str | None = None, after: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct ids in order, of deleted rows too, after an id and at most limit."""
    tables = tables if isinstance(tables, list) else [tables]
    ids = None
    for t in tables:
        one = t.select("persistence_id")
        if entity_type is not None:
            one = one.where(F.col("persistence_id").startswith(entity_type + SEPARATOR))
        if after is not None:
            one = one.where(F.col("persistence_id") > after)
        ids = one if ids is None else ids.unionByName(one)
    ordered = ids.distinct().orderBy("persistence_id")
    return ordered if limit is None else ordered.limit(limit)


def persistence_id_page(tables, after: str | None = None, page: int = BUFFER, entity_type: str | None = None) -> DataFrame:
    """The page of ids that follows one: the keyset form, for a reader that goes on from the last id it got."""
    return persistence_ids(tables, entity_type, after, page)


def numbered_pages(ids: DataFrame, page: int, folder: str) -> DataFrame:
    """(persistence_id, page): all ids in order, dealt into pages.

    The ids are sorted by range and written to folder with their partition; ids before a partition are the counts of
    those before it, one number for each partition, so no task numbers all ids and none pass through the driver.
    """
    spark = ids.sparkSession
    ids.select("persistence_id").repartitionByRange("persistence_id").sortWithinPartitions("persistence_id").select("persistence_id", F.monotonically_increasing_id().alias("_n")).write.parquet(folder)
    rows = spark.read.schema("persistence_id string, _n long").parquet(folder)
    part, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_c"))
    before = counts.select("_part", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    return rows.withColumn("_part", part).join(F.broadcast(before), "_part").select("persistence_id", F.floor((F.col("_before") + place) / page).alias("page"))


def persistence_ids_by_slices(journal: DataFrame, entity_type: str, min_slice: int, max_slice: int, from_ts=None, to_ts=None, limit: int | None = None) -> DataFrame:
    """(persistence_id, latest): ids with events in the window, the most recent first. latest is within the window."""
    rows = typed(journal, entity_type, min_slice, max_slice).where(live())
    if from_ts is not None:
        rows = rows.where(F.col("db_timestamp") >= at(from_ts))
    if to_ts is not None:
        rows = rows.where(F.col("db_timestamp") <= at(to_ts))
    ordered = rows.groupBy("persistence_id").agg(F.max("db_timestamp").alias("latest")).orderBy(F.desc("latest"), "persistence_id")
    return ordered if limit is None else ordered.limit(limit)


def replay(journal: DataFrame, persistence_id: str, from_seq_nr: int, to_seq_nr: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(events to replay, one row with the highest seq_nr). from -1 asks for the last event only; to or most of 0 for none.

    Without a limit, and of the last event only, the highest number is that of the last row read, 0 where none was;
    such a row may be a tombstone, which isn't replayed. Otherwise it is the highest there is from from_seq_nr on.
    """
    top = 2**63 - 1
    if to_seq_nr <= 0 or most == 0:
        return journal.limit(0), highest_seq_nr(journal, persistence_id, from_seq_nr)
    if from_seq_nr == -1:
        last = load_last_event(journal, persistence_id, to_seq_nr, include_deleted=True)
        return last.where(live()), last.agg(F.coalesce(F.max("seq_nr"), F.lit(0)).alias("highest"))
    end = to_seq_nr if most == top else min(to_seq_nr, from_seq_nr + most - 1)
    return events_by_persistence_id(journal, persistence_id, from_seq_nr, end), highest_seq_nr(journal, persistence_id, from_seq_nr)


def with_tag(rows: DataFrame, tag: str) -> DataFrame:
    return rows.where(F.array_contains("tags", tag))


def with_json(rows: DataFrame, path: str, value: str, column: str = "event_payload") -> DataFrame:
    """Rows whose JSON payload has the value at the path."""
    return rows.where(F.get_json_object(F.col(column).cast("string"), path) == value)

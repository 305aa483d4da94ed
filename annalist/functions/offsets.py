"""Timestamp offsets: where a read stopped, and what it had seen at that very time."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class TimestampOffset:
    """timestamp of the last row read, and the highest seq_nr of each persistence id seen at it."""

    timestamp: dt.datetime = EPOCH
    seen: dict[str, int] = field(default_factory=dict)
    read_timestamp: dt.datetime | None = None

    @classmethod
    def of(cls, offset: TimestampOffset | None) -> TimestampOffset:
        return cls() if offset is None else offset

    def advanced(self, timestamp: dt.datetime, persistence_id: str, seq_nr: int) -> TimestampOffset:
        seen = dict(self.seen) if timestamp == self.timestamp else {}
        seen[persistence_id] = max(seq_nr, seen.get(persistence_id, 0))
        return TimestampOffset(timestamp, seen, self.read_timestamp)


def at(value: dt.datetime | str | Column) -> Column:
    """A moment; without a zone it is in UTC, whatever the session's zone."""
    if isinstance(value, Column):
        return value
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else str(value)
    zoned = text.endswith("Z") or "+" in text or text[-6:-5] == "-" and text[-3:-2] == ":"
    return F.lit(text if zoned else f"{text}+00:00").cast("timestamp")


def from_time(timestamp, seq_nr: int | None = None) -> Column:
    """Rows from a time on; seq_nr skips lower ones at exactly that time."""
    ts = F.col("db_timestamp")
    return (ts >= at(timestamp)) & ((ts != at(timestamp)) | (F.col("seq_nr") >= seq_nr) if seq_nr is not None else F.lit(True))


#: So many seen entries at most become a literal map; more are joined.
LITERAL_SEEN = 1000


def unseen(rows: DataFrame, offset: TimestampOffset | None, number: str = "seq_nr") -> DataFrame:
    """Rows after the offset: later ones, and of its own time those it hasn't seen."""
    offset = TimestampOffset.of(offset)
    later, same = F.col("db_timestamp") > at(offset.timestamp), F.col("db_timestamp") == at(offset.timestamp)
    if not offset.seen:
        return rows.where(later | same)
    if len(offset.seen) <= LITERAL_SEEN:
        known = F.create_map(*[x for p, n in offset.seen.items() for x in (F.lit(p), F.lit(n).cast("long"))])
        return rows.where(later | (same & (F.coalesce(F.try_element_at(known, F.col("persistence_id")), F.lit(0)) < F.col(number))))
    known = rows.sparkSession.createDataFrame(list(offset.seen.items()), "persistence_id string, _seen long")
    joined = rows.where(later | same).join(known, "persistence_id", "left")
    return joined.where(later | (F.coalesce("_seen", F.lit(0)) < F.col(number))).select(*rows.columns)


def offset_column(number: str = "seq_nr", read_timestamp: Column | None = None) -> Column:
    """The offset of each row by itself, as a struct."""
    return F.struct(F.col("db_timestamp").alias("timestamp"), (F.lit(None).cast("timestamp") if read_timestamp is None else read_timestamp).alias("read_timestamp"), F.create_map("persistence_id", number).alias("seen"))


def last_offset(rows: DataFrame, number: str = "seq_nr") -> TimestampOffset:
    """Where a reader of rows stands: the latest time, and what rows of that time it saw."""
    top = rows.agg(F.max("db_timestamp").alias("t"))
    got = rows.join(F.broadcast(top), F.col("db_timestamp") == F.col("t")).groupBy("persistence_id").agg(F.max(number).alias("n"), F.unix_micros(F.max("t")).alias("t")).collect()
    return TimestampOffset(EPOCH + dt.timedelta(microseconds=got[0]["t"]), {r["persistence_id"]: r["n"] for r in got}) if got else TimestampOffset()

"""Unbounded reads: Structured Streaming over the folders of the tables."""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from annalist.functions.slices import checked_range, in_slices
from annalist.operators.snapshots import replaced_by_snapshots
from annalist.sources.schema import JOURNAL, STATE

#: How long a late event may be found again, and how far behind now backtracking stays.
WINDOW, BEHIND = "2 minutes", "10 seconds"


def stream(spark: SparkSession, path: str, schema: T.StructType = JOURNAL, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of a table's folder, present and future. A file that appears late is read whatever its rows' times."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def _new_numbers(lows: list[int], highs: list[int], numbers) -> list[bool]:
    """Which of the numbers lie in none of the ranges; adds them, so each is new once."""
    new = []
    for n in numbers:
        i = bisect_right(lows, n) - 1
        new.append(i < 0 or highs[i] < n)
        if not new[-1]:
            continue
        if i >= 0 and highs[i] == n - 1:
            highs[i] = n
        else:
            i += 1
            lows.insert(i, n)
            highs.insert(i, n)
        if i + 1 < len(lows) and lows[i + 1] == n + 1:
            highs[i] = highs.pop(i + 1)
            lows.pop(i + 1)
    return new


def once(rows: DataFrame) -> DataFrame:
    """Rows of a stream with each (persistence_id, seq_nr) given the first time it appears, however old it is by then.

    The state of an id is the numbers given, as ranges: one range where there is no gap, so it grows with ids and gaps
    and not with events, and no watermark drops what a long catch-up or a late file brings. Where rows have a source,
    those of backtracking (BT) all pass and don't count.
    """
    exact = {f.name: f.dataType for f in rows.schema.fields if f.name != "seq_nr" and isinstance(f.dataType, (T.LongType, T.TimestampType))}
    # pandas would round nulls' neighbours to doubles and local times at a change of the clock, so these go as text
    sent = rows.withColumns({c: (F.unix_micros(c) if isinstance(t, T.TimestampType) else F.col(c)).cast("string") for c, t in exact.items()})

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lows, highs = map(list, state.get) if state.exists else ([], [])
        for part in parts:
            again = part["source"].eq("BT") if "source" in part else pd.Series(False, part.index)
            new = pd.Series(_new_numbers(lows, highs, part.loc[~again, "seq_nr"].tolist()), part.index[~again], dtype=bool)
            yield part[again | new.reindex(part.index, fill_value=False)]
        state.update((lows, highs))

    given = sent.groupBy("persistence_id").applyInPandasWithState(run, sent.schema, "lows array<bigint>, highs array<bigint>", "append", GroupStateTimeout.NoTimeout)
    return given.withColumns({c: F.timestamp_micros(F.col(c).cast("long")) if isinstance(t, T.TimestampType) else F.col(c).cast("long") for c, t in exact.items()})


def events_by_slices(rows: DataFrame, entity_type: str, min_slice: int, max_slice: int) -> DataFrame:
    """Live events of a type and slice range, each once."""
    checked_range(min_slice, max_slice)
    return once(rows.where((F.col("entity_type") == entity_type) & in_slices(min_slice, max_slice) & ~F.col("deleted")))


def events_starting_from_snapshots(rows: DataFrame, snapshots: DataFrame, entity_type: str, min_slice: int, max_slice: int, transform: Callable[[Column], Column] = lambda s: s) -> DataFrame:
    """The same with events up to an id's snapshot left out and the one it was taken at replaced by it.

    snapshots is a table; the files it has when the stream starts are joined to each batch.
    """
    return replaced_by_snapshots(events_by_slices(rows, entity_type, min_slice, max_slice), snapshots, transform)


def events_by_persistence_id(rows: DataFrame, persistence_id: str, from_seq_nr: int = 0, to_seq_nr: int = 2**63 - 1) -> DataFrame:
    return rows.where((F.col("persistence_id") == persistence_id) & F.col("seq_nr").between(from_seq_nr, to_seq_nr) & ~F.col("deleted"))


def _fields(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)


def late_marked(rows: DataFrame, key: str = "slice") -> DataFrame:
    """(persistence_id, seq_nr, db_timestamp, key, source): BT where a later event of the key had been given before."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest = pd.Timestamp(state.get[0]) if state.exists else pd.Timestamp(0)
        for part in parts:
            part = part.sort_values(["db_timestamp", "seq_nr", "persistence_id"])
            yield part.assign(source=["BT" if t < latest else "" for t in part["db_timestamp"]])
            latest = max(latest, part["db_timestamp"].max())
        state.update((latest.to_pydatetime(),))

    columns = ["persistence_id", "seq_nr", "db_timestamp", key]
    return rows.select(*columns).groupBy(key).applyInPandasWithState(run, _fields(rows, columns) + ", source string", "latest timestamp", "append", GroupStateTimeout.NoTimeout)


def in_sequence(rows: DataFrame) -> DataFrame:
    """(persistence_id, seq_nr): each id's events in gapless order, each once; later ones wait for those missing."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = (state.get[0], set(json.loads(state.get[1]))) if state.exists else (1, set())
        for part in parts:
            waiting |= {int(n) for n in part["seq_nr"] if n >= following}
        out = []
        while following in waiting:
            waiting.remove(following)
            out.append(following)
            following += 1
        state.update((following, json.dumps(sorted(waiting))))
        yield pd.DataFrame({"persistence_id": [k[0]] * len(out), "seq_nr": out})

    return rows.select("persistence_id", "seq_nr").groupBy("persistence_id").applyInPandasWithState(run, "persistence_id string, seq_nr long", "following long, waiting string", "append", GroupStateTimeout.NoTimeout)


def pushed_in_time(rows: DataFrame, window_s: float, key: str = "entity_type") -> DataFrame:
    """Drops pushed rows before the key's first backtracking row and those more than window_s ahead of its latest."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pd.Timestamp(state.get[0]) if state.exists else None
        for part in parts:
            keep = []
            for source, t in zip(part["source"], part["db_timestamp"], strict=True):
                if source in ("BT", "HB"):
                    known = t if known is None else max(known, t)
                keep.append(source != "HB" and (source != "PS" or (known is not None and (t - known).total_seconds() <= window_s)))
            yield part[keep]
        if known is not None:
            state.update((known.to_pydatetime(),))

    columns = [key, "persistence_id", "seq_nr", "db_timestamp", "source"]
    return rows.select(*columns).groupBy(key).applyInPandasWithState(run, _fields(rows, columns), "known timestamp", "append", GroupStateTimeout.NoTimeout)


def changes_by_slices(rows: DataFrame, entity_type: str, min_slice: int, max_slice: int) -> DataFrame:
    """State changes of a type and slice range as they appear."""
    checked_range(min_slice, max_slice)
    kind = F.when(F.col("state_ser_id") == 0, "deleted").otherwise("updated")
    return rows.where((F.col("entity_type") == entity_type) & in_slices(min_slice, max_slice)).withColumn("change_type", kind)


def state_stream(spark: SparkSession, path: str) -> DataFrame:
    return stream(spark, path, STATE)


def handled(rows: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, refresh: str = "3 seconds"):
    """Starts a query that gives each batch to a change handler; a batch that fails is given again."""
    return rows.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(processingTime=refresh).start()


def heartbeat(entity_type: str, min_slice: int, nth: int) -> str:
    """Persistence id of a heartbeat: made so that it hashes to the first slice of its range."""
    n = 0
    while True:
        pid = f"{entity_type}|_hb-{nth}-{n}"
        h = 0
        for unit in array("H", pid.encode("utf-16")[2:]):
            h = (h * 31 + unit) % (1 << 32)
        if abs((h - (1 << 32) if h >= 1 << 31 else h)) % 1024 == min_slice:
            return pid
        n += 1


def drained(rows: DataFrame, folder: str) -> DataFrame:
    """All that a stream gives for the files there are now, by way of files in folder."""
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/out")

"""Slices: every persistence id belongs to one of 1024, and all range queries go by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SLICES = 1024
SEPARATOR = "|"
_WORD = 1 << 32


def slice_for(persistence_id: Column | str) -> Column:
    """abs(h % 1024), h being the 31-polynomial over UTF-16 units in 32-bit arithmetic.

    Built from higher-order functions; tables store the result, so it runs once for each row at ingest.
    """
    pid = F.col(persistence_id) if isinstance(persistence_id, str) else persistence_id

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high, low = F.lit(0xD800) + F.floor((code - 0x10000) / 1024).cast("long"), F.lit(0xDC00) + (code - 0x10000) % 1024
        return F.when(code < 0x10000, (a * 31 + code) % _WORD).otherwise(((a * 31 + high) % _WORD * 31 + low) % _WORD)

    h = F.aggregate(F.filter(F.split(pid, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return F.abs(F.when(h >= _WORD // 2, h - _WORD).otherwise(h) % SLICES).cast("int")


def entity_type_of(persistence_id: Column | str) -> Column:
    """What stands before the separator; without one, the empty type."""
    pid = F.col(persistence_id) if isinstance(persistence_id, str) else persistence_id
    at = F.instr(pid, SEPARATOR)
    return F.when(at > 0, F.substring_index(pid, SEPARATOR, 1)).otherwise(F.lit(""))


def slice_ranges(n: int) -> list[tuple[int, int]]:
    """n contiguous ranges of equal size; n must divide the number of slices."""
    if n < 1 or SLICES % n:
        raise ValueError(f"the number of ranges must divide {SLICES}, got {n}")
    size = SLICES // n
    return [(i * size, i * size + size - 1) for i in range(n)]


def checked_range(min_slice: int, max_slice: int, partitions: int = 1, strict: bool = False) -> None:
    """Slices are 0 to 1023 in order; strict also asks that a range lies within one data partition."""
    if not 0 <= min_slice <= max_slice < SLICES:
        raise ValueError(f"slice range {min_slice}-{max_slice} isn't within 0-{SLICES - 1}")
    width = SLICES // partitions
    if strict and min_slice // width != max_slice // width:
        raise ValueError(f"slice range {min_slice}-{max_slice} spans data partitions of {width} slices")


def data_partition(slice_col: Column | str, partitions: int) -> Column:
    if partitions < 1 or SLICES % partitions:
        raise ValueError(f"the number of data partitions must divide {SLICES}, got {partitions}")
    s = F.col(slice_col) if isinstance(slice_col, str) else slice_col
    return F.floor(s / (SLICES // partitions)).cast("int")


def in_slices(min_slice: int, max_slice: int) -> Column:
    return F.col("slice").between(min_slice, max_slice)


def topic(entity_type: Column | str, slice_col: Column | str, topics: int = 128, prefix: str = "events") -> Column:
    """Name of the publish topic of a row: its type and slice range."""
    size = SLICES // topics
    s = F.col(slice_col) if isinstance(slice_col, str) else slice_col
    low = (F.floor(s / size) * size).cast("int")
    t = F.col(entity_type) if isinstance(entity_type, str) else entity_type
    return F.concat_ws("-", F.lit(prefix), t, low.cast("string"), (low + size - 1).cast("string"))

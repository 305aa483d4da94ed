"""Fixed schemas of the three tables and of what queries return."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*spec: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, null) for name, kind, null in spec])


_TEXT, _LONG, _INT, _TIME, _BYTES, _TAGS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType(), T.BinaryType(), T.ArrayType(T.StringType())
_META = (("meta_ser_id", _INT, True), ("meta_ser_manifest", _TEXT, True), ("meta_payload", _BYTES, True))

JOURNAL = _fields(
    ("slice", _INT, False), ("entity_type", _TEXT, False), ("persistence_id", _TEXT, False), ("seq_nr", _LONG, False), ("db_timestamp", _TIME, False),
    ("event_ser_id", _INT, False), ("event_ser_manifest", _TEXT, False), ("event_payload", _BYTES, True), ("deleted", T.BooleanType(), False), ("writer", _TEXT, False),
    ("adapter_manifest", _TEXT, True), ("tags", _TAGS, True), *_META,
)

SNAPSHOT = _fields(
    ("slice", _INT, False), ("entity_type", _TEXT, False), ("persistence_id", _TEXT, False), ("seq_nr", _LONG, False), ("db_timestamp", _TIME, True),
    ("write_timestamp", _LONG, False), ("ser_id", _INT, False), ("ser_manifest", _TEXT, False), ("snapshot", _BYTES, False), ("tags", _TAGS, True), *_META,
)

STATE = _fields(
    ("slice", _INT, False), ("entity_type", _TEXT, False), ("persistence_id", _TEXT, False), ("revision", _LONG, False), ("db_timestamp", _TIME, False),
    ("state_ser_id", _INT, False), ("state_ser_manifest", _TEXT, True), ("state_payload", _BYTES, False), ("tags", _TAGS, True),
)

PROGRESS = _fields(("persistence_id", _TEXT, False), ("event_seq_nr", _LONG, True), ("snapshot_seq_nr", _LONG, True), ("state_revision", _LONG, True))

#: Key columns of each table: at most one live row for each.
KEYS = {"journal": ("persistence_id", "seq_nr"), "snapshot": ("persistence_id",), "state": ("persistence_id",), "progress": ("persistence_id",)}
SCHEMAS = {"journal": JOURNAL, "snapshot": SNAPSHOT, "state": STATE, "progress": PROGRESS}

#: Where a row of a query comes from.
SOURCES = {"query": "", "backtracking": "BT", "pubsub": "PS", "snapshot": "SN", "heartbeat": "HB"}
#: Serializer id of the marker for events whose payload a producer filtered out.
FILTERED_SER_ID = -1

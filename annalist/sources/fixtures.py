"""Views of the driver's tables as journals, snapshots and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.functions.slices import slice_for

_ZERO = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def moment(ntz: str) -> Column:
    """A zone-less time as the moment it is in UTC."""
    return F.timestamp_micros(F.expr(f"timestampdiff(MICROSECOND, {_ZERO}, {ntz})"))


def zoneless(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(_ZERO))


def journal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    pid = F.concat_ws("|", "event_type", F.col("user_id").cast("string"))
    order = Window.partitionBy("persistence_id").orderBy("ts", "event_id")
    tags = F.when(F.col("value") > 100, F.array(F.col("event_type"), F.lit("hi"))).otherwise(F.array("event_type"))
    return rows.withColumn("persistence_id", pid).select(
        slice_for("persistence_id").alias("slice"), F.col("event_type").alias("entity_type"), "persistence_id", F.row_number().over(order).cast("long").alias("seq_nr"), moment("ts").alias("db_timestamp"), F.lit(1).alias("event_ser_id"),
        F.lit("").alias("event_ser_manifest"), F.col("props").cast("binary").alias("event_payload"), F.lit(False).alias("deleted"), F.lit("").alias("writer"), F.lit(None).cast("string").alias("adapter_manifest"), F.array_sort(tags).alias("tags"),
        F.lit(None).cast("int").alias("meta_ser_id"), F.lit(None).cast("string").alias("meta_ser_manifest"), F.lit(None).cast("binary").alias("meta_payload"), "event_id", "user_id", "value",
    )


def journal_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every tenth user is a tombstone."""
    top = F.max("seq_nr").over(Window.partitionBy("persistence_id"))
    return journal_events(spark, sf_dir).withColumn("_top", top).withColumn("deleted", (F.col("user_id") % 10 == 0) & (F.col("seq_nr") == F.col("_top"))).drop("_top")


def journal_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many events share a time here, which is a day."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("persistence_id", F.concat(F.lit("Customer|"), F.col("o_custkey").cast("string")))
    order = Window.partitionBy("persistence_id").orderBy("o_orderdate", "o_orderkey")
    return rows.select(slice_for("persistence_id").alias("slice"), F.lit("Customer").alias("entity_type"), "persistence_id", F.row_number().over(order).cast("long").alias("seq_nr"), moment("o_orderdate").alias("db_timestamp"), F.lit(1).alias("event_ser_id"), F.col("o_orderstatus").cast("binary").alias("event_payload"), F.lit(False).alias("deleted"), F.array("o_orderpriority").alias("tags"), "o_orderkey")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each id a snapshot of the event whose number is the last multiple of five."""
    rows = journal_events(spark, sf_dir).withColumn("_top", F.max("seq_nr").over(Window.partitionBy("persistence_id")))
    hit = rows.where((F.col("seq_nr") == F.floor(F.col("_top") / 5) * 5) & (F.col("seq_nr") > 0))
    return hit.select("slice", "entity_type", "persistence_id", "seq_nr", "db_timestamp", F.unix_millis("db_timestamp").alias("write_timestamp"), F.lit(1).alias("ser_id"), F.lit("").alias("ser_manifest"), F.concat(F.lit("snap:"), F.col("event_payload").cast("string")).cast("binary").alias("snapshot"), "tags", *(F.col(c) for c in ("meta_ser_id", "meta_ser_manifest", "meta_payload")))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each id its last event as a state; every seventh revision is a deletion."""
    rows = journal_events(spark, sf_dir).groupBy("persistence_id").agg(F.max_by(F.struct("slice", "entity_type", "db_timestamp", "event_payload", "tags"), "seq_nr").alias("r"), F.max("seq_nr").alias("revision"))
    gone = F.col("revision") % 7 == 0
    return rows.select("r.slice", "r.entity_type", "persistence_id", "revision", "r.db_timestamp", F.when(gone, 0).otherwise(1).alias("state_ser_id"), F.lit("").alias("state_ser_manifest"), F.when(gone, F.lit(b"")).otherwise(F.col("r.event_payload")).alias("state_payload"), "r.tags")


def envelopes_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a reader may see them: pushed ones, backtracking copies and heartbeats among them, in order of n."""
    rows = journal_events(spark, sf_dir).select("entity_type", "persistence_id", "seq_nr", "db_timestamp", "event_id")
    k = F.col("event_id")
    base = rows.select("*", F.when(k % 3 == 0, "PS").when(k % 11 == 1, "HB").otherwise("").alias("source"), (k * 2).alias("n"))
    again = rows.where(k % 4 == 0).select("*", F.lit("BT").alias("source"), (k * 2 + 9).alias("n"))
    twice = rows.where(k % 5 == 0).select("*", F.lit("").alias("source"), (k * 2 + 21).alias("n"))
    return base.unionByName(again).unionByName(twice)

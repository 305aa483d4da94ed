"""What the operators of this subpackage share: table access, the shared work folder, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word pattern here: space, tab, LF, VT, FF, CR (what ``bytes.split`` splits on).
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor and the driver share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "/tmp/checkpoints/annalist"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/annalist-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, null text as empty; other columns, whatever their names, fall away."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def words(text: str) -> list[bytes]:
    """Words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "replace").split()


def lower_words(text: str) -> list[bytes]:
    """The same with A-Z in lower case and no other letter changed."""
    return text.encode("utf-8", "replace").lower().split()


def slices(batches: Iterator[pa.RecordBatch], columns: int = 2, rows: int = 2000) -> Iterator[list]:
    """Python lists of the first columns of Arrow batches, a bounded number of rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(i).to_pylist() for i in range(columns)]


def row_ids() -> Iterator[int]:
    """Numbers that are unique within a job and the same again when a task is repeated."""
    context = TaskContext.get()
    n = (context.partitionId() if context else 0) << 40
    while True:
        yield n
        n += 1


def added(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def components(links: DataFrame) -> DataFrame:
    """Connected components of links(a, b) as (id, comp), comp the smallest id of each.

    Alternating large-star and small-star steps; a step is a grouped minimum and a join, so no component is
    gathered anywhere. Each round is written to the shared folder. Goes on until the edges no longer change, which is
    when all are stars; every round before brings some id nearer to its smallest.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, ()
    while before != now:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = stored(small, "edges")
        before, now = now, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    return edges.groupBy("a").agg(F.min("b").alias("comp")).select(F.col("a").alias("id"), "comp").unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())

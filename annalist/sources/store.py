"""Where the tables live: Parquet folders, published together by one numbered commit file.

A commit names the folders that make up each table. Appends add a folder, rewrites replace the list or, of one type and
slice range, only the folders of its data partitions. Commit n + 1 is written aside and renamed to its name, which can
be taken only once, so no reader meets half of it, and of two writers that began at n one fails and may try again (on a
local file system, which has no such rename, only if they don't meet in the same instant). States, the events that tell
of them and a handler's own tables thus change in one step or not at all. Files are dealt by entity type and data
partition and sorted by slice and time, so slice and time ranges prune folders, row groups and pages.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.functions.slices import SLICES, checked_range, data_partition
from annalist.sources.schema import SCHEMAS


class CommitLost(RuntimeError):
    """Another writer published first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, partitions: int = 4, tables: dict[str, str] | None = None):
        """tables maps an entity type to a journal or state table of its own."""
        data_partition("slice", partitions)
        self.spark, self.root, self.partitions, self.own = spark, root.rstrip("/"), partitions, tables or {}
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        log = self._path("_commits")
        return max((int(s.getPath().getName().split(".")[0]) for s in self.fs.listStatus(log) if s.getPath().getName()[0] not in "._"), default=0) if self.fs.exists(log) else 0

    def _tables(self, version: int) -> dict[str, list[str]]:
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{version:012d}.json", wholetext=True).first()[0])["tables"] if version else {}

    def read(self, table: str, version: int | None = None) -> DataFrame:
        folders = self._tables(self.version() if version is None else version).get(table, [])
        schema = SCHEMAS.get(table)
        if not folders:
            if schema is None:
                raise KeyError(f"no table {table}")
            return self.spark.createDataFrame([], schema)
        return self._folders(table, folders).drop("data_partition")

    def _folders(self, table: str, folders: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*(f"{self.root}/{f}" for f in folders)).drop("batch")

    def journal(self, min_slice: int = 0, max_slice: int = SLICES - 1, table: str = "journal", strict: bool = False) -> DataFrame:
        """The journal, with folders outside a slice range left out; strict refuses a range over several partitions."""
        checked_range(min_slice, max_slice, self.partitions, strict)
        folders = self._tables(self.version()).get(table, [])
        if not folders:
            return self.read(table)
        width = SLICES // self.partitions
        rows = self._folders(table, folders)
        return rows.where(F.col("data_partition").between(min_slice // width, max_slice // width) & F.col("slice").between(min_slice, max_slice)).drop("data_partition")

    def table_of(self, kind: str, entity_type: str) -> str:
        return self.own.get(entity_type, kind)

    def _written(self, table: str, rows: DataFrame) -> str:
        name = f"{table}/batch={uuid.uuid4().hex}"
        if {"slice", "entity_type", "persistence_id"} <= set(rows.columns):
            rows = rows.withColumn("data_partition", data_partition("slice", self.partitions))
            order = [c for c in ("entity_type", "data_partition", "slice", "db_timestamp") if c in rows.columns]
            rows.repartitionByRange(*order[:3], "persistence_id").sortWithinPartitions(*order).write.partitionBy("entity_type", "data_partition").parquet(f"{self.root}/{name}")
        else:
            rows.write.parquet(f"{self.root}/{name}")
        return name

    def commit(self, appends: dict[str, DataFrame] | None = None, rewrites: dict[str, DataFrame] | None = None, handler: Callable[[Store], dict[str, DataFrame]] | None = None, base: int | None = None) -> int:
        """Publishes all of these or none. handler gives rewrites of its own tables; if it fails, so does the commit."""
        base = self.version() if base is None else base
        tables = self._tables(base)
        if handler is not None:
            rewrites = {**(rewrites or {}), **handler(self)}
        added = {table: self._written(table, rows) for table, rows in (appends or {}).items()}
        for table, name in added.items():
            tables[table] = [*tables.get(table, []), name]
        for table, rows in (rewrites or {}).items():
            tables[table] = [self._written(table, rows)]
        return self._publish(base, tables, added)

    def change_slices(self, table: str, entity_type: str, min_slice: int, max_slice: int, change: Callable[[DataFrame], DataFrame], base: int | None = None) -> int:
        """Rewrites a type's data partitions that a slice range touches by change(their rows); all other folders stay."""
        checked_range(min_slice, max_slice)
        base = self.version() if base is None else base
        tables, width = self._tables(base), SLICES // self.partitions
        touched, kept = [], []
        for folder in tables.get(table, []):
            for leaf in self._leaves(folder):
                at = dict(unquote(p).split("=", 1) for p in leaf.split("/")[1:])
                mine = at["entity_type"] == entity_type and min_slice // width <= int(at["data_partition"]) <= max_slice // width
                (touched if mine else kept).append(leaf)
        if touched:
            # a type that looks like a number is read as text, as it was written
            rows = self._folders(table, touched).withColumn("entity_type", F.col("entity_type").cast("string")).drop("data_partition")
            tables[table] = [*kept, self._written(table, change(rows))]
        return self._publish(base, tables, {})

    def _leaves(self, folder: str) -> list[str]:
        """The folders of single data partitions in a folder: itself, where it is one."""
        if "/data_partition=" in folder:
            return [folder]
        below = lambda f: [f"{f}/{s.getPath().getName()}" for s in self.fs.listStatus(self._path(f)) if s.isDirectory()]
        return [leaf for t in below(folder) for leaf in below(t)]

    def _publish(self, base: int, tables: dict[str, list[str]], added: dict[str, str]) -> int:
        aside, target = self._path(f"_commits/_{uuid.uuid4().hex}"), self._path(f"_commits/{base + 1:012d}.json")
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": base + 1, "tables": tables, "appended": added}).encode()))
        out.close()
        hadoop = self.jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, target, none)
        except Exception as e:
            self.fs.delete(aside, False)
            raise CommitLost(f"commit {base + 1} exists already") from e
        return base + 1

    def follow(self, table: str, handler: Callable[[DataFrame, int], None], checkpoint: str, commits_per_batch: int = 100, **trigger):
        """Starts a query that gives handler(rows, n) what commits append to the table, those there and those to come.

        It reads the log of commits, so rows of a lost commit are never given, nor are rewritten rows again.
        """
        log = self.spark.readStream.schema("value string").option("wholetext", True).option("maxFilesPerTrigger", commits_per_batch).text(f"{self.root}/_commits")

        def batch(found: DataFrame, n: int) -> None:
            commits = sorted((json.loads(r[0]) for r in found.collect()), key=lambda c: c["version"])  # commits_per_batch at most
            folders = [c["appended"][table] for c in commits if table in c["appended"]]
            if folders:
                handler(self._folders(table, folders).drop("data_partition"), n)

        return log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()

    def register(self) -> None:
        """Tables as views, for SQL."""
        for table in {*self._tables(self.version()), "journal", "snapshot", "state"}:
            self.read(table).createOrReplaceTempView(table)

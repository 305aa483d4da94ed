"""WARC archives: writing, reading back, and an external merge of their capture indexes.

Writing: Spark's text writer puts down one record a row, with the record end as line end, so archives go wherever
Spark can write. Of equal payloads of at least MIN_BYTES the one with the largest id is stored, others are revisits
that name it. Reading: files are bounded by FILE_RECORDS and parsed by Content-Length.

Merging: each archive's captures, sorted by (URL key, time, id), are one run, stored in blocks of BLOCK rows with each
row knowing the last key of the block before its own. The runs are dealt out by ranges of the order, sampled by Spark,
at most about RANGE_ROWS rows each, so a URL with a third of all captures spans several ranges. Within a range the
blocks come sorted by that last key before them. That is the order in which a merge runs out of blocks, so a loser tree
over all runs of the range takes its next block from the stream whenever a run's block is used up: a task holds one
block of each run and never its range. The ranges together are one globally ordered capture history; a capture's rank
is its place in its range and the rows of the ranges before.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from annalist.llm.common import stored, work_dir

MIN_BYTES = 1000
FILE_RECORDS = 1500
#: Rows of a block, and about so many rows to a range at most.
BLOCK, RANGE_ROWS = 64, 500_000
#: The capture time of a page without one: this moment and its id in seconds.
EPOCH = "2020-01-01 00:00:00"
END = "\r\n\r\n"
RUN = "run string, urlkey string, captured string, page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, position long"
ORDER = ("urlkey", "captured", "page_id")
#: The last key of the block before, empty for a run's first block.
BEFORE = "before_urlkey string, before_captured string, before_none boolean, before_id long, before_run string, before_position long"


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", captured_col: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One column, value: a WARC record without its end, of each row."""
    when = F.expr(f"timestampadd(SECOND, coalesce(pmod(page_id, 1000000000), 0), TIMESTAMP_NTZ'{EPOCH}')") if captured_col is None else F.col(captured_col).cast("timestamp_ntz")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col).cast("string"), "[\\x00-\\x20]", "%20").alias("uri"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), *([] if captured_col is None else [F.col(captured_col)]))
    rows = rows.select("page_id", "uri", "payload", F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"), F.sha1(F.col("payload").cast("binary")).alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    # the key of equal payloads; a small payload's key is null, which meets nothing
    key = F.when(F.col("bytes") >= min_bytes, F.concat_ws("-", F.sha2(F.col("payload").cast("binary"), 256), "bytes"))
    rows = rows.withColumn("key", key)
    kept = rows.where("key is not null and page_id is not null").groupBy("key").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "keeper")
    rows = rows.join(kept, F.col("key") == F.col("k"), "left")
    revisit = F.coalesce((F.col("keeper") != F.col("page_id")) | F.col("page_id").isNull(), F.lit(False)) & F.col("keeper").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return rows.select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\n"),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">"))),
        _line("WARC-Date", F.col("captured")), _line("WARC-Target-URI", F.col("uri")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("keeper").cast("string"), F.lit(">")))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    ).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Writes the rows as .warc files, gzipped, into path, a folder that all executors share."""
    records(pages, **columns).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def url_key(uri: str | None) -> str:
    """Sort key of a URL: host parts from the top, then the path; scheme, www, port, fragment and case don't count."""
    if not uri:
        return ""
    rest = uri.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + slash + path.lower()


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes, int]]:
    """(headers, HTTP head, payload, position) of each record of an archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    at = 0
    while line := stream.readline():
        begin, at = at, at + len(line)
        if not line.startswith(b"WARC/"):
            if line.strip():
                raise ValueError(f"not a WARC record at {begin}")
            continue
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            at += len(line)
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        at += len(line) + len(block)
        head, _, payload = block.partition(b"\r\n\r\n")
        yield headers, head, payload, begin


def _number(urn: str | None) -> int | None:
    last = (urn or "").strip("<>").rpartition(":")[2]
    return int(last) if last.lstrip("-").isdigit() else None


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            run, rows = path.as_py().rpartition("/")[2], []
            for h, head, payload, at in parsed(content.as_py()):
                digest = h["warc-payload-digest"].removeprefix("sha1:")
                length = int(head.rpartition(b":")[2])
                if h["warc-type"] == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{run}: the payload at {at} isn't the one that was written")
                uri = h.get("warc-target-uri")
                rows.append((run, url_key(uri), h["warc-date"], _number(h["warc-record-id"]), uri, length, digest, h["warc-type"], _number(h.get("warc-refers-to")), at))
            rows.sort(key=_order)
            yield _batch(rows, [_order(rows[i // BLOCK * BLOCK - 1]) if i >= BLOCK else (None,) * 6 for i in range(len(rows))])


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is None, row[3] or 0, row[0], row[9]


def _batch(rows: list[tuple], more: list[tuple], also: str = BEFORE) -> pa.RecordBatch:
    """rows with the columns of more behind them."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    spec = [x.split() for x in f"{RUN}, {also}".split(", ")]
    wide = len(RUN.split(", "))
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows] if i < wide else [x[i - wide] for x in more], kinds[k]) for i, (_, k) in enumerate(spec)], [n for n, _ in spec])


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.head = [self._next(i) for i in range(self.k)]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, i: int) -> None:
        node, winner = (i + self.k) // 2, i
        while node > 0:
            if self.tree[node] < 0:  # the first to come waits here
                self.tree[node] = winner
                return
            if self._less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and (got := self.head[w := self.tree[0]]) is not None:
            yield got[1]
            self.head[w] = self._next(w)
            self._play(w)


class Blocks:
    """Runs of a stream of rows whose blocks come in the order in which a merge needs them."""

    def __init__(self, rows: Iterator[tuple]):
        self.rows, self.ahead, self.held, self.most = rows, next(rows, None), 0, 0

    def _block(self) -> tuple[str, list[tuple]]:
        """The next block of the stream: rows of one run with the same key before them."""
        wide = len(RUN.split(", "))
        run, before, block = self.ahead[0], self.ahead[wide:], []
        while self.ahead is not None and self.ahead[0] == run and self.ahead[wide:] == before:
            block.append(self.ahead[:wide])
            self.ahead = next(self.rows, None)
        self.held += len(block)
        self.most = max(self.most, self.held)
        return run, block

    def _run(self, run: str, block: list[tuple]) -> Iterator[tuple]:
        while block:
            yield from block
            self.held -= len(block)
            # the run's next block, if it has one here, is the next of the stream: all others run out later
            block = self._block()[1] if self.ahead is not None and self.ahead[0] == run else []

    def runs(self) -> list[Iterator[tuple]]:
        """One iterator a run. First blocks have keys of other ranges, or none, before them, so they come first."""
        first: dict[str, list[tuple]] = {}
        while self.ahead is not None and self.ahead[0] not in first:
            run, block = self._block()
            first[run] = block
        return [self._run(run, block) for run, block in first.items()]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the runs of one range."""
    part = TaskContext.get().partitionId()
    stream = (row for b in batches for at in range(0, b.num_rows, 1000) for row in zip(*(c.to_pylist() for c in b.slice(at, 1000).columns), strict=True))
    rows, at = [], 0
    for row in LoserTree(Blocks(stream).runs(), _order):
        rows.append(row)
        if len(rows) == 10_000:
            yield _batch(rows, [(part, at + i) for i in range(len(rows))], "part int, place long")
            at, rows = at + len(rows), []
    yield _batch(rows, [(part, at + i) for i in range(len(rows))], "part int, place long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives in path, one sorted run an archive, with payloads checked against digests."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(_captures, f"{RUN}, {BEFORE}")


def capture_history(spark: SparkSession, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order of (URL key, time, id): rank, from 0, and part and place within it."""
    runs = stored(read_archives(spark, path), "runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-runs.count() // range_rows))
    before = [F.col(x.split()[0]).asc_nulls_first() for x in BEFORE.split(", ")]
    dealt = runs.repartitionByRange(ranges, "urlkey", "captured", F.col("page_id").asc_nulls_last()).sortWithinPartitions(*before, "run", "urlkey", "captured", F.col("page_id").asc_nulls_last(), "position")
    merged = stored(dealt.mapInArrow(_merged, f"{RUN}, part int, place long"), "merged")
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    return merged.join(F.broadcast(sizes.select("part", offset.alias("offset"))), "part").withColumn("rank", F.col("offset") + F.col("place")).drop("offset")


def archived(pages: DataFrame, range_rows: int = RANGE_ROWS, **columns) -> DataFrame:
    """Writes the pages as archives into the shared folder and returns the capture history read back from them.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, urlkey, captured, rank, part, place. rank
    counts from 0 in the order of URL key, time and id, nulls last; captures equal in all three come by archive.
    A null payload is empty. A page without id is stored as urn:page:none, comes back with a null id and never is the
    one that others revisit, unless no equal page has an id, when all are responses. A null URL has the empty key.
    Repeated rows with one id are all responses where theirs is the largest id. White space in URLs is escaped. Other
    columns of pages, whatever their names, are left out. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{work_dir(spark)}/archives"
    write_archives(pages, path, **columns)
    return capture_history(spark, path, range_rows).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "rank", "part", "place")

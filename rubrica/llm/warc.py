"""WARC archives: a writer on Spark's text sink and a reader as a PySpark Python data source.

Writing: a record is built column-wise and written with Spark's own file writer, so any store that Spark reaches will do
and a lost task is simply run again. Of records with equal payloads of ``least`` bytes or more, one carries the payload
and the others are revisit records that refer to it.

Reading (``format("warc")``): the driver lists files and sizes and packs them into partitions; equality and IN filters on
header columns are pushed down (``spark.sql.python.filterPushdown.enabled``); a task parses a record's headers first and
seeks over the block of any record that no filter wants, so unwanted payloads are neither read nor decoded.

Nulls: a null html is an empty payload, a null id or url writes no such header and reads as null; a null id is smaller than
any other, and rows of a group without any id are all responses. Rows that repeat the largest id of a group are all
responses. Other columns, whatever their names, aren't written. An empty table makes an archive without records, which reads as no rows.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .common import scratch_dir, table, written

END = "\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = (
    "record_id string, record_type string, page_id long, target_uri string, record_date string, refers_to long, content_type string, "
    "content_length long, payload_bytes long, payload_digest string, payload binary, file string, offset long"
)
ARROW = pa.schema([(name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind]) for name, kind in (x.split() for x in SCHEMA.split(", "))])
#: Column: header it comes from, by which a record can be refused before its block is read.
HEADER_COLUMNS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "page_id": "x-page-id", "target_uri": "warc-target-uri",
    "record_date": "warc-date", "refers_to": "x-refers-to-page", "content_type": "content-type",
}
LONGS = {"page_id", "refers_to"}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


#: Names that Hadoop has for stores which the reader's file systems know by another.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs"}


def file_system(path: str):
    """(file system, path in it) for a path or URI, in Hadoop's spelling of schemes too."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    scheme, mark, rest = path.partition("://")
    if not mark:
        return fs.LocalFileSystem(), path
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    except (NotImplementedError, pa.ArrowInvalid) as error:
        raise ValueError(f"archives under {scheme}:// can't be opened by tasks; name a folder on one of {sorted(SCHEMES)} or a mounted one") from error


class WarcSource(DataSource):
    """Options: path (a file or folder); payload = none, digest or bytes; partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if isinstance(f, EqualTo | In) and column in HEADER_COLUMNS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, path = file_system(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((x.size, x.path) for x in found if x.is_file and x.size and not x.base_name.startswith(("_", ".")))
        out, own, held = [], [], 0
        for size, name in files:
            if own and held + size > self.partition_bytes:
                out.append(Files(own))
                own, held = [], 0
            own.append((name, size))
            held += size
        return [*out, Files(own)] if own else out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = ARROW
        system, _ = file_system(self.path)
        rows, held = [], 0
        for name, _ in partition.files:
            with system.open_input_file(name) as raw:
                for row in self.records(gzip.open(raw) if name.endswith(".gz") else raw, name):
                    rows.append(row)
                    held += 200 + len(row[10] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def wants(self, columns: dict) -> bool:
        return all(columns[c] in values for c, values in self.wanted.items())

    def records(self, raw, name: str) -> Iterator[tuple]:
        stream = Window(raw)
        while (offset := stream.next_record()) is not None:
            headers = stream.headers()
            length = int(headers.get("content-length", 0))
            columns = {c: headers.get(h) for c, h in HEADER_COLUMNS.items()}
            columns |= {c: int(columns[c]) if columns[c] else None for c in LONGS}
            if not self.wants(columns):
                stream.skip(length)
                continue
            size, digest, payload = headers.get("x-payload-length"), (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None, None
            size = int(size) if size else None
            if self.payload == "none" or columns["record_type"] == "revisit":
                stream.skip(length)
            else:
                block = stream.take(length)
                if (columns["content_type"] or "").startswith("application/http"):
                    block = block.partition(b"\r\n\r\n")[2]
                size, digest = len(block), hashlib.sha1(block).hexdigest()
                payload = block if self.payload == "bytes" else None
            c = columns
            yield c["record_id"], c["record_type"], c["page_id"], c["target_uri"], c["record_date"], c["refers_to"], c["content_type"], length, size, digest, payload, name, offset


class Window:
    """A view of bounded size on a stream: lines of headers, blocks, and jumps over what isn't wanted."""

    CHUNK = 1 << 20

    def __init__(self, raw):
        self.raw, self.held, self.at, self.base = raw, b"", 0, 0

    def more(self) -> bool:
        got = self.raw.read(self.CHUNK)
        self.base += self.at
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def next_record(self) -> int | None:
        """Position of the next record, past empty lines; None at the end."""
        while True:
            while self.held[self.at : self.at + 2] == b"\r\n":
                self.at += 2
            if len(self.held) - self.at >= 2:
                return self.base + self.at
            if not self.more():
                return None

    def headers(self) -> dict[str, str]:
        while (end := self.held.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                raise ValueError("a record's headers are cut off")
        lines = self.held[self.at : end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {self.base + self.at}")
        self.at = end + 4
        out: dict[str, str] = {}
        last = ""
        for line in lines[1:]:
            if line[:1] in " \t" and last:
                out[last] += " " + line.strip()
            else:
                key, _, value = line.partition(":")
                last = key.strip().lower()
                out[last] = value.strip()
        return out

    def take(self, n: int) -> bytes:
        parts = [self.held[self.at : self.at + n]]
        self.at += len(parts[0])
        left = n - len(parts[0])
        if left:
            self.base += self.at
            self.held, self.at = b"", 0
            parts.append(self.raw.read(left))
            self.base += len(parts[1])
            if len(parts[1]) < left:
                raise ValueError("a record's block is cut off")
        return b"".join(parts)

    def skip(self, n: int) -> None:
        here = min(n, len(self.held) - self.at)
        self.at += here
        if n > here:
            self.base += self.at + n - here
            self.held, self.at = b"", 0
            self.raw.seek(n - here, 1)


def one_line(column):
    return F.regexp_replace(column.cast("string"), r"[\r\n]+", " ")


def with_originals(pages: DataFrame, least: int = 1000, broadcast_rows: int = 500_000) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, size and refers_to: the record with the same payload, or null.

    Groups of equal payloads are counted map-side, and only digests that repeat are joined back. Up to ``broadcast_rows``
    of them (about 60 bytes each) are broadcast, so that no payload is shuffled; more go through a shuffled join, where
    adaptive execution splits a hot digest.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    repeated = (
        keyed.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "original")
    )
    repeated = written(repeated)
    if repeated.count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    joined = keyed.join(repeated, "digest", "left")
    other = (F.col("size") >= least) & F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("refers_to", F.when(other, F.col("original"))).drop("original")


def write_warc(pages: DataFrame, path: str, least: int = 1000, records_a_file: int = 20_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """A WARC record for each row of ``pages`` (page_id, url, html), in files under ``path``."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), F.col("size").cast("string"), F.lit(END * 2))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    record = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        maybe("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        maybe("WARC-Target-URI", one_line(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        maybe("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT}{END}")).otherwise(F.lit("")),
        maybe("X-Page-Id", F.col("page_id").cast("string")),
        maybe("X-Refers-To-Page", F.col("refers_to").cast("string")),
        line("X-Payload-Length", F.col("size").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit(END),
        F.col("block"),
    )
    rows = with_originals(pages, least).withColumn("block", block).select(record.alias("value"))
    rows.write.option("lineSep", END * 2).option("maxRecordsPerFile", records_a_file).text(path)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", payload).load(path)


def op10_warc(spark, sf_dir) -> DataFrame:
    path = scratch_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    # a revisit's headers tell all, so only responses' blocks are read
    kinds = (read_warc(spark, path, "digest").where("record_type = 'response'"), read_warc(spark, path, "none").where("record_type = 'revisit'"))
    return kinds[0].unionByName(kinds[1]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS original FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM original AND original IS NOT NULL THEN original END AS refers_to
FROM m
"""

"""Helpers that the operators of this subpackage share: tables, scratch tables, Arrow slices."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import shared_dir

#: Text that a vectorised helper holds at once, which bounds its memory whatever Arrow batch Spark sends.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark's own reader (so any store that Spark reaches will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Made(threading.local):
    """Scratch folders that a thread has made, in order, so that queries in other threads keep theirs."""

    def __init__(self):
        self.folders: list[str] = []


_MADE = _Made()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    _MADE.folders.append(f"{shared_dir(spark)}/rubrica-{uuid.uuid4().hex}")
    return _MADE.folders[-1]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Scratch tables of one call, deleted together by it alone; calls at the same time don't see each other's."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/rubrica-{uuid.uuid4().hex}"
        self.count = 0

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` written to the shared folder and read again, as ``written`` does."""
        self.count += 1
        return written(df, f"{self.folder}/{self.count}")

    def clear(self) -> None:
        """Deletes the tables; nothing lazy may still read them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def mark() -> int:
    """A point to which ``clear`` goes back, in this thread."""
    return len(_MADE.folders)


def clear(spark: SparkSession, since: int, keep: tuple[DataFrame, ...] = ()) -> None:
    """Deletes the scratch folders made since ``mark`` gave that number, but for those that the tables in ``keep`` read.

    Only for tables whose results are written or read already: a lazy table that reads a deleted one fails.
    """
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    held = {name for df in keep for f in df.inputFiles() for name in [part for part in f.split("/") if part.startswith("rubrica-")]}
    for folder in _MADE.folders[since:]:
        if folder.rsplit("/", 1)[1] not in held:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
            _MADE.folders.remove(folder)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows for the session, so that long texts can't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows with about ``max_bytes`` of ``column`` each; one long text makes a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_map(df: DataFrame, columns: list[str], schema: str, fn: Callable[[pa.RecordBatch], dict], column: str) -> DataFrame:
    """``fn`` over slices of ``columns`` of ``df``; it returns the columns of ``schema`` by name. Narrow: no shuffle."""
    arrow_schema = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            out = fn(part)
            yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    spark_schema = StructType.fromDDL(schema)
    arrow_schema = to_arrow_schema(spark_schema)
    return df.select(*columns).mapInArrow(run, spark_schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a column as Python strings, nulls as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]

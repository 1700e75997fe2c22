"""A table that micro-batches append to, each key once: a manifest of batches, and a Bloom filter of keys for each file.

``rows`` holds the data, in a folder for each batch; ``manifest`` has a row for each file of a batch (stream, batch, file,
n, bloom), or one without a file where a batch added nothing. A batch that stands in the manifest is a replay and is left
out; one that ended before its manifest row was written is written anew in its folder. A batch reads only the files whose
filter holds one of its keys, so its cost follows its own keys and the filters, some ten bits a stored key.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "stream string, batch long, file string, n long, bloom binary"
#: Bits of a filter for each key, and bits that a key sets: about one key in a hundred is found in vain.
BITS, PROBES = 10, 7
#: Rows of a file at most, which bounds a filter, and hashes of a batch that go to all tasks; a larger batch asks all files.
FILE_ROWS, ASKED_ROWS = 1_000_000, 1_000_000


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of each hash in a filter of ``bits`` bits: two halves of it, added again and again."""
    h = hashes.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS // 8) * 8)
    out = np.zeros(bits, np.uint8)
    out[_places(hashes, bits).ravel()] = 1
    return np.packbits(out).tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> bool:
    """Whether a filter may hold any of the hashes."""
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8))
    return bool(bits[_places(hashes, len(bits))].all(1).any())


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest") if _exists(spark, f"{path}/manifest") else spark.createDataFrame([], MANIFEST)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the batches that the manifest has."""
    done = manifest(spark, path).where("file IS NOT NULL").select("file")
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("__file", F.col("_metadata.file_path")).join(done, F.col("__file") == F.col("file"), "left_semi").drop("__file", "stream", "batch")


def open_files(known: DataFrame, hashes: DataFrame) -> list[str]:
    """Files of the manifest ``known`` that may hold one of the key hashes (h), a name each; filters are asked in tasks."""
    filed = known.where("file IS NOT NULL")
    if hashes.count() > ASKED_ROWS:
        return [r.file for r in filed.select("file").collect()]
    asked = hashes.sparkSession.sparkContext.broadcast(hashes.toPandas()["h"].to_numpy(np.int64))  # counted above

    def held(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["file"]][[len(asked.value) > 0 and may_hold(b, asked.value) for b in frame["bloom"]]]

    return [r.file for r in filed.select("file", "bloom").mapInPandas(held, "file string").collect()]


def append_unseen(path: str, keys: list[str], stream: str = "") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: appends the rows whose keys the table at ``path`` doesn't have; a batch of ``stream`` that is
    replayed adds nothing. Streams that write to one table need names of their own, and only one may write at a time."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = manifest(spark, path)
        if not known.where((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
            return
        h = F.xxhash64(*keys)
        fresh = batch.dropDuplicates(keys).persist()
        files = open_files(known, fresh.select(h.alias("h")))
        new = fresh
        if files:
            seen = spark.read.schema(fresh.schema).parquet(*files).select(*(F.col(k).alias(f"__{k}") for k in keys))
            same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
            new = fresh.join(seen, functools.reduce(operator.and_, same), "left_anti")
        folder = f"{path}/rows/stream={stream or 'main'}/batch={batch_id}"
        new.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
        fresh.unpersist()
        rows = spark.read.schema(batch.schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), h.alias("h"))

        def filed(frame: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"file": frame["file"][:1], "n": [len(frame)], "bloom": [bloom(frame["h"].to_numpy(np.int64))]})

        made = rows.groupBy("file").applyInPandas(filed, "file string, n long, bloom binary")  # FILE_ROWS hashes at most
        mark = spark.createDataFrame([(None, 0, None)], "file string, n long, bloom binary")
        named = made.unionByName(mark).select(F.lit(stream).alias("stream"), F.lit(batch_id).cast("long").alias("batch"), "file", "n", "bloom")
        named.coalesce(1).write.mode("append").parquet(f"{path}/manifest")  # one file, so that a batch is in it or isn't

    return sink

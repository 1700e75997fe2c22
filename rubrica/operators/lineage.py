"""Cutting lineage, the shared folder that this needs, and row numbers without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. A folder of this machine stands in only for a local master; on a
    cluster it would lose data silently, so its absence raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] == "local":
        return LOCAL_DIR
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _in_order(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` sorted by ranges, with __part and __row, which grows within a part."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(sorted_.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of at most ``rows`` rows for the session, so that long texts can't fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, rows)


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``df`` with its rows' places from 0 by ``order``: a range-partitioned sort, and offsets of a row a partition."""
    placed = _in_order(df, order)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__low"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = sizes.select("__part", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__shift"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def ranked(df: DataFrame, by: str, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """``df`` with its rows' ranks from 1 within ``by``, by ``order``, and, if named, the ``total`` of rows of ``by``.

    Rows are sorted by ranges of (``by``, order), so that a key of many rows lies in several partitions. A key has a row for
    each partition that it is in; those say how many of its rows come before. No task holds a key's rows.
    """
    placed = _in_order(df, [F.col(by), *order])
    sizes = placed.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__low"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # a row a partition
    offsets = sizes.select(F.struct(by).alias("__by"), F.col("__part").alias("__in"), (F.coalesce(before, F.lit(0)) - F.col("__low") + 1).alias("__shift"), F.sum("__n").over(Window.partitionBy(by)).alias("__total"))
    # rows meet their offsets where they lie, part by part: the join is on the part first, so that no key is hot in it
    found = placed.join(offsets, (F.col("__part") == F.col("__in")) & F.struct(by).eqNullSafe(F.col("__by")))
    out = found.withColumn(name, (F.col("__row") + F.col("__shift")).cast("int"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop("__part", "__row", "__by", "__in", "__shift", "__total")

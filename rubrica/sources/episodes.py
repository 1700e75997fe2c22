"""A tree of episode files, ``{budget}/r{rollout}/{qid}.json``, as a data source that tasks write to.

Tasks write each file under its own name into a folder beside the tree; the commit gives that folder the tree's name, in one
step, and an abort deletes it. So a failed job leaves no half tree, a task that runs twice writes the same files again, and
the driver moves no file. Trees of many small files are slow to read again and again: ``compact_episode_tree`` makes them
a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .files import ContractError, _place, read_episode_tree

SCHEMA = "folder string, name string, body string"


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.making = f"{self.root}.making-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        fs, at = _place(self.making)
        made, count = set(), 0
        for folder, name, body in rows:
            if folder not in made:
                fs.create_dir(f"{at}/{folder}", recursive=True)
                made.add(folder)
            with fs.open_output_stream(f"{at}/{folder}/{name}") as out:
                out.write(body.encode())
            count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _place(self.making)
        _, root = _place(self.root)
        if not sum(m.files for m in messages if m):
            fs.create_dir(at, recursive=True)
        fs.move(at, root)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs as kinds

        fs, at = _place(self.making)
        if fs.get_file_info(at).type != kinds.FileType.NotFound:
            fs.delete_dir(at)


class EpisodeTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "episode_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"])


def write_episode_tree(df: DataFrame, root: str) -> None:
    """One file ``{budget}/r{rollout}/{qid}.json`` under ``root``, which must not be there yet, for each row of ``df`` (budget,
    rollout, qid and further fields). Budgets and qids must be file names as they stand, and the three together unique."""
    spark = df.sparkSession
    keys = df.select(*(F.col(c).cast("string").alias(c) for c in ("budget", "rollout", "qid")))
    bad = keys.where(" OR ".join(f"{c} IS NULL OR {c} = '' OR {c} RLIKE '[/\\\\x00]' OR {c} IN ('.', '..')" for c in keys.columns))
    if not bad.isEmpty():
        raise ContractError(f"no file names: {bad.first()}")
    if (twice := keys.groupBy(*keys.columns).count().where("count > 1").first()) is not None:
        raise ContractError(f"stands twice: {twice}")
    fs, at = _place(root)
    if fs.get_file_info(at).type.name != "NotFound":
        raise ContractError(f"{root} is there already")
    folder = F.concat_ws("/", F.col("budget").cast("string"), F.concat(F.lit("r"), F.col("rollout").cast("string")))
    body = F.to_json(F.struct(*(c for c in df.columns if c not in ("budget", "rollout", "qid"))))
    files = df.select(folder.alias("folder"), F.concat(F.col("qid").cast("string"), F.lit(".json")).alias("name"), F.coalesce(body, F.lit("{}")).alias("body"))
    write_tree(files.repartition("folder", "name"), root)


def write_tree(files: DataFrame, root: str) -> None:
    """A file ``{folder}/{name}`` under ``root``, which must not be there yet, for each row of ``files`` (folder, name, body)."""
    files.sparkSession.dataSource.register(EpisodeTree)
    files.write.format("episode_tree").mode("append").option("path", root).save()


def compact_episode_tree(spark: SparkSession, root: str, schema: str, table: str) -> DataFrame:
    """The tree at ``root`` as a Parquet table in folders by budget and rollout, and its rows."""
    read_episode_tree(spark, root, schema).repartition("budget", "rollout", F.pmod(F.xxhash64("qid"), F.lit(16))).write.partitionBy("budget", "rollout").parquet(table)
    return spark.read.schema(f"{schema}, qid string, budget string, rollout int").parquet(table)

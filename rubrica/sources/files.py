"""Readers and writers of session dumps, bundles, episode trees, event logs, corpora and embeddings."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = (
    "number bigint, title string, body string, state string, created_at string, closed_at string, url string, labels array<string>, author string, author_type string, "
    "comment_count bigint, comments array<struct<author:string,author_type:string,created_at:string,body:string>>"
)
BUNDLE = (
    "id string, topic string, question string, gold_answer string, rubric array<struct<claim_id:string,claim_type:string,weight:int,statement:string,span_ids:array<string>>>, "
    "evidence array<struct<span_id:string,path:string,start_line:int,end_line:int,excerpt:string>>"
)
EVENT = (
    "type string, thread_id string, item struct<id:string,type:string,command:string,text:string>, "
    "usage struct<input_tokens:bigint,cached_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint>, _corrupt_record string"
)
MAX_FILE_BYTES = 5_000_000
#: Bytes of files that a task hands on at once.
BATCH_BYTES = 16 << 20
TREE = r"([^/]+)/r(\d+)/([^/]+)\.json$"


class ContractError(ValueError):
    """Data that breaks a documented contract."""


def read_sessions(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """A row for each session of snapshot files ({…, sessions: […]}), times parsed; repeated numbers raise.

    A snapshot is one JSON document, which one task reads; ``partitions`` deals its sessions out.
    """
    raw = spark.read.schema(f"repository string, sessions array<struct<{_struct(SESSION)}>>").json(path, multiLine=True)
    rows = raw.select(F.explode("sessions").alias("s")).select("s.*")
    rows = rows.withColumns({c: F.try_to_timestamp(c) for c in ("created_at", "closed_at")})
    rows = rows.repartition(partitions) if partitions else rows
    twice = rows.groupBy("number").count().where("count > 1").limit(5).collect()
    if twice:
        raise ContractError(f"repeated session numbers, such as {[r.number for r in twice]}")
    return rows


def _struct(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString()[len("struct<") : -1]


def session_profile(df: DataFrame) -> DataFrame:
    """session_count and states: a map from state to count."""
    states = df.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return states.agg(F.sum("n").alias("session_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("state", "n")))).alias("states"))


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Question bundles from JSON lines; blank lines don't count, malformed ones raise."""
    return spark.read.schema(BUNDLE).json(path, mode="FAILFAST")


def read_episode_tree(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Rows of ``{budget}/r{rollout}/{qid}.json`` under ``root``, with budget, rollout and qid taken from the path."""
    rows = spark.read.schema(schema).json(root, multiLine=True, recursiveFileLookup=True).withColumn("__path", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    part = lambda i: F.regexp_extract("__path", TREE, i)
    return rows.where(F.col("__path").rlike(TREE)).withColumns({"budget": part(1), "rollout": part(2).cast("int"), "qid": part(3)}).drop("__path")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Agent events from JSON lines, malformed lines left out, with ``session`` from the file's name."""
    rows = spark.read.schema(EVENT).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", recursiveFileLookup=True)
    named = rows.withColumn("session", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl?)?$", 1))
    return named.where("_corrupt_record IS NULL").drop("_corrupt_record")


def text_of(content: Column) -> Column:
    """UTF-8 text of bytes, malformed parts replaced."""
    return F.make_valid_utf8(content.cast("string"))


def _place(path: str):
    """(file system, path in it) of a path or address."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _reached(root: str) -> bool:
    """Whether pyarrow knows the store of ``root``."""
    try:
        _place(root)
    except (ValueError, OSError):
        return False
    return True


def _hidden(path: str) -> bool:
    """Whether Spark's readers pass a path by."""
    return any(p.startswith(".") or p.endswith("._COPYING_") or p.startswith("_") and "=" not in p for p in path.split("/"))


def _contents(spark: SparkSession, root: str, roots: list[str], most_bytes: int) -> DataFrame:
    """path, n_bytes, content: a task lists each of ``roots``, then the paths are dealt out and tasks read the files."""
    root = root.rstrip("/")
    store, top = _place(root)
    if store.get_file_info(top).type.name == "NotFound":
        raise ContractError(f"there is no {root}")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _place(root)
        for batch in batches:
            for r in batch.column("root").to_pylist():
                if store.get_file_info(f"{top}/{r}").type != fs.FileType.Directory:
                    continue
                found = store.get_file_info(fs.FileSelector(f"{top}/{r}", recursive=True))
                kept = ((x.path[len(top) + 1 :], x.size) for x in found if x.type == fs.FileType.File and x.size <= most_bytes)
                while rows := [x for x in itertools.islice(kept, 10_000)]:
                    paths, sizes = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "n_bytes"]).filter(pa.array([not _hidden(p) for p in paths]))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _place(root)
        for batch in batches:
            held, size, start = [], 0, 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                with store.open_input_stream(f"{top}/{path}") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([part.column("path"), part.column("n_bytes"), pa.array(held, pa.binary())], ["path", "n_bytes", "content"])
                    held, size, start = [], 0, i + 1

    names = spark.createDataFrame([(r.strip("/"),) for r in dict.fromkeys(roots)], "root string").repartition("root")
    paths = names.mapInArrow(listed, "path string, n_bytes long").distinct()  # a path may lie under several roots
    return paths.repartition(spark.sparkContext.defaultParallelism * 4, "path").mapInArrow(read, "path string, n_bytes long, content binary")


def read_corpus(spark: SparkSession, root: str, roots: list[str], most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, n_bytes, text of files under ``roots`` of ``root``: up to ``most_bytes``, without NUL in their first 8 KiB.

    In stores that pyarrow reaches, tasks list and open the files (``_contents``); in others Spark's reader does, whose driver
    lists them, and which passes empty files by.
    """
    if _reached(root):
        found = _contents(spark, root, roots, most_bytes)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        relative = F.regexp_replace("path", f"^.*?{_quoted(root.rstrip('/').rsplit('/', 1)[-1])}/", "")
        found = files.where(F.col("length") <= most_bytes).select(relative.alias("path"), F.col("length").alias("n_bytes"), "content")
    under = F.lit(False)
    for r in roots:
        under = under | F.col("path").startswith(r.rstrip("/") + "/")
    binary = F.expr("locate(cast(X'00' as string), cast(substring(content, 1, 8192) as string)) > 0")
    return found.where(under & ~binary).select("path", "n_bytes", text_of(F.col("content")).alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def corpus_lines(files: DataFrame) -> DataFrame:
    """path, line_no (from 1), text; the empty piece behind a final newline isn't a line."""
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n\z", ""), r"\r?\n")).alias("i", "text"))
    return lines.select("path", (F.col("i") + 1).alias("line_no"), "text")


def write_bundles(df: DataFrame, path: str, public: tuple = ("id", "topic", "question", "gold_answer", "rubric", "evidence")) -> None:
    """All columns to ``path``/full and the public fields to ``path``/bundles, as JSON lines."""
    df.write.mode("errorifexists").json(f"{path}/full")
    df.select(*public).write.mode("errorifexists").json(f"{path}/bundles")


def write_embeddings(df: DataFrame, path: str, model: str, prefix: str = "") -> None:
    """id and embedding with model and prefix, as Parquet."""
    df.withColumns({"model": F.lit(model), "prefix": F.lit(prefix)}).write.mode("errorifexists").parquet(path)


def read_embeddings(spark: SparkSession, path: str, sessions: DataFrame, key: str) -> DataFrame:
    """Stored embeddings; raises unless they are those of exactly the sessions given."""
    stored = spark.read.parquet(path)
    gaps = sessions.select(key).join(stored, key, "left_anti").unionByName(stored.select(key).join(sessions, key, "left_anti"))
    if not gaps.isEmpty():
        raise ContractError("embeddings and sessions differ")
    return stored


def pending(expected: DataFrame, done: DataFrame, keys: list[str], valid: Column | None = None) -> DataFrame:
    """Expected keys without a valid finished row."""
    finished = done if valid is None else done.where(valid)
    return expected.join(finished.select(*keys).distinct(), keys, "left_anti")


def append_log(df: DataFrame, path: str, when: Column | None = None) -> None:
    """Appends rows as JSON lines with ``logged_at``, in folders by date."""
    stamped = df.withColumn("logged_at", when if when is not None else F.current_timestamp())
    stamped.withColumn("date", F.to_date("logged_at")).write.mode("append").partitionBy("date").json(path)

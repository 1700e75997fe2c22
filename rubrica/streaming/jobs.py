"""Structured Streaming jobs on event logs, questions, notebook edits and grades. Each has a batch twin among the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import normalize_text
from ..operators.quiz import fold_operations


#: The state store that keeps timers; the default one has none.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(rows: DataFrame, key: str, time: str, idle: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """``processor`` over ``rows`` by ``key`` in event time, with the watermark ``idle`` behind; sets the session's state store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return rows.withWatermark(time, idle).groupBy(key).transformWithStateInPandas(processor, schema, "Update", "EventTime")


class Expiring(StatefulProcessor):
    """State of a key that ends when no row has come for as long as the watermark is behind: a timer stands at the time of
    its last row, and when the watermark passes it, the key is emitted once more, as closed, and forgotten. A row that comes
    for it later begins anew."""

    #: The state's fields, its beginning, and the columns of a row that make it go on.
    state, begin, columns = "", (), []

    def __init__(self, key: str, time: str):
        self.key, self.time = key, time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.state}, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *held, last = self.held.get() if self.held.exists() else (*self.begin, None)
        frame = pd.concat(list(rows))
        held = self.go_on(held, frame)
        latest = max([last or 0, int(frame[self.time].max().timestamp() * 1000)])
        if latest != last:
            if last is not None:
                self.handle.deleteTimer(last)
            self.handle.registerTimer(latest)
        self.held.update((*held, latest))
        yield self.row(key[0], held, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        *held, _ = self.held.get()
        self.held.clear()
        yield self.row(key[0], held, True)

    def close(self) -> None:
        pass


class Usage(Expiring):
    state, begin = "commands long, tokens long", (0, 0)

    def __init__(self, key: str, time: str, limit: int):
        super().__init__(key, time)
        self.limit = limit

    def go_on(self, held: list, rows: pd.DataFrame) -> list:
        return [held[0] + int(rows["command_"].sum()), held[1] + int(rows["tokens_"].sum())]

    def row(self, key, held: list, closed: bool) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key], "commands": [held[0]], "tokens": [held[1]], "over_budget": [held[0] > self.limit], "closed": [closed]})


def running_usage(events: DataFrame, session: str, tokens: str, is_command, limit: int, time: str, idle: str) -> DataFrame:
    """session, commands, tokens, over_budget so far, for the update mode; a session without an event for ``idle`` of event
    time comes once more, ``closed``, and its state goes."""
    rows = events.select(session, time, F.coalesce(is_command, F.lit(False)).cast("int").alias("command_"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens_"))
    kind = events.schema[session].dataType.simpleString()
    return timed(rows, session, time, idle, Usage(session, time, limit), f"{session} {kind}, commands long, tokens long, over_budget boolean, closed boolean")


def dedup_questions(questions: DataFrame, text: str, time: str, delay: str) -> DataFrame:
    """Questions whose normalized text hasn't come within ``delay``; state is bounded by the watermark."""
    keyed = questions.withColumn("text_key", F.sha2(normalize_text(F.col(text)), 256)).withWatermark(time, delay)
    return keyed.dropDuplicatesWithinWatermark(["text_key"])


def activity_windows(events: DataFrame, time: str, kind: str, size: str, slide: str | None, delay: str) -> DataFrame:
    """window start and end, kind, n over tumbling or sliding windows; later rows than the watermark are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    counts = events.withWatermark(time, delay).groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def activity_sessions(events: DataFrame, time: str, user: str, gap: str, delay: str) -> DataFrame:
    """start, end, user, n of sessions that end after ``gap`` without an event."""
    counts = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), user, "n")


SECTIONS = "array<struct<id:string,title:string,content:string>>"


class Notebooks(Expiring):
    state, begin = f"sections {SECTIONS}, next_id int, skipped int", ([], 1, 0)

    def go_on(self, held: list, rows: pd.DataFrame) -> list:
        sections, next_id, skipped = held
        edits = rows.sort_values("seq")[["op", "section_id", "title", "content"]].itertuples(index=False, name=None)
        sections, next_id, lost = fold_operations([dict(zip(("id", "title", "content"), s, strict=True)) for s in sections], next_id, list(edits))
        return [[(s["id"], s["title"], s["content"]) for s in sections], next_id, skipped + len(lost)]

    def row(self, key, held: list, closed: bool) -> pd.DataFrame:
        sections = [dict(zip(("id", "title", "content"), s, strict=True)) for s in held[0]]
        return pd.DataFrame({self.key: [key], "sections": [sections], "next_id": [held[1]], "skipped": [held[2]], "closed": [closed]})


def notebook_state(ops: DataFrame, time: str, idle: str, key: str = "notebook") -> DataFrame:
    """key, sections, next_id, skipped (a count) after each micro-batch of edits (key, seq, op, section_id, title, content).

    The notebook itself is the state; edits of a micro-batch are applied in the order of seq. A notebook without an edit for
    ``idle`` of event time comes once more, ``closed``, and its state goes.
    """
    kind = ops.schema[key].dataType.simpleString()
    return timed(ops, key, time, idle, Notebooks(key, time), f"{key} {kind}, sections {SECTIONS}, next_id int, skipped int, closed boolean")


def run_available(stream: DataFrame, folder: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for the data that is there now, through files in ``folder`` (shared by all executors).

    In the update mode, ``keys`` name a row, whose last version counts.
    """
    spark = stream.sparkSession

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("__batch", F.lit(batch_id)).write.mode("append").parquet(f"{folder}/rows")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    writer.foreachBatch(sink).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if keys:
        last = rows.groupBy(*keys).agg(F.max("__batch").alias("__batch"))
        rows = rows.join(last, [*keys, "__batch"])
    return rows.drop("__batch")


def read_stream(spark, path: str) -> DataFrame:
    """A Parquet table as a stream of its files; a table of one file streams from the folder that it is in."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        return reader.option("pathGlobFilter", place.getName()).parquet(path.rsplit("/", 1)[0])
    return reader.parquet(path)

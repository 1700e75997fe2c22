"""Streams whose state ends: two runs of one checkpoint, idle keys emitted and dropped."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from rubrica.streaming import appends, jobs

DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def at(hours):
    return DAY + datetime.timedelta(hours=hours)


def run(stream, folder, name):
    """Rows that a run of what is there gives, in order of batches."""
    rows = []

    def sink(batch, _):
        rows.extend(batch.collect())

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return rows


def test_sessions_end(spark, tmp_path):
    schema = "session string, ts timestamp, tokens long, kind string"
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: run(jobs.running_usage(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "session", "tokens", F.col("kind") == "c", 1, "ts", "2 hours"), tmp_path, "s")
    feed([("a", at(0), 5, "c"), ("a", at(1), None, "c"), ("b", at(1), 7, "x")])
    assert sorted(map(tuple, go())) == [("a", 2, 5, True, False), ("b", 0, 7, False, False)]
    feed([("b", at(9), 1, "c"), ("c", at(9), 1, None)])
    got = go()
    assert ("b", 1, 8, False, False) in map(tuple, got) and ("a", 2, 5, True, True) in map(tuple, got)  # the state went on; a is over
    feed([("a", at(8), 3, "c")])
    assert ("a", 1, 3, False, False) in map(tuple, go())  # begun anew
    feed([("d", at(99), 0, "x")])
    assert {r.session for r in go() if r.closed} == {"a", "b", "c"}


def test_notebooks_end(spark, tmp_path):
    schema = "notebook long, seq int, op string, section_id string, title string, content string, at timestamp"
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    go = lambda: [(r.notebook, [s.content for s in r.sections], r.next_id, r.skipped, r.closed) for r in run(jobs.notebook_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", "1 hour"), tmp_path, "n")]
    feed([(1, 2, "append_to_section", "s1", None, "more", at(0)), (1, 1, "add_section", None, "T", "text", at(0)), (2, 1, "delete_section", "s9", None, None, at(0))])
    assert sorted(go()) == [(1, ["text\nmore"], 2, 0, False), (2, [], 1, 1, False)]
    feed([(1, 3, "add_section", None, "U", "next", at(5))])
    got = go()
    assert (1, ["text\nmore", "next"], 3, 0, False) in got and (2, [], 1, 1, True) in got
    feed([(3, 1, "add_section", None, "V", "new", at(50))])
    got = go()
    assert (1, ["text\nmore", "next"], 3, 0, True) in got and (3, ["new"], 2, 0, False) in got


def test_unseen_rows_and_replays(spark, tmp_path):
    path = str(tmp_path / "t")
    sink = appends.append_unseen(path, ["k", "j"])
    frame = lambda rows: spark.createDataFrame(rows, "k int, j string, v string").coalesce(1)
    for i, batch in enumerate([[(1, "x", "a"), (1, "x", "b"), (2, None, "c")], [(2, None, "d"), (3, "y", "e")], []]):
        sink(frame(batch), i)
    kept = lambda: sorted((r.k, r.j or "") for r in appends.read_appended(spark, path).collect())
    assert kept() == [(1, "x"), (2, ""), (3, "y")]
    sink(frame([(9, "z", "f")]), 1)  # a batch that is known by its id
    assert kept() == [(1, "x"), (2, ""), (3, "y")]
    appends.append_unseen(path, ["k", "j"], "other")(frame([(3, "y", "g"), (4, "z", "h")]), 0)
    assert kept() == [(1, "x"), (2, ""), (3, "y"), (4, "z")]


def test_an_ended_batch_is_written_anew(spark, tmp_path):
    """Rows without a manifest row aren't read, and the batch replaces them."""
    path = str(tmp_path / "t")
    frame = spark.createDataFrame([(1, "a")], "k int, v string")
    appends.append_unseen(path, ["k"])(frame, 0)
    spark.createDataFrame([(7, "lost")], "k int, v string").write.parquet(f"{path}/rows/stream=main/batch=1")
    assert [r.k for r in appends.read_appended(spark, path).collect()] == [1]
    appends.append_unseen(path, ["k"])(spark.createDataFrame([(8, "b")], "k int, v string"), 1)
    assert sorted(r.k for r in appends.read_appended(spark, path).collect()) == [1, 8]


def test_a_batch_reads_files_that_may_hold_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(6):
        appends.append_unseen(path, ["k"])(spark.range(i * 100, i * 100 + 100).withColumnRenamed("id", "k").coalesce(1), i)
    known = appends.manifest(spark, path)
    ask = lambda *keys: appends.open_files(known, spark.createDataFrame([(k,) for k in keys], "k long").select(F.xxhash64("k").alias("h")))
    assert known.where("file IS NOT NULL").count() == 6
    assert len(ask(250)) == 1 and "batch=2" in ask(250)[0] and len(ask(5, 599)) == 2 and ask() == [] and len(ask(10**6)) <= 1


def test_filters_forget_nothing():
    rng = np.random.default_rng(1)
    hashes, others = (rng.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64) for _ in range(2))
    filter_ = appends.bloom(hashes)
    assert all(appends.may_hold(filter_, hashes[i : i + 1]) for i in range(5000))
    assert sum(appends.may_hold(filter_, others[i : i + 1]) for i in range(5000)) < 150
    assert not appends.may_hold(appends.bloom(hashes[:0]), others)

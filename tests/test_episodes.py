"""The episode tree's writer: names, contracts, failures, compaction."""

import json
import time

import pytest
from pyspark.sql import functions as F

from rubrica.sources import episodes, files


def test_tree_and_table(spark, tmp_path):
    rows = [("low", 0, "q1", "ok", None), ("low", 1, "q1", "bad", 3), ("b=x y", 0, "q é", "ok", 4)]
    df = spark.createDataFrame(rows, "budget string, rollout int, qid string, status string, n int")
    root = str(tmp_path / "tree")
    episodes.write_episode_tree(df, root)
    assert json.loads((tmp_path / "tree" / "b=x y" / "r0" / "q é.json").read_text()) == {"status": "ok", "n": 4}
    table = episodes.compact_episode_tree(spark, root, "status string, n int", str(tmp_path / "table"))
    assert sorted((r.budget, r.rollout, r.qid, r.status) for r in table.collect()) == sorted(r[:4] for r in rows)
    assert [p.name for p in tmp_path.iterdir() if "making" in p.name] == []
    with pytest.raises(files.ContractError, match="already"):
        episodes.write_episode_tree(df, root)
    episodes.write_episode_tree(df.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


@pytest.mark.parametrize("rows", [[("a", 0, "q")] * 2, [("a/b", 0, "q")], [("a", 0, None)], [("..", 0, "q")], [("", 0, "q")]])
def test_names_are_checked(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "budget string, rollout int, qid string").withColumn("n", F.lit(1))
    with pytest.raises(files.ContractError):
        episodes.write_episode_tree(df, str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []


def test_a_failed_task_leaves_no_half_tree(spark, tmp_path):
    broken = F.when(F.col("id") == 399, F.raise_error(F.lit("broken"))).otherwise("fine")
    df = spark.range(400).repartition(4).select(F.lit("a").alias("budget"), F.lit(0).alias("rollout"), F.col("id").alias("qid"), broken.alias("status"))
    with pytest.raises(Exception, match="broken"):
        episodes.write_episode_tree(df, str(tmp_path / "t"))
    assert list(tmp_path.iterdir()) == []


def test_ten_thousand_episodes(spark, tmp_path):
    df = spark.range(10_000).select(F.concat(F.lit("b"), F.col("id") % 4).alias("budget"), (F.col("id") % 3).alias("rollout"), F.col("id").alias("qid"), F.lit("x").alias("status"))
    began = time.time()
    episodes.write_episode_tree(df, str(tmp_path / "t"))
    assert time.time() - began < 60 and sum(1 for _ in (tmp_path / "t").rglob("*.json")) == 10_000


def test_corpus_is_listed_and_read_in_tasks(spark, tmp_path, monkeypatch):
    """Nested, hidden, large and binary files, a folder under two roots, a missing one, several batches a task; Spark's own
    reader, which lists on the driver, gives the same but for empty files."""
    made = {"a/x y.py": b"one\n", "a/b/z+%20.py": b"\xff2", "a/_done": b"h", "a/.git/c": b"h", "a/_k=1/d": b"k", "a/big": b"b" * 300, "a/nul": b"n\0", "c/e": b"", "other/f": b"no"}
    for name, body in made.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(body)
    monkeypatch.setattr(files, "BATCH_BYTES", 4)
    read = lambda: sorted(tuple(r) for r in files.read_corpus(spark, f"file://{tmp_path}/tree", ["a", "a/b", "c/", "gone"], 299).collect())
    got = read()
    assert got == [("a/_k=1/d", 1, "k"), ("a/b/z+%20.py", 2, "\ufffd2"), ("a/x y.py", 4, "one\n"), ("c/e", 0, "")]
    with pytest.raises(files.ContractError):
        files.read_corpus(spark, str(tmp_path / "nothing"), ["a"])
    with monkeypatch.context() as m:
        m.setattr(type(spark), "read", property(lambda self: pytest.fail("the driver lists")))
        assert read() == got
    monkeypatch.setattr(files, "_reached", lambda root: False)
    assert read() == got[:-1]  # Spark's reader passes empty files by


def test_tree_of_equal_sources_is_dealt_out(spark, tmp_path):
    """Files of one folder are written by several tasks."""
    df = spark.range(0, 40, 1, 4).select(F.lit("s").alias("folder"), F.col("id").cast("string").alias("name"), F.lit("x").alias("body"))
    episodes.write_tree(df, str(tmp_path / "tree"))
    assert len(list((tmp_path / "tree" / "s").iterdir())) == 40

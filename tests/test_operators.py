"""Edge cases, published numbers and brute force for operators."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from rubrica.functions import ids, text
from rubrica.operators import codesearch, curate, dedup, foldback, grading, metrics, quiz, stats, traces
from rubrica.operators import text as ops
from rubrica.sources import files


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "clean"),
    [(None, ""), ("", ""), ("a <!-- x\ny --> b", "a b"), ("```py\nx\n``` tail", "[code] tail"), ("open ```py\nx", "open [code]"), ("<b>hi</b>\n# head\n> quote\n| row\n  kept\t\tline ", "hi\nkept line")],
)
def test_clean_markdown(spark, raw, clean):
    assert one(spark, text.clean_markdown, raw) == clean


@pytest.mark.parametrize(
    ("raw", "word"),
    [(None, ""), ("*How* do", "how"), ("[code]\nWhy", "code"), ("[How](x)", "how"), ("Hi there\nWhy", "why"), ("hello " + "x" * 54 + "\nWhy", "why"), ("hello " + "x" * 55 + "\nWhy", "hello"), ("1st\nWhy", "")],
)
def test_first_word(spark, raw, word):
    assert one(spark, text.first_word, raw) == word


@pytest.mark.parametrize(("raw", "sets"), [(None, []), ("  ", []), ("Two  words", ["two words"]), ("a b c a b c", ["a b c", "b c a", "c a b"])])
def test_shingles(spark, raw, sets):
    assert sorted(one(spark, text.shingles, raw)) == sets


def test_lengths_and_language(spark):
    for n, ok in ((29, False), (30, True), (20_000, True), (20_001, False)):
        assert one(spark, text.length_between, "x" * n) is ok
    assert one(spark, text.detect_language, "the cat is in the house and it was for me") == "en"
    assert one(spark, text.detect_language, "12345") == "unknown"


def test_programs(spark):
    df = spark.createDataFrame([("a", "x = 1"), ("b", "x = ("), ("c", None)], "k string, p string")
    assert [r.ok for r in df.select("k", text.syntax_ok("p").alias("ok")).orderBy("k").collect()] == [True, False, False]
    got = one(spark, text.fenced_blocks, "before\n```\na\n```\n```py\nlonger\n```\nafter")
    assert (got.blocks, got.longest, got.outside) == (2, "longer\n", "before\n\n\nafter")


def test_ids(spark):
    import hashlib

    digest = hashlib.sha256(b"abc").hexdigest()
    assert one(spark, lambda c: ids.content_id(c, "q_"), "abc") == "q_" + digest[:12]
    assert one(spark, ids.stable_seed, "abc") == int(digest[:8], 16) & 0x7FFFFFFF
    assert one(spark, lambda c: ids.shard_of(c, 13), "abc") == int(digest, 16) % 13
    fingerprint = one(spark, lambda c: ids.row_fingerprint(b=c, a=F.lit(None).cast("int")), "x")
    assert fingerprint == hashlib.sha256(b'{"a":null,"b":"x"}').hexdigest()


def test_sections(spark):
    df = spark.createDataFrame([(1, "# T\nintro\n## A\nx\n\n## B\n"), (2, ""), (3, "## Only\nbody")], "k int, note string")
    got = [tuple(r) for r in ops.parse_sections(df, "note", "k").orderBy("k", "section_id").collect()]
    assert got == [(1, "s1", "Overview", "intro"), (1, "s2", "A", "x"), (1, "s3", "B", ""), (3, "s1", "Only", "body")]


def test_exact_dedup_keeps_earliest(spark):
    df = spark.createDataFrame([(2, "A  b"), (1, "a b"), (3, None), (4, "")], "n int, t string")
    assert sorted(r.n for r in dedup.exact_dedup(df, "t", ["n"]).collect()) == [1, 3]


def brute_greedy(pairs):
    gone, nodes = {}, sorted({x for p in pairs for x in p})
    for n in nodes:
        before = [a for a, b in pairs if b == n and a not in gone]
        if before:
            gone[n] = min(before)
    return {n: gone.get(n) for n in nodes}


def test_greedy_survivors(spark):
    random.seed(5)
    chain = [(1, 2), (2, 3)]
    for pairs in (chain, [p for p in itertools.combinations(range(30), 2) if random.random() < 0.08]):
        got = {r.key: r.kept_by for r in dedup.greedy_survivors(spark.createDataFrame(pairs, "a_key int, b_key int")).collect()}
        assert got == brute_greedy(pairs)


def test_decontamination_bounds(spark):
    words = [f"w{i}" for i in range(29)]
    held = spark.createDataFrame([(1, " ".join(words))], "i int, t string")
    other = [f"v{i}" for i in range(13)]
    cand = spark.createDataFrame([(1, "nothing in common here"), (2, " ".join(words)), (3, " ".join(words[:16] + other))], "k int, t string")
    got = {r.k: (round(r.max_similarity, 6), r.kept) for r in dedup.decontaminate(cand, held, "k", "t", "i", "t").collect()}
    assert got == {1: (0.0, True), 2: (1.0, False), 3: (round(14 / 40, 6), True)}  # exactly 0.35 stays


GOLDENS = [
    ([(10, 5000), (20, 10000), (30, 20000), (40, 100000)], 10.8), ([(3.3, 4100), (8.6, 7900), (9.6, 8600), (29.4, 34600)], 6.49), ([(6.3, 3900), (14.4, 6100), (14.1, 7100), (23.1, 29900)], 9.65),
    ([(2.3, 4100), (6.9, 4600), (15.8, 9700), (17.6, 24300)], 7.66), ([(36.97, 857), (33.13, 1406), (42.33, 1481), (43.67, 3825)], 43.38), ([(11.43, 1859), (15.10, 3613), (13.47, 3716), (25.80, 8387)], 18.31),
]


@pytest.mark.parametrize(("points", "area"), GOLDENS)
def test_expertise_goldens(spark, points, area):
    df = spark.createDataFrame([("r", float(s), float(t)) for s, t in points], "run string, score double, tokens double")
    assert abs(metrics.expertise(df, ["run"]).first().expertise - area) < 0.06


def test_expertise_guards(spark):
    df = spark.createDataFrame([("three", 1.0, 5.0)] * 3 + [("zero", 1.0, 0.0)] * 4 + [("same", float(i), 6000.0) for i in range(4)], "run string, score double, tokens double")
    got = {r.run: r.expertise for r in metrics.expertise(df, ["run"]).collect()}
    assert got["three"] is None and got["zero"] is None and abs(got["same"] - 1.5) < 1e-9


def test_verdicts(spark):
    texts = ['{"claims":[{"claim_id":"c1","score":1,"rationale":"r"}]}', '{"claims":{"c1":{"score":0,"rationale":"r"}}}', "not json", '{"claims":[{"claim_id":"c1","score":true}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, v string")
    got = sorted((r.k, r.claim_id, r.score) for r in grading.parse_verdict(df, "v", ["k"]).collect())
    assert got[:2] == [(0, "c1", 1), (1, "c1", 0)] and all(x[0] != 2 for x in got) and [x for x in got if x[0] == 3] in ([], [(3, "c1", None)])
    claims = spark.createDataFrame([("q", "c1", 2, "r"), ("q", "c1", 1, "r"), ("q", "c3", 1, None)], "qid string, claim_id string, score int, rationale string")
    rubric = spark.createDataFrame([("q", "c1"), ("q", "c2")], "qid string, claim_id string")
    rules = sorted((r.claim_id, r.rule) for r in grading.verdict_violations(claims, rubric, "qid").collect())
    assert rules == [("c1", "repeated"), ("c1", "score"), ("c2", "missing"), ("c3", "rationale"), ("c3", "unexpected")]


def test_rubric_rules(spark):
    claims = spark.createDataFrame([("a", "c1", "core", 51, ["s1"]), ("a", "c2", "supporting", 49, ["s1"]), ("b", "c1", "core", 50, ["s9"]), ("b", "c1", "supporting", 51, [])], "id string, claim_id string, claim_type string, weight int, span_ids array<string>")
    spans = spark.createDataFrame([("a", "s1", "f.py", 1, 300), ("b", "s1", "g.py", 1, 301)], "id string, span_id string, path string, start_line int, end_line int")
    sizes = spark.createDataFrame([("f.py", 300)], "path string, n_lines int")
    assert sorted((r.id, r.rule) for r in curate.rubric_violations(claims, spans, sizes, "id").collect()) == [("b", x) for x in ("claim_ids", "core", "long", "path", "undefined", "weights")]


def test_paired_statistics(spark):
    for wins, losses in ((0, 0), (5, 0), (7, 3), (153, 65)):
        n = wins + losses
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(wins, losses) + 1)) / 2**n) if n else 1.0
        p = spark.range(1).select(stats.sign_test(F.lit(wins).cast("bigint"), F.lit(losses).cast("bigint")).alias("p")).first().p
        assert abs(p - exact) < 1e-9


@pytest.mark.parametrize(("command", "found"), [("cat /usr/bin/x", []), ("cat ../x", ["~ or ../ escape"]), ("ls ~/x", ["~ or ../ escape"]), ("cat /tmp/x /corpus/a", ["/tmp/x"]), (None, [])])
def test_escapes(spark, command, found):
    got = traces.escape_violations(spark.createDataFrame([(command,)], "c string"), "c", "/corpus").collect()
    assert (got[0].escapes if got else []) == found


def test_notebook_operations(spark):
    books = spark.createDataFrame([("n", [("s1", "A", "x")], 2), ("m", [], 1)], "notebook string, sections array<struct<id:string,title:string,content:string>>, next_id int")
    rows = [("n", 1, "replace_section", "s1", "", ""), ("n", 2, "add_section", "", "", "c"), ("n", 3, "delete_section", "s1", "", ""), ("n", 4, "append_to_section", "s1", "", "c"), ("n", 5, "add_section", "", "B", "y")]
    out = {r.notebook: r for r in quiz.apply_notebook_ops(books, spark.createDataFrame(rows, "notebook string, seq int, op string, section_id string, title string, content string")).collect()}
    assert [tuple(s) for s in out["n"].sections] == [("s2", "B", "y")] and out["n"].next_id == 3 and len(out["n"].skipped) == 3 and not out["m"].sections


def test_ceiling(spark):
    rows = [(1, "s", "t" * 10, "", 5, "reusable", 1), (1, "s", "u" * 10, "", 9, "specific", 2), (1, "z", "v" * 10, "", 1, "reusable", 3)]
    df = spark.createDataFrame(rows, "n int, section string, text string, code string, weight_hint int, generality string, position int")
    one_entry = 10 + 2 + 2 + 1 + 5
    for cap, kept in ((one_entry - 1, []), (one_entry, [1]), (2 * one_entry, [1, 3]), (2 * one_entry + 14, [1, 2, 3])):
        assert sorted(r.position for r in foldback.trim_to_ceiling(df, "n", cap).collect()) == kept


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.py", "a.py", True), ("*.py", "a/b.py", False), ("**/b.py", "a/c/b.py", True), ("**/b.py", "b.py", True), ("a?[!x].py", "abz.py", True), ("a?[!x].py", "abx.py", False), ("a[.py", "a[.py", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.search(codesearch.glob_pattern(glob), path)) is hit
    assert codesearch.safe_pattern("a(") == "a\\("


def test_nearest_cosine_beyond_its_bound(spark):
    import numpy as np

    from rubrica.operators import vectors

    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 6)), rng.normal(size=(2500, 6))
    frame = lambda x: spark.createDataFrame([(i // 2, list(map(float, v))) for i, v in enumerate(x)], "id long, v array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    best = (unit(a) @ unit(b).T).max(1)
    got = vectors.nearest_cosine(frame(a), frame(b), "id", "v", broadcast_bytes=100).collect()
    assert sorted((r.id, round(r.nearest, 9), r.flagged) for r in got) == sorted((i // 2, round(float(x), 9), bool(x >= 0.95)) for i, x in enumerate(best))


def test_episode_tree(spark, monkeypatch):
    """The tree of io4 is written and read in the operator's layout, for all documents of any length."""
    from rubrica.plans import trace_queries

    from .conftest import SMALL

    calls, read = [], files.read_episode_tree
    monkeypatch.setattr(files, "read_episode_tree", lambda *a: calls.append(a) or read(*a))
    got = trace_queries.io4(spark, SMALL).agg(F.sum("n").alias("n"), F.sum("gen_tokens").alias("chars")).first()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert (got.n, got.chars) == (docs.count(), docs.agg(F.sum("n_chars")).first()[0]) and len(calls) == 1


def test_bundle_lines(spark, tmp_path):
    """Blank lines don't count; malformed ones raise."""
    (tmp_path / "b.jsonl").write_text('{"id":"q1","rubric":[],"evidence":[]}\n\n{"id":"q2"}\n')
    assert sorted(r.id for r in files.read_bundles(spark, str(tmp_path / "b.jsonl")).collect()) == ["q1", "q2"]
    (tmp_path / "c.jsonl").write_text('{"id":"q1"}\n{"id":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_bundles(spark, str(tmp_path / "c.jsonl")).collect()


def test_readers(spark, tmp_path):
    snapshot = {"repository": "r", "sessions": [{"number": 1, "state": "OPEN", "created_at": "2024-01-01T00:00:00Z"}, {"number": 2, "state": "CLOSED", "created_at": "2024-01-01T02:00:00+02:00"}]}
    (tmp_path / "s.json").write_text(json.dumps(snapshot))
    s = files.read_sessions(spark, str(tmp_path / "s.json"))
    assert s.select("created_at").distinct().count() == 1
    assert files.session_profile(s).first().states == {"OPEN": 1, "CLOSED": 1}
    snapshot["sessions"][1]["number"] = 1
    (tmp_path / "t.json").write_text(json.dumps(snapshot))
    with pytest.raises(files.ContractError):
        files.read_sessions(spark, str(tmp_path / "t.json"))
    (tmp_path / "log.jsonl").write_text('{"type":"turn.completed","usage":{"output_tokens":5}}\n{"type": \n{"type":"turn.completed"}\n{"type":"item.completed","item":{"type":"command_execution","command":"ls"}}\n')
    e = files.read_events(spark, str(tmp_path / "log.jsonl"))
    r = traces.session_stats(e).first()
    assert (r.session, r.commands, r.output_tokens, r.reasoning_tokens) == ("log", 1, 5, 0)
    tree = tmp_path / "episodes" / "low" / "r1"
    tree.mkdir(parents=True)
    (tree / "q7.json").write_text('{\n"status": "ok"}')
    r = files.read_episode_tree(spark, str(tmp_path / "episodes"), "status string").first()
    assert (r.status, r.budget, r.rollout, r.qid) == ("ok", "low", 1, "q7")
    root = tmp_path / "corpus"
    (root / "lib").mkdir(parents=True)
    (root / "lib" / "a.py").write_bytes(b"x\xff\ny\n")
    (root / "lib" / "b.py").write_bytes(b"a\0b")
    (root / "other.py").write_bytes(b"z")
    corpus = files.read_corpus(spark, str(root), ["lib"])
    assert [r.path for r in corpus.collect()] == ["lib/a.py"]
    assert [(r.line_no, r.text) for r in files.corpus_lines(corpus).orderBy("line_no").collect()] == [(1, "x�"), (2, "y")]

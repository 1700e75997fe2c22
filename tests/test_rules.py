"""Rule by rule: edge rows of verdicts, episodes, grades, runs, rounds, notes, dedup and vectors, and brute force for signatures, projections and clusters."""

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rubrica.functions import text
from rubrica.operators import cells, codesearch, curate, dedup, foldback, grading, lineage, stats, traces, vectors
from rubrica.operators.lineage import cut

from .test_operators import one


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# texts and excerpts


def test_numbers_of_long_texts_are_whole(spark):
    lines = one(spark, text.number_lines, "\n".join("x" * 10_001)).split("\n")
    assert (lines[0], lines[9998], lines[9999], lines[10_000]) == ("0001: x", "9999: x", "10000: x", "10001: x")
    corpus = spark.range(1, 10_012).select(F.lit("f").alias("path"), F.col("id").alias("line_no"), F.lit("y").alias("text"))
    spans = spark.createDataFrame([("s", "f", 9_999, 10_001), ("t", "f", 10_011, 10_012), ("u", "g", 1, 2)], "id string, path string, start_line int, end_line int")
    got = {r.id: r.recomputed for r in curate.excerpts(spans, corpus, ["id"]).collect()}
    assert got == {"s": "9999: y\n10000: y\n10001: y", "t": "10011: y", "u": None}


@pytest.mark.parametrize(("raw", "clean"), [(" \n\n  # a\n b \n\n\n| c\nd  e\n> f", "b\nd e"), ("#a\n#b\n c", "c"), ("a\n \t \n\t|\nb #c", "a\nb #c"), ("\r\na\r\n\r\n b\r\n", "a\nb"), ("<x>\n<!-- a\nb -->\nc", "c"), ("a\x0bb", "a\x0bb")])
def test_clean_lines(spark, raw, clean):
    assert one(spark, text.clean_markdown, raw) == clean


@pytest.mark.parametrize("raw", [None, "", "  ", "a", "A\t b", "a b c", "a  b\nc a b c", "\x0b x \x1c y", "é É ß"])
def test_normal_text_and_hashed_shingles(spark, raw):
    import re

    want = re.sub(r"[ \t\n\x0b\f\r]+", " ", (raw or "").lower()).strip(" ")
    assert one(spark, text.normalize_text, raw) == want
    assert len(one(spark, text.shingle_hashes, raw)) == len(one(spark, text.shingles, raw))


# dedup


def test_exact_dedup_ties(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (1, "A  b", "y"), (1, "c", "z"), (2, "c", "w"), (3, None, "v"), (3, "", "u")], "n int, t string, k string")
    got = dedup.exact_dedup(df, "t", ["n"])
    assert got.columns == df.columns and rows(got.select("n", F.coalesce(text.normalize_text(F.col("t")), F.lit("")).alias("t")), "n", "t") == [(1, "a b"), (1, "c"), (3, "")]


def words_of(rng, n, vocabulary=4000):
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def test_minhash_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    texts = [(i, words_of(rng, n)) for i, n in enumerate((0, 1, 2, 3, 50, 300))]
    df = spark.createDataFrame(texts, "id int, t string")
    sets = {r.key: r.s for r in dedup.shingle_sets(df, "id", "t").collect()}
    factors, shifts = dedup._factors(128)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.id: (r.n, r.signature) for r in dedup.minhash(df, "id", "t").collect()}
    want = {i: (len(s), [signed(min(((h % (1 << 64)) * int(f) + int(c)) % (1 << 64) for h in s)) for f, c in zip(factors, shifts, strict=True)]) for i, s in sets.items() if s}
    assert got == want


@pytest.mark.parametrize("block", [256, 4])
def test_near_pairs_equal_brute_force(spark, block):
    """Near copies in a group larger than a block, and boilerplate that unrelated texts share."""
    rng = np.random.default_rng(2)
    base, boiler = words_of(rng, 120), words_of(rng, 60)
    texts = []
    for i in range(30):
        near = base.split()
        near[int(rng.integers(0, 120))] = f"new{i}"
        texts.append(" ".join(near))
    texts += [boiler + " " + words_of(rng, 60) for _ in range(20)] + [words_of(rng, 40) for _ in range(10)]
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(grams[a] & grams[b]) >= 0.7 * len(grams[a] | grams[b])}
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    candidates = {(r.a_key, r.b_key) for r in dedup.candidate_pairs(dedup.shingle_sets(df, "id", "t"), 0.7, block=block).collect()}
    assert want <= candidates and len(candidates) <= len(want) + 40  # unrelated pairs don't leave their blocks
    assert {(r.a_key, r.b_key) for r in dedup.near_dup_pairs(df, "id", "t").collect()} == want


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_overlaps_with_and_without_broadcast(spark, bound):
    rng = np.random.default_rng(3)
    a, b = ([words_of(rng, 30, 12) for _ in range(8)] for _ in range(2))
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(28)}
    want = sorted((i, j, round(len(grams(x) & grams(y)) / len(grams(x) | grams(y)), 9)) for i, x in enumerate(a) for j, y in enumerate(b) if grams(x) & grams(y))
    one_, two = (dedup.shingle_sets(spark.createDataFrame(list(enumerate(t)), "id int, t string"), "id", "t") for t in (a, b))
    assert sorted((r.a_key, r.b_key, round(r.similarity, 9)) for r in dedup.overlaps(one_, two, bound).collect()) == want


def test_longest_phrase_has_no_bound(spark):
    phrase = " ".join(f"p{i}" for i in range(40))
    a = [(1, f"x {phrase} y"), (2, "the cat and the dog"), (3, "q q q q q q q q"), (4, None)]
    b = [(1, f"start {phrase} end p1 p2 p3 p4 p5 p6"), (2, "the cow and the dog"), (3, "q q q q q q z"), (4, "")]
    one_, two = (spark.createDataFrame(t, "id int, t string") for t in (a, b))
    assert rows(dedup.longest_shared_phrase(one_, two, "id", "t", "id", "t"), "a_key", "b_key", "words") == [(1, 1, 40), (3, 3, 6)]
    assert rows(dedup.longest_shared_phrase(one_, two, "id", "t", "id", "t", 2), "a_key", "b_key", "words") == [(1, 1, 40), (2, 2, 3), (3, 3, 6)]


# vectors


def brute_clusters(unit, eps, samples, least):
    near = (1 - unit @ unit.T <= eps) & ~np.eye(len(unit), dtype=bool)
    core, label, out = near.sum(1) >= samples, np.arange(len(unit)), np.full(len(unit), -1)
    while True:
        after = np.array([min([label[i], *label[near[i] & core]]) if core[i] else label[i] for i in range(len(unit))])
        if (after == label).all():
            break
        label = after
    for k, own in enumerate([l for l in np.unique(label[core]) if (core & (label == l)).sum() >= least]):
        out[core & (label == own)] = k
    return out


def test_density_clusters_equal_brute_force(spark):
    """More rows within eps than any fixed number of neighbours, copies in two groups, blocks smaller than clusters."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 6))
    tight = [centres[0] + rng.normal(size=6) * 0.002 for _ in range(10)] + [centres[0] + 0.18 + rng.normal(size=6) * 0.002 for _ in range(10)]
    vs = np.array([*tight, *np.repeat(centres[1:2], 12, 0), *np.repeat(centres[1:2] + 0.1, 12, 0), *(centres[2] + rng.normal(size=(40, 6)) * 0.2), *rng.normal(size=(20, 6))])
    unit = vs / np.linalg.norm(vs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)] + [(900, None), (901, [0.0] * 6)], "id int, v array<double>")
    want = brute_clusters(unit, 0.02, 5, 5)
    got = {r.id: r.cluster for r in vectors.density_cluster(df, "id", "v", 0.02, 5, 5, block_rows=8).collect()}
    assert [got[i] for i in range(len(vs))] == want.tolist() and got[900] == got[901] == -1 and want.max() >= 1
    assert vectors.density_cluster(df.limit(0), "id", "v", 0.02, 5, 5).count() == 0


def test_sweep_and_recommendation(spark):
    rng = np.random.default_rng(5)
    vs = np.concatenate([c + rng.normal(size=(20, 4)) * 0.05 for c in np.eye(4)])
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)], "id int, v array<double>")
    got = {r.eps: r for r in vectors.sweep(df, "id", "v", [(0.05, 3, 5), (1e-9, 3, 5)]).collect()}
    assert (got[0.05].clusters, got[0.05].sizes, got[1e-9].clusters) == (4, [20] * 4, 0)
    gaps = np.linalg.norm(vs[:, None] - vs[None], axis=2) ** 2  # the evaluator takes squared distances
    own = np.arange(80) // 20
    inside = np.array([gaps[i][(own == own[i])].sum() / 19 for i in range(80)])
    outside = np.array([min(gaps[i][own == c].mean() for c in range(4) if c != own[i]) for i in range(80)])
    assert abs(got[0.05].score - np.mean((outside - inside) / np.maximum(inside, outside))) < 1e-6 and got[1e-9].score is None
    table = spark.createDataFrame([(0.1, 4, 0.1, [20, 15], 0.5), (0.2, 5, 0.45, [16], 0.5), (0.3, 3, 0.0, [50], 0.9), (0.4, 9, 0.46, [15], 0.9), (0.5, 9, 0.1, [14], 0.9)], "eps double, clusters int, noise_fraction double, sizes array<int>, score double")
    assert vectors.recommend(table).first().eps == 0.1


def test_projection_equals_principal_components(spark):
    rng = np.random.default_rng(6)
    vs = rng.normal(size=(60, 5)) * [9, 5, 3, 1, 0.1]
    got = np.array([r.projected for r in vectors.project(spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)], "id int, embedding array<double>"), 3).orderBy("id").collect()])
    values, axes = np.linalg.eigh(np.cov(vs.T))
    want = vs @ axes[:, np.argsort(-values)[:3]]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-8


# verdicts and grades


VERDICTS = {
    "good": ({"claims": [{"claim_id": "c1", "score": 1, "rationale": "r"}], "question_score": 40.5, "needs_regrade": False}, []),
    "keyed": ({"claims": {"c1": {"score": 1, "rationale": "r"}}, "question_score": 40, "needs_regrade": False}, ["claims"]),
    "more": ({"claims": [], "question_score": 40, "needs_regrade": False, "x": 1}, ["fields"]),
    "fewer": ({"claims": [], "needs_regrade": False}, ["fields", "total"]),
    "field": ({"claims": [{"claim_id": "c1", "score": 1}], "question_score": 1, "needs_regrade": False}, ["claim_fields"]),
    "regrade": ({"claims": [], "question_score": 1, "needs_regrade": True}, ["regrade"]),
    "regrade as text": ({"claims": [], "question_score": 1, "needs_regrade": "no"}, ["regrade"]),
    "total as text": ({"claims": [], "question_score": "1", "needs_regrade": False}, ["total"]),
    "total as truth": ({"claims": [], "question_score": True, "needs_regrade": False}, ["total"]),
    "list": ([1], ["json"]),
}


def test_response_rules(spark):
    data = [(name, json.dumps(v)) for name, (v, _) in VERDICTS.items()] + [("cut", '{"claims": ['), ("null", None)]
    got = rows(grading.response_violations(spark.createDataFrame(data, "k string, v string"), ["k"], "v"), "k", "rule")
    assert got == sorted([(name, rule) for name, (_, broken) in VERDICTS.items() for rule in broken] + [("cut", "json"), ("null", "json")])
    keyed = spark.createDataFrame([("a", json.dumps({"claims": {"c1": {"score": 1, "rationale": "r"}}, "needs_regrade": False})), ("b", json.dumps(VERDICTS["good"][0]))], "k string, v string")
    assert rows(grading.response_violations(keyed, ["k"], "v", "keyed"), "k", "rule") == [("b", "claims"), ("b", "fields")]


def test_response_ends_and_usage(spark):
    good = json.dumps(VERDICTS["good"][0])
    data = [("ok", good, "stop", (5, 6, 11)), ("cut", good, "length", (5, 6, 11)), ("sum", good, "stop", (5, 6, 12)), ("minus", good, "stop", (-1, 6, 5)), ("lack", good, "stop", None), ("spent", good, None, (5, 9, 14)), ("blank", "  ", "stop", (5, 6, 11))]
    df = spark.createDataFrame(data, "k string, v string, f string, u struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>")
    got = rows(grading.response_violations(df, ["k"], "v", "paper", "f", "u", 9), "k", "rule")
    assert got == [("blank", "content"), ("blank", "json"), ("cut", "stop"), ("lack", "usage"), ("minus", "usage"), ("spent", "budget"), ("spent", "stop"), ("sum", "usage")]


def test_zero_fill_leaves_broken_verdicts(spark):
    episodes = spark.createDataFrame([("a", "ok"), ("b", "no_answer"), ("c", "ok")], "qid string, status string")
    rubric = spark.createDataFrame([(q, c) for q in "abc" for c in ("c1", "c2")], "qid string, claim_id string")
    claims = spark.createDataFrame([("a", "c1", 1, "r"), ("b", "c1", 1, "stray"), ("c", "c1", 0, "r"), ("c", "c2", 1, "r")], "qid string, claim_id string, score int, rationale string")
    got = rows(grading.zero_fill(episodes, rubric, claims, ["qid"], "qid"), "qid", "claim_id", "score", "rationale")
    assert got == [("a", "c1", 1, "r"), ("b", "c1", 0, "No answer."), ("b", "c2", 0, "No answer."), ("c", "c1", 0, "r"), ("c", "c2", 1, "r")]


def test_episode_rules(spark):
    data = [("ok", "ok", "x", 0, 7, "q", "q"), ("seed", "ok", "x", 0, 8, "q", "q"), ("status", "gave_up", "x", 1, 7, "q", "q"), ("blank", "ok", " ", 1, 7, "q", "q"), ("silent", "no_answer", None, 0, 7, "q", "q"), ("tokens", "ok", "x", -1, 7, "q", "q"), ("key", "ok", "x", 1, 7, "q", None), ("null", None, None, None, None, "q", "q")]
    df = spark.createDataFrame(data, "k string, status string, answer string, gen_tokens int, seed int, qid string, path_qid string").withColumn("sha", F.sha2(F.when(F.col("k") == "ok", "asked").otherwise("asked!"), 256))
    got = rows(grading.episode_violations(df, F.lit(7), {"qid": F.col("path_qid")}, (F.col("sha"), F.sha2(F.lit("asked"), 256))).where("rule <> 'fingerprint'"), "k", "rule")
    assert got == [("blank", "answer"), ("key", "key"), ("null", "seed"), ("null", "status"), ("null", "tokens"), ("seed", "seed"), ("status", "status"), ("tokens", "tokens")]
    assert grading.episode_violations(df, F.lit(7), None, (F.col("sha"), F.sha2(F.lit("asked"), 256))).where("rule = 'fingerprint'").count() == len(data) - 1


def test_stale_scores(spark):
    grades = spark.createDataFrame([("a", 60, 5), ("b", 60, 5), ("c", 100, 5), ("d", 60, 6), ("e", 0, 5)], "qid string, lenient int, tokens int")
    episodes = spark.createDataFrame([(q, 5) for q in "abcd"], "qid string, tokens int")
    rubric = spark.createDataFrame([(q, c, w) for q in "abcde" for c, w in (("c1", 60), ("c2", 40))], "qid string, claim_id string, weight int")
    claims = spark.createDataFrame([(q, c, int(c == "c1")) for q in "abd" for c in ("c1", "c2")] + [("c", "c1", 1), ("c", "c3", 1)], "qid string, claim_id string, score int").where("NOT (qid = 'b' AND claim_id = 'c1')")
    assert rows(grading.stale_grades(grades, episodes, ["qid"], ["tokens"], claims, rubric), "qid", "field") == [("b", "lenient"), ("c", "lenient"), ("d", "tokens"), ("e", "lenient"), ("e", "tokens")]


def test_runs_are_compared_by_grid_and_seed(spark):
    manifests = [spark.createDataFrame([(m, None)], "model string, note string") for m in ("m", "m")]
    a, b = (spark.createDataFrame(x, "qid string, seed int") for x in ([("p", 1), ("q", 2), ("r", None)], [("q", 3), ("r", None), ("s", 1), ("t", 1)]))
    assert rows(grading.compat_report(*manifests, ["model", "note"], a, b, ["qid"]), "field", "a", "b") == [("grid", "1", "2"), ("seed", "1", "1")]
    assert grading.compat_report(*manifests, ["model", "note"], a, a, ["qid"]).count() == 0


def test_grid_from_rows_and_lists(spark):
    manifest = spark.createDataFrame([("r", ["x", "y"], 2, ["q1"])], "run string, budgets array<string>, rollouts int, question_ids array<string>")
    want = [("r", b, i, "q1") for b in "xy" for i in (0, 1)]
    asked = spark.createDataFrame([("r", "q1"), ("r", "q1")], "run string, qid string")
    assert rows(grading.grid_of(manifest), "run", "budget", "rollout", "qid") == want == rows(grading.grid_of(manifest.drop("question_ids"), asked), "run", "budget", "rollout", "qid")


# statistics


def test_unequal_arms_are_rejected(spark):
    a, b = (spark.createDataFrame(x, "budget string, qid string, score double") for x in ([("x", "p", 1.0), ("x", "q", 2.0)], [("x", "p", 3.0)]))
    with pytest.raises(stats.PopulationError):
        stats.paired_questions(a, b)
    assert rows(stats.paired_questions(*stats.shared_population(a, b)), "qid", "delta") == [("p", 2.0)]
    assert stats.paired_questions(a.limit(0), b.limit(0)).count() == 0


def test_largest_gainers(spark):
    means = spark.createDataFrame([("r", b, q, s) for q, (x, y) in {"p": (1.0, 9.0), "q": (5.0, 5.0), "s": (0.0, 8.0), "t": (3.0, None)}.items() for b, s in (("low", x), ("high", y))], "run string, budget string, qid string, score double")
    assert rows(stats.largest_gainers(means, "low", "high", 2), "rank", "qid", "gain") == [(1, "p", 8.0), (2, "s", 8.0)]


def test_row_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert rows(lineage.numbered(df, ["x"], "place"), "x", "place") == [(i, i) for i in range(1000)]
    assert lineage.numbered(df.limit(0), ["x"], "place").count() == 0


# traces, curation, notes


def test_turns_and_forced_budgets(spark):
    turns = spark.createDataFrame([("a", 0, "finish"), ("a", 1, "read"), ("a", 2, "finish"), ("b", 0, None)], "k string, turn int, tool string")
    assert rows(traces.turn_counts(turns, ["k"]), "k", "turns", "finish_catches", "tool_calls") == [("a", 3, 2, 1), ("b", 1, 0, 1)]
    cases = spark.createDataFrame([("forced", "ok", 5), ("forced", "ok", 4), ("forced", "no_answer", 4), ("voluntary", "ok", 4)], "b string, s string, n int")
    assert [r.s for r in cases.select(traces.forced_status(F.col("s"), F.col("b"), F.col("n"), F.lit(5)).alias("s")).collect()] == ["ok", "forced_short", "no_answer", "ok"]


def test_touch_overlap(spark):
    a, b = (spark.createDataFrame([(x,) for x in files], "file string") for files in ("pqrs", "rst"))
    r = traces.touch_overlap(a, b).first()
    assert (r.shared, r.share_a, round(r.share_b, 6)) == (2, 0.5, 0.666667)
    assert traces.touch_overlap(a, b.limit(0)).first().share_b is None


def test_acceptance_history(spark):
    claim = lambda s: [("c1", s, "why")]
    data = [("pass", 0, claim("0.5"), False, []), ("pass", 1, claim("1"), False, None), ("drop", 0, claim("0"), False, []), ("drop", 3, claim("1"), True, []), ("open", 0, [("c1", None, None)], None, []), ("rule", 0, claim("1"), False, ["two fences"]), ("text", 0, claim("x"), False, [])]
    df = spark.createDataFrame(data, "k string, round int, claims array<struct<claim_id:string,score:string,rationale:string>>, needs_regrade boolean, failures array<string>")
    got = {r.k: r for r in curate.accept_rounds(df, "k").collect()}
    assert {k: (r.status, r.passed_round, r.rounds) for k, r in got.items()} == {"pass": ("accepted", 1, 1), "drop": ("dropped", None, 3), "open": ("open", None, 0), "rule": ("open", None, 0), "text": ("open", None, 0)}
    assert got["pass"].failures == [] and got["drop"].failures == ["regrade"] and got["rule"].failures == ["two fences"] and got["open"].failures == ["c1: none"]
    assert [(h["round"], h["failures"]) for h in got["pass"].history] == [(0, ["c1: 0.5 why"]), (1, [])]


def test_report_of_the_derived_set(spark):
    df = spark.createDataFrame([("t", "hard", "abc", "accepted", True), ("t", "easy", "abcde", "revised", None), ("t", "easy", "a", "dropped", True)], "topic string, d string, q string, s string, scope boolean")
    r = curate.final_report(df, "topic", "d", "q", "s", "scope").first()
    assert (r.bundles, r.kept, r.revised, r.dropped, r.hard, r.median_chars, r.in_scope) == (3, 2, 1, 1, 1, 4.0, 1)
    assert curate.derived_scope(df, "s", "scope").count() == 1


def test_objects_are_numbered_by_kind(spark):
    protocol = spark.createDataFrame([(2, "later"), (1, "first")], "position int, claim string")
    items = spark.createDataFrame([("b", 5, "i1"), ("b", 3, "i0"), ("a", 1, "i2")], "topic string, position int, claim string")
    places = spark.createDataFrame([("b", 1, "f.py"), ("c", 1, "g.py")], "topic string, position int, file string")
    got = {(r.object_id, r.type, r.claim, r.file) for r in foldback.object_entries(protocol, items, places).collect()}
    assert got == {("p0", "protocol_item", "first", None), ("p1", "protocol_item", "later", None), ("t0i0", "content_item", "i2", None), ("t1i0", "content_item", "i0", None), ("t1i1", "content_item", "i1", None), ("t1m0", "map_entry", None, "f.py"), ("t2m0", "map_entry", None, "g.py")}


def test_note_with_protocol_and_keys(spark):
    entries = spark.createDataFrame([(1, "B", "two", "", 2), (1, "B", "one", "x", 1)], "n int, section string, text string, code string, position int")
    plan = spark.createDataFrame([(0, "A"), (1, "B")], "position int, name string")
    store = spark.createDataFrame([(1, 2, "k2"), (1, 1, "k1"), (9, 1, "alone")], "n int, position int, store_key string")
    got = {r.n: r.rendered for r in foldback.render_note(entries, plan, "n", "T", " Look. ", store).collect()}
    assert got == {1: "# T\n\n## Answer protocol\nLook.\n\n## B\n\n- one\n```python\nx\n```\n\n- two\n\n## Keys\n- `k1`\n- `k2`\n", 9: "# T\n\n## Answer protocol\nLook.\n\n## Keys\n- `alone`\n"}


def test_fingerprint_of_many_groups(spark):
    files = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(100)], "path string, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashes = sorted(sha(f"p{i}\n{sha(f't{i}')}") for i in range(100))
    assert tuple(codesearch.corpus_fingerprint(files).first()) == (100, sha(",".join(hashes)))
    first = [sha(",".join(h for h in hashes if h[0] == d)) for d in "0123456789abcdef" if any(h[0] == d for h in hashes)]
    leaf = {d: sha(",".join(h for h in hashes if h[0] == d)) for d in sorted({h[0] for h in hashes})}
    folded = sha(",".join(leaf[d] for d in sorted(leaf)))
    assert tuple(codesearch.corpus_fingerprint(files, 10).first()) == (100, folded) and len(first) == len(leaf)
    assert codesearch.corpus_fingerprint(files.limit(0)).first().files == 0


def test_fingerprint_of_many_files_is_one_hash(spark):
    """More files than a group once held; equal files; a file without a text, which SQL counts and doesn't hash."""
    many = 70_000
    files = spark.range(many).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("path"), F.concat(F.lit("t"), (F.col("id") % 9).cast("string")).alias("text"))
    odd = spark.createDataFrame([("p0", "t0"), ("none", None)], "path string, text string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashes = sorted([sha(f"p{i}\n{sha(f't{i % 9}')}") for i in range(many)] + [sha(f"p0\n{sha('t0')}")])
    assert tuple(codesearch.corpus_fingerprint(files.unionByName(odd)).first()) == (many + 2, sha(",".join(hashes)))
    assert tuple(codesearch.corpus_fingerprint(odd.where("text IS NULL")).first()) == (1, None)


def test_surface_is_rows(spark):
    files = spark.createDataFrame([("a/y.py",), ("a/x.py",), ("a/x.py",), ("z.py",), ("a/n.txt",)], "path string")
    assert [tuple(r) for r in codesearch.corpus_surface(files).collect()] == [("", "z"), ("a", "x"), ("a", "y")]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="checkpoint"):
        lineage.shared_dir(Session())
    Session.sparkContext.master = "local[4]"
    assert lineage.shared_dir(Session()) == lineage.LOCAL_DIR


def test_hashed_runs_equal_runs_of_words():
    rng = np.random.default_rng(8)
    texts = ["", "a", "a b", "a b c", "a b a b a b", "é ü 日本 x y", "w" * 5000, *(" ".join(rng.choice(["x", "yy", "zzz", "é"], int(rng.integers(0, 40)))) for _ in range(300))]
    grams = lambda t, k: ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if (w := t.split()) else set()
    for k in (1, 3, 5):
        for some in (texts, texts[::-1], texts[:1], []):
            got = text._run_hashes(pa.array(["skip me", *some], pa.string()).slice(1), k).to_pylist()
            name = {}
            for t, hashes in zip(some, got, strict=True):
                assert len(set(hashes)) == len(hashes) == len(grams(t, k))
                for g in grams(t, k):
                    name.setdefault(g, set(hashes)).intersection_update(hashes)
            assert all(name.values())  # a run has one hash in all texts that hold it


# decontamination


def plain_overlaps(a, b):
    grams = lambda t: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} if len(t.split()) > 2 else {tuple(t.split())} if t.split() else set()
    one_, two = {i: grams(t) for i, t in enumerate(a)}, {j: grams(t) for j, t in enumerate(b)}
    return {(i, j): len(x & y) / len(x | y) for i, x in one_.items() for j, y in two.items() if x & y}


def passages(seed, rows, frames):
    """Texts of rare words, of one of ``frames`` passages that many hold, or of both, some of them copies with edits."""
    rng = np.random.default_rng(seed)
    frame = [words_of(np.random.default_rng(100 + i), 14, 30) for i in range(frames)]
    texts = []
    for i in range(rows):
        own = words_of(rng, int(rng.integers(0, 20)), 400)
        texts.append([own, frame[i % frames], f"{frame[i % frames]} {own}", f"{own} {frame[i % frames]} {frame[(i + 1) % frames]}", texts[int(rng.integers(0, i))] + " more words" if i else "", ""][int(rng.integers(0, 6))])
    return texts


@pytest.mark.parametrize("bound, rare, seed", [(0, 64, 1), (1_000_000, 3, 2), (0, 3, 3), (1_000_000, 0, 4)])
def test_prefix_filter_and_best_overlaps_equal_brute_force(spark, bound, rare, seed):
    a, b = passages(seed, 40, 3), passages(seed + 50, 30, 3)
    want = plain_overlaps(a, b)
    one_, two = (cut(dedup.shingle_sets(spark.createDataFrame(list(enumerate(t)), "id int, t string"), "id", "t")) for t in (a, b))
    for threshold in (0.05, 0.35, 0.5, 0.9):
        got = {(r.a_key, r.b_key): round(r.similarity, 9) for r in dedup.pairs_above(one_, two, threshold, bound).collect()}
        assert got == {p: round(s, 9) for p, s in want.items() if s > threshold}
    best = {i: 0 for i, t in enumerate(a) if t}
    for (i, _), s in want.items():
        best[i] = max(s, best[i])
    assert {r.key: round(r.best, 9) for r in dedup.best_overlaps(one_, two, rare, bound).collect()} == {i: round(s, 9) for i, s in best.items()}


def test_frequent_passages_make_no_pairs(spark):
    """A passage in all texts of both sides: neither join sees a row for each pair of texts."""
    frame, rng = words_of(np.random.default_rng(5), 60, 1000), np.random.default_rng(6)
    a, b = ([f"{frame} {words_of(rng, 12, 100_000)}" for _ in range(300)] for _ in range(2))
    one_, two = (cut(dedup.shingle_sets(spark.createDataFrame(list(enumerate(t)), "id int, t string"), "id", "t")) for t in (a, b))
    assert dedup.pairs_above(one_, two, 0.9).count() == 0
    sides = dedup.Ordered(one_, two)
    few = F.filter("known", lambda x: x.f <= dedup.RARE)
    first = F.slice("known", F.lit(1), F.greatest(F.size("known") - F.floor(F.col("n") * 0.9 - dedup.SLACK).cast("int"), F.lit(0)))
    assert sides.matched(few, few).count() < 10 and sides.matched(first, first).count() < 3000  # of 90,000 pairs
    best = dedup.best_overlaps(one_, two)
    assert best.count() == 300 and best.where("best < 0.6").count() == 0


def test_decontamination_edges(spark):
    none = spark.createDataFrame([], "id int, t string")
    some = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (4, "a b c d"), (5, "x y z")], "id int, t string")
    for one_, two in ((none, some), (some, none), (none, none)):
        assert dedup.decontaminate(one_, two, "id", "t", "id", "t").where("max_similarity > 0").count() == 0
        assert dedup.reject_repeats(one_, two, "id", "t", "id", "t").count() == one_.count()
    got = {r.id: (r.max_similarity, r.kept) for r in dedup.decontaminate(some, some, "id", "t", "id", "t").collect()}
    assert got == {1: (0.0, True), 2: (0.0, True), 3: (1.0, False), 4: (1.0, False), 5: (1.0, False)}


# cells of near vectors


def clustered(seed, many, wide=8, groups=12, spread=0.03):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, wide))
    vs = centres[rng.integers(0, groups, many)] + rng.normal(size=(many, wide)) * spread
    return vs / np.linalg.norm(vs, axis=1, keepdims=True)


def vector_rows(spark, vs):
    return spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(vs)], "key long, v array<double>, weight long")


def test_pivot_tree_bounds_blocks_and_keeps_near_rows(spark):
    vs = np.concatenate([clustered(7, 300), np.repeat(clustered(8, 1), 60, 0)])  # one vector more often than a block holds
    rows_ = vector_rows(spark, vs)
    tree = cells.PivotTree(rows_, block_rows=16)
    leaf = {r.key: r.leaf for r in tree.placed.collect()}
    assert len(leaf) == len(vs) and max(np.unique(list(leaf.values()), return_counts=True)[1]) <= 16 and len(tree.levels) >= 2
    for reach in (0.0, 0.1, 0.6):
        asked = {(r.key, r.leaf) for r in tree.asked(rows_.withColumn("reach", F.lit(reach))).collect()}
        near = np.argwhere(cells.distances(vs, vs) <= reach)
        assert all((i, leaf[j]) in asked for i, j in near.tolist())
    assert {r.key for r in tree.home(rows_).collect()} == set(leaf)


def test_pairs_of_blocks_grow_less_than_quadratically(spark):
    asked = []
    for many in (400, 1600):
        rows_ = vector_rows(spark, clustered(9, many, groups=40, spread=0.01))
        tree = cells.PivotTree(rows_, block_rows=16)
        asked.append(tree.asked(rows_.withColumn("reach", F.lit(0.05))).count())
    assert asked[1] < 8 * asked[0]  # four times the rows; with all blocks it would be sixteen times


@pytest.mark.parametrize("few", [0, 100_000])
def test_forest_is_minimal(spark, few):
    rng = np.random.default_rng(10)
    edges = [(int(a), int(b), float(rng.integers(1, 12))) for a, b in rng.integers(0, 40, (150, 2))]
    got = vectors.spanning_forest(spark.createDataFrame(edges, "a long, b long, w double"), few).collect()
    for cut_at in range(1, 13):
        joins = [vectors.Joined(), vectors.Joined()]
        for join, some in zip(joins, (edges, [(r.a, r.b, r.w) for r in got]), strict=True):
            for a, b, w in some:
                if w <= cut_at:
                    join.link(a, b)
        assert [joins[0].root(i) for i in range(40)] == [joins[1].root(i) for i in range(40)]
    check = vectors.Joined()
    assert all(check.link(r.a, r.b) for r in got)  # a forest


def test_local_forest_is_minimal():
    rng = np.random.default_rng(11)
    for _ in range(30):
        weights = rng.integers(1, 9, (7, 9)).astype(float)
        weights[rng.random((7, 9)) < 0.5] = np.inf
        found = vectors._spanning(weights)
        for cut_at in range(1, 9):
            joins = [vectors.Joined(), vectors.Joined()]
            for i, j in np.argwhere(weights <= cut_at).tolist():
                joins[0].link(i, 100 + j)
            for i, j, w in found:
                assert w == weights[i, j]
                if w <= cut_at:
                    joins[1].link(i, 100 + j)
            nodes = [*range(7), *range(100, 109)]
            assert [joins[0].root(n) for n in nodes] == [joins[1].root(n) for n in nodes]


def test_components_with_and_without_rounds(spark):
    links = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3)]
    nodes = spark.range(0, 11).withColumnRenamed("id", "key")
    for few in (0, 100):
        got = {r.key: r.label for r in vectors.components(nodes, spark.createDataFrame(links, "a long, b long"), few).collect()}
        assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 1, 9: 1, 10: 10}


@pytest.mark.parametrize("block", [1024, 24])
def test_cuts_of_one_forest_equal_single_clusterings(spark, block, monkeypatch):
    vs = np.concatenate([clustered(12, 90, spread=0.1), np.repeat(clustered(13, 3), 6, 0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)] + [(900, None), (901, [0.0] * 8)], "id long, v array<double>")
    grid = [(e, m, n) for e in (0.002, 0.01, 0.03, 0.2) for m, n in ((2, 2), (5, 3), (5, 8))]
    passes = []
    blocks = cells.PivotTree.blocks
    monkeypatch.setattr(cells.PivotTree, "blocks", lambda self, *a: passes.append(1) or blocks(self, *a))
    got = {}
    for r in vectors.cluster_cuts(df, "id", "v", grid, block).collect():
        got.setdefault(r.setting, {})[r.id] = r.cluster
    assert len(passes) == 2  # of near blocks: nearest distances and forests, whatever the grid
    for i, (eps, samples, least) in enumerate(grid):
        want = brute_clusters(vs, eps, samples, least)
        assert [got[i][k] for k in range(len(vs))] == want.tolist() and got[i][900] == got[i][901] == -1
    assert {r.id: r.cluster for r in vectors.density_cluster(df, "id", "v", 0.03, 5, 3).collect()} == got[7]


def test_scattered_rows_settle_at_the_hub(spark, monkeypatch):
    """Vectors without clusters at a wide eps, where every leaf is near every row: hardly any row goes down the tree. A far
    group and lone rows, which the hub doesn't settle, keep their clusters."""
    rng = np.random.default_rng(21)
    scattered, far = rng.normal(size=(900, 6)), rng.normal(size=(8, 6)) * 0.02
    scattered[:, 0], far[:, 0] = 0, 1
    vs = np.concatenate([scattered, far, -np.eye(6)[:1]])
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id long, v array<double>")
    went = []
    asked = cells.PivotTree.asked
    monkeypatch.setattr(cells.PivotTree, "asked", lambda self, rows_: went.append(rows_.count()) or asked(self, rows_))
    grid = [(0.4, 4, 5), (0.55, 6, 9)]
    got = {(r.setting, r.id): r.cluster for r in vectors.cluster_cuts(df, "id", "v", grid, 256).collect()}
    for i, (eps, samples, least) in enumerate(grid):
        want = brute_clusters(vs, eps, samples, least)
        assert [got[i, k] for k in range(len(vs))] == want.tolist() and want.max() == 1 - i and want[-1] == -1
    assert sum(went) < len(vs) // 10


def test_text_is_not_shuffled_for_a_span(spark):
    """Many spans of few ranges: a range is cut once, spans move without text; bad ranges and missing lines count as gone."""
    lines = spark.createDataFrame([("p", i, f"t{i}") for i in range(1, 9)] + [("q", 1, "other")], "path string, line_no int, text string")
    spans = spark.range(0, 3000, 1, 3).select("id", F.when(F.col("id") % 5 < 4, "p").otherwise("none").alias("path"), (F.col("id") % 3 + 1).cast("int").alias("start_line"), (F.col("id") % 4 + 1).cast("int").alias("end_line"))
    text = lambda i: "\n".join(f"{n:04d}: t{n}" for n in range(i % 3 + 1, i % 4 + 2)) if i % 5 < 4 and i % 3 <= i % 4 else None
    kept = curate.cited_lines(spans, lines)
    assert sorted(r.line_no for r in kept.collect()) == [1, 2, 3, 4]
    got = {r.id: r.recomputed for r in curate.with_excerpts(spans, kept).collect()}
    assert got == {i: text(i) for i in range(3000)}
    assert {r.id: r.recomputed for r in curate.excerpts(spans, lines, ["id"]).collect()} == got
    stored = curate.with_excerpts(spans, kept).withColumn("excerpt", F.when(F.col("id") % 7 == 0, "changed").otherwise(F.col("recomputed"))).drop("recomputed")
    found = curate.excerpt_mismatch(stored, kept, ["id"])
    assert sorted(r.id for r in found.collect()) == list(range(0, 3000, 7))
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert len(joins) == 2 and all("start_line" in x and " id#" not in x for x in joins)  # by ranges, never by keys


def test_density_clusters_of_scattered_rows_take_no_tree(spark, monkeypatch):
    """Where the hub settles all rows, no row is copied to leaves: the tree has no rows."""
    vs = np.random.default_rng(29).normal(size=(600, 4))
    vs /= np.linalg.norm(vs, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id long, v array<double>")
    grown = []
    make = cells.PivotTree.__init__
    monkeypatch.setattr(cells.PivotTree, "__init__", lambda self, rows_, *a: grown.append(rows_.count()) or make(self, rows_, *a))
    got = {r.id: r.cluster for r in vectors.density_cluster(df, "id", "v", 0.5, 4, 5, block_rows=200).collect()}
    assert [got[i] for i in range(600)] == brute_clusters(vs, 0.5, 4, 5).tolist() and sum(grown) == 0


@pytest.mark.parametrize("named", [False, True])
def test_neighbours_of_packed_blocks(spark, named, monkeypatch):
    """Several blocks, partitions and groups; more equal rows than neighbours, zeros, a row without a vector; no vector is
    shuffled for a pair of blocks."""
    monkeypatch.setattr(vectors, "PART_ROWS", 40)
    monkeypatch.setattr(vectors, "GROUP_ROWS", 70)
    base = np.random.default_rng(23).normal(size=(150, 6))
    vs = np.concatenate([base, np.repeat(base[3:5], 9, 0), np.zeros((2, 6))])
    keys = [f"k{(i * 37) % 997:03}" if named else (i * 37) % 997 for i in range(len(vs))]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in zip(keys, vs, strict=True)] + [("none" if named else 9999, None)], f"id {'string' if named else 'int'}, v array<double>")
    found = vectors.neighbours(df, "id", "v", 4, block_rows=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    sides = plan[plan.index("CartesianProduct") :].split("Scan ExistingRDD")[:2]
    assert not any("Exchange" in side for side in sides)
    got = {}
    for r in found.orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append((round(abs(r.distance), 9), r.other))
    unit = vs / np.maximum(np.linalg.norm(vs, axis=1, keepdims=True), 1e-300)
    far = np.round(np.abs(1 - unit @ unit.T), 9)
    assert got == {k: sorted((far[i, j], o) for j, o in enumerate(keys) if j != i)[:4] for i, k in enumerate(keys)}
    assert vectors.neighbours(df.limit(0), "id", "v", 4).count() == 0


def test_nearest_cosine_in_a_tree(spark):
    """Clustered and scattered rows, copies, zero vectors on either side, blocks smaller than cells."""
    a = np.concatenate([clustered(14, 60), clustered(15, 20, groups=20), np.zeros((1, 8))])
    b = np.concatenate([clustered(14, 400), np.repeat(clustered(16, 1), 40, 0)])
    frame = lambda x: spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "key long, v array<double>")
    for base in (b, np.concatenate([b, np.zeros((1, 8))])):
        got = {r.key: r.nearest for r in vectors._nearest_in_tree(frame(a), frame(base).select("v"), 16).collect()}
        want = (a @ base.T).max(1)
        assert len(got) == len(a) and all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want))
    none = vectors._nearest_in_tree(frame(a), frame(b).limit(0).select("v"), 16)
    assert [r.nearest for r in none.collect()] == [None] * len(a)


# ranks within keys


def test_ranks_within_a_hot_key(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rng = np.random.default_rng(17)
        data = [(["hot", "cold", None, "rare"][k], int(x), i) for i, (k, x) in enumerate(zip(rng.choice(4, 400, p=[0.6, 0.25, 0.1, 0.05]), rng.integers(0, 50, 400), strict=True))]
        df = spark.createDataFrame(data, "k string, x int, i int")
        got = lineage.ranked(df, "k", [F.desc("x"), F.col("i")], "rank", "n")
        assert got.columns == ["k", "x", "i", "rank", "n"]
        want = {}
        for k in {d[0] for d in data}:
            own = sorted((d for d in data if d[0] == k), key=lambda d: (-d[1], d[2]))
            want |= {d[2]: (place, len(own)) for place, d in enumerate(own, 1)}
        assert {r.i: (r["rank"], r.n) for r in got.collect()} == want
        parts = lineage._in_order(df, [F.col("k"), F.desc("x"), F.col("i")]).where("k = 'hot'").groupBy("__part").count().collect()
        assert len(parts) > 3 and max(r["count"] for r in parts) < 150  # the hot key's 240 rows are split
        assert lineage.ranked(df.limit(0), "k", [F.col("i")], "rank", "n").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# replicates as vectors


def test_replicates_equal_single_draws(spark, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 4)
    rng = np.random.default_rng(20)
    sums = [(run, b, q, float(rng.integers(0, 9)), float(rng.integers(1, 99)), int(rng.integers(1, 4))) for run in "ab" for b in (1, 2, 5) for q in range(11) if rng.random() < 0.9]
    df = spark.createDataFrame(sums, "run string, budget int, qid int, s double, t double, n long")
    places = stats.number_questions(df)
    got = {r.rep: r.delta for r in stats.bootstrap_deltas(df, places, "a", "b", 70, 3, None).collect()}
    assert sorted(got) == list(range(70))
    count = places.count()
    for rep in (0, 13, 69):
        times = spark.createDataFrame([(int(stats.draws(3, [(rep, i)])[0]) % count,) for i in range(count)], "place long").groupBy("place").agg(F.count(F.lit(1)).alias("times"))
        area = stats.areas(times.join(places, "place").join(df, "qid").withColumn("rep", F.lit(rep)), ["rep"], None)
        assert abs(stats.deltas_of(area, ["rep"], "a", "b").first().delta - got[rep]) < 1e-9
    seeds = spark.createDataFrame([(1, "x", None), (2, None, "é")], "a int, b string, c string")
    assert [r[0] for r in seeds.select(stats.draw(9, F.col("a"), F.col("b"), F.col("c"))).collect()] == stats.draws(9, [(1, "x", None), (2, None, "é")]).tolist()


def test_sign_flips_equal_plain_loop(spark):
    deltas = [(1, "q1", 0.5), (1, "q2", -0.25), (2, "q1", 1.0), (2, "q3", None), (None, "q4", 0.75)]
    got = stats.permutation_test(spark.createDataFrame(deltas, "budget int, qid string, delta double").repartition(2), 50, 7).first()
    real = [d for d in deltas if d[2] is not None]
    mean = sum(d[2] for d in real) / 4
    flipped = [sum(d * (1 if stats.draws(7, [(rep, b, q)])[0] % 2 == 0 else -1) for b, q, d in real) / 4 for rep in range(50)]
    assert got.mean_delta == mean and abs(got.p_value - (sum(abs(f) >= abs(mean) - 1e-12 for f in flipped) + 1) / 51) < 1e-12


def test_large_groups_come_in_parts(spark):
    entries = spark.createDataFrame([(i, ["a", "b"][: i % 3]) for i in range(30)], "id int, grounding_paths array<string>")
    got = {(r.group, r.part): r.ids for r in foldback.verify_groups(entries, most=4).collect()}
    for k, name in enumerate(["", "a", "a|b"]):
        own = [i for i in range(30) if i % 3 == k]
        assert [got.pop((name, p)) for p in range(3)] == [own[:4], own[4:8], own[8:]]
    assert not got

"""Grading, metrics and statistics on graded episodes made from ``events`` and claims made from ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import grading, metrics, stats
from .proxies import AREA, BUDGETS, G, R, arm, claims, grades
from .registry import query, table

VERDICT_SQL = f"WITH {R} SELECT qid, claim_id, score, 'why ' || claim_id AS rationale FROM r"


def verdicts(spark, sf_dir):
    """qid, verdict: JSON with the claims as an array for even questions and as an object for odd ones."""
    c = claims(spark, sf_dir).withColumn("why", F.concat(F.lit("why "), F.col("claim_id")))
    listed = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("claim_id", "score", F.col("why").alias("rationale")))).alias("claims")))
    keyed = F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(F.struct("claim_id", F.struct("score", F.col("why").alias("rationale")))))).alias("claims")))
    return c.groupBy("qid").agg(F.when(F.col("qid") % 2 == 0, listed).otherwise(keyed).alias("verdict"))


@query("gr1_parse_verdict", VERDICT_SQL)
def gr1(spark, sf_dir):
    return grading.parse_verdict(verdicts(spark, sf_dir), "verdict", ["qid"])


@query(
    "gr2_verdict_violations",
    f"WITH {R} SELECT qid, claim_id, 'missing' AS rule FROM r WHERE claim_id = 'c1' UNION ALL SELECT qid, 'c9' AS claim_id, 'unexpected' AS rule FROM r WHERE claim_id = 'c7' "
    "UNION ALL SELECT qid, claim_id, 'score' AS rule FROM r WHERE claim_id = 'c2' AND score + 1 > 1",
)
def gr2(spark, sf_dir):
    c = claims(spark, sf_dir)
    given = c.where("claim_id <> 'c1'").select("qid", F.when(F.col("claim_id") == "c7", "c9").otherwise(F.col("claim_id")).alias("claim_id"), F.when(F.col("claim_id") == "c2", F.col("score") + 1).otherwise(F.col("score")).alias("score"), F.lit("why").alias("rationale"))
    return grading.verdict_violations(given, c.where("claim_id <> 'c7'"), "qid")


#: Rules in the order of the remainder of o_orderkey by 9 that breaks them; with the last remainder all hold.
FAULTS = ["json", "fields", "claims", "claim_fields", "regrade", "total", "stop", "usage"]
_ONE = '{"claim_id":"c1","score":1,"rationale":"r"'


@query(
    "gr2_response_violations",
    "WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 9 AS k FROM orders) "
    + " UNION ALL ".join(f"SELECT o_orderkey, '{rule}' AS rule FROM o WHERE k = {i}" for i, rule in enumerate(FAULTS))
    + " UNION ALL SELECT o_orderkey, 'budget' AS rule FROM o WHERE o_custkey >= 500",
)
def gr2_responses(spark, sf_dir):
    k = F.col("o_orderkey") % 9
    claims_ = F.when(k == 2, F.lit('{"c1":{"score":1,"rationale":"r"}}')).when(k == 3, F.lit(f'[{_ONE},"note":"n"}}]')).otherwise(F.lit(f"[{_ONE}}}]"))
    regrade, total = F.when(k == 4, "true").otherwise("false"), F.when(k == 5, F.lit('"40"')).otherwise(F.col("o_custkey").cast("string"))
    body = F.concat(F.lit('{"claims":'), claims_, F.lit(',"question_score":'), total, F.lit(',"needs_regrade":'), regrade, F.when(k == 1, F.lit(',"more":1}')).otherwise("}"))
    n = F.col("o_custkey").cast("bigint")
    usage = F.struct(n.alias("prompt_tokens"), n.alias("completion_tokens"), (2 * n + F.when(k == 7, 1).otherwise(0)).alias("total_tokens"))
    raw = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body).alias("content"), F.when(k == 6, "length").otherwise("stop").alias("finish"), usage.alias("usage"))
    return grading.response_violations(raw, ["o_orderkey"], "content", "paper", "finish", "usage", 500)


@query("gr3_lenient_score", f"WITH {R} SELECT qid, CAST(sum(weight * score) AS BIGINT) AS lenient FROM r GROUP BY qid")
def gr3(spark, sf_dir):
    c = claims(spark, sf_dir)
    return grading.lenient_score(c.select("qid", "claim_id", "score"), c, ["qid"], "qid")


@query("gr4_strict_score", f"WITH {R} SELECT qid, CAST(sum(weight * score) AS BIGINT) AS lenient, CAST(CASE WHEN coalesce(min(score) FILTER (claim_type = 'core'), 1) > 0 AND qid % 10 <> 0 THEN sum(weight * score) ELSE 0 END AS BIGINT) AS strict FROM r GROUP BY qid")
def gr4(spark, sf_dir):
    c = claims(spark, sf_dir)
    compiles = c.select("qid", (F.col("qid") % 10 != 0).alias("compiles")).distinct()
    return grading.strict_score(c.select("qid", "claim_id", "score"), c, ["qid"], "qid", compiles)


@query("gr5_zero_fill", f"WITH {R} SELECT qid, claim_id, CASE WHEN qid % 3 = 0 THEN 0 ELSE score END AS score, CASE WHEN qid % 3 = 0 THEN 'No answer.' ELSE 'why' END AS rationale FROM r")
def gr5(spark, sf_dir):
    c = claims(spark, sf_dir)
    answered = c.where("qid % 3 <> 0").select("qid", "claim_id", "score", F.lit("why").alias("rationale"))
    status = F.when(F.col("qid") % 3 == 0, "no_answer").otherwise("ok")
    return grading.zero_fill(c.select("qid", status.alias("status")).distinct(), c, answered, ["qid"], "qid")


@query(
    "gr6_total_mismatch",
    f"WITH {R}, t AS (SELECT qid, sum(weight * score) AS s, sum(weight * score) + CASE WHEN qid % 5 = 0 THEN qid % 7 ELSE 0 END AS j FROM r GROUP BY qid) "
    "SELECT CAST(count(*) AS BIGINT) AS graded, CAST(count(*) FILTER (j <> s) AS BIGINT) AS mismatches, round(avg(abs(j - s)) FILTER (j <> s), 6) AS mean_abs_diff, round(avg(j - s), 6) AS mean_shift FROM t",
)
def gr6(spark, sf_dir):
    c = claims(spark, sf_dir)
    total = grading.lenient_score(c.select("qid", "claim_id", "score"), c, ["qid"], "qid").withColumn("judged", F.col("lenient") + F.when(F.col("qid") % 5 == 0, F.col("qid") % 7).otherwise(0))
    out = grading.total_mismatch(total, "judged", "lenient")
    return out.select("graded", "mismatches", F.round("mean_abs_diff", 6).alias("mean_abs_diff"), F.round("mean_shift", 6).alias("mean_shift"))


GRID = "x AS (SELECT run, budget, rollout, qid FROM (SELECT DISTINCT run FROM g), (SELECT DISTINCT budget FROM g), (SELECT unnest([0, 1, 2]) AS rollout), (SELECT DISTINCT qid FROM g WHERE qid % 2 = 0)), k AS (SELECT DISTINCT run, budget, rollout, qid FROM g)"


@query(
    "gr7_population_gaps",
    f"WITH {G}, {GRID} SELECT *, 'missing' AS problem FROM (SELECT run, budget, CAST(rollout AS BIGINT) AS rollout, qid FROM x EXCEPT SELECT * FROM k) UNION ALL SELECT *, 'unexpected' AS problem FROM (SELECT * FROM k EXCEPT SELECT run, budget, CAST(rollout AS BIGINT), qid FROM x)",
)
def gr7(spark, sf_dir):
    g = grades(spark, sf_dir)
    manifest = g.groupBy("run").agg(F.array(*map(F.lit, BUDGETS)).alias("budgets"), F.lit(3).alias("rollouts"))
    asked = g.select("run").distinct().join(g.where("qid % 2 = 0").select("qid").distinct(), how="cross")  # two runs
    return grading.population_gaps(grading.grid_of(manifest, asked), g, ["run", "budget", "rollout", "qid"])


SEED_SQL = "('0x' || substr(sha256(run || '|' || budget || '|' || rollout || '|' || qid), 1, 8))::BIGINT & 2147483647"


@query(
    "gr8_episode_violations",
    f"WITH {G} SELECT event_id, 'status' AS rule FROM g WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'answer' AS rule FROM g WHERE status = 'ok' AND event_id % 11 <> 0 AND event_id % 13 = 0 "
    "UNION ALL SELECT event_id, 'tokens' AS rule FROM g WHERE tokens - 600 < 0 UNION ALL SELECT event_id, 'seed' AS rule FROM g WHERE event_id % 17 = 0 "
    "UNION ALL SELECT event_id, 'key' AS rule FROM g WHERE event_id % 19 = 0 OR event_id % 23 = 0 UNION ALL SELECT event_id, 'fingerprint' AS rule FROM g WHERE event_id % 29 = 0",
)
def gr8(spark, sf_dir):
    i = F.col("event_id")
    seed = ids.stable_seed(F.col("run"), F.col("budget"), F.col("rollout"), F.col("qid"))
    asked = F.concat(F.lit("note\n\nquestion "), F.col("qid").cast("string"))
    e = grades(spark, sf_dir).withColumns({
        "status": F.when(i % 11 == 0, "failed").otherwise(F.col("status")), "answer": F.when((F.col("status") == "no_answer") | (i % 13 == 0), " ").otherwise("x = 1"),
        "gen_tokens": F.col("tokens") - 600, "seed": F.when(i % 17 == 0, seed + 1).otherwise(seed), "path_budget": F.when(i % 19 == 0, "other").otherwise(F.col("budget")),
        "path_qid": F.when(i % 23 != 0, F.col("qid")), "question_sha256": F.sha2(F.when(i % 29 == 0, "changed").otherwise(asked), 256),
    })
    expected = {"budget": F.col("path_budget"), "qid": F.col("path_qid")}
    return grading.episode_violations(e, seed, expected, (F.col("question_sha256"), F.sha2(asked, 256))).select("event_id", "rule")


@query("gr9_stale_grades", f"WITH {G} SELECT event_id, 'tokens' AS field FROM g WHERE event_id % 19 = 0 OR event_id % 23 = 0 UNION ALL SELECT event_id, 'score' AS field FROM g WHERE event_id % 23 = 0")
def gr9(spark, sf_dir):
    g = grades(spark, sf_dir)
    changed = g.where("event_id % 23 <> 0").withColumn("tokens", F.when(F.col("event_id") % 19 == 0, F.col("tokens") + 1).otherwise(F.col("tokens")))
    return grading.stale_grades(g, changed, ["event_id"], ["tokens", "score"])


@query("gr9_stale_scores", f"WITH {R}, q AS (SELECT qid, bool_or(claim_id = 'c3') AS lacks FROM r GROUP BY qid) SELECT qid, 'lenient' AS field FROM q WHERE qid % 6 = 0 OR (qid % 6 = 1 AND lacks)")
def gr9_scores(spark, sf_dir):
    """Grades whose total was changed, or whose claims lack one of the rubric's."""
    c = claims(spark, sf_dir)
    total = grading.lenient_score(c.select("qid", "claim_id", "score"), c, ["qid"], "qid")
    stored = total.withColumn("lenient", F.col("lenient") + F.when(F.col("qid") % 6 == 0, 1).otherwise(0))
    given = c.where("qid % 6 <> 1 OR claim_id <> 'c3'").select("qid", "claim_id", "score")
    return grading.stale_grades(stored, total.select("qid"), ["qid"], [], given, c)


@query(
    "gr10_compat_report",
    f"WITH {G}, m AS (SELECT run, count(*) AS episodes, max(budget) AS last_budget, min(score) AS least_score FROM g GROUP BY run), "
    "e AS (SELECT run, budget, rollout, qid, max(event_id) % 7 AS seed FROM g GROUP BY 1, 2, 3, 4), x AS (SELECT * FROM e WHERE run = 'a'), y AS (SELECT * FROM e WHERE run = 'b'), "
    "f AS (SELECT x.seed AS s, y.seed AS t, x.run AS xr, y.run AS yr FROM x FULL JOIN y USING (budget, rollout, qid)) "
    "SELECT 'episodes' AS field, '{\"v\":' || a.episodes || '}' AS a, '{\"v\":' || b.episodes || '}' AS b FROM m a, m b WHERE a.run = 'a' AND b.run = 'b' AND a.episodes <> b.episodes "
    "UNION ALL SELECT 'grid', CAST(count(*) FILTER (yr IS NULL) AS VARCHAR), CAST(count(*) FILTER (xr IS NULL) AS VARCHAR) FROM f HAVING count(*) FILTER (yr IS NULL OR xr IS NULL) > 0 "
    "UNION ALL SELECT 'seed', CAST(count(*) FILTER (s <> t) AS VARCHAR), CAST(count(*) FILTER (s <> t) AS VARCHAR) FROM f HAVING count(*) FILTER (s <> t) > 0",
)
def gr10(spark, sf_dir):
    g = grades(spark, sf_dir)
    m = g.groupBy("run").agg(F.count(F.lit(1)).alias("episodes"), F.max("budget").alias("last_budget"), F.min("score").alias("least_score"))
    e = g.groupBy("run", "budget", "rollout", "qid").agg((F.max("event_id") % 7).alias("seed"))
    return grading.compat_report(arm(m, "a"), arm(m, "b"), ["episodes", "last_budget", "least_score"], arm(e, "a"), arm(e, "b"), ["budget", "rollout", "qid"])


@query(
    "gr11_token_ledger",
    "SELECT conv_id, CAST(count(*) AS BIGINT) AS calls, CAST(sum(length(text)) AS BIGINT) AS prompt_tokens, CAST(sum(turn) AS BIGINT) AS completion_tokens, CAST(count(*) FILTER (turn = 3) AS BIGINT) AS bad_calls FROM conversations GROUP BY conv_id",
)
def gr11(spark, sf_dir):
    n = F.char_length("text").cast("bigint")
    call = F.struct("turn", n.alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), (n + F.when(F.col("turn") == 3, 0).otherwise(F.col("turn"))).alias("total_tokens"))
    return grading.token_ledger(table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(call).alias("usage")), "usage", ["conv_id"])


TWO = f"WITH {R}, q AS (SELECT qid, sum(weight * score) AS x, sum(weight * score2) AS y FROM r GROUP BY qid)"


@query(
    "gr12_judge_agreement",
    f"{TWO} SELECT CAST(count(*) AS BIGINT) AS episodes, CAST(count(*) FILTER (x = y) AS BIGINT) AS exact, CAST(count(*) FILTER (x > y) AS BIGINT) AS a_higher, CAST(count(*) FILTER (x < y) AS BIGINT) AS b_higher, round(avg(y - x), 6) AS bias, round(avg(abs(y - x)), 6) AS mean_abs_diff FROM q",
)
def gr12(spark, sf_dir):
    c = claims(spark, sf_dir)
    one, two = (grading.lenient_score(c.select("qid", "claim_id", F.col(s).alias("score")), c, ["qid"], "qid") for s in ("score", "score2"))
    out = grading.judge_agreement(one, two, ["qid"], "lenient")
    return out.withColumns({"bias": F.round("bias", 6), "mean_abs_diff": F.round("mean_abs_diff", 6)})


@query(
    "gr13_shard_load",
    "SELECT CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), CAST(i * 8 + 1 AS BIGINT), 8))::BIGINT)), lambda r, x: (r * (4294967296 % 8) + x) % 8) AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1",
)
def gr13(spark, sf_dir):
    return grading.shard_load(table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), 8)


# metrics


def points(spark, sf_dir):
    return metrics.budget_means(grades(spark, sf_dir))


@query("ag1_budget_means", f"WITH {G} SELECT run, budget, CAST(count(*) AS BIGINT) AS episodes, round(avg(score), 6) AS score, round(avg(tokens), 6) AS tokens FROM g GROUP BY 1, 2")
def ag1(spark, sf_dir):
    return points(spark, sf_dir).withColumns({"score": F.round("score", 6), "tokens": F.round("tokens", 6)})


@query("ag2_question_means", f"WITH {G} SELECT run, budget, qid, CAST(count(*) AS BIGINT) AS episodes, round(avg(score), 6) AS score, round(avg(tokens), 6) AS tokens FROM g GROUP BY 1, 2, 3")
def ag2(spark, sf_dir):
    return metrics.question_means(grades(spark, sf_dir)).withColumns({"score": F.round("score", 6), "tokens": F.round("tokens", 6)})


@query("ag3_expertise", f"WITH {G}, {AREA} SELECT run, round(expertise, 6) AS expertise FROM e")
def ag3(spark, sf_dir):
    return metrics.expertise(points(spark, sf_dir), ["run"]).select("run", F.round("expertise", 6).alias("expertise"))


@query("ag4_expertise_weights", f"WITH {G}, {AREA} SELECT run, budget, round(share, 6) AS share, round(1 - sum(share) OVER (PARTITION BY run), 6) AS unreached FROM sp")
def ag4(spark, sf_dir):
    return metrics.expertise_weights(points(spark, sf_dir), ["run"]).select("run", "budget", F.round("share", 6).alias("share"), F.round("unreached", 6).alias("unreached"))


_SCEN = AREA.replace("FROM g GROUP BY 1, 2)", "FROM g GROUP BY 1, 2), q AS (SELECT run || '/' || s AS run, budget, episodes, CASE WHEN s = 'better view' AND budget = 'view' THEN 90 ELSE score END AS score, CASE WHEN s = 'cheap click' AND budget = 'click' THEN 3000 ELSE tokens END AS tokens FROM p, (SELECT unnest(['base', 'better view', 'cheap click']) AS s))").replace("FROM p)", "FROM q)")


@query(
    "ag5_expertise_scenarios",
    f"WITH {G}, {_SCEN}, z AS (SELECT split_part(run, '/', 2) AS scenario, split_part(run, '/', 1) AS run, expertise FROM e) SELECT scenario, run, round(expertise, 6) AS expertise, round(expertise - max(CASE WHEN scenario = 'base' THEN expertise END) OVER (PARTITION BY run), 6) AS delta FROM z",
)
def ag5(spark, sf_dir):
    p = points(spark, sf_dir)
    rows = spark.sql("SELECT * FROM VALUES ('better view', 'view', 90D, CAST(NULL AS DOUBLE)), ('cheap click', 'click', CAST(NULL AS DOUBLE), 3000D) AS t(scenario, budget, score, tokens)")
    return metrics.expertise_scenarios(p, rows, ["run"]).select("scenario", "run", F.round("expertise", 6).alias("expertise"), F.round("delta", 6).alias("delta"))


@query("ag6_expertise_by_rollout", "WITH " + G.replace("ELSE 'b' END AS run", "ELSE 'b' END || '/' || event_id % 3 AS run") + f", {AREA} SELECT split_part(run, '/', 1) AS run, CAST(split_part(run, '/', 2) AS BIGINT) AS rollout, round(expertise, 6) AS expertise FROM e")
def ag6(spark, sf_dir):
    return metrics.expertise_by_rollout(grades(spark, sf_dir)).withColumn("expertise", F.round("expertise", 6))


@query("ag7_comparison_table", f"WITH {G} SELECT run, " + ", ".join(f"round(avg(score) FILTER (budget = '{b}'), 6) AS {b}" for b in BUDGETS) + ", 50.0 + ascii(run) AS target FROM g GROUP BY run")
def ag7(spark, sf_dir):
    p = points(spark, sf_dir)
    targets = p.select("run", (F.lit(50.0) + F.ascii("run")).alias("target")).distinct()
    return metrics.comparison_table(p, BUDGETS, targets).select("run", *(F.round(b, 6).alias(b) for b in BUDGETS), "target")


@query("ag8_topic_budget_rollup", f"WITH {G} SELECT topic, budget, CAST(grouping_id(topic, budget) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS episodes, round(avg(score), 6) AS score FROM (SELECT *, 'topic ' || qid % 5 AS topic FROM g) GROUP BY ROLLUP (topic, budget)")
def ag8(spark, sf_dir):
    g = grades(spark, sf_dir).withColumn("topic", F.concat(F.lit("topic "), (F.col("qid") % 5).cast("string")))
    return metrics.topic_budget_rollup(g).withColumn("score", F.round("score", 6))


@query("ag9_status_counts", "SELECT o_orderpriority AS budget, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def ag9(spark, sf_dir):
    return metrics.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "budget"), ["F", "O", "P"], status="o_orderstatus")


@query("ag10_sandbox_stats", "SELECT CASE WHEN event_id % 7 = 0 THEN 'missing' WHEN event_id % 5 = 0 THEN 'syntax' WHEN event_type = 'error' THEN 'crashed' ELSE 'passed' END AS outcome, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def ag10(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return metrics.sandbox_stats(e.select(F.when(F.col("event_id") % 7 == 0, " ").otherwise("x").alias("program"), (F.col("event_id") % 5 != 0).alias("syntax_ok"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code")))


@query(
    "ag11_session_summary",
    "SELECT event_type AS budget, CAST(count(*) AS BIGINT) AS cases, CAST(count(*) FILTER (event_id % 3 = 1) AS BIGINT) AS single_fence, CAST(count(*) FILTER (value > 50) AS BIGINT) AS compliant, round(avg(event_id % 9), 6) AS mean_commands, "
    "CAST(count(*) FILTER (event_id % 4 = 0) AS BIGINT) AS passed, CAST(count(*) FILTER (event_id % 6 > 3) AS BIGINT) AS violation_cases, round(avg(length(props)), 6) AS mean_answer_chars FROM events GROUP BY 1",
)
def ag11(spark, sf_dir):
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("budget"), (i % 3).alias("fences"), (F.col("value") > 50).alias("compliant"), (i % 9).alias("commands"), (i % 4 == 0).alias("passed"), F.greatest(i % 6 - 3, F.lit(0)).alias("violations"), F.col("props").alias("answer"))
    return metrics.session_summary(e).withColumns({"mean_commands": F.round("mean_commands", 6), "mean_answer_chars": F.round("mean_answer_chars", 6)})


@query("ag12_study_tokens", "SELECT role AS phase, CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens FROM conversations GROUP BY role")
def ag12(spark, sf_dir):
    return metrics.study_tokens(table(spark, sf_dir, "conversations").select(F.col("role").alias("phase"), F.char_length("text").alias("input_tokens"), F.col("turn").alias("output_tokens")))


# statistics

PAIRS = "a AS (SELECT budget, qid, avg(score) AS x FROM g WHERE run = 'a' GROUP BY 1, 2), b AS (SELECT budget, qid, avg(score) AS y FROM g WHERE run = 'b' GROUP BY 1, 2), d AS (SELECT budget, qid, y - x AS delta FROM a JOIN b USING (budget, qid))"
SUMS = "s AS (SELECT run, budget, qid, sum(score) AS s, sum(tokens) AS t, count(*) AS n FROM g GROUP BY 1, 2, 3)"


def pairs(spark, sf_dir):
    """The arms' common questions: the given events don't have the same ones in both, which the operator would reject."""
    g = grades(spark, sf_dir)
    return stats.paired_questions(*stats.shared_population(arm(g, "a"), arm(g, "b")))


def _area_of(points_sql: str, key: str) -> str:
    return (
        f"wp AS (SELECT *, max(score) OVER (PARTITION BY {key}, run ORDER BY tokens, score ROWS UNBOUNDED PRECEDING) AS best, least(3000 / tokens, 1) AS weight FROM ({points_sql})), "
        f"sp AS (SELECT *, weight - lead(weight, 1, 0) OVER (PARTITION BY {key}, run ORDER BY tokens, score) AS share FROM wp), "
        f"e AS (SELECT {key}, run, sum(share * best) AS expertise FROM sp GROUP BY 1, 2), "
        f"dd AS (SELECT {key}, max(CASE WHEN run = 'b' THEN expertise END) - max(CASE WHEN run = 'a' THEN expertise END) AS delta FROM e GROUP BY 1)"
    )


@query(
    "st1_paired_deltas",
    f"WITH {G}, {PAIRS} SELECT budget, CAST(count(*) AS BIGINT) AS questions, round(avg(delta), 6) AS mean_delta, CAST(count(*) FILTER (delta > 0) AS BIGINT) AS wins, CAST(count(*) FILTER (delta < 0) AS BIGINT) AS losses, CAST(count(*) FILTER (delta = 0) AS BIGINT) AS ties FROM d GROUP BY budget",
)
def st1(spark, sf_dir):
    return stats.paired_deltas(pairs(spark, sf_dir)).withColumn("mean_delta", F.round("mean_delta", 6))


REPS = 100


@query(
    "st2_bootstrap_expertise",
    f"WITH {G}, {SUMS}, q AS (SELECT qid, row_number() OVER (ORDER BY qid) - 1 AS place FROM (SELECT DISTINCT qid FROM s)), nq AS (SELECT count(*) AS c FROM q), "
    f"t AS (SELECT rep, ('0x' || substr(md5('20240501|' || rep || '|' || i), 1, 8))::BIGINT % c AS place, count(*) AS times FROM nq, range(0, {REPS}) r(rep), range(0, c) j(i) GROUP BY 1, 2), "
    + _area_of("SELECT rep, run, budget, sum(s * times) / sum(n * times) AS score, sum(s.t * times) / sum(n * times) AS tokens FROM t JOIN q USING (place) JOIN s USING (qid) GROUP BY 1, 2, 3", "rep")
    + f", o AS (SELECT delta, row_number() OVER (ORDER BY delta) - 1 AS place FROM dd) SELECT round(max(delta) FILTER (place = {max(round(0.025 * REPS) - 1, 0)}), 6) AS low, round(max(delta) FILTER (place = {max(round(0.975 * REPS) - 1, 0)}), 6) AS high, round(avg(CAST(delta > 0 AS DOUBLE)), 6) AS positive FROM o",
)
def st2(spark, sf_dir):
    sums = stats.question_sums(grades(spark, sf_dir))
    deltas = stats.bootstrap_deltas(sums, stats.number_questions(sums), "a", "b", REPS, 20240501)
    return stats.bootstrap_interval(deltas, REPS).select(*(F.round(c, 6).alias(c) for c in ("low", "high", "positive")))


@query(
    "st3_leave_one_out",
    f"WITH {G}, {SUMS}, t AS (SELECT run, budget, sum(s) AS s, sum(t) AS t, sum(n) AS n FROM s GROUP BY 1, 2), "
    + _area_of("SELECT q.qid, t.run, t.budget, (t.s - coalesce(s.s, 0)) / (t.n - coalesce(s.n, 0)) AS score, (t.t - coalesce(s.t, 0)) / (t.n - coalesce(s.n, 0)) AS tokens FROM (SELECT DISTINCT qid FROM s) q CROSS JOIN t LEFT JOIN s ON s.qid = q.qid AND s.run = t.run AND s.budget = t.budget", "qid")
    + " SELECT qid, round(delta, 6) AS delta FROM dd",
)
def st3(spark, sf_dir):
    return stats.leave_one_out(stats.question_sums(grades(spark, sf_dir)), "a", "b").withColumn("delta", F.round("delta", 6))


@query(
    "st4_sign_test",
    f"WITH {G}, {PAIRS}, w AS (SELECT budget, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta < 0) AS losses FROM d GROUP BY budget) "
    "SELECT budget, round(least(1, 2 * list_sum(list_transform(range(0, least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1) - (wins + losses) * ln(2))))), 6) AS p_value FROM w",
)
def st4(spark, sf_dir):
    d = stats.paired_deltas(pairs(spark, sf_dir))
    return d.select("budget", F.round(stats.sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


@query(
    "st5_permutation_test",
    f"WITH {G}, {PAIRS}, o AS (SELECT avg(delta) AS observed FROM d), f AS (SELECT rep, avg(CASE WHEN ('0x' || substr(md5('7|' || rep || '|' || budget || '|' || qid), 1, 8))::BIGINT % 2 = 0 THEN delta ELSE -delta END) AS m FROM d, range(0, 200) r(rep) GROUP BY rep) "
    "SELECT round(any_value(observed), 6) AS mean_delta, round((count(*) FILTER (abs(m) >= abs(observed) - 1e-12) + 1) / (count(*) + 1), 6) AS p_value FROM f, o",
)
def st5(spark, sf_dir):
    return stats.permutation_test(pairs(spark, sf_dir), 200, 7).select(F.round("mean_delta", 6).alias("mean_delta"), F.round("p_value", 6).alias("p_value"))


@query(
    "st6_gain_concentration",
    f"WITH {G}, {PAIRS}, q AS (SELECT qid, sum(delta) AS delta FROM d GROUP BY qid), k AS (SELECT sum(delta) AS top_k FROM (SELECT delta FROM q ORDER BY delta DESC, qid LIMIT 10)) SELECT round(sum(delta), 6) AS total, round(any_value(top_k), 6) AS top_k, round(any_value(top_k) / sum(delta), 6) AS share FROM q, k",
)
def st6(spark, sf_dir):
    per = pairs(spark, sf_dir).groupBy("qid").agg(F.sum("delta").alias("delta"))
    return stats.gain_concentration(per, 10).select(*(F.round(c, 6).alias(c) for c in ("total", "top_k", "share")))


@query(
    "st7_budget_transitions",
    f"WITH {G}, m AS (SELECT run, qid, budget, avg(score) AS score, list_position({BUDGETS}, budget) AS place FROM g GROUP BY 1, 2, 3), l AS (SELECT budget AS to_budget, lag(budget) OVER w AS from_budget, score - lag(score) OVER w AS d FROM m WINDOW w AS (PARTITION BY run, qid ORDER BY place)) "
    "SELECT from_budget, to_budget, CAST(count(*) FILTER (d > 0) AS BIGINT) AS up, CAST(count(*) FILTER (d < 0) AS BIGINT) AS down, CAST(count(*) FILTER (d = 0) AS BIGINT) AS tied FROM l WHERE from_budget IS NOT NULL GROUP BY 1, 2",
)
def st7(spark, sf_dir):
    return stats.budget_transitions(metrics.question_means(grades(spark, sf_dir)), BUDGETS)


@query(
    "st7_largest_gainers",
    f"WITH {G}, m AS (SELECT run, qid, avg(score) FILTER (budget = 'click') AS low, avg(score) FILTER (budget = 'view') AS high FROM g GROUP BY 1, 2), k AS (SELECT *, high - low AS gain, row_number() OVER (PARTITION BY run ORDER BY high - low DESC, qid) AS rank FROM m WHERE high - low IS NOT NULL) "
    "SELECT run, CAST(rank AS INTEGER) AS rank, qid, round(low, 6) AS low, round(high, 6) AS high, round(gain, 6) AS gain FROM k WHERE rank <= 5",
)
def st7_gainers(spark, sf_dir):
    out = stats.largest_gainers(metrics.question_means(grades(spark, sf_dir)), "click", "view")
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high", "gain")})


@query("st8_with_corrections", f"WITH {R} SELECT qid, CAST(sum(weight * CASE WHEN claim_id = 'c2' THEN 1 ELSE score END) AS BIGINT) AS lenient FROM r GROUP BY qid")
def st8(spark, sf_dir):
    c = claims(spark, sf_dir)
    fixes = c.where("claim_id = 'c2'").select("qid", "claim_id", F.lit(1).alias("score"))
    fixed = stats.with_corrections(c.select("qid", "claim_id", "score"), fixes, ["qid", "claim_id"])
    return grading.lenient_score(fixed, c, ["qid"], "qid")


@query("st9_behaviour_corr", f"WITH {G} SELECT run, round(corr(tokens, score), 6) AS corr_tokens, round(corr(rollout, score), 6) AS corr_rollout FROM g GROUP BY run")
def st9(spark, sf_dir):
    out = stats.behaviour_corr(grades(spark, sf_dir), "run", ["tokens", "rollout"])
    return out.select("run", F.round("corr_tokens", 6).alias("corr_tokens"), F.round("corr_rollout", 6).alias("corr_rollout"))

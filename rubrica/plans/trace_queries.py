"""Trajectories, quiz rounds, sources and streams, on ``conversations`` as agent sessions and ``events`` as a log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quiz, traces
from ..sources import episodes, files
from ..streaming import appends, jobs
from .proxies import G, graded, grades
from .registry import ORACLES, dealt, query, scratch, table

#: Commands made from conversations: some leave the corpus.
COMMAND_SQL = (
    "CASE turn % 5 WHEN 0 THEN 'cat /corpus/src/' || role || '.py' WHEN 1 THEN 'grep -n x ../other/f.py' WHEN 2 THEN 'sed -n 1,5p /home/me/' || role || '.py' WHEN 3 THEN 'ls ~/notes /usr/bin/x' ELSE 'find . -name a.py' END"
)


def conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def commands(spark, sf_dir):
    return conversations(spark, sf_dir).withColumn("command", F.expr(COMMAND_SQL))


def agent_events(spark, sf_dir):
    item = F.struct(F.when(F.col("role") == "assistant", "command_execution").otherwise("agent_message").alias("type"), F.col("text").alias("command"))
    usage = F.struct(F.char_length("text").cast("bigint").alias("output_tokens"), F.when(F.col("turn") > 2, F.col("turn")).alias("reasoning_output_tokens"))
    kind = F.when(F.col("turn") % 2 == 0, "turn.completed").otherwise("item.completed")
    return conversations(spark, sf_dir).select(F.col("conv_id").alias("session"), kind.alias("type"), item.alias("item"), usage.alias("usage"))


TR1 = (
    "SELECT conv_id AS session, CAST(count(*) FILTER (turn % 2 = 1 AND role = 'assistant') AS BIGINT) AS commands, CAST(coalesce(sum(length(text)) FILTER (turn % 2 = 0), 0) AS BIGINT) AS output_tokens, "
    "CAST(coalesce(sum(turn) FILTER (turn % 2 = 0 AND turn > 2), 0) AS BIGINT) AS reasoning_tokens FROM conversations GROUP BY conv_id"
)


@query("tr1_session_stats", TR1)
def tr1(spark, sf_dir):
    return traces.session_stats(agent_events(spark, sf_dir))


@query("tr2_budget_compliance", f"SELECT session, CASE session % 3 WHEN 0 THEN commands = 0 WHEN 1 THEN commands <= 3 ELSE commands = 3 END AS compliant FROM ({TR1})")
def tr2(spark, sf_dir):
    s = traces.session_stats(agent_events(spark, sf_dir))
    budget = F.when(F.col("session") % 3 == 0, "direct").when(F.col("session") % 3 == 1, "voluntary").otherwise("forced")
    return s.select("session", traces.budget_compliance(budget, F.col("commands"), F.lit(3)).alias("compliant"))


@query(
    "tr3_escape_violations",
    "SELECT conv_id, turn, CASE turn % 5 WHEN 1 THEN '~ or ../ escape' WHEN 2 THEN '/home/me/' || role || '.py' ELSE '~ or ../ escape' END AS escapes FROM conversations WHERE turn % 5 IN (1, 2, 3)",
)
def tr3(spark, sf_dir):
    return traces.escape_violations(commands(spark, sf_dir), "command", "/corpus").select("conv_id", "turn", F.array_join("escapes", ",").alias("escapes"))


@query(
    "tr4_turns",
    "WITH c AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'assistant') AS f FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, CAST(turns AS BIGINT) AS turns, CAST(f AS BIGINT) AS finish_catches, CAST(turns - f AS BIGINT) AS tool_calls, CASE WHEN conv_id % 2 = 0 AND turns <> 6 THEN 'forced_short' ELSE 'ok' END AS status FROM c",
)
def tr4(spark, sf_dir):
    one = F.struct("turn", F.struct(F.when(F.col("role") == "assistant", "finish").otherwise(F.col("role")).alias("tool")).alias("t"))
    episodes = conversations(spark, sf_dir).groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x.t).alias("turns"))
    counts = traces.turn_counts(traces.explode_turns(episodes, "turns", ["conv_id"]), ["conv_id"])
    budget = F.when(F.col("conv_id") % 2 == 0, "forced").otherwise("voluntary")
    return counts.withColumn("status", traces.forced_status(F.lit("ok"), budget, F.col("turns"), F.lit(6)))


@query(
    "tr5_render_trajectory",
    r"SELECT conv_id, md5(string_agg('[' || turn || '] ' || role || ' | ' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, CASE WHEN turn = 1 THEN 400 ELSE 100 END), chr(10) ORDER BY turn)) AS trajectory_md5 FROM conversations GROUP BY conv_id",
)
def tr5(spark, sf_dir):
    t = conversations(spark, sf_dir).withColumn("touched", F.col("turn") == 1)
    return traces.render_trajectory(t, ["conv_id"], "turn", ["role", "text"], 100, 400, "touched").select("conv_id", F.md5("trajectory").alias("trajectory_md5"))


@query(
    "tr6_command_mix",
    f"SELECT kind, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT CASE WHEN regexp_matches(c, '^(cat|sed|head|tail)') THEN 'read' WHEN regexp_matches(c, '^(grep|rg)') THEN 'grep' WHEN regexp_matches(c, '^(find|ls)') THEN 'locate' ELSE 'other' END AS kind FROM (SELECT {COMMAND_SQL} AS c FROM conversations)) GROUP BY kind",
)
def tr6(spark, sf_dir):
    kinds = {"read": "^(cat|sed|head|tail)", "grep": "^(grep|rg)", "locate": "^(find|ls)"}
    return traces.command_mix(commands(spark, sf_dir), "command", kinds).withColumn("share", F.round("share", 6))


@query(
    "tr7_file_touches",
    f"WITH t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all({COMMAND_SQL}, '[A-Za-z_./]+\\.py')) AS file FROM conversations), c AS (SELECT file, count(*) AS sessions FROM t GROUP BY file) "
    "SELECT file, CAST(sessions AS BIGINT) AS sessions, CAST(row_number() OVER (ORDER BY sessions DESC, file) AS INTEGER) AS rank, round(sessions / (SELECT sum(sessions) FROM c), 6) AS share FROM c ORDER BY sessions DESC, file LIMIT 5",
)
def tr7(spark, sf_dir):
    return traces.file_touches(commands(spark, sf_dir), "command", "conv_id", r"[A-Za-z_./]+\.py", 5).withColumn("share", F.round("share", 6))


@query(
    "tr7_touch_overlap",
    f"WITH t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all({COMMAND_SQL}, '[A-Za-z_./]+\\.py')) AS file FROM conversations), c AS (SELECT conv_id % 2 AS side, file, count(*) AS sessions FROM t GROUP BY 1, 2), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY sessions DESC, file) AS rank FROM c), x AS (SELECT file FROM k WHERE side = 0 AND rank <= 4), y AS (SELECT file FROM k WHERE side = 1 AND rank <= 3) "
    "SELECT CAST(count(*) AS BIGINT) AS shared, round(count(*) / (SELECT count(*) FROM x), 6) AS share_a, round(count(*) / (SELECT count(*) FROM y), 6) AS share_b FROM x JOIN y USING (file)",
)
def tr7_overlap(spark, sf_dir):
    c = commands(spark, sf_dir)
    top = lambda side, k: traces.file_touches(c.where(F.col("conv_id") % 2 == side), "command", "conv_id", r"[A-Za-z_./]+\.py", k)
    out = traces.touch_overlap(top(0, 4), top(1, 3))
    return out.select("shared", F.round("share_a", 6).alias("share_a"), F.round("share_b", 6).alias("share_b"))


@query(
    "tr8_touched_turns",
    f"WITH c AS (SELECT conv_id, turn, {COMMAND_SQL} AS command FROM conversations), p AS (SELECT DISTINCT conv_id, 'c' || turn AS claim_id, [role || '.py', 'a.py'] AS paths FROM conversations) "
    "SELECT conv_id, claim_id, array_to_string(list_sort(list(DISTINCT c.turn)), ',') AS touched FROM p JOIN c USING (conv_id) WHERE contains(command, paths[1]) OR contains(command, paths[2]) GROUP BY 1, 2",
)
def tr8(spark, sf_dir):
    claims = conversations(spark, sf_dir).select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("claim_id"), F.array(F.concat("role", F.lit(".py")), F.lit("a.py")).alias("paths"))
    return traces.touched_turns(claims, commands(spark, sf_dir), "conv_id", "paths", "command").withColumn("touched", F.array_join("touched", ","))


@query("tr9_reported_vs_executed", f"SELECT session, CAST(session % 4 AS INTEGER) AS reported, commands AS executed, session % 4 = commands AS agree FROM ({TR1})")
def tr9(spark, sf_dir):
    executed = traces.session_stats(agent_events(spark, sf_dir))
    reports = executed.select("session", F.slice(F.array(*(F.lit(i) for i in range(4))), F.lit(1), (F.col("session") % 4).cast("int")).alias("tool_log"))
    return traces.reported_vs_executed(reports, executed, "session", "tool_log")


# quiz rounds made from events: a round a day of the month


QUIZ = "q AS (SELECT event_id AS qid, day(ts) % 6 AS round, 'm' || user_id % 7 AS mechanism, CASE event_type WHEN 'click' THEN 'correct' WHEN 'view' THEN 'partial' ELSE 'incorrect' END AS verdict FROM events)"


def quizzes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    verdict = F.when(F.col("event_type") == "click", "correct").when(F.col("event_type") == "view", "partial").otherwise("incorrect")
    mistakes = F.when(verdict == "correct", F.array().cast("array<struct<mistake:string,mistake_class:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("said "), "event_type").alias("mistake"), F.col("event_type").alias("mistake_class"))))
    return e.select(F.col("event_id").alias("qid"), (F.dayofmonth("ts") % 6).cast("bigint").alias("round"), F.concat(F.lit("m"), (F.col("user_id") % 7).cast("string")).alias("mechanism"), verdict.alias("verdict"), mistakes.alias("studier_mistakes"))


@query("sq1_verdict_counts", f"WITH {QUIZ} SELECT round, " + ", ".join(f"CAST(count(*) FILTER (verdict = '{v}') AS BIGINT) AS {v}" for v in quiz.VERDICTS) + " FROM q GROUP BY round")
def sq1(spark, sf_dir):
    return quiz.verdict_counts(quizzes(spark, sf_dir))


@query("sq1_mistake_counts", "SELECT day(ts) % 6 AS round, event_type AS mistake_class, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type <> 'click' GROUP BY 1, 2")
def sq1_mistakes(spark, sf_dir):
    return quiz.mistake_counts(quizzes(spark, sf_dir))


@query(
    "sq2_curriculum",
    f"WITH {QUIZ}, r AS (SELECT round, avg(CAST(verdict = 'correct' AS DOUBLE)) AS rate FROM q GROUP BY round), f AS (SELECT round, mechanism, min(qid) AS first FROM q WHERE verdict <> 'correct' GROUP BY 1, 2), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY first, mechanism) AS n FROM f) SELECT round, CASE WHEN rate < 1/3 THEN 'easy' WHEN rate < 2/3 THEN 'medium' ELSE 'hard' END AS difficulty, (SELECT string_agg(mechanism, ',' ORDER BY n) FROM k WHERE k.round = r.round AND n <= 2) AS focus FROM r",
)
def sq2(spark, sf_dir):
    return quiz.curriculum(quizzes(spark, sf_dir)).withColumn("focus", F.array_join("focus", ","))


@query("sq3_feedback", f"WITH {QUIZ} SELECT q.round, qid, mechanism || ' | ' || verdict || ' | ' || CASE WHEN verdict = 'correct' THEN 'clean' ELSE 'said ' || event_type END AS line FROM q JOIN events ON event_id = qid")
def sq3(spark, sf_dir):
    return quiz.feedback(quizzes(spark, sf_dir))


@query(
    "sq4_trajectory",
    f"WITH {G}, w AS (SELECT qid % 6 AS round, avg(score) FILTER (budget = 'click') AS click, avg(score) FILTER (budget = 'view') AS view FROM g GROUP BY 1), m AS (SELECT *, (coalesce(click, 0) + coalesce(view, 0)) / 2 AS mean FROM w) "
    "SELECT round, round(click, 6) AS click, round(view, 6) AS view, round(mean, 6) AS mean, row_number() OVER (ORDER BY mean DESC, round) = 1 AS is_best FROM m",
)
def sq4(spark, sf_dir):
    out = quiz.trajectory(grades(spark, sf_dir).withColumn("round", F.col("qid") % 6), ["click", "view"])
    return out.select("round", *(F.round(c, 6).alias(c) for c in ("click", "view", "mean")), "is_best")


@query("sq5_accept_round", f"WITH {QUIZ} SELECT round, CAST(count(*) FILTER (qid % 5 <> 0 AND verdict = 'correct') AS BIGINT) AS accepted, count(*) FILTER (qid % 5 <> 0 AND verdict = 'correct') >= 250 AS ok FROM q GROUP BY round")
def sq5(spark, sf_dir):
    q = quizzes(spark, sf_dir)
    return quiz.accept_round(q.select("round", "qid", (F.col("verdict") == "correct").alias("passed")), q.where("qid % 5 = 0").select("qid"), 250)


def edits(df):
    """Edit operations: a section for each turn, of which some are replaced, extended or deleted by later turns."""
    op = F.when(F.col("turn") < 3, "add_section").when(F.col("turn") == 3, "append_to_section").when(F.col("turn") == 4, "delete_section").when(F.col("turn") == 5, "replace_section").otherwise("append_to_section")
    ident = F.when(F.col("turn") == 3, "s1").when(F.col("turn") == 4, "s2").when(F.col("turn") == 5, "s2").otherwise("s3")
    return df.select(F.col("conv_id").alias("notebook"), F.col("turn").alias("seq"), op.alias("op"), ident.alias("section_id"), F.col("role").alias("title"), F.regexp_replace("text", "\n", " ").alias("content"))


EDITED = (
    r"WITH t AS (SELECT conv_id, turn, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS c, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations), "
    "n AS (SELECT conv_id AS notebook, any_value(last) AS last, max(CASE WHEN turn = 0 THEN c END) AS c0, max(CASE WHEN turn = 1 THEN c END) AS c1, max(CASE WHEN turn = 2 THEN c END) AS c2, max(CASE WHEN turn = 3 THEN c END) AS c3, "
    "max(CASE WHEN turn = 6 THEN c END) AS c6, max(CASE WHEN turn = 7 THEN c END) AS c7 FROM t GROUP BY conv_id) "
    "SELECT notebook, md5(array_to_string([c0 || coalesce(chr(10) || c3, ''), CASE WHEN last < 4 THEN c1 END, c2 || coalesce(chr(10) || c6, '') || coalesce(chr(10) || c7, '')], '|')) AS contents_md5, "
    "CAST(least(last, 2) + 2 AS INTEGER) AS next_id, CAST(last >= 5 AS INTEGER) AS skipped FROM n"
)


@query("sq6_notebook_ops", EDITED)
def sq6(spark, sf_dir):
    books = conversations(spark, sf_dir).select(F.col("conv_id").alias("notebook")).distinct().select("notebook", F.array().cast(jobs.SECTIONS).alias("sections"), F.lit(1).alias("next_id"))
    out = quiz.apply_notebook_ops(books, edits(conversations(spark, sf_dir)))
    return out.select("notebook", F.md5(F.array_join("sections.content", "|")).alias("contents_md5"), "next_id", F.size("skipped").alias("skipped"))


@query(
    "sq7_cap_sections",
    "WITH s AS (SELECT *, sum(length(role) + length(text) + 4) OVER (PARTITION BY conv_id ORDER BY length(role) + length(text) + 4, turn ROWS UNBOUNDED PRECEDING) AS c FROM conversations) SELECT conv_id, turn FROM s WHERE c <= 1500",
)
def sq7(spark, sf_dir):
    s = conversations(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("title"), F.col("text").alias("content"))
    return quiz.cap_sections(s, "conv_id", "turn", 1500, 4).select("conv_id", "turn")


# sources


def snapshots(spark, sf_dir) -> str:
    """Writes a snapshot file for each source of ``documents`` and returns the folder."""
    d = table(spark, sf_dir, "documents")
    one = F.struct(
        F.col("doc_id").alias("number"), F.concat(F.lit("How "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("body"), F.when(F.col("doc_id") % 4 == 0, "OPEN").otherwise("CLOSED").alias("state"),
        F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
    )
    path = scratch(spark)
    doc = d.groupBy("source").agg(F.to_json(F.struct(F.first("source").alias("repository"), F.collect_list(one).alias("sessions"))).alias("value")).select("value")
    doc.write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("io1_read_sessions", "SELECT doc_id AS number, 'How ' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN 'OPEN' ELSE 'CLOSED' END AS state, md5(text) AS body_md5, CAST(1700000000 + doc_id AS BIGINT) AS created FROM documents")
def io1(spark, sf_dir):
    s = files.read_sessions(spark, snapshots(spark, sf_dir))
    return s.select("number", "title", "state", F.md5("body").alias("body_md5"), F.unix_timestamp("created_at").alias("created"))


@query("io2_session_profile", "SELECT CAST(count(*) AS BIGINT) AS session_count, CAST(count(*) FILTER (doc_id % 4 = 0) AS BIGINT) AS open, CAST(count(*) FILTER (doc_id % 4 <> 0) AS BIGINT) AS closed FROM documents")
def io2(spark, sf_dir):
    p = files.session_profile(files.read_sessions(spark, snapshots(spark, sf_dir)))
    return p.select("session_count", F.try_element_at("states", F.lit("OPEN")).alias("open"), F.try_element_at("states", F.lit("CLOSED")).alias("closed"))


@query("io3_io7_bundles", "SELECT l_orderkey AS id, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS claims, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1")
def io3(spark, sf_dir):
    from .proxies import claims

    path = scratch(spark)
    rubric = F.collect_list(F.struct("claim_id", "claim_type", F.col("weight").cast("int").alias("weight"), F.lit("says").alias("statement"), F.array(F.lit("s1")).alias("span_ids")))
    bundles = claims(spark, sf_dir).groupBy(F.col("qid").cast("string").alias("id")).agg(F.lit("t").alias("topic"), F.lit("q").alias("question"), F.lit("a").alias("gold_answer"), rubric.alias("rubric"), F.array().cast("array<struct<span_id:string>>").alias("evidence"), F.lit("x").alias("difficulty"))
    files.write_bundles(bundles, path)
    read = files.read_bundles(spark, f"{path}/bundles")
    return read.select(F.col("id").cast("bigint").alias("id"), F.size("rubric").cast("bigint").alias("claims"), F.aggregate("rubric", F.lit(0), lambda s, c: s + c.weight).cast("bigint").alias("weight"))


@query("io4_episode_tree", "SELECT source AS budget, CAST(doc_id % 3 AS INTEGER) AS rollout, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS gen_tokens FROM documents GROUP BY 1, 2")
def io4(spark, sf_dir):
    path = scratch(spark)
    d = table(spark, sf_dir, "documents")
    episodes.write_episode_tree(d.select(F.col("source").alias("budget"), (F.col("doc_id") % 3).alias("rollout"), F.col("doc_id").alias("qid"), "n_chars"), path)
    tree = files.read_episode_tree(spark, path, "n_chars bigint")
    return tree.groupBy("budget", "rollout").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("gen_tokens"))


@query("io4_compact_tree", ORACLES["io4_episode_tree"])
def io4_compact(spark, sf_dir):
    path = scratch(spark)
    d = table(spark, sf_dir, "documents")
    episodes.write_episode_tree(d.select(F.col("source").alias("budget"), (F.col("doc_id") % 3).alias("rollout"), F.col("doc_id").alias("qid"), "n_chars"), path)
    tree = episodes.compact_episode_tree(spark, path, "n_chars bigint", scratch(spark))
    return tree.groupBy("budget", "rollout").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("gen_tokens"))


@query("io5_read_events", "SELECT CAST(count(*) AS BIGINT) AS events, CAST(sum(length(text)) AS BIGINT) AS tokens FROM conversations WHERE turn <> 1")
def io5(spark, sf_dir):
    path = scratch(spark)
    good = F.to_json(F.struct(F.lit("turn.completed").alias("type"), F.struct(F.char_length("text").alias("output_tokens")).alias("usage")))
    conversations(spark, sf_dir).select(F.when(F.col("turn") == 1, F.lit('{"type": "cut')).otherwise(good).alias("value")).write.text(path)
    return files.read_events(spark, path).agg(F.count(F.lit(1)).alias("events"), F.sum("usage.output_tokens").alias("tokens"))


@query("io6_read_corpus", "SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents WHERE source <> 'src1'")
def io6(spark, sf_dir):
    path = scratch(spark)
    folder = F.coalesce(F.concat(F.lit("source="), "source"), F.lit("none"))
    d = dealt(table(spark, sf_dir, "documents").select("source", "text"))
    episodes.write_tree(d.select(folder.alias("folder"), F.concat(F.monotonically_increasing_id(), F.lit(".txt")).alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("body")), path)
    roots = [f"source=src{i}" for i in range(20) if i != 1]
    return files.read_corpus(spark, path, roots).agg(F.count(F.lit(1)).alias("files"), F.sum(F.char_length("text")).alias("chars"))


@query("io8_embeddings", "SELECT vec_id, 'm1' AS model, CAST(len(embedding) AS INTEGER) AS size FROM embeddings")
def io8(spark, sf_dir):
    path, e = scratch(spark), table(spark, sf_dir, "embeddings")
    files.write_embeddings(e.select("vec_id", "embedding"), path, "m1")
    return files.read_embeddings(spark, path, e, "vec_id").select("vec_id", "model", F.size("embedding").alias("size"))


@query("io9_pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def io9(spark, sf_dir):
    return files.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"], F.col("quality") == 1)


@query("io10_append_log", "SELECT CAST(day(ts) AS INTEGER) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def io10(spark, sf_dir):
    path, e = scratch(spark), table(spark, sf_dir, "events")
    files.append_log(e.where("event_id % 2 = 0"), path, F.col("ts"))
    files.append_log(e.where("event_id % 2 = 1"), path, F.col("ts"))
    return spark.read.schema("event_id bigint, date date").json(path).groupBy(F.dayofmonth("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# streams


def event_stream(spark, sf_dir):
    return jobs.read_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("ss1_running_usage", "SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS commands, CAST(coalesce(sum(event_id), 0) AS BIGINT) AS tokens, count(*) FILTER (event_type = 'click') > 12 AS over_budget FROM events GROUP BY user_id")
def ss1(spark, sf_dir):
    usage = jobs.running_usage(event_stream(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "click", 12, "ts", "3650 days").drop("closed")  # the SQL knows no end of a session
    return jobs.run_available(usage, scratch(spark), "update", ["user_id"])


@query("ss2_dedup_questions", r"SELECT DISTINCT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_key FROM documents")
def ss2(spark, sf_dir):
    d = jobs.read_stream(spark, f"{sf_dir}/documents.parquet").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")))
    return jobs.run_available(jobs.dedup_questions(d, "text", "at", "3650 days").select("text_key"), scratch(spark), "append")


@query("ss3_activity_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def ss3(spark, sf_dir):
    w = jobs.activity_windows(event_stream(spark, sf_dir), "ts", "event_type", "1 day", None, "40 days")
    out = jobs.run_available(w, scratch(spark), "update", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query(
    "ss3_sliding_windows",
    "SELECT CAST(epoch(b - k * INTERVAL 12 HOUR) AS BIGINT) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT time_bucket(INTERVAL 12 HOUR, ts) AS b, event_type FROM events), (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2",
)
def ss3_sliding(spark, sf_dir):
    w = jobs.activity_windows(event_stream(spark, sf_dir), "ts", "event_type", "1 day", "12 hours", "40 days")
    out = jobs.run_available(w, scratch(spark), "update", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query(
    "ss3_activity_sessions",
    "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), "
    "g AS (SELECT user_id, k, min(ts) AS a, max(ts) AS b, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, CAST(floor(epoch(a)) AS BIGINT) AS start, CAST(n AS BIGINT) AS n FROM g WHERE b + INTERVAL 6 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
)
def ss3_sessions(spark, sf_dir):
    s = jobs.activity_sessions(event_stream(spark, sf_dir), "ts", "user_id", "6 hours", "1 hour")
    return jobs.run_available(s, scratch(spark), "append").select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("ss4_notebook_state", EDITED)
def ss4(spark, sf_dir):
    made = edits(jobs.read_stream(spark, f"{sf_dir}/conversations.parquet")).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq")))
    state = jobs.notebook_state(made, "at", "3650 days")
    out = jobs.run_available(state, scratch(spark), "update", ["notebook"])
    return out.select("notebook", F.md5(F.array_join("sections.content", "|")).alias("contents_md5"), "next_id", "skipped")


@query("ss5_append_unseen", f"WITH {G} SELECT DISTINCT run, budget, rollout, qid FROM g")
def ss5(spark, sf_dir):
    path, keys = scratch(spark), ["run", "budget", "rollout", "qid"]
    g = graded(event_stream(spark, sf_dir)).select(*keys)
    for turn in range(2):  # the second stream brings all rows again and adds none
        g.writeStream.foreachBatch(appends.append_unseen(f"{path}/rows", keys, f"turn{turn}")).option("checkpointLocation", f"{path}/state{turn}").trigger(availableNow=True).start().awaitTermination()
    return appends.read_appended(spark, f"{path}/rows").select(*keys)

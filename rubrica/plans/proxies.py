"""Views of the given tables in the library's schemas, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import table

BUDGETS = ["click", "purchase", "signup", "view"]

#: run, budget, qid, rollout, score, tokens, status from events; errors are episodes without an answer, dealt over the budgets.
G = (
    f"g AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS run, CASE WHEN event_type = 'error' THEN ({BUDGETS})[1 + event_id // 2 % 4] ELSE event_type END AS budget, user_id AS qid, event_id % 3 AS rollout, "
    "CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS score, 500 + CAST(floor(value * 100) AS BIGINT) AS tokens, CASE WHEN event_type = 'error' THEN 'no_answer' ELSE 'ok' END AS status FROM events)"
)
#: Rubric claims and their scores by two judges from lineitem.
R = (
    "r AS (SELECT l_orderkey AS qid, 'c' || l_linenumber AS claim_id, CAST(sum(l_quantity) AS BIGINT) AS weight, CASE WHEN bool_or(l_returnflag = 'A') THEN 'core' ELSE 'supporting' END AS claim_type, "
    "CAST(bool_or(l_linestatus = 'F') AS INTEGER) AS score, CAST(bool_or(l_returnflag = 'R') AS INTEGER) AS score2 FROM lineitem GROUP BY 1, 2)"
)
#: Points of each run, and the area under them.
AREA = (
    "p AS (SELECT run, budget, count(*) AS episodes, avg(score) AS score, avg(tokens) AS tokens FROM g GROUP BY 1, 2), "
    "wp AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY tokens, score ROWS UNBOUNDED PRECEDING) AS best, least(3000 / tokens, 1) AS weight FROM p), "
    "sp AS (SELECT *, weight - lead(weight, 1, 0) OVER (PARTITION BY run ORDER BY tokens, score) AS share FROM wp), "
    "e AS (SELECT run, sum(share * best) AS expertise FROM sp GROUP BY run)"
)


def graded(events):
    """Graded episodes of a table or stream of events."""
    error, i = F.col("event_type") == "error", F.col("event_id")
    budget = F.when(error, F.get(F.array(*map(F.lit, BUDGETS)), (F.floor(i / 2) % 4).cast("int"))).otherwise(F.col("event_type"))
    return events.select(
        "event_id", F.when(i % 2 == 0, "a").otherwise("b").alias("run"), budget.alias("budget"), F.col("user_id").alias("qid"), (i % 3).alias("rollout"),
        F.when(error, 0).otherwise(F.get_json_object("props", "$.k").cast("bigint")).alias("score"), (F.floor(F.col("value") * 100) + 500).alias("tokens"), F.when(error, "no_answer").otherwise("ok").alias("status"),
    )


def grades(spark, sf_dir):
    return graded(table(spark, sf_dir, "events"))


def claims(spark, sf_dir):
    """qid, claim_id, weight, claim_type, score, score2."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("claim_id")).agg(
        F.sum("l_quantity").cast("bigint").alias("weight"), F.when(F.bool_or(F.col("l_returnflag") == "A"), "core").otherwise("supporting").alias("claim_type"),
        F.bool_or(F.col("l_linestatus") == "F").cast("int").alias("score"), F.bool_or(F.col("l_returnflag") == "R").cast("int").alias("score2"),
    )


def arm(df, run):
    return df.where(F.col("run") == run)

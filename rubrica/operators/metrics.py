"""Cost-weighted quality: budget means, expertise (weighted area) and its variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ANCHOR = 3000


def budget_means(grades: DataFrame, by: tuple = ("run", "budget"), score: str = "score", tokens: str = "tokens") -> DataFrame:
    return grades.groupBy(*by).agg(F.count(F.lit(1)).alias("episodes"), F.avg(score).alias("score"), F.avg(tokens).alias("tokens"))


def question_means(grades: DataFrame, score: str = "score", tokens: str = "tokens") -> DataFrame:
    """Means over rollouts."""
    return budget_means(grades, ("run", "budget", "qid"), score, tokens)


def weighted_points(points: DataFrame, by: list[str], anchor: float = ANCHOR) -> DataFrame:
    """``points`` (by, tokens, score) with best (running maximum by tokens), weight and share = weight − next weight."""
    order = Window.partitionBy(*by).orderBy("tokens", "score")
    out = points.withColumn("best", F.max("score").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = out.withColumn("weight", F.least(F.lit(float(anchor)) / F.col("tokens"), F.lit(1.0)))
    return out.withColumn("share", F.col("weight") - F.lead("weight", 1, 0.0).over(order))


def expertise(points: DataFrame, by: list[str], anchor: float = ANCHOR, n: int | None = 4) -> DataFrame:
    """by, expertise: the area of best score so far under token weight. With ``n``, other numbers of points give null, as
    do tokens that aren't positive."""
    ok = F.every(F.col("tokens") > 0)
    if n:
        ok = ok & (F.count(F.lit(1)) == n)
    positive = points.withColumn("tokens", F.when(F.col("tokens") > 0, F.col("tokens").cast("double")))
    return weighted_points(positive, by, anchor).groupBy(*by).agg(F.when(F.coalesce(ok, F.lit(False)), F.sum(F.col("share") * F.col("best"))).alias("expertise"))


def expertise_weights(points: DataFrame, by: list[str], anchor: float = ANCHOR) -> DataFrame:
    """Each point's share of the area's weight, and ``unreached``: what no point covers."""
    out = weighted_points(points, by, anchor)
    return out.withColumn("unreached", 1 - F.sum("share").over(Window.partitionBy(*by)))


def expertise_scenarios(points: DataFrame, scenarios: DataFrame, by: list[str], base: str = "base", n: int | None = 4) -> DataFrame:
    """scenario, by, expertise, delta: ``scenarios`` (scenario, budget, score?, tokens?) replaces points; null keeps them."""
    names = scenarios.select("scenario").distinct().unionByName(scenarios.sparkSession.range(1).select(F.lit(base).alias("scenario"))).distinct()
    other = scenarios.select("scenario", "budget", F.col("score").alias("s2"), F.col("tokens").alias("t2"))
    grid = points.crossJoin(F.broadcast(names)).join(other, ["scenario", "budget"], "left")  # scenarios are named by hand: a few rows
    changed = grid.withColumns({"score": F.coalesce("s2", "score"), "tokens": F.coalesce("t2", "tokens")})
    area = expertise(changed, ["scenario", *by], n=n)
    first = F.max(F.when(F.col("scenario") == base, F.col("expertise"))).over(Window.partitionBy(*by))
    return area.withColumn("delta", F.col("expertise") - first)


def expertise_by_rollout(grades: DataFrame, n: int | None = 4) -> DataFrame:
    return expertise(budget_means(grades, ("run", "rollout", "budget")), ["run", "rollout"], n=n)


def comparison_table(means: DataFrame, budgets: list[str], targets: DataFrame | None = None, by: str = "run") -> DataFrame:
    wide = means.groupBy(by).pivot("budget", budgets).agg(F.first("score"))
    return wide if targets is None else wide.join(targets, by, "left")


def topic_budget_rollup(grades: DataFrame, topic: str = "topic") -> DataFrame:
    return grades.rollup(topic, "budget").agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("episodes"), F.avg("score").alias("score"))


def status_counts(df: DataFrame, statuses: list[str], by: str = "budget", status: str = "status") -> DataFrame:
    return df.groupBy(by).pivot(status, statuses).agg(F.count(F.lit(1))).na.fill(0)


def sandbox_stats(df: DataFrame) -> DataFrame:
    """Outcome counts from (program, syntax_ok, exit_code): missing, syntax, crashed or passed."""
    outcome = F.when(F.trim(F.coalesce("program", F.lit(""))) == "", "missing").when(~F.coalesce("syntax_ok", F.lit(False)), "syntax").when(F.col("exit_code").eqNullSafe(F.lit(0)), "passed").otherwise("crashed")
    return df.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def session_summary(df: DataFrame) -> DataFrame:
    """Per budget, from (budget, fences, compliant, commands, passed, violations, answer)."""
    return df.groupBy("budget").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("fences") == 1).alias("single_fence"), F.count_if("compliant").alias("compliant"), F.avg("commands").alias("mean_commands"),
        F.count_if("passed").alias("passed"), F.count_if(F.col("violations") > 0).alias("violation_cases"), F.avg(F.char_length("answer")).alias("mean_answer_chars"),
    )


def study_tokens(df: DataFrame) -> DataFrame:
    return df.groupBy("phase").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))

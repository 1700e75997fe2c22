"""Trajectories and agent event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Path prefixes that commands may use, and how absolute paths and escapes look in a command.
ALLOWED_PREFIXES = ["/bin", "/usr", "/dev", "/proc", "/etc", "/lib", "/sbin"]
ABSOLUTE_PATH = r"""(?:^|[\s'"=(:;])(/[A-Za-z0-9_.@/-]+)"""
ESCAPE = r"""(?<![\w.])\.\./|(?:^|[\s'"=(:;])~(?=[/\s'"]|$)"""


def session_stats(events: DataFrame, session: str = "session") -> DataFrame:
    """session, commands, output_tokens, reasoning_tokens from events (type, item, usage); absent counts are 0."""
    ran = (F.col("type") == "item.completed") & (F.col("item.type") == "command_execution")
    total = lambda c: F.coalesce(F.sum(F.when(F.col("type") == "turn.completed", F.col(c))), F.lit(0))
    return events.groupBy(session).agg(F.count_if(ran).alias("commands"), total("usage.output_tokens").alias("output_tokens"), total("usage.reasoning_output_tokens").alias("reasoning_tokens"))


def budget_compliance(budget: Column, commands: Column, target: Column) -> Column:
    """direct: no command; voluntary: at most the target; forced: exactly the target."""
    return F.when(budget == "direct", commands == 0).when(budget == "voluntary", commands <= target).when(budget == "forced", commands == target).otherwise(F.lit(False))


def escape_violations(df: DataFrame, command: str, root: str) -> DataFrame:
    """``df`` with ``escapes``: the first four offending tokens of a command in order; rows without any are left out."""
    paths = F.filter(F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(ABSOLUTE_PATH), F.lit(1)), lambda p: ~p.startswith(root) & ~F.exists(F.array(*map(F.lit, ALLOWED_PREFIXES)), lambda a: p.startswith(a)))
    escaped = F.when(F.col(command).rlike(ESCAPE), F.array(F.lit("~ or ../ escape"))).otherwise(F.array().cast("array<string>"))
    out = df.withColumn("escapes", F.slice(F.array_sort(F.array_distinct(F.concat(paths, escaped))), 1, 4))
    return out.where(F.size("escapes") > 0)


def explode_turns(episodes: DataFrame, turns: str, keys: list[str]) -> DataFrame:
    return episodes.select(*keys, F.posexplode(turns).alias("turn", "t")).select(*keys, "turn", "t.*")


def turn_counts(turns: DataFrame, keys: list[str], tool: str = "tool") -> DataFrame:
    """Per episode: turns, finish catches (calls of the tool ``finish``), other tool calls."""
    finish = F.coalesce(F.col(tool) == "finish", F.lit(False))
    return turns.groupBy(*keys).agg(F.count(F.lit(1)).alias("turns"), F.count_if(finish).alias("finish_catches"), F.count_if(~finish).alias("tool_calls"))


def forced_status(status: Column, budget: Column, turns: Column, most: Column) -> Column:
    """An episode's status, which becomes ``forced_short`` where a forced budget ended well with fewer turns than it demands."""
    return F.when((budget == "forced") & (status == "ok") & (turns != most), "forced_short").otherwise(status)


def render_trajectory(turns: DataFrame, keys: list[str], order: str, fields: list[str], cap: int = 300, long_cap: int = 1200, touched: str | None = None) -> DataFrame:
    """keys, trajectory: the turns' fields, white space collapsed and clipped; touched turns have the longer cap."""
    most = F.when(F.col(touched), long_cap).otherwise(cap) if touched else F.lit(cap)
    parts = [F.substr(F.trim(F.regexp_replace(F.coalesce(f, F.lit("")), r"\s+", " ")), F.lit(1), most) for f in fields]
    line = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), F.concat_ws(" | ", *parts))
    return turns.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x.l), "\n").alias("trajectory"))


def command_mix(df: DataFrame, command: str, kinds: dict[str, str]) -> DataFrame:
    """kind, n, share: commands by the first kind whose pattern they match, else ``other``."""
    kind = F.lit("other")
    for name, pattern in reversed(kinds.items()):
        kind = F.when(F.col(command).rlike(pattern), name).otherwise(kind)
    counts = df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a kind


def file_touches(df: DataFrame, text: str, session: str, pattern: str, k: int = 20) -> DataFrame:
    """file, sessions, rank, share: the ``k`` files that most sessions touch, with their share of all touches."""
    touched = df.select(session, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))).alias("file")).distinct()
    counts = touched.groupBy("file").agg(F.count(F.lit(1)).alias("sessions"))
    total = counts.agg(F.sum("sessions").alias("total"))
    top = counts.orderBy(F.desc("sessions"), "file").limit(k)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("sessions"), "file")))  # k rows
    return ranked.join(total, how="cross").select("file", "sessions", "rank", (F.col("sessions") / F.col("total")).alias("share"))


def touch_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """shared, share_a, share_b: how many files two rankings (``file_touches``) have in common, as a count and as shares of each."""
    sizes = lambda df, name: df.select("file").distinct().withColumn(name, F.lit(True))
    both = sizes(a, "in_a").join(sizes(b, "in_b"), "file", "full")
    shared = F.count_if(F.col("in_a") & F.col("in_b"))
    return both.agg(shared.alias("shared"), F.try_divide(shared, F.count("in_a")).alias("share_a"), F.try_divide(shared, F.count("in_b")).alias("share_b"))


def touched_turns(claims: DataFrame, turns: DataFrame, key: str, paths: str, text: str, claim: str = "claim_id", turn: str = "turn") -> DataFrame:
    """key, claim, touched: the turns whose text has one of the claim's paths; claims without any are left out."""
    wanted = claims.select(key, claim, F.explode(paths).alias("__path"))
    hit = wanted.join(turns.select(key, turn, F.col(text).alias("__text")), key).where(F.contains("__text", "__path"))
    return hit.groupBy(key, claim).agg(F.sort_array(F.collect_set(turn)).alias("touched"))


def reported_vs_executed(reports: DataFrame, executed: DataFrame, session: str, log: str) -> DataFrame:
    """session, reported, executed, agree: steps a session reports against commands it ran."""
    told = reports.select(session, F.coalesce(F.size(log), F.lit(0)).alias("reported"))
    both = told.join(executed.select(session, F.col("commands").alias("executed")), session, "full")
    both = both.select(session, F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("executed", F.lit(0)).alias("executed"))
    return both.withColumn("agree", F.col("reported") == F.col("executed"))

"""Filters and splits on tables of sessions and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines, stripped


def filter_epoch(df: DataFrame, cutoff: str, state: str = "state", created: str = "created_at", closed: str = "CLOSED") -> DataFrame:
    """Closed sessions created at or before ``cutoff``; times are compared as instants."""
    return df.where((F.upper(state) == closed) & (F.try_to_timestamp(F.col(created).cast("string")) <= F.lit(cutoff).cast("timestamp")))


def filter_funnel(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ``reason``: the first rule, in order, that a row fails; null for survivors. A null condition fails."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def funnel_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Per rule, in order: dropped, and survivors behind it. One row a rule, whatever the table's size."""
    marked = filter_funnel(df, rules)
    counts = marked.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("reason") == name).alias(name) for name in rules))
    rows = F.array(*(F.struct(F.lit(i).alias("stage"), F.lit(name).alias("reason"), F.col(name).alias("dropped"), (F.col("n") - sum((F.col(x) for x in list(rules)[: i + 1]), F.lit(0))).alias("survivors")) for i, name in enumerate(rules)))
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def parse_sections(df: DataFrame, text: str, key: str) -> DataFrame:
    """key, section_id (s1, s2, …), title, content for the ``## `` sections of a note; text before them is ``Overview``.

    A leading ``# `` title is skipped; a note without text has no sections.
    """
    parts = df.select(key, F.posexplode(lines(F.col(text))).alias("at", "line"))
    by_note = Window.partitionBy(key).orderBy("at")
    head = F.col("line").rlike(r"^##\s+\S")
    numbered = parts.withColumn("section", F.sum(head.cast("int")).over(by_note)).withColumn("is_head", head)
    # the first line may be the document's title
    title = (F.col("section") == 0) & F.col("line").startswith("# ") & (F.col("at") == 0)
    grouped = (
        numbered.where(~title)
        .groupBy(key, "section")
        .agg(F.sort_array(F.collect_list(F.struct("at", "is_head", "line"))).alias("rows"))
        .select(
            key, "section",
            F.coalesce(F.get(F.transform(F.filter("rows", lambda r: r.is_head), lambda r: stripped(F.regexp_replace(r.line, r"^##\s+", ""))), F.lit(0)), F.lit("Overview")).alias("title"),
            stripped(F.array_join(F.transform(F.filter("rows", lambda r: ~r.is_head), lambda r: r.line), "\n")).alias("content"),
        )
        .where((F.col("section") > 0) | (F.col("content") != ""))
    )
    place = F.row_number().over(Window.partitionBy(key).orderBy("section"))
    return grouped.select(key, F.concat(F.lit("s"), place.cast("string")).alias("section_id"), "title", "content")


def with_note(df: DataFrame, note: Column, question: str = "question") -> DataFrame:
    """``df`` with ``delivered`` (note, empty line, question) and its fingerprint."""
    out = df.withColumn("delivered", F.concat(note, F.lit("\n\n"), F.col(question)))
    return out.withColumn("delivered_sha256", F.sha2("delivered", 256))


def verify_delivery(df: DataFrame, note: Column, question: str = "question", stored: str = "delivered_sha256") -> DataFrame:
    """Rows whose stored fingerprint isn't that of note and question."""
    return df.where(~F.col(stored).eqNullSafe(F.sha2(F.concat(note, F.lit("\n\n"), F.col(question)), 256)))

"""Analytics of the self-quiz loop, and notebooks folded from edit operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["correct", "partial", "incorrect"]


def verdict_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("round").pivot("verdict", VERDICTS).agg(F.count(F.lit(1))).na.fill(0)


def mistake_counts(df: DataFrame) -> DataFrame:
    """round, mistake_class, n from studier_mistakes."""
    return df.select("round", F.explode("studier_mistakes").alias("m")).groupBy("round", F.col("m.mistake_class").alias("mistake_class")).agg(F.count(F.lit(1)).alias("n"))


def difficulty(rate: Column) -> Column:
    return F.when(rate.isNull(), "medium").when(rate < 1 / 3, "easy").when(rate < 2 / 3, "medium").otherwise("hard")


def curriculum(df: DataFrame, order: str = "qid", most: int = 2) -> DataFrame:
    """round, difficulty of the next one, focus: up to ``most`` distinct mechanisms that failed, in order."""
    rates = df.groupBy("round").agg(F.avg((F.col("verdict") == "correct").cast("double")).alias("rate"))
    failed = df.where("verdict <> 'correct'").groupBy("round", "mechanism").agg(F.min(order).alias("first"))
    ranked = failed.withColumn("n", F.row_number().over(Window.partitionBy("round").orderBy("first", "mechanism"))).where(F.col("n") <= most)
    focus = ranked.groupBy("round").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "mechanism"))), lambda x: x.mechanism).alias("focus"))
    return rates.join(focus, "round", "left").select("round", difficulty(F.col("rate")).alias("difficulty"), F.coalesce("focus", F.array().cast("array<string>")).alias("focus"))


def feedback(df: DataFrame) -> DataFrame:
    """round, qid, line: mechanism, verdict and the first mistake, or ``clean``."""
    first = F.coalesce(F.get(F.col("studier_mistakes.mistake"), F.lit(0)), F.lit("clean"))
    return df.select("round", "qid", F.concat_ws(" | ", "mechanism", "verdict", first).alias("line"))


def trajectory(df: DataFrame, budgets: list[str]) -> DataFrame:
    """Mean score per round and budget, the mean over budgets, and whether it is the best round (the first of equal ones)."""
    wide = df.groupBy("round").pivot("budget", budgets).agg(F.avg("score"))
    mean = sum((F.coalesce(b, F.lit(0.0)) for b in budgets), F.lit(0.0)) / len(budgets)
    wide = wide.withColumn("mean", mean)
    best = wide.agg(F.max_by("round", F.struct("mean", (-F.col("round")).alias("r"))).alias("best"))
    return wide.join(best, how="cross").withColumn("is_best", F.col("round") == F.col("best")).drop("best")


def accept_round(items: DataFrame, violations: DataFrame, least: int) -> DataFrame:
    """round, accepted, ok: items (round, qid, passed) without a violation that passed; fewer than ``least`` fail a round."""
    good = items.join(violations.select("qid").distinct(), "qid", "left_anti").where("passed")
    counts = items.select("round").distinct().join(good.groupBy("round").agg(F.count(F.lit(1)).alias("accepted")), "round", "left")
    return counts.select("round", F.coalesce("accepted", F.lit(0)).alias("accepted"), (F.coalesce("accepted", F.lit(0)) >= least).alias("ok"))


NOTEBOOK = "sections array<struct<id:string,title:string,content:string>>, next_id int, skipped array<string>"


def fold_operations(sections: list[dict], next_id: int, operations: list[tuple]) -> tuple[list[dict], int, list[str]]:
    """Applies (op, section_id, title, content) in order; what can't be applied is skipped, with a reason code.

    incomplete: an addition without title or content; unknown_section; no_content; unknown_op.
    """
    held = {s["id"]: dict(s) for s in sections}  # insertion order is the notebook's
    skipped = []
    for op, ident, title, content in operations:
        title, content = (title or "").strip(), (content or "").strip()
        if op == "add_section":
            if title and content:
                held[f"s{next_id}"] = {"id": f"s{next_id}", "title": title, "content": content}
                next_id += 1
            else:
                skipped.append("incomplete")
        elif ident not in held:
            skipped.append(f"unknown_section:{ident}")
        elif op == "delete_section":
            del held[ident]
        elif not content:
            skipped.append(f"no_content:{ident}")
        elif op == "replace_section":
            held[ident] |= {"content": content} | ({"title": title} if title else {})
        elif op == "append_to_section":
            held[ident]["content"] = f"{held[ident]['content'].rstrip()}\n{content}".strip()
        else:
            skipped.append(f"unknown_op:{op}")
    return list(held.values()), next_id, skipped


def apply_notebook_ops(notebooks: DataFrame, operations: DataFrame, key: str = "notebook") -> DataFrame:
    """key, sections, next_id, skipped: each notebook (key, sections, next_id) after its operations (key, seq, op, …) in order.

    A notebook's operations meet in one task; a notebook is a document of bounded size. Operations on absent notebooks are dropped.
    """

    def fold(_, books: pd.DataFrame, ops: pd.DataFrame) -> pd.DataFrame:
        if books.empty:
            return pd.DataFrame({key: [], "sections": [], "next_id": [], "skipped": []})
        book = books.iloc[0]
        sections = [s if isinstance(s, dict) else s.asDict() for s in book["sections"]]
        rows = ops.sort_values("seq")[["op", "section_id", "title", "content"]].itertuples(index=False, name=None) if len(ops) else []
        sections, next_id, skipped = fold_operations(sections, int(book["next_id"]), list(rows))
        return pd.DataFrame({key: [book[key]], "sections": [sections], "next_id": [next_id], "skipped": [skipped]})

    kind = notebooks.schema[key].dataType.simpleString()
    return notebooks.groupBy(key).cogroup(operations.groupBy(key)).applyInPandas(fold, f"{key} {kind}, {NOTEBOOK}")


def cap_sections(sections: DataFrame, key: str, order: str, cap: int, overhead: int = 0) -> DataFrame:
    """Rows (key, order, title, content) that stay when the largest sections go until the rest is within ``cap``; order is kept.

    A section's size is that of title and content plus ``overhead``. Of equal sizes, the later one goes first.
    """
    size = F.char_length("title") + F.char_length("content") + overhead
    smallest_first = Window.partitionBy(key).orderBy("__size", order)
    kept = sections.withColumn("__size", size).withColumn("__sum", F.sum("__size").over(smallest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return kept.where(F.col("__sum") <= cap).drop("__size", "__sum")

"""Paired statistics of two graded arms. Random choices come from hashes, so that any engine repeats them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import cut, numbered
from .metrics import expertise


def draw(seed: int, *parts: Column) -> Column:
    """A 32-bit number from the first hex digits of md5(seed|parts)."""
    text = F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draws(seed: int, parts: list[tuple]):
    """``draw`` of each tuple, as an array; nulls are left out, as ``concat_ws`` leaves them out."""
    import numpy as np

    md5 = hashlib.md5
    return np.array([int(md5("|".join([str(seed), *(str(x) for x in p if x is not None)]).encode()).hexdigest()[:8], 16) for p in parts], np.int64)


class PopulationError(ValueError):
    """Two arms that don't have the same episodes."""


def shared_population(a: DataFrame, b: DataFrame, keys: tuple = ("budget", "qid")) -> tuple[DataFrame, DataFrame]:
    """Both arms without the keys that only one has: for callers who choose to compare what is common."""
    return a.join(b.select(*keys).distinct(), list(keys), "left_semi"), b.join(a.select(*keys).distinct(), list(keys), "left_semi")


def paired_questions(a: DataFrame, b: DataFrame) -> DataFrame:
    """budget, qid, a, b, delta of two arms (budget, qid, score). Arms with other questions than each other's raise."""
    left = a.groupBy("budget", "qid").agg(F.avg("score").alias("a"))
    right = b.groupBy("budget", "qid").agg(F.avg("score").alias("b"))
    both = cut(left.join(right, ["budget", "qid"], "full"))
    gaps = both.where(F.col("a").isNull() | F.col("b").isNull()).limit(3).collect()
    if gaps:
        raise PopulationError(f"the arms' populations differ, such as at {[(g.budget, g.qid) for g in gaps]}")
    return both.withColumn("delta", F.col("b") - F.col("a"))


def paired_deltas(pairs: DataFrame) -> DataFrame:
    """Per budget: questions, mean delta, wins, losses, ties."""
    return pairs.groupBy("budget").agg(
        F.count(F.lit(1)).alias("questions"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("wins"),
        F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties"),
    )


def question_sums(grades: DataFrame) -> DataFrame:
    """run, budget, qid, s, t, n: sums that stand for a question's episodes whatever their number."""
    return grades.groupBy("run", "budget", "qid").agg(F.sum("score").alias("s"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))


def areas(sums: DataFrame, by: list[str], n: int | None = 4) -> DataFrame:
    """by, run, expertise from weighted question sums (s, t, n, times)."""
    points = sums.groupBy(*by, "run", "budget").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("score"), (F.sum(F.col("t") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("tokens"))
    return expertise(points, [*by, "run"], n=n)


def deltas_of(area: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    pick = lambda run: F.max(F.when(F.col("run") == run, F.col("expertise")))
    return area.groupBy(*by).agg((pick(b) - pick(a)).alias("delta"))


#: Questions of a block, whose draws in all replicates are a matrix that meets their sums in one task; replicates of a task.
BLOCK, REPS_A_TASK = 4096, 64


def drawn_counts(spark: SparkSession, reps: int, count: int, seed: int) -> DataFrame:
    """rep, block, times: how often each replicate draws each place of ``count``, an array for each block of places.

    A replicate is drawn whole in one task, as a vector of ``count`` small integers; no row is made for a draw.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for rep in batch.column("id").to_pylist():
                times = np.bincount(draws(seed, [(rep, i) for i in range(count)]) % count, minlength=count).astype(np.int32)
                starts = range(0, count, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([rep] * len(starts), pa.int64()), pa.array([s // BLOCK for s in starts], pa.int64()), pa.array([times[s : s + BLOCK] for s in starts], pa.list_(pa.int32()))], ["rep", "block", "times"])

    return spark.range(0, reps, 1, max(1, -(-reps // REPS_A_TASK))).mapInArrow(run, "rep long, block long, times array<int>")


def bootstrap_deltas(sums: DataFrame, questions: DataFrame, a: str, b: str, reps: int, seed: int, n: int | None = 4) -> DataFrame:
    """rep, delta: each rep draws as many questions as there are, with replacement, and recomputes both arms' areas.

    ``questions`` (qid, place) numbers them from 0. Draws are vectors of counts (``drawn_counts``); for each block of
    questions and run and budget, the matrix of all replicates' counts is multiplied with the questions' sums, so that what
    is shuffled afterwards is a row for each replicate, block, run and budget.
    """
    import pandas as pd

    count = questions.count()
    spark = sums.sparkSession
    counts = drawn_counts(spark, reps, count, seed)
    placed = sums.join(questions, "qid").select((F.col("place") / BLOCK).cast("long").alias("block"), (F.col("place") % BLOCK).cast("int").alias("at"), "run", "budget", *(F.col(c).cast("double").alias(c) for c in "stn"))

    def products(drawn: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        if len(drawn) and len(held):
            times = np.stack(drawn["times"].to_numpy())
            for (run, budget), own in held.groupby(["run", "budget"], dropna=False, sort=False):
                made = times[:, own["at"].to_numpy()] @ own[["s", "t", "n"]].to_numpy()
                out.append(pd.DataFrame({"rep": drawn["rep"], "run": run, "budget": budget, "s": made[:, 0], "t": made[:, 1], "n": made[:, 2]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["rep", "run", "budget", "s", "t", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    schema = f"rep long, run {kinds['run']}, budget {kinds['budget']}, s double, t double, n double"
    drawn = counts.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(products, schema).where("n > 0")
    return deltas_of(areas(drawn.withColumn("times", F.lit(1)), ["rep"], n), ["rep"], a, b)


def bootstrap_interval(deltas: DataFrame, reps: int, bounds: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """low, high, positive: order statistics of the deltas, not interpolated, and the share above 0. ``reps`` rows are sorted."""
    low, high = (max(round(q * reps) - 1, 0) for q in bounds)  # halves round to even
    placed = deltas.withColumn("place", F.row_number().over(Window.orderBy("delta")) - 1)  # one row a rep
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("delta")))
    return placed.agg(at(low).alias("low"), at(high).alias("high"), F.avg((F.col("delta") > 0).cast("double")).alias("positive"))


def number_questions(sums: DataFrame) -> DataFrame:
    """qid, place from 0 in the order of qid."""
    return numbered(sums.select("qid").distinct(), ["qid"], "place")


def leave_one_out(sums: DataFrame, a: str, b: str, n: int | None = 4) -> DataFrame:
    """qid, delta: the arms' difference without each question, from totals minus its own sums."""
    total = sums.groupBy("run", "budget").agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.sum("n").alias("all_n"))
    grid = sums.select("qid").distinct().join(total, how="cross")  # a row a question for each run and budget
    left = grid.join(sums, ["qid", "run", "budget"], "left")
    less = lambda big, own: F.col(big) - F.coalesce(own, F.lit(0))
    points = left.select("qid", "run", "budget", (less("all_s", "s") / less("all_n", "n")).alias("score"), (less("all_t", "t") / less("all_n", "n")).alias("tokens"))
    return deltas_of(expertise(points, ["qid", "run"], n=n), ["qid"], a, b)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided p-value of wins against losses under even odds, by logarithms of factorials."""
    n, m = wins + losses, F.least(wins, losses)
    log_factorial = lambda x: F.aggregate(F.sequence(F.lit(0).cast("bigint"), x.cast("bigint")), F.lit(0.0), lambda s, i: s + F.when(i > 1, F.ln(i.cast("double"))).otherwise(0.0))
    top = log_factorial(n)
    step = lambda s, i: F.struct((s.sum + F.exp(s.log)).alias("sum"), (s.log + F.ln((n - i).cast("double") / (i + 1).cast("double"))).alias("log"))
    start = F.struct(F.lit(0.0).alias("sum"), (-n * F.ln(F.lit(2.0)) + 0 * top).cast("double").alias("log"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), m.cast("bigint")), start, step)
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail.getField("sum")))


def permutation_test(pairs: DataFrame, reps: int, seed: int) -> DataFrame:
    """mean_delta, p_value: the share of sign flips whose mean is as far from 0, the observed one counted too.

    A pair's signs in all replicates are a vector; a task multiplies the matrix of its pairs' signs with their deltas and
    gives one sum a replicate, so that reps × tasks rows are shuffled, not reps × pairs. Null deltas count in no mean.
    """
    observed = pairs.agg(F.avg("delta").alias("observed"), F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, many = np.zeros(reps), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                keys, delta = [(b, q) for b, q in zip(part.column("budget").to_pylist(), part.column("qid").to_pylist(), strict=True)], part.column("delta").to_numpy(zero_copy_only=False)
                signs = np.stack([1 - 2 * (draws(seed, [(rep, *k) for k in keys]) % 2) for rep in range(reps)]) if keys else np.zeros((reps, 0))
                total += signs @ delta
                many += len(keys)
        yield pa.RecordBatch.from_arrays([pa.array(range(reps), pa.int64()), pa.array(total), pa.array([many] * reps, pa.int64())], ["rep", "sum", "many"])

    asked = pairs.where(F.col("delta").isNotNull()).select(F.col("budget").cast("string").alias("budget"), F.col("qid").cast("string").alias("qid"), F.col("delta").cast("double").alias("delta"))
    flips = asked.mapInArrow(run, "rep long, sum double, many long").groupBy("rep").agg(F.sum("sum").alias("sum"), F.sum("many").alias("many"))
    means = flips.select(F.when(F.col("many") > 0, F.col("sum") / F.col("many")).alias("flipped")).join(F.broadcast(observed), how="cross")
    return means.agg(F.first("observed").alias("mean_delta"), ((F.count_if(F.abs("flipped") >= F.abs("observed") - 1e-12) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def gain_concentration(per_question: DataFrame, k: int) -> DataFrame:
    """total, top_k, share of the total delta (qid, delta) that the ``k`` largest have."""
    top = per_question.orderBy(F.desc("delta"), "qid").limit(k).agg(F.sum("delta").alias("top_k"))
    return per_question.agg(F.sum("delta").alias("total")).join(top, how="cross").withColumn("share", F.col("top_k") / F.col("total"))


def budget_transitions(means: DataFrame, order: list[str]) -> DataFrame:
    """from_budget, to_budget, up, down, tied: steps of each question (run, budget, qid, score) along ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("budget"))
    steps = means.withColumn("place", place).where("place > 0")
    by = Window.partitionBy("run", "qid").orderBy("place")
    moved = steps.select("budget", F.lag("budget").over(by).alias("from_budget"), (F.col("score") - F.lag("score").over(by)).alias("d")).where("from_budget IS NOT NULL")
    return moved.groupBy("from_budget", F.col("budget").alias("to_budget")).agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.count_if(F.col("d") == 0).alias("tied"))


def largest_gainers(means: DataFrame, low: str, high: str, k: int = 5) -> DataFrame:
    """run, rank, qid, low, high, gain: the ``k`` questions of each run (run, budget, qid, score) that gain most between two budgets."""
    at = lambda budget: F.max(F.when(F.col("budget") == budget, F.col("score")))
    wide = means.where(F.col("budget").isin(low, high)).groupBy("run", "qid").agg(at(low).alias("low"), at(high).alias("high"))
    gains = wide.withColumn("gain", F.col("high") - F.col("low")).where("gain IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("run").orderBy(F.desc("gain"), "qid"))
    return gains.withColumn("rank", rank).where(F.col("rank") <= k).select("run", "rank", "qid", "low", "high", "gain")


def with_corrections(claims: DataFrame, fixes: DataFrame, keys: list[str]) -> DataFrame:
    """``claims`` with corrected scores where ``fixes`` (keys, score) has them."""
    return claims.join(fixes.select(*keys, F.col("score").alias("fixed")), keys, "left").withColumn("score", F.coalesce("fixed", "score")).drop("fixed")


def behaviour_corr(df: DataFrame, by: str, columns: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(by).agg(*(F.corr(c, score).alias(f"corr_{c}") for c in columns))

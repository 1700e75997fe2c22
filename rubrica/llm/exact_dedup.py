"""Exact dedup with a heavy-hitter split, in DataFrame functions only.

Equal texts are those with one SHA-256 after white space is deleted. A Misra-Gries style frequent-items sketch (Spark's
``approx_top_k`` family) names the digests that fill a noticeable share of all rows. Their true winners and sizes come
from a map-side aggregate and, being few by construction (at most ``max_heavy``), are broadcast, so all other rows of
heavy groups are settled without a shuffle. Every other digest has few rows and takes the ordinary shuffle.

Nulls: a null text counts as empty; a null id loses against any other id. Rows that repeat in full are one group, and
exactly one row of them stays. Other columns, whatever their names, are carried along unchanged by ``drop_copies``.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

#: Repeated light digests (about 150 bytes each) up to which their winners are broadcast.
BROADCAST_ROWS = 50_000
#: What ``[\x20\x09-\x0D]`` stands for.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def heavy_digests(keys: DataFrame, max_heavy: int, tracked: int, parts: int) -> DataFrame:
    """Candidates for frequent digests (column ``h``): sketches per group of partitions, then one of those few sketches."""
    by_part = keys.groupBy(F.pmod(F.spark_partition_id(), F.lit(parts)).alias("p")).agg(
        F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("sketch")
    )
    # grouped by a constant, as combine can't merge the empty buffers that partitions without rows give an ungrouped aggregate
    top = by_part.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {max_heavy})").alias("top"))
    return top.select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"), F.col("t.count").alias("about"))


def order_of(id_column: Column, length: Column) -> Column:
    """Smallest first: the longest original, then the smallest id, then null ids."""
    return F.struct((-length).alias("l"), id_column.isNull().alias("n"), id_column.alias("i"))


def heavy_winners(
    slim: DataFrame, share: float = 1e-3, max_heavy: int = 1000, tracked: int = 8192, parts: int = 64
) -> DataFrame:
    """One row for each verified heavy digest of ``slim`` (h, digest, o): digest, best order struct, group size.

    Heavy means at least ``share`` of all rows by true count. At most ``max_heavy`` rows, so the result may be broadcast.
    """
    candidates = heavy_digests(slim.select("h"), max_heavy, tracked, parts)
    least = slim.agg((F.count(F.lit(1)) * share).alias("least"))
    exact = (
        slim.join(F.broadcast(candidates.select("h")), "h", "left_semi")  # at most max_heavy keys
        .groupBy("digest")
        .agg(F.min("o").alias("best"), F.count(F.lit(1)).alias("size"))
    )
    return exact.join(F.broadcast(least), F.col("size") >= F.greatest("least", F.lit(2))).select("digest", "best", "size")


def digests(df: DataFrame, text: str, id_column: str) -> DataFrame:
    """h (64-bit key of the digest, for the sketch), digest, o (order struct) of each row."""
    digest = F.sha2(normal_text(F.col(text)), 256)
    return df.select(
        digest.alias("digest"),
        order_of(F.col(id_column), F.char_length(F.coalesce(F.col(text), F.lit("")))).alias("o"),
    ).withColumn("h", F.xxhash64("digest"))


def light_winners(slim: DataFrame, winners: DataFrame) -> DataFrame:
    """digest, best, size of the repeated digests beside the heavy ``winners``: rows of those go map-side, the rest takes an
    ordinary shuffle with map-side minima and counts. No digest's rows meet in one task, however many they are."""
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return rest.groupBy("digest").agg(F.min("o").alias("best"), F.count(F.lit(1)).alias("size")).where("size > 1")


class Winners:
    """Winners (digest, best, size) of the heavy digests, at most ``max_heavy`` and so broadcast, and of the light ones that
    repeat, broadcast up to ``broadcast_rows`` of them, as counted."""

    def __init__(self, slim: DataFrame, broadcast_rows: int, **heavy):
        self.heavy = written(heavy_winners(slim, **heavy))
        self.light = written(light_winners(slim, self.heavy))
        self.few = self.light.count() <= broadcast_rows

    def joined(self, rows: DataFrame) -> DataFrame:
        """``rows`` (digest, any others) with ``win`` (best, size), null where the digest doesn't repeat.

        Rows of heavy digests meet their winners where they are, before anything is shuffled, however many light digests
        repeat; only the others are shuffled by digest, and only where the light winners are too many to be broadcast.
        """
        win = lambda side: F.broadcast(side.select("digest", F.struct("best", "size").alias("win")))
        if self.few:
            return rows.join(win(self.heavy.unionByName(self.light)), "digest", "left")
        hot = rows.join(win(self.heavy), "digest")
        rest = rows.join(F.broadcast(self.heavy.select("digest")), "digest", "left_anti")
        return hot.unionByName(rest.join(self.light.select("digest", F.struct("best", "size").alias("win")), "digest", "left"))


def mark_copies(df: DataFrame, text: str = "text", id_column: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, **heavy) -> DataFrame:
    """A row for each row of ``df``: the id, keep_id, group_size, kept, text_sha256."""
    slim = digests(df, text, id_column)
    slim = written(slim.withColumn("o", F.col("o").withField("r", F.monotonically_increasing_id())))  # repeated rows differ by r
    marked = Winners(slim, broadcast_rows, **heavy).joined(slim.select("digest", "o"))
    best = F.coalesce("win.best", "o")
    return marked.select(
        F.col("o.i").alias(id_column), best.getField("i").alias("keep_id"), F.coalesce("win.size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("o") == best).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_copies(df: DataFrame, text: str = "text", id_column: str = "doc_id", broadcast_rows: int = BROADCAST_ROWS, **heavy) -> DataFrame:
    """``df`` with one row of each group of equal texts, all columns as they were.

    What stays is settled on digests; whole rows are only shuffled where the repeated light digests are too many to
    broadcast, heavy rows not among them, and where the best rows of a group tie in length and id.
    """
    slim = written(digests(df, text, id_column))
    winners = Winners(slim, broadcast_rows, **heavy)
    order = order_of(F.col(id_column), F.char_length(F.coalesce(F.col(text), F.lit(""))))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")  # so that no column of df can clash with ours
    keyed = df.select(F.sha2(normal_text(F.col(text)), 256).alias("digest"), order.alias("o"), row)

    def best_rows(rows: DataFrame) -> DataFrame:
        return winners.joined(rows).where(F.col("o") == F.coalesce("win.best", "o"))

    tied = written(best_rows(slim.select("digest", "o")).where(F.col("win").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    left = best_rows(keyed)
    if not tied.isEmpty():
        of_tied = left.join(tied, "digest", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("digest").orderBy("o")))
        left = left.join(tied, "digest", "left_anti").unionByName(of_tied.where("place = 1").drop("place"))
    return left.select("row.*")


def op1_exact_dedup(spark, sf_dir) -> DataFrame:
    return mark_copies(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT doc_id, text_sha256, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, text_sha256 FROM r
"""

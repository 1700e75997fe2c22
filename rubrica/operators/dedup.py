"""Dedup, similarity and decontamination on word shingles.

A text's set of shingles is an array of 64-bit hashes, made once a text (``shingle_sets``). Pairs of texts are made only
by equality of a shingle, a band or a phrase; frequent shingles are kept, as dropping them would change similarities.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import jaccard, normalize_text, shingle_hashes, shingles
from .lineage import cut, small_batches

#: Shingle rows of a side (16 bytes each, some 100 with the join's own) up to which it is broadcast, as counted.
BROADCAST_ROWS = 1_000_000
#: Members of a bucket that meet in one group; larger buckets are dealt to pairs of such blocks.
BLOCK = 256
#: How far below the threshold an estimate of a linked pair may lie: over four standard deviations of 128 two-bit minima.
MARGIN = 0.22


def exact_dedup(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row, by ``order``, of each normalized text; where rows tie in ``order``, one of them.

    What repeats is found on digests and order columns alone, with map-side counts. Rows are then judged where they are if
    the repeated texts are few enough to be broadcast, as adaptive execution measures; only ties are shuffled whole.
    """
    keyed = df.withColumns({"__d": F.sha2(normalize_text(F.col(text)), 256), "__o": F.struct(*order)})
    per = keyed.groupBy("__d", "__o").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy("__d").agg(F.min(F.struct("__o", "n")).alias("b"), F.sum("n").alias("n")).where("n > 1")
    best = cut(groups.select("__d", F.col("b.__o").alias("__best"), (F.col("b.n") > 1).alias("__ties")))
    left = keyed.join(best, "__d", "left").where(F.col("__best").isNull() | (F.col("__o") == F.col("__best")))
    if not best.where("__ties").isEmpty():
        rank = F.row_number().over(Window.partitionBy("__d").orderBy("__o"))
        left = left.where("NOT coalesce(__ties, false)").unionByName(left.where("__ties").withColumn("__r", rank).where("__r = 1").drop("__r"))
    return left.select(*df.columns)


def shingle_sets(df: DataFrame, key: str, text: str, k: int = 3) -> DataFrame:
    """key, n (size), s (shingle hashes) of each text."""
    small_batches(df.sparkSession)
    sets = df.select(F.col(key).alias("key"), shingle_hashes(F.col(text), k).alias("s"))
    return sets.select("key", F.size("s").alias("n"), "s")


def minhash(df: DataFrame, key: str, text: str, k: int = 3, permutations: int = 128) -> DataFrame:
    """key, n, signature (array of minima) of texts with shingles. A row's own work: nothing is shuffled."""
    return _signed(shingle_sets(df, key, text, k), permutations).withColumnRenamed("key", key)


def _signed(sets: DataFrame, permutations: int) -> DataFrame:
    return sets.where("n > 0").select("key", "n", _minima(permutations)("s").alias("signature"))


def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and shifts of the permutations h → h · factor + shift of the 64-bit numbers."""
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, permutations, dtype=np.uint64)


def _minima(permutations: int):
    factors, shifts = _factors(permutations)

    @F.arrow_udf(ArrayType(LongType()))
    def minima(sets: pa.Array) -> pa.Array:
        """Minima of each set, none of them empty: a pass over the flat hashes for each permutation."""
        bounds = sets.offsets.to_numpy().astype(np.int64)
        flat = sets.values.slice(bounds[0], bounds[-1] - bounds[0]).to_numpy(zero_copy_only=False).view(np.uint64)
        out = np.empty((len(sets), permutations), np.int64)
        for i in range(permutations if len(sets) else 0):
            out[:, i] = np.minimum.reduceat(flat * factors[i] + shifts[i], bounds[:-1] - bounds[0]).view(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, permutations), pa.int32()), pa.array(out.ravel()))

    return minima


@F.arrow_udf(ArrayType(LongType()))
def _planes(signatures: pa.Array) -> pa.Array:
    """The highest bit of all minima, then the next, 64 permutations a number."""
    minima = np.stack(signatures.to_numpy(zero_copy_only=False)) if len(signatures) else np.zeros((0, 64), np.int64)
    # the highest bits of minima are mostly zero, so the bits are taken from a product
    mixed = minima.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    planes = [np.packbits((mixed >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), 1, "little") for bit in (63, 62)]
    words = np.concatenate([np.pad(p, ((0, 0), (0, -p.shape[1] % 8))).view(np.int64) for p in planes], 1)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, words.size + 1, words.shape[1]), pa.int32()), pa.array(words.ravel()))


def overlaps(a: DataFrame, b: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """a_key, b_key, similarity of the sets (``shingle_sets``) of two tables that share a shingle.

    Where ``b`` has at most ``broadcast_rows`` shingle rows, as counted, they are broadcast: a text's shingles then meet
    them where they are, and what is shuffled is a count for each pair, not a row for each shingle. Beyond that both sides
    are shuffled by shingle, where adaptive execution splits frequent ones.
    """
    rows = lambda sets, side: sets.select(F.col("key").alias(f"{side}_key"), F.col("n").alias(f"{side}_n"), F.explode("s").alias("h"))
    few = (b.agg(F.sum("n").alias("n")).first().n or 0) <= broadcast_rows
    right = F.broadcast(rows(b, "b")) if few else rows(b, "b")
    both = rows(a, "a").join(right, "h").groupBy("a_key", "b_key").agg(F.count(F.lit(1)).alias("both"), F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"))
    return both.select("a_key", "b_key", (F.col("both") / (F.col("a_n") + F.col("b_n") - F.col("both"))).alias("similarity"))


#: Held-out texts that a shingle may stand in to count as rare.
RARE = 64
#: Slack of bounds computed in floating point.
SLACK = 1e-9


def rarity(b: DataFrame) -> DataFrame:
    """h, f: each shingle of ``b`` and the number of its sets that hold it."""
    return b.select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("f"))


def known(sets: DataFrame, order: DataFrame) -> DataFrame:
    """key, n, known: the shingles of each set that stand in ``order`` (``rarity``), as (f, h), the rarest first.

    Empty sets are left out, those with nothing in the order aren't. Keys are unique.
    """
    rows = sets.select("key", "n", F.explode("s").alias("h")).join(order, "h", "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("f").isNotNull(), F.struct("f", "h"))))
    return rows.groupBy("key").agg(F.first("n").alias("n"), listed.alias("known"))


class Ordered:
    """Two tables of sets with their shingles in the order of rarity in the second, for joins that leave frequent ones out.

    The order is broadcast up to ``broadcast_rows`` shingles, as counted, and else joined by shuffle, each shingle once.
    """

    def __init__(self, a: DataFrame, b: DataFrame, broadcast_rows: int = BROADCAST_ROWS):
        order = cut(rarity(b))
        self.few = order.count() <= broadcast_rows
        self.small = F.broadcast if (b.agg(F.sum("n").alias("n")).first().n or 0) <= broadcast_rows else lambda df: df
        order = F.broadcast(order) if self.few else order
        self.a, self.b = cut(known(a, order)), cut(known(b, order))

    def matched(self, a_part: Column, b_part: Column) -> DataFrame:
        """a_key, b_key, a_n, b_n, both: pairs that share a shingle of two parts of their ``known``, and how many they share."""
        side = lambda df, x, part: df.select(F.col("key").alias(f"{x}_key"), F.col("n").alias(f"{x}_n"), F.explode(part).alias("s")).select(f"{x}_key", f"{x}_n", "s.h")
        met = side(self.a, "a", a_part).join(self.small(side(self.b, "b", b_part)), "h")
        return met.groupBy("a_key", "b_key").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.count(F.lit(1)).alias("both"))


def _share(both: Column, a_n: Column, b_n: Column) -> Column:
    return both / (a_n + b_n - both)


def pairs_above(a: DataFrame, b: DataFrame, threshold: float, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """a_key, b_key, similarity of all pairs of sets whose similarity exceeds ``threshold``, by a prefix filter.

    Such a pair shares more than threshold · n of each side's shingles, so with both in one order, by rarity, it shares one
    among the first of either that are left when so many are taken from the end. Only those are joined, with bounds on the
    sizes, and pairs are confirmed on whole sets. A frequent shingle is among the first only of sets with little else.
    """
    sides = Ordered(a, b, broadcast_rows)
    first = F.slice("known", F.lit(1), F.greatest(F.size("known") - F.floor(F.col("n") * threshold - SLACK).cast("int"), F.lit(0)))
    sized = (F.col("b_n") > F.col("a_n") * threshold - SLACK) & (F.col("a_n") > F.col("b_n") * threshold - SLACK)
    found = sides.matched(first, first).where(sized).select("a_key", "b_key", "a_n", "b_n")
    whole = lambda df, x: df.select(F.col("key").alias(f"{x}_key"), F.col("known.h").alias(f"{x}_s"))
    both = F.size(F.array_intersect("a_s", "b_s"))
    scored = found.join(whole(sides.a, "a"), "a_key").join(sides.small(whole(sides.b, "b")), "b_key")
    return scored.select("a_key", "b_key", _share(both, F.col("a_n"), F.col("b_n")).alias("similarity")).where(F.col("similarity") > threshold)


def best_overlaps(a: DataFrame, b: DataFrame, rare: int = RARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """key, best: the highest similarity of each set of ``a`` to a set of ``b``, exact; 0 where they share nothing. Empty sets
    are left out.

    Pairs are made by shingles of at most ``rare`` sets of ``b``, so they grow with ``a``; what such a pair shares of
    frequent ones is counted on its arrays. Other pairs share frequent shingles only, and there only which of them a set
    holds counts: sets of ``a`` are taken by the frequent ones that they hold, where these can beat what was found, and
    those of ``b`` likewise, the smallest for all; classes are joined, not sets, however many hold a passage.
    """
    sides = Ordered(a, b, broadcast_rows)
    few, many = F.filter("known", lambda x: x.f <= rare), F.filter("known", lambda x: x.f > rare).getField("h")
    pairs = sides.matched(few, few)
    frequent = lambda df, x: df.select(F.col("key").alias(f"{x}_key"), many.alias(f"{x}_s")).where(F.size(f"{x}_s") > 0)
    of_b = cut(frequent(sides.b, "b").join(sides.b.select(F.col("key").alias("b_key"), "n"), "b_key").groupBy(F.col("b_s").alias("s")).agg(F.min("n").alias("b_n")).withColumn("b_class", F.monotonically_increasing_id()))
    every = sides.a.select("key", F.lit(0.0).alias("best"))
    score = lambda df: df.select(F.col("a_key").alias("key"), _share(F.col("both"), F.col("a_n"), F.col("b_n")).alias("best")).unionByName(every).groupBy("key").agg(F.max("best").alias("best"))
    if of_b.isEmpty():
        return score(pairs)
    shared = F.coalesce(F.size(F.array_intersect("a_s", "b_s")), F.lit(0))
    pairs = pairs.join(frequent(sides.a, "a"), "a_key", "left").join(sides.small(frequent(sides.b, "b")), "b_key", "left")
    best = cut(score(pairs.withColumn("both", F.col("both") + F.when(F.col("a_s").isNotNull() & F.col("b_s").isNotNull(), shared).otherwise(0))))
    least = of_b.agg(F.min("b_n").alias("least"))
    most = F.size("s") / (F.col("n") + F.greatest(F.col("least") - F.size("s"), F.lit(0)))
    open_ = sides.a.select("key", "n", many.alias("s")).where(F.size("s") > 0).join(F.broadcast(least)).join(best, "key").where(F.col("best") < most)
    held = cut(open_.select("key", "n", F.xxhash64("s").alias("class"), "s"))
    classes = held.groupBy("class", "s").agg(F.count(F.lit(1)).alias("rows"))
    own = classes.select("class", "s", F.explode("s").alias("h"))
    other = of_b.select("b_n", "b_class", F.explode("s").alias("h"))
    met = own.join(other, "h").groupBy("class", "s", "b_class").agg(F.count(F.lit(1)).alias("both"), F.first("b_n").alias("b_n"))
    met = met.groupBy("class", "s", "both").agg(F.min("b_n").alias("b_n"))  # of as many shared, the smallest set
    rest = held.join(met, ["class", "s"]).groupBy("key").agg(F.max(_share(F.col("both"), F.col("n"), F.col("b_n"))).alias("best"))
    return best.unionByName(rest).groupBy("key").agg(F.max("best").alias("best"))


def _estimate(a: str, b: str, permutations: int) -> Column:
    """Similarity by the share of equal pairs of bits in two arrays of planes, corrected for chance collisions of one in four."""
    words = -(-permutations // 64)
    differ = [F.bit_count(F.expr(f"({a}[{w}] ^ {b}[{w}]) | ({a}[{words + w}] ^ {b}[{words + w}])")) for w in range(words)]
    same = 1 - reduce(lambda x, y: x + y, differ) / F.lit(float(permutations))
    return (same - 0.25) / 0.75


def candidate_pairs(sets: DataFrame, threshold: float, permutations: int = 128, rows: int = 4, block: int = BLOCK) -> DataFrame:
    """a_key < b_key of sets that share a band and whose estimate is within ``MARGIN`` of ``threshold``.

    Buckets of one member go first. A bucket of many members is dealt to blocks, so that no task holds all its pairs; pairs
    leave a block only if sizes and estimate allow them.
    """
    bands = F.array(*(F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(permutations // rows)))
    signed = cut(_signed(sets, permutations).select("key", "n", bands.alias("bands"), _planes("signature").alias("p")))
    banded = signed.select("key", "n", "p", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    dealt = banded.join(shared, "band").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))

    def side(name: str, i: Column, j: Column) -> DataFrame:
        return dealt.select("band", F.col("key").alias(f"{name}_key"), F.col("n").alias(f"{name}_n"), F.col("p").alias(f"{name}_p"), i.alias("i"), j.alias("j"))

    own = F.col("own")
    left = side("x", own, F.explode(F.sequence(own, F.col("blocks") - 1)))
    right = side("y", F.explode(F.sequence(F.lit(0), own)), own)
    met = left.join(right, ["band", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("x_key") < F.col("y_key")))
    likely = (F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n")) & (_estimate("x_p", "y_p", permutations) >= threshold - MARGIN)
    return met.where(likely).select(F.least("x_key", "y_key").alias("a_key"), F.greatest("x_key", "y_key").alias("b_key")).distinct()


def near_dup_pairs(df: DataFrame, key: str, text: str, threshold: float = 0.7, k: int = 3, permutations: int = 128, rows: int = 4, sets: DataFrame | None = None) -> DataFrame:
    """a_key < b_key, similarity ≥ ``threshold``: band candidates, confirmed on full sets. Give it exactly deduplicated rows.

    ``sets``: the table's ``shingle_sets``, where they are there already.
    """
    sets = shingle_sets(df, key, text, k) if sets is None else sets
    found = cut(candidate_pairs(sets, threshold, permutations, rows))
    named = found.select(F.col("a_key").alias("key")).union(found.select(F.col("b_key").alias("key"))).distinct()
    own = sets.join(named, "key", "left_semi")
    a, b = (own.select(F.col("key").alias(f"{x}_key"), F.col("s").alias(f"{x}_s")) for x in "ab")
    both = F.size(F.array_intersect("a_s", "b_s"))
    scored = found.join(a, "a_key").join(b, "b_key").select("a_key", "b_key", (both / (F.size("a_s") + F.size("b_s") - both)).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold)


def greedy_survivors(pairs: DataFrame, first: str = "a_key", second: str = "b_key") -> DataFrame:
    """key, kept, kept_by for all rows of ``pairs``, whose ``first`` comes before ``second`` in the order of survival.

    A row goes only if it matches an earlier row that stays, and names the first such row. Rounds decide all rows without
    an undecided earlier match; a long chain sets the number of rounds.
    """
    edges = cut(pairs.select(F.col(first).alias("a"), F.col(second).alias("b")))
    undecided = edges.select(F.col("a").alias("key")).union(edges.select(F.col("b").alias("key"))).distinct()
    decided = None
    while True:
        stay = undecided.join(edges.select(F.col("b").alias("key")), "key", "left_anti")
        drop = edges.join(stay.select(F.col("key").alias("a")), "a").groupBy(F.col("b").alias("key")).agg(F.min("a").alias("kept_by"))
        settled = cut(stay.select("key", F.lit(True).alias("kept"), F.lit(None).cast(edges.schema["a"].dataType).alias("kept_by")).unionByName(drop.select("key", F.lit(False).alias("kept"), "kept_by")))
        decided = settled if decided is None else decided.unionByName(settled)
        undecided = cut(undecided.join(settled.select("key"), "key", "left_anti"))
        if undecided.isEmpty():
            return decided
        known = settled.select("key")
        edges = cut(edges.join(known.withColumnRenamed("key", "a"), "a", "left_anti").join(known.withColumnRenamed("key", "b"), "b", "left_anti"))


def decontam_audit(candidates: DataFrame, heldout: DataFrame, threshold: float = 0.35) -> DataFrame:
    """key, max_similarity, flagged for each candidate with shingles (both tables are ``shingle_sets``); without overlap 0."""
    best = best_overlaps(candidates, heldout)
    return best.select("key", F.col("best").alias("max_similarity"), (F.col("best") > threshold).alias("flagged"))


def decontaminate(df: DataFrame, heldout: DataFrame, key: str, text: str, heldout_key: str, heldout_text: str, threshold: float = 0.35, k: int = 3, sets: DataFrame | None = None) -> DataFrame:
    """``df`` with max_similarity to any held-out text and kept; rows above ``threshold`` aren't kept.

    Rows that share nothing with the held-out texts count 0; only pairs that overlap are joined back. ``sets``: ``df``'s
    ``shingle_sets``, where they are there already.
    """
    sets = shingle_sets(df, key, text, k) if sets is None else sets
    best = best_overlaps(sets, shingle_sets(heldout, heldout_key, heldout_text, k)).select(F.col("key").alias(key), F.col("best").alias("max_similarity"))
    joined = df.join(best, key, "left").withColumn("max_similarity", F.coalesce("max_similarity", F.lit(0.0)))
    return joined.withColumn("kept", F.col("max_similarity") <= threshold)


def reject_repeats(new: DataFrame, prior: DataFrame, key: str, text: str, prior_key: str, prior_text: str, threshold: float = 0.5, k: int = 3) -> DataFrame:
    """Rows of ``new`` whose similarity to every prior text is at most ``threshold``."""
    pairs = pairs_above(shingle_sets(new, key, text, k), shingle_sets(prior, prior_key, prior_text, k), threshold)
    return new.join(pairs.select(F.col("a_key").alias(key)).distinct(), key, "left_anti")


def verbatim_dups(df: DataFrame, text: str, batch: str, key: str) -> DataFrame:
    """key, in_batch, earlier: whether a row's stripped text repeats in its batch, or occurs in an earlier one."""
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""), 256)
    rows = df.select(F.col(key), F.col(batch).alias("batch"), digest.alias("d"))
    per_batch = rows.groupBy("d", "batch").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("d").agg(F.min("batch").alias("first_batch"))
    return rows.join(per_batch, ["d", "batch"]).join(first, "d").select(key, (F.col("n") > 1).alias("in_batch"), (F.col("first_batch") < F.col("batch")).alias("earlier"))


def overlap_summary(audit: DataFrame) -> DataFrame:
    """Mean and maximum of the candidates' highest similarities."""
    return audit.agg(F.avg("max_similarity").alias("mean_max"), F.max("max_similarity").alias("max_max"))


def longest_shared_phrase(a: DataFrame, b: DataFrame, a_key: str, a_text: str, b_key: str, b_text: str, least: int = 5) -> DataFrame:
    """a_key, b_key, words: the length of the longest phrase that two texts share, of any length from ``least`` words on.

    Texts meet on their runs of ``least`` words only, so frequent words make no pairs. Runs that follow each other in both
    texts have one difference of places; the longest unbroken stretch of them is the phrase.
    """

    def runs(df: DataFrame, key: str, text: str, name: str) -> DataFrame:
        words = df.select(F.col(key).alias(f"{name}_key"), F.split(normalize_text(F.col(text)), " ").alias("w")).where(F.size("w") >= least)
        hashed = F.transform(F.sequence(F.lit(0), F.size("w") - least), lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(least))))
        return words.select(f"{name}_key", F.posexplode(hashed).alias(f"{name}_at", "h"))

    shared = runs(a, a_key, a_text, "a").join(runs(b, b_key, b_text, "b"), "h")
    line = shared.select("a_key", "b_key", "a_at", (F.col("a_at") - F.col("b_at")).alias("shift"))
    place = F.row_number().over(Window.partitionBy("a_key", "b_key", "shift").orderBy("a_at"))
    stretches = line.withColumn("start", F.col("a_at") - place).groupBy("a_key", "b_key", "shift", "start").agg((F.count(F.lit(1)) + (least - 1)).alias("words"))
    return stretches.groupBy("a_key", "b_key").agg(F.max("words").cast("int").alias("words"))


def similarity_of(a: Column, b: Column) -> Column:
    return jaccard(shingles(a), shingles(b))

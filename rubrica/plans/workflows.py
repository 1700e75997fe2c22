"""Whole workflows put together from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, foldback, metrics, stats
from ..operators import text as filters
from ..operators.lineage import cut
from .curate_queries import BLOCK, TRIM, homed, plan
from .dedup_queries import GREEDY, HELD, SIZES
from .proxies import AREA, G, arm, grades
from .registry import dealt, query, table
from .text_queries import NORM, SHINGLES


@query(
    "w1_seed_pool",
    f"WITH RECURSIVE {SHINGLES}, {HELD}, {SIZES}, o AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN b USING (s) GROUP BY 1, 2), bad AS (SELECT doc_id FROM o JOIN sn USING (doc_id) JOIN bn USING (item_id) WHERE c / (sn.n + bn.n - c) > 0.35), "
    f"k AS (SELECT doc_id, row_number() OVER (PARTITION BY {NORM.format('text')} ORDER BY doc_id) AS n FROM documents WHERE length(text) BETWEEN 30 AND 20000 AND lang = 'en'), "
    "fs AS (SELECT s.* FROM s JOIN k USING (doc_id) WHERE n = 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM fs x JOIN fs y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2), "
    "e AS (SELECT a AS a_key, b AS b_key FROM c JOIN sn na ON na.doc_id = a JOIN sn nb ON nb.doc_id = b WHERE c / (na.n + nb.n - c) >= 0.7), "
    f"{GREEDY.format(pairs='e')} "
    "SELECT doc_id FROM k WHERE n = 1 AND doc_id NOT IN (SELECT key FROM gs WHERE NOT kept) AND doc_id NOT IN (SELECT doc_id FROM bad)",
)
def seed_pool(spark, sf_dir) -> DataFrame:
    """W1: length and language rules, exact dedup, near-duplicate survivors, decontamination against ``benchmark``."""
    rules = {"length": text.length_between(F.col("text")), "language": F.col("lang") == "en"}
    kept = filters.filter_funnel(dealt(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), rules).where("reason IS NULL")
    unique = dedup.exact_dedup(kept, "text", ["doc_id"])
    sets = cut(dedup.shingle_sets(unique, "doc_id", "text"))  # made once, for pairs and decontamination
    near = dedup.near_dup_pairs(unique, "doc_id", "text", sets=sets)
    gone = dedup.greedy_survivors(near).where("NOT kept").select("key")
    survivors = sets.join(gone, "key", "left_anti")
    clean = dedup.decontaminate(survivors.select(F.col("key").alias("doc_id")), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", sets=survivors)
    return clean.where("kept").select("doc_id")


@query(
    "w2_paired_expertise",
    f"WITH {G}, {AREA} SELECT round(max(CASE WHEN run = 'a' THEN expertise END), 6) AS a, round(max(CASE WHEN run = 'b' THEN expertise END), 6) AS b, "
    "round(max(CASE WHEN run = 'b' THEN expertise END) - max(CASE WHEN run = 'a' THEN expertise END), 6) AS delta FROM e",
)
def paired_expertise(spark, sf_dir) -> DataFrame:
    """W2: graded episodes to budget means, expertise of both arms and their difference."""
    area = metrics.expertise(metrics.budget_means(grades(spark, sf_dir)), ["run"])
    pick = lambda run: F.max(F.when(F.col("run") == run, F.col("expertise")))
    return area.agg(F.round(pick("a"), 6).alias("a"), F.round(pick("b"), 6).alias("b"), F.round(pick("b") - pick("a"), 6).alias("delta"))


@query(
    "w3_verified_note",
    f"{TRIM}, s AS (SELECT topic, section, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY position) AS body FROM y WHERE total <= 150000 GROUP BY 1, 2) "
    "SELECT topic, '# Study notes' || chr(10) || chr(10) || string_agg('## ' || section || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY section) || chr(10) AS rendered FROM s GROUP BY topic".replace("FROM h)", "FROM h WHERE id % 7 <> 0 AND delivery = 'note')"),
)
def verified_note(spark, sf_dir) -> DataFrame:
    """W3: entries to sections of the plan, verdicts, note or store, size ceiling, rendered notes by topic."""
    entries = homed(spark, sf_dir)
    verdicts = entries.select("id", F.when(F.col("id") % 7 == 0, "contradicted").otherwise("verified").alias("verdict"))
    kept = foldback.apply_verdicts(entries, verdicts).where("kept")
    notes = foldback.route_entries(kept, "hybrid").where("target = 'note'")
    return foldback.render_note(foldback.trim_to_ceiling(notes, "topic"), plan(spark), "topic", "Study notes")


def bootstrap_summary(spark, sf_dir, reps: int = 1000, seed: int = 20240501) -> DataFrame:
    """Paired deltas by budget with the bootstrap interval of the expertise difference."""
    g = grades(spark, sf_dir)
    sums = stats.question_sums(g)
    interval = stats.bootstrap_interval(stats.bootstrap_deltas(sums, stats.number_questions(sums), "a", "b", reps, seed), reps)
    return stats.paired_deltas(stats.paired_questions(*stats.shared_population(arm(g, "a"), arm(g, "b")))).join(interval, how="cross")

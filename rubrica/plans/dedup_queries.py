"""Dedup and decontamination: ``documents`` as sessions, ``benchmark`` as the held-out set."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import dedup
from .registry import dealt, query, table
from .text_queries import NORM, SHINGLES

HELD = (
    "bw AS (SELECT item_id, string_split(" + NORM.format("text") + ", ' ') AS w FROM benchmark), "
    "b AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(CASE WHEN w = [''] THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] "
    "ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM bw))"
)
SIZES = "sn AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), bn AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)"
AUDIT = (
    f"{SHINGLES}, {HELD}, {SIZES}, o AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN b USING (s) GROUP BY 1, 2), "
    "j AS (SELECT doc_id, item_id, c / (sn.n + bn.n - c) AS j FROM o JOIN sn USING (doc_id) JOIN bn USING (item_id)), "
    "m AS (SELECT sn.doc_id, coalesce(max(j), 0) AS max_similarity FROM sn LEFT JOIN j USING (doc_id) GROUP BY 1)"
)
#: First document of each normalized text.
FIRSTS = f"f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY {NORM.format('text')})"
PAIRS = (
    f"{SHINGLES}, {FIRSTS}, fs AS (SELECT s.* FROM s JOIN f USING (doc_id)), n AS (SELECT doc_id, count(*) AS n FROM fs GROUP BY 1), "
    "c AS (SELECT x.doc_id AS a_key, y.doc_id AS b_key, count(*) AS c FROM fs x JOIN fs y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2), "
    "p AS (SELECT a_key, b_key, round(c / (na.n + nb.n - c), 6) AS similarity FROM c JOIN n na ON na.doc_id = a_key JOIN n nb ON nb.doc_id = b_key WHERE c / (na.n + nb.n - c) >= 0.7)"
)


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def audited(spark, sf_dir):
    sets = dedup.shingle_sets(dealt(docs(spark, sf_dir)), "doc_id", "text")
    return dedup.decontam_audit(sets, dedup.shingle_sets(table(spark, sf_dir, "benchmark"), "item_id", "text"))


def firsts(spark, sf_dir):
    return dedup.exact_dedup(dealt(docs(spark, sf_dir)), "text", ["doc_id"])


@query("dd1_exact_dedup", f"SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY {NORM.format('text')}")
def dd1(spark, sf_dir):
    return firsts(spark, sf_dir).select("doc_id", "lang")


@query("dd2_minhash")
def dd2(spark, sf_dir):
    return dedup.minhash(docs(spark, sf_dir), "doc_id", "text")


@query("dd3_near_dup_pairs", f"WITH {PAIRS} SELECT * FROM p")
def dd3(spark, sf_dir):
    return dedup.near_dup_pairs(firsts(spark, sf_dir), "doc_id", "text").withColumn("similarity", F.round("similarity", 6))


#: Survivors of ``{pairs}`` (a_key, b_key): rows are decided one by one in their order.
GREEDY = (
    "gn AS (SELECT key, row_number() OVER (ORDER BY key) AS i, coalesce(list(a) FILTER (a IS NOT NULL), []) AS before FROM "
    "(SELECT b_key AS key, a_key AS a FROM {pairs} UNION ALL SELECT a_key AS key, NULL AS a FROM {pairs}) GROUP BY key), "
    "gr AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept UNION ALL SELECT gn.i, CASE WHEN list_has_any(kept, before) THEN kept ELSE list_append(kept, key) END FROM gr JOIN gn ON gn.i = gr.i + 1), "
    "gl AS (SELECT kept FROM gr ORDER BY i DESC LIMIT 1), "
    "gs AS (SELECT key, list_contains(kept, key) AS kept, CASE WHEN NOT list_contains(kept, key) THEN list_min(list_intersect(before, kept)) END AS kept_by FROM gn, gl)"
)


@query("dd4_greedy_survivors", f"WITH RECURSIVE {PAIRS}, {GREEDY.format(pairs='p')} SELECT key, kept, coalesce(kept_by, -1) AS kept_by FROM gs")
def dd4(spark, sf_dir):
    return dedup.greedy_survivors(dedup.near_dup_pairs(firsts(spark, sf_dir), "doc_id", "text")).withColumn("kept_by", F.coalesce("kept_by", F.lit(-1)))


@query(
    "dd5_jaccard",
    f"WITH {SHINGLES}, {HELD}, x AS (SELECT s.doc_id, s.s FROM s), y AS (SELECT item_id AS doc_id, s FROM b), "
    "k AS (SELECT DISTINCT doc_id FROM x JOIN y USING (doc_id)), "
    "i AS (SELECT doc_id, count(*) AS c FROM x JOIN y USING (doc_id, s) GROUP BY 1), nx AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1), ny AS (SELECT doc_id, count(*) AS n FROM y GROUP BY 1) "
    "SELECT k.doc_id, round(coalesce(c, 0) / (nx.n + ny.n - coalesce(c, 0)), 6) AS similarity FROM k LEFT JOIN i USING (doc_id) JOIN nx USING (doc_id) JOIN ny USING (doc_id)",
)
def dd5(spark, sf_dir):
    held = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("other"))
    both = docs(spark, sf_dir).select("doc_id", "text").join(held, "doc_id")
    return both.select("doc_id", F.round(dedup.similarity_of(F.col("text"), F.col("other")), 6).alias("similarity"))


@query("dd6_decontam_audit", f"WITH {AUDIT} SELECT doc_id, round(max_similarity, 6) AS max_similarity, max_similarity > 0.35 AS flagged FROM m")
def dd6(spark, sf_dir):
    audit = audited(spark, sf_dir)
    return audit.select(F.col("key").alias("doc_id"), F.round("max_similarity", 6).alias("max_similarity"), "flagged")


@query("dd7_decontaminate", f"WITH {AUDIT} SELECT doc_id, lang, round(coalesce(max_similarity, 0), 6) AS max_similarity, coalesce(max_similarity, 0) <= 0.35 AS kept FROM documents LEFT JOIN m USING (doc_id)")
def dd7(spark, sf_dir):
    out = dedup.decontaminate(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return out.select("doc_id", "lang", F.round("max_similarity", 6).alias("max_similarity"), "kept")


@query("dd8_reject_repeats", f"WITH {AUDIT} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM j WHERE j > 0.05)")
def dd8(spark, sf_dir):
    return dedup.reject_repeats(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", 0.05).select("doc_id")


@query(
    "dd9_verbatim_dups",
    r"WITH r AS (SELECT doc_id, source, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS d FROM documents) "
    "SELECT doc_id, count(*) OVER (PARTITION BY d, source) > 1 AS in_batch, min(source) OVER (PARTITION BY d) < source AS earlier FROM r",
)
def dd9(spark, sf_dir):
    return dedup.verbatim_dups(docs(spark, sf_dir), "text", "source", "doc_id")


@query("dd10_overlap_summary", f"WITH {AUDIT} SELECT round(avg(max_similarity), 6) AS mean_max, round(max(max_similarity), 6) AS max_max FROM m")
def dd10(spark, sf_dir):
    audit = audited(spark, sf_dir)
    return dedup.overlap_summary(audit).select(F.round("mean_max", 6).alias("mean_max"), F.round("max_max", 6).alias("max_max"))


LEAST = 3


def _runs(table_: str, key: str, name: str) -> str:
    """All runs of ``LEAST`` words or more, up to the longest text of ``benchmark``."""
    return (
        f"{name}w AS (SELECT {key}, string_split({NORM.format('text')}, ' ') AS w FROM {table_}), {name} AS (SELECT DISTINCT {key}, n, array_to_string(w[i:i + n - 1], ' ') AS g "
        f"FROM (SELECT {key}, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM {name}w, (SELECT unnest(range({LEAST}, (SELECT max(len(string_split({NORM.format('text')}, ' '))) + 1 FROM benchmark))) AS n) WHERE len(w) >= n))"
    )


@query(
    "dd11_longest_shared_phrase",
    f"WITH {_runs('benchmark', 'item_id', 'x')}, {_runs('conversations', 'conv_id', 'y')} SELECT item_id, conv_id, CAST(max(n) AS INTEGER) AS words FROM x JOIN y USING (n, g) GROUP BY 1, 2",
)
def dd11(spark, sf_dir):
    shared = dedup.longest_shared_phrase(table(spark, sf_dir, "benchmark"), dealt(table(spark, sf_dir, "conversations")), "item_id", "text", "conv_id", "text", LEAST)
    return shared.select(F.col("a_key").alias("item_id"), F.col("b_key").alias("conv_id"), "words")

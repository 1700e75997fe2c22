"""Vectors: ``embeddings`` with their label as cluster, ``labels`` as screen verdicts, ``documents`` as sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import vectors
from .registry import query, table

UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
RANKED = (
    f"{UNIT}, d AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM u), c AS (SELECT label, i, avg(x) AS x FROM d GROUP BY 1, 2), "
    "l AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY 1), k AS (SELECT d.vec_id, d.label, sum(d.x * c.x) / any_value(l.n) AS cosine FROM d JOIN c USING (label, i) JOIN l USING (label) GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM k)"
)


def emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


@query("em1_l2_normalize", f"WITH {UNIT} SELECT vec_id, round(v[1], 6) AS first, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS sq FROM u")
def em1(spark, sf_dir):
    u = vectors.l2_normalize(emb(spark, sf_dir))
    return u.select("vec_id", F.round(F.get("embedding", F.lit(0)), 6).alias("first"), F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("sq"))


@query(
    "em1_norm_report",
    "WITH n AS (SELECT sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) AS n FROM embeddings) SELECT round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, bool_and(abs(n - 1) <= 1e-3) AS unit_norm FROM n",
)
def em1_report(spark, sf_dir):
    return vectors.norm_report(emb(spark, sf_dir)).select(F.round("min_norm", 6).alias("min_norm"), F.round("max_norm", 6).alias("max_norm"), "unit_norm")


@query("em2_apply_screen", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def em2(spark, sf_dir):
    verdicts = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("groundable"))
    return vectors.apply_screen(table(spark, sf_dir, "documents"), verdicts, "doc_id", "groundable").select("doc_id", "lang")


@query("em3_project")
def em3(spark, sf_dir):
    return vectors.project(emb(spark, sf_dir)).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected"))


EPS, SAMPLES, LEAST = 0.75, 5, 5


@query(
    "em4_density_cluster",
    f"WITH RECURSIVE {UNIT}, p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE 1 - list_dot_product(a.v, b.v) <= {EPS}), "
    f"core AS (SELECT a AS k FROM p GROUP BY a HAVING count(*) >= {SAMPLES}), l AS (SELECT a, b FROM p WHERE a IN (FROM core) AND b IN (FROM core)), "
    "reach AS (SELECT k, k AS m FROM core UNION SELECT l.b AS k, m FROM reach JOIN l ON l.a = reach.k AND m < l.b), c AS (SELECT k, min(m) AS least FROM reach GROUP BY k), "
    f"s AS (SELECT least, row_number() OVER (ORDER BY least) - 1 AS cluster FROM c GROUP BY least HAVING count(*) >= {LEAST}) "
    "SELECT vec_id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM embeddings LEFT JOIN c ON k = vec_id LEFT JOIN s USING (least)",
)
def em4(spark, sf_dir):
    return vectors.density_cluster(emb(spark, sf_dir), "vec_id", "embedding", EPS, SAMPLES, LEAST)


@query("em4_neighbours", f"WITH {UNIT}, p AS (SELECT a.vec_id AS key, b.vec_id AS other, round(1 - list_dot_product(a.v, b.v), 6) AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id) "
       "SELECT key, min(distance) AS nearest FROM p GROUP BY key")
def em4_near(spark, sf_dir):
    near = vectors.neighbours(emb(spark, sf_dir), "vec_id", "embedding", 5)
    return near.where("rank = 1").select("key", F.round("distance", 6).alias("nearest"))


@query(
    "em5_cluster_summary",
    "WITH s AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(count(*) FILTER (label >= 0) AS BIGINT) AS clusters, "
    "round(coalesce(sum(n) FILTER (label < 0), 0) / sum(n), 6) AS noise_fraction, array_to_string(list_reverse_sort(list(n) FILTER (label >= 0)), ',') AS sizes FROM s",
)
def em5(spark, sf_dir):
    return vectors.cluster_summary(emb(spark, sf_dir), "label").select("clusters", F.round("noise_fraction", 6).alias("noise_fraction"), F.array_join("sizes", ",").alias("sizes"))


@query("em6_sweep")
def em6(spark, sf_dir):
    rows = vectors.sweep(emb(spark, sf_dir), "vec_id", "embedding", [(0.7, 4, 5), (0.8, 4, 5)])
    best = vectors.recommend(rows, 1, 1.0, 1).select("eps", F.lit(True).alias("recommended"))
    return rows.join(best, "eps", "left").select("eps", "min_samples", "min_size", "clusters", "noise_fraction", "score", F.coalesce("recommended", F.lit(False)).alias("recommended"))


@query(
    "em7_assign_topics",
    "SELECT doc_id, CASE WHEN label >= 2 THEN label ELSE -1 END AS cluster_id, CASE WHEN label >= 2 THEN 'topic ' || label END AS topic FROM documents LEFT JOIN (SELECT vec_id AS doc_id, label FROM embeddings) e USING (doc_id)",
)
def em7(spark, sf_dir):
    labels = emb(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") >= 2, F.col("label")).otherwise(-1).alias("cluster_id"))
    clusters = emb(spark, sf_dir).select(F.col("label").alias("cluster_id"), F.concat(F.lit("topic "), F.col("label").cast("string")).alias("label")).distinct()
    topics = vectors.assign_topics(table(spark, sf_dir, "documents").select("doc_id"), labels, clusters, "doc_id")
    return topics.select("doc_id", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"), "topic")


@query("em8_centroid_rank", f"WITH {RANKED} SELECT vec_id, label, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM r")
def em8(spark, sf_dir):
    return vectors.centroid_rank(emb(spark, sf_dir), "vec_id", "embedding", "label").select("vec_id", "label", F.round("cosine", 6).alias("cosine"), "rank")


@query(
    "em9_seed_batches",
    f"WITH {RANKED}, n AS (SELECT label, count(*) AS n FROM r GROUP BY 1), s AS (SELECT label, n, b AS batch, p AS position FROM n, range(0, 7) t(b), range(0, 10) u(p) WHERE p < n) "
    "SELECT s.label, CAST(batch AS INTEGER) AS batch, CAST(position AS INTEGER) AS position, vec_id FROM s JOIN r ON r.label = s.label AND r.rank = (batch * 10 + position) % n + 1",
)
def em9(spark, sf_dir):
    return vectors.seed_batches(vectors.centroid_rank(emb(spark, sf_dir), "vec_id", "embedding", "label"), "label", "vec_id", 7)


@query(
    "em10_seed_payload",
    "SELECT conv_id, coalesce(array_to_string(list_transform(list_filter(list({'turn': turn, 'role': role, 'body': text} ORDER BY turn), lambda c: c.role = 'assistant')[1:3], lambda c: substr(c.body, 1, 100)), '|'), '') AS replies FROM conversations GROUP BY conv_id",
)
def em10(spark, sf_dir):
    one = F.struct("turn", F.col("role").alias("author"), F.when(F.col("role") == "system", "Bot").otherwise("User").alias("author_type"), F.col("text").alias("body"))
    sessions = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("comments")).withColumn("author", F.lit("user"))
    return vectors.seed_payload(sessions, chars=100).select("conv_id", F.array_join("replies", "|").alias("replies"))


@query("em11_usable_topics", "SELECT label AS cluster_id FROM embeddings GROUP BY label HAVING count(*) > 45 AND label % 2 = 0")
def em11(spark, sf_dir):
    clusters = emb(spark, sf_dir).groupBy(F.col("label").alias("cluster_id")).agg((F.count(F.lit(1)) > 45).alias("coherent")).withColumn("corpus_groundable", F.col("cluster_id") % 2 == 0)
    return vectors.usable_topics(clusters).select("cluster_id")


@query(
    "em12_nearest_cosine",
    f"WITH {UNIT} SELECT a.vec_id, round(max(list_dot_product(a.v, b.v)), 6) AS nearest, max(list_dot_product(a.v, b.v)) >= 0.95 AS flagged FROM u a, u b WHERE b.label = 0 GROUP BY 1",
)
def em12(spark, sf_dir):
    near = vectors.nearest_cosine(emb(spark, sf_dir), emb(spark, sf_dir).where("label = 0"), "vec_id", "embedding")
    return near.select("vec_id", F.round("nearest", 6).alias("nearest"), "flagged")

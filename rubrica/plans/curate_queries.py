"""Bundle curation, code search and fold-back.

``documents`` is the corpus (a file for each), ``lineitem`` gives claims and the spans that they cite, ``orders`` gives
candidates and entries.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import codesearch, curate, foldback
from ..operators.lineage import cut
from .proxies import R, claims
from .registry import ORACLES, query, table

FILES = "f AS (SELECT source || '/d' || doc_id || '.py' AS path, text FROM documents)"
LINES = "l AS (SELECT path, unnest(t) AS text, generate_subscripts(t, 1) AS line_no FROM (SELECT path, string_split(text, chr(10)) AS t FROM f))"
NLINES = "nl AS (SELECT path, max(line_no) AS n_lines FROM l GROUP BY path)"
#: Spans from line items: path, start_line, end_line; some have no file or end behind it.
SPANS = (
    "sp AS (SELECT l_orderkey AS qid, 's' || l_linenumber AS span_id, 'src' || min(l_partkey) % 20 || '/d' || min(l_partkey) % 1000 || '.py' AS path, "
    "CAST(min(l_suppkey) % 8 + 1 AS INTEGER) AS start_line, CAST(min(l_suppkey) % 8 + 1 + min(l_partkey) % 5 AS INTEGER) AS end_line FROM lineitem GROUP BY 1, 2)"
)
ENTRIES = (
    "en AS (SELECT o_orderkey AS id, o_custkey % 50 AS topic, CASE o_orderpriority WHEN '1-URGENT' THEN 'basics' WHEN '2-HIGH' THEN 'Pitfalls' ELSE o_orderpriority END AS section, 'Entry ' || o_orderkey AS text, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 'x = ' || o_orderkey ELSE '' END AS code, CAST(o_totalprice AS BIGINT) % 100 AS weight_hint, CASE WHEN o_orderkey % 2 = 0 THEN 'reusable' ELSE 'specific' END AS generality, o_orderkey AS position, "
    "CASE WHEN o_orderstatus = 'F' THEN 'note' ELSE 'store' END AS delivery, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'k' || o_custkey END AS lookup_key FROM orders)"
)
BLOCK = "'- ' || trim(text) || CASE WHEN trim(code) <> '' THEN chr(10) || '```python' || chr(10) || trim(code) || chr(10) || '```' ELSE '' END"


def corpus(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "text")


def lines(spark, sf_dir):
    rows = corpus(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1).alias("line_no"), "text")


def n_lines(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("path").agg(F.max("line_no").alias("n_lines"))


def spans(spark, sf_dir):
    part, supp = F.min("l_partkey"), F.min("l_suppkey")
    start = (supp % 8 + 1).cast("int")
    path = F.concat(F.lit("src"), (part % 20).cast("string"), F.lit("/d"), (part % 1000).cast("string"), F.lit(".py"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("qid"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("span_id")).agg(path.alias("path"), start.alias("start_line"), (start + (part % 5).cast("int")).alias("end_line"))


def entries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    section = F.when(F.col("o_orderpriority") == "1-URGENT", "basics").when(F.col("o_orderpriority") == "2-HIGH", "Pitfalls").otherwise(F.col("o_orderpriority"))
    i = F.col("o_orderkey")
    return o.select(
        i.alias("id"), (F.col("o_custkey") % 50).alias("topic"), section.alias("section"), F.concat(F.lit("Entry "), i.cast("string")).alias("text"), F.when(i % 3 == 0, F.concat(F.lit("x = "), i.cast("string"))).otherwise("").alias("code"),
        (F.bround("o_totalprice").cast("bigint") % 100).alias("weight_hint"), F.when(i % 2 == 0, "reusable").otherwise("specific").alias("generality"), i.alias("position"),
        F.when(F.col("o_orderstatus") == "F", "note").otherwise("store").alias("delivery"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("k"), F.col("o_custkey").cast("string"))).alias("lookup_key"),
    )


def plan(spark):
    return spark.sql("SELECT * FROM VALUES (0, 'Basics'), (1, 'Pitfalls') AS t(position, name)")


HOMED = "h AS (SELECT * REPLACE (CASE WHEN lower(section) = 'pitfalls' THEN 'Pitfalls' ELSE 'Basics' END AS section) FROM en)"

# curation


@query(
    "cu1_question_violations",
    "SELECT doc_id, 'short' AS rule FROM documents WHERE length(text) < 400 UNION ALL SELECT doc_id, 'paragraphs' AS rule FROM documents WHERE len(list_filter(string_split(replace(text, '.' || chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda p: trim(p) <> '')) < 2",
)
def cu1(spark, sf_dir):
    q = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw"), F.regexp_replace("text", r"\.\n", "\n\n").alias("question"))
    short = curate.question_violations(q, "doc_id", "raw", 400, 0)
    return short.unionByName(curate.question_violations(q, "doc_id", "question", 0, 2))


@query(
    "cu2_answer_violations",
    "WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k FROM orders) SELECT o_orderkey, 'fences' AS rule FROM o WHERE k = 1 UNION ALL SELECT o_orderkey, 'outside' AS rule FROM o WHERE k IN (1, 2) UNION ALL SELECT o_orderkey, 'syntax' AS rule FROM o WHERE k = 3",
)
def cu2(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    good = F.concat(F.lit("```python\nx = "), F.col("o_orderkey").cast("string"), F.lit("\n```"))
    answer = F.when(k == 0, good).when(k == 1, F.lit("no program")).when(k == 2, F.concat(F.lit("see "), good)).otherwise(F.lit("```python\nx = (\n```"))
    return curate.answer_violations(table(spark, sf_dir, "orders").select("o_orderkey", answer.alias("answer")), "o_orderkey", "answer")


ROOTS = [f"src{i}" for i in range(15)]
_EV = "sp.path NOT IN (SELECT path FROM f)"
_ROOT = "split_part(path, '/', 1) NOT IN (" + ", ".join(f"'{r}'" for r in ROOTS) + ")"


@query("cu3_evidence_violations", f"WITH {FILES}, {SPANS} SELECT qid, span_id, 'absent' AS rule FROM sp WHERE {_EV} UNION ALL SELECT qid, span_id, 'root' AS rule FROM sp WHERE {_ROOT}")
def cu3(spark, sf_dir):
    return curate.evidence_violations(spans(spark, sf_dir), corpus(spark, sf_dir), ["qid", "span_id"], "path", ROOTS)


@query("cu4_validate", f"WITH {FILES}, {SPANS} SELECT o_orderkey AS qid FROM orders WHERE o_orderkey NOT IN (SELECT qid FROM sp WHERE {_EV} OR {_ROOT}) AND o_totalprice >= 100000")
def cu4(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("qid"), "o_totalprice")
    cheap = curate.broken(o, ["qid"], {"cheap": F.col("o_totalprice") < 100000})
    good, _ = curate.validate(o, "qid", [cheap, curate.evidence_violations(spans(spark, sf_dir), corpus(spark, sf_dir), ["qid"], "path", ROOTS)])
    return good.select("qid")


@query(
    "cu5_selection_report",
    "WITH c AS (SELECT o_custkey % 100 AS topic, o_orderkey FROM orders) SELECT topic, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey % 3 = 0)), ',') AS kept, array_to_string(list_sort(list(o_orderkey) FILTER (o_orderkey % 3 <> 0)), ',') AS rejected, CAST(count(*) FILTER (o_orderkey % 9 = 0) AS INTEGER) AS repeated, 1 AS out_of_range FROM c GROUP BY topic",
)
def cu5(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("topic"), "o_orderkey")
    picked = c.where("o_orderkey % 3 = 0").unionByName(c.where("o_orderkey % 9 = 0")).unionByName(c.select("topic", F.lit(-1).cast("bigint").alias("o_orderkey")).distinct())
    out = curate.selection_report(c, picked, "topic", "o_orderkey")
    return out.select("topic", F.array_join("kept", ",").alias("kept"), F.array_join("rejected", ",").alias("rejected"), "repeated", "out_of_range")


@query("cu6_take_quota", "WITH c AS (SELECT o_orderkey, o_custkey % 100 AS topic, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey % 100) AS n FROM orders) SELECT o_orderkey, topic FROM c WHERE k <= round_even(n * 5.0 / 12, 0)")
def cu6(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("topic"), "o_totalprice")
    return curate.take_quota(c, "topic", [F.desc("o_totalprice"), "o_orderkey"]).select("o_orderkey", "topic")


@query("cu7_tag_scope", f"WITH {SPANS} SELECT qid, bool_and(split_part(path, '/', 1) IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8') AND path IN (SELECT source || '/d' || doc_id || '.py' FROM documents)) AS in_scope FROM sp GROUP BY qid")
def cu7(spark, sf_dir):
    scope = corpus(spark, sf_dir).where(F.split_part("path", F.lit("/"), F.lit(1)).isin([f"src{i}" for i in range(1, 9)]))
    return curate.tag_scope(spans(spark, sf_dir), scope, "qid", "path")


CITES = "c AS (SELECT r.*, CASE WHEN claim_id = 'c1' THEN ['s1', 's9'] ELSE ['s' || substr(claim_id, 2)] END AS cites FROM r)"


@query(
    "cu8_rubric_violations",
    f"WITH {R}, {FILES}, {LINES}, {NLINES}, {SPANS}, w AS (SELECT qid, sum(weight) AS w, coalesce(sum(weight) FILTER (claim_type = 'core'), 0) AS core, bool_or(claim_id = 'c1') AS bad FROM r GROUP BY qid), "
    "s AS (SELECT qid, bool_or(nl.path IS NULL) AS p, bool_or(end_line > coalesce(n_lines, end_line)) AS g, bool_or(end_line - start_line + 1 > 4) AS l FROM sp LEFT JOIN nl USING (path) GROUP BY qid) "
    "SELECT qid, 'weights' AS rule FROM w WHERE w <> 100 UNION ALL SELECT qid, 'core' AS rule FROM w WHERE core <= 50 UNION ALL SELECT qid, 'undefined' AS rule FROM w WHERE bad UNION ALL SELECT qid, 'path' AS rule FROM s WHERE p UNION ALL SELECT qid, 'range' AS rule FROM s WHERE g UNION ALL SELECT qid, 'long' AS rule FROM s WHERE l",
)
def cu8(spark, sf_dir):
    cited = F.when(F.col("claim_id") == "c1", F.array(F.lit("s1"), F.lit("s9"))).otherwise(F.array(F.concat(F.lit("s"), F.substr("claim_id", F.lit(2)))))
    return curate.rubric_violations(claims(spark, sf_dir).withColumn("span_ids", cited), spans(spark, sf_dir), n_lines(spark, sf_dir), "qid", 4)


@query(
    "cu9_bundle_violations",
    f"WITH {R}, {FILES}, {LINES}, {NLINES}, {SPANS}, w AS (SELECT qid, sum(weight) AS w, coalesce(sum(weight) FILTER (claim_type = 'core'), 0) AS core FROM r GROUP BY qid), "
    "s AS (SELECT qid, bool_or(nl.path IS NULL) AS p, bool_or(end_line > coalesce(n_lines, end_line)) AS g, bool_or(" + _ROOT + ") AS o FROM sp LEFT JOIN nl USING (path) GROUP BY qid) "
    "SELECT CAST(qid AS VARCHAR) AS id, 'weights' AS rule FROM w WHERE w <> 100 UNION ALL SELECT CAST(qid AS VARCHAR) AS id, 'core' AS rule FROM w WHERE core <= 50 UNION ALL SELECT CAST(qid AS VARCHAR) AS id, 'path' AS rule FROM s WHERE p UNION ALL SELECT CAST(qid AS VARCHAR) AS id, 'range' AS rule FROM s WHERE g UNION ALL SELECT CAST(qid AS VARCHAR) AS id, 'root' AS rule FROM s WHERE o UNION ALL SELECT '*' AS id, 'rows' AS rule",
)
def cu9(spark, sf_dir):
    c = claims(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.struct("claim_id", "claim_type", "weight", F.array(F.concat(F.lit("s"), F.substr("claim_id", F.lit(2)))).alias("span_ids"))).alias("rubric"))
    s = spans(spark, sf_dir).groupBy("qid").agg(F.collect_list(F.struct("span_id", "path", "start_line", "end_line")).alias("evidence"))
    bundles = c.join(s, "qid").withColumn("id", F.col("qid").cast("string"))
    return curate.bundle_violations(bundles, n_lines(spark, sf_dir), ROOTS, 1)


@query(
    "cu10_normalize_ids",
    "WITH d AS (SELECT DISTINCT l_orderkey AS qid, l_linenumber AS k FROM lineitem), o AS (SELECT qid, k, row_number() OVER (PARTITION BY qid ORDER BY k) AS c, CASE WHEN k % 2 = 1 THEN row_number() OVER (PARTITION BY qid, k % 2 ORDER BY k) END AS s FROM d) "
    "SELECT qid, string_agg('c' || c || coalesce(':s' || s, ':'), ',' ORDER BY k) AS claims, CAST(count(s) AS INTEGER) AS spans FROM o GROUP BY qid",
)
def cu10(spark, sf_dir):
    k = F.col("l_linenumber")
    name = lambda p: F.concat(F.lit(p), k.cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("qid"), k).distinct().groupBy("qid")
    claim = F.struct(k, F.struct(name("x").alias("claim_id"), F.when(k % 2 == 1, F.array(name("y"))).otherwise(F.array(F.lit("none"))).alias("span_ids")).alias("v"))
    span = F.struct(k, F.struct(name("y").alias("span_id"), F.lit("p").alias("path")).alias("v"))
    pick = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda x: x.v)
    b = curate.normalize_ids(rows.agg(pick(claim).alias("rubric"), pick(span).alias("evidence")))
    line = F.transform("rubric", lambda c: F.concat(c.claim_id, F.lit(":"), F.array_join(c.span_ids, "+")))
    return b.select("qid", F.array_join(line, ",").alias("claims"), F.size("evidence").alias("spans"))


@query("cu11_evidence_paths", f"WITH {SPANS}, k AS (SELECT qid, path, min(span_id) AS first FROM sp GROUP BY 1, 2) SELECT qid, string_agg(path, ',' ORDER BY first) AS paths FROM k GROUP BY qid")
def cu11(spark, sf_dir):
    e = spans(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("span_id", "path"))).alias("e"))
    return e.select("qid", F.array_join(curate.evidence_paths(F.col("e")), ",").alias("paths"))


CUT = f"WITH {FILES}, {LINES}, {SPANS}, x AS (SELECT sp.qid, sp.span_id, string_agg(printf('%04d: ', line_no) || text, chr(10) ORDER BY line_no) AS t FROM sp LEFT JOIN l ON l.path = sp.path AND line_no BETWEEN start_line AND end_line GROUP BY 1, 2)"


@query("cu12_excerpts", f"{CUT} SELECT qid, span_id, md5(t) AS excerpt_md5 FROM x")
def cu12(spark, sf_dir):
    return curate.excerpts(spans(spark, sf_dir), lines(spark, sf_dir), ["qid", "span_id"]).select("qid", "span_id", F.md5("recomputed").alias("excerpt_md5"))


@query("cu13_excerpt_mismatch", f"{CUT} SELECT qid, span_id FROM x WHERE qid % 10 = 0 OR t IS NULL")
def cu13(spark, sf_dir):
    s = spans(spark, sf_dir)
    l = curate.cited_lines(s, lines(spark, sf_dir))
    excerpt = F.when(F.col("qid") % 10 == 0, "changed").otherwise(F.coalesce("recomputed", F.lit("gone")))
    stored = curate.with_excerpts(s, l).withColumn("excerpt", excerpt).drop("recomputed")
    return curate.excerpt_mismatch(stored, l, ["qid", "span_id"])


@query(
    "cu14_accept_rounds",
    f"WITH {R}, a AS (SELECT qid % 3000 AS b, qid // 3000 AS round, count(*) FILTER (score = 0) AS low, bool_or(qid % 7 = 0) AS rules, bool_or(qid % 5 = 0) AS regrade FROM r GROUP BY 1, 2), f AS (SELECT b, round, CASE WHEN rules THEN 1 ELSE low + CAST(regrade AS INTEGER) END AS n FROM a), "
    "p AS (SELECT b, min(round) FILTER (n = 0) AS passed, max(round) AS rounds, CAST(arg_max(n, round) AS INTEGER) AS failures, string_agg(round || ':' || n, ' ' ORDER BY round) AS history FROM f GROUP BY b) "
    "SELECT b, coalesce(passed, -1) AS passed_round, rounds, CASE WHEN passed IS NOT NULL THEN 'accepted' WHEN rounds >= 3 THEN 'dropped' ELSE 'open' END AS status, failures, history FROM p",
)
def cu14(spark, sf_dir):
    q = F.col("qid")
    claim = F.struct("claim_id", F.col("score").cast("string").alias("score"), F.lit("why").alias("rationale"))
    attempts = claims(spark, sf_dir).groupBy((q % 3000).alias("b"), F.floor(q / 3000).alias("round")).agg(
        F.collect_list(claim).alias("claims"), F.bool_or(q % 5 == 0).alias("needs_regrade"), F.when(F.bool_or(q % 7 == 0), F.array(F.lit("rule"))).alias("failures")
    )
    out = curate.accept_rounds(attempts, "b")
    history = F.array_join(F.transform("history", lambda h: F.concat_ws(":", h["round"].cast("string"), F.size(h.failures).cast("string"))), " ")
    return out.select("b", F.coalesce("passed_round", F.lit(-1)).alias("passed_round"), "rounds", "status", F.size("failures").alias("failures"), history.alias("history"))


@query(
    "cu15_final_report",
    "WITH d AS (SELECT source, n_chars, doc_id % 3 = 0 AS scope, CASE doc_id % 5 WHEN 0 THEN 'dropped' WHEN 1 THEN 'revised' ELSE 'accepted' END AS status, length(text) AS n FROM documents) SELECT source, CAST(count(*) AS BIGINT) AS bundles, CAST(count(*) FILTER (status <> 'dropped') AS BIGINT) AS kept, CAST(count(*) FILTER (status = 'revised') AS BIGINT) AS revised, CAST(count(*) FILTER (status = 'dropped') AS BIGINT) AS dropped, "
    "CAST(count(*) FILTER (status <> 'dropped' AND n_chars > 1000) AS BIGINT) AS hard, median(n) FILTER (status <> 'dropped') AS median_chars, CAST(count(*) FILTER (status <> 'dropped' AND scope) AS BIGINT) AS in_scope FROM d GROUP BY source",
)
def cu15(spark, sf_dir):
    i = F.col("doc_id") % 5
    d = table(spark, sf_dir, "documents").withColumns({"status": F.when(i == 0, "dropped").when(i == 1, "revised").otherwise("accepted"), "difficulty": F.when(F.col("n_chars") > 1000, "hard").otherwise("easy"), "scope": F.col("doc_id") % 3 == 0})
    return curate.final_report(d, "source", "difficulty", "text", "status", "scope")


@query(
    "cu16_stratified_split",
    "WITH t AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)), d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('5|' || doc_id), doc_id) AS p FROM documents) "
    "SELECT doc_id, CASE WHEN p <= 130 // n + CASE WHEN k < 130 % n THEN 1 ELSE 0 END THEN 'dev' ELSE 'study' END AS split FROM d JOIN t USING (source)",
)
def cu16(spark, sf_dir):
    return curate.stratified_split(table(spark, sf_dir, "documents"), "doc_id", "source", 130, 5).select("doc_id", "split")


# code search

PATTERNS = "(VALUES (1, 'the [a-z]+ing', 'src1'), (2, '^Of', 'src'), (3, 'x', 'lib/'), (4, 'Lic[ae]', 'src2')) AS t(pattern_id, pattern, prefix)"


@query(
    "cs1_grep",
    f"WITH {FILES}, {LINES}, p AS (SELECT * FROM {PATTERNS}), h AS (SELECT pattern_id, path, line_no, text, row_number() OVER (PARTITION BY pattern_id ORDER BY path, line_no) AS rank, count(*) OVER (PARTITION BY pattern_id) AS n FROM l JOIN p ON starts_with(path, prefix) AND regexp_matches(text, pattern)) "
    "SELECT pattern_id, CAST(rank AS INTEGER) AS rank, path || ':' || line_no || ':' || substr(text, 1, 500) AS hit, n > 20 AS truncated FROM h WHERE rank <= 20 UNION ALL SELECT pattern_id, 0, NULL, false FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE starts_with(f.path, p.prefix))",
)
def cs1(spark, sf_dir):
    return codesearch.grep(lines(spark, sf_dir), spark.sql(f"SELECT * FROM {PATTERNS.replace('(VALUES', 'VALUES').replace(') AS t', ' AS t')}"), 20)


@query("cs1_grep_indexed", ORACLES["cs1_grep"])
def cs1_indexed(spark, sf_dir):
    """The same requests through an index of trigrams, which a user would store."""
    own = lines(spark, sf_dir)
    asked = spark.sql(f"SELECT * FROM {PATTERNS.replace('(VALUES', 'VALUES').replace(') AS t', ' AS t')}")
    return codesearch.grep(own, asked, 20, index=cut(codesearch.trigram_index(own)))


GLOBS = {"src1/*.py": "^src1/[^/]*\\.py$", "d1?.py": "d1.\\.py$", "src[2-3]/d*5.py": "^src[2-3]/d[^/]*5\\.py$", "**/d77.py": "^([^/]+/)*d77\\.py$"}


@query(
    "cs2_glob",
    f"WITH {FILES}, g AS (" + " UNION ALL ".join(f"SELECT '{g}' AS pattern, path FROM f WHERE regexp_matches({'split_part(path, chr(47), 2)' if '/' not in g else 'path'}, '{('^' + r) if '/' not in g else r}')" for g, r in GLOBS.items()) + "), k AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY path) AS rank, count(*) OVER (PARTITION BY pattern) AS n FROM g) "
    "SELECT pattern, CAST(rank AS INTEGER) AS rank, path, CAST(greatest(n - 10, 0) AS BIGINT) AS more FROM k WHERE rank <= 10",
)
def cs2(spark, sf_dir):
    return codesearch.glob(corpus(spark, sf_dir), list(GLOBS), 10)


@query(
    "cs3_read_range",
    f"WITH {FILES}, {LINES}, {NLINES}, q AS (SELECT doc_id AS request_id, source || '/d' || doc_id || '.py' AS path, doc_id % 6 AS a, doc_id % 6 + 3 AS b FROM documents UNION ALL SELECT -1, 'none.py', 1, 2), "
    "e AS (SELECT q.*, n_lines AS n, least(b, n_lines) AS last FROM q LEFT JOIN nl USING (path)) SELECT request_id, CASE WHEN n IS NULL THEN 'error: no such file' WHEN a < 1 OR a > n THEN 'error: bad range, the file has ' || n || ' lines' "
    "ELSE 'lines ' || a || '–' || last || ' of ' || n || chr(10) || (SELECT string_agg(substr(l.text, 1, 500), chr(10) ORDER BY line_no) FROM l WHERE l.path = e.path AND line_no BETWEEN a AND last) END AS answer FROM e",
)
def cs3(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i.alias("request_id"), F.concat("source", F.lit("/d"), i.cast("string"), F.lit(".py")).alias("path"), (i % 6).cast("int").alias("start_line"), (i % 6 + 3).cast("int").alias("end_line"))
    asked = d.unionByName(spark.sql("SELECT -1L AS request_id, 'none.py' AS path, 1 AS start_line, 2 AS end_line"))
    return codesearch.read_range(lines(spark, sf_dir), asked)


@query(
    "cs4_corpus_fingerprint",
    f"WITH {FILES}, h AS (SELECT sha256(path || chr(10) || sha256(text)) AS h FROM f) SELECT CAST(count(*) AS BIGINT) AS files, sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint FROM h",
)
def cs4(spark, sf_dir):
    return codesearch.corpus_fingerprint(corpus(spark, sf_dir))


@query(
    "cs5_lookup",
    f"WITH {FILES}, a AS (SELECT unnest(['src1/d1.py', 'D99', 'nothing', 'src3']) AS asked), n AS (SELECT asked, path, row_number() OVER (PARTITION BY asked ORDER BY path) AS k FROM a JOIN f ON contains(lower(path), lower(asked)) WHERE asked NOT IN (SELECT path FROM f)) "
    "SELECT asked, asked IN (SELECT path FROM f) AS exact, CASE WHEN asked IN (SELECT path FROM f) THEN asked ELSE coalesce((SELECT string_agg(path, ',' ORDER BY path) FROM n WHERE n.asked = a.asked AND k <= 5), '') END AS keys FROM a",
)
def cs5(spark, sf_dir):
    asked = spark.sql("SELECT explode(array('src1/d1.py', 'D99', 'nothing', 'src3')) AS asked")
    return codesearch.lookup(corpus(spark, sf_dir).select(F.col("path").alias("key")), asked).withColumn("keys", F.array_join("keys", ","))


@query("cs6_corpus_surface", "SELECT DISTINCT source AS folder, 'd' || doc_id AS module FROM documents")
def cs6(spark, sf_dir):
    return codesearch.corpus_surface(corpus(spark, sf_dir))


# fold-back

FLIPS = "fl AS (SELECT *, CASE WHEN score = 0 AND score2 = 1 THEN 'FLIP+' WHEN score = 1 AND score2 = 0 THEN 'FLIP-' WHEN score + score2 = 0 THEN 'BOTH0' ELSE 'BOTH1' END AS bucket FROM r)"
LESSONS = "ls AS (SELECT qid, claim_id, 'lesson ' || qid AS lesson FROM r WHERE qid % 3 = 0)"


def flips(spark, sf_dir, with_spans: bool = False):
    c = claims(spark, sf_dir)
    low = c.select("qid", "claim_id", "weight", "score", F.lit("low").alias("rationale"))
    high = c.select("qid", "claim_id", F.col("score2").alias("score"), F.lit("high").alias("rationale"))
    own = spans(spark, sf_dir).select("qid", F.concat(F.lit("c"), F.substr("span_id", F.lit(2))).alias("claim_id"), "path") if with_spans else None
    return foldback.claim_flips(low, high, own)


def lessons(spark, sf_dir):
    return claims(spark, sf_dir).where("qid % 3 = 0").select("qid", "claim_id", F.concat(F.lit("lesson "), F.col("qid").cast("string")).alias("lesson"))


@query("fb1_claim_flips", f"WITH {R}, {FLIPS}, {SPANS} SELECT fl.qid, claim_id, weight, bucket, CASE WHEN score = 0 THEN 'low' END AS low_rationale, CASE WHEN score2 = 0 THEN 'high' END AS high_rationale, path AS paths FROM fl JOIN sp ON sp.qid = fl.qid AND sp.span_id = 's' || substr(claim_id, 2)")
def fb1(spark, sf_dir):
    return flips(spark, sf_dir, True).select("qid", "claim_id", "weight", "bucket", "low_rationale", "high_rationale", F.array_join("evidence_paths", ",").alias("paths"))


@query("fb2_bucket_weight", f"WITH {R}, {FLIPS} SELECT bucket, CAST(sum(weight) AS BIGINT) AS weight, round(sum(weight) / sum(sum(weight)) OVER (), 6) AS share FROM fl GROUP BY bucket")
def fb2(spark, sf_dir):
    return foldback.bucket_weight(flips(spark, sf_dir)).withColumn("share", F.round("share", 6))


@query("fb3_admit_lessons", f"WITH {R}, {FLIPS}, {LESSONS} SELECT qid, claim_id, 'admitted' AS status FROM ls JOIN fl USING (qid, claim_id) WHERE bucket IN ('FLIP+', 'BOTH0') UNION ALL SELECT qid, claim_id, 'open' AS status FROM fl WHERE bucket IN ('FLIP+', 'BOTH0') AND qid % 3 <> 0")
def fb3(spark, sf_dir):
    admitted, open_ = foldback.admit_lessons(lessons(spark, sf_dir), flips(spark, sf_dir))
    return admitted.select("qid", "claim_id", F.lit("admitted").alias("status")).unionByName(open_.select("qid", "claim_id", F.lit("open").alias("status")))


@query(
    "fb4_lesson_coverage",
    f"WITH {R}, {FLIPS}, {LESSONS} SELECT topic, bucket, CAST(coalesce(sum(weight) FILTER (lesson IS NOT NULL), 0) AS BIGINT) AS covered, CAST(coalesce(sum(weight) FILTER (lesson IS NULL), 0) AS BIGINT) AS uncovered, CAST(count(lesson) AS BIGINT) AS lessons, CAST(coalesce(sum(length(lesson)), 0) AS BIGINT) AS lesson_chars "
    "FROM (SELECT fl.*, qid % 7 AS topic, lesson FROM fl LEFT JOIN ls USING (qid, claim_id)) WHERE bucket IN ('FLIP+', 'BOTH0') GROUP BY 1, 2",
)
def fb4(spark, sf_dir):
    return foldback.lesson_coverage(flips(spark, sf_dir).withColumn("topic", F.col("qid") % 7), lessons(spark, sf_dir), "topic")


@query(
    "fb5_material",
    f"WITH {R}, {FLIPS}, {LESSONS}, m AS (SELECT qid, claim_id, 'lesson' AS kind, lesson AS text FROM ls UNION ALL SELECT qid, claim_id, 'fix', 'WRONG: w' || qid || ' CORRECTION: c' FROM r WHERE qid % 5 = 0 UNION ALL SELECT o_orderkey, NULL, 'map', 'm f.py s n' FROM orders WHERE o_orderkey % 11 = 0) "
    "SELECT m.qid, coalesce(m.claim_id, '') AS claim_id, kind, text, coalesce(weight, -1) AS weight, coalesce(bucket, '') AS bucket FROM m LEFT JOIN fl USING (qid, claim_id)",
)
def fb5(spark, sf_dir):
    fixes = claims(spark, sf_dir).where("qid % 5 = 0").select("qid", "claim_id", F.concat(F.lit("w"), F.col("qid").cast("string")).alias("wrong_belief"), F.lit("c").alias("correction"))
    places = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("qid"), F.lit("m").alias("mechanism"), F.lit("f.py").alias("file"), F.lit("s").alias("symbol"), F.lit("n").alias("note"))
    out = foldback.material(lessons(spark, sf_dir), fixes, places, flips(spark, sf_dir))
    return out.select("qid", F.coalesce("claim_id", F.lit("")).alias("claim_id"), "kind", "text", F.coalesce("weight", F.lit(-1)).alias("weight"), F.coalesce("bucket", F.lit("")).alias("bucket"))


def homed(spark, sf_dir):
    return foldback.rehome_sections(entries(spark, sf_dir), plan(spark))


@query("fb6_rehome_sections", f"WITH {ENTRIES}, {HOMED} SELECT section, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY section")
def fb6(spark, sf_dir):
    return homed(spark, sf_dir).groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def grounded(spark, sf_dir):
    return spans(spark, sf_dir).groupBy(F.col("qid").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("span_id", "path"))), lambda x: x.path).alias("grounding_paths"))


@query("fb7_prune_paths", f"WITH {FILES}, {SPANS} SELECT qid AS id, string_agg(path, ',' ORDER BY span_id) AS paths FROM sp WHERE path IN (SELECT path FROM f) GROUP BY qid")
def fb7(spark, sf_dir):
    return foldback.prune_paths(grounded(spark, sf_dir), corpus(spark, sf_dir)).select("id", F.array_join("grounding_paths", ",").alias("paths"))


@query(
    "fb8_verify_groups",
    f"WITH {SPANS}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY span_id) AS k FROM sp), g AS (SELECT qid, array_to_string(list_sort(list(DISTINCT split_part(path, '/', 1))), '|') AS g FROM k WHERE k <= 3 GROUP BY qid) SELECT g AS \"group\", CAST(count(*) AS INTEGER) AS n, min(qid) AS first FROM g GROUP BY g",
)
def fb8(spark, sf_dir):
    e = grounded(spark, sf_dir).withColumn("grounding_paths", F.transform("grounding_paths", lambda p: F.split_part(p, F.lit("/"), F.lit(1))))
    parts = foldback.verify_groups(e).groupBy("group").agg(F.sum(F.size("ids")).cast("int").alias("n"), F.min(F.array_min("ids")).alias("first"))
    return parts.select("group", "n", "first")


@query("fb9_apply_verdicts", f"WITH {ENTRIES}, v AS (SELECT id, CASE WHEN id % 7 = 0 THEN 'contradicted' WHEN id % 5 = 0 THEN 'unverified' ELSE 'verified' END AS v FROM en WHERE id % 9 <> 0) SELECT coalesce(v, 'unverified') AS verdict, coalesce(v = 'verified', false) AS kept, CAST(count(*) AS BIGINT) AS n FROM en LEFT JOIN v USING (id) GROUP BY 1, 2")
def fb9(spark, sf_dir):
    e = entries(spark, sf_dir)
    verdicts = e.where("id % 9 <> 0").select("id", F.when(F.col("id") % 7 == 0, "contradicted").when(F.col("id") % 5 == 0, "unverified").otherwise("verified").alias("verdict"))
    return foldback.apply_verdicts(e, verdicts).groupBy("verdict", "kept").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fb10_route_entries",
    f"WITH {ENTRIES}, k AS (SELECT id, delivery, CASE WHEN lookup_key <> '' THEN lookup_key ELSE CAST(id AS VARCHAR) END AS key FROM en), n AS (SELECT *, row_number() OVER (PARTITION BY delivery, key ORDER BY id) AS n FROM k) "
    "SELECT id, delivery AS target, CASE WHEN delivery = 'store' THEN CASE WHEN n > 1 THEN key || '__' || id ELSE key END ELSE '' END AS store_key FROM n",
)
def fb10(spark, sf_dir):
    return foldback.route_entries(entries(spark, sf_dir), "hybrid").select("id", "target", F.coalesce("store_key", F.lit("")).alias("store_key"))


TRIM = (
    f"WITH {ENTRIES}, {HOMED}, z AS (SELECT *, length({BLOCK}) + 2 AS b, row_number() OVER (PARTITION BY topic, section ORDER BY generality <> 'reusable', weight_hint DESC, position) AS k FROM h), "
    "y AS (SELECT *, sum(b + CASE WHEN k = 1 THEN length(section) + 5 ELSE 0 END) OVER (PARTITION BY topic ORDER BY generality <> 'reusable', weight_hint DESC, position ROWS UNBOUNDED PRECEDING) AS total FROM z)"
)


@query("fb11_trim_to_ceiling", f"{TRIM} SELECT topic, id FROM y WHERE total <= 2000")
def fb11(spark, sf_dir):
    return foldback.trim_to_ceiling(homed(spark, sf_dir), "topic", 2000).select("topic", "id")


@query(
    "fb12_render_note",
    f"{TRIM}, s AS (SELECT topic, section, string_agg({BLOCK}, chr(10) || chr(10) ORDER BY position) AS body FROM y WHERE total <= 2000 GROUP BY 1, 2), "
    "p AS (SELECT topic, string_agg('## ' || section || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY section) AS body FROM s GROUP BY topic), "
    "i AS (SELECT topic, '## Keys' || chr(10) || string_agg('- `k' || id || '`', chr(10) ORDER BY position) AS keys FROM h WHERE id % 10 = 0 GROUP BY topic) "
    "SELECT topic, md5('# Notes' || chr(10) || chr(10) || '## Answer protocol' || chr(10) || 'Look first.' || chr(10) || chr(10) || concat_ws(chr(10) || chr(10), body, keys) || chr(10)) AS note_md5 FROM p FULL JOIN i USING (topic)",
)
def fb12(spark, sf_dir):
    entries_ = homed(spark, sf_dir)
    kept = foldback.trim_to_ceiling(entries_, "topic", 2000)
    store = entries_.where("id % 10 = 0").select("topic", "position", F.concat(F.lit("k"), F.col("id").cast("string")).alias("store_key"))
    return foldback.render_note(kept, plan(spark), "topic", "Notes", "Look first.", store).select("topic", F.md5("rendered").alias("note_md5"))


@query(
    "fb13_object_entries",
    f"WITH {ENTRIES}, pl AS (SELECT o_orderkey AS id, o_custkey % 60 AS topic FROM orders WHERE o_orderkey % 11 = 0), t AS (SELECT topic, row_number() OVER (ORDER BY topic) - 1 AS t FROM (SELECT topic FROM en UNION SELECT topic FROM pl)) "
    "SELECT id, 't' || t || 'i' || (row_number() OVER (PARTITION BY topic ORDER BY position) - 1) AS object_id, 'content_item' AS type FROM en JOIN t USING (topic) "
    "UNION ALL SELECT id, 't' || t || 'm' || (row_number() OVER (PARTITION BY topic ORDER BY id) - 1), 'map_entry' FROM pl JOIN t USING (topic) "
    "UNION ALL SELECT n_nationkey, 'p' || (row_number() OVER (ORDER BY n_nationkey) - 1), 'protocol_item' FROM nation",
)
def fb13(spark, sf_dir):
    protocol = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_nationkey").cast("bigint").alias("position"), F.col("n_name").alias("text"))
    places = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("position"), (F.col("o_custkey") % 60).alias("topic"), F.lit("f.py").alias("file"))
    return foldback.object_entries(protocol, entries(spark, sf_dir), places).select("id", "object_id", "type")


@query(
    "fb14_excerpt_votes",
    f"WITH {FILES}, {SPANS}, n AS (SELECT path, start_line * 9 AS s, least(end_line * 25, start_line * 9 + 39) AS e FROM sp WHERE path IN (SELECT path FROM f)), v AS (SELECT path, s // 20 AS g, count(*) AS votes, arg_max({{'s': s, 'e': e}}, (e - s) * 1000 - s) AS r FROM n GROUP BY 1, 2), "
    'k AS (SELECT *, row_number() OVER (ORDER BY votes DESC, path, g) AS rank FROM v) SELECT CAST(rank AS INTEGER) AS rank, path, r.s AS start_line, r.e AS end_line, CAST(votes AS BIGINT) AS votes FROM k WHERE rank <= 25',
)
def fb14(spark, sf_dir):
    noms = spans(spark, sf_dir).select("path", (F.col("start_line") * 9).alias("start_line"), (F.col("end_line") * 25).alias("end_line"))
    return foldback.excerpt_votes(noms, corpus(spark, sf_dir))


@query(
    "fb15_prior_cards",
    "WITH d AS (SELECT doc_id, text, row_number() OVER (PARTITION BY lower(substr(text, 1, 80)) ORDER BY doc_id) AS n FROM documents), k AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS rank FROM d WHERE n = 1) SELECT CAST(rank AS INTEGER) AS rank, md5('- You will believe: b' || doc_id || ' — WRONG. Truth: ' || text || ' (see `f`)') AS card_md5 FROM k WHERE rank <= 40",
)
def fb15(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("you_will_believe"), F.col("text").alias("truth"), F.lit("f").alias("file"))
    return foldback.prior_cards(d, "doc_id").select("rank", F.md5("card").alias("card_md5"))


@query("fb16_variants", f"WITH {ENTRIES}, v AS (SELECT *, unnest(CASE WHEN regexp_matches(section, 'Pit|URG|LOW') THEN ['full', 'marked'] ELSE ['full'] END) AS variant FROM en) SELECT variant, CAST(count(*) AS BIGINT) AS entries, CAST(sum(length({BLOCK})) AS BIGINT) AS chars FROM v GROUP BY variant")
def fb16(spark, sf_dir):
    return foldback.variants(entries(spark, sf_dir), "Pit|URG|LOW")


@query("fb17_findings", "SELECT day(ts) % 6 AS round, event_id AS qid, CASE event_type WHEN 'click' THEN '' ELSE event_type || ': said ' || event_type END AS mistakes, CASE WHEN event_type <> 'click' THEN 'gold ' || event_id ELSE '' END AS gold FROM events")
def fb17(spark, sf_dir):
    from .trace_queries import quizzes

    q = quizzes(spark, sf_dir)
    gold = q.select("qid", F.concat(F.lit("gold "), F.col("qid").cast("string")).alias("gold_program"))
    return foldback.findings(gold, q).select("round", "qid", F.array_join("mistakes", ",").alias("mistakes"), F.coalesce("gold", F.lit("")).alias("gold"))


@query("fb18_claims_summary", f"WITH {R} SELECT qid, string_agg(claim_id || ' (w' || weight || '): ' || score || ' why', chr(10) ORDER BY claim_id) AS summary FROM r GROUP BY qid")
def fb18(spark, sf_dir):
    c = claims(spark, sf_dir)
    return foldback.claims_summary(c.select("qid", "claim_id", "score", F.lit("why").alias("rationale")), c, ["qid"], "qid")


@query("fb19_note_matched_gain", f"WITH {R}, {FLIPS} SELECT qid % 13 < 3 AS matched, CAST(count(*) AS BIGINT) AS claims, CAST(sum(CASE bucket WHEN 'FLIP+' THEN weight WHEN 'FLIP-' THEN -weight ELSE 0 END) AS BIGINT) AS gain FROM fl GROUP BY 1")
def fb19(spark, sf_dir):
    named = flips(spark, sf_dir).withColumn("statement", F.concat(F.lit("uses `api"), (F.col("qid") % 13).cast("string"), F.lit("` and `x`")))
    tokens = spark.range(3).select(F.concat(F.lit("api"), F.col("id").cast("string")).alias("token"))
    return foldback.note_matched_gain(named, tokens, "statement")

"""Text scalars and filters on ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import text as ops
from .registry import dealt, query, table

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
CLEAN = (
    r"trim(regexp_replace(array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace({0}, "
    r"'(?s)<!--.*?-->', ' ', 'g'), '(?s)```.*?(```|\z)', ' [code] ', 'g'), '<[^>\n]{{1,80}}>', ' ', 'g'), '\r?\n'), "
    r"lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^[#>|]')), chr(10)), '[ \t]+', ' ', 'g'))"
)
NORM = r"trim(regexp_replace(lower(coalesce({}, '')), '\s+', ' ', 'g'))"
FIRST = (
    r"coalesce(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce({0}, ''), '\r?\n'), "
    r"lambda x: regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[*_`]+|[*_`]+$', '', 'g'), '^[\[\]() .]+', '')), "
    r"lambda x: x <> '' AND NOT (lower(regexp_extract(x, '^[A-Za-z'']+')) IN ('hi','hello','hey','greetings','thanks','thank','dear') AND length(x) <= 60)), "
    r"lambda x: lower(regexp_extract(x, '^[A-Za-z'']+')))[1], '')"
)
LEAD = ", ".join(f"'{w}'" for w in text.LEAD_WORDS)
#: Distinct word 3-grams of each document: doc_id, s.
SHINGLES = (
    "w AS (SELECT doc_id, string_split(" + NORM.format("text") + ", ' ') AS w FROM documents), "
    "s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN w = [''] THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] "
    "ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w))"
)


@query("tx1_clean_markdown", f"SELECT page_id, md5({CLEAN.format('html')}) AS cleaned_md5, CAST(length({CLEAN.format('html')}) AS BIGINT) AS chars FROM pages")
def tx1(spark, sf_dir):
    cleaned = table(spark, sf_dir, "pages").select("page_id", text.clean_markdown(F.col("html")).alias("t"))
    return cleaned.select("page_id", F.md5("t").alias("cleaned_md5"), F.char_length("t").cast("bigint").alias("chars"))


@query("tx2_first_word", f"SELECT doc_id, {FIRST.format('text')} AS first_word FROM documents")
def tx2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_word(F.col("text")).alias("first_word"))


@query(
    "tx3_question_form",
    f"SELECT conv_id, turn, {FIRST.format('text')} IN ({LEAD}) OR {FIRST.format(CLEAN.format('text'))} IN ({LEAD}) AS question FROM conversations",
)
def tx3(spark, sf_dir):
    form = text.is_question_form(F.col("text"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", form.alias("question"))


@query("tx4_normalize_text", f"SELECT doc_id, md5({NORM.format('text')}) AS norm_md5 FROM documents")
def tx4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("norm_md5"))


@query("tx5_length_between", "SELECT lang, CAST(count(*) AS BIGINT) AS n FROM documents WHERE length(text) BETWEEN 30 AND 20000 GROUP BY lang")
def tx5(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.length_between(F.col("text"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


_VOTES = ", ".join(
    f"len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in own)}))) AS {lang}" for lang, own in text.STOP_WORDS.items()
)
_PICK = "CASE WHEN greatest(en, de, fr, es) = 0 THEN 'unknown' " + " ".join(f"WHEN {x} = greatest(en, de, fr, es) THEN '{x}'" for x in text.STOP_WORDS) + " END"


@query(
    "tx6_detect_language",
    r"WITH v AS (SELECT doc_id, lang, " + _VOTES + r" FROM (SELECT doc_id, lang, regexp_split_to_array(" + NORM.format("substr(text, 1, 1500)") + r", '[^\p{L}]+') AS w FROM documents)) "
    f"SELECT lang, {_PICK} AS detected, CAST(count(*) AS BIGINT) AS n FROM v GROUP BY 1, 2",
)
def tx6(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("lang", text.detect_language(F.col("text")).alias("detected"))
    return found.groupBy("lang", "detected").agg(F.count(F.lit(1)).alias("n"))


@query(
    "tx7_filter_epoch",
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1998-06-30 00:00:00'",
)
def tx7(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return ops.filter_epoch(orders, "1998-06-30 00:00:00", "o_orderstatus", "o_orderdate", "F").select("o_orderkey", "o_custkey")


@query(
    "tx8_filter_funnel",
    "WITH r AS (SELECT CASE WHEN NOT coalesce(length(coalesce(text, '')) BETWEEN 100 AND 10000, false) THEN 'length' "
    "WHEN lang IS DISTINCT FROM 'en' THEN 'not_english' WHEN source = 'src1' THEN 'source' END AS reason FROM documents), "
    "s AS (SELECT * FROM (VALUES (0, 'length'), (1, 'not_english'), (2, 'source')) t(stage, reason)), "
    "n AS (SELECT s.stage, s.reason, (SELECT count(*) FROM r WHERE r.reason = s.reason) AS dropped FROM s) "
    "SELECT CAST(stage AS INTEGER) AS stage, reason, CAST(dropped AS BIGINT) AS dropped, "
    "CAST((SELECT count(*) FROM documents) - sum(dropped) OVER (ORDER BY stage) AS BIGINT) AS survivors FROM n",
)
def tx8(spark, sf_dir):
    rules = {"length": text.length_between(F.col("text"), 100, 10_000), "not_english": F.col("lang") == "en", "source": F.coalesce(F.col("source"), F.lit("")) != "src1"}
    return ops.funnel_report(table(spark, sf_dir, "documents"), rules)


@query("tx9_shingles", f"WITH {SHINGLES} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_shingles, min(s) AS first_shingle FROM s GROUP BY doc_id")
def tx9(spark, sf_dir):
    sets = dealt(table(spark, sf_dir, "documents")).select("doc_id", text.shingles(F.col("text")).alias("s")).where(F.size("s") > 0)
    return sets.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.array_min("s").alias("first_shingle"))


@query("tx10_clip", "SELECT conv_id, turn, substr(text, 1, 200) AS clipped FROM conversations")
def tx10(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clip(F.col("text"), 200).alias("clipped"))


#: Programs made from conversations: each turn inside a fence, with prose around it.
FENCED = "'Text. ' || chr(10) || '```python' || chr(10) || 'x = ' || turn || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'y = (' || chr(10) || role || chr(10) || '```'"


@query(
    "tx11_fenced_blocks",
    f"WITH f AS (SELECT conv_id, turn, {FENCED} AS t FROM conversations), "
    r"b AS (SELECT *, regexp_extract_all(t, '(?s)```[^\n]*\n(.*?)```', 1) AS bodies FROM f) "
    "SELECT conv_id, turn, CAST(len(bodies) AS BIGINT) AS blocks, list_max(list_transform(bodies, lambda x: length(x))) AS longest_chars, "
    r"md5(regexp_replace(regexp_replace(t, '(?s)```[^\n]*\n.*?```', '', 'g'), '^\s+|\s+$', '', 'g')) AS outside_md5 FROM b",
)
def tx11(spark, sf_dir):
    f = table(spark, sf_dir, "conversations").withColumn("t", F.expr(FENCED.replace("chr(10)", "'\\n'"))).withColumn("b", text.fenced_blocks(F.col("t")))
    return f.select("conv_id", "turn", F.col("b.blocks").cast("bigint").alias("blocks"), F.char_length("b.longest").cast("bigint").alias("longest_chars"), F.md5("b.outside").alias("outside_md5"))


@query("tx12_syntax_ok", "SELECT conv_id, turn, length(text) % 2 = 0 AS ok FROM conversations")
def tx12(spark, sf_dir):
    """Programs with the turn's text as comments; a text of odd length leaves a bracket open."""
    size = F.char_length("text")
    program = F.concat(F.lit("# "), F.regexp_replace("text", r"[\r\n\x00]", "\n# "), F.lit("\nx = ("), size.cast("string"), F.when(size % 2 == 0, ")").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.syntax_ok(program).alias("ok"))


@query(
    "tx13_content_ids",
    "SELECT doc_id, 'doc_' || substr(sha256(text), 1, 12) AS content_id, ('0x' || substr(sha256(lang || '|' || doc_id), 1, 8))::BIGINT & 2147483647 AS seed, "
    "sha256('{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}') AS fingerprint, "
    "CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substr(sha256(text), CAST(i * 8 + 1 AS BIGINT), 8))::BIGINT)), lambda r, x: (r * (4294967296 % 7) + x) % 7) AS BIGINT) AS shard FROM documents",
)
def tx13(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", ids.content_id(F.col("text"), "doc_").alias("content_id"), ids.stable_seed(F.col("lang"), F.col("doc_id")).alias("seed"),
        ids.row_fingerprint(doc_id=F.col("doc_id"), lang=F.col("lang")).alias("fingerprint"), ids.shard_of(F.col("text"), 7).alias("shard"),
    )


@query(
    "tx14_parse_sections",
    "SELECT conv_id, 's1' AS section_id, 'Overview' AS title, md5('before') AS content_md5 FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL "
    "SELECT conv_id, 's' || (1 + row_number() OVER (PARTITION BY conv_id ORDER BY turn)) AS section_id, 'Turn ' || turn AS title, "
    r"md5(regexp_replace(replace(text, '#', ''), '^\s+|\s+$', '', 'g')) AS content_md5 FROM conversations",
)
def tx14(spark, sf_dir):
    part = F.concat(F.lit("## Turn "), F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", "#", ""))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("p")))).alias("t"))
    notes = turns.select("conv_id", F.concat(F.lit("# Note\nbefore\n"), F.array_join(F.col("t.p"), "\n")).alias("note"))
    return ops.parse_sections(notes, "note", "conv_id").select("conv_id", "section_id", "title", F.md5("content").alias("content_md5"))


@query(
    "tx15_number_lines",
    "SELECT conv_id, turn, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: printf('%04d: ', i) || x), chr(10))) AS numbered_md5 FROM conversations",
)
def tx15(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.number_lines(F.col("text"))).alias("numbered_md5"))


@query("tx16_note_delivery", "SELECT item_id, sha256('Study note.' || chr(10) || chr(10) || text) AS delivered_sha256, true AS verified FROM benchmark")
def tx16(spark, sf_dir):
    note = F.lit("Study note.")
    sent = ops.with_note(table(spark, sf_dir, "benchmark"), note, "text")
    bad = ops.verify_delivery(sent, note, "text").select("item_id", F.lit(False).alias("bad"))
    return sent.join(bad, "item_id", "left").select("item_id", "delivered_sha256", F.coalesce("bad", F.lit(True)).alias("verified"))

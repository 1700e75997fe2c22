"""Curation of question bundles: rules, rubrics, spans, excerpts, splits.

Child tables: claims (key, claim_id, claim_type, weight, span_ids), spans (key, span_id, path, start_line, end_line, excerpt),
files (path, n_lines), lines (path, line_no, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fenced_blocks, numbered_line, syntax_ok
from .grading import broken
from .lineage import cut, ranked

MAX_SPAN = 300


def question_violations(df: DataFrame, key: str, question: str, least_chars: int = 400, least_paragraphs: int = 2) -> DataFrame:
    q = F.coalesce(F.col(question), F.lit(""))
    paragraphs = F.size(F.filter(F.split(q, r"\n\n"), lambda p: F.trim(p) != ""))
    return broken(df, [key], {"short": F.char_length(q) < least_chars, "paragraphs": paragraphs < least_paragraphs})


def answer_violations(df: DataFrame, key: str, answer: str) -> DataFrame:
    parts = df.withColumn("__f", fenced_blocks(F.col(answer)))
    parts = parts.withColumn("__ok", syntax_ok(F.col("__f.longest")))
    return broken(parts, [key], {"fences": F.col("__f.blocks") != 1, "outside": F.col("__f.outside") != "", "syntax": ~F.col("__ok")})


def evidence_violations(evidence: DataFrame, files: DataFrame, keys: list[str], path: str, roots: list[str], suffix: str = ".py") -> DataFrame:
    """keys, rule for evidence paths of another suffix, outside the roots, or absent from the corpus."""
    known = evidence.join(files.select(F.col("path").alias(path), F.lit(True).alias("__there")).distinct(), path, "left")
    under = F.lit(False)
    for r in roots:
        under = under | F.startswith(F.col(path), F.lit(r.rstrip("/") + "/"))
    return broken(known, keys, {"suffix": ~F.endswith(F.col(path), F.lit(suffix)), "root": ~under, "absent": F.col("__there").isNull()})


def validate(df: DataFrame, key: str, violations: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows without a violation, all violations as key and rule)."""
    table = violations[0].select(key, "rule")
    for v in violations[1:]:
        table = table.unionByName(v.select(key, "rule"))
    return df.join(table.select(key).distinct(), key, "left_anti"), table


def selection_report(candidates: DataFrame, selected: DataFrame, group: str, index: str) -> DataFrame:
    """group, kept, rejected (sorted indices), repeated and out_of_range (counts of bad selections)."""
    all_ = candidates.groupBy(group).agg(F.collect_set(index).alias("all"))
    picked = selected.groupBy(group).agg(F.collect_list(index).alias("picked"))
    both = all_.join(picked, group, "left").withColumn("picked", F.coalesce("picked", F.array().cast("array<bigint>")))
    kept = F.array_intersect("all", "picked")
    return both.select(
        group, F.sort_array(kept).alias("kept"), F.sort_array(F.array_except("all", "picked")).alias("rejected"),
        (F.size("picked") - F.size(F.array_distinct("picked"))).alias("repeated"), F.size(F.array_except("picked", "all")).alias("out_of_range"),
    )


def take_quota(df: DataFrame, topic: str, order: list[Column | str], ratio: float = 5 / 12) -> DataFrame:
    """The first rows of each topic, up to its size times ``ratio``, halves rounded to even; ranked by ranges, no topic in one task."""
    placed = ranked(df, topic, [F.col(c) if isinstance(c, str) else c for c in order], "__n", "__total")
    return placed.where(F.col("__n") <= F.bround(F.col("__total") * F.lit(ratio))).drop("__n", "__total")


def tag_scope(evidence: DataFrame, scope: DataFrame, key: str, path: str) -> DataFrame:
    """key, in_scope: whether all evidence paths of a row are among ``scope`` (path)."""
    marked = evidence.join(scope.select(F.col("path").alias(path), F.lit(True).alias("__in")).distinct(), path, "left")
    return marked.groupBy(key).agg(F.every(F.coalesce("__in", F.lit(False))).alias("in_scope"))


def rubric_violations(claims: DataFrame, spans: DataFrame, files: DataFrame, key: str, most_lines: int = MAX_SPAN) -> DataFrame:
    """key, rule: repeated ids, weights that aren't 100, core weight of 50 or less, undefined spans, unknown paths, bad ranges."""
    core = F.sum(F.when(F.col("claim_type") == "core", F.col("weight")).otherwise(0))
    per = claims.groupBy(key).agg(F.count("claim_id").alias("n"), F.count_distinct("claim_id").alias("ids"), F.sum("weight").alias("w"), core.alias("core"), F.array_distinct(F.flatten(F.collect_list("span_ids"))).alias("cited"))
    cut = spans.join(files.select("path", "n_lines", F.lit(True).alias("there")), "path", "left")
    bad_path = F.bool_or(F.col("there").isNull())
    bad_range = F.bool_or((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.coalesce("n_lines", "end_line")))
    long = F.bool_or(F.col("end_line") - F.col("start_line") + 1 > most_lines)
    per_span = cut.groupBy(key).agg(F.count("span_id").alias("sn"), F.count_distinct("span_id").alias("sids"), F.collect_set("span_id").alias("defined"), bad_path.alias("bad_path"), bad_range.alias("bad_range"), long.alias("long"))
    both = per.join(per_span, key, "left")
    rules = {
        "claim_ids": F.col("n") > F.col("ids"), "weights": F.col("w") != 100, "core": F.col("core") <= 50, "span_ids": F.col("sn") > F.col("sids"),
        "undefined": F.size(F.array_except("cited", F.coalesce("defined", F.array().cast("array<string>")))) > 0, "path": F.col("bad_path"), "range": F.col("bad_range"), "long": F.col("long"),
    }
    return broken(both, [key], rules)


def bundle_violations(bundles: DataFrame, files: DataFrame, roots: list[str], rows: int | None = None) -> DataFrame:
    """id, rule over nested bundles: the rubric's rules, claim types, roots, repeated ids and, under the id ``*``, the row count."""
    claims = bundles.select("id", F.explode("rubric").alias("c")).select("id", "c.*")
    spans = bundles.select("id", F.explode("evidence").alias("s")).select("id", "s.*")
    out = rubric_violations(claims, spans, files, "id")
    out = out.unionByName(broken(claims, ["id"], {"claim_type": ~F.coalesce(F.col("claim_type").isin("core", "supporting"), F.lit(False))}).distinct())
    out = out.unionByName(bundles.groupBy("id").count().where("count > 1").select("id", F.lit("id").alias("rule")))
    out = out.unionByName(evidence_violations(spans, files, ["id"], "path", roots).where("rule = 'root'").distinct())
    if rows is not None:
        out = out.unionByName(bundles.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != rows).select(F.lit("*").cast(bundles.schema["id"].dataType).alias("id"), F.lit("rows").alias("rule")))
    return out


def normalize_ids(df: DataFrame, rubric: str = "rubric", evidence: str = "evidence") -> DataFrame:
    """``df`` without uncited spans, with claims c1… and spans s1… numbered in order and claims' span ids rewritten."""
    cited = F.flatten(F.transform(rubric, lambda c: c.span_ids))
    kept = df.withColumn("__kept", F.filter(evidence, lambda s: F.array_contains(cited, s.span_id)))
    names = kept.withColumn("__map", F.map_from_arrays(F.transform("__kept", lambda s: s.span_id), F.transform("__kept", lambda s, i: F.concat(F.lit("s"), (i + 1).cast("string")))))
    spans = F.transform("__kept", lambda s, i: s.withField("span_id", F.concat(F.lit("s"), (i + 1).cast("string"))))
    claims = F.transform(rubric, lambda c, i: c.withField("claim_id", F.concat(F.lit("c"), (i + 1).cast("string"))).withField("span_ids", F.filter(F.transform(c.span_ids, lambda x: F.try_element_at("__map", x)), lambda x: x.isNotNull())))
    return names.withColumns({rubric: claims, evidence: spans}).drop("__kept", "__map")


def evidence_paths(evidence: Column) -> Column:
    """Distinct paths in the order of first sight."""
    return F.array_distinct(F.transform(evidence, lambda s: s.path))


#: Lines of a corpus that spans cite and that are broadcast to find them in it, as counted.
FEW_CITED = 200_000


RANGE = ["path", "start_line", "end_line"]


def cited_lines(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """The lines of a corpus that any of ``spans`` cites, kept; the corpus isn't shuffled where those are few."""
    ranges = spans.where("start_line <= end_line").select(*RANGE).distinct()
    cited = cut(ranges.select("path", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct())
    few = cited.count() <= FEW_CITED
    return cut(lines.join(F.broadcast(cited) if few else cited, ["path", "line_no"], "left_semi"))


def with_excerpts(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """``spans`` with ``recomputed``: the numbered lines of each; null where the path or range isn't in the corpus.

    Spans may cite the same lines many times, so each distinct (path, range) is cut once; its line numbers, at most a few
    hundred, are exploded, so that the join is on (path, line) and not on a range. Spans then meet their excerpts by path and
    range; no text is shuffled for a span.
    """
    ranges = spans.where("start_line <= end_line").select(*RANGE).distinct()
    rows = ranges.select(*RANGE, F.explode(F.sequence("start_line", "end_line")).alias("line_no")).join(lines, ["path", "line_no"])
    numbered = numbered_line(F.col("line_no"), F.col("text"))
    texts = rows.groupBy(*RANGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", numbered.alias("t")))), lambda x: x.t), "\n").alias("recomputed"))
    return spans.join(texts, RANGE, "left")


def excerpts(spans: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, recomputed: the numbered lines of each span; spans whose path or range isn't in the corpus have null."""
    return with_excerpts(spans.select(*keys, *RANGE).distinct(), lines).select(*keys, "recomputed")


def excerpt_mismatch(spans: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys of spans whose stored excerpt differs from the recomputed one, as their SHA-256 hashes tell."""
    stored = spans.select(*keys, *RANGE, F.sha2("excerpt", 256).alias("stored"))
    return with_excerpts(stored, lines).where(~F.col("stored").eqNullSafe(F.sha2("recomputed", 256))).select(*keys)


def accept_rounds(attempts: DataFrame, key: str, most: int = 3) -> DataFrame:
    """key, passed_round, rounds, status, failures (of the last round), history of each bundle's attempts.

    ``attempts``: key, round (from 0), claims (array of claim_id, score, rationale), needs_regrade and, if rules have been
    checked before, failures (array). A round passes when it has no failure: no broken rule, no regrade, every score 1.
    Without a pass, a bundle is dropped after ``most`` revisions and open before that. ``history`` lists round and failures
    in order.
    """
    low = F.filter("claims", lambda c: ~F.coalesce(c.score.cast("string").try_cast("double") >= 1, F.lit(False)))
    told = F.transform(low, lambda c: F.concat_ws(" ", F.concat_ws(": ", c.claim_id, F.coalesce(c.score.cast("string"), F.lit("none"))), c.rationale))
    before = F.coalesce("failures", F.array().cast("array<string>")) if "failures" in attempts.columns else F.array().cast("array<string>")
    regrade = F.when(F.coalesce("needs_regrade", F.lit(False)), F.array(F.lit("regrade"))).otherwise(F.array().cast("array<string>"))
    judged = attempts.select(key, "round", F.when(F.size(before) > 0, before).otherwise(F.concat(regrade, told)).alias("failures"))
    per = judged.groupBy(key).agg(F.min(F.when(F.size("failures") == 0, F.col("round"))).alias("passed_round"), F.max("round").alias("rounds"), F.sort_array(F.collect_list(F.struct("round", "failures"))).alias("history"))
    status = F.when(F.col("passed_round").isNotNull(), "accepted").when(F.col("rounds") >= most, "dropped").otherwise("open")
    return per.select(key, "passed_round", "rounds", status.alias("status"), F.element_at("history", -1).failures.alias("failures"), "history")


def final_report(df: DataFrame, topic: str, difficulty: str, question: str, status: str, scope: str | None = None) -> DataFrame:
    """Per topic: bundles, kept, revised, dropped, hard ones, median question length of kept ones and, with the column
    ``scope`` (from ``tag_scope``), in_scope: the size of the derived set of kept bundles inside it."""
    kept = F.col(status) != "dropped"
    more = [F.count_if(kept & F.coalesce(F.col(scope), F.lit(False))).alias("in_scope")] if scope else []
    return df.groupBy(topic).agg(
        F.count(F.lit(1)).alias("bundles"), F.count_if(kept).alias("kept"), F.count_if(F.col(status) == "revised").alias("revised"), F.count_if(~kept).alias("dropped"),
        F.count_if(kept & (F.col(difficulty) == "hard")).alias("hard"), F.percentile(F.when(kept, F.char_length(question)), F.lit(0.5)).alias("median_chars"), *more,
    )


def derived_scope(df: DataFrame, status: str, scope: str) -> DataFrame:
    """The kept bundles whose evidence lies inside the scope."""
    return df.where((F.col(status) != "dropped") & F.coalesce(F.col(scope), F.lit(False)))


def stratified_split(df: DataFrame, key: str, topic: str, total: int, seed: int) -> DataFrame:
    """``df`` with split: dev or study. Each topic gives total // topics rows to dev, the first total % topics (sorted) one more.

    Rows are chosen by the order of sha2(seed|key), ranked by ranges, so that no topic lies in one task.
    """
    topics = df.select(topic).distinct().withColumn("__t", F.row_number().over(Window.orderBy(topic)) - 1)  # a row a topic
    topics = topics.join(topics.agg(F.count(F.lit(1)).alias("__n")), how="cross")
    share = F.floor(F.lit(total) / F.col("__n")) + (F.col("__t") < F.lit(total) % F.col("__n")).cast("int")
    order = [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256), F.col(key)]
    marked = ranked(df, topic, order, "__p").join(topics, topic)
    return marked.withColumn("split", F.when(F.col("__p") <= share, "dev").otherwise("study")).drop("__t", "__n", "__p")

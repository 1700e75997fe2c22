"""From graded claims to verified notes: flips, lessons, entries, verdicts, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import ranked

NOTE_CEILING = 150_000
MOST_EXCERPT_LINES, MOST_EXCERPTS, MOST_CARDS = 40, 25, 40


def bucket(low: Column, high: Column) -> Column:
    return F.when((low == 0) & (high == 1), "FLIP+").when((low == 1) & (high == 0), "FLIP-").when(low + high == 0, "BOTH0").otherwise("BOTH1")


def claim_flips(low: DataFrame, high: DataFrame, spans: DataFrame | None = None, keys: tuple = ("qid", "claim_id")) -> DataFrame:
    """keys, weight, bucket, the rationale of each missed side, and evidence_paths of the claim's spans, sorted."""
    right = high.select(*keys, F.col("score").alias("high"), F.col("rationale").alias("high_rationale"))
    both = low.select(*keys, "weight", F.col("score").alias("low"), F.col("rationale").alias("low_rationale")).join(right, list(keys))
    out = both.withColumn("bucket", bucket(F.col("low"), F.col("high")))
    out = out.withColumns({s: F.when(F.col(side) == 0, F.col(s)) for s, side in (("low_rationale", "low"), ("high_rationale", "high"))})
    if spans is not None:
        paths = spans.groupBy(*keys).agg(F.array_sort(F.collect_set("path")).alias("evidence_paths"))
        out = out.join(paths, list(keys), "left").withColumn("evidence_paths", F.coalesce("evidence_paths", F.array().cast("array<string>")))
    return out


def bucket_weight(flips: DataFrame) -> DataFrame:
    sums = flips.groupBy("bucket").agg(F.sum("weight").alias("weight"))
    return sums.join(sums.agg(F.sum("weight").alias("total")), how="cross").select("bucket", "weight", (F.col("weight") / F.col("total")).alias("share"))


RECOVERABLE = ["FLIP+", "BOTH0"]


def admit_lessons(lessons: DataFrame, flips: DataFrame, keys: tuple = ("qid", "claim_id")) -> tuple[DataFrame, DataFrame]:
    """(lessons for recoverable claims, recoverable claims without a lesson)."""
    open_ = flips.where(F.col("bucket").isin(RECOVERABLE))
    return lessons.join(open_.select(*keys), list(keys), "left_semi"), open_.join(lessons.select(*keys), list(keys), "left_anti")


def lesson_coverage(flips: DataFrame, lessons: DataFrame, by: str, keys: tuple = ("qid", "claim_id")) -> DataFrame:
    """by, bucket, weight with and without a lesson, lessons, lesson_chars, over recoverable claims."""
    per = lessons.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("lesson")).alias("chars"))
    joined = flips.where(F.col("bucket").isin(RECOVERABLE)).join(per, list(keys), "left")
    has = F.col("n").isNotNull()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.groupBy(by, "bucket").agg(
        zero(F.sum(F.when(has, F.col("weight")))).alias("covered"), zero(F.sum(F.when(~has, F.col("weight")))).alias("uncovered"), zero(F.sum("n")).alias("lessons"), zero(F.sum("chars")).alias("lesson_chars")
    )


def material(lessons: DataFrame, fixes: DataFrame, places: DataFrame, flips: DataFrame, keys: tuple = ("qid", "claim_id")) -> DataFrame:
    """One table of lessons, fixes (wrong belief and correction) and map entries, with the claim's weight and bucket."""
    a = lessons.select(*keys, F.lit("lesson").alias("kind"), F.col("lesson").alias("text"))
    b = fixes.select(*keys, F.lit("fix").alias("kind"), F.concat(F.lit("WRONG: "), "wrong_belief", F.lit(" CORRECTION: "), "correction").alias("text"))
    c = places.select("qid", F.lit(None).cast("string").alias("claim_id"), F.lit("map").alias("kind"), F.concat_ws(" ", "mechanism", "file", "symbol", "note").alias("text"))
    return a.unionByName(b).unionByName(c).join(flips.select(*keys, "weight", "bucket"), list(keys), "left")


def rehome_sections(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """Entries with the plan's spelling of their section; unknown ones go to the plan's first. ``plan``: position, name."""
    names = plan.select(F.lower("name").alias("__key"), F.col("name").alias("__name"))
    first = plan.agg(F.min_by("name", "position").alias("__first"))
    homed = entries.withColumn("__key", F.lower(F.trim("section"))).join(names, "__key", "left").join(first, how="cross")
    return homed.withColumn("section", F.coalesce("__name", "__first")).drop("__key", "__name", "__first")


def prune_paths(entries: DataFrame, files: DataFrame, key: str = "id", paths: str = "grounding_paths") -> DataFrame:
    """Entries with only the paths that are in the corpus, in their order; entries left with none go."""
    exploded = entries.select(key, F.posexplode(paths).alias("__i", "path"))
    good = exploded.join(files.select("path").distinct(), "path", "left_semi").groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "path"))), lambda x: x.path).alias("__good"))
    return entries.join(good, key).withColumn(paths, F.col("__good")).drop("__good")


def verify_groups(entries: DataFrame, paths: str = "grounding_paths", key: str = "id", most: int = 1000) -> DataFrame:
    """group, part, ids: entries that share the set of their first three paths, in parts of ``most`` ids, in order.

    Entries without paths are the group of the empty set; ids are ranked by ranges, so no group lies in one task.
    """
    group = F.array_join(F.array_sort(F.array_distinct(F.slice(paths, 1, 3))), "|")
    placed = ranked(entries.select(group.alias("group"), key), "group", [F.col(key)], "place")
    part = F.floor((F.col("place") - 1) / most).cast("int").alias("part")
    return placed.groupBy("group", part).agg(F.sort_array(F.collect_list(key)).alias("ids"))


def apply_verdicts(entries: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Entries with verdict (absent: unverified) and kept (verified only)."""
    joined = entries.join(verdicts.select(key, "verdict"), key, "left")
    return joined.withColumn("verdict", F.coalesce("verdict", F.lit("unverified"))).withColumn("kept", F.col("verdict") == "verified")


def route_entries(entries: DataFrame, form: str) -> DataFrame:
    """Entries with target (note or store) and store_key. ``form``: prompt_note, lookup_tool or hybrid; a repeated key gets ``__id``."""
    target = {"prompt_note": F.lit("note"), "lookup_tool": F.lit("store"), "hybrid": F.col("delivery")}[form]
    key = F.coalesce(F.when(F.trim("lookup_key") != "", F.col("lookup_key")), F.col("id").cast("string"))
    keyed = entries.withColumns({"target": target, "store_key": key})
    n = F.row_number().over(Window.partitionBy("target", "store_key").orderBy("position", "id"))
    repeated = keyed.withColumn("__n", n)
    final = F.when(F.col("target") == "store", F.when(F.col("__n") > 1, F.concat("store_key", F.lit("__"), "id")).otherwise(F.col("store_key")))
    return repeated.withColumn("store_key", final).drop("__n")


def entry_block() -> Column:
    code = F.trim(F.coalesce("code", F.lit("")))
    return F.concat(F.lit("- "), F.trim("text"), F.when(code != "", F.concat(F.lit("\n```python\n"), code, F.lit("\n```"))).otherwise(""))


def trim_to_ceiling(entries: DataFrame, note: str, cap: int = NOTE_CEILING, overhead: int = 0) -> DataFrame:
    """Entries that stay when question-specific, then light ones go until the rendered note is within ``cap``.

    The size of a kept set is that of its blocks, a heading for each section in it and two characters after each part;
    adding entries from the last to go onward, a section's heading counts with its first one.
    """
    order = [F.col("generality") != "reusable", F.desc("weight_hint"), "position"]
    sized = entries.withColumn("__size", F.char_length(entry_block()) + 2)
    first = F.row_number().over(Window.partitionBy(note, "section").orderBy(*order)) == 1
    sized = sized.withColumn("__size", F.col("__size") + F.when(first, F.char_length("section") + 5).otherwise(0))
    total = F.sum("__size").over(Window.partitionBy(note).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return sized.withColumn("__sum", total).where(F.col("__sum") + overhead <= cap).drop("__size", "__sum")


def render_note(entries: DataFrame, plan: DataFrame, note: str, title: str, protocol: str = "", store: DataFrame | None = None, keys_title: str = "Keys") -> DataFrame:
    """note, rendered: a title, the answer protocol if there is one, sections in the plan's order with their entries in order,
    and, with ``store`` (note, position, store_key), an index of the keys that can be looked up. A note may be an index alone."""
    blocks = entries.withColumn("__b", entry_block()).groupBy(note, "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "__b"))), lambda x: x["__b"]), "\n\n").alias("body"))
    placed = blocks.join(plan.select(F.col("name").alias("section"), F.col("position").alias("p")), "section")
    parts = placed.select(note, "p", F.concat(F.lit("## "), "section", F.lit("\n\n"), "body").alias("s"))
    if store is not None:
        line = F.transform(F.sort_array(F.collect_list(F.struct("position", "store_key"))), lambda x: F.concat(F.lit("- `"), x.store_key.cast("string"), F.lit("`")))
        index = store.groupBy(note).agg(F.concat(F.lit(f"## {keys_title}\n"), F.array_join(line, "\n")).alias("s"))
        parts = parts.unionByName(index.select(note, F.lit(2147483647).alias("p"), "s"))
    notes = parts.groupBy(note).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "s"))), lambda x: x.s), "\n\n").alias("body"))
    head = f"# {title}\n\n" + (f"## Answer protocol\n{protocol.strip()}\n\n" if protocol.strip() else "")
    return notes.select(note, F.concat(F.lit(head), "body", F.lit("\n")).alias("rendered"))


def object_entries(protocol: DataFrame, items: DataFrame, places: DataFrame, topic: str = "topic", order: str = "position") -> DataFrame:
    """One list of entries with object_id and type: p{i} for the protocol's, t{topic}i{i} for items and t{topic}m{i} for places.

    Topics count in sorted order over items and places, entries by ``order`` in their list, all from 0. Fields that a kind of
    entry lacks are null. The protocol is one short list; topics are a row each.
    """
    topics = items.select(topic).union(places.select(topic)).distinct()
    topics = topics.withColumn("__t", F.row_number().over(Window.orderBy(topic)) - 1)  # a row a topic
    within = F.row_number().over(Window.partitionBy(topic).orderBy(order)) - 1
    ident = lambda letter: F.concat(F.lit("t"), F.col("__t").cast("string"), F.lit(letter), within.cast("string"))
    head = protocol.withColumns({"object_id": F.concat(F.lit("p"), (F.row_number().over(Window.orderBy(order)) - 1).cast("string")), "type": F.lit("protocol_item")})
    body = items.join(F.broadcast(topics), topic).withColumns({"object_id": ident("i"), "type": F.lit("content_item")})
    where = places.join(F.broadcast(topics), topic).withColumns({"object_id": ident("m"), "type": F.lit("map_entry")})
    return head.unionByName(body, allowMissingColumns=True).unionByName(where, allowMissingColumns=True).drop("__t")


def excerpt_votes(nominations: DataFrame, files: DataFrame, most_lines: int = MOST_EXCERPT_LINES, most: int = MOST_EXCERPTS, by: str | None = None) -> DataFrame:
    """path, start_line, end_line, votes: nominated ranges by regions of 20 lines; of each the longest, then the most voted."""
    keys = [by] if by else []
    known = nominations.join(files.select("path").distinct(), "path", "left_semi").withColumn("s", F.greatest("start_line", F.lit(1)))
    known = known.withColumn("e", F.least("end_line", F.col("s") + (most_lines - 1))).withColumn("region", F.floor(F.col("s") / 20))
    voted = known.groupBy(*keys, "path", "region").agg(F.count(F.lit(1)).alias("votes"), F.max_by(F.struct("s", "e"), F.struct(F.col("e") - F.col("s"), -F.col("s"))).alias("r"))
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), "path", "region") if keys else Window.orderBy(F.desc("votes"), "path", "region")
    if not keys:
        voted = voted.orderBy(F.desc("votes"), "path", "region").limit(most)
    ranked = voted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.select(*keys, "rank", "path", F.col("r.s").alias("start_line"), F.col("r.e").alias("end_line"), "votes")


def prior_cards(diffs: DataFrame, order: str, most: int = MOST_CARDS) -> DataFrame:
    """rank, card: the first of each truth (80 characters, lower case), in order, at most ``most``."""
    key = F.lower(F.substring("truth", 1, 80))
    firsts = diffs.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").orderBy(order).limit(most)
    card = F.concat(F.lit("- You will believe: "), "you_will_believe", F.lit(" — WRONG. Truth: "), "truth", F.lit(" (see `"), "file", F.lit("`)"))
    return firsts.select(F.row_number().over(Window.orderBy(order)).alias("rank"), card.alias("card"))


def variants(entries: DataFrame, markers: str) -> DataFrame:
    """variant, entries, chars: all verified entries, and those of sections that match ``markers``."""
    size = F.char_length(entry_block())
    both = entries.withColumn("variant", F.explode(F.array_compact(F.array(F.lit("full"), F.when(F.col("section").rlike(markers), F.lit("marked"))))))
    return both.groupBy("variant").agg(F.count(F.lit(1)).alias("entries"), F.sum(size).alias("chars"))


def findings(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """round, qid, mechanism, verdict, mistakes, gold (only where the verdict isn't correct)."""
    joined = verdicts.join(questions.select("qid", F.col("gold_program").alias("__gold")), "qid")
    mistakes = F.transform("studier_mistakes", lambda m: F.concat(m.mistake_class, F.lit(": "), m.mistake))
    return joined.select("round", "qid", "mechanism", "verdict", mistakes.alias("mistakes"), F.when(F.col("verdict") != "correct", F.col("__gold")).alias("gold"))


def claims_summary(grades: DataFrame, rubric: DataFrame, episode: list[str], question: str, chars: int = 200) -> DataFrame:
    """episode, summary: a line for each claim with id, weight, score and clipped rationale."""
    joined = grades.join(rubric.select(question, "claim_id", "weight"), [question, "claim_id"])
    line = F.format_string("%s (w%d): %d %s", "claim_id", "weight", "score", F.substring(F.coalesce("rationale", F.lit("")), 1, chars))
    return joined.groupBy(*episode).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_id", line.alias("l")))), lambda x: x.l), "\n").alias("summary"))


def note_matched_gain(flips: DataFrame, note_tokens: DataFrame, statement: str, token: str = r"`([^`]+)`", keys: tuple = ("qid", "claim_id")) -> DataFrame:
    """matched, claims, gain: the weight gained less that lost, by whether a claim names a token (in backticks) of the note.

    ``note_tokens`` (token) is the list of a note's tokens.
    """
    named = flips.select(*keys, F.explode(F.regexp_extract_all(statement, F.lit(token), F.lit(1))).alias("token"))
    hits = named.join(note_tokens.select("token").distinct(), "token", "left_semi").select(*keys).distinct().withColumn("matched", F.lit(True))
    gain = F.when(F.col("bucket") == "FLIP+", F.col("weight")).when(F.col("bucket") == "FLIP-", -F.col("weight")).otherwise(0)
    return flips.join(hits, list(keys), "left").groupBy(F.coalesce("matched", F.lit(False)).alias("matched")).agg(F.count(F.lit(1)).alias("claims"), F.sum(gain).alias("gain"))

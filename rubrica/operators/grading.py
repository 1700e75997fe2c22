"""Verdicts, scores and the integrity of graded populations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLAIMS = "array<struct<claim_id:string,score:int,rationale:string>>"
KEYED = "map<string,struct<score:int,rationale:string>>"


def broken(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule for each rule whose condition is true."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(rule)) for rule, cond in rules.items())))
    return df.select(*keys, F.explode(found).alias("rule"))


def parse_verdict(df: DataFrame, verdict: str, keys: list[str]) -> DataFrame:
    """keys, claim_id, score, rationale: a verdict's claims, written as an array or as an object keyed by claim id.

    JSON that doesn't parse, or has no claims, gives no rows; a score that isn't an integer is null.
    """
    listed = F.from_json(F.col(verdict), f"struct<claims:{CLAIMS}>").getField("claims")
    keyed = F.from_json(F.col(verdict), f"struct<claims:{KEYED}>").getField("claims")
    as_rows = F.transform(F.map_entries(keyed), lambda e: F.struct(e.key.alias("claim_id"), e.value.score.alias("score"), e.value.rationale.alias("rationale")))
    is_list = F.trim(F.get_json_object(F.col(verdict), "$.claims")).startswith("[")
    rows = F.when(is_list, listed).otherwise(as_rows)
    return df.select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*")


#: Fields of a verdict and the form of its claims, by contract: ``paper`` lists claims and states a total, ``keyed`` does neither.
CONTRACTS = {"paper": (["claims", "needs_regrade", "question_score"], "ARRAY", ["claim_id", "rationale", "score"]), "keyed": (["claims", "needs_regrade"], "OBJECT", ["rationale", "score"])}


def response_violations(df: DataFrame, keys: list[str], verdict: str, contract: str = "paper", finish: str | None = None, usage: str | None = None, max_tokens: int | None = None) -> DataFrame:
    """keys, rule for each rule that a judge's response breaks, whatever its claims say.

    json: it isn't an object; fields: other fields than the contract's; claims: the other contract's form; claim_fields: a
    claim with other fields; regrade: needs_regrade isn't false; total: the paper contract's question_score isn't a number.
    With the columns given: stop (``finish`` isn't ``stop``), content (blank), usage (counts that are absent, negative or
    don't add up), budget (``max_tokens`` reached). Use ``verdict_violations`` for the claims themselves.
    """
    fields, form, claim_fields = CONTRACTS[contract]
    text = F.trim(F.coalesce(F.col(verdict), F.lit("")))
    v = F.try_parse_json(text)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    names = lambda c: F.array_sort(F.json_object_keys(c))
    one_form = kind("$.claims").startswith(form)
    raw = F.get_json_object(text, "$.claims")
    each = F.from_json(raw, "array<map<string,string>>") if contract == "paper" else F.map_values(F.from_json(raw, "map<string,map<string,string>>"))
    whole = F.forall(each, lambda c: F.array_sort(F.map_keys(c)) == F.array(*map(F.lit, claim_fields)))
    rules = {
        "json": ~is_object,
        "fields": is_object & (names(text) != F.array(*map(F.lit, fields))),
        "claims": is_object & ~one_form,
        "claim_fields": is_object & one_form & ~F.coalesce(whole, F.lit(False)),
        "regrade": is_object & ~((kind("$.needs_regrade") == "BOOLEAN") & F.coalesce(~F.try_variant_get(v, "$.needs_regrade", "boolean"), F.lit(False))),
    }
    if contract == "paper":
        rules["total"] = is_object & ~kind("$.question_score").rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if finish:
        rules["stop"] = ~F.col(finish).eqNullSafe(F.lit("stop"))
        rules["content"] = text == ""
    if usage:
        part = lambda name: F.col(f"{usage}.{name}")
        sound = (part("prompt_tokens") >= 0) & (part("completion_tokens") >= 0) & (part("prompt_tokens") + part("completion_tokens") == part("total_tokens"))
        rules["usage"] = ~F.coalesce(sound, F.lit(False))
        if max_tokens is not None:
            rules["budget"] = part("completion_tokens") >= max_tokens
    return broken(df, keys, rules)


def verdict_violations(claims: DataFrame, rubric: DataFrame, key: str) -> DataFrame:
    """key, claim_id, rule: missing, unexpected and repeated claims, scores other than 0 and 1, rationales that are absent."""
    given = claims.groupBy(key, "claim_id").agg(F.count(F.lit(1)).alias("times"), F.min("score").alias("low"), F.max("score").alias("high"), F.count("score").alias("scores"), F.count("rationale").alias("texts"))
    wanted = rubric.select(key, "claim_id", F.lit(True).alias("wanted")).distinct()
    rules = {
        "missing": F.col("times").isNull(),
        "unexpected": F.col("wanted").isNull(),
        "repeated": F.col("times") > 1,
        "score": (F.col("scores") < F.col("times")) | (F.col("low") < 0) | (F.col("high") > 1),
        "rationale": F.col("texts") < F.col("times"),
    }
    return broken(wanted.join(given, [key, "claim_id"], "full"), [key, "claim_id"], rules)


def lenient_score(claims: DataFrame, rubric: DataFrame, episode: list[str], question: str) -> DataFrame:
    """episode key, lenient: the sum of weight × score over a question's rubric."""
    joined = claims.join(rubric.select(question, "claim_id", "weight"), [question, "claim_id"])
    return joined.groupBy(*episode).agg(F.sum(F.col("weight") * F.col("score")).alias("lenient"))


def strict_score(claims: DataFrame, rubric: DataFrame, episode: list[str], question: str, compiles: DataFrame | None = None) -> DataFrame:
    """episode key, lenient, strict: 0 if the program doesn't compile or a core claim is missed, else the lenient score."""
    joined = claims.join(rubric.select(question, "claim_id", "weight", "claim_type"), [question, "claim_id"])
    core = F.min(F.when(F.col("claim_type") == "core", F.col("score")))
    scored = joined.groupBy(*episode).agg(F.sum(F.col("weight") * F.col("score")).alias("lenient"), F.coalesce(core, F.lit(1)).alias("core"))
    ok = F.col("core") > 0
    if compiles is not None:
        scored = scored.join(compiles, episode, "left")
        ok = ok & F.coalesce("compiles", F.lit(False))
    return scored.select(*episode, "lenient", F.when(ok, F.col("lenient")).otherwise(0).alias("strict"))


def zero_fill(episodes: DataFrame, rubric: DataFrame, claims: DataFrame, episode: list[str], question: str, status: str = "status") -> DataFrame:
    """episode, claim_id, score, rationale: the claims of answered episodes as they are, and for each rubric claim of an
    episode whose ``status`` is no_answer a score of 0 with the rationale ``No answer.``

    Claims that a verdict of an answered episode lacks stay missing: ``verdict_violations`` reports them.
    """
    silent = episodes.where(F.col(status) == "no_answer").select(*episode)
    zeros = silent.join(rubric.select(question, "claim_id"), question).select(*episode, "claim_id", F.lit(0).alias("score"), F.lit("No answer.").alias("rationale"))
    said = claims.join(silent, episode, "left_anti").select(*episode, "claim_id", "score", "rationale")
    return said.unionByName(zeros)


def total_mismatch(df: DataFrame, judged: str, summed: str, tolerance: float = 0.0) -> DataFrame:
    """graded, mismatches, mean_abs_diff, mean_shift: how the judge's totals differ from the claims' sums."""
    diff = F.col(judged) - F.col(summed)
    off = F.abs(diff) > tolerance
    return df.where(F.col(judged).isNotNull()).agg(
        F.count(F.lit(1)).alias("graded"), F.count_if(off).alias("mismatches"), F.avg(F.when(off, F.abs(diff))).alias("mean_abs_diff"), F.avg(diff).alias("mean_shift")
    )


def population_gaps(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: missing and unexpected keys."""
    e, f = expected.select(*keys).distinct(), found.select(*keys).distinct()
    missing = e.join(f, keys, "left_anti").withColumn("problem", F.lit("missing"))
    return missing.unionByName(f.join(e, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def grid_of(manifest: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """run, budget, rollout, qid of a manifest (run, budgets, rollouts and, unless ``questions`` has them, question_ids).

    ``questions`` (run, qid) keeps long lists of ids as rows.
    """
    asked = manifest.select("run", F.explode("question_ids").alias("qid")) if questions is None else questions.select("run", "qid").distinct()
    cells = manifest.select("run", F.explode("budgets").alias("budget"), "rollouts")
    cells = cells.select("run", "budget", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rollouts").cast("bigint") - 1)).alias("rollout"))
    return asked.join(F.broadcast(cells), "run").select("run", "budget", "rollout", "qid")  # a row a budget and rollout of a run


def episode_violations(df: DataFrame, seed: Column, expected: dict[str, Column] | None = None, fingerprint: tuple[Column, Column] | None = None) -> DataFrame:
    """``df`` with rule, a row for each broken rule of an episode (status, answer, gen_tokens, seed and what follows).

    ``expected``: column and the value that file name or manifest give it; one that differs breaks the rule ``key``.
    ``fingerprint``: the stored and the recomputed fingerprint of the question as it was delivered.
    """
    rules = {
        "status": ~F.coalesce(F.col("status").isin("ok", "no_answer"), F.lit(False)),
        "answer": (F.col("status") == "ok") & (F.trim(F.coalesce("answer", F.lit(""))) == ""),
        "tokens": ~F.coalesce(F.col("gen_tokens") >= 0, F.lit(False)),
        "seed": ~F.col("seed").eqNullSafe(seed),
    }
    if expected:
        rules["key"] = F.exists(F.array(*(~F.col(name).eqNullSafe(value) for name, value in expected.items())), lambda x: x)
    if fingerprint:
        rules["fingerprint"] = ~fingerprint[0].eqNullSafe(fingerprint[1])
    return broken(df, df.columns, rules)


def stale_grades(grades: DataFrame, episodes: DataFrame, keys: list[str], fields: list[str], claims: DataFrame | None = None, rubric: DataFrame | None = None, question: str = "qid", score: str = "lenient") -> DataFrame:
    """keys, field: grades whose copied fields differ from the episode's, or whose episode is gone.

    With ``claims`` (keys, claim_id, score) and ``rubric``, scores are recomputed too: one that differs, or a claim list that
    isn't the rubric's, is reported as ``score``'s.
    """
    ours = grades.select(*keys, *(F.col(f).alias(f"g_{f}") for f in fields))
    joined = ours.join(episodes.select(*keys, *fields, F.lit(True).alias("there")), keys, "left")
    found = F.array_compact(F.array(*(F.when(F.col("there").isNull() | ~F.col(f"g_{f}").eqNullSafe(F.col(f)), F.lit(f)) for f in fields)))
    out = joined.select(*keys, F.explode(found).alias("field"))
    if claims is None or rubric is None:
        return out
    weights = rubric.select(question, "claim_id", "weight")
    size = rubric.groupBy(question).agg(F.count(F.lit(1)).alias("__size"))
    sums = claims.join(weights, [question, "claim_id"], "left").groupBy(*keys).agg(F.sum(F.col("weight") * F.col("score")).alias("__sum"), F.count("weight").alias("__known"), F.count(F.lit(1)).alias("__claims"))
    checked = grades.select(*dict.fromkeys([*keys, question, score])).join(sums, keys, "left").join(size, question, "left")
    right = F.col(score).eqNullSafe(F.col("__sum")) & F.col("__known").eqNullSafe(F.col("__size")) & F.col("__claims").eqNullSafe(F.col("__size"))
    return out.unionByName(checked.where(~right).select(*keys, F.lit(score).alias("field")))


def compat_report(a: DataFrame, b: DataFrame, fields: list[str], episodes_a: DataFrame | None = None, episodes_b: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """field, a, b for the fields in which two one-row manifests differ.

    With both runs' episodes (``keys``, seed): ``grid``, how many keys only one run has, and ``seed``, how many shared keys
    have another seed in it.
    """

    def unpivoted(df: DataFrame, name: str) -> DataFrame:
        rows = F.array(*(F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v")), {"ignoreNullFields": "false"}).alias(name)) for f in fields))
        return df.select(F.explode(rows).alias("r")).select("r.*")

    out = unpivoted(a, "a").join(unpivoted(b, "b"), "field", "full").where(~F.col("a").eqNullSafe(F.col("b")))
    if episodes_a is None or episodes_b is None or not keys:
        return out
    one, two = (e.select(*keys, F.col("seed").alias(f"{x}_seed"), F.lit(True).alias(f"{x}_there")) for e, x in ((episodes_a, "a"), (episodes_b, "b")))
    both = one.join(two, keys, "full")
    other = F.count_if(F.col("a_there") & F.col("b_there") & ~F.col("a_seed").eqNullSafe(F.col("b_seed")))
    counts = both.agg(F.count_if(F.col("b_there").isNull()).alias("a"), F.count_if(F.col("a_there").isNull()).alias("b"), other.alias("s"))
    row = lambda field, x, y: F.struct(F.lit(field).alias("field"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"))
    rows = counts.select(F.explode(F.array(row("grid", "a", "b"), row("seed", "s", "s"))).alias("r")).select("r.*")
    return out.unionByName(rows.where("a <> '0' OR b <> '0'"))


def token_ledger(df: DataFrame, usage: str, keys: list[str]) -> DataFrame:
    """keys, calls, prompt_tokens, completion_tokens, bad_calls: sums over an episode's calls; a bad call is negative or doesn't add up."""
    calls = df.select(*keys, F.explode_outer(usage).alias("u"))
    bad = (F.col("u.prompt_tokens") < 0) | (F.col("u.completion_tokens") < 0) | (F.col("u.prompt_tokens") + F.col("u.completion_tokens") != F.col("u.total_tokens"))
    return calls.groupBy(*keys).agg(
        F.count("u").alias("calls"), F.coalesce(F.sum("u.prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("u.completion_tokens"), F.lit(0)).alias("completion_tokens"), F.count_if(bad).alias("bad_calls"),
    )


def judge_agreement(a: DataFrame, b: DataFrame, keys: list[str], score: str, by: list[str] | None = None) -> DataFrame:
    """episodes, exact, a_higher, b_higher, bias (b − a), mean_abs_diff of two judges on the same episodes."""
    both = a.select(*keys, F.col(score).alias("a")).join(b.select(*keys, F.col(score).alias("b")), keys)
    d = F.col("b") - F.col("a")
    return both.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(d == 0).alias("exact"), F.count_if(d < 0).alias("a_higher"), F.count_if(d > 0).alias("b_higher"),
        F.avg(d).alias("bias"), F.avg(F.abs(d)).alias("mean_abs_diff"),
    )


def shard_load(df: DataFrame, key: Column, shards: int) -> DataFrame:
    from ..functions.ids import shard_of

    return df.groupBy(shard_of(key, shards).alias("shard")).agg(F.count(F.lit(1)).alias("n"))

"""Registered hypotheses, judged on the arms of a comparison: what the evidence says, whether it was there before, and whether the text changed since."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts of a pair; of a hypothesis that expects several, the last one here that any of them has.
VERDICTS = ("confirmed", "inconclusive", "untested", "refuted")


def expected(expect: Column) -> tuple[Column, Column]:
    """(arms, pairs of pos, low, high) that an expectation like "a < b > c" names; both null if it can't be read or names an arm twice."""
    tokens = F.regexp_extract_all(expect, F.lit(r"([<>]|[^\s<>]+)"), 1)
    arms, signs = F.filter(tokens, lambda _, i: i % 2 == 0), F.filter(tokens, lambda _, i: i % 2 == 1)
    read = (F.size(tokens) >= 3) & (F.size(tokens) % 2 == 1) & (F.size(F.array_distinct(arms)) == F.size(arms))
    read = read & F.forall(signs, lambda s: s.isin("<", ">")) & F.forall(arms, lambda a: ~a.isin("<", ">"))
    left, right, rises = lambda i: F.get(arms, i), lambda i: F.get(arms, i + 1), lambda i: F.get(signs, i) == "<"
    pairs = F.transform(signs, lambda _, i: F.struct(i.alias("pos"), F.when(rises(i), left(i)).otherwise(right(i)).alias("low"), F.when(rises(i), right(i)).otherwise(left(i)).alias("high")))
    return F.when(read, arms), F.when(read, pairs)


def reaches(gap: Column, margin: Column) -> Column:
    """gap >= margin but for the noise of doubles."""
    return (gap > margin) | (F.abs(gap - margin) <= F.greatest(1e-9 * F.greatest(F.abs(gap), F.abs(margin)), F.lit(1e-12)))


def _named(arms: DataFrame) -> DataFrame:
    """family, metric, name, found (kind 0: an arm, 1: a replicate of one): what a name can mean; an arm goes before a replicate of that name."""
    of = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col("name").alias("owner"), "value", "ci_low", "ci_high")
    own = arms.select("family", "metric", "name", of(0).alias("found"))
    members = arms.select("family", "metric", F.explode("members").alias("name"), of(1).alias("found"))
    return own.unionByName(members).groupBy("family", "metric", "name").agg(F.min("found").alias("found"))


def _pair_verdicts(sides: DataFrame) -> DataFrame:
    """hyp_id, verdict, why of each pair; sides has a row for its low and one for its high arm."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("name", "found"))).alias(s)
    pairs = sides.groupBy("hyp_id", "pos", "margin", "allow_single_run").agg(side("low"), side("high"))
    problem = lambda s: F.when(F.col(f"{s}.found").isNull(), "no such arm").when(F.col(f"{s}.found.kind") == 1, "a replicate, not an arm").when(F.col(f"{s}.found.value").isNull(), "no value")
    why = F.coalesce(problem("low"), problem("high"))
    v = lambda s, c: F.col(f"{s}.found.{c}")
    spans = v("low", "ci_low").isNotNull() & v("low", "ci_high").isNotNull() & v("high", "ci_low").isNotNull() & v("high", "ci_high").isNotNull()
    apart, possible = reaches(v("high", "ci_low") - v("low", "ci_high"), F.col("margin")), reaches(v("high", "ci_high") - v("low", "ci_low"), F.col("margin"))
    by_spans = F.when(apart, "confirmed").when(~possible, "refuted").otherwise("inconclusive")
    by_values = F.when(~F.col("allow_single_run"), "inconclusive").when(reaches(v("high", "value") - v("low", "value"), F.col("margin")), "confirmed").otherwise("refuted")
    verdict = F.when(why == "a replicate, not an arm", "inconclusive").when(why.isNotNull(), "untested").when(spans, by_spans).otherwise(by_values)
    said = F.coalesce(why, F.when(spans, "intervals").when(F.col("allow_single_run"), "values").otherwise("no interval"))
    return pairs.select("hyp_id", "pos", verdict.alias("verdict"), said.alias("why"))


def judge(hypotheses: DataFrame, arms: DataFrame, evidence: DataFrame) -> DataFrame:
    """hyp_id, verdict, why (of its pairs in their order), post_hoc, before (its arms that had evidence by then), altered.

    hypotheses: hyp_id, family, metric, expect, margin, allow_single_run, registered_at, content (JSON text), digest (of the registered content in canonical form).
    arms: family, metric, name, value, ci_low, ci_high, members (names of its runs). evidence: family, arm, at; an arm may have several.
    A pair of arms with intervals is confirmed if these are a margin apart, refuted if they leave no room for it; values alone decide only where that
    was allowed. The hypothesis is refuted if any pair is, else untested, else inconclusive. An expectation that can't be read gets no verdict.
    post_hoc: some arm had evidence at or before the second of registration; the verdict stands beside it. altered: the content isn't the registered one."""
    from tracewright.functions.records import canonical

    names, pairs = expected(F.col("expect"))
    h = hypotheses.withColumns({"names": names, "pairs": pairs})
    each = h.select("hyp_id", "family", "metric", "margin", "allow_single_run", F.explode("pairs").alias("p"))
    sides = each.select("hyp_id", "family", "metric", "margin", "allow_single_run", "p.pos", F.explode(F.create_map(F.lit("low"), F.col("p.low"), F.lit("high"), F.col("p.high"))).alias("side", "name"))
    rank = F.array_position(F.array(*[F.lit(x) for x in VERDICTS]), F.col("verdict"))
    whole = _pair_verdicts(sides.join(_named(arms), ["family", "metric", "name"], "left")).groupBy("hyp_id").agg(F.max_by("verdict", rank).alias("verdict"), F.array_sort(F.collect_list(F.struct("pos", "why"))).alias("w"))
    # Of an arm's evidence the earliest decides whether any was there.
    first = evidence.groupBy("family", "arm").agg(F.date_trunc("second", F.min("at")).alias("at"))
    early = h.select("hyp_id", "family", "registered_at", F.explode("names").alias("arm")).join(first, ["family", "arm"]).filter(F.col("at") <= F.col("registered_at"))
    before = early.groupBy("hyp_id").agg(F.array_sort(F.collect_list("arm")).alias("before"))
    altered = ~F.coalesce(F.sha2(canonical(F.col("content")), 256) == F.col("digest"), F.lit(False))
    out = h.select("hyp_id", altered.alias("altered")).join(whole, "hyp_id", "left").join(before, "hyp_id", "left")
    return out.select("hyp_id", "verdict", F.array_join(F.transform("w", lambda w: w["why"]), "; ").alias("why"), F.col("before").isNotNull().alias("post_hoc"), F.coalesce(F.array_join("before", ","), F.lit("")).alias("before"), "altered")

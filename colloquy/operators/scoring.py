"""Joins and aggregates of scored responses: completeness, pooled and two-level means,
contrasts, attribution outcomes and copy rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import window_places


def ratio(a: Column, b: Column) -> Column:
    """a / b rounded to six places; null where b is 0 or null."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def completeness(
    targets: DataFrame, arms: list[str], responses: DataFrame, keys: list[str], order: list[str], duplicates: str = "last",
) -> DataFrame:
    """Every target with every arm: keys, arm, copies, found, and the last response's ``pick``.

    ``duplicates`` ``raise`` makes reading ``copies`` fail where there is more than one.
    Responses of other targets are ignored. The arms are a list of parameters."""
    expected = targets.select(*keys).distinct().withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))
    value = F.max(F.struct(*order)).alias("pick")
    got = responses.groupBy(*keys, "arm").agg(F.count(F.lit(1)).alias("copies"), value)
    rows = expected.join(got, [*keys, "arm"], "left").withColumn("copies", F.coalesce("copies", F.lit(0))).withColumn("found", F.col("copies") > 0)
    if duplicates == "raise":
        rows = rows.withColumn(
            "copies",
            F.when(F.col("copies") > 1, F.raise_error(F.lit("a response is there more than once")).cast("long")).otherwise(F.col("copies")),
        )
    return rows


def pooled_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over rows and ratios of the sums: word and carry error rates, hit rate, false hints."""
    names = ("wer_errors", "wer_tokens", "carry_errors", "carry_tokens", "carry_hits", "carry_total", "false_hint_target")
    sums = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return sums.select(
        *keys, "n", *names, ratio(F.col("wer_errors"), F.col("wer_tokens")).alias("wer"),
        ratio(F.col("carry_errors"), F.col("carry_tokens")).alias("carry_wer"),
        ratio(F.col("carry_hits"), F.col("carry_total")).alias("hit_rate"),
        ratio(F.col("false_hint_target"), F.col("n")).alias("false_hint_rate"),
    )


def two_level_mean(rows: DataFrame, arm: str, group: str, value: str) -> DataFrame:
    """Mean of group means per arm, groups unweighted; null values are left out and counted."""
    per = rows.groupBy(arm, group).agg(F.avg(value).alias("m"), F.count_if(F.col(value).isNull()).alias("skipped"))
    return per.groupBy(arm).agg(F.count("m").alias("groups"), F.round(F.avg("m"), 6).alias("mean"), F.sum("skipped").alias("skipped"))


def arm_pairs(scores: DataFrame, first: str, second: str) -> DataFrame:
    """Targets with a score in both arms: uniq_id, target_id and both arms' columns with the
    suffixes ``_0`` and ``_1``. A target has one row an arm (see the message operator)."""
    names = ("wer_errors", "wer_tokens", "carry_hits", "carry_total", "false_hint_target")
    side = lambda arm, k: scores.where(F.col("arm") == arm).select("target_id", "uniq_id", *[F.col(c).alias(f"{c}_{k}") for c in names])
    return side(first, 0).join(side(second, 1).drop("uniq_id"), "target_id")


def transitions(pairs: DataFrame) -> DataFrame:
    """Labels of each pair: repair, break, retained or missed by carry hits."""
    a, b = F.coalesce(F.col("carry_hits_0"), F.lit(0)) > 0, F.coalesce(F.col("carry_hits_1"), F.lit(0)) > 0
    return pairs.withColumn("transition", F.when(~a & b, "repair").when(a & ~b, "break").when(a & b, "retained").otherwise("missed"))


def width_bucket(width: Column) -> Column:
    return F.when(width.isNull(), "unknown").when(width <= 1, "1").when(width <= 4, "2-4").otherwise("5+")


def policy_strata(pairs: DataFrame, accept: Column, strata: list[str]) -> DataFrame:
    """A policy that takes arm 1 where ``accept`` holds and arm 0 elsewhere, over all targets
    and within each stratum, in one pass: stratum, level, n, accepted, hits, total, and the
    gain of hits over arm 0."""
    take = F.coalesce(accept, F.lit(False))
    rows = pairs.select(
        *strata, take.cast("long").alias("acc"), F.when(take, F.col("carry_hits_1")).otherwise(F.col("carry_hits_0")).alias("hits"),
        F.when(take, F.col("carry_total_1")).otherwise(F.col("carry_total_0")).alias("total"),
        F.col("carry_hits_0").alias("base"),
    )
    # each row once for each stratum and once for all: a fixed small factor, before the shuffle
    cells = F.array(
        F.struct(F.lit("all").alias("stratum"), F.lit("all").alias("level")),
        *[F.struct(F.lit(s).alias("stratum"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("level")) for s in strata],
    )
    long = rows.select("*", F.inline(cells))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return long.groupBy("stratum", "level").agg(
        F.count(F.lit(1)).alias("n"), F.sum("acc").alias("accepted"), zero("hits").alias("hits"), zero("total").alias("total"), (zero("hits") - zero("base")).alias("gain")
    )


def attribution(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Full join of gold sentences (sentence, speakers array) with predictions (sentence,
    speaker): outcome correct, wrong, ambiguous, unattributed or hallucinated.

    A null speaker or no prediction is unattributed; a prediction without gold sentence is
    hallucinated and in no denominator; several gold speakers are ambiguous if one is hit."""
    rows = gold.join(predicted, "sentence", "full")
    hit = F.array_contains("speakers", F.col("speaker"))
    outcome = (
        F.when(F.col("speakers").isNull(), "hallucinated").when(F.col("speaker").isNull(), "unattributed")
        .when(hit & (F.size("speakers") > 1), "ambiguous").when(hit, "correct").otherwise("wrong")
    )
    return rows.select("sentence", "speakers", "speaker", outcome.alias("outcome"))


def attribution_accuracy(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    kinds = ("correct", "wrong", "ambiguous", "unattributed", "hallucinated")
    rows = outcomes.groupBy(*keys).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    return rows.withColumn("accuracy", ratio(F.col("correct"), F.col("correct") + F.col("wrong") + F.col("unattributed")))


def copy_counts(pairs: DataFrame, produced: str, reference: str) -> DataFrame:
    """Adds ``copies``: occurrences, overlapping ones too, of the reference tokens as a run in
    the produced tokens; 0 for an empty reference."""
    return pairs.withColumn("copies", F.size(window_places(F.col(produced), F.col(reference))))


def copy_rate(counted: DataFrame) -> DataFrame:
    return counted.agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("copies") > 0).alias("hits"),
        F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), ratio(F.count_if(F.col("copies") > 0), F.count(F.lit(1))).alias("rate"),
    )


def activation(rows: DataFrame, hyp: str, ref: str, terms: str) -> DataFrame:
    """Of the injected single-token terms: activated (in the hypothesis) and unsupported
    (activated and not in the reference)."""
    active = F.filter(F.array_distinct(terms), lambda t: F.array_contains(F.col(hyp), t))
    unsupported = F.filter(active, lambda t: ~F.array_contains(F.col(ref), t))
    return rows.withColumn("activated", F.size(active)).withColumn("unsupported", F.size(unsupported))


def pair_errors(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """Aligned token pairs (ref, hyp; null where a side has none) against a glossary (term):
    induced substitutions, errors and tokens inside and outside the glossary. Insertions are
    in neither denominator."""
    terms = glossary.select("term").distinct()
    rows = pairs.join(terms.select(F.col("term").alias("_r"), F.lit(True).alias("in_ref")), F.col("ref") == F.col("_r"), "left")
    rows = rows.join(terms.select(F.col("term").alias("_h"), F.lit(True).alias("in_hyp")), F.col("hyp") == F.col("_h"), "left")
    inside, wrong, there = F.coalesce("in_ref", F.lit(False)), ~F.col("ref").eqNullSafe(F.col("hyp")), F.col("ref").isNotNull()
    out = rows.agg(
        F.count_if(there & wrong & F.coalesce("in_hyp", F.lit(False))).alias("induced"), F.count_if(there & inside).alias("b_tokens"),
        F.count_if(there & inside & wrong).alias("b_errors"),
        F.count_if(there & ~inside).alias("u_tokens"), F.count_if(there & ~inside & wrong).alias("u_errors"),
        F.count_if(~there).alias("insertions"),
    )
    return out.withColumn("b_wer", ratio(F.col("b_errors"), F.col("b_tokens"))).withColumn("u_wer", ratio(F.col("u_errors"), F.col("u_tokens")))

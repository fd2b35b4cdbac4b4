"""Carried terms: who said a term before, and what could be handed on.

A unit is a distinct (meeting, position, speaker, surface). Firsts are aggregated before
anything is joined, so a meeting with a third of all rows costs rows, not windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_units(df: DataFrame, meeting: Column, position: Column, speaker: Column, terms: Column) -> DataFrame:
    """Distinct units of rows with a position; a null speaker is the speaker ``''``."""
    rows = df.where(position.isNotNull()).select(
        meeting.alias("meeting"), position.alias("position"), F.coalesce(speaker, F.lit("")).alias("speaker"),
        F.explode(F.array_distinct(terms)).alias("surface"),
    )
    return rows.distinct()


def census(units: DataFrame) -> DataFrame:
    """Each unit's class: ``shared`` (own and other speakers said the surface strictly
    earlier), ``exclusive`` (own only), ``global_only`` (others only) or ``new``."""
    firsts = units.groupBy("meeting", "surface", "speaker").agg(F.min("position").alias("first"))
    two = firsts.groupBy("meeting", "surface").agg(
        F.min(F.struct("first", "speaker")).alias("a"), F.count(F.lit(1)).alias("n"),
    )
    second = (
        firsts.join(two.where("n > 1"), ["meeting", "surface"]).where(F.col("speaker") != F.col("a.speaker"))
        .groupBy("meeting", "surface").agg(F.min("first").alias("b"))
    )
    earliest = two.join(second, ["meeting", "surface"], "left").select("meeting", "surface", "a", "b")
    rows = units.join(firsts, ["meeting", "surface", "speaker"]).join(earliest, ["meeting", "surface"])
    own = F.col("first") < F.col("position")
    others = F.when(F.col("a.speaker") == F.col("speaker"), F.col("b")).otherwise(F.col("a.first"))
    other = F.coalesce(others < F.col("position"), F.lit(False))
    kind = F.when(own & other, "shared").when(own, "exclusive").when(other, "global_only").otherwise("new")
    return rows.select("meeting", "position", "speaker", "surface", kind.alias("kind"))


def census_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("meeting").agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("exclusive", "global_only", "new", "shared")]
    )


def half_even_quantile(counted: Column, n: Column, fraction: float) -> Column:
    """Nearest rank, the index rounded half to even, from a sorted array of (v, c): values
    and how often each occurs, ``n`` in all."""
    rank = F.bround((n - 1) * F.lit(fraction), 0).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("v"))
    step = lambda s, x: F.struct((s["seen"] + x["c"]).alias("seen"), F.when(s["v"].isNull() & (s["seen"] + x["c"] > rank), x["v"]).otherwise(s["v"]).alias("v"))
    return F.aggregate(counted, start, step)["v"]


def supply_summary(classified: DataFrame) -> DataFrame:
    """Meetings, exclusive units, quartiles of exclusive units a meeting, and the largest
    share one surface has of them (0.0 without any)."""
    per = classified.groupBy("meeting").agg(F.count_if(F.col("kind") == "exclusive").alias("v"))
    # meetings are counted by value first, so the array holds distinct counts only
    spread = per.groupBy("v").agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("meetings"), F.coalesce(F.sum(F.col("v") * F.col("c")), F.lit(0)).alias("units"), F.array_sort(F.collect_list(F.struct("v", "c"))).alias("d")
    )
    top = classified.where("kind = 'exclusive'").groupBy("surface").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("top"))
    row = spread.crossJoin(F.broadcast(top))  # one row each
    return row.select(
        "meetings", "units",
        *[half_even_quantile(F.col("d"), F.col("meetings"), q).alias(name) for q, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))],
        F.round(F.coalesce(F.try_divide(F.col("top"), F.col("units")), F.lit(0.0)), 6).alias("max_share"),
    )


def prior_terms(units: DataFrame, same_speaker: bool = True) -> DataFrame:
    """Per target unit that was said before: ``evidence`` (earlier positions with the surface)
    and ``gap`` to the last of them, by the same speaker or by anyone."""
    keys = ["meeting", "surface", "speaker"] if same_speaker else ["meeting", "surface"]
    own = units if same_speaker else units.select("meeting", "surface", "position").distinct()
    order = Window.partitionBy(*keys).orderBy("position")
    rows = own.withColumn("evidence", F.row_number().over(order) - 1).withColumn("gap", F.col("position") - F.lag("position").over(order))
    return rows.where("evidence > 0").select(*keys, "position", "evidence", "gap")


def prior_of_others(units: DataFrame) -> DataFrame:
    """Per target unit whose surface another speaker said before: ``evidence``, the earlier
    positions at which anyone but the speaker alone did.

    These are all earlier positions with the surface less those where the speaker was the
    only one, so running counts are enough."""
    said = units.select("meeting", "surface", "position", "speaker").distinct()
    at = said.groupBy("meeting", "surface", "position").agg(F.count(F.lit(1)).alias("_n"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_all", F.count(F.lit(1)).over(before("meeting", "surface")))
    rows = said.join(at, ["meeting", "surface", "position"])
    alone = F.coalesce(F.sum((F.col("_n") == 1).cast("long")).over(before("meeting", "surface", "speaker")), F.lit(0))
    rows = rows.withColumn("evidence", F.col("_all") - alone).where("evidence > 0")
    return rows.select("meeting", "surface", "speaker", "position", "evidence")


def ranked_terms(units: DataFrame, most: int) -> DataFrame:
    """The ``most`` surfaces of each meeting by evidence, then first position, then name;
    ``rank`` from 1."""
    terms = units.groupBy("meeting", "surface").agg(F.count(F.lit(1)).alias("evidence"), F.min("position").alias("first_seen"))
    by = (F.col("evidence").desc(), "first_seen", "surface")
    # the best of each part of a meeting first: a meeting with very many terms is many tasks
    part = Window.partitionBy("meeting", "_part").orderBy(*by)
    best = terms.withColumn("_part", F.pmod(F.xxhash64("surface"), F.lit(64))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most).drop("_part", "_r")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("meeting").orderBy(*by))).where(F.col("rank") <= most)


def carry_accounting(units: DataFrame) -> DataFrame:
    """Per meeting and position: distinct surfaces in all, new ones, and those known before
    (said at any earlier position, said again or not)."""
    firsts = units.groupBy("meeting", "surface").agg(F.min("position").alias("position"))
    new = firsts.groupBy("meeting", "position").agg(F.count(F.lit(1)).alias("new"))
    here = units.groupBy("meeting", "position").agg(F.count_distinct("surface").alias("total"))
    rows = here.join(new, ["meeting", "position"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    before = Window.partitionBy("meeting").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("carried", F.coalesce(F.sum("new").over(before), F.lit(0)))


def second_half_coverage(units: DataFrame) -> DataFrame:
    """Per meeting: share of second-half mentions whose surface was said in the first half;
    halves by the middle position, 0.0 without mentions."""
    span = units.groupBy("meeting").agg(((F.min("position") + F.max("position")) / 2.0).alias("middle"))
    rows = units.join(span, "meeting")
    first = rows.where(F.col("position") <= F.col("middle")).select("meeting", "surface").distinct().withColumn("hit", F.lit(1))
    later = rows.where(F.col("position") > F.col("middle")).join(first, ["meeting", "surface"], "left")
    share = later.groupBy("meeting").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("c"))
    return span.join(share, "meeting", "left").select("meeting", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("coverage"))


def clusters(candidates: DataFrame) -> DataFrame:
    """Candidates (meeting, key, surface, place) as clusters by key: canonical (the most
    frequent surface, then the least), variants, evidence and first place."""
    counted = candidates.groupBy("meeting", "key", "surface").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("place"))
    return counted.groupBy("meeting", "key").agg(
        F.min_by("surface", F.struct(-F.col("n"), "surface")).alias("canonical"), F.array_sort(F.collect_set("surface")).alias("variants"), F.sum("n").alias("evidence"), F.min("place").alias("first_place")
    )


def merged_entries(entries: DataFrame) -> DataFrame:
    """Entries (meeting, key, chunk, canonical, evidence, variants) folded in the order of
    chunks: variants united, evidence summed, first_seen the least chunk. The canonical form
    follows a chunk's only if its evidence is over the sum so far, so the fold is in order;
    a key has one entry a chunk."""
    item = F.struct("chunk", "canonical", "evidence", "variants")
    ordered = entries.groupBy("meeting", "key").agg(F.sort_array(F.collect_list(item)).alias("e"))
    start = F.struct(F.element_at("e", 1)["canonical"].alias("canonical"), F.element_at("e", 1)["evidence"].cast("long").alias("evidence"))
    step = lambda s, x: F.struct(F.when(x["evidence"] > s["evidence"], x["canonical"]).otherwise(s["canonical"]).alias("canonical"), (s["evidence"] + x["evidence"]).alias("evidence"))
    folded = F.aggregate(F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0))), start, step)
    return ordered.select(
        "meeting", "key", folded["canonical"].alias("canonical"), folded["evidence"].alias("evidence"),
        F.element_at("e", 1)["chunk"].alias("first_seen"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("e", lambda x: x["variants"])))).alias("variants"),
    )


def merged_by_source(entries: DataFrame) -> DataFrame:
    """``merged_entries`` by key, provenance and tier, with ``introduced_by`` of the earliest
    chunk: entries also have provenance, tier and introduced_by, whose nulls are values."""
    null = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    whole = F.struct("key", null("provenance").alias("p"), null("tier").alias("t"))
    by = entries.groupBy("meeting", whole.alias("key")).agg(F.min_by("introduced_by", "chunk").alias("introduced_by"))
    folded = merged_entries(entries.withColumn("key", whole)).join(by, ["meeting", "key"])
    back = lambda c: F.when(F.col(f"key.{c}") != "", F.substring(F.col(f"key.{c}"), 2, 1 << 30))
    rest = [x for x in folded.columns if x not in ("meeting", "key")]
    return folded.select("meeting", F.col("key.key").alias("key"), back("p").alias("provenance"), back("t").alias("tier"), *rest)


def state_scores(rows: DataFrame, keys: list[str], terms: str, supported: str, same: str, other: str) -> DataFrame:
    """Ten counters and six rates per ``keys`` of term sets: state terms against the terms that
    speech supports, the same speaker's targets and all targets (arrays). Off-speaker terms are
    supported ones that are no target of the speaker's. Rates without denominator are null."""
    n = lambda c: F.coalesce(F.size(F.array_distinct(c)), F.lit(0)).cast("long")
    t, s, a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (terms, supported, same, other))
    counts = {
        "terms": n(t), "supported_terms": n(F.array_intersect(t, s)), "hallucinated_terms": n(F.array_except(t, s)),
        "off_speaker_terms": n(F.array_except(F.array_intersect(t, s), a)),
        "target_relevant_terms": n(F.array_intersect(t, b)), "same_targets": n(a), "same_target_hits": n(F.array_intersect(t, a)),
        "global_targets": n(b), "global_target_hits": n(F.array_intersect(t, b)),
    }
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("targets"), *[F.sum(c).alias(name) for name, c in counts.items()])
    rate = lambda x, y: F.round(F.try_divide(F.col(x).cast("double"), F.col(y).cast("double")), 6)
    return (
        sums.withColumn("support_precision", rate("supported_terms", "terms")).withColumn("hallucination_rate", rate("hallucinated_terms", "terms")).withColumn("off_speaker_rate", rate("off_speaker_terms", "terms"))
        .withColumn("target_relevance", rate("target_relevant_terms", "terms")).withColumn("same_target_recall", rate("same_target_hits", "same_targets")).withColumn(
            "global_target_recall", rate("global_target_hits", "global_targets"),
        )
    )


def class_counts(classified: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidate and exclusive units per class of surface (surface, class); a surface of several
    classes counts once in each: class, candidates, exclusive."""
    rows = classified.join(classes.select("surface", "class").distinct(), "surface")
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("kind") == "exclusive").alias("exclusive"))


def gated(entries: DataFrame, least: int = 2, clip: int | None = None) -> DataFrame:
    """Entries with enough evidence; evidence over ``clip`` is cut to it, all else kept."""
    kept = entries.where(F.col("evidence") >= least)
    return kept.withColumn("evidence", F.least("evidence", F.lit(clip))) if clip else kept


def equal_width_arms(lists: DataFrame, columns: list[str]) -> DataFrame:
    """Term lists cut to the length of the shortest; rows where that is 0 are dropped."""
    width = F.least(*[F.size(c) for c in columns])
    rows = lists.withColumn("width", width).where("width > 0")
    return rows.select(
        *[c for c in lists.columns if c not in columns], *[F.slice(F.col(c), F.lit(1), F.col("width")).alias(c) for c in columns], "width",
    )


def term_set_sizes(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds sizes of the union, intersection and differences of two term arrays."""
    return rows.select(
        "*", F.size(F.array_union(a, b)).alias("n_union"), F.size(F.array_intersect(a, b)).alias("n_both"), F.size(F.array_except(a, b)).alias("n_left"), F.size(F.array_except(b, a)).alias("n_right")
    )


def active_entries(log: DataFrame) -> DataFrame:
    """Rows of an append-only log (entry, supersedes) that no later row supersedes."""
    gone = log.where(F.col("supersedes").isNotNull()).select(F.col("supersedes").alias("entry"))
    return log.join(gone, "entry", "left_anti")


def broken_links(log: DataFrame, chain: str, seq: str) -> DataFrame:
    """Rows of a hash-chained log whose previous hash is not the hash of the row before."""
    order = Window.partitionBy(chain).orderBy(seq)
    return log.withColumn("_before", F.lag("entry").over(order)).where(~F.col("previous").eqNullSafe(F.col("_before"))).drop("_before")

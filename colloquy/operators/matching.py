"""Matching of predictions to references: greedy claims, alternatives, positional pairs,
fuzzy windows, and comparisons of two results."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import edit_distance, multiset_overlap, token_f1

_CLAIM = T.ArrayType(
    T.StructType([T.StructField("gold", T.StringType()), T.StructField("pred", T.IntegerType()), T.StructField("f1", T.DoubleType())])
)


@F.pandas_udf(_CLAIM)
def _claims(candidates: pd.Series) -> pd.Series:
    """One-to-one claims in the order of falling f1, then gold, then prediction."""
    out = []
    for own in candidates:
        golds, preds, kept = set(), set(), []
        for c in sorted(own, key=lambda c: (-c["f1"], c["gold"], c["pred"])):
            if c["gold"] not in golds and c["pred"] not in preds:
                golds.add(c["gold"])
                preds.add(c["pred"])
                kept.append({"gold": c["gold"], "pred": c["pred"], "f1": c["f1"]})
        out.append(kept)
    return pd.Series(out)


def greedy_claims(gold: DataFrame, predicted: DataFrame, least: float = 0.3) -> DataFrame:
    """Predictions (meeting, pred, tokens) claim gold sentences (meeting, gold, tokens) one to
    one, best token F1 first, from ``least`` on: meeting, gold, pred, f1.

    Candidates share a token (an inverted index), so no pair without one is formed; the
    claims of one meeting are made in one place."""
    a = gold.select("meeting", "gold", F.col("tokens").alias("_a"))
    b = predicted.select("meeting", "pred", F.col("tokens").alias("_b"))
    index = lambda df, key, tokens: df.select("meeting", key, F.explode(F.array_distinct(tokens)).alias("_t"))
    shared = index(a, "gold", "_a").join(index(b, "pred", "_b"), ["meeting", "_t"]).select("meeting", "gold", "pred").distinct()
    scored = shared.join(a, ["meeting", "gold"]).join(b, ["meeting", "pred"]).withColumn("f1", token_f1(F.col("_a"), F.col("_b"), 0.0)).where(F.col("f1") >= least)
    claims = scored.groupBy("meeting").agg(F.collect_list(F.struct("gold", "pred", "f1")).alias("c"))
    return claims.select("meeting", F.inline(_claims("c")))


def best_alternative(rows: DataFrame, prediction: str, alternatives: str) -> DataFrame:
    """Adds ``f1`` and ``exact``, each the best over the gold alternatives (arrays of tokens) on
    its own; a prediction against no alternative is scored against the empty one."""
    golds = F.when(F.size(alternatives) > 0, F.col(alternatives)).otherwise(F.array(F.array().cast("array<string>")))
    return rows.withColumn("f1", F.array_max(F.transform(golds, lambda g: token_f1(F.col(prediction), g)))).withColumn(
        "exact", F.array_max(F.transform(golds, lambda g: (g == F.col(prediction)).cast("int"))),
    )


def scorer_gaps(a: DataFrame, b: DataFrame, key: str, value: str, threshold: float = 0.2) -> DataFrame:
    """Examples scored by two scorers: signed gap (a - b) and whether it is over the threshold."""
    rows = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    return rows.withColumn("gap", F.round(F.col("a") - F.col("b"), 6)).withColumn("diverges", F.abs("gap") > threshold)


def positional(left: DataFrame, right: DataFrame, key: str, order: str, other_order: str | None = None) -> DataFrame:
    """Rows of two tables of a key paired by place in ``order``, from 0; surplus rows of either
    side have nulls on the other. Columns other than the key come as structs a and b."""

    def placed(df: DataFrame, name: str, by: str) -> DataFrame:
        rest = [c for c in df.columns if c != key]
        return df.select(key, (F.row_number().over(Window.partitionBy(key).orderBy(by)) - 1).alias("place"), F.struct(*rest).alias(name))

    return placed(left, "a", order).join(placed(right, "b", other_order or order), [key, "place"], "full")


def timed_by_place(segments: DataFrame, turns: DataFrame, bounds: DataFrame, key: str, order: str, turn_order: str) -> DataFrame:
    """Segments of a key with the times (s, e) of the turn in the same place; surplus ones have the
    bounds (low, high) of the key, if there are any. ``turns`` has key, turn_order, s and e."""
    pairs = positional(segments, turns.select(key, turn_order, "s", "e"), key, order, turn_order).where("a is not null")
    rows = pairs.join(bounds.select(key, "low", "high"), key, "left")
    return rows.select(key, "a.*", F.coalesce("b.s", "low").alias("s"), F.coalesce("b.e", "high").alias("e"))


def fuzzy_places(tokens: list[str], needle: list[str]) -> list[tuple[int, list[str], bool]]:
    """Where a needle of n tokens stands in a text, up to ceil(n / 2) - 1 token edits: start,
    the window, and whether the needle stands in it word for word.

    A window has n tokens, or fewer, or more, in this order, as far as the edits allow; where
    n do not fit any more, nothing is looked for. What a match covers is used up, but words
    behind a literal needle are not."""
    n = len(needle)
    edits = -(-n // 2) - 1
    lengths = [n, *range(n - 1, max(1, n - edits) - 1, -1), *range(n + 1, n + edits + 1)] if n else []
    out: list[tuple[int, list[str], bool]] = []
    start = 0
    while n and start + n <= len(tokens):
        step = 1
        for k in lengths:
            if start + k > len(tokens):
                break
            window = tokens[start : start + k]
            if edit_distance(window, needle) <= edits:
                text, whole = " ".join(window), " ".join(needle)
                at = text.find(whole)
                out.append((start, window, at >= 0))
                step = k - (len(text[at + len(whole) :].split()) if at >= 0 else 0)
                break
        start += max(step, 1)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def fuzzy_matches(tokens: pd.Series, needles: pd.Series) -> pd.Series:
    """Matched texts of needles (array of texts) in token arrays, in order of their places: the
    needle itself where it stands word for word, else the window. Null in, null out."""
    out = []
    for text, wanted in zip(tokens, needles):
        if text is None or wanted is None:
            out.append(None)
            continue
        found = set()
        for needle in wanted:
            for start, window, literal in fuzzy_places(list(text), needle.split()):
                matched = needle if literal else " ".join(window)
                found.add((start, len(matched.split()), matched))
        out.append([x[2] for x in sorted(found)])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.IntegerType())
def window_distance(tokens: pd.Series, needle: pd.Series) -> pd.Series:
    """Least token edit distance of a needle of n tokens to a window of n - 1 to n + 1 tokens; n
    where there is no window, null for nulls."""

    def least(text, wanted) -> int | None:
        if text is None or wanted is None:
            return None
        text, wanted = list(text), list(wanted)
        n = len(wanted)
        windows = (text[i : i + k] for k in range(max(1, n - 1), n + 2) for i in range(len(text) - k + 1))
        return min((edit_distance(x, wanted) for x in windows), default=n)

    return pd.Series([least(a, b) for a, b in zip(tokens, needle)], dtype="Int32")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with their numbers, that one table has more often than the other: empty if both
    hold the same rows."""
    columns = sorted(a.columns)
    count = lambda df, name: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))
    x, y = count(a, "n_a"), count(b, "n_b").select(*[F.col(c).alias(f"_{c}") for c in columns], "n_b")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = x.join(y, same, "full").withColumn("n_a", F.coalesce("n_a", F.lit(0))).withColumn("n_b", F.coalesce("n_b", F.lit(0)))
    return rows.where("n_a <> n_b").select(*[F.coalesce(c, f"_{c}").alias(c) for c in columns], "n_a", "n_b")


def changed_positions(a: DataFrame, b: DataFrame, key: str, place: str, columns: list[str]) -> DataFrame:
    """Per key: places at which two plans differ in any of ``columns`` (a place that one plan
    lacks differs), out of the longer plan's places."""
    x = a.select(key, place, F.struct(*columns).alias("_a"))
    y = b.select(key, place, F.struct(*columns).alias("_b"))
    rows = x.join(y, [key, place], "full")
    return rows.groupBy(key).agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"), F.count(F.lit(1)).alias("places"))


def within_budget(rows: DataFrame, group: list[str], order: list[str], cost: str, cap: int) -> DataFrame:
    """Rows in order with their running cost and whether they are still allowed: a row is
    refused if it would pass the cap, and so are all rows after it."""
    window = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(F.coalesce(F.col(cost), F.lit(0))).over(window)
    return rows.withColumn("spent", spent).withColumn("allowed", F.max("spent").over(window) <= cap)


def rotated_requests(targets: DataFrame, key: str, arms: list[str]) -> DataFrame:
    """Every target with every arm; the order of the arms turns by one from target to target
    (by the hash of the target): key, arm, turn from 0."""
    shift = F.pmod(F.conv(F.substr(F.md5(F.col(key)), F.lit(1), F.lit(6)), 16, 10).cast("long"), F.lit(len(arms)))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("arm")) for i, a in enumerate(arms)]))
    rows = targets.select(key).distinct().select(key, shift.alias("_s"), each.alias("x"))
    return rows.select(key, F.col("x.arm").alias("arm"), F.pmod(F.col("x.i") - F.col("_s"), F.lit(len(arms))).cast("int").alias("turn"))


def capped_block(rows: DataFrame, group: str, order: list[str], text: str, budget: int) -> DataFrame:
    """Per group the longest prefix of lines, in order, whose token estimate (four characters
    a token, line ends counted) fits the budget, as one text: group, block, n_lines."""
    window = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.where(F.col(text).isNotNull()).withColumn("_upto", F.sum(F.length(text) + 1).over(window)).withColumn(
        "_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)),
    )
    kept = kept.where(F.ceil((F.col("_upto") - 1) / 4.0) <= budget)
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", text))), lambda x: x[text]), "\n")
    return kept.groupBy(group).agg(block.alias("block"), F.count(F.lit(1)).alias("n_lines"))


def trimmed_sections(first: Column, second: Column, heads: tuple[str, str], empty: tuple[str, str], budget: int) -> Column:
    """Two sections of lines (arrays, in order) as one text of at most ``budget`` tokens, at four
    characters a token: struct of text, n_first, n_second and tokens.

    Lines go from the end of the second section first, then of the first, until the text fits; a
    section without lines has its ``empty`` line. Heads and empty lines are never dropped, so a
    very small budget is passed by them alone. Null arrays are empty ones."""
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in (first, second))

    def body(lines: Column, n: Column, none: str) -> Column:
        return F.when(n > 0, F.array_join(F.slice(lines, F.lit(1), n), "\n")).otherwise(F.lit(none))

    def text(g: Column, s: Column) -> Column:
        return F.concat(F.lit(heads[0] + "\n"), body(a, g, empty[0]), F.lit("\n\n" + heads[1] + "\n"), body(b, s, empty[1]))

    steps = F.concat(
        F.transform(F.sequence(F.size(b), F.lit(0)), lambda s: F.struct(F.size(a).alias("g"), s.alias("s"))),
        F.when(F.size(a) > 0, F.transform(F.sequence(F.size(a) - 1, F.lit(0)), lambda g: F.struct(g.alias("g"), F.lit(0).alias("s")))).otherwise(
            F.array().cast("array<struct<g:int,s:int>>")
        ),
    )
    fits = F.filter(steps, lambda x: F.ceil(F.length(text(x["g"], x["s"])) / 4.0) <= budget)
    chosen = F.coalesce(F.get(fits, F.lit(0)), F.struct(F.lit(0).alias("g"), F.lit(0).alias("s")))
    return F.struct(
        text(chosen["g"], chosen["s"]).alias("text"), chosen["g"].alias("n_first"), chosen["s"].alias("n_second"),
        F.ceil(F.length(text(chosen["g"], chosen["s"])) / 4.0).alias("tokens"),
    )


def reconciled(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned against done rows per key: numbers of both and ``state`` (complete, missing,
    repeated or unplanned)."""
    a = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("planned"))
    b = done.groupBy(*keys).agg(F.count(F.lit(1)).alias("done"))
    rows = a.join(b, keys, "full").withColumn("planned", F.coalesce("planned", F.lit(0))).withColumn("done", F.coalesce("done", F.lit(0)))
    state = F.when(F.col("planned") == 0, "unplanned").when(F.col("done") == 0, "missing").when(F.col("done") > F.col("planned"), "repeated").otherwise("complete")
    return rows.withColumn("state", state)


def overlap_f1(a: Column, b: Column) -> Column:
    """F1 of two n-gram arrays, 0.0 where either is empty."""
    return F.coalesce(F.try_divide(2.0 * multiset_overlap(a, b), F.size(a) + F.size(b)), F.lit(0.0))

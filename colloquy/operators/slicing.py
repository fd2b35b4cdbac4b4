"""Slice plans of recordings: grids, packed turns, task chunks and call batches.

Plans are sequential: where a slice begins depends on where the last one ended. Each
recording's distinct points of time are gathered as one array (turns that start in the
same millisecond are one turn with the latest end, so the array is bounded by the length
of the recording) and planned in an Arrow-batched function; recordings are independent.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .periods import rounded_ms

Span = tuple[int, int]


def grid(low: int, high: int, pauses: Sequence[int], nominal: int, least: int, most: int, snap: int) -> list[Span]:
    """Tiles of [low, high): each end goes to the pause nearest to the nominal length, the
    earlier of two, if it is within ``snap`` and the tile stays within [least, most]. A last
    tile under ``least`` joins the one before it if both fit in ``most``."""
    out: list[Span] = []
    points = sorted(pauses)
    at = low
    while high - at > nominal:
        target = at + nominal
        low_, high_ = max(target - snap, at + least), min(target + snap, at + most)
        near = points[bisect_left(points, low_) : bisect_right(points, high_)]
        end = min(near, key=lambda p: (abs(p - target), p)) if near else target
        if end >= high:
            break
        out.append((at, end))
        at = end
    if high > at:
        if out and high - at < least and high - out[-1][0] <= most:
            out[-1] = (out[-1][0], high)
        else:
            out.append((at, high))
    return out


def packed(turns: Sequence[Span], low: int, high: int, nominal: int, least: int, most: int, push: int) -> list[Span]:
    """Consecutive turns as slices of at most ``most``, closed from ``nominal`` on; a longer
    turn is tiled. Gaps between slices are shared at their middle as far as lengths allow, and
    the first and last slice reach out by up to ``push`` within [low, high]."""
    slices: list[list[int]] = []
    open_ = False
    for s, e in turns:
        if e - s > most:
            slices += [list(x) for x in grid(s, e, (), nominal, least, most, 0)]
            open_ = False
        elif open_ and e - slices[-1][0] <= most and slices[-1][1] - slices[-1][0] < nominal:
            slices[-1][1] = max(slices[-1][1], e)
        else:
            slices.append([s, e])
            open_ = True
    for a, b in zip(slices, slices[1:]):
        if a[1] < b[0]:
            middle = (a[1] + b[0]) // 2
            a[1] = max(a[1], min(middle, a[0] + most))
            b[0] = min(b[0], max(middle, b[1] - most))
        elif a[1] > b[0]:
            b[0] = min(a[1], b[1])
    slices = [x for x in slices if x[1] > x[0]]
    if slices:
        slices[0][0] = max(low, slices[0][0] - push, slices[0][1] - most)
        slices[-1][1] = max(slices[-1][1], min(high, slices[-1][1] + push, slices[-1][0] + most))
    return [(a, b) for a, b in slices]


def chunked(turns: Sequence[Span], target: int, least: int, most: int, marks: Sequence[int] = ()) -> list[Span]:
    """Chunks of whole turns (in order of their starts). A turn that reaches ``target`` from the
    start of the open chunk closes it, but for the last turn of all:

    * at the topic mark nearest to the target, the earlier of two, out of those after the
      chunk's start, up to the turn's end and within ``most``; turns that begin before the
      mark belong to the chunk, one at least;
    * else at the turn's end, if that is within ``most``;
    * else at the end of the turn before, or, where the turn is the chunk's first, at its own
      end: turns are never split.

    The next chunk starts where the last one ends. A last chunk under ``least`` joins the one
    before it."""
    out: list[Span] = []
    if not turns:
        return out
    low, first, i = turns[0][0], 0, 0
    while i < len(turns) - 1:
        end = turns[i][1]
        if end - low < target:
            i += 1
            continue
        near = [x for x in marks if low < x <= min(end, low + most)]
        if near:
            cut = min(near, key=lambda x: (abs(x - low - target), x))
            last = first
            while last < i and turns[last + 1][0] < cut:
                last += 1
        elif end <= low + most or i == first:
            cut, last = end, i
        else:
            cut, last = turns[i - 1][1], i - 1
        out.append((low, cut))
        low, first, i = cut, last + 1, last + 1
    if first < len(turns):
        out.append((low, max(e for _, e in turns)))
    if len(out) > 1 and out[-1][1] - out[-1][0] < least:
        (_, end), (start, _) = out.pop(), out.pop()
        out.append((start, end))
    return out


def next_fit(costs: Sequence[float], cap: float) -> list[int]:
    """Bin of each cost in order: a cost that does not fit the open bin opens the next. A cost
    over the cap is refused."""
    bins, used, out = 0, 0.0, []
    for c in costs:
        if c > cap:
            raise ValueError(f"{c} is over the cap of {cap}")
        if used + c > cap:
            bins, used = bins + 1, 0.0
        used += c
        out.append(bins)
    return out


def next_fit_batches(items: DataFrame, group: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Adds ``batch``: items of a group, in order, in batches whose cost stays within the cap. An
    item that does not fit the open batch opens the next; one over the cap makes the read
    fail. Null costs are 0.

    Where a batch begins depends on all before it, so a group is folded in one place: groups
    are plans of work, one entry a request, and only order and cost are gathered."""
    rest = [x for x in items.columns if x not in group]
    rows = items.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*rest).alias("_row")))).alias("_all"))
    spent = lambda x: F.coalesce(x["_row"][cost].cast("double"), F.lit(0.0))
    start = F.struct(F.lit(0).alias("bin"), F.lit(0.0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        c = F.when(
            spent(x) > cap, F.raise_error(F.concat(F.lit("an item is over the cap: "), spent(x).cast("string"))).cast("double"),
        ).otherwise(spent(x))
        full = s["used"] + c > cap
        b = F.when(full, s["bin"] + 1).otherwise(s["bin"])
        return F.struct(b.alias("bin"), F.when(full, c).otherwise(s["used"] + c).alias("used"), F.concat(s["out"], F.array(b)).alias("out"))

    rows = rows.withColumn("_bins", F.aggregate("_all", start, step)["out"])
    pairs = F.explode(F.arrays_zip(F.col("_all").alias("a"), F.col("_bins").alias("b"))).alias("_x")
    return rows.select(*group, pairs).select(*group, F.col("_x.a._row.*"), F.col("_x.b").alias("batch"))


_SPANS = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))


def _planner(plan: Callable[..., list[Span]], marked: bool):
    cut = lambda own, *rest: [{"s": a, "e": b} for a, b in plan(sorted((t["s"], t["e"]) for t in own), *rest)]

    @F.pandas_udf(_SPANS)
    def spans(turns: pd.Series, lengths: pd.Series) -> pd.Series:
        return pd.Series([cut(own, int(n)) for own, n in zip(turns, lengths)])

    @F.pandas_udf(_SPANS)
    def with_marks(turns: pd.Series, lengths: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([cut(own, int(n), sorted(m) if m is not None else ()) for own, n, m in zip(turns, lengths, marks)])

    return with_marks if marked else spans


def plan_turns(turns: DataFrame, plan: Callable[..., list[Span]], marks: DataFrame | None = None) -> DataFrame:
    """Slices of each dialogue of runtime_turns: uniq_id, slice_no, start_ms, end_ms."""
    ms = turns.select("uniq_id", rounded_ms(F.col("start_s")).alias("s"), rounded_ms(F.col("end_s")).alias("e")).where("s < e")
    own = ms.groupBy("uniq_id", "s").agg(F.max("e").alias("e")).groupBy("uniq_id").agg(
        F.collect_list(F.struct("s", "e")).alias("t"), F.max("e").alias("length"),
    )
    arguments = ["t", "length"]
    if marks is not None:
        own = own.join(
            marks.where("at_ms is not null").groupBy("uniq_id").agg(F.collect_set(F.col("at_ms").cast("long")).alias("m")), "uniq_id",
            "left",
        )
        arguments.append("m")
    rows = own.select("uniq_id", F.posexplode(_planner(plan, marks is not None)(*arguments)).alias("slice_no", "x"))
    return rows.select("uniq_id", "slice_no", F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"))


def turn_slices(turns: DataFrame) -> DataFrame:
    return plan_turns(turns, lambda t, n: packed(t, 0, n, 90_000, 60_000, 120_000, 3_000))


def task_chunks(turns: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """Task chunks of each dialogue; ``marks`` (uniq_id, at_ms): its topic marks, if any."""
    return plan_turns(turns, lambda t, n, m=(): chunked(t, 360_000, 180_000, 900_000, m), marks)


def pause_grid(turns: DataFrame) -> DataFrame:
    """A grid over each dialogue that snaps to starts and ends of silences of a second."""

    def plan(t: list[Span], n: int) -> list[Span]:
        pauses, reach = [], t[0][1]
        for s, e in t[1:]:
            if s - reach >= 1_000:
                pauses += [reach, s]
            reach = max(reach, e)
        return grid(0, n, pauses, 90_000, 60_000, 120_000, 3_000)

    return plan_turns(turns, plan)

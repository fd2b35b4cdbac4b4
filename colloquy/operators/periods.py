"""Continuous periods and gaps of overlapping integer intervals, by dyadic blocks.

The time axis of each key is cut into aligned tiles of 2**TILE_BITS units. Every interval
is clipped to its tiles (long ones into aligned tile ranges, see below), and inside each
tile the interval set becomes canonical dyadic blocks; blocks under an ancestor are
removed, sibling pairs merge upward, adjacent blocks coalesce into runs. Only the first
and last run of each tile, at most two rows a tile, go on to be joined across tiles.

A group handed to one task is one tile of one key. Before it is gathered, rows with the
same start keep only their latest end, so it holds at most 2**TILE_BITS rows however many
rows the key has: a hot key spreads over all its tiles.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

TILE_BITS = 20
_SHIFT = TILE_BITS + 1
_MASK = (1 << _SHIFT) - 1


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting, as hashing is slower here)."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among the sorted ``known``."""
    at = np.searchsorted(known, x)
    at[at == len(known)] = 0
    return known[at] == x


def dyadic_runs(start: np.ndarray, end: np.ndarray, bits: int = TILE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Runs covered by the half-open intervals [start, end), none of which crosses a
    multiple of 2**bits. Runs are sorted and broken at multiples of 2**bits."""
    none = np.empty(0, np.int64)
    blocks: list[np.ndarray] = []
    for level in range(bits + 1):
        low, high = -((-start) >> level), end >> level
        open_ = low < high
        if level == bits:
            blocks.append(_distinct(low[open_]))
        else:
            blocks.append(
                _distinct(np.concatenate([low[open_ & (low & 1 == 1)], high[open_ & (high & 1 == 1)] - 1])) if open_.any() else none
            )
    # a block under an ancestor adds nothing
    for level in range(bits):
        for above in range(level + 1, bits + 1):
            if len(blocks[level]) and len(blocks[above]):
                blocks[level] = blocks[level][~_among(blocks[level] >> (above - level), blocks[above])]
    # two siblings are their parent
    for level in range(bits):
        own = blocks[level]
        if len(own) > 1:
            first = np.flatnonzero((own[:-1] & 1 == 0) & (own[1:] == own[:-1] + 1))
            if len(first):
                keep = np.ones(len(own), bool)
                keep[first] = keep[first + 1] = False
                blocks[level] = own[keep]
                blocks[level + 1] = _distinct(np.concatenate([blocks[level + 1], own[first] >> 1]))
    low = np.concatenate([b << level for level, b in enumerate(blocks)])
    high = np.concatenate([(b + 1) << level for level, b in enumerate(blocks)])
    order = np.argsort(low, kind="stable")
    low, high = low[order], high[order]
    if not len(low):
        return none, none
    fresh = np.ones(len(low), bool)
    fresh[1:] = (low[1:] != high[:-1]) | (low[1:] >> bits != low[:-1] >> bits)
    at = np.flatnonzero(fresh)
    return low[at], high[np.append(at[1:], len(low)) - 1]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _tile_runs(spans: pa.Array) -> pa.Array:
    """Per tile: spans and runs are numbers start << _SHIFT | end, local to the tile."""
    sizes = np.diff(spans.offsets.to_numpy())
    flat = spans.flatten().to_numpy(zero_copy_only=False)
    base = np.repeat(np.arange(len(spans), dtype=np.int64) << TILE_BITS, sizes)
    low, high = dyadic_runs(base + (flat >> _SHIFT), base + (flat & _MASK))
    tile = low >> TILE_BITS
    local = tile << TILE_BITS
    packed = (low - local) << _SHIFT | (high - local)
    offsets = np.searchsorted(tile, np.arange(len(spans) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(packed))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Continuous periods of ``[start, end)`` per ``keys``, and the gaps between them.

    ``start`` and ``end`` are BIGINT columns. Result: the keys, ``kind`` (``period`` or
    ``gap``), ``start`` and ``end``. Touching intervals are one period. Rows with a null
    bound or an end not after the start are ignored; null keys form a group of their own;
    repeated rows change nothing; an empty table gives an empty result. Other columns of
    ``df`` are not read, whatever their names.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    low, high = F.col("_s"), F.col("_e")
    spans = (
        df.select(*[df[k].alias(n) for k, n in zip(keys, names)], df[start].cast("long").alias("_s"), df[end].cast("long").alias("_e"))
        .where(low < high)
        .withColumn("_first", F.shiftright(low, TILE_BITS))
        .withColumn("_last", F.shiftright(high - 1, TILE_BITS))
    )
    # Clip: the tile of the start and that of the end get the partial spans, whole tiles
    # between them stay one aligned span, so a very long interval is not blown up.
    one = F.lit(1).cast("long")
    edge = lambda t: F.shiftleft(t, TILE_BITS)
    part = F.when(
        F.col("_first") == F.col("_last"),
        F.array(F.struct(F.col("_first").alias("t"), (low - edge(F.col("_first"))).alias("s"), (high - edge(F.col("_first"))).alias("e"))),
    ).otherwise(
        F.array(
            F.struct(F.col("_first").alias("t"), (low - edge(F.col("_first"))).alias("s"), F.lit(1 << TILE_BITS).cast("long").alias("e")),
            F.struct(F.col("_last").alias("t"), F.lit(0).cast("long").alias("s"), (high - edge(F.col("_last"))).alias("e")),
        )
    )
    tiles = (
        spans.select(*names, F.explode(part).alias("p"))
        .groupBy(*names, F.col("p.t").alias("_t"), F.col("p.s").alias("_s"))
        .agg(F.max("p.e").alias("_e"))
        .groupBy(*names, "_t")
        .agg(F.collect_list(F.shiftleft(low, _SHIFT).bitwiseOR(high)).alias("_spans"))
        .select(*names, "_t", _tile_runs("_spans").alias("_runs"))
    )
    tiles = cut_lineage(tiles)  # read several times below, made once
    # Tiles wholly inside a long interval: aligned spans, by tile number.
    whole = (
        spans.where(F.col("_last") - F.col("_first") > 1)
        .groupBy(*names, (F.col("_first") + one).alias("_t"))
        .agg(F.max("_last").alias("_until"))
    )
    inside = whole.select(*[F.col(n).alias(f"{n}_w") for n in names], F.col("_t").alias("_w"), "_until")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_w"))
    tiles = tiles.join(inside, same & (F.col("_t") >= F.col("_w")) & (F.col("_t") < F.col("_until")), "left_anti")

    def run(x: Column, t: Column) -> Column:
        return F.struct((edge(t) + F.shiftright(x, _SHIFT)).alias("s"), (edge(t) + x.bitwiseAND(F.lit(_MASK).cast("long"))).alias("e"))

    runs = tiles.select(*names, "_t", F.transform("_runs", lambda x: run(x, F.col("_t"))).alias("_runs"), F.size("_runs").alias("_n"))
    kind = lambda k, s, e: F.struct(F.lit(k).alias("kind"), s.alias("s"), e.alias("e"))
    inner = F.concat(
        F.when(
            F.col("_n") > 2,
            F.transform(F.slice("_runs", F.lit(2), F.greatest(F.col("_n") - 2, F.lit(0))), lambda r: kind("period", r["s"], r["e"])),
        ).otherwise(F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>")),
        F.when(
            F.col("_n") > 1,
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.col("_n") - 2, F.lit(0))),
                lambda i: kind("gap", F.get(F.col("_runs"), i)["e"], F.get(F.col("_runs"), i + 1)["s"]),
            ),
        ).otherwise(F.array().cast("array<struct<kind:string,s:bigint,e:bigint>>")),
    )
    # edges: the first and last run of each tile, and the aligned spans
    first_last = F.when(F.col("_n") > 1, F.array(F.element_at("_runs", 1), F.element_at("_runs", -1))).otherwise(F.col("_runs"))
    rows = runs.where("_n > 1").select(*names, F.inline(inner))
    edges = runs.select(*names, "_t", F.inline(first_last)).unionByName(
        whole.select(*names, F.lit(None).cast("long").alias("_t"), edge(F.col("_t")).alias("s"), edge(F.col("_until")).alias("e"))
    )
    order = Window.partitionBy(*names).orderBy("s", F.col("e").desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_reach", F.max("e").over(before)).withColumn("_t0", F.lag("_t").over(order))
    edges = edges.withColumn("_new", F.col("_reach").isNull() | (F.col("_reach") < F.col("s"))).withColumn(
        "_island", F.sum(F.col("_new").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    )
    # A period of the edges and the gap before it, if it isn't one within a tile.
    joined = edges.groupBy(*names, "_island").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.max(F.when(F.col("_new"), F.struct("_reach", "s", "_t", "_t0"))).alias("_f"),
    )
    gap = F.col("_f._reach").isNotNull() & ~F.coalesce(F.col("_f._t") == F.col("_f._t0"), F.lit(False))
    both = F.array(F.when(gap, kind("gap", F.col("_f._reach"), F.col("_f.s"))), kind("period", F.col("s"), F.col("e")))
    crossing = joined.select(*names, F.inline(F.filter(both, lambda x: x.isNotNull())))
    out = rows.unionByName(crossing)
    return out.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "kind", F.col("s").alias("start"), F.col("e").alias("end"))


def rounded_ms(seconds: Column) -> Column:
    """Whole milliseconds of finite seconds, halves away from zero; else null."""
    finite = ~F.isnan(seconds) & (F.abs(seconds) < 9e12)
    return F.when(finite, F.round(seconds * 1000).cast("long"))


def speaking_periods(segments: DataFrame) -> DataFrame:
    """Periods and gaps of diar_segments per meeting, side and speaker, in milliseconds.

    Rows without finite times, with an end not after the start, or whose speaker is null,
    blank or ``<NA>`` do not count; spans that round to nothing have no length and add
    nothing. Columns: kind, meeting_id, side, speaker, start_ms, end_ms.
    """
    named = F.col("speaker").isNotNull() & ~F.trim("speaker").isin("", "<NA>")
    clean = (
        segments.where(named & (F.col("end_s") > F.col("start_s")))
        .select("meeting_id", "side", "speaker", rounded_ms(F.col("start_s")).alias("start_ms"), rounded_ms(F.col("end_s")).alias("end_ms"))
    )
    out = periods_and_gaps(clean, ["meeting_id", "side", "speaker"], "start_ms", "end_ms")
    return out.select("kind", "meeting_id", "side", "speaker", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))

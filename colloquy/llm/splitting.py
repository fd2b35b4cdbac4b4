"""Items over a size limit, cut into pieces at natural boundaries.

A recursive hierarchy of separators cuts an item: long silences, silences, points between
turns, ends of turns while others speak, and in the end the bare clock. A part that is
still too long is cut by the next separator. The parts are then packed greedily into
pieces within the limit, each piece starting with the trailing overlap of the one before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.periods import periods_and_gaps
from ..session import cut_lineage

#: A silence of this many seconds ends a section.
SECTION_SILENCE = 2.0
BOUNDARIES = ("section", "silence", "between_turns", "turn_end", "cut")
#: Profiles are parameters; more rows than this are refused.
MOST_PROFILES = 1_000
_US = 1_000_000


def parts_of(low: int, high: int, cuts: list[np.ndarray], room: int) -> list[tuple[int, int]]:
    """Recursive cutting of [low, high): (end, level) of each part, none longer than room."""
    out: list[tuple[int, int]] = []
    todo = [(low, high, 0, len(BOUNDARIES) - 1)]
    while todo:
        a, b, level, ends_with = todo.pop()
        if b - a <= room:
            out.append((b, ends_with))
            continue
        if level == len(cuts):
            k = -(-(b - a) // room)
            inner = [a + room * i for i in range(1, k)]
            last = len(BOUNDARIES) - 1
        else:
            own = cuts[level]
            inner = own[np.searchsorted(own, a, "right") : np.searchsorted(own, b, "left")].tolist()
            last = level
        edges = [a, *inner, b]
        todo += [(x, y, level if level == len(cuts) else level + 1, last if y != b else ends_with) for x, y in zip(edges, edges[1:])][::-1]
    return out


def pieces_of(low: int, high: int, cuts: list[np.ndarray], most: int, overlap: int, target: int, least: int) -> list[tuple[int, int, int]]:
    """Pieces (start, end, level of the end) of [low, high), each within ``most``; piece
    i + 1 starts ``overlap`` before piece i ends. A piece of at least ``target`` closes at a
    section; a last piece under ``least`` takes from the one before where that stays over it."""
    overlap = min(max(overlap, 0), max(most - 1, 0) // 2)
    parts = parts_of(low, high, cuts, max(most - overlap, 1))
    out: list[tuple[int, int, int]] = []
    start, i = low, 0
    first = 0
    while i < len(parts):
        j = i
        while j + 1 < len(parts) and parts[j + 1][0] - start <= most and not (parts[j][1] == 0 and parts[j][0] - start >= target):
            j += 1
        if j == len(parts) - 1 and out and parts[j][0] - start < least:
            # move the cut before back to where the tail reaches its least length
            for k in range(i - 2, first - 1, -1):
                if parts[k][0] - out[-1][0] < least:
                    break
                if least <= high - (parts[k][0] - overlap) <= most:
                    out[-1] = (out[-1][0], parts[k][0], parts[k][1])
                    start = parts[k][0] - overlap
                    break
        out.append((start, parts[j][0], parts[j][1]))
        first, i = i, j + 1
        start = parts[j][0] - overlap
    return out


_PIECE = T.StructType(
    [
        T.StructField("profile", T.StringType()), T.StructField("turn_index", T.IntegerType()), T.StructField("piece_no", T.IntegerType()),
        T.StructField("start_us", T.LongType()), T.StructField("end_us", T.LongType()), T.StructField("boundary", T.StringType()),
    ]
)


@F.pandas_udf(T.ArrayType(_PIECE))
def _pieces(items: pd.Series, bounds: pd.Series) -> pd.Series:
    """Pieces of the items of a dialogue. Bounds are silences (s, e in half milliseconds) and
    ends of turns (s in milliseconds, no e)."""
    rows = []
    for own, found_bounds in zip(items, bounds):
        found_bounds = found_bounds if found_bounds is not None else []
        pairs = np.array([(q["s"], q["e"]) for q in found_bounds if q["e"] is not None], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0])]
        stops = np.array([q["s"] for q in found_bounds if q["e"] is None], np.int64) * 1000
        # half milliseconds; a gap of one of them is two turns that touch
        length, at = pairs[:, 1] - pairs[:, 0], pairs[:, 0] // 2 * 1000 + (pairs[:, 0] % 2) * 1000
        cuts = [at[length >= SECTION_SILENCE * 2000], at[length > 1], at, np.sort(stops)]
        found = []
        for i in own:
            pieces = pieces_of(i["start_us"], i["end_us"], cuts, i["max_us"], i["overlap_us"], i["target_us"], i["min_us"])
            found += [{"profile": i["profile"], "turn_index": i["turn_index"], "piece_no": k, "start_us": a, "end_us": b, "boundary": BOUNDARIES[level] if k < len(pieces) - 1 else "end"} for k, (a, b, level) in enumerate(pieces)]
        rows.append(found)
    return pd.Series(rows)


def _us(seconds: Column) -> Column:
    return F.round(seconds * _US).cast("long")


def counted_turns(turns: DataFrame) -> DataFrame:
    """Turns with finite times whose end is after the start; repeated rows once."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e9)
    return turns.where(finite("start_s") & finite("end_s") & (F.col("end_s") > F.col("start_s"))).select("uniq_id", "turn_index", "start_s", "end_s").distinct()


def oversized(dialogues: DataFrame, good: DataFrame, limits: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Items over the limit of a profile: uniq_id and ``item``, a struct for ``_pieces``.

    A dialogue is as long as the larger of its duration and the last end of its turns; a
    turn lasts end_s - start_s. An excess under a microsecond is none. Null and non-finite
    durations say nothing; a turn of an unlisted dialogue counts for itself. ``good`` are the
    counted turns.
    """
    duration = F.when(~F.isnan("duration") & (F.abs("duration") < 1e9), F.col("duration"))
    listed = dialogues.where(F.col("uniq_id").isNotNull()).select("uniq_id", duration.alias("length"), F.lit(True).alias("listed"))
    last = good.groupBy("uniq_id").agg(F.max("end_s").alias("length")).withColumn("listed", F.lit(False))
    whole = listed.unionByName(last).groupBy("uniq_id").agg(
        F.max("length").alias("length"), F.max("listed").alias("listed"),
    ).where("listed")
    items = whole.select(
        "uniq_id", F.lit(-1).alias("turn_index"), F.lit(0.0).alias("start_s"), F.col("length").alias("end_s"),
    ).unionByName(good)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(t).alias("target"), F.lit(a).alias("least"), F.lit(b).alias("most"), F.lit(o).alias("overlap")) for p, t, a, b, o in limits]))
    items = items.select("*", each.alias("l")).where(F.floor((F.col("end_s") - F.col("start_s") - F.col("l.most")) * _US + 1e-3) >= 1)
    start = _us(F.col("start_s"))
    item = F.struct(
        F.col("l.profile").alias("profile"), F.col("turn_index").cast("int").alias("turn_index"), start.alias("start_us"),
        F.greatest(_us(F.col("end_s")), start + _us(F.col("l.most")) + 1).alias("end_us"), _us(F.col("l.most")).alias("max_us"),
        _us(F.col("l.overlap")).alias("overlap_us"),
        _us(F.col("l.target")).alias("target_us"), _us(F.col("l.least")).alias("min_us"),
    )
    return items.select("uniq_id", item.alias("item")).distinct()


def profile_limits(piece_limits: DataFrame) -> list[tuple[str, float, float, float, float]]:
    """The profiles as parameters (a fixed table); rows without a positive max_s are none."""
    rows = piece_limits.where("profile is not null and max_s > 0").select("profile", "target_s", "min_s", "max_s", "overlap_s").distinct().limit(MOST_PROFILES + 1).collect()
    if len(rows) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles")
    number = lambda x, d: d if x is None or x != x else float(x)
    return [(r[0], number(r[1], r[3]), number(r[2], 0.0), float(r[3]), number(r[4], 0.0)) for r in rows]


def split_oversized(dialogues: DataFrame, turns: DataFrame, piece_limits: DataFrame) -> DataFrame:
    """Pieces of all oversized dialogues (turn_index -1) and turns: profile, uniq_id,
    turn_index, piece_no from 0, start_s, end_s, boundary (how the piece ends).

    The boundaries of a dialogue are gathered for one task. They are distinct points of
    time in whole milliseconds, so their number is bounded by the recording's length,
    whatever the number of rows: silences come from the tiled period operator, and repeated
    turn ends count once. No items, no pieces; empty tables give an empty result.
    """
    limits = profile_limits(piece_limits)
    schema = "profile STRING, uniq_id STRING, turn_index INT, piece_no INT, start_s DOUBLE, end_s DOUBLE, boundary STRING"
    if not limits:
        return dialogues.sparkSession.createDataFrame([], schema)
    good = cut_lineage(counted_turns(turns))  # read for the items, the silences and the ends
    items = cut_lineage(oversized(dialogues, good, limits).groupBy("uniq_id").agg(F.collect_list("item").alias("items")))
    own = good.join(items.select("uniq_id"), "uniq_id", "left_semi")
    # Doubled milliseconds less one: turns that touch leave a gap of one half.
    half = own.select(
        "uniq_id", (F.floor(F.col("start_s") * 1000) * 2).cast("long").alias("s"),
        (F.ceil(F.col("end_s") * 1000) * 2 - 1).cast("long").alias("e"),
    )
    silences = periods_and_gaps(half, ["uniq_id"], "s", "e").where("kind = 'gap'").select(
        "uniq_id", F.col("start").alias("s"), F.col("end").alias("e"),
    )
    ends = own.select("uniq_id", F.ceil(F.col("end_s") * 1000).cast("long").alias("s"), F.lit(None).cast("long").alias("e")).distinct()
    bounds = silences.unionByName(ends).groupBy("uniq_id").agg(F.collect_list(F.struct("s", "e")).alias("bounds"))
    rows = items.join(bounds, "uniq_id", "left")
    out = rows.select("uniq_id", F.explode(_pieces("items", "bounds")).alias("p"))
    return out.select(
        "p.profile", "uniq_id", "p.turn_index", "p.piece_no", (F.col("p.start_us") / _US).alias("start_s"),
        (F.col("p.end_us") / _US).alias("end_s"), "p.boundary",
    )


def piece_faults(pieces: DataFrame, limits: DataFrame) -> DataFrame:
    """Per profile what is wrong with pieces: items, pieces over max_s, pairs of neighbours whose
    overlap is not overlap_s (or, where that leaves no room, half of max_s at most), pieces
    that do not advance, and items whose numbers have a gap."""
    order = Window.partitionBy("profile", "uniq_id", "turn_index").orderBy("piece_no")
    rows = pieces.join(limits.select("profile", "max_s", "overlap_s"), "profile")
    us = lambda c: F.round(F.col(c) * _US).cast("long")
    before = F.lag(us("end_s")).over(order)
    overlap = F.least(F.greatest(us("overlap_s"), F.lit(0)), F.floor((us("max_s") - 1) / 2))
    rows = rows.select(
        "profile", (F.col("piece_no") == 0).alias("first"), (us("end_s") - us("start_s") > us("max_s")).alias("long"),
        F.coalesce(before - us("start_s") != overlap, F.lit(False)).alias("off"),
        F.coalesce(us("end_s") <= before, F.lit(False)).alias("back"), (F.row_number().over(order) - 1 != F.col("piece_no")).alias("gap"),
    )
    return rows.groupBy("profile").agg(*[F.count_if(a).alias(b) for a, b in (("first", "items"), ("long", "too_long"), ("off", "wrong_overlap"), ("back", "not_advancing"), ("gap", "misnumbered"))])

"""Joins of intervals and points of time: overlap, containment and nearest neighbour.

All joins have an equality key and a time bucket, so none becomes a Cartesian product and
a busy key is spread over its buckets. Times are BIGINT (milliseconds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Buckets an interval of one level covers, at most; a longer one is of the next level, whose
#: buckets are so many times wider.
LEVEL = 1 << 12


def _buckets(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    """Adds the level of each interval, 0 to 2, as ``<name>l``."""
    covers = F.floor((F.col(end) - 1) / width) - F.floor(F.col(start) / width)
    level = F.when(covers < LEVEL, 0).when(covers < LEVEL * LEVEL, 1).otherwise(2)
    return df.where(F.col(start) < F.col(end)).withColumn(f"{name}l", level)


def _exploded(df: DataFrame, start: str, end: str, width: int, name: str) -> DataFrame:
    low, high = F.floor(F.col(start) / width).cast("long"), F.floor((F.col(end) - 1) / width).cast("long")
    return df.withColumn(name, F.explode(F.sequence(low, F.greatest(low, high))))


def overlap_join(
    left: DataFrame, right: DataFrame, key: str, width: int = 30_000, names: tuple[str, str, str, str] = ("s", "e", "s2", "e2"),
) -> DataFrame:
    """Pairs of half-open intervals of one key that share more than a point.

    ``left`` has key, s and e, ``right`` key, s2 and e2, both any further columns (of
    different names). Each pair comes once: in the bucket in which the later one starts.
    Null keys match nothing; empty and reversed intervals match nothing. Very long intervals
    are joined in wider buckets, so that none becomes more than LEVEL rows. Both sides are read
    twice: materialise what is dear.
    """
    s, e, s2, e2 = names
    a, b = _buckets(left, s, e, width, "_b"), _buckets(right, s2, e2, width, "_c").withColumnRenamed(key, "_key2")

    def of(level: int) -> DataFrame:
        """Pairs the longer of which is of a level."""
        wide = width * LEVEL**level
        x, y = a.where(F.col("_bl") <= level), b.where(F.col("_cl") <= level)
        if level:  # only keys with an interval of the level
            keys = a.where(F.col("_bl") == level).select(F.col(key).alias("_k")).unionByName(b.where(F.col("_cl") == level).select(F.col("_key2").alias("_k"))).distinct()
            x, y = x.join(keys, F.col(key) == F.col("_k"), "left_semi"), y.join(keys, F.col("_key2") == F.col("_k"), "left_semi")
        met = (F.col(s) < F.col(e2)) & (F.col(s2) < F.col(e)) & (F.col("_b") == F.floor(F.greatest(F.col(s), F.col(s2)) / wide)) & (F.greatest("_bl", "_cl") == level)
        joined = _exploded(x, s, e, wide, "_b").join(
            _exploded(y, s2, e2, wide, "_c"), (F.col(key) == F.col("_key2")) & (F.col("_b") == F.col("_c")) & met,
        )
        return joined.drop("_b", "_c", "_bl", "_cl", "_key2")

    # one small job says which levels there are: nearly always the first one only
    levels = {r[0] for r in a.select("_bl").unionByName(b.select(F.col("_cl").alias("_bl"))).distinct().collect()}
    out = of(0)
    for level in sorted(levels - {0}):
        out = out.unionByName(of(level))
    return out


def clipped(rows: DataFrame, names: tuple[str, str, str, str] = ("s", "e", "s2", "e2")) -> DataFrame:
    """Adds the common part of two overlapping intervals as ``cs``, ``ce``, and its offsets
    from the start of the left one as ``offset_s``, ``offset_e``; own times stay."""
    s, e, s2, e2 = names
    rows = rows.withColumn("cs", F.greatest(s, s2)).withColumn("ce", F.least(e, e2))
    return rows.withColumn("offset_s", F.col("cs") - F.col(s)).withColumn("offset_e", F.col("ce") - F.col(s))


def nearest(points: DataFrame, others: DataFrame, key: str, at: str, tile: int = 600_000) -> DataFrame:
    """For each of ``points`` (key, at) the distance to the nearest of ``others`` (key, at) of
    the key, null if there is none: key, at, distance. Repeated points come once.

    Two as-of passes, each within a tile of time; from outside the tile only the last other
    point before it and the first after it matter, one row a tile.
    """
    tagged = points.select(key, at, F.lit(1).alias("p")).distinct().unionByName(others.select(key, at, F.lit(0).alias("p")).distinct())
    tagged = tagged.where(F.col(at).isNotNull()).groupBy(key, at).agg(F.max("p").alias("p"), F.max(1 - F.col("p")).alias("o")).withColumn("_t", F.floor(F.col(at) / tile).cast("long"))
    other = F.when(F.col("o") == 1, F.col(at))
    ends = tagged.groupBy(key, "_t").agg(F.max(other).alias("_last"), F.min(other).alias("_first"))
    # Frames grow from the start, forwards and backwards: one that shrinks towards the end is
    # summed up anew for each row.
    tiles = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_last", True).over(tiles.orderBy("_t"))).withColumn(
        "_after", F.last("_first", True).over(tiles.orderBy(F.col("_t").desc())),
    )
    own = Window.partitionBy(key, "_t").rowsBetween(Window.unboundedPreceding, 0)
    rows = tagged.withColumn("_lo", F.last(other, True).over(own.orderBy(at))).withColumn(
        "_hi", F.last(other, True).over(own.orderBy(F.col(at).desc())),
    )
    rows = rows.where("p = 1").join(
        ends.select(F.col(key).alias("_k"), F.col("_t").alias("_t2"), "_before", "_after"),
        F.col(key).eqNullSafe(F.col("_k")) & (F.col("_t") == F.col("_t2")),
    )
    low, high = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    return rows.select(key, at, F.least(F.col(at) - low, high - F.col(at)).alias("distance"))


def containing(points: DataFrame, spans: DataFrame, key: str, at: str, clamp_first: bool = True) -> DataFrame:
    """Index of the span (key, idx, s, e; disjoint, half-open) that holds each point. A point
    after the last span has the last; one before the first has the first, or, with
    ``clamp_first`` off, the last too. Points of keys without spans keep a null."""
    inside = overlap_join(
        points.withColumn("_s", F.col(at)).withColumn("_e", F.col(at) + 1),
        spans.withColumnRenamed("s", "_s2").withColumnRenamed("e", "_e2"), key, names=("_s", "_e", "_s2", "_e2"),
    )
    inside = inside.select(*[F.col(c) for c in points.columns], "idx")
    limits = spans.groupBy(key).agg(F.min("s").alias("_low"), F.min_by("idx", "s").alias("_first"), F.max_by("idx", "s").alias("_end"))
    same = [points[c].eqNullSafe(inside[c]) for c in points.columns]
    missing = points.join(inside, _all(same), "left_anti").join(limits, key, "left")
    fallback = F.when(F.lit(clamp_first) & (F.col(at) < F.col("_low")), F.col("_first")).otherwise(F.col("_end"))
    return inside.unionByName(missing.select(*points.columns, fallback.alias("idx")))


def _all(conditions: list[Column]) -> Column:
    whole = F.lit(True)
    for c in conditions:
        whole = whole & c
    return whole


def stream_faults(rows: DataFrame, stream: str, speaker: str, ordinal: str, start: str, end: str) -> DataFrame:
    """Per stream whether its times can be used: rows, ``all_zero``, ``one_pair`` (more than one
    row, all the same times), ``reversed`` and ``disordered`` (a speaker's start before the
    one above it in input order), and ``valid``."""
    before = F.lag(start).over(Window.partitionBy(stream, speaker).orderBy(ordinal))
    marked = rows.withColumn("_down", F.coalesce(F.col(start) < before, F.lit(False)))
    pair = F.struct(start, end)
    out = marked.groupBy(stream).agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bool_and((F.col(start) == 0) & (F.col(end) == 0)), F.lit(False)).alias("all_zero"),
        ((F.count(F.lit(1)) > 1) & (F.min(pair) == F.max(pair))).alias("one_pair"),
        F.coalesce(F.bool_or(F.col(end) < F.col(start)), F.lit(False)).alias("reversed"), F.bool_or("_down").alias("disordered"),
    )
    return out.withColumn("valid", ~(F.col("all_zero") | F.col("one_pair") | F.col("reversed") | F.col("disordered")))

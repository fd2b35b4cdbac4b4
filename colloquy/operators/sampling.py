"""Deterministic samples, permutations, splits and ranked prefixes, by hash order.

Draws are hashes of seed and identifier, so they do not depend on partitioning or order.
Orders of a group are made in two steps: the digest's first signs cut a group into 4,096
buckets, which are ordered on their own, and one row a bucket is ordered in the group. So a
group with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, identifier: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), identifier.cast("string")))


def capped(df: DataFrame, identifier: str, seed: str, most: int) -> DataFrame:
    """The ``most`` rows that come first in hash order (a top-k, not a sort of all)."""
    return df.withColumn("_d", draw(seed, F.col(identifier))).orderBy("_d", identifier).limit(most).drop("_d")


def hashed_head(df: DataFrame, column: str, most: int, rows: int) -> DataFrame:
    """The ``most`` distinct values of a column with the least hashes, out of about ``rows``.

    A threshold on the hash leaves some twice as many before anything is shuffled or sorted,
    so that no partition sends its own ``most`` values to the driver, and repeated values do
    not crowd out others. Of much repeated columns the result may be smaller."""
    scale = 1 << 20
    share = min(scale, -(-2 * most * scale // max(rows, 1)))
    digest = F.xxhash64(F.lit("head"), F.col(column))
    return df.where(F.pmod(digest, F.lit(scale)) < share).select(column).distinct().orderBy(digest, column).limit(most)


def _cut(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_b", F.substring("_d", 1, 3))


def _beside(rows: DataFrame, summary: DataFrame, within: list[str]) -> DataFrame:
    """Rows with the columns of a summary by ``within`` and bucket; null groups are groups."""
    there = summary.select(*[F.col(c).alias(f"_s_{c}") for c in [*within, "_b"]], *[c for c in summary.columns if c not in (*within, "_b")])
    same = F.col("_b") == F.col("_s__b")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return rows.join(there, same).drop(*[f"_s_{c}" for c in [*within, "_b"]])


def _group(within: list[str]) -> list:
    return [F.col(c) for c in within] or [F.lit(0)]


def derangement(ids: DataFrame, identifier: str, seed: str, within: list[str]) -> DataFrame:
    """A partner for each id that is not itself: the next in hash order of its group, the
    first for the last. Groups of one have no partner (null)."""
    rows = _cut(ids.select(*within, identifier).distinct().withColumn("_d", draw(seed, F.col(identifier))))
    firsts = rows.groupBy(*within, "_b").agg(F.min_by(identifier, F.struct("_d", identifier)).alias("_first"))
    along = Window.partitionBy(*_group(within)).orderBy("_b")
    firsts = firsts.select(*within, "_b", F.coalesce(F.lead("_first").over(along), F.first("_first").over(along)).alias("_then"))
    own = Window.partitionBy(*within, "_b").orderBy("_d", identifier)
    rows = _beside(rows.withColumn("_next", F.lead(identifier).over(own)), firsts, within)
    partner = F.coalesce("_next", "_then")
    return rows.select(*within, identifier, F.when(partner != F.col(identifier), partner).alias("partner"))


def round_robin(df: DataFrame, identifier: str, stratum: str, seed: str, most: int) -> DataFrame:
    """Strata in turn, ids of a stratum in hash order; the first ``most``, ``turn`` from 1."""
    digest = lambda c: F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)
    rows = _cut(df.withColumn("_d", digest(F.col(identifier))))
    along = Window.partitionBy(stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_n"))
    bases = bases.select(stratum, "_b", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base")).where(F.col("_base") < most)  # later buckets have no turn
    own = Window.partitionBy(stratum, "_b").orderBy("_d", identifier)
    rows = _beside(rows, bases, [stratum]).withColumn(
        "turn", (F.col("_base") + F.row_number().over(own)).cast("int"),
    ).where(F.col("turn") <= most)
    return rows.withColumn("_g", digest(F.coalesce(F.col(stratum), F.lit("")))).orderBy("turn", "_g", identifier).limit(most).drop("_d", "_g", "_b", "_base")


def prefix_of_mass(df: DataFrame, identifier: str, mass: str, target: float, seed: str, within: list[str]) -> DataFrame:
    """Per group, the shortest prefix in hash order whose mass reaches ``target``; all of a
    group whose mass does not."""
    rows = _cut(df.withColumn("_d", draw(seed, F.col(identifier))))
    along = Window.partitionBy(*_group(within)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy(*within, "_b").agg(F.sum(mass).alias("_m"))
    bases = bases.select(*within, "_b", F.coalesce(F.sum("_m").over(along), F.lit(0)).alias("_base")).where(F.col("_base") < target)
    own = Window.partitionBy(*within, "_b").orderBy("_d", identifier).rowsBetween(Window.unboundedPreceding, 0)
    rows = _beside(rows, bases, within).withColumn("upto", F.col("_base") + F.sum(mass).over(own))
    return rows.where(F.col("upto") - F.col(mass) < target).drop("_d", "_b", "_base")


def ranked_split(df: DataFrame, identifier: str, salt: str, sizes: dict[str, int]) -> DataFrame:
    """Ids into named parts of given sizes in the order of a salted hash (NUL between salt
    and id); what is over goes to ``rest``. Only the ids of the parts are ranked."""
    whole = sum(sizes.values())
    key = F.sha2(F.concat(F.lit(salt + "\x00"), F.col(identifier).cast("string")), 256)
    ids = df.select(identifier).where(F.col(identifier).isNotNull()).distinct().withColumn("_k", key)
    head = ids.orderBy("_k", identifier).limit(whole)
    head = head.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_k", identifier)))  # `whole` rows
    part, upto = None, 0
    for name, n in sizes.items():
        upto += n
        inside = F.col("rank") <= upto
        part = F.when(inside, F.lit(name)) if part is None else part.when(inside, F.lit(name))
    named = head.select(F.col(identifier).alias("_id"), part.alias("_part"))
    return ids.join(named, F.col(identifier) == F.col("_id"), "left").select(identifier, F.coalesce("_part", F.lit("rest")).alias("part"))


def last_rows(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each group; ``place`` counts backwards from 1."""
    window = Window.partitionBy(group).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= n)

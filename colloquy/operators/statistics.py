"""Percentile variants, cluster bootstraps and plan arithmetic.

Bootstrap draws are md5 numbers of (seed, replicate, draw), the same in any engine. Only
one row a cluster enters a bootstrap; the replicates are exploded on the cluster side of
an equality join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_draw
from ..session import cut_lineage


def ceil_rank(values: Column, fraction: float) -> Column:
    """Value at rank ceil(fraction * n) of a sorted array."""
    return F.element_at(values, F.greatest(F.ceil(F.size(values) * F.lit(fraction)).cast("int"), F.lit(1)))


def floor_rank(values: Column, fraction: float) -> Column:
    """Value at the 0-based index floor(fraction * n) of a sorted array, at most the last."""
    return F.element_at(values, F.least(F.floor(F.size(values) * F.lit(fraction)).cast("int") + 1, F.size(values)))


def cluster_summary(per_cluster: DataFrame, value: str) -> DataFrame:
    """n, mean, median, 90th percentile by ceiling rank and maximum over clusters. Values are
    counted before they are gathered, so only distinct ones are."""
    counted = per_cluster.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(F.lit(0)).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)  # distinct values
    ranked = counted.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(F.lit(0))))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    n = F.col("n")
    return ranked.groupBy("n").agg(
        F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 6).alias("mean"),
        F.round((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2, 6).alias("median"),
        at(F.ceil(n * 0.9)).alias("p90"), F.max("v").alias("most"),
    )


def numbered(rows: DataFrame, column: str) -> tuple[DataFrame, int]:
    """Rows with ``_i``, their number from 0 in the order of a column, and how many there are.
    Range partitions are numbered on their own; one row a partition gives where each begins."""
    ranged = cut_lineage(rows.repartitionByRange(column).withColumn("_p", F.spark_partition_id()))
    along = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    bases = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_p").orderBy(column)
    placed = ranged.join(bases, F.col("_p") == F.col("_q")).withColumn("_i", F.col("_base") + F.row_number().over(own) - 1)
    return placed.drop("_p", "_q", "_base"), ranged.count()


def bootstrap(clusters: DataFrame, cluster: str, sums: list[str], replicates: int, seed: str) -> DataFrame:
    """Sums of ``sums`` over clusters drawn with replacement, one row a replicate.

    ``clusters`` has one row a cluster, with components already summed. Clusters are numbered
    by their name; each replicate draws as many as there are. Draws are rows of a range, so
    no replicate is gathered."""
    rows, n = numbered(clusters.select(cluster, *sums), cluster)
    draws = clusters.sparkSession.range(replicates * n).select(
        F.floor(F.col("id") / max(n, 1)).alias("r"), (F.col("id") % max(n, 1)).alias("k"),
    )
    drawn = draws.select("r", md5_draw(F.lit(max(n, 1)), F.lit(seed), F.col("r"), F.col("k")).alias("_i"))
    return drawn.join(rows, "_i").groupBy("r").agg(*[F.sum(c).alias(c) for c in sums])


def interval(replicates: DataFrame, value: Column, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Linear-interpolation percentile interval and population deviation of a statistic."""
    v = replicates.select(value.alias("v"))
    return v.agg(
        F.round(F.expr(f"percentile(v, {low})"), 6).alias("low"), F.round(F.expr(f"percentile(v, {high})"), 6).alias("high"),
        F.round(F.stddev_pop("v"), 6).alias("sigma"),
    )


def paired_size(mde: Column, discordance: Column, design: Column, z_alpha: float = 1.959964, z_power: float = 0.841621) -> Column:
    """Mentions a paired-proportion test needs to see a difference of ``mde``."""
    base = (z_alpha * F.sqrt(discordance) + z_power * F.sqrt(discordance - mde * mde)) / mde
    return F.ceil(base * base * design).cast("long")


def orc_bound(utterances: Column, words: Column) -> Column:
    """Cells of an assignment search: utterances times the product of words + 1."""
    return utterances.cast("double") * F.aggregate(words, F.lit(1.0), lambda a, w: a * (w + 1))


def prompt_tokens(seconds: Column) -> Column:
    """Tokens of an audio prompt: 13 a second, a fixed part and four a second of answer."""
    return (F.floor(seconds) * 13 + 950 + F.ceil(seconds * 4)).cast("long")


def device_seconds(wall: Column, utilization: Column) -> Column:
    """Wall seconds times a utilization in percent, within 0 and 100; 0.0 without one."""
    share = F.least(F.greatest(F.coalesce(utilization.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) / 100
    return F.greatest(wall.cast("double"), F.lit(0.0)) * share


def attempt_seconds(attempts: Column) -> Column:
    """Seconds of all attempts (array of structs with ``latency``); nulls add nothing."""
    return F.aggregate(
        F.coalesce(attempts, F.array().cast("array<struct<latency:double>>")), F.lit(0.0),
        lambda n, x: n + F.coalesce(x["latency"].cast("double"), F.lit(0.0)),
    )

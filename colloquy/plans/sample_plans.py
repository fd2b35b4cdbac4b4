"""Queries of samples, splits and ranked prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carry, sampling
from ..session import table
from ..sources import lines
from .registry import Registry

registry = Registry()


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "runtime_dialogues").where("uniq_id is not null").groupBy("uniq_id").agg(
        F.coalesce(F.min("source_tar"), F.lit("")).alias("tar"), F.max("duration").alias("duration"),
    )


_IDS = "i AS (SELECT uniq_id, coalesce(min(source_tar), '') AS tar, max(duration) AS duration FROM runtime_dialogues WHERE uniq_id IS NOT NULL GROUP BY uniq_id)"


@registry.query("capped_sample", f"WITH {_IDS} SELECT uniq_id FROM i ORDER BY md5('cap:' || uniq_id), uniq_id LIMIT 50")
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty dialogues in hash order; the size is what is asked for."""
    return sampling.capped(_ids(spark, sf_dir).select("uniq_id"), "uniq_id", "cap", 50)


@registry.query(
    "deranged",
    f"WITH {_IDS}, o AS (SELECT tar, uniq_id, coalesce(lead(uniq_id) OVER w, first_value(uniq_id) OVER w) AS p FROM i WINDOW w AS (PARTITION BY tar ORDER BY md5('swap:' || uniq_id), uniq_id)) SELECT tar, uniq_id, CASE WHEN p <> uniq_id THEN p END AS partner FROM o",
)
def deranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.derangement(_ids(spark, sf_dir), "uniq_id", "swap", ["tar"])


@registry.query(
    "round_robin",
    f"WITH {_IDS}, r AS (SELECT uniq_id, tar, row_number() OVER (PARTITION BY tar ORDER BY sha256('turn:' || uniq_id), uniq_id) AS turn FROM i) SELECT uniq_id, tar, CAST(turn AS INT) AS turn FROM r ORDER BY r.turn, sha256('turn:' || tar), uniq_id LIMIT 60",
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty dialogues, archives in turn; the size is what is asked for."""
    return sampling.round_robin(_ids(spark, sf_dir).select("uniq_id", "tar"), "uniq_id", "tar", "turn", 60)


@registry.query(
    "prefix_of_mass",
    f"WITH {_IDS}, p AS (SELECT uniq_id, tar, round(duration, 3) AS mass FROM i WHERE duration > 0), r AS (SELECT *, sum(CAST(mass * 1000 AS BIGINT)) OVER (PARTITION BY tar ORDER BY md5('mass:' || uniq_id), uniq_id ROWS UNBOUNDED PRECEDING) AS upto FROM p) SELECT uniq_id, tar, CAST(upto AS BIGINT) AS upto FROM r WHERE upto - CAST(mass * 1000 AS BIGINT) < 1500000",
)
def prefix_of_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per archive the dialogues, in hash order, that make up 25 minutes."""
    rows = _ids(spark, sf_dir).where("duration > 0").select(
        "uniq_id", "tar", F.round(F.round("duration", 3) * 1000).cast("long").alias("mass"),
    )
    return sampling.prefix_of_mass(rows, "uniq_id", "mass", 1_500_000, "mass", ["tar"]).select("uniq_id", "tar", "upto")


@registry.query(
    "ranked_split",
    f"WITH {_IDS}, r AS (SELECT uniq_id, row_number() OVER (ORDER BY sha256('split' || chr(0) || uniq_id), uniq_id) AS n FROM i) SELECT uniq_id, CASE WHEN n <= 80 THEN 'discovery' WHEN n <= 125 THEN 'reserve' ELSE 'rest' END AS part FROM r",
)
def ranked_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.ranked_split(_ids(spark, sf_dir), "uniq_id", "split", {"discovery": 80, "reserve": 45})


@registry.query(
    "last_turns",
    "WITH t AS (SELECT DISTINCT uniq_id, turn_index FROM runtime_turns), r AS (SELECT *, row_number() OVER (PARTITION BY uniq_id ORDER BY turn_index DESC) AS place FROM t) SELECT uniq_id, turn_index, CAST(place AS INT) AS place FROM r WHERE place <= 3",
)
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.last_rows(
        table(spark, sf_dir, "runtime_turns").select("uniq_id", "turn_index").distinct(), "uniq_id", ["turn_index"], 3,
    )


@registry.query(
    "first_listings",
    "WITH f AS (SELECT file_id, min(manifest_batch) AS batch, count(*) AS listed, count(DISTINCT file_path) AS paths FROM earnings22_inputs WHERE file_id IS NOT NULL GROUP BY file_id) SELECT batch, count(*) AS files, count(*) FILTER (WHERE listed > 1) AS relisted, CAST(sum(paths) AS BIGINT) AS paths FROM f GROUP BY batch",
)
def first_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "earnings22_inputs").where("file_id is not null").groupBy("file_id").agg(
        F.min("manifest_batch").alias("batch"), F.count(F.lit(1)).alias("listed"), F.count_distinct("file_path").alias("paths"),
    )
    return per.groupBy("batch").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("listed") > 1).alias("relisted"), F.sum("paths").alias("paths"),
    )


@registry.query(
    "still_to_do",
    "WITH q AS (SELECT DISTINCT uniq_id FROM runtime_dialogues WHERE uniq_id IS NOT NULL) SELECT uniq_id FROM q WHERE uniq_id NOT IN (SELECT uniq_id FROM parse_results WHERE parse_mode = 'strict' AND uniq_id IS NOT NULL)",
)
def still_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues without a reply that was parsed strictly."""
    asked = table(spark, sf_dir, "runtime_dialogues").where("uniq_id is not null").select("uniq_id").distinct()
    replies = table(spark, sf_dir, "parse_results").withColumnRenamed("parse_mode", "outcome")
    return lines.still_to_do(asked, replies, ["uniq_id"], "strict")


@registry.query(
    "last_replies",
    "SELECT uniq_id, arm, arg_max(request_id, (recorded_utc, request_id)) AS request_id, count(*) AS replies FROM parse_results WHERE parse_mode = 'strict' AND recorded_utc IS NOT NULL GROUP BY uniq_id, arm",
)
def last_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parse_results").where("recorded_utc is not null").withColumnRenamed("parse_mode", "outcome")
    last = lines.last_responses(rows, ["uniq_id", "arm"], ["recorded_utc", "request_id"], "strict").select("uniq_id", "arm", "request_id")
    return last.join(rows.where("outcome = 'strict'").groupBy("uniq_id", "arm").agg(F.count(F.lit(1)).alias("replies")), ["uniq_id", "arm"])


@registry.query(
    "superseded_listings",
    """WITH l AS (SELECT uniq_id, manifest_batch AS b FROM runtime_dialogues WHERE uniq_id IS NOT NULL AND manifest_batch IS NOT NULL GROUP BY ALL) SELECT uniq_id || ':' || b AS entry FROM l WHERE (uniq_id, b) IN (SELECT (uniq_id, max(b)) FROM l GROUP BY uniq_id)""",
)
def superseded_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings that no later one of the same dialogue supersedes."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "runtime_dialogues").where("uniq_id is not null and manifest_batch is not null").select("uniq_id", "manifest_batch").distinct()
    entry = lambda b: F.concat("uniq_id", F.lit(":"), b.cast("string"))
    before = F.lag("manifest_batch").over(Window.partitionBy("uniq_id").orderBy("manifest_batch"))
    return carry.active_entries(
        rows.select(entry(F.col("manifest_batch")).alias("entry"), F.when(before.isNotNull(), entry(before)).alias("supersedes"))
    ).select("entry")


@registry.query(
    "hourly_events",
    "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over events: coverage of the event table, the batch twin of the stream."""
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"),
    )
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")

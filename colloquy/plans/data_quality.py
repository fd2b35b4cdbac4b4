"""Queries of the general training-data operators: intervals and redeliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import periods, redelivery
from ..session import table
from .registry import Registry

registry = Registry()

_PERIODS = """
WITH a AS (SELECT DISTINCT meeting_id, side, speaker, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e
           FROM diar_segments WHERE isfinite(start_s) AND isfinite(end_s) AND end_s > start_s AND trim(speaker) NOT IN ('', '<NA>')),
b AS (SELECT * FROM a WHERE e > s),
c AS (SELECT *, max(e) OVER (PARTITION BY meeting_id, side, speaker ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
d AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY meeting_id, side, speaker ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM c),
p AS (SELECT meeting_id, side, speaker, min(s) AS start_ms, max(e) AS end_ms FROM d GROUP BY meeting_id, side, speaker, g),
q AS (SELECT *, lead(start_ms) OVER (PARTITION BY meeting_id, side, speaker ORDER BY start_ms) AS n FROM p),
r AS (SELECT 'period' AS kind, meeting_id, side, speaker, start_ms, end_ms FROM p
      UNION ALL SELECT 'gap', meeting_id, side, speaker, end_ms, n FROM q WHERE n IS NOT NULL)
"""


@registry.query("p2_found", _PERIODS + "SELECT kind, meeting_id, side, speaker, start_ms, end_ms FROM r")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.speaking_periods(table(spark, sf_dir, "diar_segments"))


@registry.query(
    "p2_totals",
    _PERIODS
    + "SELECT meeting_id, side, speaker, count(*) FILTER (WHERE kind = 'period') AS periods, count(*) FILTER (WHERE kind = 'gap') AS gaps, CAST(sum(CASE WHEN kind = 'period' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS speech_ms, "
    "CAST(sum(CASE WHEN kind = 'gap' THEN end_ms - start_ms ELSE 0 END) AS BIGINT) AS gap_ms FROM r GROUP BY meeting_id, side, speaker",
)
def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.speaking_periods(table(spark, sf_dir, "diar_segments"))
    length = F.col("end_ms") - F.col("start_ms")
    return found.groupBy("meeting_id", "side", "speaker").agg(
        F.count_if(F.col("kind") == "period").alias("periods"), F.count_if(F.col("kind") == "gap").alias("gaps"),
        F.sum(F.when(F.col("kind") == "period", length).otherwise(0)).alias("speech_ms"),
        F.sum(F.when(F.col("kind") == "gap", length).otherwise(0)).alias("gap_ms"),
    )


_MESSAGES = """
WITH m AS (SELECT *, lower(trim(target_id, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS t, lower(trim(arm, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS a
           FROM direction_scores WHERE outcome = 'ok'),
k AS (SELECT *, count(*) OVER (PARTITION BY t, a) AS copies,
             row_number() OVER (PARTITION BY t, a ORDER BY delivered_at ASC NULLS LAST, delivery_id) AS n FROM m WHERE t <> '')
"""


@registry.query("p5_found", _MESSAGES + "SELECT t AS target_id, a AS arm FROM k WHERE n = 1 AND copies > 1")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivery.messages(table(spark, sf_dir, "direction_scores")).where("copies > 1").select("target_id", "arm")


@registry.query("p5_messages", _MESSAGES + "SELECT delivery_id, target_id, arm, uniq_id, outcome, text FROM k WHERE n = 1")
def p5_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = redelivery.one_row_per_message(table(spark, sf_dir, "direction_scores"))
    return kept.select("delivery_id", "target_id", "arm", "uniq_id", "outcome", "text")

"""Queries of rollups, reports and term supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import reporting
from ..session import table
from .carry_plans import _UNITS, units
from .registry import Registry
from .score_plans import _KEPT, _PAIRS
from .text_plans import _NEIGHBOURS, _neighbours

registry = Registry()


@registry.query(
    "outcome_rollup",
    "SELECT source_name, count(*) AS n, count(*) FILTER (WHERE outcome = 'ok') AS n_ok, count(*) FILTER (WHERE outcome = 'error') AS n_error, grouping(source_name) = 1 AS total FROM direction_scores GROUP BY ROLLUP (source_name)",
)
def outcome_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.outcome_rollup(table(spark, sf_dir, "direction_scores"), "source_name")


@registry.query(
    "answer_report",
    _NEIGHBOURS
    + """, o AS (SELECT *, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS n FROM q),
    s AS (SELECT CASE WHEN len(a) + len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0 * coalesce(n, 0) / (len(a) + len(b)) END AS f, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b))) / len(list_distinct(list_concat(a, b))) END AS i, len(b) > 0 AS w FROM o)
    SELECT count(*) AS examples, round(avg(f), 6) AS f1, round(avg(i), 6) AS iou, round(avg(f) FILTER (WHERE w), 6) AS f1_answerable, round(avg(f) FILTER (WHERE NOT w), 6) AS f1_other FROM s""",
)
def answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    scored = _neighbours(spark, sf_dir).select(
        text.token_f1(a, b).alias("f"), text.token_iou(a, b).alias("i"), (F.size("b") > 0).alias("w"),
    )
    return reporting.answer_report(scored, "f", "i", F.col("w"))


@registry.query(
    "side_counts",
    "SELECT meeting_id, count(*) FILTER (WHERE side = 'ref') AS n_ref, count(*) FILTER (WHERE side = 'hyp') AS n_hyp, count(*) FILTER (WHERE side = 'ref') - count(*) FILTER (WHERE side = 'hyp') AS delta FROM diar_segments GROUP BY meeting_id",
)
def side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.source_counts(table(spark, sf_dir, "diar_segments"), "meeting_id", "side", ["ref", "hyp"])


_CELLS = "c AS (SELECT arm, source_name, round(avg(completion_tokens), 6) AS tokens, round(count(*) FILTER (WHERE parse_mode <> 'failed') / count(*), 6) AS parsed FROM parse_results WHERE arm IS NOT NULL AND source_name IS NOT NULL GROUP BY ALL)"


@registry.query(
    "best_cells",
    f"WITH {_CELLS}, p AS (SELECT * FROM c WHERE parsed >= 0.5 AND tokens IS NOT NULL), t AS (SELECT * FROM p WHERE tokens <= (SELECT min(tokens) FROM p) + 20 + 1e-9) SELECT *, (arm, source_name) = (SELECT min((arm, source_name)) FROM t) AS winner FROM t",
)
def best_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of arm and source that parse, within twenty tokens of the shortest replies."""
    rows = table(spark, sf_dir, "parse_results").where("arm is not null and source_name is not null")
    cells = rows.groupBy("arm", "source_name").agg(
        F.round(F.avg("completion_tokens"), 6).alias("tokens"),
        F.round(F.count_if(F.col("parse_mode") != "failed") / F.count(F.lit(1)), 6).alias("parsed"),
    )
    return reporting.best_cells(cells, "tokens", "parsed", ["arm", "source_name"], 0.5, 20)


@registry.query(
    "roster_breaks",
    "WITH r AS (SELECT DISTINCT uniq_id FROM runtime_dialogues WHERE uniq_id IS NOT NULL), m AS (SELECT uniq_id, arm AS split FROM parse_results WHERE uniq_id IS NOT NULL) SELECT 'unknown' AS problem, 'replies' AS \"where\", uniq_id FROM (SELECT DISTINCT uniq_id FROM m) WHERE uniq_id NOT IN (SELECT uniq_id FROM r) UNION ALL SELECT 'two splits', 'replies', uniq_id FROM m GROUP BY uniq_id HAVING count(DISTINCT split) > 1",
)
def roster_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    roster = table(spark, sf_dir, "runtime_dialogues").where("uniq_id is not null").select("uniq_id").distinct()
    replies = table(spark, sf_dir, "parse_results").where("uniq_id is not null").select("uniq_id", F.col("arm").alias("split"))
    return reporting.constraint_breaks(roster, "uniq_id", {"replies": replies})


@registry.query(
    "term_supplies",
    _UNITS
    + """, e AS (SELECT meeting, position // 10 AS chunk, surface AS term, count(*) AS evidence FROM u GROUP BY ALL), ch AS (SELECT DISTINCT meeting, chunk FROM e),
    kn AS (SELECT ch.meeting, ch.chunk, e.term, sum(e.evidence) AS evidence FROM ch JOIN e ON e.meeting = ch.meeting AND e.chunk <= ch.chunk GROUP BY ALL), ga AS (SELECT * FROM kn WHERE evidence >= 2),
    ms AS (SELECT DISTINCT meeting FROM ch), pa AS (SELECT meeting, coalesce(lead(meeting) OVER w, first_value(meeting) OVER w) AS partner FROM ms WINDOW w AS (ORDER BY md5('supply:' || meeting), meeting)),
    st AS (SELECT ch.meeting, ch.chunk, ga.term, ga.evidence FROM pa JOIN ch USING (meeting) JOIN ga ON ga.meeting = pa.partner AND ga.chunk = ch.chunk WHERE pa.partner <> pa.meeting),
    al AS (SELECT 'gated' AS arm, meeting, chunk, term, evidence FROM ga UNION ALL SELECT 'naive', meeting, chunk, term, evidence FROM kn UNION ALL SELECT 'no_carry', meeting, chunk, term, evidence FROM e WHERE evidence >= 2
      UNION ALL SELECT 'scrambled', meeting, chunk, CASE WHEN length(term) >= 4 THEN term[1] || term[3] || term[2] || substr(term, 4) ELSE term || 'x' END, evidence FROM kn UNION ALL SELECT 'deranged', meeting, chunk, term, evidence FROM st),
    ra AS (SELECT *, row_number() OVER (PARTITION BY arm, meeting, chunk ORDER BY evidence DESC, term) AS rank FROM al)
    SELECT arm, meeting, CAST(chunk AS BIGINT) AS chunk, term, CAST(evidence AS BIGINT) AS evidence, CAST(rank AS INT) AS rank FROM ra WHERE rank <= 8""",
)
def term_supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that each arm hands to each stretch of ten turns."""
    entries = units(spark, sf_dir).groupBy(
        "meeting", F.floor(F.col("position") / 10).alias("chunk"), F.col("surface").alias("term"),
    ).agg(F.count(F.lit(1)).alias("evidence"))
    return reporting.term_supplies(entries)


@registry.query(
    "reply_rates",
    "SELECT source_name, arm, count(*) AS n, count(*) FILTER (WHERE parse_mode = 'strict') AS hits, round(count(*) FILTER (WHERE parse_mode = 'strict') / count(*), 6) AS rate FROM parse_results GROUP BY source_name, arm",
)
def reply_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reporting.rate_table(table(spark, sf_dir, "parse_results"), ["source_name", "arm"], F.col("parse_mode") == "strict")


_CONTRASTS = _KEPT + """, v AS (SELECT arm, uniq_id, sum(wer_errors) / nullif(sum(wer_tokens), 0) AS wer, sum(carry_hits) / nullif(sum(carry_total), 0) AS hit FROM m1 GROUP BY ALL),
l AS (SELECT uniq_id, arm, unnest([{'metric': 'wer', 'x': wer}, {'metric': 'hit', 'x': hit}]) AS y FROM v), a AS (SELECT uniq_id, y.metric AS metric, y.x AS x FROM l WHERE arm = 'd0-global'), b AS (SELECT uniq_id, y.metric AS metric, y.x AS x FROM l WHERE arm = 'd1-speaker')
SELECT metric, 'd0-global' AS first_arm, 'd1-speaker' AS second_arm, count(*) FILTER (WHERE a.x IS NOT NULL AND b.x IS NOT NULL) AS paired, count(*) FILTER (WHERE a.x IS NULL OR b.x IS NULL) AS dropped, round(avg(b.x - a.x), 6) AS gap
FROM a FULL JOIN b USING (uniq_id, metric) GROUP BY metric"""


@registry.query("arm_contrasts", _CONTRASTS)
def arm_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrasts of pairs of arms over dialogues that both scored; the others are counted."""
    from .score_plans import ARMS, messages

    rate = lambda a, b: F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))
    per = messages(spark, sf_dir).groupBy("arm", "uniq_id").agg(
        rate("wer_errors", "wer_tokens").alias("wer"), rate("carry_hits", "carry_total").alias("hit"),
    )
    return reporting.arm_contrasts(per, "uniq_id", "arm", ["wer", "hit"], [ARMS])


@registry.query(
    "parse_health",
    """SELECT coalesce(arm, 'none') AS arm, count(*) AS replies, count(*) FILTER (WHERE raw_text IS NULL) AS missing, count(*) FILTER (WHERE length(trim(raw_text)) = 0) AS empty, count(*) FILTER (WHERE completion_tokens >= max_tokens) AS capped, count(*) FILTER (WHERE parse_mode = 'strict') AS strict,
      count(*) FILTER (WHERE parse_mode = 'lenient') AS lenient, count(*) FILTER (WHERE parse_mode = 'failed') AS failed, count(*) FILTER (WHERE parse_mode <> 'failed' AND n_segments = 0) AS abstained FROM parse_results GROUP BY 1""",
)
def parse_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies per arm: missing ones counted, modes, capped ones, abstentions that parsed."""
    return reporting.parse_health(table(spark, sf_dir, "parse_results").withColumn("arm", F.coalesce("arm", F.lit("none"))), ["arm"])


@registry.query(
    "task_order",
    """WITH k AS (SELECT request_id, CASE arm WHEN 'A-grid' THEN 0 WHEN 'A-free' THEN 1 ELSE 2 END AS priority, row_number() OVER (ORDER BY recorded_utc NULLS FIRST, request_id) AS seq FROM parse_results WHERE parse_mode <> 'strict' OR parse_mode IS NULL)
    SELECT request_id, priority, CAST(row_number() OVER (ORDER BY priority, seq) AS BIGINT) AS place FROM k""",
)
def task_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to be asked again, by the priority of their arm, then as they came."""
    rows = table(spark, sf_dir, "parse_results").where("parse_mode <> 'strict' or parse_mode is null")
    priority = F.when(F.col("arm") == "A-grid", 0).when(F.col("arm") == "A-free", 1).otherwise(2)
    return reporting.task_order(
        rows.select("request_id", "recorded_utc", priority.alias("priority")), ["priority", "recorded_utc", "request_id"],
    ).select("request_id", "priority", "place")


@registry.query(
    "views_of_speakers",
    "SELECT source_name, count(*) AS n FROM parse_results WHERE arm IS NOT DISTINCT FROM NULL GROUP BY source_name UNION ALL SELECT 'A-grid', count(*) FROM parse_results WHERE arm IS NOT DISTINCT FROM 'A-grid'",
)
def views_of_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one value of a column, null being a value."""
    rows = table(spark, sf_dir, "parse_results")
    none = reporting.view(rows, "arm", None).groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))
    return none.unionByName(reporting.view(rows, "arm", "A-grid").agg(F.lit("A-grid").alias("source_name"), F.count(F.lit(1)).alias("n")))


@registry.query(
    "hint_histograms",
    _PAIRS + """, h AS (SELECT unnest([{'feature': 'width', 'x': t1}, {'feature': 'hits', 'x': h1}]) AS v, coalesce(f1, 0) > 0 AS hint FROM pr)
    SELECT v.feature AS feature, CASE WHEN v.x IS NULL THEN 'unknown' WHEN v.x <= 1 THEN '1' WHEN v.x <= 2 THEN '2' ELSE '3+' END AS level, count(*) AS n, count(*) FILTER (WHERE hint) AS hints FROM h GROUP BY 1, 2""",
)
def hint_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False hints by width and hits of a target, in three classes and unknown."""
    from .score_plans import pairs

    rows = pairs(spark, sf_dir).withColumn("hint", F.coalesce(F.col("false_hint_target_1"), F.lit(0)) > 0)
    return reporting.histograms(rows, {"width": "carry_total_1", "hits": "carry_hits_1"}, [1, 2], "hint").withColumnRenamed("hits", "hints")


@registry.query(
    "excluded_listings",
    """WITH r AS (SELECT DISTINCT uniq_id FROM speaker_roster), a AS (SELECT DISTINCT uniq_id FROM runtime_dialogues WHERE manifest_batch = 1 AND uniq_id IN (SELECT uniq_id FROM r)), b AS (SELECT DISTINCT uniq_id FROM runtime_dialogues WHERE manifest_batch = 2 AND uniq_id IN (SELECT uniq_id FROM r)),
    x AS (SELECT uniq_id FROM a UNION SELECT uniq_id FROM b) SELECT uniq_id FROM x WHERE uniq_id NOT IN (SELECT uniq_id FROM parse_results WHERE uniq_id IS NOT NULL)""",
)
def excluded_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues of the first two batches on the roster, less those that were asked already."""
    listed = table(spark, sf_dir, "runtime_dialogues")
    batch = lambda n: listed.where(F.col("manifest_batch") == n).select("uniq_id")
    return reporting.eligible(
        [batch(1), batch(2)], table(spark, sf_dir, "speaker_roster").select("uniq_id"),
        table(spark, sf_dir, "parse_results").select("uniq_id"), "uniq_id",
    )


@registry.query(
    "receipt_shares",
    "WITH t AS (SELECT arm, count(*) AS calls, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS tokens FROM parse_results GROUP BY arm) SELECT arm, calls, tokens, round(tokens / 50000, 6) AS share, tokens > 50000 AS over FROM t",
)
def receipt_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer tokens per arm against a ceiling of 50,000."""
    return reporting.ceilings(
        table(spark, sf_dir, "parse_results"), ["arm"], "completion_tokens", 50_000,
    ).withColumnRenamed("total", "tokens")

"""Queries of scored responses: pooled rates, contrasts, bootstraps, attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_of
from ..operators import redelivery, scoring, speakers, statistics
from ..session import table
from .data_quality import _MESSAGES
from .registry import Registry
from .text_plans import _ROSTER, speaker_sql

registry = Registry()

ARMS = ("d0-global", "d1-speaker")
_KEPT = _MESSAGES + ", m1 AS (SELECT * EXCLUDE (target_id, arm, t, a), t AS target_id, a AS arm FROM k WHERE n = 1)"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a message, identifiers in their normal form."""
    kept = redelivery.one_row_per_message(table(spark, sf_dir, "direction_scores"))
    return kept.withColumn("target_id", redelivery.normal_id(F.col("target_id"))).withColumn("arm", redelivery.normal_id(F.col("arm")))


_SUMS = "count(*) AS n, " + ", ".join(
    f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in (
        "wer_errors", "wer_tokens", "carry_errors", "carry_tokens", "carry_hits", "carry_total", "false_hint_target",
    )
)
_RATES = "round(wer_errors / nullif(wer_tokens, 0), 6) AS wer, round(carry_errors / nullif(carry_tokens, 0), 6) AS carry_wer, round(carry_hits / nullif(carry_total, 0), 6) AS hit_rate, round(false_hint_target / nullif(n, 0), 6) AS false_hint_rate"


@registry.query("arm_metrics", _KEPT + f", g AS (SELECT arm, {_SUMS} FROM m1 GROUP BY arm) SELECT *, {_RATES} FROM g")
def arm_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pooled_metrics(messages(spark, sf_dir), ["arm"])


@registry.query("source_metrics", _KEPT + f", g AS (SELECT arm, source_name, {_SUMS} FROM m1 GROUP BY arm, source_name) SELECT *, {_RATES} FROM g")
def source_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pooled_metrics(messages(spark, sf_dir), ["arm", "source_name"])


@registry.query(
    "arm_means",
    _KEPT + ", v AS (SELECT arm, uniq_id, wer_errors / nullif(wer_tokens, 0) AS x FROM m1), p AS (SELECT arm, uniq_id, avg(x) AS m, count(*) FILTER (WHERE x IS NULL) AS skipped FROM v GROUP BY ALL) SELECT arm, count(m) AS groups, round(avg(m), 6) AS mean, CAST(sum(skipped) AS BIGINT) AS skipped FROM p GROUP BY arm",
)
def arm_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir).withColumn("x", F.try_divide(F.col("wer_errors").cast("double"), F.col("wer_tokens").cast("double")))
    return scoring.two_level_mean(rows, "arm", "uniq_id", "x")


@registry.query(
    "missing_cells",
    _KEPT + f", e AS (SELECT DISTINCT target_id, unnest({list(ARMS)}) AS arm FROM m1), g AS (SELECT target_id, arm, count(*) AS copies FROM m1 GROUP BY ALL) SELECT e.target_id, e.arm, coalesce(copies, 0) AS copies, copies IS NOT NULL AS found FROM e LEFT JOIN g USING (target_id, arm)",
)
def missing_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages(spark, sf_dir)
    return scoring.completeness(
        rows, list(ARMS), rows, ["target_id"], ["delivered_at", "delivery_id"],
    ).select("target_id", "arm", "copies", "found")


_PAIRS = _KEPT + """, pr AS (SELECT a.target_id, a.uniq_id, a.carry_hits AS h0, b.carry_hits AS h1, a.carry_total AS t0, b.carry_total AS t1, a.wer_errors AS e0, b.wer_errors AS e1, a.wer_tokens AS w0, b.wer_tokens AS w1, b.false_hint_target AS f1
  FROM m1 a JOIN m1 b ON a.target_id = b.target_id WHERE a.arm = 'd0-global' AND b.arm = 'd1-speaker')"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.arm_pairs(messages(spark, sf_dir), *ARMS)


@registry.query(
    "transitions",
    _PAIRS + " SELECT CASE WHEN coalesce(h0, 0) <= 0 AND coalesce(h1, 0) > 0 THEN 'repair' WHEN coalesce(h0, 0) > 0 AND coalesce(h1, 0) <= 0 THEN 'break' WHEN coalesce(h0, 0) > 0 THEN 'retained' ELSE 'missed' END AS transition, count(*) AS n FROM pr GROUP BY 1",
)
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.transitions(pairs(spark, sf_dir)).groupBy("transition").agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    "policy_strata",
    _PAIRS
    + """, c AS (SELECT *, coalesce(f1 = 0, false) AS acc, CASE WHEN t0 IS NULL THEN 'unknown' WHEN t0 <= 1 THEN '1' WHEN t0 <= 4 THEN '2-4' ELSE '5+' END AS width, CAST(('0x' || substr(sha256('fold:' || uniq_id), 16, 1))::INT % 4 AS VARCHAR) AS fold FROM pr),
    l AS (SELECT *, unnest([{'s': 'all', 'l': 'all'}, {'s': 'fold', 'l': coalesce(fold, 'unknown')}, {'s': 'width', 'l': width}]) AS x FROM c)
    SELECT x.s AS stratum, x.l AS level, count(*) AS n, CAST(sum(CASE WHEN acc THEN 1 ELSE 0 END) AS BIGINT) AS accepted, CAST(coalesce(sum(CASE WHEN acc THEN h1 ELSE h0 END), 0) AS BIGINT) AS hits,
      CAST(coalesce(sum(CASE WHEN acc THEN t1 ELSE t0 END), 0) AS BIGINT) AS total, CAST(coalesce(sum(CASE WHEN acc THEN h1 ELSE h0 END), 0) - coalesce(sum(h0), 0) AS BIGINT) AS gain FROM l GROUP BY x.s, x.l""",
)
def policy_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).withColumn("fold", fold_of(F.col("uniq_id"), "fold")).withColumn("width", scoring.width_bucket(F.col("carry_total_0")))
    return scoring.policy_strata(rows, F.col("false_hint_target_1") == 0, ["fold", "width"])


@registry.query(
    "folds",
    "SELECT DISTINCT uniq_id, CAST(('0x' || substr(sha256('fold:' || uniq_id), 16, 1))::INT % 4 AS INT) AS fold FROM runtime_dialogues WHERE uniq_id IS NOT NULL",
)
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "runtime_dialogues").where("uniq_id is not null").select("uniq_id").distinct()
    return ids.select("uniq_id", fold_of(F.col("uniq_id"), "fold").alias("fold"))


_CLUSTERS = _PAIRS + ", cl AS (SELECT uniq_id, CAST(coalesce(sum(h0), 0) AS DOUBLE) AS h0, CAST(coalesce(sum(h1), 0) AS DOUBLE) AS h1, CAST(coalesce(sum(t0), 0) AS DOUBLE) AS t0, CAST(coalesce(sum(t1), 0) AS DOUBLE) AS t1 FROM pr GROUP BY uniq_id)"


@registry.query(
    "bootstrap_interval",
    _CLUSTERS
    + """, nu AS (SELECT *, row_number() OVER (ORDER BY uniq_id) - 1 AS i FROM cl), z AS (SELECT count(*) AS n FROM nu), dr AS (SELECT r, CAST(('0x' || substr(md5('direction:' || r || ':' || k), 1, 8))::BIGINT % z.n AS BIGINT) AS i FROM range(200) a(r), z, range(z.n) b(k)),
    re AS (SELECT r, sum(h1) / nullif(sum(t1), 0) - sum(h0) / nullif(sum(t0), 0) AS v FROM dr JOIN nu USING (i) GROUP BY r)
    SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, round(stddev_pop(v), 6) AS sigma FROM re""",
)
def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of the difference of the arms' hit rates, by 200 draws of dialogues."""
    clusters = pairs(spark, sf_dir).groupBy("uniq_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("carry_hits_0", "carry_hits_1", "carry_total_0", "carry_total_1")])
    drawn = statistics.bootstrap(clusters, "uniq_id", ["carry_hits_0", "carry_hits_1", "carry_total_0", "carry_total_1"], 200, "direction")
    return statistics.interval(drawn, F.try_divide("carry_hits_1", "carry_total_1") - F.try_divide("carry_hits_0", "carry_total_0"))


@registry.query(
    "cluster_summary",
    """WITH c AS (SELECT uniq_id, count(DISTINCT turn_index) AS v FROM runtime_turns GROUP BY uniq_id), l AS (SELECT list_sort(list(CAST(v AS DOUBLE))) AS x FROM c)
    SELECT len(x) AS n, round(list_avg(x), 6) AS mean, round(list_median(x), 6) AS median, x[CAST(ceil(len(x) * 0.9) AS INT)] AS p90, x[len(x)] AS most FROM l""",
)
def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "runtime_turns").groupBy("uniq_id").agg(F.count_distinct("turn_index").alias("v"))
    return statistics.cluster_summary(per, "v")


@registry.query(
    "source_crosstab",
    "SELECT arm, parse_mode, count(*) AS n, count(*) FILTER (WHERE raw_text IS NULL) AS empty, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS tokens, grouping(arm, parse_mode) AS level FROM parse_results GROUP BY CUBE (arm, parse_mode)",
)
def source_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parse_results").cube("arm", "parse_mode")
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw_text").isNull()).alias("empty"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("tokens"), F.grouping_id("arm", "parse_mode").alias("level"),
    )


@registry.query(
    "attribution",
    f"""WITH {_ROSTER}, ls AS {speaker_sql('speaker_id', 'score_turns')}, g AS (SELECT uniq_id || ':' || turn_index AS sentence, list_sort(list(DISTINCT speaker)) AS speakers FROM ls WHERE uniq_id IS NOT NULL AND turn_index IS NOT NULL AND speaker <> '' GROUP BY 1),
    p AS (SELECT uniq_id || ':' || turn_index AS sentence, '#' || min(CAST(nullif(regexp_extract(speaker_id, '(\\d+)\\D*$', 1), '') AS INT)) AS speaker FROM runtime_turns WHERE uniq_id IS NOT NULL AND turn_index IS NOT NULL GROUP BY 1),
    o AS (SELECT CASE WHEN speakers IS NULL THEN 'hallucinated' WHEN speaker IS NULL THEN 'unattributed' WHEN list_contains(speakers, speaker) AND len(speakers) > 1 THEN 'ambiguous' WHEN list_contains(speakers, speaker) THEN 'correct' ELSE 'wrong' END AS outcome FROM g FULL JOIN p USING (sentence)),
    a AS (SELECT 'all' AS scope, count(*) FILTER (WHERE outcome = 'correct') AS correct, count(*) FILTER (WHERE outcome = 'wrong') AS wrong, count(*) FILTER (WHERE outcome = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE outcome = 'unattributed') AS unattributed, count(*) FILTER (WHERE outcome = 'hallucinated') AS hallucinated FROM o)
    SELECT *, round(correct / nullif(correct + wrong + unattributed, 0), 6) AS accuracy FROM a""",
)
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diarizer's cluster numbers against the speakers of the raw labels, turn by turn; all
    labels count, resolved against the roster."""
    key = F.concat(F.col("uniq_id"), F.lit(":"), F.col("turn_index").cast("string")).alias("sentence")
    named = speakers.resolved(table(spark, sf_dir, "score_turns"), table(spark, sf_dir, "speaker_roster"), "speaker_id")
    gold = named.where("uniq_id is not null and turn_index is not null and speaker <> ''").groupBy(key).agg(F.array_sort(F.collect_set("speaker")).alias("speakers"))
    number = F.nullif(F.regexp_extract("speaker_id", r"(\d+)\D*$", 1), F.lit("")).cast("int")
    predicted = table(spark, sf_dir, "runtime_turns").where("uniq_id is not null and turn_index is not null").groupBy(key).agg(F.concat(F.lit("#"), F.min(number).cast("string")).alias("speaker"))
    return scoring.attribution_accuracy(scoring.attribution(gold, predicted).withColumn("scope", F.lit("all")), ["scope"])


@registry.query(
    "sample_sizes",
    """WITH g AS (SELECT unnest([0.03, 0.05, 0.08]::DOUBLE[]) AS mde), h AS (SELECT g.mde, unnest([0.2, 0.3]::DOUBLE[]) AS discordance FROM g)
    SELECT mde, discordance, CAST(ceil(power((1.959964 * sqrt(discordance) + 0.841621 * sqrt(discordance - mde * mde)) / mde, 2) * 1.5) AS BIGINT) AS mentions FROM h""",
)
def sample_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of scenarios; reads no table."""
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.03, 0.05, 0.08)])).alias("mde")).select(
        "mde", F.explode(F.array(F.lit(0.2), F.lit(0.3))).alias("discordance"),
    )
    return grid.withColumn("mentions", statistics.paired_size(F.col("mde"), F.col("discordance"), F.lit(1.5)))


@registry.query(
    "paired_dialogues",
    _KEPT
    + """, v AS (SELECT arm, uniq_id, sum(wer_errors) / nullif(sum(wer_tokens), 0) AS x FROM m1 GROUP BY ALL), a AS (SELECT uniq_id, x FROM v WHERE arm = 'd0-global'), b AS (SELECT uniq_id, x FROM v WHERE arm = 'd1-speaker')
    SELECT uniq_id, round(b.x - a.x, 6) AS gap, a.x IS NULL OR b.x IS NULL AS dropped FROM a FULL JOIN b USING (uniq_id)""",
)
def paired_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of the arms' word error rates per dialogue; dialogues without both are marked."""
    v = messages(spark, sf_dir).groupBy("arm", "uniq_id").agg(
        F.try_divide(F.sum("wer_errors").cast("double"), F.sum("wer_tokens").cast("double")).alias("x")
    )
    a, b = (v.where(F.col("arm") == arm).select("uniq_id", F.col("x").alias(n)) for arm, n in zip(ARMS, "ab"))
    rows = a.join(b, "uniq_id", "full")
    return rows.select(
        "uniq_id", F.round(F.col("b") - F.col("a"), 6).alias("gap"), (F.col("a").isNull() | F.col("b").isNull()).alias("dropped"),
    )


@registry.query(
    "prevalence",
    _KEPT
    + """, d AS (SELECT uniq_id, count(*) FILTER (WHERE carry_total > 0) > 0 AS usable, count(*) FILTER (WHERE carry_hits > 0) > 0 AS positive FROM m1 GROUP BY uniq_id)
    SELECT count(*) AS dialogues, count(*) FILTER (WHERE usable) AS usable, count(*) FILTER (WHERE usable AND positive) AS positive, round(count(*) FILTER (WHERE usable AND positive) / nullif(count(*) FILTER (WHERE usable), 0), 6) AS share FROM d""",
)
def prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues in which a term could be carried, and in which one was."""
    per = messages(spark, sf_dir).groupBy("uniq_id").agg(
        (F.count_if(F.col("carry_total") > 0) > 0).alias("u"), (F.count_if(F.col("carry_hits") > 0) > 0).alias("p"),
    )
    both = F.count_if(F.col("u") & F.col("p"))
    return per.agg(
        F.count(F.lit(1)).alias("dialogues"), F.count_if("u").alias("usable"), both.alias("positive"),
        scoring.ratio(both, F.count_if("u")).alias("share"),
    )

"""Queries of carried terms and glossaries, over the raw turns of score_turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import carry
from ..session import table
from .registry import Registry
from .text_plans import TURNS, turns

registry = Registry()

TERMS = r"[a-z]{4,}"
_UNITS = f"""WITH {TURNS}, u AS (SELECT DISTINCT uniq_id AS meeting, turn_index AS position, coalesce(speaker, '') AS speaker, unnest(regexp_extract_all(lower(said), '{TERMS}')) AS surface FROM t WHERE turn_index IS NOT NULL)"""
_CENSUS = _UNITS + """, f AS (SELECT meeting, surface, speaker, min(position) AS first FROM u GROUP BY ALL),
g AS (SELECT u.*, f.first < u.position AS own, coalesce((SELECT min(x.first) FROM f x WHERE x.meeting = u.meeting AND x.surface = u.surface AND x.speaker <> u.speaker) < u.position, false) AS other
      FROM u JOIN f ON f.meeting = u.meeting AND f.surface = u.surface AND f.speaker = u.speaker),
c AS (SELECT meeting, position, speaker, surface, CASE WHEN own AND other THEN 'shared' WHEN own THEN 'exclusive' WHEN other THEN 'global_only' ELSE 'new' END AS kind FROM g)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir)
    return carry.term_units(
        rows, F.col("uniq_id"), F.col("turn_index"), F.col("speaker"), F.regexp_extract_all(F.lower("said"), F.lit(TERMS), F.lit(0)),
    )


@registry.query("carry_census", _CENSUS + " SELECT meeting, count(*) FILTER (WHERE kind = 'exclusive') AS exclusive, count(*) FILTER (WHERE kind = 'global_only') AS global_only, count(*) FILTER (WHERE kind = 'new') AS new, count(*) FILTER (WHERE kind = 'shared') AS shared FROM c GROUP BY meeting")
def carry_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.census_counts(carry.census(units(spark, sf_dir)))


@registry.query(
    "carry_supply",
    _CENSUS
    + """, m AS (SELECT meeting, count(*) FILTER (WHERE kind = 'exclusive') AS n FROM c GROUP BY meeting), s AS (SELECT surface, count(*) AS k FROM c WHERE kind = 'exclusive' GROUP BY surface), v AS (SELECT list_sort(list(n)) AS l FROM m)
    SELECT (SELECT count(*) FROM m) AS meetings, (SELECT CAST(sum(n) AS BIGINT) FROM m) AS units, l[CAST(round_even((len(l) - 1) * 0.25, 0) AS INT) + 1] AS q1, l[CAST(round_even((len(l) - 1) * 0.5, 0) AS INT) + 1] AS median,
      l[CAST(round_even((len(l) - 1) * 0.75, 0) AS INT) + 1] AS q3, round(coalesce((SELECT max(k) FROM s) / (SELECT sum(n) FROM m), 0.0), 6) AS max_share FROM v""",
)
def carry_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.supply_summary(carry.census(units(spark, sf_dir)))


_BINS = f"""WITH {TURNS}, b AS (SELECT uniq_id, turn_index, CAST(floor(min(start_s) / 90) AS BIGINT) AS bin FROM runtime_turns WHERE isfinite(start_s) GROUP BY ALL),
u AS (SELECT DISTINCT t.uniq_id AS meeting, b.bin AS position, coalesce(t.speaker, '') AS speaker, unnest(regexp_extract_all(lower(t.said), '{TERMS}')) AS surface FROM t JOIN b USING (uniq_id, turn_index))"""


@registry.query("carry_census_bins", _BINS + _CENSUS[len(_UNITS) :] + " SELECT meeting, count(*) FILTER (WHERE kind = 'exclusive') AS exclusive, count(*) FILTER (WHERE kind = 'global_only') AS global_only, count(*) FILTER (WHERE kind = 'new') AS new, count(*) FILTER (WHERE kind = 'shared') AS shared FROM c GROUP BY meeting")
def carry_census_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census over 90 s bins: what is said in one bin does not know itself."""
    times = table(spark, sf_dir, "runtime_turns").where(~F.isnan("start_s") & F.col("start_s").isNotNull())
    bins = times.groupBy("uniq_id", "turn_index").agg(F.floor(F.min("start_s") / 90).alias("bin"))
    rows = turns(spark, sf_dir).join(bins, ["uniq_id", "turn_index"])
    return carry.census_counts(
        carry.census(
            carry.term_units(
                rows, F.col("uniq_id"), F.col("bin"), F.col("speaker"), F.regexp_extract_all(F.lower("said"), F.lit(TERMS), F.lit(0)),
            )
        )
    )


@registry.query(
    "prior_terms",
    _UNITS
    + """, r AS (SELECT *, row_number() OVER w - 1 AS evidence, position - lag(position) OVER w AS gap FROM u WINDOW w AS (PARTITION BY meeting, surface, speaker ORDER BY position))
    SELECT meeting, surface, speaker, position, CAST(evidence AS INT) AS evidence, gap FROM r WHERE evidence > 0""",
)
def prior_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.prior_terms(units(spark, sf_dir))


@registry.query(
    "prior_terms_of_anyone",
    _UNITS
    + """, d AS (SELECT DISTINCT meeting, surface, position FROM u), r AS (SELECT *, row_number() OVER w - 1 AS evidence, position - lag(position) OVER w AS gap FROM d WINDOW w AS (PARTITION BY meeting, surface ORDER BY position))
    SELECT meeting, surface, position, CAST(evidence AS INT) AS evidence, gap FROM r WHERE evidence > 0""",
)
def prior_terms_of_anyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.prior_terms(units(spark, sf_dir), same_speaker=False)


@registry.query(
    "ranked_terms",
    _UNITS
    + """, k AS (SELECT meeting, surface, count(*) AS evidence, min(position) AS first_seen FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY evidence DESC, first_seen, surface) AS rank FROM k)
    SELECT meeting, surface, evidence, first_seen, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""",
)
def ranked_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.ranked_terms(units(spark, sf_dir), 8)


@registry.query(
    "carry_accounting",
    _UNITS
    + """, f AS (SELECT meeting, surface, min(position) AS position FROM u GROUP BY ALL), n AS (SELECT meeting, position, count(*) AS new FROM f GROUP BY ALL),
    h AS (SELECT meeting, position, count(DISTINCT surface) AS total FROM u GROUP BY ALL), j AS (SELECT h.meeting, h.position, total, coalesce(new, 0) AS new FROM h LEFT JOIN n USING (meeting, position))
    SELECT meeting, position, total, new, CAST(coalesce(sum(new) OVER (PARTITION BY meeting ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS carried FROM j""",
)
def carry_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.carry_accounting(units(spark, sf_dir))


@registry.query(
    "second_half_coverage",
    _UNITS
    + """, s AS (SELECT meeting, (min(position) + max(position)) / 2.0 AS middle FROM u GROUP BY meeting), f AS (SELECT DISTINCT u.meeting, surface FROM u JOIN s USING (meeting) WHERE position <= middle),
    l AS (SELECT u.meeting, CASE WHEN f.surface IS NULL THEN 0 ELSE 1 END AS hit FROM u JOIN s USING (meeting) LEFT JOIN f ON f.meeting = u.meeting AND f.surface = u.surface WHERE position > middle)
    SELECT s.meeting, round(coalesce(avg(hit), 0.0), 6) AS coverage FROM s LEFT JOIN l ON l.meeting = s.meeting GROUP BY s.meeting""",
)
def second_half_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.second_half_coverage(units(spark, sf_dir))


_WORDS = f"""WITH {TURNS}, w AS (SELECT uniq_id AS meeting, turn_index, unnest(regexp_extract_all(said, '[A-Za-z]{{4,}}')) AS surface FROM t WHERE said IS NOT NULL),
k AS (SELECT meeting, lower(surface) AS key, surface, count(*) AS n, min(turn_index) AS place FROM w GROUP BY ALL)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(
        F.col("uniq_id").alias("meeting"), F.col("turn_index").alias("place"),
        F.explode(F.regexp_extract_all("said", F.lit(r"[A-Za-z]{4,}"), F.lit(0))).alias("surface"),
    )
    return rows.withColumn("key", F.lower("surface"))


@registry.query(
    "term_clusters",
    _WORDS + " SELECT meeting, key, arg_min(surface, (-n, surface)) AS canonical, array_to_string(list_sort(list(surface)), ' ') AS variants, CAST(sum(n) AS BIGINT) AS evidence, min(place) AS first_place FROM k GROUP BY meeting, key",
)
def term_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carry.clusters(_candidates(spark, sf_dir)).withColumn("variants", F.array_join("variants", " "))


@registry.query(
    "merged_glossary",
    _WORDS[: _WORDS.index("k AS")]
    + """n AS (SELECT meeting, CAST(floor(turn_index / 10.0) AS BIGINT) AS chunk, lower(surface) AS key, surface, count(*) AS n FROM w GROUP BY ALL),
    g AS (SELECT meeting, chunk, key, arg_min(surface, (-n, surface)) AS canonical, CAST(sum(n) AS BIGINT) AS evidence, list(surface) AS vs FROM n GROUP BY meeting, chunk, key),
    o AS (SELECT meeting, key, list({'c': canonical, 'e': evidence} ORDER BY chunk) AS l, min(chunk) AS first_seen, flatten(list(vs)) AS vs FROM g GROUP BY meeting, key),
    f AS (SELECT meeting, key, list_reduce(l, lambda s, x: {'c': CASE WHEN x.e > s.e THEN x.c ELSE s.c END, 'e': s.e + x.e}) AS r, first_seen, vs FROM o)
    SELECT meeting, key, r.c AS canonical, CAST(r.e AS BIGINT) AS evidence, first_seen, array_to_string(list_sort(list_distinct(vs)), ' ') AS variants FROM f WHERE r.e >= 2""",
)
def merged_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each stretch of ten turns folded in order (the fold is tested by hand)."""
    chunks = _candidates(spark, sf_dir).withColumn("meeting", F.struct("meeting", F.floor(F.col("place") / 10).alias("chunk")))
    entries = carry.clusters(chunks).select(
        F.col("meeting.meeting").alias("meeting"), "key", F.col("meeting.chunk").alias("chunk"), "canonical", "evidence", "variants",
    )
    return carry.gated(carry.merged_entries(entries), 2).withColumn("variants", F.array_join("variants", " "))


@registry.query(
    "term_set_sizes",
    _UNITS
    + """, a AS (SELECT meeting, speaker, list(DISTINCT surface) AS terms FROM u GROUP BY ALL), p AS (SELECT x.meeting, x.speaker AS speaker_a, y.speaker AS speaker_b, x.terms AS a, y.terms AS b FROM a x JOIN a y ON x.meeting = y.meeting AND y.speaker = (SELECT min(z.speaker) FROM a z WHERE z.meeting = x.meeting AND z.speaker > x.speaker))
    SELECT meeting, speaker_a, speaker_b, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS n_union, CAST(len(list_intersect(a, b)) AS INT) AS n_both, CAST(len(a) - len(list_intersect(a, b)) AS INT) AS n_left, CAST(len(b) - len(list_intersect(a, b)) AS INT) AS n_right FROM p""",
)
def term_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term sets of each label against the next label of its dialogue, in the order of labels."""
    from pyspark.sql import Window

    sets = units(spark, sf_dir).groupBy("meeting", "speaker").agg(F.collect_set("surface").alias("a"))
    order = Window.partitionBy("meeting").orderBy("speaker")
    pairs = sets.withColumn("speaker_b", F.lead("speaker").over(order)).withColumn("b", F.lead("a").over(order)).where("b is not null")
    return carry.term_set_sizes(pairs, "a", "b").select(
        "meeting", F.col("speaker").alias("speaker_a"), "speaker_b", "n_union", "n_both", "n_left", "n_right",
    )


@registry.query(
    "prior_terms_of_others",
    _UNITS
    + """, p AS (SELECT meeting, surface, position, count(DISTINCT speaker) AS n, min(speaker) AS one FROM u GROUP BY ALL)
    SELECT u.meeting, u.surface, u.speaker, u.position, count(*) AS evidence FROM u JOIN p ON p.meeting = u.meeting AND p.surface = u.surface AND p.position < u.position AND (p.n > 1 OR p.one <> u.speaker) GROUP BY ALL""",
)
def prior_terms_of_others(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier positions at which others than the speaker said a term."""
    return carry.prior_of_others(units(spark, sf_dir))


_CLASSES = "CASE WHEN length(surface) > 8 THEN ['long'] ELSE ['short'] END || CASE WHEN surface LIKE '%s' THEN ['plural'] ELSE [] END"


@registry.query(
    "class_counts",
    _CENSUS + f", x AS (SELECT kind, unnest({_CLASSES}) AS class FROM c) SELECT class, count(*) AS candidates, count(*) FILTER (WHERE kind = 'exclusive') AS exclusive FROM x GROUP BY class",
)
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units per class of surface: by length, and those that end like plurals in two classes."""
    found = carry.census(units(spark, sf_dir))
    kinds = F.array_compact(
        F.array(F.when(F.length("surface") > 8, "long").otherwise("short"), F.when(F.col("surface").endswith("s"), "plural"))
    )
    return carry.class_counts(found, found.select("surface").distinct().select("surface", F.explode(kinds).alias("class")))


@registry.query(
    "state_scores",
    _UNITS
    + """, m AS (SELECT meeting, speaker, position, list(DISTINCT surface) AS now FROM u GROUP BY ALL),
    s AS (SELECT m.meeting, m.speaker, m.position, now, coalesce((SELECT list(DISTINCT x.surface) FROM u x WHERE x.meeting = m.meeting AND x.speaker = m.speaker AND x.position < m.position), []) AS own,
      coalesce((SELECT list(DISTINCT x.surface) FROM u x WHERE x.meeting = m.meeting AND x.position < m.position), []) AS every FROM m),
    a AS (SELECT unnest([{'arm': 'speaker', 't': own}, {'arm': 'global', 't': every}]) AS v, own, every, list_intersect(now, own) AS same, list_intersect(now, every) AS other FROM s),
    n AS (SELECT v.arm AS arm, count(*) AS targets, sum(len(v.t)) AS terms, sum(len(list_intersect(v.t, every))) AS supported_terms, sum(len(v.t) - len(list_intersect(v.t, every))) AS hallucinated_terms,
      sum(len(list_intersect(v.t, every)) - len(list_intersect(v.t, same))) AS off_speaker_terms, sum(len(list_intersect(v.t, other))) AS target_relevant_terms, sum(len(same)) AS same_targets, sum(len(list_intersect(v.t, same))) AS same_target_hits,
      sum(len(other)) AS global_targets, sum(len(list_intersect(v.t, other))) AS global_target_hits FROM a GROUP BY 1)
    SELECT arm, targets, CAST(terms AS BIGINT) AS terms, CAST(supported_terms AS BIGINT) AS supported_terms, CAST(hallucinated_terms AS BIGINT) AS hallucinated_terms, CAST(off_speaker_terms AS BIGINT) AS off_speaker_terms, CAST(target_relevant_terms AS BIGINT) AS target_relevant_terms,
      CAST(same_targets AS BIGINT) AS same_targets, CAST(same_target_hits AS BIGINT) AS same_target_hits, CAST(global_targets AS BIGINT) AS global_targets, CAST(global_target_hits AS BIGINT) AS global_target_hits,
      round(supported_terms / nullif(terms, 0), 6) AS support_precision, round(hallucinated_terms / nullif(terms, 0), 6) AS hallucination_rate, round(off_speaker_terms / nullif(terms, 0), 6) AS off_speaker_rate, round(target_relevant_terms / nullif(terms, 0), 6) AS target_relevance,
      round(same_target_hits / nullif(same_targets, 0), 6) AS same_target_recall, round(global_target_hits / nullif(global_targets, 0), 6) AS global_target_recall FROM n""",
)
def state_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of two arms at each turn, the speaker's own earlier terms and everybody's, against
    what was said before and what is said now. A state holds a dialogue's distinct terms."""
    u = units(spark, sf_dir)
    now = u.groupBy("meeting", "speaker", "position").agg(F.collect_set("surface").alias("now"))
    firsts = u.groupBy("meeting", "speaker", "surface").agg(F.min("position").alias("first"))
    own = firsts.groupBy("meeting", "speaker").agg(F.collect_list(F.struct("first", "surface")).alias("mine"))
    every = firsts.groupBy("meeting", "surface").agg(F.min("first").alias("first")).groupBy("meeting").agg(F.collect_list(F.struct("first", "surface")).alias("all"))
    rows = now.join(own, ["meeting", "speaker"]).join(every, "meeting")
    before = lambda c: F.transform(F.filter(c, lambda x: x["first"] < F.col("position")), lambda x: x["surface"])
    rows = rows.select("now", before(F.col("mine")).alias("own"), before(F.col("all")).alias("every"))
    arms = F.inline(
        F.array(
            F.struct(F.lit("speaker").alias("arm"), F.col("own").alias("t")),
            F.struct(F.lit("global").alias("arm"), F.col("every").alias("t")),
        )
    )
    rows = rows.select("now", "own", "every", arms).select(
        "arm", "t", "every", F.array_intersect("now", "own").alias("same"), F.array_intersect("now", "every").alias("other"),
    )
    return carry.state_scores(rows, ["arm"], "t", "every", "same", "other")

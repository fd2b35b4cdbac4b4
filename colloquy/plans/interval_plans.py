"""Queries of intervals: overlaps, nearest boundaries, diarization errors, slice plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diarization, matching, overlaps, slicing, speakers, wer
from ..operators.periods import rounded_ms
from ..session import cut_lineage, stored_table, table
from ..sources import lines
from .data_quality import _PERIODS
from .registry import Registry
from .text_plans import TURNS

registry = Registry()

_SIDES = _PERIODS + ", x AS (SELECT meeting_id, side, speaker, start_ms AS s, end_ms AS e FROM r WHERE kind = 'period')"


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.side_periods(table(spark, sf_dir, "diar_segments"))


@registry.query(
    "speaker_overlap",
    _SIDES
    + """ SELECT a.meeting_id, a.speaker AS ref_speaker, b.speaker AS hyp_speaker, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS ms
    FROM x a JOIN x b ON a.meeting_id = b.meeting_id AND a.s < b.e AND b.s < a.e WHERE a.side = 'ref' AND b.side = 'hyp' GROUP BY ALL""",
)
def speaker_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.speaker_overlap(cut_lineage(_periods(spark, sf_dir)))


_SWEEP = _SIDES + """, ev AS (SELECT meeting_id, s AS moment, CASE WHEN side = 'ref' THEN 1 ELSE 0 END AS dr, CASE WHEN side = 'hyp' THEN 1 ELSE 0 END AS dh, 0 AS dc FROM x
  UNION ALL SELECT meeting_id, e, CASE WHEN side = 'ref' THEN -1 ELSE 0 END, CASE WHEN side = 'hyp' THEN -1 ELSE 0 END, 0 FROM x
  UNION ALL SELECT meeting_id, b - $c, 0, 0, 1 FROM (SELECT DISTINCT meeting_id, unnest([s, e]) AS b FROM x WHERE side = 'ref')
  UNION ALL SELECT meeting_id, b + $c, 0, 0, -1 FROM (SELECT DISTINCT meeting_id, unnest([s, e]) AS b FROM x WHERE side = 'ref')),
st AS (SELECT meeting_id, moment, sum(dr) AS dr, sum(dh) AS dh, sum(dc) AS dc FROM ev GROUP BY ALL),
el AS (SELECT meeting_id, lead(moment) OVER w - moment AS ms, sum(dr) OVER w AS nr, sum(dh) OVER w AS nh, sum(dc) OVER w AS nc FROM st WINDOW w AS (PARTITION BY meeting_id ORDER BY moment)),
sc AS (SELECT * FROM el WHERE ms > 0 AND (nr > 0 OR nh > 0) AND (nc = 0 OR $c = 0) $skip)
SELECT meeting_id, CAST(sum(nr * ms) AS BIGINT) AS total_ms, CAST(sum(greatest(nr - nh, 0) * ms) AS BIGINT) AS missed_ms, CAST(sum(greatest(nh - nr, 0) * ms) AS BIGINT) AS false_alarm_ms FROM sc GROUP BY meeting_id"""


@registry.query("missed_and_false", _SWEEP.replace("$c", "0").replace("$skip", ""))
def missed_and_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.error_times(diarization.elementary(_periods(spark, sf_dir))).select("meeting_id", "total_ms", "missed_ms", "false_alarm_ms")


@registry.query("missed_and_false_collar", _SWEEP.replace("$c", "250").replace("$skip", "AND nr <= 1"))
def missed_and_false_collar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.error_times(
        diarization.elementary(_periods(spark, sf_dir), None, 250), True,
    ).select("meeting_id", "total_ms", "missed_ms", "false_alarm_ms")


@registry.query("diarization_errors")
def diarization_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate per meeting under two conventions (speaker assignment is no SQL; tested)."""
    return diarization.meeting_scores(table(spark, sf_dir, "diar_segments"))


# The best one-to-one mapping by sets: reference speakers in order, hypothesis speakers taken so far as bits.
_BEST = _SIDES + """, ov AS (SELECT a.meeting_id, a.speaker AS r, b.speaker AS h, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS ms FROM x a JOIN x b ON a.meeting_id = b.meeting_id AND a.s < b.e AND b.s < a.e WHERE a.side = 'ref' AND b.side = 'hyp' GROUP BY ALL),
nr AS (SELECT meeting_id, r, row_number() OVER (PARTITION BY meeting_id ORDER BY r) AS i FROM (SELECT DISTINCT meeting_id, r FROM ov)), nh AS (SELECT meeting_id, h, CAST(1 AS BIGINT) << CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY h) - 1 AS INT) AS bit FROM (SELECT DISTINCT meeting_id, h FROM ov)),
ce AS (SELECT meeting_id, i, bit, ms FROM ov JOIN nr USING (meeting_id, r) JOIN nh USING (meeting_id, h)), ns AS (SELECT meeting_id, max(i) AS n FROM nr GROUP BY meeting_id),
dp AS (SELECT meeting_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS best FROM ns
  UNION ALL SELECT meeting_id, i, taken, CAST(max(best) AS BIGINT) FROM (SELECT d.meeting_id, d.i + 1 AS i, d.taken, d.best FROM dp d JOIN ns USING (meeting_id) WHERE d.i < ns.n
    UNION ALL SELECT d.meeting_id, d.i + 1, d.taken | c.bit, d.best + c.ms FROM dp d JOIN ce c ON c.meeting_id = d.meeting_id AND c.i = d.i + 1 WHERE d.taken & c.bit = 0) GROUP BY ALL),
co AS (SELECT dp.meeting_id, max(best) AS correct_ms FROM dp JOIN ns ON ns.meeting_id = dp.meeting_id AND dp.i = ns.n GROUP BY dp.meeting_id)"""
_SWEPT = _SWEEP.replace("$c", "0").replace("$skip", "")[len(_SIDES) :]


@registry.query(
    "diarization_full",
    _BEST.replace("WITH ", "WITH RECURSIVE ", 1).replace("\nWITH ", "\nWITH RECURSIVE ", 0)
    + _SWEPT[: _SWEPT.index("\nSELECT")]
    + """, te AS (SELECT meeting_id, CAST(sum(nr * ms) AS BIGINT) AS total_ms, CAST(sum(greatest(nr - nh, 0) * ms) AS BIGINT) AS missed_ms, CAST(sum(greatest(nh - nr, 0) * ms) AS BIGINT) AS false_alarm_ms, CAST(sum(least(nr, nh) * ms) AS BIGINT) AS both_ms FROM sc GROUP BY meeting_id)
    SELECT te.meeting_id, total_ms, missed_ms, false_alarm_ms, both_ms - coalesce(correct_ms, 0) AS confusion_ms, CAST(coalesce(correct_ms, 0) AS BIGINT) AS correct_ms, round(coalesce((missed_ms + false_alarm_ms + both_ms - coalesce(correct_ms, 0)) / nullif(total_ms, 0), 0.0), 6) AS der FROM te LEFT JOIN co ON co.meeting_id IS NOT DISTINCT FROM te.meeting_id""",
)
def diarization_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate per meeting without collar: the mapping is checked by its total, which ties
    do not change."""
    rows = diarization.meeting_scores(table(spark, sf_dir, "diar_segments"), (("full", 0, False),))
    return rows.drop("convention")


@registry.query("diarization_errors_pooled")
def diarization_errors_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.pooled(diarization.meeting_scores(table(spark, sf_dir, "diar_segments")))


_MAPPED = (
    _BEST[: _BEST.index("dp AS (")].replace("WITH a AS", "WITH RECURSIVE a AS", 1)
    + """dp AS (SELECT meeting_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS best, []::BIGINT[] AS path FROM ns
  UNION ALL SELECT meeting_id, i, taken, CAST(max(best) AS BIGINT), arg_max(path, best) FROM (SELECT d.meeting_id, d.i + 1 AS i, d.taken, d.best, list_append(d.path, 0) AS path FROM dp d JOIN ns USING (meeting_id) WHERE d.i < ns.n
    UNION ALL SELECT d.meeting_id, d.i + 1, d.taken | c.bit, d.best + c.ms, list_append(d.path, c.bit) FROM dp d JOIN ce c ON c.meeting_id = d.meeting_id AND c.i = d.i + 1 WHERE d.taken & c.bit = 0) GROUP BY meeting_id, i, taken),
pa AS (SELECT dp.meeting_id, arg_max(path, best) AS path FROM dp JOIN ns ON ns.meeting_id = dp.meeting_id AND dp.i = ns.n GROUP BY dp.meeting_id),
mp AS (SELECT nr.meeting_id, nr.r, nh.h FROM pa JOIN nr ON nr.meeting_id = pa.meeting_id JOIN nh ON nh.meeting_id = pa.meeting_id AND nh.bit = pa.path[nr.i]),
ln AS (SELECT meeting_id, side, speaker, sum(e - s) AS ms FROM x GROUP BY ALL)"""
)


@registry.query(
    "jaccard_errors",
    _MAPPED
    + """ SELECT a.meeting_id, count(*) AS speakers, round(avg(CASE WHEN mp.h IS NULL THEN 1.0 ELSE 1 - ov.ms / (a.ms + b.ms - ov.ms) END), 6) AS jer
    FROM ln a LEFT JOIN mp ON mp.meeting_id = a.meeting_id AND mp.r = a.speaker LEFT JOIN ln b ON b.meeting_id = a.meeting_id AND b.side = 'hyp' AND b.speaker = mp.h LEFT JOIN ov ON ov.meeting_id = a.meeting_id AND ov.r = mp.r AND ov.h = mp.h
    WHERE a.side = 'ref' GROUP BY a.meeting_id""",
)
def jaccard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diarization.jaccard_errors(table(spark, sf_dir, "diar_segments"))


@registry.query(
    "boundary_distances",
    _SIDES
    + """, rb AS (SELECT DISTINCT meeting_id, unnest([s, e]) AS moment FROM x WHERE side = 'ref'), hb AS (SELECT DISTINCT meeting_id, unnest([s, e]) AS moment FROM x WHERE side = 'hyp'),
    lo AS (SELECT rb.meeting_id, rb.moment, hb.moment AS h FROM rb ASOF LEFT JOIN hb ON rb.meeting_id = hb.meeting_id AND rb.moment >= hb.moment),
    hi AS (SELECT rb.meeting_id, rb.moment, hb.moment AS h FROM rb ASOF LEFT JOIN hb ON rb.meeting_id = hb.meeting_id AND rb.moment <= hb.moment)
    SELECT lo.meeting_id, lo.moment AS "at", least(lo.moment - lo.h, hi.h - hi.moment) AS distance FROM lo JOIN hi USING (meeting_id, moment)""",
)
def boundary_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = cut_lineage(_periods(spark, sf_dir).select("meeting_id", "side", F.explode(F.array("s", "e")).alias("at")))
    side = lambda x: points.where(F.col("side") == x).drop("side")
    return overlaps.nearest(side("ref"), side("hyp"), "meeting_id", "at")


_TURNS_MS = "tt AS (SELECT DISTINCT uniq_id, turn_index, CAST(round(start_s * 1000) AS BIGINT) AS s2, CAST(round(end_s * 1000) AS BIGINT) AS e2 FROM runtime_turns WHERE isfinite(start_s) AND isfinite(end_s))"


def _turns_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "runtime_turns")
    return rows.select(
        "uniq_id", "turn_index", rounded_ms(F.col("start_s")).alias("s2"), rounded_ms(F.col("end_s")).alias("e2"),
    ).where("s2 is not null and e2 is not null").distinct()


@registry.query(
    "slice_turns",
    f"""WITH {_TURNS_MS}, g AS (SELECT uniq_id, unnest(range(0, CAST(ceil(max(e2) / 90000.0) AS BIGINT))) AS slice_no FROM tt WHERE s2 < e2 GROUP BY uniq_id),
    k AS (SELECT *, slice_no * 90000 AS s, (slice_no + 1) * 90000 AS e FROM g)
    SELECT k.uniq_id, k.slice_no, tt.turn_index, greatest(s, s2) - s AS offset_s, least(e, e2) - s AS offset_e FROM k JOIN tt ON k.uniq_id = tt.uniq_id AND s < e2 AND s2 < e AND s2 < e2""",
)
def slice_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each 90 s slice with their offsets in it."""
    turns = _turns_ms(spark, sf_dir)
    ends = turns.where("s2 < e2").groupBy("uniq_id").agg(F.max("e2").alias("m"))
    slices = ends.select("uniq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("m") / 90_000) - 1)).alias("slice_no"))
    slices = slices.withColumn("s", F.col("slice_no") * 90_000).withColumn("e", F.col("s") + 90_000)
    rows = overlaps.clipped(overlaps.overlap_join(slices, turns, "uniq_id", 90_000))
    return rows.select("uniq_id", "slice_no", "turn_index", "offset_s", "offset_e")


@registry.query(
    "turns_of_chunks",
    f"""WITH {_TURNS_MS}, c AS (SELECT uniq_id, CAST(max(e2) AS BIGINT) AS m FROM tt GROUP BY uniq_id), k AS (SELECT uniq_id, unnest([0, 1, 2]) AS idx, m FROM c),
    q AS (SELECT uniq_id, idx, 5000 + idx * 60000 AS s, 65000 + idx * 60000 AS e FROM k), d AS (SELECT DISTINCT uniq_id, s2 AS at FROM tt)
    SELECT d.uniq_id, d.at, coalesce(min(q.idx), CASE WHEN d.at < 5000 THEN 0 ELSE 2 END) AS idx FROM d LEFT JOIN q ON q.uniq_id = d.uniq_id AND d.at >= q.s AND d.at < q.e GROUP BY d.uniq_id, d.at""",
)
def turns_of_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk, of three minutes from the fifth second on, in which each turn starts; turns
    before and after fall to the first and last."""
    turns = _turns_ms(spark, sf_dir)
    chunks = turns.select("uniq_id").distinct().select("uniq_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"))
    chunks = chunks.withColumn("s", (5_000 + F.col("idx") * 60_000).cast("long")).withColumn("e", F.col("s") + 60_000)
    return overlaps.containing(turns.select("uniq_id", F.col("s2").alias("at")).distinct(), chunks, "uniq_id", "at")


@registry.query(
    "stream_faults",
    """WITH o AS (SELECT DISTINCT uniq_id, speaker_id, turn_index, start_s, end_s FROM runtime_turns), d AS (SELECT *, coalesce(start_s < lag(start_s) OVER (PARTITION BY uniq_id, speaker_id ORDER BY turn_index), false) AS down FROM o),
    g AS (SELECT uniq_id, count(*) AS n_rows, coalesce(bool_and(start_s = 0 AND end_s = 0), false) AS all_zero, count(*) > 1 AND count(DISTINCT coalesce(CAST(start_s AS VARCHAR), 'none') || ' ' || coalesce(CAST(end_s AS VARCHAR), 'none')) = 1 AS one_pair,
      coalesce(bool_or(end_s < start_s), false) AS reversed, bool_or(down) AS disordered FROM d GROUP BY uniq_id)
    SELECT *, NOT (all_zero OR one_pair OR reversed OR disordered) AS valid FROM g""",
)
def stream_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "runtime_turns").select("uniq_id", "speaker_id", "turn_index", "start_s", "end_s").distinct()
    return overlaps.stream_faults(turns, "uniq_id", "speaker_id", "turn_index", "start_s", "end_s")


_OWN = "own AS (SELECT uniq_id, s, max(e) AS e FROM (SELECT uniq_id, CAST(round(start_s * 1000) AS BIGINT) AS s, CAST(round(end_s * 1000) AS BIGINT) AS e FROM runtime_turns WHERE isfinite(start_s) AND isfinite(end_s)) WHERE s < e GROUP BY uniq_id, s)"
# Open slices turn by turn; long turns are tiled; then gaps are shared and the ends reach out.
_PACKED = (
    _OWN
    + """, ot AS (SELECT *, row_number() OVER (PARTITION BY uniq_id ORDER BY s) AS i, e - s > 120000 AS big, (e - s - 1) // 90000 AS m FROM own),
ok AS (SELECT *, CASE WHEN big AND e - s - m * 90000 <= 30000 THEN m WHEN big THEN m + 1 ELSE 1 END AS tiles FROM ot),
st AS (SELECT uniq_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, false AS open, CAST(0 AS BIGINT) AS no FROM own GROUP BY uniq_id
  UNION ALL SELECT t.uniq_id, t.i, CASE WHEN t.big THEN NULL WHEN st.open AND t.e - st.a <= 120000 AND st.b - st.a < 90000 THEN st.a ELSE t.s END,
    CASE WHEN t.big THEN NULL WHEN st.open AND t.e - st.a <= 120000 AND st.b - st.a < 90000 THEN greatest(st.b, t.e) ELSE t.e END, NOT t.big,
    CASE WHEN t.big THEN st.no + t.tiles WHEN st.open AND t.e - st.a <= 120000 AND st.b - st.a < 90000 THEN st.no ELSE st.no + 1 END
  FROM st JOIN ok t ON t.uniq_id IS NOT DISTINCT FROM st.uniq_id AND t.i = st.i + 1),
bt AS (SELECT st.uniq_id, ok.s, ok.e, ok.tiles, st.no - ok.tiles AS base, unnest(range(0, ok.tiles)) AS k FROM st JOIN ok ON ok.uniq_id IS NOT DISTINCT FROM st.uniq_id AND ok.i = st.i WHERE ok.big),
sl AS (SELECT uniq_id, no, min(a) AS a, max(b) AS b FROM st WHERE a IS NOT NULL GROUP BY uniq_id, no
  UNION ALL SELECT uniq_id, base + k + 1, s + k * 90000, CASE WHEN k = tiles - 1 THEN e ELSE s + (k + 1) * 90000 END FROM bt),
nb AS (SELECT *, lag(b) OVER w AS pb, lead(a) OVER w AS na FROM sl WINDOW w AS (PARTITION BY uniq_id ORDER BY no)),
fa AS (SELECT *, CASE WHEN pb < a THEN least(a, greatest((pb + a) // 2, b - 120000)) WHEN pb > a THEN least(pb, b) ELSE a END AS a2 FROM nb),
fb AS (SELECT *, CASE WHEN b < na THEN greatest(b, least((b + na) // 2, a2 + 120000)) ELSE b END AS b2 FROM fa),
hi AS (SELECT uniq_id, max(e) AS high FROM own GROUP BY uniq_id),
fc AS (SELECT fb.uniq_id, a2, b2, row_number() OVER w - 1 AS k, lead(no) OVER w IS NULL AS last, high FROM fb JOIN hi ON hi.uniq_id IS NOT DISTINCT FROM fb.uniq_id WHERE b2 > a2 WINDOW w AS (PARTITION BY fb.uniq_id ORDER BY no)),
fd AS (SELECT *, CASE WHEN k = 0 THEN greatest(0, a2 - 3000, b2 - 120000) ELSE a2 END AS a3 FROM fc),
ps AS (SELECT uniq_id, CAST(k AS INT) AS slice_no, a3 AS start_ms, CASE WHEN last THEN greatest(b2, least(high, b2 + 3000, a3 + 120000)) ELSE b2 END AS end_ms FROM fd)"""
)


@registry.query("turn_slices", "WITH RECURSIVE " + _PACKED + " SELECT * FROM ps")
def turn_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices of packed turns (sequential; bounds and cover are tested)."""
    return slicing.turn_slices(table(spark, sf_dir, "runtime_turns"))


@registry.query(
    "task_chunks",
    f"""WITH RECURSIVE {_OWN}, o AS (SELECT *, row_number() OVER (PARTITION BY uniq_id ORDER BY s) AS i, count(*) OVER (PARTITION BY uniq_id) AS n, max(e) OVER (PARTITION BY uniq_id) AS z, lag(e) OVER (PARTITION BY uniq_id ORDER BY s) AS p FROM own),
    k AS (SELECT uniq_id, s AS low, i AS first, CAST(NULL AS BIGINT) AS cut, CAST(-1 AS BIGINT) AS no, n, z FROM o WHERE i = 1
      UNION ALL SELECT k.uniq_id, x.cut, x.next, x.cut, k.no + 1, k.n, k.z FROM k, LATERAL (SELECT CASE WHEN o.e <= k.low + 900000 OR o.i = k.first THEN o.e ELSE o.p END AS cut, CASE WHEN o.e <= k.low + 900000 OR o.i = k.first THEN o.i + 1 ELSE o.i END AS next
        FROM o WHERE o.uniq_id IS NOT DISTINCT FROM k.uniq_id AND o.i >= k.first AND o.i < k.n AND o.e - k.low >= 360000 ORDER BY o.i LIMIT 1) x),
    c AS (SELECT uniq_id, no + 1 AS slice_no, low AS start_ms, coalesce(lead(cut) OVER (PARTITION BY uniq_id ORDER BY no), z) AS end_ms FROM k),
    l AS (SELECT *, max(slice_no) OVER (PARTITION BY uniq_id) AS last FROM c),
    m AS (SELECT uniq_id, max(slice_no) AS tail FROM l WHERE slice_no = last AND slice_no > 0 AND end_ms - start_ms < 180000 GROUP BY uniq_id)
    SELECT l.uniq_id, CAST(slice_no AS INT) AS slice_no, start_ms, CASE WHEN m.tail = slice_no + 1 THEN lead(end_ms) OVER (PARTITION BY l.uniq_id ORDER BY slice_no) ELSE end_ms END AS end_ms
    FROM l LEFT JOIN m ON m.uniq_id IS NOT DISTINCT FROM l.uniq_id QUALIFY m.tail IS NULL OR slice_no <> m.tail""",
)
def task_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.task_chunks(table(spark, sf_dir, "runtime_turns"))


_GRID = """r AS (SELECT uniq_id, s, e, max(e) OVER (PARTITION BY uniq_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM own),
    p AS (SELECT uniq_id, unnest([reach, s]) AS x FROM r WHERE s - reach >= 1000), h AS (SELECT uniq_id, max(e) AS high FROM own GROUP BY uniq_id),
    g AS (SELECT uniq_id, CAST(0 AS BIGINT) AS low, high, CAST(-1 AS BIGINT) AS no FROM h
      UNION ALL SELECT g.uniq_id, y.cut, g.high, g.no + 1 FROM g, LATERAL (SELECT coalesce((SELECT arg_min(p.x, (abs(p.x - g.low - 90000), p.x)) FROM p WHERE p.uniq_id IS NOT DISTINCT FROM g.uniq_id AND abs(p.x - g.low - 90000) <= 3000 AND p.x - g.low BETWEEN 60000 AND 120000), g.low + 90000) AS cut) y WHERE g.high - g.low > 90000 AND y.cut < g.high),
    c AS (SELECT uniq_id, no + 1 AS slice_no, low AS start_ms, coalesce(lead(low) OVER w, high) AS end_ms, high, lag(low) OVER w AS before, lead(low) OVER w IS NULL AS last FROM g WINDOW w AS (PARTITION BY uniq_id ORDER BY no)),
    j AS (SELECT *, last AND slice_no > 0 AND end_ms - start_ms < 60000 AND high - before <= 120000 AS joins FROM c WHERE end_ms > start_ms)"""
_GRID_ROWS = """SELECT uniq_id, CAST(slice_no AS INT) AS slice_no, start_ms, CASE WHEN coalesce(lead(joins) OVER (PARTITION BY uniq_id ORDER BY slice_no), false) THEN high ELSE end_ms END AS end_ms FROM j QUALIFY NOT joins"""


@registry.query("pause_grid", f"WITH RECURSIVE {_OWN}, {_GRID} {_GRID_ROWS}")
def pause_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slicing.pause_grid(table(spark, sf_dir, "runtime_turns"))


@registry.query(
    "turn_lines",
    r"""WITH x AS (SELECT coalesce(meeting_id || '.', '') || side AS file_id, start_s, end_s, coalesce(nullif(regexp_replace(trim(speaker), '\s+', '_', 'g'), ''), '<NA>') AS name FROM diar_segments WHERE end_s > start_s AND isfinite(start_s) AND isfinite(end_s)),
    y AS (SELECT file_id, CAST(round(round(start_s, 3) * 1000) AS BIGINT) AS onset_ms, greatest(CAST(round(round(end_s - start_s, 3) * 1000) AS BIGINT), 1) AS length_ms, nullif(name, '<NA>') AS speaker FROM x)
    SELECT file_id, onset_ms, length_ms, speaker, count(*) AS n FROM y GROUP BY ALL""",
)
def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speaker-turn lines of all turns with a length, written and parsed again."""
    rows = table(spark, sf_dir, "diar_segments").withColumn("file", F.concat_ws(".", "meeting_id", "side"))
    made = lines.rttm_lines(rows, "file", "start_s", "end_s", "speaker")
    back = lines.parse_rttm(made.select("value"))
    ms = lambda c: F.round(c * 1000).cast("long")
    return back.groupBy(
        "file_id", ms(F.col("start_s")).alias("onset_ms"), ms(F.col("end_s") - F.col("start_s")).alias("length_ms"), "speaker",
    ).agg(F.count(F.lit(1)).alias("n"))


@registry.query(
    "slice_words",
    f"""WITH {_TURNS_MS}, said AS (SELECT uniq_id, turn_index, min(reference_text) AS x FROM score_turns GROUP BY ALL), w AS (SELECT tt.uniq_id, s2, e2, len(regexp_extract_all(lower(x), '[a-z0-9]+')) AS n FROM tt JOIN said USING (uniq_id, turn_index) WHERE s2 < e2 AND length(trim(x)) > 0),
    k AS (SELECT *, unnest(range(s2 // 90000, (e2 - 1) // 90000 + 1)) AS slice_no FROM w)
    SELECT uniq_id, slice_no, count(*) AS turns, CAST(sum(n) AS BIGINT) AS words, CAST(sum(least(e2, (slice_no + 1) * 90000) - greatest(s2, slice_no * 90000)) AS BIGINT) AS ms FROM k GROUP BY ALL""",
)
def slice_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference words of each 90 s slice: times are clipped to the slice, texts are not, so a
    turn over an edge counts its words on both sides."""
    said = table(spark, sf_dir, "score_turns").groupBy("uniq_id", "turn_index").agg(F.min("reference_text").alias("x")).where(F.length(F.trim("x")) > 0)
    rows = _turns_ms(spark, sf_dir).where("s2 < e2").join(said, ["uniq_id", "turn_index"])
    rows = rows.withColumn("slice_no", F.explode(F.sequence(F.floor(F.col("s2") / 90_000), F.floor((F.col("e2") - 1) / 90_000))))
    s = F.col("slice_no") * 90_000
    ms = F.least("e2", s + 90_000) - F.greatest("s2", s)
    words = F.size(F.regexp_extract_all(F.lower("x"), F.lit("[a-z0-9]+"), F.lit(0)))
    return rows.groupBy("uniq_id", "slice_no").agg(F.count(F.lit(1)).alias("turns"), F.sum(words).alias("words"), F.sum(ms).alias("ms"))


def _said_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with text and times: uniq_id, turn_index, speaker, s, e, said."""
    from .text_plans import turns

    times = _turns_ms(spark, sf_dir).where("s2 < e2").groupBy("uniq_id", "turn_index").agg(F.min("s2").alias("s"), F.max("e2").alias("e"))
    rows = turns(spark, sf_dir).where("said is not null").join(times, ["uniq_id", "turn_index"])
    return rows.select("uniq_id", "turn_index", "speaker", "s", "e", "said")


def _timed_segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Segments of each request with the times of the turns in their places, and those turns."""
    ref = _said_turns(spark, sf_dir)
    asked = table(spark, sf_dir, "transcribed_segments").where("text is not null and request_id is not null")
    least = F.min(F.struct("text", F.coalesce("speaker", F.lit("")).alias("label"), "uniq_id"))
    one = asked.groupBy("request_id", "seg_ord").agg(least.alias("m")).select("request_id", "seg_ord", "m.*")
    hyp = speakers.resolved(one, table(spark, sf_dir, "speaker_roster"), "label")
    hyp = hyp.select("request_id", "seg_ord", "uniq_id", "speaker", text.word_tokens(F.col("text")).alias("words"))
    hyp = stored_table(hyp, "segments")  # both sides are read several times
    own = hyp.groupBy("request_id").agg(F.max("uniq_id").alias("uniq_id"))
    placed = ref.join(own, "uniq_id").select("request_id", "turn_index", "speaker", "s", "e", text.word_tokens(F.col("said")).alias("words"))
    placed = stored_table(placed, "placed")
    hyp = hyp.drop("uniq_id")
    bounds = placed.groupBy("request_id").agg(F.min("s").alias("low"), F.max("e").alias("high"))
    timed = matching.timed_by_place(hyp, placed, bounds, "request_id", "seg_ord", "turn_index")
    covered = matching.positional(placed, hyp.select("request_id", "seg_ord"), "request_id", "turn_index", "seg_ord")
    return timed, covered.where("a is not null and b is not null").select("request_id", "a.*")


@registry.query(
    "timed_segments",
    f"WITH {TURNS}, "
    + f"""{_TURNS_MS}, ti AS (SELECT uniq_id, turn_index, min(s2) AS s, max(e2) AS e FROM tt WHERE s2 < e2 GROUP BY ALL), re AS (SELECT t.uniq_id, t.turn_index, s, e FROM t JOIN ti USING (uniq_id, turn_index) WHERE said IS NOT NULL),
    hy AS (SELECT request_id, seg_ord, arg_min(uniq_id, (text, coalesce(speaker, ''), uniq_id)) AS uniq_id FROM transcribed_segments WHERE text IS NOT NULL AND request_id IS NOT NULL GROUP BY ALL),
    ow AS (SELECT request_id, max(uniq_id) AS uniq_id FROM hy GROUP BY request_id), pl AS (SELECT request_id, s, e, row_number() OVER (PARTITION BY request_id ORDER BY turn_index) AS k FROM re JOIN ow USING (uniq_id)),
    bo AS (SELECT request_id, min(s) AS low, max(e) AS high FROM pl GROUP BY request_id), hk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY seg_ord) AS k FROM hy)
    SELECT hk.request_id, seg_ord, coalesce(s, low) AS start_ms, coalesce(e, high) AS end_ms FROM hk LEFT JOIN pl ON pl.request_id = hk.request_id AND pl.k = hk.k LEFT JOIN bo ON bo.request_id = hk.request_id""",
)
def timed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with the times of the turns in their places, surplus ones with those of all."""
    return _timed_segments(spark, sf_dir)[0].select("request_id", "seg_ord", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


@registry.query("confusion_costs")
def confusion_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four word error counts of each request against the turns of its dialogue that it covers,
    with times by place (programmes over streams are no SQL; compared with brute force in tests)."""
    timed, covered = _timed_segments(spark, sf_dir)
    seconds = lambda c, none: (F.coalesce(c, F.lit(none)) / 1000.0)
    side = lambda df, ordinal: df.select(
        F.col("request_id").alias("session"), F.col(ordinal).alias("ordinal"), "speaker", seconds(F.col("s"), 0).alias("start_s"), seconds(F.col("e"), 1).alias("end_s"), "words"
    )
    return wer.session_scores(side(covered, "turn_index"), side(timed, "seg_ord"), 5.0)


@registry.query(
    "work_batches",
    """WITH RECURSIVE o AS (SELECT source_name, request_id, coalesce(completion_tokens, 0) AS c, row_number() OVER (PARTITION BY source_name ORDER BY recorded_utc NULLS FIRST, request_id) AS n FROM parse_results),
    f AS (SELECT source_name, request_id, n, 0 AS batch, CAST(c AS DOUBLE) AS used FROM o WHERE n = 1
      UNION ALL SELECT o.source_name, o.request_id, o.n, CASE WHEN f.used + o.c > 6000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.used + o.c > 6000 THEN o.c ELSE f.used + o.c END FROM f JOIN o ON o.source_name IS NOT DISTINCT FROM f.source_name AND o.n = f.n + 1)
    SELECT source_name, request_id, batch FROM f""",
)
def work_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of a source, in order, in batches of at most 6,000 answer tokens."""
    rows = table(spark, sf_dir, "parse_results").select("source_name", "recorded_utc", "request_id", "completion_tokens")
    return slicing.next_fit_batches(
        rows, ["source_name"], ["recorded_utc", "request_id"], "completion_tokens", 6_000,
    ).select("source_name", "request_id", "batch")

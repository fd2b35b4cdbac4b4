"""Rollups, cell selection, silences, logs, constraints and term supplies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import swapped
from .sampling import derangement
from .scoring import ratio
from .statistics import numbered


def outcome_rollup(rows: DataFrame, group: str, outcome: str = "outcome") -> DataFrame:
    """Rows, ok and failed ones per group, and a last row with ``total`` true over all."""
    out = rows.rollup(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) == "ok").alias("n_ok"),
        F.count_if(F.col(outcome) == "error").alias("n_error"), F.grouping(group).alias("_g"),
    )
    return out.select(group, "n", "n_ok", "n_error", (F.col("_g") == 1).alias("total"))


def answer_report(scored: DataFrame, f1: str, iou: str, answerable: Column) -> DataFrame:
    """One row: plain means of F1 and IoU over all examples and over answerable ones alone;
    a mean of nothing is null."""
    rows = scored.withColumn("_a", answerable)
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.agg(
        F.count(F.lit(1)).alias("examples"), mean(f1).alias("f1"), mean(iou).alias("iou"),
        mean(F.when(F.col("_a"), F.col(f1))).alias("f1_answerable"), mean(F.when(~F.col("_a"), F.col(f1))).alias("f1_other"),
    )


def source_counts(rows: DataFrame, key: str, source: str, sources: list[str]) -> DataFrame:
    """Rows per key and source, side by side, with the difference of the first two."""
    wide = rows.groupBy(key).agg(*[F.count_if(F.col(source) == s).alias(f"n_{s}") for s in sources])
    return wide.withColumn("delta", F.col(f"n_{sources[0]}") - F.col(f"n_{sources[1]}"))


def best_cells(cells: DataFrame, value: str, compliance: str, order: list[str], least: float = 0.9, within: float = 0.01) -> DataFrame:
    """Cells that pass the compliance gate and whose value is within ``within`` of the best, with
    ``winner`` on the first of them in ``order``. Cells are few: one row each."""
    passed = cells.where((F.col(compliance) >= least) & F.col(value).isNotNull())
    best = passed.agg(F.min(value).alias("_best"))
    tied = passed.crossJoin(F.broadcast(best)).where(F.col(value) <= F.col("_best") + within + 1e-9).drop("_best")  # one row
    first = tied.agg(F.min(F.struct(*order)).alias("_f"))
    return tied.crossJoin(F.broadcast(first)).withColumn("winner", F.struct(*order) == F.col("_f")).drop("_f")


def silences(frames: DataFrame, frame_ms: int = 20, floor: float = 0.15, least_ms: int = 1_000) -> DataFrame:
    """Runs of quiet frames (recording, frame, energy) of at least ``least_ms``: recording,
    start_ms, end_ms. Quiet is at most the exact ``floor`` quantile of the recording."""
    quiet = frames.groupBy("recording").agg(F.expr(f"percentile(energy, {floor})").alias("_q"))
    rows = frames.join(quiet, "recording").where(F.col("energy") <= F.col("_q"))
    island = F.col("frame") - F.row_number().over(Window.partitionBy("recording").orderBy("frame"))
    runs = rows.withColumn("_i", island).groupBy("recording", "_i").agg(
        (F.min("frame") * frame_ms).alias("start_ms"), ((F.max("frame") + 1) * frame_ms).alias("end_ms"),
    )
    return runs.where(F.col("end_ms") - F.col("start_ms") >= least_ms).drop("_i")


def log_entries(logs: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """One row per match of a pattern with groups in whole log texts (file, text): file, no,
    the groups by name. Files sort by the number in their name."""
    groups = [F.regexp_extract_all("text", F.lit(pattern), F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    rows = logs.select(
        "file", F.regexp_extract("file", r"(\d+)", 1).try_cast("long").alias("file_no"),
        F.posexplode(F.arrays_zip(*groups)).alias("no", "x"),
    )
    return rows.select("file", "file_no", "no", *[F.col(f"x.{n}").alias(n) for n in names])


def constraint_breaks(roster: DataFrame, key: str, members: dict[str, DataFrame]) -> DataFrame:
    """Broken constraints of a roster and its membership tables (key, split): a key twice in the
    roster, a member off the roster, a key in two splits. Columns: problem, where, key."""
    twice = roster.groupBy(key).count().where("count > 1").select(F.lit("repeated").alias("problem"), F.lit("roster").alias("where"), key)
    for name, rows in members.items():
        off = rows.select(key).distinct().join(roster.select(key), key, "left_anti").select(
            F.lit("unknown").alias("problem"), F.lit(name).alias("where"), key,
        )
        split = rows.groupBy(key).agg(F.count_distinct("split").alias("n")).where("n > 1").select(
            F.lit("two splits").alias("problem"), F.lit(name).alias("where"), key,
        )
        twice = twice.unionByName(off).unionByName(split)
    return twice


def term_supplies(entries: DataFrame, seed: str = "supply", least: int = 2, most: int = 8) -> DataFrame:
    """Terms that each of five arms hands to each chunk: arm, meeting, chunk, term, rank.

    ``entries`` has meeting, chunk, term and evidence. ``gated``: terms of all chunks so far
    with enough evidence; ``naive``: all of them; ``no_carry``: enough evidence in the chunk
    itself; ``scrambled``: naive with letters swapped; ``deranged``: the gated terms of
    another meeting's same chunk. Terms rank by evidence, then name, ``most`` an arm."""
    per = entries.groupBy("meeting", "chunk", "term").agg(F.sum("evidence").alias("evidence"))
    chunks = per.select("meeting", "chunk").distinct()
    # what is known at a chunk: a term's sums at its own chunks, carried on to later ones
    own = per.groupBy("meeting", "term").agg(F.sort_array(F.collect_list(F.struct("chunk", "evidence"))).alias("e"))  # a row a chunk
    known = chunks.join(own, "meeting").withColumn(
        "evidence",
        F.aggregate(F.filter("e", lambda x: x["chunk"] <= F.col("chunk")), F.lit(0).cast("long"), lambda a, x: a + x["evidence"]),
    ).where("evidence > 0").drop("e")
    gated = known.where(F.col("evidence") >= least)
    partner = derangement(chunks.select("meeting").distinct(), "meeting", seed, []).where("partner is not null")
    strange = partner.join(chunks, "meeting").join(
        gated.select(F.col("meeting").alias("partner"), "chunk", "term", "evidence"), ["partner", "chunk"],
    ).drop("partner")
    arms = {
        "gated": gated, "naive": known, "no_carry": per.where(F.col("evidence") >= least),
        "scrambled": known.withColumn("term", swapped(F.col("term"))), "deranged": strange,
    }
    rows = None
    for name, df in arms.items():
        df = df.select(F.lit(name).alias("arm"), "meeting", "chunk", "term", "evidence")
        rows = df if rows is None else rows.unionByName(df)
    order = Window.partitionBy("arm", "meeting", "chunk").orderBy(F.col("evidence").desc(), "term")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def index_interval(values: Column, low: float = 0.025, high: float = 0.975) -> Column:
    """Interval of a sorted array by fixed places: floor(low * n) and floor(high * n) - 1."""
    n = F.size(values)
    return F.struct(
        F.element_at(values, F.floor(n * low).cast("int") + 1).alias("low"),
        F.element_at(values, F.greatest(F.floor(n * high).cast("int"), F.lit(1))).alias("high"),
    )


def rate_table(rows: DataFrame, keys: list[str], hit: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"), ratio(F.count_if(hit), F.count(F.lit(1))).alias("rate"),
    )


def markdown_table(rows: DataFrame, most: int = 200) -> str:
    """A small result as a table for a report; more than ``most`` rows are refused."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cells = [rows.columns, ["---"] * len(rows.columns), *[["" if v is None else str(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in cells)


def view(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows with one value of a column, null being a value like others."""
    return rows.where(F.col(column).eqNullSafe(F.lit(value)))


def arm_contrasts(scores: DataFrame, group: str, arm: str, metrics: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Per metric and pair of arms: groups that both arms scored, groups dropped because one has
    no score, and the mean gap (second less first). ``scores`` has one row a group and arm."""
    cells = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics]))
    long = scores.select(group, arm, cells)
    out = None
    for first, second in pairs:
        a, b = (long.where(F.col(arm) == name).select(group, "metric", F.col("x").alias(x)) for name, x in ((first, "a"), (second, "b")))
        both = F.col("a").isNotNull() & F.col("b").isNotNull()
        rows = a.join(b, [group, "metric"], "full").groupBy("metric").agg(
            F.count_if(both).alias("paired"), F.count_if(~both).alias("dropped"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("gap"),
        )
        rows = rows.select("metric", F.lit(first).alias("first_arm"), F.lit(second).alias("second_arm"), "paired", "dropped", "gap")
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_health(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Replies (raw_text, parse_mode, n_segments, completion_tokens, max_tokens) per ``keys``:
    missing and empty ones, capped ones, parse modes, and abstentions that did parse."""
    mode = lambda m: F.count_if(F.col("parse_mode") == m).alias(m)
    return replies.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("replies"), F.count_if(F.col("raw_text").isNull()).alias("missing"),
        F.count_if(F.length(F.trim("raw_text")) == 0).alias("empty"),
        F.count_if(F.col("completion_tokens") >= F.col("max_tokens")).alias("capped"),
        mode("strict"), mode("lenient"), mode("failed"),
        F.count_if((F.col("parse_mode") != "failed") & (F.col("n_segments") == 0)).alias("abstained"),
    )


def task_order(tasks: DataFrame, order: list[str]) -> DataFrame:
    """Tasks with ``place`` from 1 in the order of priority and arrival: range partitions are
    numbered on their own."""
    key = tasks.withColumn("_key", F.struct(*order))
    rows, _ = numbered(key, "_key")
    return rows.withColumn("place", (F.col("_i") + 1).cast("long")).drop("_key", "_i")


def histograms(rows: DataFrame, features: dict[str, str], upto: list[int], hit: str) -> DataFrame:
    """Per feature (name: column) and class of its value (up to each bound, over the last one, and
    ``unknown``): feature, level, n and hits, in one pass."""

    def level(c: Column) -> Column:
        out, low = F.when(c.isNull(), "unknown"), None
        for bound in upto:
            name = str(bound) if low is None or low + 1 == bound else f"{low + 1}-{bound}"
            out, low = out.when(c <= bound, name), bound
        return out.otherwise(f"{low + 1}+")

    cells = F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), level(F.col(c)).alias("level")) for n, c in features.items()]))
    long = rows.select(F.col(hit).alias("_hit"), cells)
    return long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"), F.count_if("_hit").alias("hits"))


def eligible(lists: list[DataFrame], roster: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Keys of several lists together, each once, that are on the roster and not excluded."""
    rows = lists[0]
    for other in lists[1:]:
        rows = rows.unionByName(other)
    return rows.where(F.col(key).isNotNull()).distinct().join(roster.select(key).distinct(), key, "left_semi").join(
        excluded.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti",
    )


def ceilings(receipts: DataFrame, keys: list[str], cost: str, ceiling: float) -> DataFrame:
    """Receipts per ``keys``: calls, total cost, its share of a ceiling and whether it is over."""
    total = F.coalesce(F.sum(cost), F.lit(0)).alias("total")
    rows = receipts.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), total)
    return rows.withColumn("share", F.round(F.col("total") / F.lit(float(ceiling)), 6)).withColumn("over", F.col("total") > ceiling)

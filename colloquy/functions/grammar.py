"""Grammars of model replies, line by line, as Column expressions.

Replies are untrusted text: a line that fits no grammar is data, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three forms of a reply line.
STRICT_LINE = r"^([^|\n]+)\|(.+)$"
BRACKET_LINE = r"^\[([^\]\n]+)\]\s*(.+)$"
COLON_LINE = r"^([A-Za-z0-9 _.\-]{1,40}?):\s*(.+)$"


def reply_lines(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Lines that are not blank: the keys, line_no from 0, line, ``form`` (strict, lenient or
    malformed), speaker and said. Null and empty replies have no lines."""
    lines = F.filter(F.split(F.col(text), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.posexplode(lines).alias("line_no", "line"))
    line = F.trim("line")
    found = [(form, F.regexp_extract(line, p, 1), F.regexp_extract(line, p, 2)) for form, p in (("strict", STRICT_LINE), ("lenient", BRACKET_LINE), ("lenient", COLON_LINE))]
    form = speaker = said = None
    for name, who, what in found:
        good = (F.trim(who) != "") & (F.trim(what) != "")
        form = F.when(good, F.lit(name)) if form is None else form.when(good, F.lit(name))
        speaker = F.when(good, F.trim(who)) if speaker is None else speaker.when(good, F.trim(who))
        said = F.when(good, F.trim(what)) if said is None else said.when(good, F.trim(what))
    return rows.select(
        *keys, "line_no", line.alias("line"), form.otherwise(F.lit("malformed")).alias("form"), speaker.alias("speaker"),
        said.alias("said"),
    )


def reply_modes(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Per reply: lines, strict, lenient and malformed ones, mode (strict: all lines are;
    lenient: some line is parsed; failed) and compliance, the share of strict lines."""
    counts = reply_lines(df, text, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), *[F.count_if(F.col("form") == f).alias(f) for f in ("strict", "lenient", "malformed")]
    )
    mode = F.when(F.col("strict") == F.col("lines"), "strict").when(F.col("strict") + F.col("lenient") > 0, "lenient").otherwise("failed")
    return counts.withColumn("mode", mode).withColumn("compliance", F.round(F.col("strict") / F.col("lines"), 6))


def minutes_bullets(
    df: DataFrame, text: str, keys: list[str], sections: tuple[str, ...] = ("ABSTRACT", "ACTIONS", "DECISIONS", "PROBLEMS"),
) -> DataFrame:
    """Bullets of minutes: the keys, section, n from 0, body, speaker and span of the
    evidence tag ``[evidence: speaker|span]`` (null without one).

    A line that names a section, in any case and with or without a colon, opens it; bullets
    before any section are dropped; a bullet is a line that begins with ``-``. The section is
    carried inside each reply, so no window spans replies.
    """
    is_head = lambda x: F.upper(F.regexp_replace(F.trim(x), r"^#+\s*|:$", "")).isin(*sections)
    lines = F.filter(F.split(F.col(text), r"\r\n|\n|\r"), lambda x: F.trim(x) != "")

    def step(state: Column, line: Column) -> Column:
        section = F.when(is_head(line), F.upper(F.regexp_replace(F.trim(line), r"^#+\s*|:$", ""))).otherwise(state["section"])
        bullet = (~is_head(line)) & line.rlike(r"^\s*-\s*\S") & state["section"].isNotNull()
        n = F.when(is_head(line), F.lit(0)).when(bullet, state["n"] + 1).otherwise(state["n"])
        row = F.struct(
            state["section"].alias("section"), state["n"].alias("n"), F.trim(F.regexp_replace(line, r"^\s*-\s*", "")).alias("body"),
        )
        return F.struct(
            section.alias("section"), n.alias("n"),
            F.when(bullet, F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"),
        )

    start = F.struct(
        F.lit(None).cast("string").alias("section"), F.lit(0).alias("n"),
        F.array().cast("array<struct<section:string,n:int,body:string>>").alias("out"),
    )
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.inline(F.aggregate(lines, start, step)["out"]))
    tag = r"\[evidence:\s*([^|\]]*)\|([^\]]*)\]\s*$"
    has = F.col("body").rlike(tag)
    return rows.select(
        *keys, "section", "n", F.trim(F.regexp_replace("body", tag, "")).alias("body"),
        F.when(has, F.trim(F.regexp_extract("body", tag, 1))).alias("speaker"),
        F.when(has, F.trim(F.regexp_extract("body", tag, 2))).alias("span"),
    )


def answers(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Per reply: answers (array, in order), abstained, mode. A real answer beats an
    abstention; ``ANSWER: x`` is strict, a bare line only counts where there is nothing else."""
    lines = F.filter(F.transform(F.split(F.col(text), r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    strict = F.filter(
        F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"^(?i:answer)\s*[:|]\s*(.+)$", 1))),
        lambda x: (x != "") & (F.upper(x) != "ABSTAIN"),
    )
    abstains = F.exists(lines, lambda x: x.rlike(r"^(?i)(answer\s*[:|]\s*)?abstain\.?$"))
    bare = F.filter(lines, lambda x: ~x.rlike(r"^(?i)(answer\s*[:|]|abstain)"))
    found = F.when(F.size(strict) > 0, strict).when(~abstains, bare).otherwise(F.array().cast("array<string>"))
    rows = df.where(F.col(text).isNotNull()).select(
        *keys, lines.alias("_l"), strict.alias("_s"), abstains.alias("_a"), found.alias("answers"),
    )
    mode = F.when((F.size("_s") > 0) | F.col("_a"), "strict").when(F.size("answers") > 0, "lenient").otherwise("failed")
    return rows.select(*keys, "answers", ((F.size("answers") == 0) & F.col("_a")).alias("abstained"), mode.alias("mode"))


def section_texts(bullets: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Bullets (key, section, body and the order columns) of several replies as one text per
    section, in order, a line each: key, section, n, text."""
    item = F.struct(*order, "body")
    rows = bullets.groupBy(key, "section").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("_b"))
    return rows.select(key, "section", "n", F.array_join(F.transform("_b", lambda x: x["body"]), "\n").alias("text"))

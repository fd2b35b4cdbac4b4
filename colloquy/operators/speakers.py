"""Speakers behind raw labels: numbers, and names or roles of a roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed

NUMBERED = r"^(?:speaker|spkr?|s)[\s_\-]*0*(\d+)$"


def label_form(label: Column) -> Column:
    """A label in lower case without brackets and colons; no label is the empty one."""
    return F.coalesce(F.lower(squeezed(F.regexp_replace(label, r"^[\s<\[>]+|[\s:|>\]]+$", ""))), F.lit(""))


def roster_forms(roster: DataFrame, key: str = "uniq_id") -> DataFrame:
    """key, form and n of each way to name a speaker of a roster (key, speaker_no, display_name,
    role_title) that one speaker only has."""
    name = F.lower(squeezed(F.col("display_name")))
    first, last = F.substring_index(name, " ", 1), F.substring_index(name, " ", -1)
    initial = F.concat(F.substring(first, 1, 1), F.lit(". "), last)
    forms = F.array(name, first, last, initial, F.concat(last, F.lit(", "), first), F.lower(squeezed(F.col("role_title"))))
    rows = roster.select(key, "speaker_no", F.explode(F.array_distinct(forms)).alias("form")).where("form <> ''").groupBy(key, "form")
    return rows.agg(F.min("speaker_no").alias("n"), F.max("speaker_no").alias("_m")).where("n = _m").select(key, "form", "n")


def resolved(rows: DataFrame, roster: DataFrame, label: str, key: str = "uniq_id") -> DataFrame:
    """Adds ``speaker``: ``#n`` of a numbered label, or of a name or role that one roster entry of
    the key has; any other label stands for itself, none for the empty one. Without a roster
    only numbers are known; rows are neither lost nor doubled."""
    known = roster_forms(roster, key).select(F.col(key).alias("_key"), F.col("form").alias("_known"), F.col("n").alias("_n"))
    number = F.nullif(F.regexp_extract("_form", NUMBERED, 1), F.lit(""))
    joined = rows.withColumn("_form", label_form(F.col(label)))
    joined = joined.join(known, (F.col(key) == F.col("_key")) & (F.col("_form") == F.col("_known")), "left")
    speaker = F.coalesce(F.concat(F.lit("#"), F.coalesce(number, F.col("_n").cast("string"))), F.col("_form"))
    return joined.withColumn("speaker", speaker).drop("_form", "_key", "_known", "_n")

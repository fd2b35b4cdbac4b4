"""Line formats: speaker-turn (RTTM) lines, aligned-token lines, JSON lines of responses.

Parsing works on DataFrames of lines, reading and writing files is beside it, so either
can be used alone. Schemas are explicit; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESPONSE_SCHEMA = "request_id STRING, uniq_id STRING, arm STRING, outcome STRING, text STRING, usage MAP<STRING, BIGINT>, max_tokens INT, recorded_utc STRING"


def parse_rttm(lines: DataFrame, value: str = "value") -> DataFrame:
    """SPEAKER lines: file_id, channel, start_s, end_s, speaker, with the other columns kept.

    Comments (``;``), blank lines and other record types are left out. A SPEAKER line that is
    short, has bad times or a length that is not positive makes the read fail."""
    fields = F.split(F.trim(value), r"\s+")
    rows = lines.where(~F.trim(F.col(value)).startswith(";")).withColumn("_f", fields).where(F.get("_f", F.lit(0)) == "SPEAKER")
    onset, length = F.expr("try_cast(_f[3] AS DOUBLE)"), F.expr("try_cast(_f[4] AS DOUBLE)")
    rows = rows.withColumn("_ok", (F.size("_f") >= 8) & onset.isNotNull() & (length > 0))
    checked = lambda c: F.when(F.coalesce("_ok", F.lit(False)), c).otherwise(F.raise_error(F.concat(F.lit("bad speaker line: "), F.col(value))))
    kept = [c for c in lines.columns if c != value]
    return rows.select(
        *kept, F.get("_f", F.lit(1)).alias("file_id"), F.get("_f", F.lit(2)).alias("channel"),
        checked(onset).cast("double").alias("start_s"), checked(onset + length).cast("double").alias("end_s"),
        F.nullif(F.get("_f", F.lit(7)), F.lit("<NA>")).alias("speaker"),
    )


def rttm_lines(turns: DataFrame, file_id: str, start: str, end: str, speaker: str, channel: str = "1") -> DataFrame:
    """One line per turn of positive length, three decimals, columns file_id and value. A length
    that three decimals do not show is written as one of them, so that no turn is lost."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = turns.where((F.col(end) > F.col(start)) & finite(start) & finite(end))
    name = F.coalesce(F.nullif(F.regexp_replace(F.trim(speaker), r"\s+", "_"), F.lit("")), F.lit("<NA>"))
    value = F.concat_ws(
        " ", F.lit("SPEAKER"), F.col(file_id), F.lit(channel), F.format_string("%.3f", F.col(start)),
        F.format_string("%.3f", F.greatest(F.col(end) - F.col(start), F.lit(0.001))), F.lit("<NA> <NA>"), name, F.lit("<NA> <NA>"),
    )
    return good.select(F.col(file_id).alias("file_id"), value.alias("value"))


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    return parse_rttm(spark.read.text(path).withColumn("path", F.col("_metadata.file_path")))


def write_rttm(lines: DataFrame, path: str) -> None:
    """A folder of text files per file_id; an earlier result is never overwritten."""
    lines.repartition("file_id").sortWithinPartitions("file_id", "value").write.mode("errorifexists").partitionBy("file_id").text(path)


def entity_mentions(tokens: DataFrame, document: str = "document") -> DataFrame:
    """Mentions in aligned tokens (document, ord, token, speaker, ts, entity, kind): a run of
    neighbouring tokens with the same entity id. An id that comes back after another token
    makes the read fail. Columns: document, entity, kind, speaker, surface, ts (the least
    known), first_ord."""
    order = Window.partitionBy(document).orderBy("ord")
    marked = tokens.withColumn("_n", F.row_number().over(order)).where(F.col("entity").isNotNull())
    own = Window.partitionBy(document, "entity").orderBy("_n")
    runs = marked.withColumn("_run", F.col("_n") - F.row_number().over(own))
    rows = runs.groupBy(document, "entity").agg(
        F.count_distinct("_run").alias("_runs"), F.min("kind").alias("kind"), F.min("speaker").alias("speaker"),
        F.count_distinct("kind", "speaker").alias("_kinds"), F.min("ts").alias("ts"), F.min("ord").alias("first_ord"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "token"))), lambda x: x["token"]), " ").alias("surface"),
    )
    bad = (F.col("_runs") > 1) | (F.col("_kinds") > 1)
    surface = F.when(bad, F.raise_error(F.concat(F.lit("entity is not one run: "), F.col("entity")))).otherwise(F.col("surface"))
    return rows.select(document, "entity", "kind", "speaker", surface.alias("surface"), "ts", "first_ord")


def aligned_tokens(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tokens of pipe-delimited lines (document, ord, value) with 11 or 12 columns: token,
    speaker, ts, and of ``[id:kind]`` tags the first one."""
    f = F.split(F.col(value), r"\|")
    tag = F.get(f, F.lit(7))
    return lines.where(F.size(f) >= 11).select(
        "document", "ord", F.get(f, F.lit(0)).alias("token"), F.get(f, F.lit(1)).alias("speaker"),
        F.expr("try_cast(split(value, '\\\\|')[2] AS DOUBLE)").alias("ts"),
        F.nullif(F.regexp_extract(tag, r"'(\w+):", 1), F.lit("")).alias("entity"),
        F.nullif(F.regexp_extract(tag, r"'\w+:(\w+)'", 1), F.lit("")).alias("kind"),
    )


def read_responses(spark: SparkSession, path: str, schema: str = RESPONSE_SCHEMA) -> DataFrame:
    """JSON lines with the file they stand in; a torn last line is dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("file_name", F.col("_metadata.file_name"))


def last_responses(responses: DataFrame, keys: list[str], order: list[str], outcome: str = "ok") -> DataFrame:
    """The last response of each key with the outcome, by ``order``."""
    rest = [c for c in responses.columns if c not in keys]
    picked = responses.where(F.col("outcome") == outcome).groupBy(*keys).agg(
        F.max(F.struct(*order, *[c for c in rest if c not in order and dict(responses.dtypes)[c][:3] != "map"])).alias("_p")
    )
    return picked.select(*keys, "_p.*")


def still_to_do(requests: DataFrame, responses: DataFrame, keys: list[str], outcome: str = "ok") -> DataFrame:
    """Requests without a response of the outcome; failed ones are asked again."""
    return requests.join(responses.where(F.col("outcome") == outcome).select(*keys).distinct(), keys, "left_anti")


def append_responses(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def table_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and an order-independent hash of the columns, for locks and receipts."""
    row = F.xxhash64(*[F.col(c) for c in sorted(columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("hash"))

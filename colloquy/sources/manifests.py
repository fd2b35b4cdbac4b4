"""Frozen manifests: small JSON documents with a schema version and a content hash.

Reading is a table like any other: documents come in as rows of text, every fault of every
document is a row of ``manifest_breaks``, and documents without one give the rows they hold.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A manifest is a document on the driver; larger tables are no manifests.
MOST_ROWS = 100_000


def content_hash(document: dict[str, Any]) -> str:
    """sha256 of the canonical JSON (sorted keys, ASCII, no blanks) of all keys but the hash."""
    plain = {k: v for k, v in document.items() if k != "content_hash"}
    return hashlib.sha256(json.dumps(plain, sort_keys=True, ensure_ascii=True, separators=(",", ":")).encode()).hexdigest()


def write_manifest(rows: DataFrame, path: str, schema_version: str) -> dict[str, Any]:
    """Rows as one document; an earlier manifest is never overwritten."""
    found = [r.asDict(recursive=True) for r in rows.limit(MOST_ROWS + 1).collect()]
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows")
    document = {"schema_version": schema_version, "rows": sorted(found, key=lambda r: json.dumps(r, sort_keys=True, default=str))}
    document["content_hash"] = content_hash(document)
    with Path(path).open("x", encoding="utf-8") as f:
        json.dump(document, f, sort_keys=True, indent=1)
    return document


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as text: path, value; an empty file has no row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


_TOLD = T.StructType(
    [
        T.StructField("version", T.StringType()), T.StructField("hash_holds", T.BooleanType()),
        T.StructField("repeated", T.ArrayType(T.StringType())), T.StructField("broken", T.StringType()),
    ]
)


@F.pandas_udf(_TOLD)
def _told(values: pd.Series) -> pd.DataFrame:
    """What a document says of itself: its version, whether its hash is that of its content,
    the keys some object has twice, and why it cannot be read, if it can't."""
    rows = []
    for value in values:
        twice: list[str] = []

        def once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
            seen: set[str] = set()
            twice.extend(k for k, _ in pairs if k in seen or seen.add(k))  # noqa: B023
            return dict(pairs)

        try:
            document = json.loads(value, object_pairs_hook=once)
        except (TypeError, ValueError) as error:
            rows.append((None, None, [], str(error)))
            continue
        if not isinstance(document, dict):
            rows.append((None, None, [], "no object"))
            continue
        version = document.get("schema_version")
        rows.append(
            (None if version is None else str(version), document.get("content_hash") == content_hash(document), sorted(set(twice)), None)
        )
    return pd.DataFrame(rows, columns=["version", "hash_holds", "repeated", "broken"])


def manifest_breaks(documents: DataFrame, schema_version: str) -> DataFrame:
    """All faults of documents (path, value): path, problem (``unreadable``, ``version``, ``hash``
    or ``repeated key``) and detail. A null document is unreadable."""
    told = documents.select("path", _told("value").alias("t"))
    problem = lambda name, detail: F.struct(F.lit(name).alias("problem"), detail.alias("detail"))
    readable = F.col("t.broken").isNull()
    found = F.concat(
        F.array(
            F.when(~readable, problem("unreadable", F.col("t.broken"))),
            F.when(
                readable & ~F.coalesce(F.col("t.version") == schema_version, F.lit(False)),
                problem("version", F.coalesce("t.version", F.lit("none"))),
            ),
            F.when(readable & ~F.coalesce("t.hash_holds", F.lit(False)), problem("hash", F.lit("the content is not what was hashed"))),
        ),
        F.transform("t.repeated", lambda k: problem("repeated key", k)),
    )
    return told.select("path", F.inline(F.array_compact(found)))


def manifest_rows(documents: DataFrame, schema_version: str, row_schema: str) -> DataFrame:
    """Rows of the documents without a fault, with their path; ``row_schema`` is that of a row."""
    good = documents.join(manifest_breaks(documents, schema_version).select("path").distinct(), "path", "left_anti")
    return good.select("path", F.inline(F.from_json("value", f"rows array<struct<{row_schema}>>")["rows"]))


def missing_files(rows: DataFrame, identifier: str, files: DataFrame, template: str) -> DataFrame:
    """Ids whose file, named by the template with ``{id}``, is not in a listing (name)."""
    before, _, after = template.partition("{id}")
    wanted = rows.select(identifier).where(F.col(identifier).isNotNull()).distinct().withColumn(
        "name", F.concat(F.lit(before), F.col(identifier), F.lit(after)),
    )
    return wanted.join(files.select("name"), "name", "left_anti")


def registry_breaks(registry: DataFrame, counts: dict[str, dict[str, int]], members: dict[str, DataFrame]) -> DataFrame:
    """Broken constraints of a registry (meeting and columns): ``count`` of a column's value that is
    not the expected one, ``unknown`` members that the registry lacks, and ``uncovered``
    meetings that a member list (meeting) lacks: problem, where, what."""
    rows = registry.groupBy("meeting").count().where("count > 1").select(
        F.lit("repeated").alias("problem"), F.lit("registry").alias("where"), F.col("meeting").alias("what"),
    )
    for column, expected in counts.items():
        cells = F.inline(F.array(*[F.struct(F.lit(v).alias("v"), F.lit(n).cast("long").alias("n")) for v, n in expected.items()]))
        wanted = registry.sparkSession.range(1).select(cells)
        found = registry.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("m"))
        off = wanted.join(found, "v", "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0)))
        rows = rows.unionByName(
            off.select(
                F.lit("count").alias("problem"), F.lit(column).alias("where"),
                F.concat_ws(" ", F.coalesce("v", F.lit("none")), F.coalesce("m", F.lit(0)).cast("string")).alias("what"),
            )
        )
    for name, df in members.items():
        listed, known = df.select("meeting").distinct(), registry.select("meeting").distinct()
        for problem, extra in (
            ("unknown", listed.join(known, "meeting", "left_anti")), ("uncovered", known.join(listed, "meeting", "left_anti")),
        ):
            rows = rows.unionByName(
                extra.select(F.lit(problem).alias("problem"), F.lit(name).alias("where"), F.col("meeting").alias("what"))
            )
    return rows

"""JSON documents, archives and audio headers."""

from __future__ import annotations

import io
import tarfile
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

QA_SCHEMA = "data ARRAY<STRUCT<id: STRING, title: STRING, question: STRING, context: STRING, is_impossible: BOOLEAN, answers: STRUCT<text: ARRAY<STRING>, answer_start: ARRAY<INT>>>>"
SPAN_SCHEMA = "data ARRAY<STRUCT<id: STRING, question: ARRAY<STRING>, context: ARRAY<STRING>, labels: ARRAY<STRING>>>"
TRANSCRIPT_SCHEMA = "meeting_transcripts ARRAY<STRUCT<speaker: STRING, content: STRING>>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions: id, meeting (title), question, context, unanswerable, flat_answers."""
    rows = spark.read.schema(QA_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("data").alias("d"))
    return rows.select(
        "d.id", F.col("d.title").alias("meeting"), "d.question", "d.context", F.col("d.is_impossible").alias("unanswerable"),
        F.col("d.answers.text").alias("flat_answers"),
    )


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Multi-span answers: id and the spans its labels mark."""
    from ..functions.text import tag_runs

    rows = spark.read.schema(SPAN_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("data").alias("d"))
    return rows.select("d.id", tag_runs(F.col("d.context"), F.col("d.labels")).alias("spans"))


def answered(questions: DataFrame, spans: DataFrame) -> DataFrame:
    """Questions with ``answers`` and where they come from: unanswerable (none), spans, flat."""
    rows = questions.join(spans, "id", "left")
    none = F.coalesce("unanswerable", F.lit(False)) | ((F.size(F.coalesce("spans", F.array().cast("array<string>"))) == 0) & F.col("spans").isNotNull())
    answers = F.when(none, F.array().cast("array<string>")).when(F.col("spans").isNotNull(), F.col("spans")).otherwise(F.coalesce("flat_answers", F.array().cast("array<string>")))
    source = F.when(none, "unanswerable").when(F.col("spans").isNotNull(), "spans").otherwise("flat")
    return rows.withColumn("answers", answers).withColumn("answer_source", source).drop("spans", "flat_answers")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Turns of transcript documents: meeting (file name), ord, speaker, content."""
    rows = spark.read.schema(TRANSCRIPT_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    rows = rows.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.json)?$", 1).alias("meeting"),
        F.posexplode("meeting_transcripts").alias("ord", "t"),
    )
    return rows.select("meeting", "ord", "t.speaker", "t.content")


class _TarPart(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        import glob

        self.paths = sorted(glob.glob(options["path"]))

    def partitions(self) -> list[_TarPart]:
        return [_TarPart(p) for p in self.paths]

    def read(self, partition: _TarPart) -> Iterator[tuple]:
        import hashlib

        with tarfile.open(partition.path) as tar:  # members are streamed; none is held whole
            for n, member in enumerate(tar):
                if not member.isfile():
                    continue
                digest, stream = hashlib.sha256(), tar.extractfile(member)
                while block := stream.read(1 << 20):
                    digest.update(block)
                yield partition.path.rpartition("/")[2], n, member.name, member.name.rpartition("/")[2].rpartition(".")[0], member.size, digest.hexdigest()


class TarIndex(DataSource):
    """``spark.read.format("tar_index").load(glob)``: one row per member, a partition a tar."""

    @classmethod
    def name(cls) -> str:
        return "tar_index"

    def schema(self) -> str:
        return "tar STRING, ord INT, member STRING, stem STRING, bytes BIGINT, sha256 STRING"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _TarReader(self.options)


def read_tar_index(spark: SparkSession, pattern: str) -> DataFrame:
    spark.dataSource.register(TarIndex)
    return spark.read.format("tar_index").load(pattern)


@F.pandas_udf(T.DoubleType())
def wave_seconds(content: pd.Series) -> pd.Series:
    """Seconds of PCM wave files from their headers; null where a file is none."""

    def seconds(data: bytes | None) -> float | None:
        try:
            with wave.open(io.BytesIO(data)) as w:
                return w.getnframes() / w.getframerate()
        except (wave.Error, EOFError, TypeError):
            return None

    return content.map(seconds)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder: name, bytes, modified; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def lock_breaks(files: DataFrame, expected: DataFrame, tolerance: int = 4_096) -> DataFrame:
    """Files (name, bytes) that are missing, not expected or off by more than ``tolerance``."""
    rows = expected.select("name", F.col("bytes").alias("expected")).join(files.select("name", "bytes"), "name", "full")
    state = F.when(F.col("bytes").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(
        F.abs(F.col("bytes") - F.col("expected")) > tolerance, "size",
    )
    return rows.withColumn("problem", state).where(F.col("problem").isNotNull())


@F.pandas_udf(T.BinaryType())
def wave_slice(content: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """PCM wave files cut to [start, end) seconds, clipped to the file; null where a file is no
    wave or nothing is left."""

    def cut(data: bytes | None, a: float, b: float) -> bytes | None:
        try:
            with wave.open(io.BytesIO(data)) as w:
                rate = w.getframerate()
                first, last = max(0, round(a * rate)), min(w.getnframes(), round(b * rate))
                if last <= first:
                    return None
                w.setpos(first)
                out = io.BytesIO()
                with wave.open(out, "wb") as o:
                    o.setparams(w.getparams())
                    o.writeframes(w.readframes(last - first))
                return out.getvalue()
        except (wave.Error, EOFError, TypeError, ValueError):
            return None

    return pd.Series([cut(c, a, b) for c, a, b in zip(content, start, end)], dtype=object)


def mono(data: bytes | None, rate: int, start: float = 0.0, end: float | None = None) -> bytes | None:
    """A PCM wave file (8, 16 or 32 bits) of [start, end) seconds as 16-bit mono at a rate, by
    linear interpolation; None where it is no such file or nothing is left."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            own, channels, width = w.getframerate(), w.getnchannels(), w.getsampwidth()
            first, last = max(0, round(start * own)), w.getnframes() if end is None else min(w.getnframes(), round(end * own))
            if last <= first or width not in (1, 2, 4):
                return None
            w.setpos(first)
            raw = np.frombuffer(w.readframes(last - first), {1: "u1", 2: "<i2", 4: "<i4"}[width]).astype(np.float64)
    except (wave.Error, EOFError, TypeError, ValueError):
        return None
    level = {1: lambda x: (x - 128) * 256, 2: lambda x: x, 4: lambda x: x / 65_536}[width](raw.reshape(-1, channels).mean(1))
    n = round(len(level) * rate / own)
    samples = level if own == rate else np.interp(np.arange(n) * own / rate, np.arange(len(level)), level)
    out = io.BytesIO()
    with wave.open(out, "wb") as o:
        o.setnchannels(1)
        o.setsampwidth(2)
        o.setframerate(rate)
        o.writeframes(np.clip(np.rint(samples), -32_768, 32_767).astype("<i2").tobytes())
    return out.getvalue()


def audio_clips(rows: DataFrame, content: str, start: str, end: str, rate: int = 16_000) -> DataFrame:
    """Adds ``clip``, [start, end) seconds of a wave file as 16-bit mono at a rate, and its
    ``sha256``; both null where there is nothing to cut. A file's bytes are one value, so
    files must fit in a task."""

    @F.pandas_udf(T.BinaryType())
    def cut(data: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [mono(x, rate, s, e) if x is not None and s == s and e == e else None for x, s, e in zip(data, a, b)], dtype=object,
        )

    return rows.withColumn("clip", cut(content, start, end)).withColumn("sha256", F.sha2("clip", 256))

"""Stand-off annotation: XML layers of a meeting and the pointers between them.

Files are read whole (``binaryFile``, one row a file) and parsed into rows with explicit
ordinals; pointers like ``file#id(a)..id(b)`` are resolved by joins on file and ordinal.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTER = r"^([^#]+)#id\(([^)]+)\)(?:\.\.id\(([^)]+)\))?$"
ELEMENTS = "file STRING, ord INT, depth INT, parent INT, tag STRING, id STRING, start_s DOUBLE, end_s DOUBLE, punc BOOLEAN, kind STRING, text STRING, href STRING"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content",
    )


def layers(files: DataFrame) -> DataFrame:
    """Layers there are of each meeting, from file names ``meeting.agent.layer.xml`` or
    ``meeting.layer.xml`` only; file contents are not read."""
    parts = F.split("file", r"\.")
    rows = files.select("file", parts.alias("p")).where(F.size("p").between(3, 4) & (F.element_at("p", -1) == "xml"))
    agent = F.when(F.size("p") == 4, F.get("p", F.lit(1)))
    return rows.groupBy(F.get("p", F.lit(0)).alias("meeting")).agg(
        F.array_sort(F.collect_set(F.element_at("p", -2))).alias("layers"), F.array_sort(F.collect_set(agent)).alias("agents"),
    )


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _number(x: str | None) -> float | None:
    try:
        return float(x) if x is not None else None
    except ValueError:
        return None


def elements(files: DataFrame) -> DataFrame:
    """Every element below the root in document order. ``href`` is that of a pointer element;
    bad numbers are null; a file that is no XML makes the read fail."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, content in zip(batch["file"], batch["content"]):
                n = 0
                todo = [(child, 1, None) for child in reversed(list(ET.fromstring(content)))]
                while todo:
                    e, depth, parent = todo.pop()
                    a = {_local(k): v for k, v in e.attrib.items()}
                    rows.append(
                        (
                            file, n, depth, parent, _local(e.tag), a.get("id"), _number(a.get("starttime") or a.get("transcriber_start")),
                            _number(a.get("endtime") or a.get("transcriber_end")), a.get("punc") == "true", a.get("type"),
                            (e.text or "").strip() or None, a.get("href"),
                        )
                    )
                    todo += [(child, depth + 1, n) for child in reversed(list(e))]
                    n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    return files.select("file", "content").mapInPandas(parse, ELEMENTS)


def pointer(href: Column) -> Column:
    """file, start_id and end_id (the start's where there is one id); a malformed pointer
    makes the read fail, a null one is null."""
    part = lambda i: F.regexp_extract(href, POINTER, i)
    parsed = F.struct(part(1).alias("file"), part(2).alias("start_id"), F.when(part(3) != "", part(3)).otherwise(part(2)).alias("end_id"))
    return F.when(href.isNull(), F.lit(None)).when(href.rlike(POINTER), parsed).otherwise(F.raise_error(F.concat(F.lit("malformed pointer: "), href)))


def words(rows: DataFrame) -> DataFrame:
    """Word-layer rows with an id: file, ord, id, tag, text (of words only), times, punc."""
    return rows.where(F.col("id").isNotNull() & (F.col("depth") == 1)).select(
        "file", "ord", "id", F.col("tag").alias("kind"), F.when(F.col("tag") == "w", F.col("text")).alias("text"), "start_s", "end_s",
        "punc",
    )


def holders(rows: DataFrame, tag: str) -> DataFrame:
    """Elements of a tag with their pointers: file, ord, id, start_s, end_s, kind, p (position), ptr."""
    own = rows.where(F.col("tag") == tag).select("file", "ord", "id", "start_s", "end_s", "kind")
    ptr = rows.where(F.col("href").isNotNull()).select(
        F.col("file").alias("_f"), F.col("parent").alias("_p"), F.col("ord").alias("p"), pointer(F.col("href")).alias("ptr"),
    )
    return own.join(ptr, (F.col("file") == F.col("_f")) & (F.col("ord") == F.col("_p")), "left").drop("_f", "_p")


def expanded(pointers: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets between the ends of each pointer, both included, in document order; the ends may
    be the wrong way round. ``pointers`` has ``key`` and ``ptr``, ``targets`` file, ord, id.

    A pointer with an id that is not there has no targets and is an orphan. Returns the
    (key, target columns) rows and the orphans (key, file, start_id, end_id)."""
    flat = pointers.where(F.col("ptr").isNotNull()).select("key", "ptr.file", "ptr.start_id", "ptr.end_id")
    place = targets.select(F.col("file").alias("_f"), F.col("id").alias("_id"), F.col("ord").alias("_o"))
    a = place.select(F.col("_f").alias("_fa"), F.col("_id").alias("_ia"), F.col("_o").alias("_a"))
    b = place.select(F.col("_f").alias("_fb"), F.col("_id").alias("_ib"), F.col("_o").alias("_b"))
    ends = flat.join(
        a, (F.col("file") == F.col("_fa")) & (F.col("start_id") == F.col("_ia")), "left",
    ).join(b, (F.col("file") == F.col("_fb")) & (F.col("end_id") == F.col("_ib")), "left")
    orphans = ends.where(F.col("_a").isNull() | F.col("_b").isNull()).select("key", "file", "start_id", "end_id")
    good = ends.where(F.col("_a").isNotNull() & F.col("_b").isNotNull()).select(
        "key", F.col("file").alias("_pf"), F.least("_a", "_b").alias("_lo"), F.greatest("_a", "_b").alias("_hi"),
    )
    found = good.join(targets, (F.col("_pf") == F.col("file")) & F.col("ord").between(F.col("_lo"), F.col("_hi"))).drop("_pf", "_lo", "_hi")
    return found, orphans


def rebuilt(found: DataFrame) -> DataFrame:
    """Per key the text of its words in order, punctuation joined to the word before it, and
    the span of their times: key, text, start_s, end_s, n_words."""
    item = F.struct("file", "ord", F.when(F.col("punc"), F.col("text")).otherwise(F.concat(F.lit(" "), "text")).alias("t"))
    said = found.where(F.col("text").isNotNull())
    text = said.groupBy("key").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), "")).alias("text"),
        F.count_if(~F.col("punc")).alias("n_words"),
    )
    span = found.groupBy("key").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    return span.join(text, "key", "left")


def topic_tree(rows: DataFrame, tag: str = "topic") -> DataFrame:
    """Topics as an adjacency list: file, id, parent_id, depth and place among siblings."""
    own = rows.where(F.col("tag") == tag)
    parents = own.select(F.col("file").alias("_f"), F.col("ord").alias("_o"), F.col("id").alias("parent_id"))
    tree = own.join(parents, (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_o")), "left")
    place = F.row_number().over(Window.partitionBy("file", "parent_id").orderBy("ord")) - 1
    return tree.select("file", "id", "parent_id", "depth", place.alias("place"), "ord")


def linked_evidence(links: DataFrame, acts: DataFrame, sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Summary links (act_id, sentence_id) with their dialogue acts (act_id, speaker) and
    sentences (sentence_id, section, text): per sentence the acts and sorted speakers; and
    the links of which either end is missing."""
    rows = links.join(acts, "act_id", "left").join(sentences, "sentence_id", "left")
    missing = F.col("speaker").isNull() | F.col("section").isNull()
    good = rows.where(~missing).groupBy("sentence_id").agg(
        F.min("section").alias("section"), F.min("text").alias("text"), F.array_sort(F.collect_set("act_id")).alias("acts"),
        F.array_sort(F.collect_set("speaker")).alias("speakers"),
    )
    return good, rows.where(missing).select("act_id", "sentence_id")


def placed(files: DataFrame, layout: dict[str, str]) -> DataFrame:
    """Adds the layer of each file (name) by the longest suffix of a layout that its name has, and
    the meeting, what stands before its first dot; files of no layer keep a null."""
    layer = F.lit(None).cast("string")
    for suffix, name in sorted(layout.items(), key=lambda x: len(x[0])):  # longer ones come last and win
        layer = F.when(F.col("name").endswith(suffix), F.lit(name)).otherwise(layer)
    return files.withColumn("layer", layer).withColumn("meeting", F.regexp_extract("name", r"^([^.]+)", 1))


def minutes(rows: DataFrame, sections: tuple[str, ...] = ("abstract", "actions", "decisions", "problems")) -> DataFrame:
    """Sentences of abstractive minutes by section, which is the tag they stand under: file,
    section, place in it from 0, id, text. Other sections are left out."""
    heads = rows.where(F.col("tag").isin(*sections)).select(
        F.col("file").alias("_f"), F.col("ord").alias("_o"), F.col("tag").alias("section"),
    )
    own = rows.where((F.col("tag") == "sentence") & F.col("id").isNotNull()).join(
        heads, (F.col("file") == F.col("_f")) & (F.col("parent") == F.col("_o")),
    )
    place = F.row_number().over(Window.partitionBy("file", "section").orderBy("ord")) - 1
    return own.select("file", "section", place.alias("place"), "id", "text")

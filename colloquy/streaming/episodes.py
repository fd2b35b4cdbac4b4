"""Streams: per-episode term state, late and repeated rows, windows over events.

``EpisodeTerms`` keeps the terms of each episode in state and reports, for each chunk of
turns, how many are new and how many were known: the streaming twin of
``operators.carry.carry_accounting``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

REPORT = "meeting STRING, position BIGINT, total BIGINT, new BIGINT, carried BIGINT"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class EpisodeTerms(StatefulProcessor):
    """State: the known terms, one map entry each, and their number. An episode without rows
    for ``ttl_ms`` forgets its terms; None keeps them."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        term = T.StructType([T.StructField("surface", T.StringType())])
        count = T.StructType([T.StructField("n", T.LongType())])
        self.terms = handle.getMapState("terms", term, count, self.ttl_ms)
        self.known = handle.getValueState("known", count, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        known = self.known.get()[0] if self.known.exists() else 0
        out = []
        for position, own in batch.groupby("position"):  # chunks of one micro-batch in order
            surfaces = sorted(set(own["surface"]))
            new = [s for s in surfaces if not self.terms.containsKey((s,))]
            for s in new:
                self.terms.updateValue((s,), (int(position),))
            out.append((key[0], int(position), len(surfaces), len(new), known))
            known += len(new)
        self.known.update((known,))
        yield pd.DataFrame(out, columns=["meeting", "position", "total", "new", "carried"])

    def close(self) -> None:
        pass


def episode_terms(units: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Report stream of term units (meeting, position, surface); needs STATE_STORE."""
    return units.select("meeting", "position", "surface").groupBy("meeting").transformWithStateInPandas(EpisodeTerms(ttl_ms), REPORT, "append", "none")


def first_deliveries(messages: DataFrame, ids: list[str], at: str, delay: str = "7 days") -> DataFrame:
    """Each message once, as long as its copies come within ``delay`` of one another; state
    older than the watermark is dropped. Later copies pass: the batch operator in
    ``operators.redelivery`` is exact."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark(ids)


def windowed_counts(events: DataFrame, at: str, keys: list[str], width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts per tumbling window; windows close once the watermark has passed them."""
    window = F.window(F.col(at), width)
    rows = events.withWatermark(at, delay).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n")

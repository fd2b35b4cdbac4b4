"""A reproducible sample that keeps its members as data grows.

Each identifier belongs to the epoch in which it was first seen, and an epoch's rate is
frozen when the epoch is first processed. An identifier is a member if a counter-based
random number, keyed by the identifier, is below the rate of its epoch. Nothing depends on
partitioning, row order or later epochs, so members stay members.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root

#: Rate of the first epoch, and the factor from epoch to epoch: a fixed schedule, so that an
#: epoch's rate can be frozen before its size is known.
FIRST_RATE, DECAY, LEAST_RATE = 0.2, 0.95, 0.05

# Multipliers and key increments of the published Philox 4x32 generator.
_M0, _M1, _W0, _W1 = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85


def philox(key: np.ndarray, counter: int = 0, rounds: int = 10) -> np.ndarray:
    """Philox 4x32: the first 64 of 128 random bits for each 64-bit key and the counter."""
    low = np.uint64(0xFFFFFFFF)
    key = key.astype(np.uint64)
    k0, k1 = key & low, key >> np.uint64(32)
    c = [np.full(len(key), x, np.uint64) for x in (counter & 0xFFFFFFFF, counter >> 32 & 0xFFFFFFFF, 0, 0)]
    for _ in range(rounds):
        a, b = c[0] * np.uint64(_M0), c[2] * np.uint64(_M1)
        c = [(b >> np.uint64(32)) ^ c[1] ^ k0, b & low, (a >> np.uint64(32)) ^ c[3] ^ k1, a & low]
        k0, k1 = (k0 + np.uint64(_W0)) & low, (k1 + np.uint64(_W1)) & low
    return c[1] << np.uint64(32) | c[0]


def uniform(key: Column, counter: int = 0) -> Column:
    """A number in [0, 1) from a BIGINT key."""

    @F.pandas_udf(T.DoubleType())
    def draw(keys: pd.Series) -> pd.Series:
        return pd.Series((philox(keys.to_numpy().view(np.uint64), counter) >> np.uint64(11)) * 2.0**-53)

    return draw(key)


def scheduled_rate(epoch: Column, first: float = FIRST_RATE, decay: float = DECAY, least: float = LEAST_RATE) -> Column:
    """The frozen rate of an epoch by the schedule; a null epoch has the least rate."""
    rate = F.greatest(F.lit(least), F.lit(first) * F.pow(F.lit(decay), F.greatest(epoch, F.lit(1)) - 1))
    return F.when(epoch.isNull(), F.lit(least)).otherwise(rate)


def first_seen(records: DataFrame, id_column: str, epoch_column: str) -> DataFrame:
    """id, its first epoch and that epoch's frozen rate. Null ids are no records; an id with
    no epoch at all keeps a null epoch and the least rate. Counting is pre-aggregated, so an
    id listed in a third of all rows is one row a task."""
    seen = records.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min(epoch_column).alias("epoch"))
    return seen.withColumn("rate", scheduled_rate(F.col("epoch")))


def members(seen: DataFrame, seed: int = 0) -> DataFrame:
    """The members among (id, epoch, rate): id, epoch, rate, draw."""
    drawn = seen.withColumn("draw", uniform(F.xxhash64(F.lit("member"), F.col("id").cast("string")), seed))
    return drawn.where(F.col("draw") < F.col("rate")).select("id", "epoch", "rate", "draw")


class EpochStore:
    """First-seen epochs and frozen rates, kept in a folder of the shared file system.

    ``update`` adds ids not seen before; what is stored is never changed, so a re-listed id
    keeps its epoch and rate whatever its later rows say, and an epoch keeps the rate that its
    first ids were given. Each update is a generation of its own, written aside and then
    renamed to the next number. A rename to a number that is taken fails, so of two writers
    one wins and the other starts again from what the first has stored: no id is stored twice.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def generations(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n.removeprefix("gen=")) for n in names if n.startswith("gen="))

    def read(self, generations: list[int] | None = None) -> DataFrame:
        """id, epoch and rate of all ids, or of those of some generations."""
        known = self.generations() if generations is None else generations
        if not known:
            return self.spark.createDataFrame([], "id STRING, epoch INT, rate DOUBLE")
        return self.spark.read.schema("id STRING, epoch INT, rate DOUBLE").parquet(*[f"{self.folder}/gen={n}" for n in known])

    def update(self, batch: DataFrame, id_column: str, epoch_column: str, rate: float | None = None) -> int:
        """Stores the ids of a batch that are new; the number of the generation, or the last one
        where there is none. ``rate``: the rate to freeze for new epochs, else the schedule's."""
        seen = first_seen(batch, id_column, epoch_column).select(
            F.col("id").cast("string").alias("id"), F.col("epoch").cast("int").alias("epoch"),
            (F.lit(rate) if rate is not None else F.col("rate")).alias("rate"),
        )
        while True:
            known = self.generations()
            last = known[-1] if known else -1
            stored = self.read(known)
            frozen = stored.groupBy(F.col("epoch").alias("_e")).agg(F.min("rate").alias("_rate"))  # one row an epoch
            new = seen.join(stored.select("id"), "id", "left_anti").join(frozen, F.col("epoch").eqNullSafe(F.col("_e")), "left")
            aside = f"{self.folder}/_aside-{uuid.uuid4().hex}"
            new.select("id", "epoch", F.coalesce("_rate", "rate").alias("rate")).write.parquet(aside)
            if known and self.spark.read.parquet(aside).isEmpty():
                self._fs.delete(self._path(aside), True)
                return last
            try:
                self._files.rename(self._path(aside), self._path(f"{self.folder}/gen={last + 1}"), self._options)
                return last + 1
            except Py4JJavaError as error:
                self._fs.delete(self._path(aside), True)
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise

    def sample(self, seed: int = 0) -> DataFrame:
        return members(self.read(), seed)


def persisted_members(records: DataFrame, name: str, id_column: str, epoch_column: str, seed: int = 0) -> DataFrame:
    """The members among the ids of a table, through the store of that table in the shared
    folder: new ids are stored with their epochs and rates, ids that were there before keep
    theirs. Ids that the table does not list (any more) are not returned."""
    store = EpochStore(records.sparkSession, f"{checkpoint_root(records.sparkSession)}/epochs-{name}")
    store.update(records, id_column, epoch_column)
    listed = records.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("string").alias("id")).distinct()
    return store.sample(seed).join(listed, "id", "left_semi")

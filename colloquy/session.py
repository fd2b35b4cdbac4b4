"""Session, tables and lineage helpers shared by all operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "diar_segments", "runtime_dialogues", "runtime_turns", "score_turns", "transcribed_segments", "parse_results",
    "direction_scores", "earnings22_inputs", "speaker_roster", "piece_limits", "mix_targets",
)


def build_session(app: str = "colloquy", cores: str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("COLLOQUY_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a context, so that a cluster needs no copy
    of it. The archive is staged on the driver only; Spark hands it out."""
    context = spark.sparkContext
    if getattr(context, "_colloquy_shipped", False):
        return
    context._colloquy_shipped = True
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="colloquy-package-")) / "colloquy.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(archive))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the package goes to the workers with the first one."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Only on one machine, as in tests, may it be unset: then a temporary folder is set. A
    cluster without it is refused, as its machines share no local folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = getattr(context, "_colloquy_folder", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        folder = context._colloquy_folder = tempfile.mkdtemp(prefix="colloquy-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder, so that later stages
    survive lost executors and do not recompute it."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored_table(df: DataFrame, name: str, partitions: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder, by partitions, and read it back."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partitions or [])).parquet(path)
    # shuffle files stay until the driver collects what refers to them, which it seldom needs to
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

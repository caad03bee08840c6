"""Session and reliable-checkpoint helpers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "pulsegrid", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Plans are built from many small expressions; recording a Python call site for each costs more than the rest of building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Merges keep small sets per key; the default of 128 keys would send nearly every task to the sorting fallback.
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "16384")
    )
    if master is not None:
        # On one machine small stages are bound by work per row, not bytes: keep them spread over the cores.
        builder = (
            builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; fall back to a private folder only where none is set (single machine, tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if configured:
        context.setCheckpointDir(configured)
        return
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def freeze(df: DataFrame) -> DataFrame:
    """Write the frame to the reliable checkpoint folder and continue from the written copy."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as Parquet under the shared folder and continue from the written copy, which is read back pruned and with statistics."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, so that jobs may start from any folder."""
    context = spark.sparkContext
    if getattr(context, "_pulsegrid_shipped", False):
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp" if context.master.startswith("local[") else None)) / "pulsegrid.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(target))
    context._pulsegrid_shipped = True

"""Session helpers: local test session, scratch folder, input spreading."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000  # rows handed to a Python task at once: texts are long, and a batch is held several times over


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and benchmarks. Clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("backglot")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the cluster's shared checkpoint folder.

    Only a local session without that setting falls back to a temporary folder; a
    cluster without it is a configuration error, because executors could not see
    a driver-local path.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="backglot-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, and bound the rows of their batches.

    Only operators with Python tasks need it; everything else runs in the JVM. A smaller bound of the session stays.
    """
    given = int(spark.conf.get(BATCH_CONF))
    if given <= 0 or given > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    context = spark.sparkContext
    if any(f.endswith("backglot.zip") for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "backglot"), "zip", root.parent, root.name)
    context.addPyFile(archive)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input that has fewer splits than the session has cores.

    Lexing is CPU-bound, so one big row group must not pin the job to one core.
    Inputs with enough splits are left alone: no shuffle at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(4 * cores, *keys)  # several tasks per core even out long documents

"""Session helpers: table loading, reliable lineage cuts, sizing decisions."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("readloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that they need no installation of it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):  # not when run from an archive that was shipped already
        folder = tempfile.mkdtemp(prefix="readloom-")
        shutil.copytree(here, os.path.join(folder, "src", "readloom"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "readloom"), "zip", os.path.join(folder, "src")))
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate files, set as the checkpoint folder of the session."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not shared:
            shared = tempfile.mkdtemp(prefix="readloom-ckpt-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder named in ``spark.checkpoint.dir``.

    A folder of our own is used only where the session names none and runs on
    one machine, as in tests; a cluster without a shared folder is an error,
    as executors would not see each other's files.  Files of checkpoints that
    are no longer referenced are removed by Spark where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, as in
    ``local_session``.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, per_core: int = 4) -> DataFrame:
    """A scan or checkpoint of few partitions dealt out for work that is heavy on CPU; larger ones stay as they are.

    Only for plans without a shuffle of their own, whose partitions can be counted without running anything.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)

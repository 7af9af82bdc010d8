"""Spark session defaults used by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session clock (dates are computed
# explicitly in Asia/Tokyo where needed), ANSI mode, AQE with skew handling
# and partition coalescing, dynamic partition overwrite for the upsert writer.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE sizes reduce partitions from runtime statistics: start from the
    # configured shuffle partition count and coalesce towards 128 MB each,
    # so one setting works from the test tables to a many-terabyte fact
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "liftlake") -> SparkSession:
    """Return a session with the engine defaults applied.

    On a cluster the master and the shuffle partition count come from the
    submit configuration; locally they default to ``local[*]`` and 8.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and not os.environ.get("SPARK_MASTER"):
        master = "local[*]"
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", os.environ.get("LIFTLAKE_DRIVER_MEMORY", "6g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for k, v in _DEFAULTS.items():
        if not k.startswith("spark.ui."):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Shuffle files of an execution go when it ends, not when the driver's garbage
# collector comes by: a query of several steps then holds those of one step.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def free_shuffles(spark: SparkSession, wanted: bool = True) -> None:
    """Whether executions that start from now on delete their shuffle files at
    their end (a frame that is executed again makes them anew)."""
    spark.conf.set(_FREED, str(wanted).lower())


# Bytes of different values up to which a column of a written file keeps a
# dictionary; Parquet's own bound is 1 MB.
LONG_TEXTS = 64 << 20


def keep_long_texts_once(spark: SparkSession) -> None:
    """Files written from now on hold a text that many rows share once for each
    file, also one of more than 1 MB, and not once for each row."""
    spark.conf.set("parquet.dictionary.page.size", str(LONG_TEXTS))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local session (tests)
    may leave it unset and gets a fresh folder; on a cluster a machine-local
    folder would lose data, so that is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return spark.sparkContext.getCheckpointDir() or configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="liftlake-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once for a Spark context), for the
    operators that run Python functions in tasks."""
    sc = spark.sparkContext
    if getattr(sc, "_liftlake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="liftlake-package-")
    path = os.path.join(folder, "liftlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for base, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._liftlake_shipped = True

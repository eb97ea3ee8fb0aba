"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app_name: str = "tidings",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with UTC time, AQE and the UI off.

    On a cluster leave ``master`` unset so spark-submit decides; tests and
    the bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # a checkpoint's files go when the last table that reads them is gone
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, size its heap
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name it: executors cannot see a folder of the driver's
    machine.  Only a local session, whose executors are the driver, gets one
    of its own when the setting is absent.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tidings-shared-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def sub_dir(spark: SparkSession, name: str) -> str:
    """A named folder below the shared one (stream checkpoints, tables)."""
    return os.path.join(shared_dir(spark), name)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of an intermediate that several branches read.

    Written to the shared folder, so the lineage is cut and a lost executor
    costs a re-read.  A failing query fails here.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt evenly over the session's cores, or by ``keys``, which AQE leaves at that: for rows
    that take long beside their bytes.  No more tasks than cores, as each sets up its expressions anew."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)

"""Session helper for local use; on a cluster the submitted configuration is used as it is."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: tasks that the text tables of the test data are dealt to after the scan: they are one row group each, which one task reads.
#: Only the local session sets it; tables of many row groups need no such step.
FAN_OUT = "spark.gradeloom.fanOut"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "gradeloom") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.execution.arrow.pyspark.enabled", "true")
            .config("spark.driver.memory", os.environ.get("GRADELOOM_DRIVER_MEMORY", "12g"))
            .config(FAN_OUT, "0" if cores == "*" else str(cores))
            .config("spark.ui.enabled", "false")
            .getOrCreate())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only on a local master, where driver and tasks share one machine, a temporary one stands in."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gradeloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: removes the shuffle files of a query when it ends
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_cleaned(spark: SparkSession):
    """Queries that are built inside leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partition narrow rows into the configured number of tasks before CPU-heavy work.

    The count is explicit, so adaptive execution does not merge the small
    inputs of large computations back into one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


"""Session helpers: settings that hold at any size, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "ferrolith") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("FERROLITH_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back, so that later stages don't recompute it.

    The folder is the cluster's (spark.checkpoint.dir). Where none is set a temporary one is chosen if all runs on one machine
    (master local); on a cluster that is an error, as executors would write to disks of their own.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ferrolith-"))
    return df.checkpoint(eager=True)

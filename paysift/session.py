"""Session helpers.

Library code never builds its own session: every operator receives the
caller's ``SparkSession`` (or a DataFrame bound to it).  ``local_session`` is
for tests and the bench only.
"""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "paysift") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAYSIFT_DRIVER_MEM", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts, in this order: the folder the caller
    has set with ``setCheckpointDir``, the session's ``spark.checkpoint.dir``,
    and — with a local master only, as in tests — a fresh scratch folder.
    On a cluster an unset folder is an error: executors and driver do not
    share local disks."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="paysift-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when their plan is collected on the driver: ask for it now, between
    steps that would otherwise keep the files of all of them.  Nothing waits for it, and
    nothing depends on it but the disk used."""
    gc.collect()  # the Python side's references to plans
    spark.sparkContext._jvm.System.gc()

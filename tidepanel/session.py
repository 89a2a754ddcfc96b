"""Session settings. Everything here is a default: a session handed in by the caller is used as it is."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app="tidepanel", master=None, partitions=None):
    """A session tuned for panel work; ``master`` stays unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("TIDEPANEL_DRIVER_MEMORY", "12g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    builder = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # window work is heavy per byte: do not merge it into fewer tasks than there are cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "64m")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.debug.maxToStringFields", "50")
        # call-site capture of every Column call dominates the building of wide factor sets
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark):
    """The shared folder of the cluster, as ``spark.checkpoint.dir`` names it. A session on one machine makes its own where none is
    set; on a cluster that is an error, because executors do not see each other's disks."""
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidepanel-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """``df`` read from the shared folder: what was computed is not computed again, and executors may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df):
    """``df`` as a compressed table in the shared folder, for steps that read the same rows many times."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

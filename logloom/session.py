"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings the package is written for.  None of them is required for a right
# result except the UTC session time zone, which `use_utc` also sets.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.files.maxPartitionBytes": "16m",
}


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the workers once per application, so that Python functions
    load there wherever the driver was started.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="logloom-package-"), "logloom.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, files in os.walk(package):
                for name in files:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps in the logs are UTC; day keys are wrong in any other zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_small_splits(spark: SparkSession) -> SparkSession:
    """Stored log records take a twentieth of their size in memory: a split of 128 MB is gigabytes of rows, which spill."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", RECOMMENDED["spark.sql.files.maxPartitionBytes"])
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the folder the cluster shares between executors.

    The folder is the one named by ``spark.checkpoint.dir``.  Where that is
    unset a local session falls back to a scratch folder; a cluster does not,
    because a folder on the driver's disk is invisible to the executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="logloom-")
    return f"{root.rstrip('/')}/logloom/{label}-{uuid.uuid4().hex}"

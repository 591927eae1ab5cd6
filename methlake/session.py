"""Session settings, the shared folder, and the package for executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings that suit wide scans followed by additive aggregates. Shuffle partitions are left to the
# cluster (AQE coalesces them); skewed sort-merge joins are split at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # probe maps and dictionaries are some tens of MB; what statistics put above this is shuffled
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    # narrow scans feed CPU-heavy expressions, so splits are small
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # rows that carry whole profiles are wide, so batches are bounded by bytes as well
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def get_session(app: str = "methlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees (`spark.checkpoint.dir`); a local one only where none is set and Spark is local."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="methlake-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session; from then on tasks import it from anywhere."""
    context = spark.sparkContext
    if getattr(context, "_methlake_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="methlake-")  # the driver serves the file from here while it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "methlake.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for where, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(where, name)
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._methlake_shipped = True

"""Tables in the folder that all executors share, to cut lineage and to compute what is used twice only once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from methlake.llm.words import release
from methlake.session import shared_dir

#: Rows here carry whole texts: what the JVM and a Python worker hand each other at a time stays small.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

#: Spark's setting that an action's exchange files go when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits to those above, where they are higher."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in `spark.checkpoint.dir` and read back; the exchange files that this took are gone then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    release()  # what planning and small results took on the driver
    return spark.read.schema(df.schema).parquet(path)

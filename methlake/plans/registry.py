"""Registered queries: a callable (spark, sf_dir) -> DataFrame and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def spread(scan: DataFrame) -> DataFrame:
    """A narrow table of few row groups dealt out to all cores, where costly expressions follow; larger scans stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


SHARES = 16  # parts for each partition of a scan


def dealt(rows: DataFrame, scan: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys into parts whose number grows with the scan they come from, so that what one task sorts or hashes does not."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, SHARES * scan.rdd.getNumPartitions()), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""Counts that grow as files arrive.

Counters only add up, so a micro-batch needs no state from earlier ones: it writes its own partial counts under its
batch number (a repeated batch overwrites itself), and a reader adds the partials. State never outgrows the probes
times the batches kept, and `compact` folds those.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from methlake.functions import reads as R
from methlake.model.artifact import Model
from methlake.operators import calls as C
from methlake.plans import entries as E
from methlake.sources import bam
from methlake.sources.text import count_rows


def accumulate(
    stream: DataFrame, to_counts: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Start the job; `to_counts` turns a micro-batch into (keys..., n_mod, n_unmod)."""

    def save(batch: DataFrame, number: int) -> None:
        to_counts(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def totals(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Counts so far."""
    return C.sum_counts(spark.read.parquet(table), keys)


def running_totals(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The same as a stateful streaming aggregate, for `update` or `complete` sinks."""
    return stream.groupBy(*keys).agg(F.sum("n_mod").alias("n_mod"), F.sum("n_unmod").alias("n_unmod"))


def count_parts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Count tables dropped into a folder, as a stream of (probe_id, n_mod, n_unmod)."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumnRenamed("value", "line")
    rows = count_rows(lines.filter(~F.col("line").startswith("probe_id\t")))
    return rows.filter("ok").select("probe_id", "n_mod", "n_unmod")


def alignment_reads(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Reads of the alignment files that arrive whole in a folder, as a stream; for `accumulate` with `alignment_counts`."""
    bam.register(spark)
    reader = spark.readStream.format("methbam")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(folder)


def alignment_counts(model: Model, low: float = R.THRESHOLD_LOW, high: float = R.THRESHOLD_HIGH) -> Callable[[DataFrame], DataFrame]:
    """A micro-batch of reads to (sample_id, probe_id, n_mod, n_unmod), sample_id being the file."""

    def counts(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        paths = sorted(r["path"] for r in batch.select("path").distinct().collect())  # the files of one micro-batch
        if not paths:
            return spark.createDataFrame([], "sample_id string, probe_id string, n_mod bigint, n_unmod bigint")
        _, matched = E.resolve(spark, paths)
        contigs = matched.filter("contig is not null").select("path", "rid", F.concat_ws(":", "assembly", "map_name").alias("contig"))
        reads = batch.filter((F.col("kind") == "read") & C.is_usable()).join(F.broadcast(contigs), ["path", "rid"])  # 22 rows a file
        calls = C.read_calls(reads.withColumn("sample_id", F.col("path")), E.probe_sites(spark, model), low, high)
        return C.tally(calls, ["sample_id", "probe_id"])

    return counts


def compact(spark: SparkSession, table: str, out: str, keys: list[str]) -> None:
    """Fold all partials into one table of the same layout elsewhere."""
    totals(spark, table, keys).write.mode("overwrite").parquet(f"{out}/batch=0")

"""Incremental load (K3 / S4): each new file of a folder taken exactly once.

A run reads the files that no earlier run has taken, as one streaming query
that ends when they are done (``availableNow``).  Which files belong to which
batch is logged in the checkpoint before the batch runs, and the sink lists a
batch's output files only when all of them are written, so a run that dies
between or inside batches is repeated by the next one without loss or repeats:
output files that no log names are never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, types as T

from .files import path_exists


def load_new_files(spark: SparkSession, folder: str, schema: T.StructType, out: str, checkpoint: str, fmt: str = "parquet",
                   options: dict[str, str] | None = None, transform: Callable[[DataFrame], DataFrame] | None = None,
                   partition_by: list[str] | None = None, files_per_batch: int | None = None) -> int:
    """Append the rows of the new files of ``folder`` (``transform``-ed, row by
    row operations and joins with static tables) to the dataset ``out``;
    returns how many batches ran.  ``checkpoint`` is this load's own folder in
    shared storage.  A folder without new files adds nothing."""
    reader = spark.readStream.schema(schema).format(fmt)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.load(folder)
    rows = transform(rows) if transform else rows
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True)
    query = (writer.partitionBy(*partition_by) if partition_by else writer).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"] > 0)


def loaded(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows of all finished batches; none before the first."""
    if not path_exists(spark, f"{out}/_spark_metadata"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out)

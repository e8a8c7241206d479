"""Sinks (K1-K3).  Writes are distributed (one file per task and partition
value); nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .files import partition_values


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",",
              encoding: str | None = None) -> str:
    """K1: CSV with a header, no index column."""
    w = df.write.mode(mode).option("header", True).option("sep", sep)
    if encoding:
        w = w.option("encoding", encoding)
    w.csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", sort_by: list[str] | None = None) -> str:
    """K2 / K4: Parquet stage table.  ``sort_by`` clusters rows inside each
    file so row-group min/max statistics prune later filters."""
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    df.write.mode(mode).parquet(path)
    return path


def write_by_state(df: DataFrame, path: str, state_col: str = "state", mode: str = "overwrite") -> str:
    """K3: one directory per state (``state=<v>/``), readable with pruning.

    The ``rebalance`` hint groups rows by state into partitions of the AQE
    advisory size first: a hot state is split over several files, small
    states share a task, and no task writes a small file for every state.
    """
    df.hint("rebalance", state_col).write.mode(mode).partitionBy(state_col).parquet(path)
    return path


def states_written(spark, path: str, state_col: str, state_type) -> DataFrame:
    """The states (null too) that a dataset at ``path`` holds, in ``state_type``:
    the names of its partition folders (one row each), no file is opened.  A
    folder without any, or no folder, holds none."""
    names = [(n,) for n in partition_values(spark, path, state_col)]
    return spark.createDataFrame(names, "name string").select(F.col("name").cast(state_type).alias(state_col))


def without_written(df: DataFrame, path: str, state_col: str = "state") -> DataFrame:
    """Rows of ``df`` (points, or the state polygons before any work is done
    for them) whose state is not yet in the dataset at ``path``."""
    done = states_written(df.sparkSession, path, state_col, df.schema[state_col].dataType)
    done = done.withColumnRenamed(state_col, "__done")
    return df.join(done, F.col(state_col).eqNullSafe(F.col("__done")), "left_anti")


def write_new_states(df: DataFrame, path: str, state_col: str = "state") -> str:
    """K3, incremental: skip states already written (a null state is a state
    of its own), append the rest."""
    df = without_written(df, path, state_col)
    df.hint("rebalance", state_col).write.mode("append").partitionBy(state_col).parquet(path)
    return path


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """K4 for block tables: ``df`` as table ``name`` at ``path``, cut into
    ``buckets`` by a hash of ``key`` and sorted by it in each.  Tables bucketed
    alike join, group and number by ``key`` without a shuffle."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_table(spark, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """The files of an earlier :func:`write_bucketed` as table ``name`` of this session."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) "
                  f"into {buckets} buckets location '{path}'")
    return spark.table(name)

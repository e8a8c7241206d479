"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder, read back;
    ``options`` go to the writer.

    Cuts the lineage with replicated / shared storage, so a lost executor
    costs a re-read and nothing is recomputed by later jobs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_rows(fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None]):
    """Per-batch function -> the iterator form ``mapInArrow`` wants."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield from out.to_batches() if isinstance(out, pa.Table) else (out,)
    return run


#: Rows of an Arrow batch between Spark and Python: texts average kilobytes,
#: so Spark's default of 10,000 rows would be tens of megabytes a batch.
BATCH_ROWS = 500


def map_text(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` for rows with texts, in batches of ``BATCH_ROWS`` (a
    setting of the session, read when the plan runs)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of ``column`` in one piece stays near
    ``most_bytes`` (a single longer text is a piece of its own)."""
    for b in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and size + n > most_bytes:
                yield b.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < b.num_rows:
            yield b.slice(start)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name, i = f"__{stem}", 0
    while name.lower() in have:
        i += 1
        name = f"__{stem}_{i}"
    return name


def id_bucket(column: str, mod: int) -> Column:
    """crc32 of an id's decimal text, modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string")) % F.lit(mod)


def hot_keys(counts: DataFrame, n_column: str, total: int, parts: int = 200) -> DataFrame:
    """Keys holding over 1/``parts`` of ``total`` rows: fewer than ``parts``
    rows whatever the data, so the table may be broadcast."""
    return counts.where(F.col(n_column) > F.lit(total / parts))


def join_by_hot(left: DataFrame, right: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Left join on ``key`` (``right`` unique on it), where the keys in ``hot``
    (bounded, see :func:`hot_keys`) never meet in one task: their rows stay
    where they are and take the broadcast rows, all others shuffle."""
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    cold = left.join(hot, key, "left_anti").join(right.join(hot, key, "left_anti"), key, "left")
    warm = left.join(hot, key, "left_semi").join(few, key, "left")
    return cold.unionByName(warm)

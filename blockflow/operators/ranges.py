"""Global order without a global task: rows placed by ranges of a sort key.

``placed`` range-sorts a table over many tasks, writes it to the shared
scratch folder with the number of each row's range and its position there,
and counts the ranges (one number per range).  The written ranges are fixed,
so later jobs, retries and lost executors see the same positions.  A hot key
is cut by the further key columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path


@dataclass(frozen=True)
class Placed:
    rows: DataFrame                 # the input's columns, the range's number and the place in it (0-based)
    sizes: list[tuple[int, int]]    # (range, rows), in key order
    range: str                      # the names of these two columns, none of the input's
    at: str

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def numbered(self, out: str) -> DataFrame:
        """The rows with their 0-based global position in ``out``."""
        first, starts = 0, []
        for r, n in self.sizes:
            starts.append((r, first))
            first += n
        spark, start = self.rows.sparkSession, free_name(self.rows, "first")
        starts = spark.createDataFrame(starts, "r int, s long").toDF(self.range, start)    # one row per range
        d = self.rows.join(F.broadcast(starts), self.range)
        return d.withColumn(out, F.col(start) + F.col(self.at)).drop(self.range, self.at, start)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have, name, i = {c.lower() for c in df.columns}, f"__{stem}", 0
    while name in have:
        i += 1
        name = f"__{stem}_{i}"
    return name


def placed(df: DataFrame, *order: str) -> Placed:
    spark, range_, at = df.sparkSession, free_name(df, "range"), free_name(df, "at")
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = d.withColumns({range_: F.spark_partition_id(),
                       at: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    path = scratch_path(spark, "placed")
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    sizes = d.groupBy(range_).agg(F.count(F.lit(1)).alias("n")).collect()
    return Placed(d, sorted((r[range_], r["n"]) for r in sizes), range_, at)

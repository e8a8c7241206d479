"""Sort, top-k, bottom-k, first-n and exact reproducible samples.

Every ordering carries the key as tie-breaker so results are deterministic.
``orderBy(...).limit(n)`` plans as ``TakeOrderedAndProject``: each task keeps
its n best rows and only ``n * tasks`` rows reach the final merge.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rand import hash_key
from .ranges import placed

#: Positions up to here are found by a top-k, deeper ones by a range sort.
NEAR = 10_000


def sort_by(df: DataFrame, *cols: str, within_partitions: bool = False) -> DataFrame:
    """Global range sort, or a per-partition sort when only layout matters."""
    return df.sortWithinPartitions(*cols) if within_partitions else df.orderBy(*cols)


def sort_desc(df: DataFrame, value: str, key: str) -> DataFrame:
    """Descending by value, ascending key breaks ties."""
    return df.orderBy(F.col(value).desc(), F.col(key).asc())


def _numbered(limited: DataFrame, order) -> DataFrame:
    # ``limited`` holds at most n rows, so an unpartitioned window is bounded.
    return limited.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def top_n(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """The n largest groups, ``pos`` 1 = largest."""
    order = [F.col(value).desc(), F.col(key).asc()]
    return _numbered(df.orderBy(*order).limit(n), order)


def bottom_n(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """T4: the last n of the descending order (reverse order incl. tie key),
    ``pos`` 1 = smallest.  With fewer than 2n groups it overlaps ``top_n`` (Q14)."""
    order = [F.col(value).asc(), F.col(key).desc()]
    return _numbered(df.orderBy(*order).limit(n), order)


def first_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows of a defined order."""
    return df.orderBy(*order).limit(n)


def nth_row(df: DataFrame, i: int, *order: str, near: int = NEAR) -> DataFrame:
    """The row at 0-based position i of a defined order.

    Near the front ``TakeOrderedAndProject`` keeps i + 1 rows per task; from
    ``near`` on the rows are placed by ranges and the one row is looked up in its
    range, so no task ever merges i rows.
    """
    if i < near:
        return df.orderBy(*order).offset(i).limit(1)
    p = placed(df, *order)
    for r, n in p.sizes:
        if i < n:
            return p.rows.where((F.col(p.range) == r) & (F.col(p.at) == i)).drop(p.range, p.at)
        i -= n
    return df.limit(0)


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = 0, sigmas: float = 6.0) -> DataFrame:
    """Exactly n rows, reproducible: the n smallest md5(key, seed), ties
    broken by the key columns.

    A plain ``orderBy(h).limit(n)`` would merge ``n`` rows from every task in
    one task.  Instead the first 32 bits of the hash (uniform) give a
    threshold that keeps about ``n`` rows (``n/N`` plus ``sigmas`` standard
    deviations); if fewer than ``n`` pass, the margin doubles.  Every row with
    a smaller hash than a kept row is kept too.  The candidates are placed by
    ranges of the hash and the first ``n`` positions are the sample: no task
    holds more than its range.  A table of at most ``n`` rows is its own sample.
    """
    h = F.md5(hash_key(*[F.col(c) for c in key_cols], F.lit(seed)))
    d = df.withColumn("__h", h).withColumn("__h32", F.conv(F.substring("__h", 1, 8), 16, 10).cast("long"))
    total = df.count()
    if total <= n:
        return df
    margin = sigmas
    while True:
        p = min(1.0, n / total + margin * math.sqrt(n) / total + 1.0 / total)
        cand = placed(d.where(F.col("__h32") <= F.lit(int(p * 4294967296.0))), "__h", *key_cols)
        if p >= 1.0 or cand.total >= n:
            break
        margin *= 2
    return cand.numbered("__pos").where(F.col("__pos") < n).drop("__pos", "__h", "__h32")

"""Window-shaped operators (W1-W3) written so that no single task ever holds
an unbounded group or the whole table.

* :func:`bfill` - backward fill along an ordering key, range by range, plus a
  carry table of one row per range.
* :func:`number_within_group` - ``row_number()`` per group; groups too large
  for one task are numbered through their place in a range sort.
* :func:`window_freq` - rows per key attached to every row of the key
  (partial aggregate + join, skew-safe under AQE skew-join splitting).

Rows with a null key form a group of their own, as in SQL windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranges import free_name, placed


def bfill(df: DataFrame, value: str, order_key: str, out: str | None = None) -> DataFrame:
    """``fillna(method='bfill')`` along ``order_key`` (unique).

    The table is range-sorted by the key (:func:`ranges.placed`), so a range
    is one task's share of the rows however sparse the keys are.  Inside a
    range the fill is a window that runs backwards, so one value is carried
    from row to row (a frame up to the end of the range would be read again
    for every row); a row with no later value there takes the first value of
    the next ranges, known from one value per range.
    """
    out = out or value
    p = placed(df, order_key)
    own, later = free_name(p.rows, "fill"), free_name(p.rows, "next")
    w = Window.partitionBy(p.range).orderBy(F.col(p.at).desc()).rowsBetween(Window.unboundedPreceding, 0)
    local = p.rows.withColumn(own, F.last(F.col(value), ignorenulls=True).over(w))
    firsts = {r[0]: r[1] for r in p.rows.where(F.col(value).isNotNull()).groupBy(p.range).agg(
        F.min_by(F.col(value), F.col(p.at))).collect()}                        # one row per range
    carry, nxt = [], None
    for r, _ in reversed(p.sizes):
        carry.append((r, nxt))
        nxt = firsts.get(r, nxt)
    spark = df.sparkSession
    schema = local.select(F.col(p.range), F.col(value).alias(later)).schema
    carry = spark.createDataFrame(carry, schema)
    res = local.join(F.broadcast(carry), p.range, "left")
    return res.withColumn(out, F.coalesce(F.col(own), F.col(later))).drop(p.range, p.at, own, later)


def number_within_group(df: DataFrame, group: str, order: list[str], out: str = "rn",
                        max_rows: int = 1 << 20) -> DataFrame:
    """Number the rows of each group 1..n in ``order`` (``reset_index`` per
    block): the same numbers as ``row_number()`` for any ``max_rows``.

    Groups of at most ``max_rows`` rows are numbered by a window.  The rows of
    larger ones are range-sorted by (group, order) over all tasks, and a row's
    number is its global position less the first position of its group.
    Whether there are such groups is asked by one aggregate job.
    """
    w = Window.partitionBy(group).orderBy(*order)
    g, n, pos, start = (free_name(df, x) for x in ("g", "n", "pos", "start"))
    large = df.groupBy(F.col(group).alias(g)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > max_rows).select(g)
    if large.isEmpty():
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    same = F.col(group).eqNullSafe(F.col(g))
    small = df.join(large, same, "left_anti").withColumn(out, F.row_number().over(w).cast("long"))
    rows = placed(df.join(large, same, "left_semi"), group, *order).numbered(pos)
    first = rows.groupBy(F.col(group).alias(g)).agg(F.min(pos).alias(start))
    rows = rows.join(first, same).withColumn(out, F.col(pos) - F.col(start) + 1)
    return small.unionByName(rows.drop(pos, g, start))


def window_freq(df: DataFrame, key: str, out: str = "freq") -> DataFrame:
    """Rows per ``key`` attached to every row (``value_counts`` joined back)."""
    k = free_name(df, "k")
    f = df.groupBy(F.col(key).alias(k)).agg(F.count(F.lit(1)).alias(out))
    return df.join(f, F.col(key).eqNullSafe(F.col(k))).drop(k)

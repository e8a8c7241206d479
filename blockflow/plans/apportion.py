"""Crosswalk apportionment 2010 -> 2020.

A 2010 block split over ``freq`` crosswalk rows gives ``measure / freq`` to
each of them; a 2020 block receives the sum over its crosswalk rows.  The
reference's value_counts -> right join -> left join -> group sum, as keyed
joins (Q1, Q11):

1. ``freq``: crosswalk rows per ``ID10`` (partial + final aggregate), counted
   over every row with that ``ID10``, also those without an ``ID20``.
2. ``weights``: one row per ``ID10`` = measures / freq (co-partitioned join).
3. crosswalk LEFT JOIN weights on ``ID10`` (AQE splits a hot ``ID10``), then
   a partial + final sum per ``ID20``; unmatched or null 2010 ids weigh 0.
   Rows without an ``ID20`` are dropped here, after the frequency has seen them.

Duplicated crosswalk rows count twice, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def apportion(crosswalk: DataFrame, source: DataFrame, measures: list[str],
              from_key: str = "ID10", to_key: str = "ID20", prefix: str = "eq_") -> DataFrame:
    # joined on the id made non-null and a mark of the null ones: Spark infers no
    # id filter for one use of the crosswalk only, so AQE reuses its shuffle, and
    # the sorts compare plain numbers
    key = ["__k", "__nil"]
    of = lambda d: (F.coalesce(F.col(from_key), F.lit(0).cast(d.schema[from_key].dataType)).alias("__k"),
                    F.col(from_key).isNull().alias("__nil"))
    cw = crosswalk.select(to_key, *of(crosswalk))
    freq = cw.groupBy(*key).agg(F.count(F.lit(1)).alias("__freq"))
    src = source.where(F.col(from_key).isNotNull()).select(*of(source), *measures)
    weights = src.join(freq, key).select(
        *key, *[(F.col(m).cast("double") / F.col("__freq")).alias(m) for m in measures])
    out = cw.join(weights, key, "left").groupBy(to_key).agg(
        *[F.sum(F.coalesce(F.col(m), F.lit(0.0))).alias(prefix + m) for m in measures], F.max(to_key).alias("__id"))
    # the id comes out of an aggregate: neither this filter nor one that a later
    # join infers can move below one use of the crosswalk only
    return out.where(F.col("__id").isNotNull()).select(
        F.col("__id").alias(to_key), *[prefix + m for m in measures])


def mapped_blocks(block20: DataFrame, apportioned: DataFrame, key: str = "ID20",
                  fill: float = 0.0) -> DataFrame:
    """Attach apportioned 2010 measures to the 2020 blocks by key (Q1).

    A 2020 block without any crosswalk row gets ``fill`` (no 2010 population).
    """
    eq_cols = [c for c in apportioned.columns if c != key]
    j = block20.join(apportioned, key, "left")
    return j.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) for c in eq_cols})

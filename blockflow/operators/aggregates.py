"""Aggregations (A1-A10, A16-A17).  All are hash aggregates with a map-side
partial step, so a hot key is pre-aggregated in every task before the
shuffle and never lands whole in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A1: rows per value of ``col``."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def group_sum(df: DataFrame, key: str, cols: list[str], prefix: str = "") -> DataFrame:
    """A2: per-key sums of several measures."""
    return df.groupBy(key).agg(*[F.sum(c).alias(prefix + c) for c in cols])


def count_by(df: DataFrame, col: str, measure: str = "net") -> DataFrame:
    """A3: non-null ``measure`` per group (``groupby(col)[measure].count()``);
    rows without a group are in none."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.col(measure)).alias("cnt"))


def row_count(df: DataFrame) -> DataFrame:
    """A4."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def global_sum(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A5."""
    return df.agg(F.sum(col).alias(name or f"sum_{col}"))


def conditional_sum(df: DataFrame, col: str, cond, name: str) -> DataFrame:
    """``sum(col) where cond`` as one aggregate, no second scan."""
    return df.agg(F.sum(F.when(cond, F.col(col)).otherwise(F.lit(0))).alias(name))


def data_bounds(df: DataFrame, x: str = "easting", y: str = "northing") -> DataFrame:
    """Extent and its centre (one row)."""
    b = df.agg(F.min(x).alias("xmin"), F.max(x).alias("xmax"), F.min(y).alias("ymin"), F.max(y).alias("ymax"))
    return b.withColumns({"xc": (F.col("xmin") + F.col("xmax")) / F.lit(2.0),
                          "yc": (F.col("ymin") + F.col("ymax")) / F.lit(2.0)})


def race_in_out(df: DataFrame, col: str = "race") -> DataFrame:
    """Individuals moving in (+) and out (-) per race from signed codes."""
    return (df.groupBy(F.abs(F.col(col)).alias("race"), F.signum(F.col(col)).cast("int").alias("direction"))
            .agg(F.count(F.lit(1)).alias("cnt")))


def fixed_width_histogram(df: DataFrame, col: str, lo: float, width: float) -> DataFrame:
    """Counts in bins ``[lo + i*width, lo + (i+1)*width)``."""
    b = F.floor((F.col(col).cast("double") - F.lit(float(lo))) / F.lit(float(width))).cast("long")
    return (df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
            .withColumn("bin_lo", F.lit(float(lo)) + F.col("bin") * F.lit(float(width))))


def clamp_viewport(df: DataFrame, window, x: str = "lon", y: str = "lat") -> DataFrame:
    """clamp a requested ``(x0, x1, y0, y1)`` window to the data extent (one row)."""
    x0, x1, y0, y1 = window
    return df.agg(F.greatest(F.lit(float(x0)), F.min(x)).alias("lon0"),
                  F.least(F.lit(float(x1)), F.max(x)).alias("lon1"),
                  F.greatest(F.lit(float(y0)), F.min(y)).alias("lat0"),
                  F.least(F.lit(float(y1)), F.max(y)).alias("lat1"))

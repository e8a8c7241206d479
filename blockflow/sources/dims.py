"""Dimension (lookup) tables: id <-> name, with key/value inversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import RACE_NAMES, STATE_ABBR


def state_abbr(spark: SparkSession) -> DataFrame:
    """FIPS code -> postal abbreviation (52 rows, a fixed code table)."""
    schema = T.StructType([T.StructField("fips", T.IntegerType()), T.StructField("abbr", T.StringType())])
    return spark.createDataFrame(sorted(STATE_ABBR.items()), schema)


def race_dim(spark: SparkSession) -> DataFrame:
    """Race code -> name (8 rows, a fixed code table)."""
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    return spark.createDataFrame(sorted(RACE_NAMES.items()), schema)


def invert(dim: DataFrame, key: str = "id", value: str = "name") -> DataFrame:
    """``{v: k for k, v in d.items()}``: swap the columns; for a value held by
    several keys the largest key wins, as the last insert wins in a dict built
    in key order."""
    return dim.groupBy(F.col(value).alias(key + "_name")).agg(F.max(key).alias(value + "_id")) \
        .select(F.col(key + "_name").alias(value), F.col(value + "_id").alias(key))

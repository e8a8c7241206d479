"""Readers for the census-format inputs, producing the tables the jobs take.

* 2010 block counts (CSV: GISJOIN, STATEA, H7X001 total, H7X002..H7X008 races)
  -> ``block10``: ID10, STATE, P10, R101..R107
* 2020 block counts (CSV, Latin-1: GISJOIN, GEOCODE, STATEA, COUNTY, U7B001
  total, U7B003..U7B009 races) -> ``block20``: ID20, STATE, COUNTY, P20, R201..R207
* block relationship files (one ``|``-delimited file per state, byte-order
  mark before the header, more columns than needed) -> ``crosswalk``:
  ID10, ID20, STATE_2020

All reads use declared schemas or header names with explicit casts - never
schema inference - and one scan over all files of a kind (per header).
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import ids
from ..schemas import BLOCK2010_CSV, BLOCK2020_CSV
from .files import read_csv

BOM = "﻿"
REL_KEYS = ["STATE_2010", "COUNTY_2010", "TRACT_2010", "BLK_2010",
            "STATE_2020", "COUNTY_2020", "TRACT_2020", "BLK_2020"]


def read_block2010(spark: SparkSession, path: str) -> DataFrame:
    df = read_csv(spark, path, BLOCK2010_CSV)
    return df.select(ids.parse_gisjoin("GISJOIN").alias("ID10"), F.col("STATEA").alias("STATE"),
                     F.col("H7X001").alias("P10"),
                     *[F.col(f"H7X00{k + 1}").alias(f"R10{k}") for k in range(1, 8)])


def read_block2020(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    df = read_csv(spark, path, BLOCK2020_CSV, encoding=encoding)
    return df.select(F.col("GEOCODE").alias("ID20"), F.col("STATEA").alias("STATE"), "COUNTY",
                     F.col("U7B001").alias("P20"),
                     *[F.col(f"U7B00{k + 2}").alias(f"R20{k}") for k in range(1, 8)])


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of a text file (compressed ones too), through its own file system; None for an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    jp = jvm.org.apache.hadoop.fs.Path(path)
    stream = jp.getFileSystem(conf).open(jp)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jp)
        text = codec.createInputStream(stream) if codec is not None else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def files_by_header(spark: SparkSession, pattern: str) -> dict[str, list[str]]:
    """Header line -> files of ``pattern`` having it; of each file (one per
    state) its first line alone is read.  Empty files have no rows and no header."""
    out: dict[str, list[str]] = {}
    for path in sorted(unquote(p) for p in spark.read.text(pattern).inputFiles()):
        line = first_line(spark, path)
        if line is not None:
            out.setdefault(line.rstrip("\r").lstrip(BOM), []).append(path)
    return out


def read_relationship(spark: SparkSession, pattern: str) -> DataFrame:
    """All relationship files matching ``pattern``.

    Columns are taken by header name, file by file: the files are grouped by
    their header line, each group is one scan under its own names, and the
    groups are united by name.  Files may carry more columns, in any order, and
    names in any case; a file whose first line lacks an id column, header or
    not, is an error.  A byte-order mark in front of
    the first name is ignored, and the id parts are cast to int and composed
    into 15-digit ids (F3).
    """
    parts = None
    for header, paths in files_by_header(spark, pattern).items():
        names = [c.strip().strip('"').strip() for c in header.split("|")]
        missing = set(REL_KEYS) - {c.upper() for c in names}
        if missing:
            raise ValueError(f"{', '.join(paths[:3])}: the first line names no column {sorted(missing)}")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        raw = spark.read.schema(schema).option("header", True).option("sep", "|").csv(paths)
        raw = raw.select(*[F.col(c).cast("int").alias(c) for c in REL_KEYS])
        parts = raw if parts is None else parts.unionByName(raw)
    if parts is None:
        raise ValueError(f"no relationship file with a header matches {pattern}")
    return parts.select(
        ids.compose_block_id("STATE_2010", "COUNTY_2010", "TRACT_2010", "BLK_2010").alias("ID10"),
        ids.compose_block_id("STATE_2020", "COUNTY_2020", "TRACT_2020", "BLK_2020").alias("ID20"),
        F.col("STATE_2020"))

"""File sources (S1-S8, S10).  Explicit schemas everywhere - never
``inferSchema`` - so a scan is one pass and the types are the same on every
file."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from ..schemas import MULTIPOLYGON_DDL


def read_csv(spark: SparkSession, path: str, schema: T.StructType, cols: list[str] | None = None,
             sep: str = ",", encoding: str | None = None, header: bool = True) -> DataFrame:
    """CSV with a declared schema; only ``cols`` are kept.

    ``sep="|"`` reads the pipe-delimited relationship files; a UTF-8 byte
    order mark before the first header is dropped by the reader;
    ``encoding="ISO-8859-1"`` reads Latin-1 text.
    """
    r = spark.read.schema(schema).option("header", header).option("sep", sep)
    if encoding:
        r = r.option("encoding", encoding)
    df = r.csv(path)
    return df.select(*cols) if cols else df


def read_csv_files(spark: SparkSession, pattern: str, schema: T.StructType, source_col: str = "source_file",
                   **kw) -> DataFrame:
    """One scan over many files (one per state); files that do not exist
    simply do not match the glob.  The file each row came from is kept."""
    df = read_csv(spark, pattern, schema, **kw)
    return df.withColumn(source_col, F.col("_metadata.file_path"))


def read_parquet(spark: SparkSession, path: str, cols: list[str] | None = None) -> DataFrame:
    """Parquet file or directory (split by row groups / maxPartitionBytes)."""
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_dataset(spark: SparkSession, path: str, state=None, state_col: str = "state",
                 state_type: T.DataType | str | None = None) -> DataFrame:
    """The whole country, or one state of a dataset partitioned by state
    (the filter prunes partitions: only that state's files are opened).

    ``state_type`` declares the type the state was written with; without it
    Spark reads it off the directory names, where the code "01" looks like 1.
    """
    df = spark.read.parquet(path)
    if state_type is not None:
        kind = T._parse_datatype_string(state_type) if isinstance(state_type, str) else state_type
        fields = [T.StructField(f.name, kind) if f.name == state_col else f for f in df.schema]
        df = spark.read.schema(T.StructType(fields)).parquet(path)
    if state is None or state == "USA":
        return df
    return df.where(F.col(state_col) == F.lit(state))


def list_states(dataset: DataFrame, state_col: str = "state") -> DataFrame:
    """The states present in a dataset (as they were written, see
    ``state_type`` of :func:`read_dataset`) plus the whole-country entry "USA"."""
    s = dataset.select(F.col(state_col).cast("string").alias("name")).where("name is not null").distinct()
    return s.unionByName(dataset.sparkSession.createDataFrame([("USA",)], "name string"))


def read_polygons(spark: SparkSession, path: str, id_col: str = "GEOID20", geom_col: str = "geometry",
                  fmt: str = "parquet") -> DataFrame:
    """Polygon table with the geometry stored as JSON rings text
    (``[[[{"x":..,"y":..}, ...]]]``: parts -> rings -> vertices)."""
    df = spark.read.format(fmt).load(path)
    return df.select(F.col(id_col), F.from_json(F.col(geom_col), MULTIPOLYGON_DDL).alias(geom_col))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, asked of its Hadoop file system (no job, no
    logged "not found" error); falls back to resolving it as a table."""
    try:
        jp = spark._jvm.org.apache.hadoop.fs.Path(path)
        return bool(jp.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jp))
    except AttributeError:  # no JVM handle (e.g. a Connect session)
        try:
            spark.read.text(path).schema  # noqa: B018 - resolves the file listing only
            return True
        except AnalysisException:
            return False


def stored_stats(spark: SparkSession, path: str, columns: list[str]) -> dict:
    """A4 / A7 from the footers of the Parquet files at ``path``: ``n_rows`` and
    min / max per column, without reading a row (the V2 reader with the
    aggregates pushed down).  Files without statistics for a column (NaN in it,
    or written without) are scanned instead."""
    settings = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = spark.read.parquet(path).agg(*aggs).first().asDict()
        return found | {"n_rows": found["n_rows"] or 0}                 # null where every file is empty
    except Exception as e:
        if "No min/max found" not in str(e):
            raise
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(path).agg(*aggs).first().asDict()


def partition_values(spark: SparkSession, path: str, column: str) -> list[str | None]:
    """The values of the partition folders ``column=value`` at ``path``, as
    written (None for the null partition), listed by the path's file system."""
    null = "__HIVE_DEFAULT_PARTITION__"
    try:
        jp = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = jp.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(jp) if s.isDirectory()] if fs.exists(jp) else []
    except AttributeError:  # no JVM handle (e.g. a Connect session)
        if not path_exists(spark, path):
            return []
        found = spark.read.schema(f"`{column}` string").parquet(path).select(column).distinct().collect()
        return [r[0] for r in found]
    values = [unquote(n.split("=", 1)[1]) for n in names if n.startswith(column + "=")]
    return [None if v == null else v for v in values]


def publish(df: DataFrame, name: str | None = None, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> str:
    """Keep a loaded dataset at storage ``level`` and name it for SQL;
    returns the view's name (a fresh one by default).  :func:`unpublish` gives
    the memory back."""
    name = name or f"published_{uuid.uuid4().hex}"
    df.persist(level).createOrReplaceTempView(name)
    return name


def unpublish(spark: SparkSession, name: str) -> None:
    """Drop a published dataset from memory and from the catalog."""
    spark.table(name).unpersist()
    spark.catalog.dropTempView(name)

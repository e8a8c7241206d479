"""Cross-filter answers from a pre-aggregated cube (C3 without a full scan).

``build`` stores two tables.  The points, one directory per tile of ``cell``
metres (a power of two, so a tile's edges are exact doubles), sorted inside a
directory by finer tiles.  The cube, one row per tile, county, race and net
with its number of points: at most tiles x counties x races x 3 rows whatever
the number of points, since a point has one of each.

``crossfilter_cube`` answers a request from both: a tile that lies whole in the
box is taken from the cube, and only the directories of tiles that the edge of
the box cuts are read from the points, so an interaction costs the cube and
the edge, not the data.  View filter and bar selections are filters on
columns that both tables have.  The result is that of
``crossfilter.crossfilter_all`` without a viewport, for any box.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators import filters
from ..session import scratch_path

#: Tile width in metres.
CELL = float(1 << 18)
DIMS = ["county", "race", "net"]


@dataclass(frozen=True)
class Cube:
    """The stored tables of :func:`build` (``points``: tile directories ``tx``, ``ty``)."""
    points: str
    cube: str
    columns: StructType              # of the stored points
    cell: float
    x: str = "easting"
    y: str = "northing"


def _tile(c: str, cell: float) -> Column:
    return F.floor(F.col(c) / F.lit(cell)).cast("int")


def build(points: DataFrame, path: str | None = None, cell: float = CELL, x: str = "easting", y: str = "northing") -> Cube:
    """Store ``points`` (county, race, net, ``x``, ``y`` and any other columns
    but ``tx`` and ``ty``) by tile, and their cube.

    A tile with many points is several files: rows go to tasks by ranges of
    tile and coordinates.  Points without a coordinate have the null tile.
    """
    if math.frexp(cell)[0] != 0.5:
        raise ValueError("the tile width must be a power of two")
    if {"tx", "ty"} & {c.lower() for c in points.columns}:
        raise ValueError("columns tx and ty are the tile's")
    path = path or scratch_path(points.sparkSession, "cube")
    whole = F.col(x).isNotNull() & F.col(y).isNotNull()
    tiles = points.withColumns({"tx": F.when(whole, _tile(x, cell)), "ty": F.when(whole, _tile(y, cell))})
    fine = [_tile(c, cell / 64) for c in (x, y)]
    stored = tiles.repartitionByRange("tx", "ty", *fine, F.col(x)).sortWithinPartitions("tx", "ty", *fine)
    out = Cube(os.path.join(path, "points"), os.path.join(path, "cube"), tiles.schema, cell, x, y)
    stored.write.partitionBy("tx", "ty").parquet(out.points)
    cube = stored_points(points.sparkSession, out).groupBy("tx", "ty", *DIMS).agg(F.count(F.lit(1)).alias("n"))
    cube.repartitionByRange("tx", "ty").sortWithinPartitions("tx", "ty").write.parquet(out.cube)
    return out


def stored_points(spark: SparkSession, stored: Cube) -> DataFrame:
    return spark.read.schema(stored.columns).parquet(stored.points)


def _tiles_of(box, cell: float) -> tuple[tuple[int, int, int, int], tuple[int, int, int, int]]:
    """(tiles the box meets, tiles whole in the box) as x0, x1, y0, y1, inclusive;
    a whole tile holds coordinates from its lower edge to below its upper edge."""
    (x0, x1), (y0, y1) = sorted(map(float, box[:2])), sorted(map(float, box[2:]))
    meets = tuple(math.floor(v / cell) for v in (x0, x1, y0, y1))
    whole = (math.ceil(x0 / cell), math.floor(x1 / cell) - 1, math.ceil(y0 / cell), math.floor(y1 / cell) - 1)
    return meets, whole


def _between(c: str, lo: int, hi: int) -> Column:
    return F.col(c).between(F.lit(lo), F.lit(hi))


def weighted(spark: SparkSession, stored: Cube, view: str = "total", box=None, selections=None) -> DataFrame:
    """county, race, net, n: the points of the request, whole tiles summed up, the others row by row."""
    cube = spark.read.parquet(stored.cube)
    if box is None:
        rows = cube.select(*DIMS, "n")
    else:
        (mx0, mx1, my0, my1), (wx0, wx1, wy0, wy1) = _tiles_of(box, stored.cell)
        inside = _between("tx", wx0, wx1) & _between("ty", wy0, wy1)
        points = stored_points(spark, stored)
        # the tiles met but not whole; for the tile directories these are partition filters
        edge = _between("tx", mx0, mx1) & _between("ty", my0, my1) & ~inside
        cut = filters.box_select(points.where(edge), box, stored.x, stored.y)
        rows = cube.where(inside).select(*DIMS, "n").unionByName(cut.select(*DIMS, F.lit(1).cast("long").alias("n")))
    return filters.filter_selections(filters.filter_view(rows, view), selections)


def crossfilter_cube(spark: SparkSession, stored: Cube, view: str = "total", box=None, selections=None) -> DataFrame:
    """The county, race and total rows of ``crossfilter_all``: grp, county,
    race, px, py (null), cnt, n_rows, mean_race, mean_net."""
    rows = weighted(spark, stored, view, box, selections)

    def total(value):
        return F.sum(value)

    def mean(c):
        return F.try_divide(total(F.col(c).cast("double") * F.col("n")), total(F.when(F.col(c).isNotNull(), F.col("n"))).cast("double"))

    g = rows.groupingSets([["county"], ["race"], []], "county", "race").agg(
        F.grouping_id().alias("gid"), F.coalesce(total(F.when(F.col("net").isNotNull(), F.col("n"))), F.lit(0).cast("long")).alias("cnt"),
        total(F.col("n")).alias("n_rows"), mean("race").alias("mean_race"), mean("net").alias("mean_net"))
    grp = F.when(F.col("gid") == 1, "county").when(F.col("gid") == 2, "race").otherwise("total")
    out = g.withColumn("grp", grp)
    keep = F.when(F.col("grp") == "county", F.col("county").isNotNull()).when(
        F.col("grp") == "race", F.col("race").isNotNull() & F.lit(view != "out")).otherwise(F.col("n_rows").isNotNull())
    none = F.lit(None).cast("int")
    return out.where(keep).select("grp", "county", "race", none.alias("px"), none.alias("py"), "cnt", "n_rows", "mean_race", "mean_net")

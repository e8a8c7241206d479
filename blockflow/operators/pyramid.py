"""Tile pyramid: rasters (A11, A12) of any zoom from stored cells.

``build`` aggregates the points once to the cells of the finest zoom and
stores them; each coarser zoom is the one below merged two by two, so the
points are scanned once and the levels shrink geometrically.  A cell row holds
what counts and means need in a form that can be merged: the number of points
per ``net``, and the number and sum of the non-null races.

A map window is answered from the zoom whose cells are no larger than the
wanted pixels (``fitting``), snapped outwards to the edges of these cells; the
read touches one zoom's directory and, inside it, only row groups whose cells
meet the window.  On the snapped window the result is that of
``raster.raster`` over the points; a point exactly on the window's upper edge
belongs to the next cell.

The square of the pyramid and its cells have powers of two as edges, so all
cell edges are exact doubles at every zoom.
"""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .filters import filter_view

#: Web-Mercator metres from the corner, enough for the whole projection.
SIDE, CORNER = float(1 << 26), (-float(1 << 25), -float(1 << 25))
LEVELS = 16


@dataclass(frozen=True)
class Pyramid:
    path: str
    levels: int
    corner: tuple[float, float] = CORNER
    side: float = SIDE

    def cell(self, z: int) -> float:
        """Width of a cell at zoom ``z`` (0: the whole square is one cell)."""
        return self.side / (1 << z)

    def level_path(self, z: int) -> str:
        return os.path.join(self.path, f"z={z}")


def _morton(bits: int) -> Column:
    key = F.lit(0).cast("long")
    for b in range(bits):
        one = F.lit(1 << b)
        key = key.bitwiseOR(F.shiftleft(F.col("cx").bitwiseAND(one).cast("long"), b)).bitwiseOR(
            F.shiftleft(F.col("cy").bitwiseAND(one).cast("long"), b + 1))
    return key


def _store(cells: DataFrame, p: Pyramid, z: int) -> DataFrame:
    """Write a level clustered by interleaved cell, so that files and row groups are compact areas."""
    key = _morton(z)
    cells.repartitionByRange(key).sortWithinPartitions(key).write.parquet(p.level_path(z))
    return cells.sparkSession.read.schema(cells.schema).parquet(p.level_path(z))


def build(points: DataFrame, path: str | None = None, levels: int = LEVELS, corner: tuple[float, float] = CORNER,
          side: float = SIDE, x: str = "easting", y: str = "northing", race: str = "race", net: str = "net") -> Pyramid:
    """Store zooms 0 to ``levels``.  Points outside the square or without a
    coordinate have no cell.  ``levels`` of 24 is a 4-metre cell; a level has
    at most three rows per non-empty cell."""
    if math.frexp(side)[0] != 0.5 or any(c % (side / (1 << levels)) for c in corner):
        raise ValueError("side must be a power of two, corner a multiple of the finest cell")
    p = Pyramid(path or scratch_path(points.sparkSession, "pyramid"), levels, corner, side)
    s = F.lit(p.cell(levels))
    cx, cy = (F.floor((F.col(c) - F.lit(o)) / s) for c, o in ((x, corner[0]), (y, corner[1])))
    inside = F.col(x).between(F.lit(corner[0]), F.lit(corner[0] + side)) & F.col(y).between(F.lit(corner[1]), F.lit(corner[1] + side))
    top = F.lit((1 << levels) - 1)
    d = points.where(inside).select(F.least(cx, top).cast("int").alias("cx"), F.least(cy, top).cast("int").alias("cy"),
                                    F.col(net).cast("int").alias("net"), F.col(race).cast("long").alias("race"))
    cells = d.groupBy("cx", "cy", "net").agg(F.count(F.lit(1)).alias("n"), F.count("race").alias("races"),
                                             F.coalesce(F.sum("race"), F.lit(0)).cast("long").alias("race_sum"))
    cells = _store(cells, p, levels)
    for z in range(levels - 1, -1, -1):
        half = [F.shiftright(F.col(c), 1).alias(c) for c in ("cx", "cy")]
        cells = _store(cells.groupBy(*half, "net").agg(*[F.sum(c).alias(c) for c in ("n", "races", "race_sum")]), p, z)
    return p


def fitting(p: Pyramid, window, width: int, height: int) -> tuple[int, tuple[float, float, float, float], int, int]:
    """(zoom, snapped window, its width and height in cells) for ``window`` = (x0, x1, y0, y1) shown on
    ``width`` x ``height`` pixels: the coarsest zoom with cells no larger than a pixel, or the finest there is."""
    x0, x1, y0, y1 = (*sorted(map(float, window[:2])), *sorted(map(float, window[2:])))
    pixel = min((x1 - x0) / width, (y1 - y0) / height)
    z = p.levels if pixel <= 0 else min(p.levels, max(0, math.ceil(math.log2(p.side / pixel))))
    s = p.cell(z)
    a, b = (math.floor((v - o) / s) for v, o in zip((x0, y0), p.corner))
    c, d = (max(math.ceil((v - o) / s), low + 1) for v, o, low in zip((x1, y1), p.corner, (a, b)))
    snapped = (p.corner[0] + a * s, p.corner[0] + c * s, p.corner[1] + b * s, p.corner[1] + d * s)
    return z, snapped, c - a, d - b


def raster(spark: SparkSession, p: Pyramid, window, width: int, height: int, view: str = "total",
           agg: str = "count") -> tuple[DataFrame, tuple[float, float, float, float]]:
    """((px, py, value) of the non-empty cells, the snapped window they lie in).

    ``agg``: ``count`` (points with a net), ``mean_net`` or ``mean_race``.
    """
    z, snapped, w, h = fitting(p, window, width, height)
    s = p.cell(z)
    a, b = round((snapped[0] - p.corner[0]) / s), round((snapped[2] - p.corner[1]) / s)
    cells = spark.read.parquet(p.level_path(z))
    cells = cells.where(F.col("cx").between(F.lit(a), F.lit(a + w - 1)) & F.col("cy").between(F.lit(b), F.lit(b + h - 1)))
    cells = filter_view(cells, view)
    with_net = F.when(F.col("net").isNotNull(), F.col("n"))
    value = {"count": F.coalesce(F.sum(with_net), F.lit(0).cast("long")),
             "mean_net": F.try_divide(F.sum(F.col("net") * F.col("n")).cast("double"), F.sum(with_net).cast("double")),
             "mean_race": F.try_divide(F.sum("race_sum").cast("double"), F.sum("races").cast("double"))}[agg]
    out = cells.groupBy((F.col("cx") - F.lit(a)).alias("px"), (F.col("cy") - F.lit(b)).alias("py")).agg(value.alias("value"))
    return out, snapped

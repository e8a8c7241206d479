"""Spatial join through a linear quadtree (J8 / J9): polygons as intervals of
the Z-order, points with one interleaved key each.

A polygon's cells (as in ``spatial.polygon_cells``: whole inside, or cut by an
edge) are quadtree cells of its own size, so each is one interval of the
Z-order of the finest cells.  The starts and ends of all intervals cut the
order into segments; since quadtree cells are nested or apart, a segment lies
whole inside a cell or whole outside, and the cells over it are looked up by
the prefixes of its start, on the polygons' side alone.  A point then belongs
to exactly one segment, whatever the number of levels and polygons: points and
segment starts are sorted together by ranges of the key and the last start
before a point is its segment (one number carried per range).  Only points
under a cut cell run the exact test, against the edges of their polygon's row.

Stored points (:func:`store`) are clustered by the key, which is a column, so
the polygons' coverage, as at most ``RANGES`` intervals, is pushed to the scan
and files and row groups outside it are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geo
from ..session import checkpoint_dir, scratch_path
from . import spatial
from .ranges import placed

RANGES, _COARSE = 64, 6


@dataclass(frozen=True)
class Grid:
    """A square of 2**bits x 2**bits finest cells; ``cell`` and ``corner`` are
    such that all edges are exact doubles (a power of two and multiples of it)."""
    cell: float
    corner: tuple[float, float]
    bits: int = 24

    def __post_init__(self):
        if math.frexp(self.cell)[0] != 0.5 or any(c % self.cell for c in self.corner) or not _COARSE < self.bits <= 30:
            raise ValueError("cell must be a power of two, corner a multiple of it, bits 7 to 30")

    @property
    def level(self) -> int:
        return math.frexp(self.cell)[1] - 1

    @property
    def side(self) -> float:
        return self.cell * (1 << self.bits)


#: Degrees (cells of about 3 m) and Web-Mercator metres (cells of 4 m).
LONLAT = Grid(2.0 ** -15, (-256.0, -256.0))
METRES = Grid(4.0, (-float(1 << 25), -float(1 << 25)))


def interleaved(gx: Column, gy: Column, bits: int) -> Column:
    """The bits of two cell numbers in turn."""
    key = F.lit(0).cast("long")
    for b in range(bits):
        one = F.lit(1 << b).cast("long")
        key = key.bitwiseOR(F.shiftleft(gx.cast("long").bitwiseAND(one), b)).bitwiseOR(F.shiftleft(gy.cast("long").bitwiseAND(one), b + 1))
    return key


def z_key(x: str, y: str, grid: Grid) -> Column:
    """The key of a point's finest cell; null outside the grid or without a coordinate."""
    gx, gy = (F.floor((F.col(c) - F.lit(o)) / F.lit(grid.cell)) for c, o in ((x, grid.corner[0]), (y, grid.corner[1])))
    top = F.lit((1 << grid.bits) - 1)
    inside = gx.between(F.lit(0), top) & gy.between(F.lit(0), top)
    return F.when(inside, interleaved(gx, gy, grid.bits))


def store(points: DataFrame, grid: Grid = LONLAT, x: str = "lon", y: str = "lat", z: str = "z", path: str | None = None) -> DataFrame:
    """``points`` and their key ``z``, written in files clustered by it and read back."""
    path = path or scratch_path(points.sparkSession, "zordered")
    d = points.withColumn(z, z_key(x, y, grid))
    d.repartitionByRange(F.col(z), F.col(x), F.col(y)).sortWithinPartitions(z).write.parquet(path)
    return points.sparkSession.read.schema(d.schema).parquet(path)


def quadtree_cells(levelled: DataFrame, key: str, grid: Grid, geom: str = "geometry", depth: int = 2) -> DataFrame:
    """Cells of each polygon (rows of ``spatial.with_level``) as Z-order
    intervals: key, __boundary, __s (cell width), __lvl, __z (first finest
    cell) and __span (finest cells).  Polygons smaller than a finest cell take
    the finest; one that reaches out of the grid is an error."""
    cells = spatial.polygon_cells(levelled, key, geom, depth)
    s = F.pow(F.lit(2.0), F.col("__lvl"))
    gx, gy = (F.floor((F.col(c) * s - F.lit(o)) / F.lit(grid.cell)).cast("long") for c, o in (("__cx", grid.corner[0]), ("__cy", grid.corner[1])))
    within = gx.between(F.lit(0), F.lit((1 << grid.bits) - 1)) & gy.between(F.lit(0), F.lit((1 << grid.bits) - 1))
    z = F.when(within, interleaved(gx, gy, grid.bits)).otherwise(F.raise_error(F.lit("polygon outside the grid")).cast("long"))
    span = F.expr(f"shiftleft(cast(1 as bigint), 2 * (__lvl - ({grid.level})))")
    return cells.select(key, "__boundary", s.alias("__s"), "__lvl", z.alias("__z"), span.alias("__span"))


def segments(cells: DataFrame, key: str, levels: list[int], grid: Grid) -> DataFrame:
    """__seg (first key of a segment) and __over: the polygons' cells over it."""
    cuts = cells.select(F.explode(F.array("__z", F.col("__z") + F.col("__span"))).alias("__seg")).distinct()
    prefix = "shiftright({0}, 2 * ({1} - ({2})))"
    starts = cuts.withColumn("__lvl", F.explode(F.array(*[F.lit(v) for v in levels])))
    starts = starts.withColumn("__p", F.expr(prefix.format("__seg", "__lvl", grid.level)))
    named = cells.select("__lvl", F.expr(prefix.format("__z", "__lvl", grid.level)).alias("__p"),
                         F.struct(F.col(key).alias("key"), F.col("__boundary").alias("boundary"), F.col("__s").alias("s")).alias("c"))
    over = starts.join(named, ["__lvl", "__p"]).groupBy("__seg").agg(F.collect_list("c").alias("__over"))
    return cuts.join(over, "__seg", "left")


def coverage(cells: DataFrame, grid: Grid, most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` intervals (inclusive) that hold all cells: 4**6 coarse
    cells, those in use collected and the narrowest gaps closed."""
    shift = 2 * (grid.bits - _COARSE)
    first, last = F.shiftright("__z", shift), F.shiftright(F.col("__z") + F.col("__span") - 1, shift)
    used = sorted(r[0] for r in cells.select(F.explode(F.sequence(first, last)).alias("b")).distinct().collect())   # 4,096 at most
    out: list[list[int]] = []
    for b in used:
        if out and b == out[-1][1] + 1:
            out[-1][1] = b
        else:
            out.append([b, b])
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda j: out[j + 1][0] - out[j][1])
        out[i:i + 2] = [[out[i][0], out[i + 1][1]]]
    return [(a << shift, ((b + 1) << shift) - 1) for a, b in out]


def _segment_of(points: DataFrame, starts: DataFrame, z: str) -> DataFrame:
    """``points`` with __seg, the last start at or before their key (null before the first)."""
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in points.schema if f.name != z]
    both = points.withColumn("__kind", F.lit(1)).unionByName(
        starts.select(F.col("__seg").alias(z), *none, F.lit(0).alias("__kind")))
    tie = F.xxhash64(*[c for c in points.columns if c != z])
    p = placed(both.withColumn("__tie", tie), z, "__kind", "__tie")
    start = F.when(F.col("__kind") == 0, F.col(z))
    so_far = Window.partitionBy(p.range).orderBy(p.at).rowsBetween(Window.unboundedPreceding, 0)
    rows = p.rows.withColumn("__own", F.last(start, ignorenulls=True).over(so_far)).where("__kind = 1")
    lasts = {r[0]: r[1] for r in p.rows.where("__kind = 0").groupBy(p.range).agg(F.max(z)).collect()}   # one per range
    carry, before = [], None
    for r, _ in p.sizes:
        carry.append((r, before))
        before = lasts.get(r, before)
    carry = points.sparkSession.createDataFrame(carry, "r int, __before long").withColumnRenamed("r", p.range)
    rows = rows.join(F.broadcast(carry), p.range, "left").withColumn("__seg", F.coalesce("__own", "__before"))
    return rows.drop(p.range, p.at, "__kind", "__tie", "__own", "__before")


def spatial_join_zorder(points: DataFrame, polys: DataFrame, key: str, x: str = "lon", y: str = "lat", geom: str = "geometry",
                        depth: int = 2, grid: Grid = LONLAT, z: str | None = None, per_side: int = 32,
                        max_broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Every (point, polygon) pair with the point inside: the rows of
    ``spatial.spatial_join``.  ``z`` names the key column of points stored with
    :func:`store` on the same grid; without it the key is computed here.

    The polygons' tables are checkpointed when the plan is made, and the points
    are placed by ranges once; the segments are broadcast only within
    ``max_broadcast_bytes``, otherwise joined by a shuffle that AQE splits.
    """
    spatial.check_names(points, polys, key, geom, {"__z", "__span", "__seg", "__over", "__kind", "__tie", "__own", "__before"})
    spatial.check_key(polys, key)
    checkpoint_dir(polys.sparkSession)
    p = spatial.with_level(polys.select(key, geom), geom, depth, per_side)
    p = p.withColumn("__lvl", F.greatest("__lvl", F.lit(grid.level))).withColumn("__s", F.pow(F.lit(2.0), F.col("__lvl"))).checkpoint(eager=True)
    cells = quadtree_cells(p, key, grid, geom, depth).checkpoint(eager=True)
    levels = sorted(r[0] for r in cells.select("__lvl").distinct().collect())
    if not levels:
        return spatial.no_matches(points, polys, key, geom, drop=z)
    segs = segments(cells, key, levels, grid).checkpoint(eager=True)
    name = z or "__z"
    if z:
        near = None
        for a, b in coverage(cells, grid):
            inside = F.col(z).between(F.lit(a), F.lit(b))
            near = inside if near is None else near | inside
        pts = points.where(near)
    else:
        r = p.agg(F.min("__minx"), F.max("__maxx"), F.min("__miny"), F.max("__maxy")).first()
        pts = points.where(F.col(x).between(r[0], r[1]) & F.col(y).between(r[2], r[3])).withColumn(name, z_key(x, y, grid))
    pts = _segment_of(pts, segs, name).drop(name)
    size = segs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.coalesce("__over", F.array()))).alias("m")).first()
    covered = segs.where(F.col("__over").isNotNull())
    key_bytes = spatial.key_bytes(polys, key)
    small = 32 * size["n"] + (40 + key_bytes) * (size["m"] or 0) <= max_broadcast_bytes
    cand = pts.join(F.broadcast(covered) if small else covered, "__seg").drop("__seg")
    kept = [c for c in points.columns if c != z]
    cand = cand.select(*kept, F.explode("__over").alias("__c"))
    cand = cand.select(*kept, F.col("__c.key").alias(key), F.col("__c.boundary").alias("__boundary"),
                       F.floor(F.col(y) / F.col("__c.s")).alias("__cy"))
    bands = spatial.band_edges(p, key, geom, depth).checkpoint(eager=True)
    return spatial.with_attributes(spatial.decided(cand, bands, key, x, y, key_bytes, max_broadcast_bytes), polys, key, geom, max_broadcast_bytes)

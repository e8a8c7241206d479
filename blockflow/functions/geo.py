"""Geometry as plain Column expressions.

Polygons are nested arrays: a polygon is ``array<ring>`` (first ring outer,
further rings holes, combined by the even-odd rule) and a multipolygon is
``array<polygon>``.  A ring is ``array<struct<x,y>>`` and is closed (its last
vertex repeats the first).  Everything stays inside the JVM: higher-order
functions over the vertex arrays, no Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..schemas import EARTH_RADIUS

DEG = math.pi / 180.0
QUARTER_PI = math.pi / 4.0


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- projections (F10, F11) -------------------------------------------------

def to_mercator(lon, lat) -> tuple[Column, Column]:
    """lon/lat degrees -> Web-Mercator metres (EPSG:3857)."""
    x = F.lit(EARTH_RADIUS) * (_c(lon) * F.lit(DEG))
    y = F.lit(EARTH_RADIUS) * F.ln(F.tan(F.lit(QUARTER_PI) + (_c(lat) * F.lit(DEG)) / F.lit(2.0)))
    return x, y


def from_mercator(x, y) -> tuple[Column, Column]:
    """Web-Mercator metres -> lon/lat degrees."""
    lon = (_c(x) / F.lit(EARTH_RADIUS)) / F.lit(DEG)
    lat = (F.lit(2.0) * F.atan(F.exp(_c(y) / F.lit(EARTH_RADIUS))) - F.lit(math.pi / 2.0)) / F.lit(DEG)
    return lon, lat


def mercator_xy(lon: float, lat: float) -> tuple[float, float]:
    """F10 for driver-side parameters (viewport and box corners)."""
    return (EARTH_RADIUS * (lon * DEG),
            EARTH_RADIUS * math.log(math.tan(QUARTER_PI + (lat * DEG) / 2.0)))


def lonlat_of(x: float, y: float) -> tuple[float, float]:
    """F11 for driver-side parameters."""
    return ((x / EARTH_RADIUS) / DEG,
            (2.0 * math.atan(math.exp(y / EARTH_RADIUS)) - math.pi / 2.0) / DEG)


def ring_to_mercator(ring) -> Column:
    return F.transform(_c(ring), lambda v: F.struct(*[c.alias(n) for c, n in zip(
        to_mercator(v["x"], v["y"]), ("x", "y"))]))


def polygon_to_mercator(poly) -> Column:
    """reproject every vertex of a polygon (array of rings)."""
    return F.transform(_c(poly), ring_to_mercator)


def multipolygon_to_mercator(mp) -> Column:
    """F17 for multipolygons (array of polygons)."""
    return F.transform(_c(mp), polygon_to_mercator)


# --- bounds, area (F13) -----------------------------------------------------

def _vertices(geom, depth: int) -> Column:
    """All vertices of a ring (depth 1), polygon (2) or multipolygon (3)."""
    g = _c(geom)
    for _ in range(depth - 1):
        g = F.flatten(g)
    return g


def bounds(geom, depth: int = 2) -> Column:
    """struct(minx, miny, maxx, maxy) of a ring / polygon / multipolygon."""
    v = _vertices(geom, depth)
    xs = F.transform(v, lambda p: p["x"])
    ys = F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def ring_signed_area(ring) -> Column:
    """Shoelace area of a closed ring (positive when counter-clockwise)."""
    r = _c(ring)
    n = F.size(r)

    def step(acc, i):
        a = F.get(r, i)
        b = F.get(r, i + 1)
        return acc + (a["x"] * b["y"] - b["x"] * a["y"])

    s = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), F.lit(0.0), step)
    return F.when(n >= 4, s / F.lit(2.0)).otherwise(F.lit(0.0))


def even_odd_area(poly) -> Column:
    """Largest ring less the others: the area of a polygon whose rings do not
    cross, in whatever order they come (0 where that is negative)."""
    areas = F.transform(_c(poly), lambda r: F.abs(ring_signed_area(r)))
    total = F.aggregate(areas, F.lit(0.0), lambda acc, a: acc + a)
    return F.greatest(F.lit(2.0) * F.coalesce(F.array_max(areas), F.lit(0.0)) - total, F.lit(0.0))


def ring_has_corner(ring) -> Column:
    """Whether the ring's vertices do not all lie on one line through the first."""
    r = _c(ring)
    ox, oy = F.get(r, 0)["x"], F.get(r, 0)["y"]
    idx = F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)))

    def cross(i):
        a, b = F.get(r, i), F.get(r, i + 1)
        return (a["x"] - ox) * (b["y"] - oy) - (b["x"] - ox) * (a["y"] - oy)

    return F.exists(idx, lambda i: F.coalesce(cross(i) != 0, F.lit(False)))


def polygon_area(poly) -> Column:
    """Area under the even-odd rule for rings that do not cross: outer minus holes."""
    return even_odd_area(poly)


def multipolygon_area(mp) -> Column:
    return F.aggregate(F.transform(_c(mp), polygon_area), F.lit(0.0), lambda acc, a: acc + a)


# --- point in polygon (F14) -------------------------------------------------

def ring_crossings_odd(ring, px, py) -> Column:
    """Even-odd ray cast of point (px, py) against one closed ring.

    An edge counts when it straddles the horizontal line through the point
    (half-open in y, so a vertex is counted once) and crosses it right of the
    point.  Horizontal edges never straddle, so the division is never by 0
    (``try_divide`` keeps ANSI mode quiet regardless).
    """
    r, x, y = _c(ring), _c(px), _c(py)
    n = F.size(r)

    def step(acc, i):
        a = F.get(r, i)
        b = F.get(r, i + 1)
        straddle = (a["y"] > y) != (b["y"] > y)
        xcross = F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"]
        return acc != (straddle & (x < xcross))

    return F.when(n >= 4, F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(False), step)) \
        .otherwise(F.lit(False))


def polygon_contains(poly, px, py) -> Column:
    """Point in polygon with holes: odd number of rings around the point."""
    return F.aggregate(_c(poly), F.lit(False),
                       lambda acc, ring: acc != ring_crossings_odd(ring, px, py))


def multipolygon_contains(mp, px, py) -> Column:
    """Point in any part of a multipolygon (OR over parts)."""
    return F.exists(_c(mp), lambda part: polygon_contains(part, px, py))


# --- building polygons ------------------------------------------------------

def ring_of(*xy: tuple[Column, Column]) -> Column:
    """Closed ring from vertex expressions; the first vertex is repeated."""
    pts = list(xy) + [xy[0]]
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in pts])


# --- precomputed edge lists (fast repeated point-in-polygon tests) ---------------
#
# For many tests against the same polygon, its non-horizontal edges are listed
# once as (x1, y1, y2, dx, dy); a test is then one fold over that list.  The
# crossing arithmetic is the same expression as ``ring_crossings_odd``.

def ring_edges(ring) -> Column:
    r = _c(ring)
    n = F.size(r)
    idx = F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))
    edges = F.transform(idx, lambda i: F.struct(
        F.get(r, i)["x"].alias("x1"), F.get(r, i)["y"].alias("y1"), F.get(r, i + 1)["y"].alias("y2"),
        (F.get(r, i + 1)["x"] - F.get(r, i)["x"]).alias("dx"),
        (F.get(r, i + 1)["y"] - F.get(r, i)["y"]).alias("dy")))
    edges = F.filter(edges, lambda e: F.coalesce(e["dy"] != 0, F.lit(False)))
    return F.when(n >= 4, edges).otherwise(F.filter(edges, lambda e: F.lit(False)))


def polygon_edges(poly) -> Column:
    """All rings' edges of a polygon (even-odd over all rings = holes)."""
    return F.flatten(F.transform(_c(poly), ring_edges))


def multipolygon_edges(mp) -> Column:
    """Edges per part: array<array<edge>>."""
    return F.transform(_c(mp), polygon_edges)


def edges_contain(edges, px, py) -> Column:
    """Odd number of edge crossings right of the point."""
    x, y = _c(px), _c(py)

    def step(acc, e):
        straddle = (e["y1"] > y) != (e["y2"] > y)
        return acc != (straddle & (x < (e["dx"] * (y - e["y1"])) / e["dy"] + e["x1"]))

    return F.aggregate(_c(edges), F.lit(False), step)


def parts_contain(parts_edges, px, py) -> Column:
    """OR over the parts of a multipolygon given as edge lists."""
    return F.exists(_c(parts_edges), lambda p: edges_contain(p, px, py))

"""Projections on the ellipsoid (F10, F11, F17 between any two systems).

Transverse Mercator (the UTM zones) by the sixth-order series in the third
flattening, Albers equal-area by its closed form; their inverses end in an
iteration for the latitude, written out a fixed number of times (the last step
is far below 1e-6 m).  A system turns longitude / latitude in degrees into its
coordinates and back, and :func:`reproject` chains one system's inverse with
another's forward, on the columns of a table; :func:`reproject_vertices` does so
inside the vertex arrays of a geometry.  All on one ellipsoid: no datum shift.

A projection is a list of steps, each a formula over the values named before
it, so every value is computed once per row: as a column of its own, or inside
an array as an element bound to a name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import EARTH_RADIUS

Values = dict[str, Column]
Step = tuple[str, Callable[[Values], Column]]
DEG = math.pi / 180.0


def _n(v: float) -> Column:
    return F.lit(float(v))


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2.0 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


# fixed values of the two ellipsoids
GRS80 = Ellipsoid(6378137.0, 1.0 / 298.257222101)
WGS84 = Ellipsoid(6378137.0, 1.0 / 298.257223563)


@dataclass(frozen=True)
class LonLat:
    """Degrees as they are."""

    def forward(self) -> list[Step]:
        return [("x", lambda v: v["lon"]), ("y", lambda v: v["lat"])]

    def inverse(self) -> list[Step]:
        return [("lon", lambda v: v["x"]), ("lat", lambda v: v["y"])]


@dataclass(frozen=True)
class WebMercator:
    """The sphere of ``functions.geo``, the same formulas."""

    def forward(self) -> list[Step]:
        return [("x", lambda v: _n(EARTH_RADIUS) * (v["lon"] * _n(DEG))),
                ("y", lambda v: _n(EARTH_RADIUS) * F.ln(F.tan(_n(math.pi / 4) + (v["lat"] * _n(DEG)) / _n(2.0))))]

    def inverse(self) -> list[Step]:
        return [("lon", lambda v: (v["x"] / _n(EARTH_RADIUS)) / _n(DEG)),
                ("lat", lambda v: (_n(2.0) * F.atan(F.exp(v["y"] / _n(EARTH_RADIUS))) - _n(math.pi / 2)) / _n(DEG))]


# fixed values: coefficients of the sixth-order series, from the power j of the third flattening upwards
FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800), (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
           (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440), (49561 / 161280, -179 / 168, 6601661 / 7257600),
           (34729 / 80640, -3418889 / 1995840), (212378941 / 319334400,))
BACKWARD = ((1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800), (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
            (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720), (4397 / 161280, -11 / 504, -830251 / 7257600),
            (4583 / 161280, -108847 / 3991680), (20648693 / 638668800,))


def series(rows: tuple, n: float) -> tuple[float, ...]:
    return tuple(sum(c * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(rows, 1))


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float
    k0: float = 0.9996
    east: float = 500_000.0
    north: float = 0.0
    ellipsoid: Ellipsoid = GRS80
    lat0: float = 0.0
    #: filled below
    alpha: tuple = field(init=False)
    beta: tuple = field(init=False)
    radius: float = field(init=False)
    north0: float = field(init=False)

    def __post_init__(self):
        n = self.ellipsoid.f / (2.0 - self.ellipsoid.f)
        put = object.__setattr__
        put(self, "alpha", series(FORWARD, n))
        put(self, "beta", series(BACKWARD, n))
        put(self, "radius", self.k0 * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256))
        xi = math.atan(self._conformal(math.tan(self.lat0 * DEG)))       # the meridian's length to lat0
        put(self, "north0", self.north - self.radius * (xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(self.alpha, 1))))

    def _conformal(self, tau: float) -> float:
        e = self.ellipsoid.e
        s = math.sinh(e * math.atanh(e * tau / math.hypot(1.0, tau)))
        return tau * math.hypot(1.0, s) - s * math.hypot(1.0, tau)

    def forward(self) -> list[Step]:
        e = self.ellipsoid.e
        out: list[Step] = [
            ("sin", lambda v: F.sin(v["lat"] * _n(DEG))), ("dl", lambda v: (v["lon"] - _n(self.lon0)) * _n(DEG)),
            ("t", lambda v: F.sinh(F.atanh(v["sin"]) - _n(e) * F.atanh(_n(e) * v["sin"]))), ("c", lambda v: F.cos(v["dl"])),
            ("xi", lambda v: F.atan2(v["t"], v["c"])),
            ("eta", lambda v: F.asinh(F.sin(v["dl"]) / F.sqrt(v["t"] * v["t"] + v["c"] * v["c"])))]

        def summed(first, wave, shape):
            def total(v):
                s = v[first]
                for j, a in enumerate(self.alpha, 1):
                    s = s + _n(a) * wave(_n(2 * j) * v["xi"]) * shape(_n(2 * j) * v["eta"])
                return s
            return total
        return out + [("x", lambda v: _n(self.east) + _n(self.radius) * summed("eta", F.cos, F.sinh)(v)),
                      ("y", lambda v: _n(self.north0) + _n(self.radius) * summed("xi", F.sin, F.cosh)(v))]

    def inverse(self) -> list[Step]:
        e, e2 = self.ellipsoid.e, self.ellipsoid.e2

        def summed(first, wave, shape):
            def total(v):
                s = v[first]
                for j, b in enumerate(self.beta, 1):
                    s = s - _n(b) * wave(_n(2 * j) * v["xi0"]) * shape(_n(2 * j) * v["eta0"])
                return s
            return total
        out: list[Step] = [
            ("xi0", lambda v: (v["y"] - _n(self.north0)) / _n(self.radius)), ("eta0", lambda v: (v["x"] - _n(self.east)) / _n(self.radius)),
            ("xi", summed("xi0", F.sin, F.cosh)), ("eta", summed("eta0", F.cos, F.sinh)),
            ("sh", lambda v: F.sinh(v["eta"])), ("c", lambda v: F.cos(v["xi"])),
            ("goal", lambda v: F.sin(v["xi"]) / F.sqrt(v["sh"] * v["sh"] + v["c"] * v["c"])), ("tau", lambda v: v["goal"])]
        for _ in range(4):                                    # Newton's step for the latitude's tangent
            out += [("w", lambda v: F.sqrt(_n(1.0) + v["tau"] * v["tau"])), ("s", lambda v: F.sinh(_n(e) * F.atanh(_n(e) * v["tau"] / v["w"]))),
                    ("at", lambda v: v["tau"] * F.sqrt(_n(1.0) + v["s"] * v["s"]) - v["s"] * v["w"]),
                    ("tau", lambda v: v["tau"] + (v["goal"] - v["at"]) / F.sqrt(_n(1.0) + v["at"] * v["at"])
                     * (_n(1.0) + _n(1.0 - e2) * v["tau"] * v["tau"]) / (_n(1.0 - e2) * v["w"]))]
        return out + [("lat", lambda v: F.atan(v["tau"]) / _n(DEG)), ("lon", lambda v: _n(self.lon0) + F.atan2(v["sh"], v["c"]) / _n(DEG))]


def utm(zone: int, south: bool = False, ellipsoid: Ellipsoid = GRS80) -> TransverseMercator:
    """UTM zone 1 to 60."""
    return TransverseMercator(6.0 * zone - 183.0, north=10_000_000.0 if south else 0.0, ellipsoid=ellipsoid)


@dataclass(frozen=True)
class Albers:
    """Equal-area conic with two standard parallels."""
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    east: float = 0.0
    north: float = 0.0
    ellipsoid: Ellipsoid = GRS80

    def _q(self, lat: float) -> float:
        e, s = self.ellipsoid.e, math.sin(lat * DEG)
        return (1 - self.ellipsoid.e2) * (s / (1 - self.ellipsoid.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def _cone(self) -> tuple[float, float, float]:
        """(cone constant, C, radius of the origin's parallel)."""
        def m2(lat):
            s = math.sin(lat * DEG)
            return (1 - s * s) / (1 - self.ellipsoid.e2 * s * s)
        n = math.sin(self.lat1 * DEG) if self.lat1 == self.lat2 else \
            (m2(self.lat1) - m2(self.lat2)) / (self._q(self.lat2) - self._q(self.lat1))
        c = m2(self.lat1) + n * self._q(self.lat1)
        return n, c, self.ellipsoid.a * math.sqrt(c - n * self._q(self.lat0)) / n

    def forward(self) -> list[Step]:
        (n, c, rho0), e, e2 = self._cone(), self.ellipsoid.e, self.ellipsoid.e2
        return [("s", lambda v: F.sin(v["lat"] * _n(DEG))),
                ("q", lambda v: _n(1 - e2) * (v["s"] / (_n(1.0) - _n(e2) * v["s"] * v["s"])
                                              - F.ln((_n(1.0) - _n(e) * v["s"]) / (_n(1.0) + _n(e) * v["s"])) / _n(2 * e))),
                ("rho", lambda v: _n(self.ellipsoid.a) * F.sqrt(_n(c) - _n(n) * v["q"]) / _n(n)),
                ("theta", lambda v: _n(n) * (v["lon"] - _n(self.lon0)) * _n(DEG)),
                ("x", lambda v: _n(self.east) + v["rho"] * F.sin(v["theta"])),
                ("y", lambda v: _n(self.north) + _n(rho0) - v["rho"] * F.cos(v["theta"]))]

    def inverse(self) -> list[Step]:
        (n, c, rho0), e, e2, a = self._cone(), self.ellipsoid.e, self.ellipsoid.e2, self.ellipsoid.a
        sign = math.copysign(1.0, n)
        out: list[Step] = [
            ("dx", lambda v: v["x"] - _n(self.east)), ("dy", lambda v: _n(self.north + rho0) - v["y"]),
            ("r2", lambda v: (v["dx"] * v["dx"] + v["dy"] * v["dy"]) * _n(n * n / (a * a))),
            ("q", lambda v: (_n(c) - v["r2"]) / _n(n)), ("phi", lambda v: F.asin(v["q"] / _n(2.0)))]
        for _ in range(6):
            out += [("s", lambda v: F.sin(v["phi"])), ("w", lambda v: _n(1.0) - _n(e2) * v["s"] * v["s"]),
                    ("phi", lambda v: v["phi"] + v["w"] * v["w"] / (_n(2.0) * F.cos(v["phi"])) * (
                        v["q"] / _n(1 - e2) - v["s"] / v["w"] + F.ln((_n(1.0) - _n(e) * v["s"]) / (_n(1.0) + _n(e) * v["s"])) / _n(2 * e)))]
        return out + [("lat", lambda v: v["phi"] / _n(DEG)),
                      ("lon", lambda v: _n(self.lon0) + F.atan2(_n(sign) * v["dx"], _n(sign) * v["dy"]) / _n(n) / _n(DEG))]


#: Contiguous United States, equal area (fixed values of the system).
CONUS_ALBERS = Albers(29.5, 45.5, 23.0, -96.0)


def reproject(df: DataFrame, x: str, y: str, source, target, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """``df`` with columns ``out``: the point (``x``, ``y``) of system ``source``
    in system ``target``.  Each step is one column, computed once per row in
    generated code; a null coordinate gives null."""
    values, columns, d = {"x": x, "y": y}, [], df
    for i, (name, formula) in enumerate(source.inverse() + target.forward()):
        column = f"__p{i}"
        d = d.withColumn(column, formula({k: F.col(c) for k, c in values.items()}))
        values[name] = column
        columns.append(column)
    done = {out[0]: F.col(values["x"]), out[1]: F.col(values["y"])}
    return d.withColumns(done).drop(*columns)


def vertex(v: Column, source, target) -> Column:
    """struct(x, y) of a vertex struct in the other system, inside a lambda: each step binds one value by a one-element array."""
    steps = source.inverse() + target.forward()

    def bind(i: int, values: Values) -> Column:
        if i == len(steps):
            return F.struct(values["x"].alias("x"), values["y"].alias("y"))
        name, formula = steps[i]
        return F.get(F.transform(F.array(formula(values)), lambda e: bind(i + 1, {**values, name: e})), F.lit(0))
    return bind(0, {"x": v["x"], "y": v["y"]})


def reproject_vertices(geometry, source, target, depth: int = 2) -> Column:
    """every vertex of a ring (depth 1), polygon (2) or multipolygon (3) in the other system."""
    g = F.col(geometry) if isinstance(geometry, str) else geometry
    if depth == 0:
        return vertex(g, source, target)
    return F.transform(g, lambda part: reproject_vertices(part, source, target, depth - 1))

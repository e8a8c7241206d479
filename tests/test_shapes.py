"""Projections, exact point location, spread and equalised rasters."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from blockflow.functions import exact, projections as PR
from blockflow.operators import raster as R

CLARKE = PR.Ellipsoid(6378206.4, 1 - math.sqrt(1 - 0.00676866))


def one(spark, lon, lat, target, source=PR.LonLat()):
    d = spark.createDataFrame([(lon, lat)], "a double, b double")
    r = PR.reproject(d, "a", "b", source, target).first()
    return r["x"], r["y"]


def test_published_examples(spark):
    # worked examples of the textbook on map projections (Clarke 1866), to its printed decimals
    x, y = one(spark, -73.5, 40.5, PR.TransverseMercator(-75.0, east=0.0, ellipsoid=CLARKE))
    assert abs(x - 127106.5) < 0.1 and abs(y - 4484124.4) < 0.1
    x, y = one(spark, -75.0, 35.0, PR.Albers(29.5, 45.5, 23.0, -96.0, ellipsoid=CLARKE))
    assert abs(x - 1885472.7) < 0.1 and abs(y - 1535925.0) < 0.1
    assert one(spark, -99.0, 0.0, PR.utm(14)) == (500000.0, 0.0)
    x, y = one(spark, -96.0, 23.0, PR.CONUS_ALBERS)
    assert abs(x) < 1e-6 and abs(y) < 1e-6


def meridian(lat, e=PR.GRS80, steps=20000):
    """Length of the meridian by summing small arcs (midpoints)."""
    h = math.radians(lat) / steps
    return sum(e.a * (1 - e.e2) / (1 - e.e2 * math.sin((i + 0.5) * h) ** 2) ** 1.5 * h for i in range(steps))


def test_meridian_and_scale_of_the_transverse_mercator(spark):
    for lat in (10.0, 45.0, 80.0):
        x, y = one(spark, -99.0, lat, PR.utm(14))
        assert x == 500000.0 and abs(y - 0.9996 * meridian(lat)) < 1e-3
    assert abs(one(spark, -99.0, -30.0, PR.utm(14, south=True))[1] - (1e7 - 0.9996 * meridian(30.0))) < 1e-3


def test_albers_keeps_areas(spark):
    # a small quadrangle's area, on the ellipsoid and on the map
    lon, lat, w, e = -110.0, 47.0, 1e-3, PR.GRS80
    corners = [(lon, lat), (lon + w, lat), (lon + w, lat + w), (lon, lat + w)]
    xy = [one(spark, *c, PR.CONUS_ALBERS) for c in corners]
    xy = [(x - xy[0][0], y - xy[0][1]) for x, y in xy]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(xy, xy[1:] + xy[:1]))) / 2
    s, r = math.sin(math.radians(lat + w / 2)), math.radians(w)
    m = e.a * (1 - e.e2) / (1 - e.e2 * s * s) ** 1.5
    n = e.a / math.sqrt(1 - e.e2 * s * s)
    assert abs(area / (m * r * n * math.sqrt(1 - s * s) * r) - 1) < 1e-7


@pytest.mark.parametrize("system", [PR.utm(14), PR.utm(33, ellipsoid=PR.WGS84), PR.CONUS_ALBERS, PR.WebMercator(), PR.Albers(-18.0, -36.0, 0.0, 132.0),
                                    PR.Albers(40.0, 40.0, 30.0, 10.0), PR.TransverseMercator(9.0, 1.0, 0.0, 0.0, lat0=20.0)])
def test_inverses_to_a_micrometre(spark, system):
    lon0 = getattr(system, "lon0", 0.0)
    rng = random.Random(3)
    rows = [(lon0 + rng.uniform(-25, 25), rng.uniform(-60, 60) if not isinstance(system, PR.Albers) else math.copysign(rng.uniform(5, 60), system.lat1))
            for _ in range(300)] + [(lon0, 0.0), (None, 1.0), (1.0, None)]
    d = PR.reproject(spark.createDataFrame(rows, "lon double, lat double"), "lon", "lat", PR.LonLat(), system)
    d = PR.reproject(PR.reproject(d, "x", "y", system, PR.LonLat(), ("lon2", "lat2")), "lon2", "lat2", PR.LonLat(), system, ("x2", "y2"))
    for r in d.collect():
        if r["lon"] is None or r["lat"] is None:
            assert r["x"] is None or r["y"] is None or r["lon"] is None
            continue
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-9
        assert math.hypot(r["x"] - r["x2"], r["y"] - r["y2"]) < 1e-6


def test_vertices_equal_columns_and_stay_in_generated_code(spark):
    d = spark.createDataFrame([(1, [[{"x": -100.0, "y": 30.0}, {"x": -99.5, "y": 31.0}]])], "id int, g array<array<struct<x:double,y:double>>>")
    got = d.select(F.get(F.get(PR.reproject_vertices("g", PR.LonLat(), PR.utm(14)), 0), 1).alias("v")).first()["v"]
    assert (got["x"], got["y"]) == one(spark, -99.5, 31.0, PR.utm(14))
    plan = PR.reproject(spark.range(9).select(F.col("id").cast("double").alias("a"), F.lit(3.0).alias("b")), "a", "b", PR.LonLat(), PR.utm(31))
    assert "*(1) Project" in plan._jdf.queryExecution().executedPlan().toString()


# --- exact location ---------------------------------------------------------------------

def place(rings, x, y):
    """With fractions: 1 inside, 0 on the border, -1 outside."""
    px, py, odd = Fraction(x), Fraction(y), False
    for r in rings:
        for a, b in zip(r, r[1:]):
            ax, ay, bx, by = (Fraction(v) for v in (*a, *b))
            side = (ax - px) * (by - py) - (ay - py) * (bx - px)
            if side == 0 and min(ax, bx) <= px <= max(ax, bx) and min(ay, by) <= py <= max(ay, by):
                return 0
            if (ay > py) != (by > py) and (side > 0) == (by > ay):
                odd = not odd
    return 1 if odd else -1


def test_location_against_fractions(spark):
    rng, rows = random.Random(8), []
    for i in range(60):
        s = 10.0 ** rng.randrange(-8, 9)
        pts = [(rng.uniform(-s, s), rng.uniform(-s, s)) for _ in range(rng.randrange(3, 8))]
        rings = [[*pts, pts[0]]]
        if i % 3 == 0:
            hole = [(x * 0.25, y * 0.25) for x, y in pts]
            rings.append([*hole, hole[0]])
        near = list(pts)
        for _ in range(25):
            k, t = rng.randrange(len(pts)), rng.random()
            (ax, ay), (bx, by) = rings[0][k], rings[0][k + 1]
            x, y = ax + t * (bx - ax), ay + t * (by - ay)
            near += [(x, y), (math.nextafter(x, math.inf), y), (x, math.nextafter(y, -math.inf)), ((ax + bx) / 2, (ay + by) / 2)]
        near += [(rng.uniform(-s, s), rng.uniform(-s, s)) for _ in range(10)]
        rows += [([[{"x": v[0], "y": v[1]} for v in r] for r in rings], x, y, place(rings, x, y)) for x, y in near]
    d = spark.createDataFrame(rows, "g array<array<struct<x:double,y:double>>>, x double, y double, want int")
    assert {r["want"] for r in d.select("want").distinct().collect()} == {-1, 0, 1}
    assert d.where(exact.locate("g", "x", "y") != F.col("want")).count() == 0
    assert d.where(exact.contains("g", "x", "y") != (F.col("want") == 1)).count() == 0


def test_short_rings_and_nulls(spark):
    d = spark.createDataFrame([([], 0.0, 0.0), ([[{"x": 0.0, "y": 0.0}]], 0.0, 0.0)], "g array<array<struct<x:double,y:double>>>, x double, y double")
    assert [r[0] for r in d.select(exact.locate("g", "x", "y")).collect()] == [-1, -1]


def test_nulls_in_points_and_polygons(spark):
    sq = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))]
    rows = [([sq], 1.0, 1.0, 1), ([sq, None], 4.0, 2.0, 0), ([sq], None, 1.0, -1), ([sq], 1.0, None, -1), ([sq], math.nan, 1.0, -1), ([sq], 5.0, 4.0, -1),
            (None, 1.0, 1.0, None), ([None], 1.0, 1.0, -1), ([], 1.0, 1.0, -1), ([sq, sq], 1.0, 1.0, -1), ([sq, sq], 0.0, 3.0, 0)]
    d = spark.createDataFrame(rows, "g array<array<struct<x:double,y:double>>>, x double, y double, want int").coalesce(1)
    assert [tuple(r) for r in d.select(exact.locate("g", "x", "y"), "want").collect()] == [(r[3], r[3]) for r in rows]
    far = spark.createDataFrame([([sq], -math.inf, 1.0)], "g array<array<struct<x:double,y:double>>>, x double, y double")
    with pytest.raises(Exception, match="NaN"):
        far.select(exact.locate("g", "x", "y")).collect()


def test_location_binds_its_values_once(spark):
    """Its folds are interpreted, so time goes with the expression's size: it was 112,000 characters."""
    d = spark.createDataFrame([], "g array<array<struct<x:double,y:double>>>, x double, y double")
    assert len(d.select(exact.locate("g", "x", "y"))._jdf.queryExecution().analyzed().toString()) < 30_000


def test_many_points_beside_edges(spark):
    """All of 300,000 points within rounding of an edge, some with differences that round."""
    ring = [(-0.1, 0.3), (7.7, 0.1), (3.3, 5.9), (-0.1, 0.3)]
    g = F.array(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ring)))
    t, u = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / F.lit(float(1 << 20)), F.lit(2.0 ** -52) * (F.col("id") % 5 - 2)
    (ax, ay), (bx, by), (cx, cy) = ring[:3]
    x = F.when(F.col("id") % 2 == 0, F.lit(ax) + t * F.lit(bx - ax)).otherwise(F.lit(bx) + t * F.lit(cx - bx))
    y = F.when(F.col("id") % 2 == 0, F.lit(ay) + t * F.lit(by - ay)).otherwise(F.lit(by) + t * F.lit(cy - by))
    d = spark.range(0, 300_000, 1, 4).select("id", g.alias("g"), x.alias("x"), (y + u).alias("y"))
    located = d.select("id", "x", "y", exact.locate("g", "x", "y").alias("place"))
    n = {r["place"]: r["count"] for r in located.groupBy("place").count().collect()}
    assert sum(n.values()) == 300_000 and min(n[1], n[-1]) > 50_000
    for r in located.where("id % 1000 < 2").collect():
        assert r["place"] == place([ring], r["x"], r["y"])


# --- rasters ------------------------------------------------------------------------------

W, H = 40, 30


def cells(spark, n=120, seed=2, top=9):
    rng = random.Random(seed)
    found = {(rng.randrange(W), rng.randrange(H)): rng.randrange(1, top) for _ in range(n)}
    return found, spark.createDataFrame([(x, y, v) for (x, y), v in found.items()], "px int, py int, value long")


def as_dict(df):
    return {(r["px"], r["py"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("how", ["add", "max"])
def test_spread_against_plain_python(spark, radius, how):
    found, r = cells(spark)
    want = {}
    for (x, y), v in found.items():
        for i, j in R.disc(radius):
            at = (x + i, y + j)
            if 0 <= at[0] < W and 0 <= at[1] < H:
                want[at] = want.get(at, 0) + v if how == "add" else max(want.get(at, 0), v)
    assert as_dict(R.spread(r, radius, W, H, how)) == want
    assert len(R.disc(1)) == 9 and len(R.disc(2)) == 21


@pytest.mark.parametrize("n", [2, 25, 60, 400])
def test_dynamic_radius(spark, n):
    found, r = cells(spark, n, seed=n)

    def share(k):
        return sum(any((x + i, y + j) in found for i in range(-k, k + 1) for j in range(-k, k + 1) if i or j) for x, y in found) / len(found)
    radius = 0
    while radius < 3 and share(2 * (radius + 1)) <= 0.5:
        radius += 1
    got, picked = R.dynamic_spread(r, W, H, 0.5)
    assert picked == radius and as_dict(got) == as_dict(R.spread(r, radius, W, H))
    assert R.density(r, 4) == pytest.approx(share(4))
    assert R.dynamic_spread(r.where("false"), W, H)[0].count() == 0


def test_equalized_ranks(spark):
    _, r = cells(spark, 500, top=30)
    r = r.unionByName(spark.createDataFrame([(99, 0, None)], r.schema))
    values = sorted(x["value"] for x in r.collect() if x["value"] is not None)
    first = values.count(values[0])
    for x in R.raster_equalized(r, 5).collect():
        if x["value"] is None:
            assert x["t"] is None and x["bin"] is None
        else:
            t = (sum(v <= x["value"] for v in values) - first) / (len(values) - first)
            assert x["t"] == pytest.approx(t) and x["bin"] == min(int(t * 5), 4)
    flat = R.raster_equalized(r.where("value is not null").withColumn("value", F.lit(3)))
    assert {(x["t"], x["bin"]) for x in flat.collect()} == {(0.0, 0)}
    assert R.raster_equalized(r.where("false")).count() == 0

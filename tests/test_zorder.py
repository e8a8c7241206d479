"""The Z-order join against the grid join and against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from blockflow.operators import spatial, zorder
from blockflow.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
POLY = "poly long, geometry array<array<struct<x:double,y:double>>>, name string"


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in [*xy, xy[0]]]


def polygons():
    rng = random.Random(4)
    out = []
    for i in range(60):                                     # triangles of very different sizes, many overlapping
        x, y, w = rng.uniform(-120, -70), rng.uniform(25, 48), 10 ** rng.uniform(-4, 1.2)
        out.append((i, [ring((x, y), (x + w, y + w / 7), (x + w / 3, y + w))], f"n{i}"))
    out.append((100, [ring((-110, 30), (-90, 30), (-90, 45), (-110, 45)), ring((-105, 33), (-95, 33), (-95, 42), (-105, 42))], "with a hole"))
    out.append((101, None, "without geometry"))
    return out


def inside(polygon, x, y):
    odd = False
    for r in polygon:
        for a, b in zip(r, r[1:]):
            if (a["y"] > y) != (b["y"] > y) and x < ((b["x"] - a["x"]) * (y - a["y"])) / (b["y"] - a["y"]) + a["x"]:
                odd = not odd
    return odd


@pytest.fixture(scope="module")
def pts(spark):
    rng = random.Random(9)
    rows = [(i, rng.uniform(-121, -68), rng.uniform(24, 50)) for i in range(4000)]
    rows += [(5000 + i, -100.0, 37.0) for i in range(500)]               # one crowded place
    rows += [(6000, None, 3.0), (6001, 3.0, None), (6002, 1e9, 0.0), (6003, float("nan"), 1.0)]
    return spark.createDataFrame(rows, "pid long, lon double, lat double")


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("limit", [0, 256 << 20])
def test_zorder_against_plain_python(spark, pts, stored, limit):
    polys = spark.createDataFrame(polygons(), POLY)
    p = zorder.store(pts) if stored else pts
    got = zorder.spatial_join_zorder(p, polys, "poly", z="z" if stored else None, per_side=8, max_broadcast_bytes=limit)
    assert got.columns == ["pid", "lon", "lat", "poly", "name"] or set(got.columns) == {"pid", "lon", "lat", "poly", "name"}
    want = [(r["pid"], i) for r in pts.collect() if r["lon"] is not None and r["lat"] is not None
            for i, g, _ in polygons() if g and inside(g, r["lon"], r["lat"])]
    assert sorted((r["pid"], r["poly"]) for r in got.collect()) == sorted(want) and len(want) > 1000


def test_zorder_equals_grid_join_on_a_coarse_grid(spark):
    p = fx.points(spark, SF).select("county", "lon", "lat")
    polys = fx.mixed_boxes(spark, SF)
    grid = zorder.Grid(0.25, (-256.0, -256.0), bits=12)                  # polygons far smaller than a cell
    a = zorder.spatial_join_zorder(p, polys, "poly", grid=grid).select("county", "lon", "lat", "poly")
    b = spatial.spatial_join(p, polys, "poly", "lon", "lat").select("county", "lon", "lat", "poly")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_polygons_and_no_points(spark, pts):
    none = spark.createDataFrame([], POLY)
    assert zorder.spatial_join_zorder(pts, none, "poly").count() == 0
    polys = spark.createDataFrame(polygons(), POLY)
    assert zorder.spatial_join_zorder(pts.where("false"), polys, "poly").count() == 0


def test_files_outside_the_polygons_are_skipped(spark, pts):
    stored = zorder.store(pts)
    one = spark.createDataFrame([(1, [ring((-119, 26), (-118, 26), (-118, 27))], "small")], POLY)
    cells = zorder.quadtree_cells(spatial.with_level(one.select("poly", "geometry")), "poly", zorder.LONLAT)
    ranges = zorder.coverage(cells, zorder.LONLAT)
    assert len(ranges) <= zorder.RANGES
    near = stored.where(" or ".join(f"z between {a} and {b}" for a, b in ranges))
    assert near.count() < stored.count() / 10
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan or "PushedFilters: [IsNotNull(z), GreaterThanOrEqual(z" in plan, plan


def test_clashing_names_and_repeated_keys_raise(spark, pts):
    polys = spark.createDataFrame(polygons(), POLY)
    for join in (zorder.spatial_join_zorder, lambda p, q, k: spatial.spatial_join(p, q, k, "lon", "lat")):
        with pytest.raises(ValueError, match="both have"):
            join(pts.withColumn("Name", F.lit(1)), polys, "poly")
        with pytest.raises(ValueError, match="once"):
            join(pts, polys.union(polys), "poly")
    with pytest.raises(ValueError):
        zorder.Grid(0.3, (0.0, 0.0))


def test_polygon_outside_the_grid_raises(spark, pts):
    far = spark.createDataFrame([(1, [ring((400, 0), (401, 0), (401, 1))], "far")], POLY)
    with pytest.raises(Exception, match="outside the grid"):
        zorder.spatial_join_zorder(pts, far, "poly").count()


@pytest.mark.parametrize("limit", [0, 256 << 20])
def test_attributes_by_either_join(spark, pts, limit):
    polys = spark.createDataFrame(polygons(), POLY)
    got = spatial.spatial_join(pts, polys, "poly", "lon", "lat", max_broadcast_bytes=limit)
    names = {i: n for i, _, n in polygons()}
    rows = got.collect()
    assert rows and all(r["name"] == names[r["poly"]] for r in rows)

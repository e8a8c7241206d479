"""Answers from stored aggregates against the direct computation."""

import random

import pytest
from pyspark.sql import functions as F

from blockflow.operators import pyramid as PY, raster as R
from blockflow.plans import crossfilter as X, cube as CU, fixtures as fx

SF = "/root/testdata/sf0.001"
KEYS = ["grp", "county", "race"]


def bars(df):
    return sorted((r["grp"], r["county"] or -1, -1 if r["race"] is None else r["race"], r["cnt"], r["n_rows"],
                   None if r["mean_race"] is None else round(r["mean_race"], 9), None if r["mean_net"] is None else round(r["mean_net"], 9))
                  for r in df.collect())


@pytest.fixture(scope="module")
def pts(spark):
    return fx.points_with_nulls(spark, SF)


@pytest.fixture(scope="module")
def cube(pts):
    return CU.build(pts)


def boxes():
    rng = random.Random(5)
    c = CU.CELL
    out = [(-11 * 1e6, -10 * 1e6, 3 * 1e6, 6 * 1e6), (-50 * c, -30 * c, 10 * c, 25 * c),       # edges on tile edges
           (-40 * c + 1, -40 * c + 2, 0, 40 * c), (0.0, 1.0, 0.0, 1.0), (-2e7, 2e7, -2e7, 2e7)]
    return out + [tuple(rng.uniform(*r) for r in [(-14e6, -7e6)] * 2 + [(2.5e6, 6.6e6)] * 2) for _ in range(4)]


@pytest.mark.parametrize("box", boxes())
@pytest.mark.parametrize("view", ["total", "out"])
def test_cube_equals_scan(spark, pts, cube, box, view):
    got = CU.crossfilter_cube(spark, cube, view, box=box)
    assert bars(got) == bars(X.crossfilter_all(pts, view, box=box))


def test_cube_with_selections_and_without_a_box(spark, pts, cube):
    sel = {"race": [1, 2], "county_top": list(range(8))}
    assert bars(CU.crossfilter_cube(spark, cube, "net", selections=sel)) == bars(X.crossfilter_all(pts, "net", selections=sel))
    assert bars(CU.crossfilter_cube(spark, cube, "net")) == bars(X.crossfilter_all(pts, "net"))


def test_cube_reads_only_border_tiles(spark, cube):
    c = cube.cell
    box = (-45 * c + 5, -33 * c - 5, 11 * c + 5, 22 * c - 5)
    (mx0, mx1, my0, my1), (wx0, wx1, wy0, wy1) = CU._tiles_of(box, c)
    rows = CU.weighted(spark, cube, "net", box)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" in plan        # tile directories, and the cube's file
    cut = spark.read.parquet(cube.points).where(
        F.col("tx").between(mx0, mx1) & F.col("ty").between(my0, my1) & ~(F.col("tx").between(wx0, wx1) & F.col("ty").between(wy0, wy1)))
    files = cut.select(F.input_file_name().alias("f")).distinct().collect()
    every = spark.read.parquet(cube.points).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < len(files) < every / 2


def test_cube_of_no_points(spark, pts):
    none = CU.build(pts.where("false"))
    assert CU.crossfilter_cube(spark, none, "net", box=(-1e7, 1e7, -1e7, 1e7)).count() == 0
    with pytest.raises(ValueError):
        CU.build(pts, cell=3.0)


@pytest.fixture(scope="module")
def pyramid(pts):
    return PY.build(pts, levels=13)


def cells(df):
    return sorted((r["px"], r["py"], round(float(r["value"]), 9)) for r in df.collect() if r["value"] is not None)


@pytest.mark.parametrize("width,height", [(3840, 2160), (300, 200), (7, 3), (1, 1)])
@pytest.mark.parametrize("view,agg", [("total", "count"), ("net", "mean_net"), ("race", "mean_race")])
def test_pyramid_equals_raster(spark, pts, pyramid, width, height, view, agg):
    window = (-13.1e6, -8.2e6, 3.1e6, 5.9e6)
    got, snapped = PY.raster(spark, pyramid, window, width, height, view, agg)
    z, _, w, h = PY.fitting(pyramid, window, width, height)
    assert snapped[0] <= window[0] and snapped[1] >= window[1] and (w >= width or z == pyramid.levels)
    kind, col = {"count": ("count", "net"), "mean_net": ("mean", "net"), "mean_race": ("mean", "race")}[agg]
    assert cells(got) == cells(R.raster(X.filtered(pts, view), snapped, w, h, kind, col))


def test_pyramid_levels_agree_and_shrink(spark, pts, pyramid):
    totals = {z: spark.read.parquet(pyramid.level_path(z)).agg(F.sum("n"), F.count("*")).first() for z in range(pyramid.levels + 1)}
    n = pts.where("easting is not null").count()
    assert all(t[0] == n for t in totals.values())
    sizes = [totals[z][1] for z in sorted(totals)]
    assert sizes == sorted(sizes) and sizes[0] <= 3


def test_pyramid_outside_and_empty(spark, pts, pyramid):
    assert PY.raster(spark, pyramid, (1e6, 2e6, -2e6, -1e6), 10, 10)[0].count() == 0
    assert PY.raster(spark, PY.build(pts.where("false"), levels=3), (-1e7, 1e7, -1e7, 1e7), 10, 10)[0].count() == 0

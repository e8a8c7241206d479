"""Queries answered from stored aggregates and layouts: the cross-filter cube
(C3), the tile pyramid (A11, A12), and others that read what a job stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import queries_core as Q, queries_geo as G, queries_prep as QP
from .catalog import query
from .operators import pyramid as PY, zorder
from .plans import cube as CU, fixtures as fx, stages
from .plans import fixtures_sql as S
from .plans.fixtures_sql import d
from .session import scratch_path
from .sources import files, incremental, shapefile, sinks

# --- C3 from the cube -----------------------------------------------------------

_BARS = f"""select 'county' as grp, county, {Q._NI} as race, {Q._NI} as px, {Q._NI} as py, {Q._M} from f group by county
union all select 'race', {Q._NB}, race, {Q._NI}, {Q._NI}, {Q._M} from f group by race
union all select 'total', {Q._NB}, {Q._NI}, {Q._NI}, {Q._NI}, {Q._M} from f"""


@query("crossfilter_cube", Q.P(f", f as (select county, race, net from points where net in (0, 1) and {Q.box_sql()}) {_BARS}"))
def crossfilter_cube(spark, sf):
    """Bars and total of a box from the stored cube, points read only in the tiles the box's edge cuts."""
    return CU.crossfilter_cube(spark, CU.build(fx.points(spark, sf)), "total", box=Q.BOX)


@query("crossfilter_cube_selected", Q.P(f""", f as (select county, race, net from points where race in ({', '.join(map(str, Q.SEL_RACES))})
  and county in ({', '.join(map(str, Q.SEL_COUNTIES))})) {_BARS}"""))
def crossfilter_cube_selected(spark, sf):
    """Race and county selections without a box: the cube alone answers."""
    sel = {"race": Q.SEL_RACES, "county_top": Q.SEL_COUNTIES}
    return CU.crossfilter_cube(spark, CU.build(fx.points(spark, sf)), "net", selections=sel)


# --- A11 / A12 from the pyramid ---------------------------------------------------

_LEVELS = 14
_SHAPE = PY.Pyramid("", _LEVELS)


def _pyramid_sql(where: str, agg: str, window, width: int, height: int) -> str:
    _, (x0, x1, y0, y1), w, h = PY.fitting(_SHAPE, window, width, height)
    inside = f"easting between {d(x0)} and {d(x1)} and northing between {d(y0)} and {d(y1)}"
    return Q.P(f"""select px, py, {agg} as value from (select {Q.cell_sql('easting', x0, x1, w)} as px,
      {Q.cell_sql('northing', y0, y1, h)} as py, net, race from points where {where} and {inside}) c group by px, py""")


def _pyramid(spark, sf):
    return PY.build(fx.points(spark, sf), levels=_LEVELS)


@query("raster_pyramid", _pyramid_sql("true", "count(net)", Q.VIEWPORT, Q.SMALL_W, Q.SMALL_H))
def raster_pyramid(spark, sf):
    """Count raster of the whole map from the fitting zoom of the stored pyramid."""
    return PY.raster(spark, _pyramid(spark, sf), Q.VIEWPORT, Q.SMALL_W, Q.SMALL_H, "net")[0]


@query("raster_pyramid_mean", _pyramid_sql("net in (0, 1)", "avg(cast(race as double))", Q.BOX, 100, 100))
def raster_pyramid_mean(spark, sf):
    """Mean race of a map window ("race" view), merged from stored sums and counts."""
    return PY.raster(spark, _pyramid(spark, sf), Q.BOX, 100, 100, "race", "mean_race")[0]


# --- J8 / J9 over the Z-order -------------------------------------------------------

_PROW = "county, net, race, lon, lat"
_PCOLS = ", ".join("p." + c for c in _PROW.split(", "))


@query("spatial_join_zorder", f"""with {G.PTS_ID}, {G._pip_sql(S.NATION_EDGES, 'e.State_Code, e.State_Name')}
select {_PCOLS}, h.State_Code, h.State_Name from hits h join pts p on p.pid = h.pid""")
def spatial_join_zorder(spark, sf):
    """Points stored in Z-order joined with the state polygons' intervals, one row per point on the way."""
    pts = zorder.store(fx.points(spark, sf).select(*_PROW.split(", ")))
    return zorder.spatial_join_zorder(pts, fx.state_polygon(spark, sf), "State_Code", z="z")


@query("spatial_join_zorder_mixed", f"""with {G.PTS_ID}, boxes as ({G._MIXED})
select p.county, p.lon, p.lat, b.pid as poly from pts p join boxes b
  on p.lon >= b.x0 and p.lon < b.x1 and p.lat >= b.y0 and p.lat < b.y1""")
def spatial_join_zorder_mixed(spark, sf):
    """Overlapping polygons of very different sizes, all met through the one key of a point."""
    pts = fx.points(spark, sf).select("county", "lon", "lat")
    return zorder.spatial_join_zorder(pts, fx.mixed_boxes(spark, sf), "poly")


@query("spatial_multipolygon_zorder", f"""with {G.PTS_ID}, {G._pip_sql(S.NATION_EDGES, 'e.region, e.State_Code')},
regions as (select distinct pid, region from hits)
select {_PCOLS}, r.region from regions r join pts p on p.pid = r.pid""")
def spatial_multipolygon_zorder(spark, sf):
    """Region multipolygons through the Z-order."""
    pts = zorder.store(fx.points(spark, sf).select(*_PROW.split(", ")))
    return zorder.spatial_join_zorder(pts, fx.region_multipolygon(spark, sf), "region", depth=3, z="z")


# --- A4 / A7 from file footers --------------------------------------------------------

@query("data_bounds_stored", Q.P("""select count(*) as n_rows, round(min(easting), 4) as xmin, round(max(easting), 4) as xmax,
  round(min(northing), 4) as ymin, round(max(northing), 4) as ymax from points"""))
def data_bounds_stored(spark, sf):
    """Row count and extent of stored points from the file footers, no row read."""
    path = sinks.write_parquet(fx.points(spark, sf), scratch_path(spark, "stored_points"))
    r = files.stored_stats(spark, path, ["easting", "northing"])
    row = (r["n_rows"], r["min_easting"], r["max_easting"], r["min_northing"], r["max_northing"])
    out = spark.createDataFrame([row], "n_rows long, xmin double, xmax double, ymin double, ymax double")      # one row
    return out.select("n_rows", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


# --- block tables bucketed, stages resumed, files taken once -------------------------------

@query("join_bucketed", QP.PREP + f"""select m.ID20, m.P20, m.eq_P10, r.P_delta, {', '.join(f'b.R20{k}' for k in QP.RK)}
  from mig m join b20 b on b.ID20 = m.ID20 left join rmig2 r on r.ID20 = m.ID20""")
def join_bucketed(spark, sf):
    """Three block tables bucketed by ID20, joined bucket by bucket."""
    base = scratch_path(spark, "bucketed")
    paths = stages.build_datasets(fx.block10(spark, sf), fx.block20(spark, sf), fx.crosswalk(spark, sf), fx.block_polygon(spark, sf),
                                  fx.dim_state(spark, sf), base, stop_after="race_migration")
    return joined_block_tables(spark, base, paths)


def joined_block_tables(spark, base, paths):
    t = stages.block_tables(spark, base, paths)
    races = t["mapped_blocks"].select("ID20", *[f"R20{k}" for k in QP.RK]).hint("merge")
    delta = t["race_migration"].select("ID20", "P_delta").hint("merge")
    return t["total_attr"].select("ID20", "P20", "eq_P10").join(races, "ID20").join(delta, "ID20", "left")


@query("stages_resumed", QP._RPREP + QP._PERMUTED + QP._g2_sql(
    QP._NET_ROWS, "r.ID20 as blockid, r.k, f.x, f.y, r.race, r.STATE as state, r.COUNTY as county, "
                  "r.P_delta as block_diff, cast(sign(r.P_delta) as integer) as block_net"))
def stages_resumed(spark, sf):
    """K4: the preparation stopped after the migration tables, then gone on from them."""
    inputs = (fx.block10(spark, sf), fx.block20(spark, sf), fx.crosswalk(spark, sf), fx.block_polygon(spark, sf), fx.dim_state(spark, sf))
    base = scratch_path(spark, "stages")
    stages.build_datasets(*inputs, base, stop_after="race_migration")
    return spark.read.parquet(stages.build_datasets(*inputs, base, resume=True)["net_migration"])


@query("sink_available_now", f"select county, state, net, race, lon, lat from ({S.POINTS}) p")
def sink_available_now(spark, sf):
    """Three runs of an incremental load, new files before the first and the third; each row once."""
    pts = fx.points(spark, sf).select("county", "state", "net", "race", "lon", "lat")
    base = scratch_path(spark, "incremental")
    for new in ("state < 9", None, "state >= 9"):
        if new:
            pts.where(new).write.mode("append").parquet(f"{base}/in")
        incremental.load_new_files(spark, f"{base}/in", pts.schema, f"{base}/out", f"{base}/checkpoint", partition_by=["state"])
    return incremental.loaded(spark, f"{base}/out", pts.schema).select(*pts.columns)


# --- S8 from shapefiles ------------------------------------------------------------------

_SHAPES = f"""select GEOID20, cast(count(distinct part) as integer) as parts, cast(count(*) as integer) as vertices, min(x) as xmin, max(x) as xmax
from ({S.MULTI_VERTICES}) v group by GEOID20"""


def _shapefile(spark, sf):
    shapefile.register(spark)
    path = scratch_path(spark, "shapes")
    fx.block_multipolygon(spark, sf).repartition(3, "GEOID20").write.format("shapefile").mode("append").save(path)
    return spark.read.format("shapefile").option("records", 32).load(path)


@query("scan_shapefile", _SHAPES)
def scan_shapefile(spark, sf):
    """Block multipolygons written as shapefiles and read back by record ranges."""
    return _shapefile(spark, sf).select("GEOID20", F.size("geometry").alias("parts"), F.size(F.flatten(F.flatten("geometry"))).alias("vertices"),
                                        "xmin", "xmax")


@query("scan_shapefile_box", f"select * from ({_SHAPES}) s where xmax >= {d(-100.0)} and xmin <= {d(-90.0)} and GEOID20 > 20")
def scan_shapefile_box(spark, sf):
    """Id and box filters pushed into the table rows and record headers."""
    s = _shapefile(spark, sf).where((F.col("xmax") >= -100.0) & (F.col("xmin") <= -90.0) & (F.col("GEOID20") > 20))
    return s.select("GEOID20", F.size("geometry").alias("parts"), F.size(F.flatten(F.flatten("geometry"))).alias("vertices"), "xmin", "xmax")

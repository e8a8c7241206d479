"""Geometry queries: spatial joins (J8-J10), polygon functions (F13-F17),
multipolygon handling (P13, P17) and geometry-dependent filters (P15).

Oracles are brute force: every point against every polygon edge, crossing
counts per (point, polygon), odd = inside.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import geo
from .operators import spatial
from .plans import datasets as DS, fixtures as fx
from .plans import fixtures_sql as S

_PROW = "county, net, race, lon, lat"
PTS_ID = f"pts as (select row_number() over () as pid, * from ({S.POINTS}) p)"


def _pip_sql(edges: str, poly_cols: str, extra_where: str = "") -> str:
    """Point rows x polygon edges -> (pid, polygon) pairs with an odd crossing count."""
    return f"""hits as (select p.pid, {poly_cols} from pts p join ({edges}) e on true {extra_where}
      group by p.pid, {poly_cols} having sum({S.crossing('p.lon', 'p.lat')}) % 2 = 1)"""


@query("spatial_join_polygon", f"""with {PTS_ID}, {_pip_sql(S.NATION_EDGES, 'e.State_Code')}
select {', '.join('p.' + c for c in _PROW.split(', '))}, h.State_Code as state from hits h join pts p on p.pid = h.pid""")
def spatial_join_polygon(spark, sf):
    """Every point tagged with each state polygon containing it (grid-cell equi-join)."""
    pts = fx.points(spark, sf).select(*_PROW.split(", "))
    return DS.split_by_state(pts, fx.state_polygon(spark, sf))


@query("spatial_count", f"""with {PTS_ID}, {_pip_sql(S.NATION_EDGES, 'e.State_Code')}
select State_Code as state, count(*) as points from hits group by State_Code""")
def spatial_count(spark, sf):
    """Points per state after the spatial join."""
    pts = fx.points(spark, sf).select(*_PROW.split(", "))
    return spatial.count_per_polygon(DS.split_by_state(pts, fx.state_polygon(spark, sf)), "state")


@query("spatial_multipolygon", f"""with {PTS_ID}, {_pip_sql(S.NATION_EDGES, 'e.region, e.State_Code')},
regions as (select distinct pid, region from hits)
select {', '.join('p.' + c for c in _PROW.split(', '))}, r.region from regions r join pts p on p.pid = r.pid""")
def spatial_multipolygon(spark, sf):
    """Points in region multipolygons (OR over the parts, even-odd per part)."""
    pts = fx.points(spark, sf).select(*_PROW.split(", "))
    regions = fx.region_multipolygon(spark, sf)
    return spatial.spatial_join(pts, regions, "region", "lon", "lat", "geometry", depth=3)


@query("polygon_bounds", f"""select GEOID20, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy
from ({S.MULTI_VERTICES}) v group by GEOID20""")
def polygon_bounds(spark, sf):
    """bounding box of each block multipolygon."""
    p = fx.block_multipolygon(spark, sf)
    b = geo.bounds("geometry", depth=3)
    return p.select("GEOID20", b["minx"].alias("minx"), b["miny"].alias("miny"),
                    b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


@query("pip_scalar", f"""with {PTS_ID},
hits as (select p.pid, sum({S.crossing('p.lon', 'p.lat')}) % 2 = 1 as inside
  from pts p join ({S.BLOCK_EDGES}) e on e.GEOID20 = p.county group by p.pid)
select p.county, p.lon, p.lat, h.inside from hits h join pts p on p.pid = h.pid""")
def pip_scalar(spark, sf):
    """is each point inside the triangle of its own block (equi-join on the id)?"""
    pts = fx.points(spark, sf).select("county", "lon", "lat")
    poly = fx.block_polygon(spark, sf)
    j = pts.join(poly, pts.county == poly.GEOID20)
    return j.select("county", "lon", "lat", geo.polygon_contains("geometry", "lon", "lat").alias("inside"))


@query("explode_parts", f"""select GEOID20, part, cast(count(*) as integer) as n_vertices, min(x) as minx
from ({S.MULTI_VERTICES}) v group by GEOID20, part""")
def explode_parts(spark, sf):
    """multipolygon -> one row per part."""
    r = fx.block_multipolygon(spark, sf)
    parts = r.select("GEOID20", F.posexplode("geometry").alias("part", "poly"))
    b = geo.bounds("poly")
    return parts.select("GEOID20", "part", F.size(F.flatten("poly")).alias("n_vertices"), b["minx"].alias("minx"))


@query("filter_multipolygon", f"""select GEOID20, cast(count(distinct part) as integer) as n_parts
from ({S.MULTI_VERTICES}) v group by GEOID20 having count(distinct part) > 1""")
def filter_multipolygon(spark, sf):
    """Keep multipolygons (more than one part)."""
    r = fx.block_multipolygon(spark, sf)
    return r.where(F.size("geometry") > 1).select("GEOID20", F.size("geometry").alias("n_parts"))


_TRI_VERTS = f"""
select GEOID20, 0 as pos, cx - {S.d(1)} as x, cy - {S.d(0.8)} as y from ({S.BLOCK_TRIANGLES}) t union all
select GEOID20, 1, cx + {S.d(1)}, cy - {S.d(0.8)} from ({S.BLOCK_TRIANGLES}) t union all
select GEOID20, 2, cx, cy + {S.d(0.8)} from ({S.BLOCK_TRIANGLES}) t union all
select GEOID20, 3, cx - {S.d(1)}, cy - {S.d(0.8)} from ({S.BLOCK_TRIANGLES}) t"""


@query("arrays_zip_xy", f"select GEOID20, cast(pos as integer) as pos, x, y from ({_TRI_VERTS}) v")
def arrays_zip_xy(spark, sf):
    """x[] and y[] of each outer ring zipped into (x, y) pairs."""
    p = fx.block_polygon(spark, sf)
    ring = F.get(F.col("geometry"), 0)
    xs = F.transform(ring, lambda v: v["x"])
    ys = F.transform(ring, lambda v: v["y"])
    z = p.select("GEOID20", F.posexplode(F.arrays_zip(xs.alias("x"), ys.alias("y"))).alias("pos", "xy"))
    return z.select("GEOID20", "pos", F.col("xy.x").alias("x"), F.col("xy.y").alias("y"))


@query("polygon_to_mercator", f"""select GEOID20, part, cast(pos as integer) as pos, round({S.mercator_x('x')}, 3) as x,
  round({S.mercator_y('y')}, 3) as y from ({S.MULTI_VERTICES}) v""")
def polygon_to_mercator(spark, sf):
    """every block polygon vertex reprojected to Web-Mercator."""
    p = fx.block_multipolygon(spark, sf).select("GEOID20", geo.multipolygon_to_mercator("geometry").alias("g"))
    parts = p.select("GEOID20", F.posexplode("g").alias("part", "poly"))
    v = parts.select("GEOID20", "part", F.posexplode(F.get(F.col("poly"), 0)).alias("pos", "xy"))
    return v.select("GEOID20", "part", "pos", F.round("xy.x", 3).alias("x"), F.round("xy.y", 3).alias("y"))


@query("blocks_with_geometry", f"""with g as (select l_suppkey as ID20, count(*) as points from lineitem group by l_suppkey)
select g.ID20, g.points from g join ({S.BLOCK_TRIANGLES}) t on t.GEOID20 = g.ID20
where g.ID20 % 5 <> 0 and g.ID20 % 7 <> 0""")
def blocks_with_geometry(spark, sf):
    """Blocks that have a polygon (some have none, some a null geometry)."""
    g = fx.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("ID20")).agg(F.count(F.lit(1)).alias("points"))
    p = fx.block_polygon(spark, sf).where(F.col("GEOID20") % 5 != 0)
    p = p.withColumn("geometry", F.when(F.col("GEOID20") % 7 != 0, F.col("geometry"))).where(F.col("geometry").isNotNull())
    return g.join(p, g.ID20 == p.GEOID20).select("ID20", "points")


_MIXED = f"""select cast(0 as bigint) as pid, {S.d(-124)} as x0, {S.d(-70)} as x1, {S.d(25)} as y0, {S.d(48)} as y1
union all select 1, {S.d(-124)}, {S.d(-68)}, {S.d(33.3)}, {S.d(33.3)} + {S.d(1e-3)}
union all select s_suppkey + 10, {S.d(-124)} + {S.d(0.05)} * (s_suppkey % 1000), {S.d(-124)} + {S.d(0.05)} * (s_suppkey % 1000) + {S.d(0.04)},
  {S.d(26)} + {S.d(0.02)} * (s_suppkey % 997), {S.d(26)} + {S.d(0.02)} * (s_suppkey % 997) + {S.d(0.3)} from supplier"""


@query("spatial_join_mixed_sizes", f"""with {PTS_ID}, boxes as ({_MIXED})
select p.county, p.lon, p.lat, b.pid as poly from pts p join boxes b
  on p.lon >= b.x0 and p.lon < b.x1 and p.lat >= b.y0 and p.lat < b.y1""")
def spatial_join_mixed_sizes(spark, sf):
    """One large, one very thin and many small polygons in one join, each on the grid level of its own size."""
    pts = fx.points(spark, sf).select("county", "lon", "lat")
    return spatial.spatial_join(pts, fx.mixed_boxes(spark, sf), "poly", "lon", "lat")


@query("points_in_polygon_odd_rings", f"""select s_suppkey as id, n.k, true as inside from supplier s,
  generate_series(1, 20) n(k) union all select s_suppkey + 1000000, n.k, true from supplier s, generate_series(1, 20) n(k)""")
def points_in_polygon_odd_rings(spark, sf):
    """Bow-ties (rings crossing themselves) and polygons whose hole comes
    first; every individual lies inside by the even-odd rule."""
    polys = fx.odd_polygons(spark, sf)
    p = spatial.sampling_params(polys).withColumn("n", F.lit(20))
    e = spatial.individuals_in_polygon(p, "n", key="id")
    j = e.join(polys, "id")
    return j.select("id", "k", geo.polygon_contains("geometry", "x", "y").alias("inside"))

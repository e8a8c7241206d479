"""Queries on projections of the ellipsoid (F10, F11, F17), exact point location
(F14), spread or equalised rasters (A14), and points drawn by area (G2)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from . import queries_core as Q, queries_prep as QP
from .catalog import query
from .functions import exact, projections as PR
from .operators import by_area, raster as R
from .plans import crossfilter as X, fixtures as fx, migration as MG
from .plans import fixtures_sql as S
from .plans.fixtures_sql import d

# --- projections: the oracle writes the formulas out again, as SQL ------------------------

_E2 = PR.GRS80.f * (2 - PR.GRS80.f)
_E = math.sqrt(_E2)


def _q_sql(s: str) -> str:
    return f"({d(1 - _E2)} * ({s} / (1 - {d(_E2)} * {s} * {s}) - ln((1 - {d(_E)} * {s}) / (1 + {d(_E)} * {s})) / {d(2 * _E)}))"


def _albers_sql(rows: str, keep: str, lon: str = "lon", lat: str = "lat", lat1=29.5, lat2=45.5, lat0=23.0, lon0=-96.0) -> str:
    """``keep``, x, y of ``rows`` in the equal-area conic."""
    a = PR.GRS80.a
    return f"""select {keep}, rho * sin(theta) as x, rho0 - rho * cos(theta) as y from (
      select *, {d(a)} * sqrt(c - n * {_q_sql('sp')}) / n as rho, {d(a)} * sqrt(c - n * q0) / n as rho0, n * radians({lon} - {d(lon0)}) as theta from (
        select *, m1 + n * q1 as c from (
          select *, (m1 - m2) / (q2 - q1) as n from (
            select *, sin(radians({lat})) as sp, {_q_sql('s1')} as q1, {_q_sql('s2')} as q2, {_q_sql('s0')} as q0,
              (1 - s1 * s1) / (1 - {d(_E2)} * s1 * s1) as m1, (1 - s2 * s2) / (1 - {d(_E2)} * s2 * s2) as m2 from (
              select *, sin(radians({d(lat1)})) as s1, sin(radians({d(lat2)})) as s2, sin(radians({d(lat0)})) as s0 from {rows}) t1) t2) t3) t4) t5"""


def _utm_sql(rows: str, keep: str, lon0: float) -> str:
    """``keep``, x, y of ``rows`` (lon, lat) in a transverse Mercator zone: the same series, north of the equator."""
    n = PR.GRS80.f / (2 - PR.GRS80.f)
    al = PR.series(PR.FORWARD, n)
    r = 0.9996 * PR.GRS80.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)
    east = " + ".join(f"{d(a)} * cos({2 * j} * xi) * ((exp({2 * j} * eta) - exp(-{2 * j} * eta)) / 2)" for j, a in enumerate(al, 1))
    north = " + ".join(f"{d(a)} * sin({2 * j} * xi) * ((exp({2 * j} * eta) + exp(-{2 * j} * eta)) / 2)" for j, a in enumerate(al, 1))
    return f"""select {keep}, 500000 + {d(r)} * (eta + {east}) as x, {d(r)} * (xi + {north}) as y from (
      select *, atan2(t, cos(dl)) as xi, ln(u + sqrt(u * u + 1)) as eta from (
        select *, sin(dl) / sqrt(t * t + cos(dl) * cos(dl)) as u from (
          select *, (exp(w) - exp(-w)) / 2 as t from (
            select *, ln((1 + sp) / (1 - sp)) / 2 - {d(_E)} * ln((1 + {d(_E)} * sp) / (1 - {d(_E)} * sp)) / 2 as w from (
              select *, sin(radians(lat)) as sp, radians(lon - {d(lon0)}) as dl from {rows}) t1) t2) t3) t4) t5"""


def _rounded(sql: str, keep: str, places: int) -> str:
    return f"select {keep}, round(x, {places}) as x, round(y, {places}) as y from ({sql}) r"


def _rounding(df, keep, places):
    return df.select(*keep.split(", "), F.round("x", places).alias("x"), F.round("y", places).alias("y"))


@query("reproject_albers", Q.P(_rounded(_albers_sql("points", "county, lon, lat"), "county, lon, lat", 4)))
def reproject_albers(spark, sf):
    """every point in the equal-area conic of the contiguous states."""
    pts = fx.points(spark, sf).select("county", "lon", "lat")
    return _rounding(PR.reproject(pts, "lon", "lat", PR.LonLat(), PR.CONUS_ALBERS), "county, lon, lat", 4)


@query("reproject_utm", Q.P(_rounded(_utm_sql("points", "county, lon, lat", -99.0), "county, lon, lat", 4)))
def reproject_utm(spark, sf):
    """every point in UTM zone 14, far points too."""
    pts = fx.points(spark, sf).select("county", "lon", "lat")
    return _rounding(PR.reproject(pts, "lon", "lat", PR.LonLat(), PR.utm(14)), "county, lon, lat", 4)


@query("reproject_chain", Q.P(f"select county, round(lon, 7) as lon, round(lat, 7) as lat, round(x, 2) as x, round(y, 2) as y "
                              f"from ({_albers_sql('points', 'county, lon, lat')}) r"))
def reproject_chain(spark, sf):
    """Mercator to UTM, from there to the conic and back to degrees: the inverses lose nothing."""
    pts = fx.points(spark, sf).select("county", "easting", "northing")
    zone = PR.reproject(pts, "easting", "northing", PR.WebMercator(), PR.utm(14), ("ux", "uy"))
    conic = PR.reproject(zone, "ux", "uy", PR.utm(14), PR.CONUS_ALBERS)
    back = PR.reproject(conic, "x", "y", PR.CONUS_ALBERS, PR.LonLat(), ("lon", "lat"))
    return back.select("county", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("polygon_to_albers", f"""select GEOID20, part, cast(pos as integer) as pos, round(px, 4) as x, round(py, 4) as y from (
  select GEOID20, part, pos, x as px, y as py from ({_albers_sql(f"({S.MULTI_VERTICES}) v", "GEOID20, part, pos", "x", "y")}) a) b""")
def polygon_to_albers(spark, sf):
    """every block polygon vertex in the equal-area conic."""
    g = PR.reproject_vertices("geometry", PR.LonLat(), PR.CONUS_ALBERS, depth=3)
    parts = fx.block_multipolygon(spark, sf).select("GEOID20", F.posexplode(g).alias("part", "poly"))
    v = parts.select("GEOID20", "part", F.posexplode(F.get(F.col("poly"), 0)).alias("pos", "xy"))
    return v.select("GEOID20", "part", "pos", F.round("xy.x", 4).alias("x"), F.round("xy.y", 4).alias("y"))


# --- F14 without rounding ------------------------------------------------------------------

_ULP, _SCALE = 2.0 ** -46, 2.0 ** 48             # of the fixture's longitudes (64 to 128); all its coordinates are multiples of 1 / _SCALE

# points on an edge of their block's triangle, rounded to doubles, some of them one ulp aside
_NEAR = f"""select l_orderkey, l_linenumber, GEOID20, (x1 + t * (x2 - x1)) + u * {d(_ULP)} as px, y1 + t * (y2 - y1) as py from (
  select l_orderkey, l_linenumber, GEOID20, cast(l_quantity as double) / {d(64.0)} as t, l_partkey % 3 - 1 as u,
    case l_linenumber % 3 when 0 then cx - {d(1)} when 1 then cx + {d(1)} else cx end as x1,
    case l_linenumber % 3 when 2 then cy + {d(0.8)} else cy - {d(0.8)} end as y1,
    case l_linenumber % 3 when 0 then cx + {d(1)} when 1 then cx else cx - {d(1)} end as x2,
    case l_linenumber % 3 when 1 then cy + {d(0.8)} else cy - {d(0.8)} end as y2
  from lineitem join ({S.BLOCK_TRIANGLES}) t on t.GEOID20 = l_suppkey) e"""


def points_beside_edges(spark, sf):
    """The points of ``_NEAR``: l_orderkey, l_linenumber, GEOID20, px, py and the triangle."""
    li = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity")
    j = li.join(fx.block_polygon(spark, sf), F.col("l_suppkey") == F.col("GEOID20"))
    edge = (F.col("l_linenumber") % 3).cast("int")
    a, b = (F.get(F.get(F.col("geometry"), 0), edge + i) for i in (0, 1))
    t = F.col("l_quantity").cast("double") / F.lit(64.0)
    u = (F.col("l_partkey") % 3 - 1).cast("double") * F.lit(_ULP)
    return j.select("l_orderkey", "l_linenumber", "GEOID20", "geometry", ((a["x"] + t * (b["x"] - a["x"])) + u).alias("px"),
                    (a["y"] + t * (b["y"] - a["y"])).alias("py"))


def _big(c: str) -> str:
    return f"cast({c} * {d(_SCALE)} as hugeint)"


@query("pip_exact", f"""with near as ({_NEAR}), sides as (
  select n.*, ex0, ey0, ex1, ey1, sign(({_big('ex0')} - {_big('px')}) * ({_big('ey1')} - {_big('py')})
     - ({_big('ey0')} - {_big('py')}) * ({_big('ex1')} - {_big('px')})) as side
  from near n join ({S.BLOCK_EDGES}) e on e.GEOID20 = n.GEOID20)
select l_orderkey, l_linenumber, px, py, cast(case
    when bool_or(side = 0 and px between least(ex0, ex1) and greatest(ex0, ex1) and py between least(ey0, ey1) and greatest(ey0, ey1)) then 0
    when sum(case when (ey0 > py) <> (ey1 > py) and ((ey1 > ey0 and side > 0) or (ey1 < ey0 and side < 0)) then 1 else 0 end) % 2 = 1 then 1
    else -1 end as integer) as place, cast(count(*) // 3 as bigint) as points
from sides group by l_orderkey, l_linenumber, px, py""")
def pip_exact(spark, sf):
    """points on, and one ulp beside, the edges of their triangle: inside, on the border or outside, without rounding."""
    p = points_beside_edges(spark, sf)
    located = p.select("l_orderkey", "l_linenumber", "px", "py", exact.locate("geometry", "px", "py").alias("place"))
    return located.groupBy(*located.columns).agg(F.count(F.lit(1)).alias("points"))


# --- A14: spreading, equalised shading ----------------------------------------------------------

_SW, _SH = 960, 540
_DISC = ", ".join(f"({i}, {j})" for i, j in R.disc(2))


@query("raster_spread", Q.P(f"""select px + i as px, py + j as py, cast(sum(value) as bigint) as value
  from {Q._raster_sub('net = 1', 'count(net)', _SW, _SH)} r, (values {_DISC}) o(i, j)
  where px + i between 0 and {_SW - 1} and py + j between 0 and {_SH - 1} group by 1, 2"""))
def raster_spread(spark, sf):
    """Every cell drawn as a disc of radius 2, overlaps added."""
    r = R.raster(X.filtered(fx.points(spark, sf), "in"), Q.VIEWPORT, _SW, _SH, "count", "net")
    return R.spread(r, 2, _SW, _SH)


@query("raster_dynamic_spread", Q.P(f"""
, r as {Q._raster_sub('net = 1 and county % 10 = 3', 'count(net)', _SW, _SH)}
, dens as (select k, avg(case when exists(select 1 from r b where b.px between a.px - 2 * k and a.px + 2 * k
      and b.py between a.py - 2 * k and a.py + 2 * k and (b.px <> a.px or b.py <> a.py)) then 1.0 else 0.0 end) as share
  from r a, (values (1), (2), (3)) t(k) group by k)
, radius as (select coalesce(min(k) - 1, 3) as r from dens where share > 0.7)
, o as (select i, j, rr from (select unnest(range(-3, 4)) as i) a, (select unnest(range(-3, 4)) as j) b, (values (0), (1), (2), (3)) c(rr)
        where sqrt(i * i + j * j) <= rr + 0.5)
select px + i as px, py + j as py, cast(sum(value) as bigint) as value, any_value(rr) as radius from r, o, radius
where o.rr = radius.r and px + i between 0 and {_SW - 1} and py + j between 0 and {_SH - 1} group by 1, 2"""))
def raster_dynamic_spread(spark, sf):
    """A sparse selection, spread until 70 % of the cells have neighbours in reach."""
    df = X.filtered(fx.points(spark, sf), "in").where(F.col("county") % 10 == 3)
    out, radius = R.dynamic_spread(R.raster(df, Q.VIEWPORT, _SW, _SH, "count", "net"), _SW, _SH, threshold=0.7)
    return out.withColumn("radius", F.lit(radius))


@query("raster_equalized", Q.P(f"""
, r as {Q._raster_sub('net in (0, 1)', 'avg(cast(race as double))', Q.SMALL_W, Q.SMALL_H)}
, c as (select value as v, count(*) as n from r group by value)
, u as (select v, sum(n) over (order by v) as upto, first(n) over (order by v) as least, sum(n) over () as total from c)
select r.px, r.py, r.value, round(cast(upto - least as double) / (total - least), 9) as t,
  least(cast(floor(cast(upto - least as double) / (total - least) * 9) as integer), 8) as bin from r join u on u.v = r.value"""))
def raster_equalized(spark, sf):
    """Mean race shaded by rank, so the nine colours are used alike."""
    r = X.view_raster(X.filtered(fx.points(spark, sf), "race"), "race", Q.VIEWPORT, Q.SMALL_W, Q.SMALL_H)
    return R.raster_equalized(r).withColumn("t", F.round("t", 9))


# --- G2 without rejection --------------------------------------------------------------------

def _u(first: int) -> str:
    return f"((('0x' || substr(h, {first}, 8))::BIGINT + 0.5) / 4294967296.0)"


@query("points_in_polygon_by_area", QP.PREP + f"""
, pts as (select g.ID20, t.k, tr.cx, tr.cy, md5(concat_ws(':', cast(g.ID20 as varchar), cast(t.k as varchar), 'area', '0')) as h
  from (select ID20, points from mig where points <> 0) g join ({S.BLOCK_TRIANGLES}) tr on tr.GEOID20 = g.ID20, generate_series(1, g.points) t(k))
, ups as (select *, {_u(9)} * (({{r}} - {{l}}) + cx - cx) / (({{r}} - {{l}}) + sqrt(({{r}} - {{l}}) * ({{r}} - {{l}}) + {_u(9)} * ({d(0)} - ({{r}} - {{l}}) * ({{r}} - {{l}})))) as up from pts)
select ID20, k, round(({{l}} + up * (cx - {{l}})) + {_u(17)} * (({{r}} + up * (cx - {{r}})) - ({{l}} + up * (cx - {{l}}))), 9) as x,
  round((cy - {d(0.8)}) + up * ((cy + {d(0.8)}) - (cy - {d(0.8)})), 9) as y from ups""".replace("{l}", f"(cx - {d(1)})").replace("{r}", f"(cx + {d(1)})"))
def points_in_polygon_by_area(spark, sf):
    """One draw per individual, by the trapezoids of its block's polygon."""
    g = MG.generation_table(QP._mig(spark, sf))
    p = by_area.trapezoids(fx.block_polygon(spark, sf).withColumnRenamed("GEOID20", "ID20"))
    e = by_area.individuals_by_area(g.join(p, "ID20"), "points")
    return e.select("ID20", "k", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))

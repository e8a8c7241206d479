"""The fixture adapters of ``fixtures.py`` as DuckDB SQL (oracle side only)."""

from __future__ import annotations

from ..functions.geo import DEG, QUARTER_PI
from ..schemas import EARTH_RADIUS


def d(v: float) -> str:
    return f"cast('{float(v)!r}' as double)"


def mercator_x(lon: str) -> str:
    return f"({d(EARTH_RADIUS)} * ({lon} * {d(DEG)}))"


def mercator_y(lat: str) -> str:
    return f"({d(EARTH_RADIUS)} * ln(tan({d(QUARTER_PI)} + ({lat} * {d(DEG)}) / {d(2.0)})))"


POINTS = f"""
select county, state, net, race, lon, lat, {mercator_x('lon')} as easting, {mercator_y('lat')} as northing
from (
  select l_suppkey as county, s_nationkey as state,
    cast(case l_returnflag when 'N' then 1 when 'A' then 0 else -1 end as integer) as net,
    cast(case when l_returnflag = 'R' then 0 else l_linenumber end as integer) as race,
    {d(-125)} + {d(58)} * (l_extendedprice - {d(900)}) / {d(104100)} as lon,
    {d(24)} + {d(26)} * (l_quantity - {d(1)} + {d(9.9)} * l_discount) / {d(50)} as lat
  from lineitem join supplier on l_suppkey = s_suppkey
) p
"""


POINTS_NULLS = f"""select case when county % 9 <> 4 then county end as county, state, net,
  case when county % 7 <> 2 then race end as race, lon, lat,
  case when race <> 5 or net <> 0 then easting end as easting, northing from ({POINTS}) p0"""


def _race_sums(prefix: str) -> str:
    return ", ".join(f"cast(sum(case when l_linenumber = {k} then 1 else 0 end) as bigint) as {prefix}{k}"
                     for k in range(1, 8))


BLOCK10 = f"""
select l_partkey as ID10, count(*) as P10, {_race_sums('R10')}
from lineitem where l_linestatus = 'F' group by l_partkey
"""

BLOCK20 = f"""
select l_suppkey as ID20, max(s_nationkey) as STATE, max(n_name) as COUNTY, count(*) as P20, {_race_sums('R20')}
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
where l_linestatus = 'O' group by l_suppkey
"""

CROSSWALK = "select distinct l_partkey as ID10, l_suppkey as ID20 from lineitem"

DIM_COUNTY = "select s_suppkey as id, s_name as name from supplier"
DIM_STATE = "select n_nationkey as id, n_name as name from nation"

# State L-shapes as vertex lists: (State_Code, State_Name, region, v, x, y), v = 0..6.
NATION_VERTICES = f"""
select n_nationkey as State_Code, n_name as State_Name, n_regionkey as region, v, x, y from (
  select n_nationkey, n_name, n_regionkey,
    {d(-125)} + {d(11.6)} * (n_nationkey % 5) as x0,
    {d(24)} + {d(5.2)} * floor(n_nationkey / 5) as y0
  from nation
) b, (
  select * from (values (0, 0, 0), (1, 2, 0), (2, 2, 1), (3, 1, 1), (4, 1, 2), (5, 0, 2), (6, 0, 0)) t(v, ix, iy)
) t2,
lateral (select
  case ix when 0 then x0 when 1 then x0 + {d(5.8)} else x0 + {d(11.6)} end as x,
  case iy when 0 then y0 when 1 then y0 + {d(2.6)} else y0 + {d(5.2)} end as y) c
"""

NATION_EDGES = f"""
select a.State_Code, a.State_Name, a.region, a.x as ex0, a.y as ey0, b.x as ex1, b.y as ey1
from ({NATION_VERTICES}) a join ({NATION_VERTICES}) b on a.State_Code = b.State_Code and b.v = a.v + 1
"""

BLOCK_TRIANGLES = f"""
select s_suppkey as GEOID20,
  {d(-120)} + {d(5)} * (s_suppkey % 10) as cx,
  {d(26)} + {d(2)} * (floor(s_suppkey / 10) % 10) as cy
from supplier
"""

# Triangle edges (cx-1, cy-0.8) -> (cx+1, cy-0.8) -> (cx, cy+0.8) -> back.
BLOCK_EDGES = f"""
select GEOID20, ex0, ey0, ex1, ey1 from (
  select GEOID20, cx - {d(1)} as ex0, cy - {d(0.8)} as ey0, cx + {d(1)} as ex1, cy - {d(0.8)} as ey1 from ({BLOCK_TRIANGLES}) t
  union all
  select GEOID20, cx + {d(1)}, cy - {d(0.8)}, cx, cy + {d(0.8)} from ({BLOCK_TRIANGLES}) t
  union all
  select GEOID20, cx, cy + {d(0.8)}, cx - {d(1)}, cy - {d(0.8)} from ({BLOCK_TRIANGLES}) t
) e
"""


def crossing(px: str, py: str) -> str:
    """1 when the edge (ex0,ey0)-(ex1,ey1) crosses the ray right of (px, py)."""
    return (f"case when ((ey0 > {py}) <> (ey1 > {py})) and "
            f"({px} < ((ex1 - ex0) * ({py} - ey0)) / (ey1 - ey0) + ex0) then 1 else 0 end")

SIGNED_POINTS = """
select l_suppkey as county,
  cast(l_linenumber * case when l_returnflag = 'N' then 1 else -1 end as integer) as race
from lineitem where l_returnflag <> 'A'
"""

GISJOIN = """
select s_suppkey, s_nationkey, 'G' || lpad(cast(s_nationkey as varchar), 2, '0') || '0' ||
  lpad(cast(s_nationkey as varchar), 3, '0') || '0' || lpad(cast(s_suppkey as varchar), 10, '0') as GISJOIN
from supplier
"""

COUNTY_TEXT = "select s_suppkey as id, 'Doña Ana ' || s_name || ' LaSalle McLean County' as COUNTY from supplier"

# Vertices of the per-supplier multipolygons: (GEOID20, part, pos, x, y).
MULTI_VERTICES = f"""
select GEOID20, part, pos, (cx + part * {d(2.5)}) + dx as x, cy + dy as y from ({BLOCK_TRIANGLES}) t,
  (select * from (values (0, {d(-1)}, {d(-0.8)}), (1, {d(1)}, {d(-0.8)}), (2, {d(0)}, {d(0.8)}),
                         (3, {d(-1)}, {d(-0.8)})) v(pos, dx, dy)) v,
  (select * from (values (0), (1)) p(part)) p
where part = 0 or GEOID20 % 3 <> 0
"""

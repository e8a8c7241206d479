"""Cross-filter, projection, filter, aggregate, sort and scalar queries.

Each query runs the library's operators over the census-shaped views of the
driver tables (``plans.fixtures``); the SQL next to it is the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import geo, ids, numeric
from .operators import aggregates as A, filters, raster as R, topk, windows
from .plans import crossfilter as X, fixtures as fx
from .plans import fixtures_sql as fx_sql
from .plans.fixtures_sql import BLOCK20, POINTS, d
from .schemas import STATE_ABBR

# --- query parameters --------------------------------------------------------
VIEWPORT_LL = (-125.0, -67.0, 24.0, 50.0)   # lon0, lon1, lat0, lat1
BOX_LL = (-110.0, -90.0, 30.0, 44.0)
_vx0, _vy0 = geo.mercator_xy(VIEWPORT_LL[0], VIEWPORT_LL[2])
_vx1, _vy1 = geo.mercator_xy(VIEWPORT_LL[1], VIEWPORT_LL[3])
VIEWPORT = (_vx0, _vx1, _vy0, _vy1)
_bx0, _by0 = geo.mercator_xy(BOX_LL[0], BOX_LL[3])   # top-left, as the map sends it
_bx1, _by1 = geo.mercator_xy(BOX_LL[1], BOX_LL[2])   # bottom-right
BOX = (_bx0, _bx1, _by0, _by1)
W, H = 3840, 2160
SMALL_W, SMALL_H = 384, 216
SEL_RACES = [1, 2, 3]
SEL_COUNTIES = list(range(0, 10))


def P(body: str) -> str:
    return f"with points as ({POINTS}) {body}"


def box_sql() -> str:
    lx, hx = min(BOX[0], BOX[1]), max(BOX[0], BOX[1])
    ly, hy = min(BOX[2], BOX[3]), max(BOX[2], BOX[3])
    return f"easting between {d(lx)} and {d(hx)} and northing between {d(ly)} and {d(hy)}"


def cell_sql(c: str, lo: float, hi: float, n: int) -> str:
    return (f"case when {c} between {d(lo)} and {d(hi)} then least(cast(floor((({c} - {d(lo)}) * {d(n)}) / "
            f"{d(hi - lo)}) as integer), {n - 1}) end")


def viewport_sql() -> str:
    x0, x1, y0, y1 = VIEWPORT
    return f"easting between {d(x0)} and {d(x1)} and northing between {d(y0)} and {d(y1)}"


def _pts(spark, sf):
    return fx.points(spark, sf)


# --- minimum slice / flagship: top-15 counties of inward migration ----------

TOP_SQL = """
, agg as (select county, count(net) as cnt from points where {where} group by county)
, bars as (select county, cnt, cast(row_number() over (order by cnt {o1}, county {o2}) as integer) as pos from agg)
select b.county, b.cnt, b.pos, s.s_name as name from bars b left join supplier s on s.s_suppkey = b.county
where b.pos <= 15
"""


@query("top15_county", P(TOP_SQL.format(where="net = 1", o1="desc", o2="asc")))
def top15_county(spark, sf):
    """T3 + J7: top-15 counties of the "in" view, names decoded after the limit."""
    df = X.filtered(_pts(spark, sf), "in")
    return X.county_top(df, fx.dim_county(spark, sf))


@query("bottom15_county", P(TOP_SQL.format(where="net = 1", o1="asc", o2="desc")))
def bottom15_county(spark, sf):
    """T4 + J7: bottom-15 counties of the "in" view (last 15 of the descending order)."""
    df = X.filtered(_pts(spark, sf), "in")
    return X.county_bottom(df, fx.dim_county(spark, sf))


@query("crossfilter_county", P(TOP_SQL.format(where=f"net in (0, 1) and {box_sql()}", o1="desc", o2="asc")))
def crossfilter_county(spark, sf):
    """Top counties after box select + "total" view."""
    df = X.filtered(_pts(spark, sf), "total", box=BOX)
    return X.county_top(df, fx.dim_county(spark, sf))


@query("crossfilter_race", P(f"""
select race, count(net) as cnt, {'case race ' + ' '.join(f"when {k} then '{v}'" for k, v in X.RACE_NAMES.items()) + ' end'} as name
from points where net in (0, 1) and {box_sql()} and county in ({', '.join(map(str, SEL_COUNTIES))})
group by race"""))
def crossfilter_race(spark, sf):
    """Race histogram with box, view and a county selection."""
    df = X.filtered(_pts(spark, sf), "total", box=BOX, selections={"county_top": SEL_COUNTIES})
    return X.race_histogram(df, "total")


@query("histogram_race_out_empty", P(f"""select 'in' as view, race, count(net) as cnt,
  {'case race ' + ' '.join(f"when {k} then '{v}'" for k, v in X.RACE_NAMES.items()) + ' end'} as name
from points where net = 1 group by race"""))
def histogram_race_out_empty(spark, sf):
    """C4 / Q15: race histograms of the "in" and the "out" view; the second has no bar."""
    both = [X.race_histogram(X.filtered(_pts(spark, sf), v), v).withColumn("view", F.lit(v)) for v in ("in", "out")]
    return both[0].unionByName(both[1]).select("view", "race", "cnt", "name")


@query("crossfilter_count", P(f"select count(*) as n_rows from points where net in (0, 1) and {box_sql()} "
                              f"and race in ({', '.join(map(str, SEL_RACES))})"))
def crossfilter_count(spark, sf):
    """Row count after box select, view and a race selection."""
    df = X.filtered(_pts(spark, sf), "total", box=BOX, selections={"race": SEL_RACES})
    return X.row_count(df)


def _raster_sql(where: str, agg: str, w: int = W, h: int = H) -> str:
    x0, x1, y0, y1 = VIEWPORT
    return P(f"""select px, py, {agg} as value from (
      select {cell_sql('easting', x0, x1, w)} as px, {cell_sql('northing', y0, y1, h)} as py, net, race
      from points where {where} and {viewport_sql()}) c group by px, py""")


@query("crossfilter_raster", _raster_sql(f"net in (0, 1) and {box_sql()}", "count(net)"))
def crossfilter_raster(spark, sf):
    """Count raster of the box-selected "total" view over the full viewport (Q13)."""
    df = X.filtered(_pts(spark, sf), "total", box=BOX)
    return X.view_raster(df, "total", VIEWPORT, W, H)


@query("raster_count", _raster_sql("true", "count(net)"))
def raster_count(spark, sf):
    """3840 x 2160 count raster of every point."""
    return R.raster(_pts(spark, sf), VIEWPORT, W, H, "count", "net")


@query("raster_mean_race", _raster_sql("net in (0, 1)", "avg(cast(race as double))", SMALL_W, SMALL_H))
def raster_mean_race(spark, sf):
    """Mean race per cell ("race" view)."""
    df = X.filtered(_pts(spark, sf), "race")
    return X.view_raster(df, "race", VIEWPORT, SMALL_W, SMALL_H)


@query("raster_mean_net", _raster_sql("true", "avg(cast(net as double))", SMALL_W, SMALL_H))
def raster_mean_net(spark, sf):
    """Mean net per cell ("net" view)."""
    df = X.filtered(_pts(spark, sf), "net")
    return X.view_raster(df, "net", VIEWPORT, SMALL_W, SMALL_H)




def _raster_sub(where: str, agg: str, w: int, h: int) -> str:
    x0, x1, y0, y1 = VIEWPORT
    return f"""(select px, py, {agg} as value from (
      select {cell_sql('easting', x0, x1, w)} as px, {cell_sql('northing', y0, y1, h)} as py, net, race
      from points where {where} and {viewport_sql()}) c group by px, py)"""


@query("raster_stats", P(f"select min(value) as vmin, max(value) as vmax, cast(sum(value) as bigint) as vsum, "
                         f"count(*) as cells from {_raster_sub('true', 'count(net)', W, H)} r"))
def raster_stats(spark, sf):
    """Min / max / sum over the cells of the count raster."""
    return R.raster_stats(R.raster(_pts(spark, sf), VIEWPORT, W, H, "count", "net"))


def _shade_sql(raster: str, place: str) -> str:
    """Values shifted to start at 0, log(1 + .), divided by the largest; bin by palette position."""
    return P(f"""
, r as {raster}
, s as (select min(cast(value as double)) as lo, max(cast(value as double)) as hi from r)
, t as (select px, py, value, case when hi > lo then ln(1 + (cast(value as double) - lo)) / ln(1 + (hi - lo))
        else cast(0 as double) end as t from r, s)
select px, py, value, round(t, 6) as t, least(cast(floor({place} * 9) as integer), 8) as bin from t""")


@query("raster_scaled_net", _shade_sql(_raster_sub('true', 'avg(cast(net as double))', SMALL_W, SMALL_H), "log10(9 * t + 1)"))
def raster_scaled_net(spark, sf):
    """A14 on a mean raster with negative cells ("net" view), logarithmic palette."""
    r = X.view_raster(X.filtered(_pts(spark, sf), "net"), "net", VIEWPORT, SMALL_W, SMALL_H)
    return R.raster_scaled(r, 9, "log", "log").withColumn("t", F.round("t", 6))


@query("raster_zero_width", P(f"""
, e as (select easting from points order by easting, northing limit 1)
, m as (select p.net, p.northing from points p join e on p.easting = e.easting)
, n as (select min(northing) as lo, max(northing) as hi from m)
, w as (select case when hi > lo then lo else lo - greatest(cast(0.5 as double), abs(lo) * {d(1e-9)}) end as lo,
        case when hi > lo then hi else hi + greatest(cast(0.5 as double), abs(lo) * {d(1e-9)}) end as hi from n)
select cast({SMALL_W // 2} as integer) as px,
  least(cast(floor(((northing - lo) * {d(SMALL_H)}) / (hi - lo)) as integer), {SMALL_H - 1}) as py, count(net) as value
from m, w group by 1, 2"""))
def raster_zero_width(spark, sf):
    """A viewport without width (the points on the smallest easting) still has cells."""
    pts = _pts(spark, sf)
    x = pts.agg(F.min("easting")).first()[0]
    line = pts.where(F.col("easting") == F.lit(x))
    return R.raster(line, X.data_extent(line), SMALL_W, SMALL_H, "count", "net")


@query("raster_scaled", _shade_sql(_raster_sub('true', 'count(net)', SMALL_W, SMALL_H), "t"))
def raster_scaled(spark, sf):
    """Log shading of the count raster into 9 palette bins."""
    r = R.raster(_pts(spark, sf), VIEWPORT, SMALL_W, SMALL_H, "count", "net")
    out = R.raster_scaled(r, 9, "log")
    return out.withColumn("t", F.round("t", 6))


_M = ("count(net) as cnt, count(*) as n_rows, avg(cast(race as double)) as mean_race, "
      "avg(cast(net as double)) as mean_net")
_NI, _NB = "cast(null as integer)", "cast(null as bigint)"
_SETS = f"""select 'county' as grp, county, {_NI} as race, {_NI} as px, {_NI} as py, {_M} from f group by county
union all select 'race', {_NB}, race, {_NI}, {_NI}, {_M} from f group by race
union all select 'cell', {_NB}, {_NI}, px, py, {_M} from f where px is not null group by px, py
union all select 'total', {_NB}, {_NI}, {_NI}, {_NI}, {_M} from f"""
_RACE_NAME = "case race " + " ".join(f"when {k} then '{v}'" for k, v in X.RACE_NAMES.items()) + " end"


def _ranked_sql(f: str, no_nulls: bool = False) -> str:
    """Oracle of ``ranked``: bars within 15 of either end, with names."""
    whole = "(grp <> 'county' or county is not null) and (grp <> 'race' or race is not null) and (grp <> 'cell' or py is not null)"
    return P(f""", {f}, a as (select * from ({_SETS}) a0 where {whole if no_nulls else 'true'}), r as (select *,
  case when grp = 'county' then cast(row_number() over (partition by grp order by cnt desc, county) as integer) end as pos_top,
  case when grp = 'county' then cast(row_number() over (partition by grp order by cnt, county desc) as integer) end as pos_bottom from a)
select r.*, case when grp = 'race' then {_RACE_NAME} else s.s_name end as name
from r left join supplier s on r.grp = 'county' and s.s_suppkey = r.county
where n_rows > 0 and (grp <> 'county' or least(pos_top, pos_bottom) <= 15)""")


def _gs_sql() -> str:
    x0, x1, y0, y1 = VIEWPORT
    f = (f"f as (select county, race, net, case when {viewport_sql()} then {cell_sql('easting', x0, x1, W)} end as px, "
         f"case when {viewport_sql()} then {cell_sql('northing', y0, y1, H)} end as py "
         f"from points where net in (0, 1) and {box_sql()})")
    return P(f", {f} {_SETS}")


@query("crossfilter_all", _gs_sql())
def crossfilter_all(spark, sf):
    """In one scan, county bars, race bars, raster cells and total via GROUPING SETS."""
    return X.crossfilter_all(_pts(spark, sf), "total", box=BOX, viewport=VIEWPORT, width=W, height=H)


# --- P12 views, P9-P11, P16 -------------------------------------------------
_ROW = "county, state, net, race, lon, lat"
_VIEW_SQL = {"total": "net in (0, 1)", "in": "net = 1", "stationary": "net = 0", "out": "net = -1",
             "net": "true", "race": "net in (0, 1)"}


def _view_query(view: str):
    @query(f"view_{view}", P(f"select {_ROW} from points where {_VIEW_SQL[view]}"))
    def q(spark, sf):
        return filters.filter_view(_pts(spark, sf), view).select(*_ROW.split(", "))
    q.__doc__ = f"P12: rows of the {view!r} view."
    return q


for _v in ("total", "in", "stationary", "out", "net", "race"):
    _view_query(_v)


@query("box_select", P(f"select {_ROW} from points where {box_sql()}"))
def box_select(spark, sf):
    """Inclusive box on easting/northing; corners given top-left, bottom-right."""
    return filters.box_select(_pts(spark, sf), BOX).select(*_ROW.split(", "))


@query("filter_isin", P(f"select {_ROW} from points where county in ({', '.join(map(str, SEL_COUNTIES))})"))
def filter_isin(spark, sf):
    """P10: county membership (short list -> IN predicate)."""
    return filters.filter_isin(_pts(spark, sf), "county_top", SEL_COUNTIES).select(*_ROW.split(", "))


@query("filter_multi_isin", P(f"select {_ROW} from points where county in ({', '.join(map(str, SEL_COUNTIES))}) "
                              f"and race in ({', '.join(map(str, SEL_RACES))})"))
def filter_multi_isin(spark, sf):
    """P10: several selections ANDed."""
    sel = {"race": SEL_RACES, "county_bottom": SEL_COUNTIES}
    return filters.filter_selections(_pts(spark, sf), sel).select(*_ROW.split(", "))


LABELS = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000003", "Supplier#000000005"]


@query("filter_by_labels", P(f"select {_ROW} from points where county in (select s_suppkey from supplier "
                             f"where s_name in ({', '.join(repr(x) for x in LABELS)}))"))
def filter_by_labels(spark, sf):
    """Bar labels -> ids -> semi join."""
    return filters.filter_by_labels(_pts(spark, sf), "county_top", fx.dim_county(spark, sf), LABELS) \
        .select(*_ROW.split(", "))


@query("view_race_signed", f"select county, race from ({fx_sql.SIGNED_POINTS}) s where abs(race) = 3")
def view_race_signed(spark, sf):
    """One race, in or out (sign-insensitive)."""
    return filters.race_view_signed(fx.signed_points(spark, sf), 3)


@query("race_in_out", f"select abs(race) as race, cast(sign(race) as integer) as direction, count(*) as cnt "
                      f"from ({fx_sql.SIGNED_POINTS}) s group by abs(race), sign(race)")
def race_in_out(spark, sf):
    """Individuals in and out per race."""
    return A.race_in_out(fx.signed_points(spark, sf))


# --- P1-P7 on block tables -----------------------------------------------------
_B20 = "ID20, STATE, COUNTY, P20, R201, R202, R203, R204, R205, R206, R207"


@query("filter_state", f"select {_B20} from ({BLOCK20}) b where STATE = 3")
def filter_state(spark, sf):
    """Equality filter on the state."""
    return fx.block20(spark, sf).where(F.col("STATE") == 3)


@query("filter_nonzero", f"select ID20, R207 - R206 as diff from ({BLOCK20}) b where R207 - R206 <> 0 and ID20 % 3 <> 0")
def filter_nonzero(spark, sf):
    """P5: non-zero filter on a difference of race counts (0 in every third block)."""
    b = fx.block20(spark, sf)
    b = b.select("ID20", F.when(F.col("ID20") % 3 == 0, 0).otherwise(F.col("R207") - F.col("R206")).alias("diff"))
    return filters.filter_nonzero(b, "diff")


@query("filter_id_range", f"select {_B20} from ({BLOCK20}) b where ID20 between 10 and 40")
def filter_id_range(spark, sf):
    """One shard of block ids."""
    return filters.filter_id_range(fx.block20(spark, sf), "ID20", 10, 40)


@query("rename_cols", f"select ID20 as GEOCODE, STATE as STATEA, COUNTY, P20 as U7B001, R201 as U7B003 from ({BLOCK20}) b")
def rename_cols(spark, sf):
    """Rename many columns at once."""
    b = fx.block20(spark, sf).withColumnsRenamed(
        {"ID20": "GEOCODE", "STATE": "STATEA", "P20": "U7B001", "R201": "U7B003"})
    return b.select("GEOCODE", "STATEA", "COUNTY", "U7B001", "U7B003")


@query("select_drop", f"select ID20, STATE, P20 from ({BLOCK20}) b")
def select_drop(spark, sf):
    """Select / drop columns."""
    return fx.block20(spark, sf).drop("COUNTY", *[f"R20{k}" for k in range(1, 8)])


@query("derive_diff", f"select ID20, P20 - R201 as diff, R207 / P20 as share7 from ({BLOCK20}) b")
def derive_diff(spark, sf):
    """Difference and ratio columns (ratio via try_divide)."""
    b = fx.block20(spark, sf)
    return b.select("ID20", (F.col("P20") - F.col("R201")).alias("diff"),
                    F.try_divide(F.col("R207").cast("double"), F.col("P20").cast("double")).alias("share7"))


# --- A1-A7, T1-T7, U1 ------------------------------------------------------
@query("value_counts", f"select ID20, count(*) as count from ({fx_sql.CROSSWALK}) c group by ID20")
def value_counts(spark, sf):
    """A1: crosswalk rows per 2020 block."""
    return A.value_counts(fx.crosswalk(spark, sf), "ID20")


@query("top10_value_counts", f"""select ID20, count, cast(pos as integer) as pos from (
  select ID20, count(*) as count, row_number() over (order by count(*) desc, ID20 asc) as pos
  from ({fx_sql.CROSSWALK}) c group by ID20) t where pos <= 10""")
def top10_value_counts(spark, sf):
    """T5: top-10 of a value_counts."""
    return topk.top_n(A.value_counts(fx.crosswalk(spark, sf), "ID20"), "count", "ID20", 10)


@query("group_sum_multi", f"""select ID20, cast(sum(P10) as bigint) as P10, {', '.join(f'cast(sum(R10{k}) as bigint) as R10{k}' for k in range(1, 8))}
from ({fx_sql.CROSSWALK}) c join ({fx_sql.BLOCK10}) b on c.ID10 = b.ID10 group by ID20""")
def group_sum_multi(spark, sf):
    """A2: eight sums per 2020 block over the crosswalk."""
    j = fx.crosswalk(spark, sf).join(fx.block10(spark, sf), "ID10")
    return A.group_sum(j, "ID20", ["P10"] + [f"R10{k}" for k in range(1, 8)])


@query("count_by_county", P("select county, count(net) as cnt from points group by county"))
def count_by_county(spark, sf):
    """A3: non-null net per county."""
    return A.count_by(_pts(spark, sf), "county")


@query("count_by_race", P("select race, count(net) as cnt from points group by race"))
def count_by_race(spark, sf):
    """A3: non-null net per race."""
    return A.count_by(_pts(spark, sf), "race")


@query("row_count", P("select count(*) as n_rows from points"))
def row_count(spark, sf):
    """A4: row count of the point table."""
    return A.row_count(_pts(spark, sf))


@query("global_sum", f"select cast(sum(P20) as bigint) as sum_P20 from ({BLOCK20}) b")
def global_sum(spark, sf):
    """A5: global sum of the 2020 population."""
    return A.global_sum(fx.block20(spark, sf), "P20")


@query("conditional_sum", f"select cast(sum(case when STATE % 2 = 0 then P20 else 0 end) as bigint) as even_P20 "
                          f"from ({BLOCK20}) b")
def conditional_sum(spark, sf):
    """Filtered sum in the same scan."""
    return A.conditional_sum(fx.block20(spark, sf), "P20", F.col("STATE") % 2 == 0, "even_P20")


@query("data_bounds", P("select round(min(easting), 4) as xmin, round(max(easting), 4) as xmax, "
                        "round(min(northing), 4) as ymin, round(max(northing), 4) as ymax, "
                        "round((min(easting) + max(easting)) / 2, 4) as xc, "
                        "round((min(northing) + max(northing)) / 2, 4) as yc from points"))
def data_bounds(spark, sf):
    """Data extent and centre."""
    b = A.data_bounds(_pts(spark, sf))
    return b.select(*[F.round(c, 4).alias(c) for c in b.columns])


@query("clamp_viewport", P(f"select greatest({d(-100.0)}, min(lon)) as lon0, least({d(-60.0)}, max(lon)) as lon1, "
                           f"greatest({d(20.0)}, min(lat)) as lat0, least({d(40.0)}, max(lat)) as lat1 from points"))
def clamp_viewport(spark, sf):
    """a lon/lat window clamped to the data extent: two sides inside the data, two beyond."""
    return A.clamp_viewport(_pts(spark, sf), (-100.0, -60.0, 20.0, 40.0), "lon", "lat")


@query("top_n_param", P("""select county, cnt, cast(pos as integer) as pos from (
  select county, count(net) as cnt, row_number() over (order by count(net) desc, county asc) as pos
  from points where net <> 0 group by county) t where pos <= 25"""))
def top_n_param(spark, sf):
    """Counties with most migration (in or out), N = 25."""
    df = _pts(spark, sf).where(F.col("net") != 0)
    return topk.top_n(A.count_by(df, "county"), "cnt", "county", 25)


@query("sort_by_id", f"select {_B20} from ({BLOCK20}) b order by ID20")
def sort_by_id(spark, sf):
    """Global sort by block id."""
    return topk.sort_by(fx.block20(spark, sf), "ID20")


@query("sort_desc", P("select county, count(net) as cnt from points group by county order by cnt desc, county"))
def sort_desc(spark, sf):
    """County counts sorted descending, key as tie-break."""
    return topk.sort_desc(A.count_by(_pts(spark, sf), "county"), "cnt", "county")


@query("first_n", f"select {_B20} from ({BLOCK20}) b order by ID20 limit 5")
def first_n(spark, sf):
    """First rows of a defined order."""
    return topk.first_n(fx.block20(spark, sf), 5, "ID20")


@query("nth_row", f"select {_B20} from ({BLOCK20}) b order by ID20 limit 1 offset 3")
def nth_row(spark, sf):
    """The row at a position."""
    return topk.nth_row(fx.block20(spark, sf), 3, "ID20")


@query("sample_n", """select o_orderkey, o_custkey, o_totalprice from orders
order by md5(concat_ws(':', cast(o_orderkey as varchar), cast(0 as varchar))), o_orderkey limit 1000""")
def sample_n(spark, sf):
    """Exactly 1000 rows, reproducible (smallest md5 of key and seed)."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return topk.sample_n(o, 1000, ["o_orderkey"], seed=0)


@query("union_all", f"select {_B20} from ({BLOCK20}) b where STATE < 12 union all "
                    f"select {_B20} from ({BLOCK20}) b where STATE >= 12")
def union_all(spark, sf):
    """Union of per-state frames by name."""
    b = fx.block20(spark, sf)
    return b.where(F.col("STATE") < 12).unionByName(b.where(F.col("STATE") >= 12).select(*reversed(b.columns)))


# --- W1-W3 -----------------------------------------------------------------
@query("bfill", """select o_orderkey, v, first(v ignore nulls) over (order by o_orderkey
  rows between current row and unbounded following) as v_filled from (
  select o_orderkey, case when o_orderstatus = 'P' then null else o_custkey end as v from orders) o""")
def bfill(spark, sf):
    """Backward fill along o_orderkey (values null for status P)."""
    o = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_custkey")).alias("v"))
    return windows.bfill(o, "v", "o_orderkey", out="v_filled")


@query("row_number_per_block", f"select ID20, ID10, row_number() over (partition by ID20 order by ID10) as rn "
                               f"from ({fx_sql.CROSSWALK}) c")
def row_number_per_block(spark, sf):
    """1..n numbering of the crosswalk rows of each 2020 block (groups over 64 rows through the range sort)."""
    return windows.number_within_group(fx.crosswalk(spark, sf), "ID20", ["ID10"], out="rn", max_rows=64)


@query("window_freq", f"select ID10, ID20, count(*) over (partition by ID10) as freq from ({fx_sql.CROSSWALK}) c")
def window_freq(spark, sf):
    """Crosswalk rows of each 2010 block attached to every row."""
    return windows.window_freq(fx.crosswalk(spark, sf), "ID10")


# --- F1-F12 ------------------------------------------------------------------
@query("str_strip_prefix", f"select s_suppkey, replace(GISJOIN, 'G', '') as stripped from ({fx_sql.GISJOIN}) g")
def str_strip_prefix(spark, sf):
    """remove the letter from GISJOIN ids."""
    g = fx.gisjoin_text(spark, sf)
    return g.select("s_suppkey", ids.strip_letter("GISJOIN").alias("stripped"))


@query("parse_gisjoin", f"""select s_suppkey, GISJOIN, cast(substr(s, 1, 2) || substr(s, 4, 3) || substr(s, 8) as bigint) as ID
from (select s_suppkey, GISJOIN, replace(GISJOIN, 'G', '') as s from ({fx_sql.GISJOIN}) g) t""")
def parse_gisjoin(spark, sf):
    """GISJOIN -> 15-digit id."""
    g = fx.gisjoin_text(spark, sf)
    return g.select("s_suppkey", "GISJOIN", ids.parse_gisjoin("GISJOIN").alias("ID"))


def _rj(c: str, n: int) -> str:
    return f"(case when length(cast({c} as varchar)) >= {n} then cast({c} as varchar) else lpad(cast({c} as varchar), {n}, '0') end)"


@query("compose_block_id", f"""select s_suppkey, cast({_rj('s_nationkey', 2)} || {_rj('s_suppkey % 1000', 3)} ||
  {_rj('s_suppkey', 6)} || {_rj('s_suppkey % 10000', 4)} as bigint) as ID from supplier""")
def compose_block_id(spark, sf):
    """padded parts -> block id."""
    s = fx.table(spark, sf, "supplier")
    return s.select("s_suppkey", ids.compose_block_id("s_nationkey", F.col("s_suppkey") % 1000, "s_suppkey",
                                                      F.col("s_suppkey") % 10000).alias("ID"))


@query("casts", f"""select ID20, cast(P20 as double) as P20d, cast(STATE as varchar) as STATE_s,
  try_cast(substr(COUNTY, 8) as integer) as county_no from ({BLOCK20}) b""")
def casts(spark, sf):
    """cast and try_cast."""
    b = fx.block20(spark, sf)
    return b.select("ID20", F.col("P20").cast("double").alias("P20d"), F.col("STATE").cast("string").alias("STATE_s"),
                    F.substr(F.col("COUNTY"), F.lit(8)).try_cast("int").alias("county_no"))


@query("round_abs", f"""select ID20, cast(round_even((R201 - R202) / 2, 0) as integer) as half_even,
  abs(R201 - R202) as abs_diff from ({BLOCK20}) b""")
def round_abs(spark, sf):
    """half-to-even rounding of halves and absolute values."""
    b = fx.block20(spark, sf)
    x = (F.col("R201") - F.col("R202")) / F.lit(2.0)
    return b.select("ID20", numeric.round_half_even(x).alias("half_even"),
                    F.abs(F.col("R201") - F.col("R202")).alias("abs_diff"))


@query("sign_net", f"select ID20, cast(sign(R201 - R202) as integer) as net from ({BLOCK20}) b")
def sign_net(spark, sf):
    """1 / 0 / -1."""
    b = fx.block20(spark, sf)
    return b.select("ID20", numeric.sign_net(F.col("R201") - F.col("R202")).alias("net"))


@query("sign_net2", f"select ID20, case when R201 - R202 > 0 then 1 else 0 end as net2 from ({BLOCK20}) b")
def sign_net2(spark, sf):
    """two-valued net code (1 if positive else 0)."""
    b = fx.block20(spark, sf)
    return b.select("ID20", numeric.sign_net2(F.col("R201") - F.col("R202")).alias("net2"))


@query("clean_county", f"""select id, COUNTY,
  regexp_replace(regexp_replace(COUNTY, '[^\\x00-\\x7F]+', '', 'g'), '([A-Z][a-z]+)([A-Z]+)', '\\1', 'g') as clean,
  regexp_replace(regexp_replace(COUNTY, '[^\\x00-\\x7F]+', '', 'g'), '([A-Z][a-z]+)([A-Z]+)$', '\\1', 'g') as clean_anchored
from ({fx_sql.COUNTY_TEXT}) c""")
def clean_county(spark, sf):
    """F8: non-ASCII removal and the CamelCase regex (parity and anchored)."""
    c = fx.county_text(spark, sf)
    return c.select("id", "COUNTY", ids.clean_county("COUNTY").alias("clean"),
                    ids.clean_county("COUNTY", anchored=True).alias("clean_anchored"))


_ABBR_VALUES = ", ".join(f"({k}, '{v}')" for k, v in sorted(STATE_ABBR.items()))


@query("state_code", f"""select s_suppkey, s_nationkey, lpad(cast(s_nationkey as varchar), 2, '0') as code, a.abbr
from supplier left join (select * from (values {_ABBR_VALUES}) t(fips, abbr)) a on a.fips = s_nationkey""")
def state_code(spark, sf):
    """2-digit state code and postal abbreviation (broadcast 52-row code table)."""
    from .sources import dims
    su = fx.table(spark, sf, "supplier")
    out = su.select("s_suppkey", "s_nationkey", ids.state_code("s_nationkey").alias("code"))
    ab = dims.state_abbr(spark).withColumnRenamed("fips", "s_nationkey")
    return out.join(F.broadcast(ab), "s_nationkey", "left")


@query("to_mercator", P("select county, lon, lat, round(easting, 2) as easting, round(northing, 2) as northing from points"))
def to_mercator(spark, sf):
    """lon/lat -> Web-Mercator."""
    p = _pts(spark, sf)
    return p.select("county", "lon", "lat", F.round("easting", 2).alias("easting"), F.round("northing", 2).alias("northing"))


@query("from_mercator", P(f"""select county, lon, lat,
  round((easting / {d(geo.EARTH_RADIUS)}) / {d(geo.DEG)}, 6) as lon2,
  round(({d(2.0)} * atan(exp(northing / {d(geo.EARTH_RADIUS)})) - {d(geo.math.pi / 2.0)}) / {d(geo.DEG)}, 6) as lat2 from points"""))
def from_mercator(spark, sf):
    """Web-Mercator -> lon/lat (round trip of F10)."""
    p = _pts(spark, sf)
    lon, lat = geo.from_mercator("easting", "northing")
    return p.select("county", "lon", "lat", F.round(lon, 6).alias("lon2"), F.round(lat, 6).alias("lat2"))


_REQ_LABELS = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000004", "Supplier#000000007"]


def _request_sql() -> str:
    # window (-120, -80, 28, 46) clamped to the data extent, then projected
    x0, x1, y0, y1 = _REQ_VIEWPORT
    inside = f"easting between {d(x0)} and {d(x1)} and northing between {d(y0)} and {d(y1)}"
    f = (f"f as (select county, race, net, case when {inside} then {cell_sql('easting', x0, x1, SMALL_W)} end as px, "
         f"case when {inside} then {cell_sql('northing', y0, y1, SMALL_H)} end as py from points "
         f"where net = 1 and race in (1, 2) and county in (select s_suppkey from supplier where s_name in "
         f"({', '.join(repr(x) for x in _REQ_LABELS)})))")
    return _ranked_sql(f)


# the data extent of the fixture lies inside (-125, -67) x (24, 50): the window is clamped only where it exceeds it
_REQ_WINDOW = (-120.0, -80.0, 28.0, 46.0)
_rx0, _ry0 = geo.mercator_xy(_REQ_WINDOW[0], _REQ_WINDOW[2])
_rx1, _ry1 = geo.mercator_xy(_REQ_WINDOW[1], _REQ_WINDOW[3])
_REQ_VIEWPORT = (_rx0, _rx1, _ry0, _ry1)


@query("crossfilter_request", _request_sql())
def crossfilter_request(spark, sf):
    """End to end, one interaction (view "in", map window, race and county
    bar labels) answered by a single GROUPING SETS scan: raster, ranked and
    named county bars, race bars and the row count."""
    req = X.Request(view="in", window_lonlat=_REQ_WINDOW,
                    labels={"race": ["White", "African American"], "county_top": _REQ_LABELS},
                    width=SMALL_W, height=SMALL_H)
    return X.answer(_pts(spark, sf), req, fx.dim_county(spark, sf))


@query("crossfilter_empty", _ranked_sql("f as (select county, race, net, cast(null as integer) as px, cast(null as integer) as py "
                                       "from points where lon > 1000)"))
def crossfilter_empty(spark, sf):
    """A selection without a row, computed from the points: no bars, no cells, no total."""
    pts = _pts(spark, sf).where(F.col("lon") > 1000)
    return X.answer(pts, X.Request(view="net", width=SMALL_W, height=SMALL_H), fx.dim_county(spark, sf))


@query("crossfilter_bars", _ranked_sql("f as (select county, race, net, cast(null as integer) as px, cast(null as integer) as py "
                                      "from points where net in (0, 1))"))
def crossfilter_bars(spark, sf):
    """Top and bottom 15 of all counties, named, from the one scan."""
    return X.ranked(X.crossfilter_all(_pts(spark, sf), "total"), fx.dim_county(spark, sf))


def _null_f() -> str:
    inside = viewport_sql()
    return (f"f as (select county, race, net, case when {inside} then {cell_sql('easting', *VIEWPORT[:2], SMALL_W)} end as px, "
            f"case when {inside} then {cell_sql('northing', *VIEWPORT[2:], SMALL_H)} end as py from ({fx_sql.POINTS_NULLS}) p1 where net in (0, 1))")


@query("crossfilter_null_county", _ranked_sql(_null_f(), no_nulls=True))
def crossfilter_null_county(spark, sf):
    """Rows without a county, a race or a coordinate make no bar and no
    cell of their own, and count for the other groups."""
    pts = fx.points_with_nulls(spark, sf)
    found = X.crossfilter_all(pts, "total", viewport=VIEWPORT, width=SMALL_W, height=SMALL_H)
    return X.ranked(found, fx.dim_county(spark, sf))


@query("count_by_null_county", f"select county, count(net) as cnt from ({fx_sql.POINTS_NULLS}) p where county is not null group by county")
def count_by_null_county(spark, sf):
    """A3: a null key is no group."""
    return A.count_by(fx.points_with_nulls(spark, sf), "county")


@query("nth_row_deep", "select o_orderkey, o_custkey from orders order by o_orderkey limit 1 offset 12345"
       .replace("12345", "(select count(*) * 4 // 5 from orders)"))
def nth_row_deep(spark, sf):
    """A row four fifths down a defined order, found through the range sort."""
    o = fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return topk.nth_row(o, o.count() * 4 // 5, "o_orderkey", near=0)


_ODD_CW = """select case when l_partkey % 11 = 0 then null else l_partkey end as ID10,
  case when l_suppkey % 7 = 0 then null else l_suppkey end as ID20 from lineitem"""


@query("row_number_null_key", f"select ID10, rn, count(*) as n from (select ID10, row_number() over (partition by ID10 "
                              f"order by ID20 nulls first) as rn from ({_ODD_CW}) c) t group by ID10, rn")
def row_number_null_key(spark, sf):
    """Rows with a null group key are numbered as a group of their own, large groups included."""
    out = windows.number_within_group(fx.crosswalk_with_nulls(spark, sf), "ID10", ["ID20"], out="rn", max_rows=64)
    return out.groupBy("ID10", "rn").agg(F.count(F.lit(1)).alias("n"))


@query("window_freq_null_key", f"select ID10, ID20, count(*) over (partition by ID10) as freq from ({_ODD_CW}) c")
def window_freq_null_key(spark, sf):
    """Frequency of the null key too."""
    return windows.window_freq(fx.crosswalk_with_nulls(spark, sf), "ID10")


@query("bfill_sparse", """select k, v, first(v ignore nulls) over (order by k rows between current row and unbounded following) as v_filled
  from (select (o_orderkey * 7919 + 3) * 1000003 as k, case when o_orderkey % 5 <> 0 then null else o_custkey end as v from orders) o""")
def bfill_sparse(spark, sf):
    """Backward fill along sparse 15-digit keys, most values missing."""
    o = fx.table(spark, sf, "orders").select(
        ((F.col("o_orderkey") * 7919 + 3) * 1000003).alias("k"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey")).alias("v"))
    return windows.bfill(o, "v", "k", out="v_filled")


@query("filter_isin_many", P(f"select {_ROW} from points where county % 3 = 0"))
def filter_isin_many(spark, sf):
    """P10: membership in a table of ids (semi join)."""
    ids_df = fx.dim_county(spark, sf).where(F.col("id") % 3 == 0).select("id")
    return filters.filter_isin(_pts(spark, sf), "county", ids_df).select(*_ROW.split(", "))

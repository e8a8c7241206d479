"""Cross-filter queries over the individual point table.

One request = box select + view filter + category selections, then four
consumers of the same filtered rows: a 2-D raster over the viewport, the
race histogram, the top and bottom county bars and the row count.  Each
consumer is a separate function, and :func:`crossfilter_all` answers all of
them in a single scan with ``GROUPING SETS``.

Only the aggregates (at most one row per county, race or non-empty cell)
ever leave the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import geo
from ..operators import aggregates as A, filters, raster as R, topk
from ..session import checkpoint_dir
from ..schemas import CANVAS_H, CANVAS_W, RACE_NAMES, TOP_N


def filtered(points: DataFrame, view: str = "total", box=None, selections=None,
             x: str = "easting", y: str = "northing") -> DataFrame:
    """Box select (P9), view filter (P12) and category selections (P10)."""
    df = filters.box_select(points, box, x, y)
    df = filters.filter_view(df, view)
    return filters.filter_selections(df, selections)


def raster_agg_for_view(view: str) -> tuple[str, str]:
    """(aggregate, column) the map shows for a view."""
    if view == "race":
        return "mean", "race"
    if view == "net":
        return "mean", "net"
    return "count", "net"


def view_raster(df: DataFrame, view: str, viewport, width: int = CANVAS_W, height: int = CANVAS_H,
                x: str = "easting", y: str = "northing") -> DataFrame:
    agg, col = raster_agg_for_view(view)
    return R.raster(df, viewport, width, height, agg, col, x, y)


def county_counts(df: DataFrame) -> DataFrame:
    """A3: non-null ``net`` per county; rows without a county make no bar."""
    return A.count_by(df, "county")


def decode(bars: DataFrame, dim: DataFrame, key: str = "county") -> DataFrame:
    """Attach names to at most ``TOP_N`` bars without ever broadcasting
    the (possibly large) dimension.

    The dimension is streamed once through a left-semi join against the
    broadcast bar keys, reduced to one name per key (at most one row per bar),
    and that bounded table is broadcast into a left join that keeps every bar.
    """
    keys = bars.select(key)
    names = (dim.select(F.col("id").alias(key), F.col("name"))
             .join(F.broadcast(keys), key, "left_semi")
             .groupBy(key).agg(F.max("name").alias("name")))
    return bars.join(F.broadcast(names), key, "left")


def county_top(df: DataFrame, dim: DataFrame | None = None, n: int = TOP_N) -> DataFrame:
    """The n counties with most rows, ``pos`` 1 = largest."""
    bars = topk.top_n(county_counts(df), "cnt", "county", n)
    return decode(bars, dim) if dim is not None else bars


def county_bottom(df: DataFrame, dim: DataFrame | None = None, n: int = TOP_N) -> DataFrame:
    """T4: the last n of the descending county list, ``pos`` 1 = smallest."""
    bars = topk.bottom_n(county_counts(df), "cnt", "county", n)
    return decode(bars, dim) if dim is not None else bars


def race_names_col(col: str = "race"):
    """J7 for the 8 race codes: an in-plan literal map (no join)."""
    kv = []
    for k, v in RACE_NAMES.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)[F.col(col)]


def race_histogram(df: DataFrame, view: str) -> DataFrame:
    """C4: rows per race, descending; empty for the "out" view (Q15)."""
    agg = A.count_by(df, "race")
    if view == "out":
        agg = agg.where(F.lit(False))
    return agg.withColumn("name", race_names_col("race"))


def row_count(df: DataFrame) -> DataFrame:
    """A4 as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def crossfilter_all(points: DataFrame, view: str = "total", box=None, selections=None,
                    viewport=None, width: int = CANVAS_W, height: int = CANVAS_H,
                    x: str = "easting", y: str = "northing") -> DataFrame:
    """C3 in one scan: ``GROUPING SETS ((county), (race), (px, py), ())``.

    Rows outside the viewport still count for the bars and the total (Q13):
    their cell is null and the null cell group is dropped afterwards.
    Columns: grp, county, race, px, py, cnt (non-null ``net``), n_rows,
    mean_race, mean_net.  A selection without rows has no group, not even the total.
    """
    df = filtered(points, view, box, selections, x, y)
    if viewport is not None:
        (x0, x1), (y0, y1) = R.widened(*viewport[:2]), R.widened(*viewport[2:])
        inside = F.col(x).between(F.lit(float(x0)), F.lit(float(x1))) & \
            F.col(y).between(F.lit(float(y0)), F.lit(float(y1)))
        df = df.withColumns({"px": F.when(inside, R.cell_index(x, x0, x1, width)),
                             "py": F.when(inside, R.cell_index(y, y0, y1, height))})
    else:
        df = df.withColumns({"px": F.lit(None).cast("int"), "py": F.lit(None).cast("int")})
    g = df.groupingSets([["county"], ["race"], ["px", "py"], []], "county", "race", "px", "py").agg(
        F.grouping_id().alias("gid"),
        F.count("net").alias("cnt"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("race").cast("double")).alias("mean_race"),
        F.avg(F.col("net").cast("double")).alias("mean_net"))
    # grouping_id bits (county, race, px, py): 1 = aggregated away.
    grp = (F.when(F.col("gid") == 7, "county").when(F.col("gid") == 11, "race")
           .when(F.col("gid") == 12, "cell").otherwise("total"))
    out = g.withColumn("grp", grp).drop("gid")
    # a null key makes no bar and no cell; its rows still count for the other groups
    keep = F.when(F.col("grp") == "cell", F.col("px").isNotNull() & F.col("py").isNotNull()) \
        .when(F.col("grp") == "county", F.col("county").isNotNull()) \
        .when(F.col("grp") == "race", F.col("race").isNotNull()).otherwise(F.lit(True))
    if view == "out":
        keep = keep & (F.col("grp") != "race")
    return out.where(keep).select("grp", "county", "race", "px", "py", "cnt", "n_rows", "mean_race", "mean_net")


def ranked(answers: DataFrame, dim_county: DataFrame | None = None, n: int = TOP_N) -> DataFrame:
    """The rows of :func:`crossfilter_all` as a dashboard shows them: county
    bars with ``pos_top`` (1 = largest) and ``pos_bottom`` (1 = smallest), only
    those within ``n`` of either end, and ``name`` for counties and races.

    The answers (at most a row per county, race and non-empty cell) are
    checkpointed once.  Both ends of the county list are top-k's, in which each
    task keeps ``n`` rows; the cells and races pass no sort at all.  The two
    orders are each other's reverse, so a place from one end and the number of
    counties give the place from the other.
    """
    checkpoint_dir(answers.sparkSession)
    found = answers.checkpoint(eager=True)
    counties = found.where("grp = 'county'")
    after = F.lit(counties.count() + 1).cast("int")
    top = topk.top_n(counties, "cnt", "county", n).withColumnRenamed("pos", "pos_top")
    top = top.withColumn("pos_bottom", after - F.col("pos_top"))
    bottom = topk.bottom_n(counties, "cnt", "county", n).withColumnRenamed("pos", "pos_bottom")
    bottom = bottom.withColumn("pos_top", after - F.col("pos_bottom")).where(F.col("pos_top") > n)
    bars = top.unionByName(bottom)
    bars = decode(bars, dim_county) if dim_county is not None else bars.withColumn("name", F.lit(None).cast("string"))
    none = F.lit(None).cast("int")
    rest = found.where("grp <> 'county'").withColumns({
        "pos_top": none, "pos_bottom": none, "name": F.when(F.col("grp") == "race", race_names_col("race"))})
    return rest.unionByName(bars)


def crossfilter(points: DataFrame, view: str = "total", box=None, selections=None,
                viewport=None, dim_county: DataFrame | None = None, width: int = CANVAS_W,
                height: int = CANVAS_H, x: str = "easting", y: str = "northing") -> dict[str, DataFrame]:
    """C3 as named results: raster, race, county_top, county_bottom, count.

    All are parts of one :func:`crossfilter_all`, written once to the
    checkpoint folder (a few rows per county, race and cell), so the points
    are scanned once for all five.
    """
    checkpoint_dir(points.sparkSession)
    found = ranked(crossfilter_all(points, view, box, selections, viewport, width, height, x, y), dim_county)
    found = found.checkpoint(eager=True)
    bars = found.where("grp = 'county'")
    agg, _ = raster_agg_for_view(view)
    value = {"count": F.col("cnt"), "mean": F.col("mean_race" if view == "race" else "mean_net")}[agg]
    out = {
        "race": found.where("grp = 'race'").select("race", "cnt", "name"),
        "county_top": bars.where(F.col("pos_top") <= TOP_N).select("county", "cnt", F.col("pos_top").alias("pos"), "name"),
        "county_bottom": bars.where(F.col("pos_bottom") <= TOP_N).select("county", "cnt", F.col("pos_bottom").alias("pos"), "name"),
        "count": found.where("grp = 'total'").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")),
    }
    if viewport is not None:
        out["raster"] = found.where("grp = 'cell'").select("px", "py", value.alias("value"))
    return out


# --- one dashboard interaction ------------------------------------------------

@dataclass
class Request:
    """One interaction: view, optional map window and box (lon/lat), and bar
    selections by label (``race`` names, ``county_top`` / ``county_bottom``
    county names)."""
    view: str = "total"
    window_lonlat: tuple | None = None      # (lon0, lon1, lat0, lat1) of the map
    box_lonlat: tuple | None = None         # (lon0, lon1, lat0, lat1) box select
    labels: dict = field(default_factory=dict)
    width: int = CANVAS_W
    height: int = CANVAS_H


def data_extent(points: DataFrame, x: str = "easting", y: str = "northing") -> tuple:
    """(x0, x1, y0, y1) of the data - one aggregated row to the driver;
    None where there is no point with both coordinates."""
    r = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return None if r[0] is None else (r[0], r[1], r[2], r[3])


def answer(points: DataFrame, req: Request, dim_county: DataFrame, extent: tuple | None = None) -> DataFrame:
    """The whole update of one interaction, as one ``GROUPING SETS`` scan.

    * the map window is clamped to the data extent (F12) and projected (F10);
      without a window the data extent is the viewport;
    * the box corners are projected (P9 on easting / northing);
    * bar labels become ids: race names through the code table, county names
      through a semi join with the county dimension (P11);
    * the result is :func:`crossfilter_all`, ranked and named
      (:func:`ranked`): raster cells, top and bottom counties, race bars and
      the row count.

    Points that all share a coordinate, or no points at all, are answered like
    any others: the raster then has one column, or no cell.  ``extent`` (from :func:`data_extent`) can be computed once per dataset.
    """
    ext = extent or data_extent(points)
    if ext is None:
        viewport = None
    elif req.window_lonlat:
        lon0, lon1, lat0, lat1 = req.window_lonlat
        dlon0, dlat0 = geo.lonlat_of(ext[0], ext[2])
        dlon1, dlat1 = geo.lonlat_of(ext[1], ext[3])
        lon0, lon1 = max(min(lon0, lon1), dlon0), min(max(lon0, lon1), dlon1)
        lat0, lat1 = max(min(lat0, lat1), dlat0), min(max(lat0, lat1), dlat1)
        (x0, y0), (x1, y1) = geo.mercator_xy(lon0, lat0), geo.mercator_xy(lon1, lat1)
        viewport = (x0, x1, y0, y1)
    else:
        viewport = ext
    box = None
    if req.box_lonlat:
        b0, b1, c0, c1 = req.box_lonlat
        (bx0, by0), (bx1, by1) = geo.mercator_xy(b0, c0), geo.mercator_xy(b1, c1)
        box = (bx0, bx1, by0, by1)
    df = points
    names_to_race = {v: k for k, v in RACE_NAMES.items()}
    sel = {}
    for chart, labels in (req.labels or {}).items():
        if chart == "race":
            sel["race"] = [names_to_race[n] for n in labels]
        else:
            df = filters.filter_by_labels(df, "county", dim_county, labels)
    found = crossfilter_all(df, req.view, box=box, selections=sel, viewport=viewport,
                            width=req.width, height=req.height)
    return ranked(found, dim_county)

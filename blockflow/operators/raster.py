"""2-D density rasters (A11-A14) as sparse DataFrames ``(px, py, value)``.

A canvas of ``width x height`` cells over ``viewport = (x0, x1, y0, y1)``:
``px = floor((x - x0) * width / (x1 - x0))``, the upper edge belongs to the
last cell, rows outside the viewport are dropped.  ``py`` counts from the
bottom (``y0``).  Only non-empty cells exist, so the result is at most
``min(rows, width * height)`` rows and is produced by one partial/final hash
aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import checkpoint_dir
from .ranges import placed

AGGS = ("count", "mean", "sum", "min", "max")


def widened(lo: float, hi: float) -> tuple[float, float]:
    """An extent without width gets half a unit on each side (relative to its
    size, so that it stays a width for large coordinates)."""
    if hi > lo:
        return float(lo), float(hi)
    half = max(0.5, abs(lo) * 1e-9)
    return lo - half, lo + half


def cell_index(c, lo: float, hi: float, n: int) -> Column:
    """Cell index on one axis, null outside ``[lo, hi]``."""
    col = F.col(c) if isinstance(c, str) else c
    lo, hi = widened(lo, hi)
    idx = F.floor(((col - F.lit(float(lo))) * F.lit(float(n))) / F.lit(float(hi - lo))).cast("int")
    return F.when(col.between(F.lit(float(lo)), F.lit(float(hi))), F.least(idx, F.lit(n - 1)))


def with_cells(df: DataFrame, viewport, width: int, height: int,
               x: str = "easting", y: str = "northing") -> DataFrame:
    x0, x1, y0, y1 = viewport
    return df.withColumns({"px": cell_index(x, x0, x1, width), "py": cell_index(y, y0, y1, height)})


def _agg_expr(agg: str, col: str) -> Column:
    if agg == "count":
        return F.count(F.col(col))
    if agg == "mean":
        return F.avg(F.col(col).cast("double"))
    if agg == "sum":
        return F.sum(F.col(col))
    if agg == "min":
        return F.min(F.col(col))
    if agg == "max":
        return F.max(F.col(col))
    raise ValueError(f"unknown raster aggregate {agg!r}")


def raster(df: DataFrame, viewport, width: int, height: int, agg: str = "count",
           column: str = "net", x: str = "easting", y: str = "northing") -> DataFrame:
    """Sparse raster with one aggregate per non-empty cell."""
    (x0, x1), (y0, y1) = widened(*viewport[:2]), widened(*viewport[2:])
    inside = F.col(x).between(F.lit(float(x0)), F.lit(float(x1))) & \
        F.col(y).between(F.lit(float(y0)), F.lit(float(y1)))
    cells = with_cells(df.where(inside), viewport, width, height, x, y)
    return cells.groupBy("px", "py").agg(_agg_expr(agg, column).alias("value"))


def raster_stats(r: DataFrame, value: str = "value") -> DataFrame:
    """Min, max and sum over the cells of a raster (one row)."""
    return r.agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"),
                 F.sum(value).alias("vsum"), F.count(F.lit(1)).alias("cells"))


#: Colour scales: how far along the palette a shade t in [0, 1] lies.  The scale
#: places colours at powers of the palette position (or at its exponential), so
#: the way back is a root (or a logarithm).
PALETTE = {
    "linear": lambda t: t,
    "sqrt": lambda t: F.sqrt(t),
    "cbrt": lambda t: F.cbrt(t),
    "log": lambda t: F.log10(F.lit(9.0) * t + F.lit(1.0)),
}


def raster_scaled(r: DataFrame, n_colors: int = 9, how: str = "log", palette: str = "linear",
                  value: str = "value") -> DataFrame:
    """Shading of the cell values to ``t`` in [0, 1] and a palette bin
    ``0..n_colors-1``; null cells have neither.

    Values are shifted by the smallest one, so a mean raster with negative
    cells shades like any other, then (``how="log"``) taken as log(1 + shift),
    then divided by the largest.  ``palette`` names the colour scale.  The
    raster (at most one row per cell of the canvas) is checkpointed once; its
    extent is two numbers.
    """
    checkpoint_dir(r.sparkSession)
    r = r.checkpoint(eager=True)
    f = F.log1p if how == "log" else (lambda c: c)
    v = F.col(value).cast("double")
    st = r.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
    if st["lo"] is None:
        return r.withColumns({"t": F.lit(None).cast("double"), "bin": F.lit(None).cast("int")})
    shift = v - F.lit(st["lo"])
    t = f(shift) / f(F.lit(st["hi"] - st["lo"])) if st["hi"] > st["lo"] else F.when(v.isNotNull(), F.lit(0.0))
    out = r.withColumn("t", t)
    place = F.floor(PALETTE[palette](F.col("t")) * F.lit(float(n_colors))).cast("int")
    return out.withColumn("bin", F.when(F.col("t").isNotNull(), F.least(place, F.lit(n_colors - 1))))


# --- spreading and equalised shading (A14) ----------------------------------------

def disc(radius: int) -> list[tuple[int, int]]:
    """Offsets of the cells whose centre is within ``radius`` + 1/2 of a cell's."""
    r = range(-radius, radius + 1)
    return [(i, j) for i in r for j in r if math.hypot(i, j) <= radius + 0.5]


def _moved(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every cell at each of the offsets from its place."""
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    d = cells.withColumn("__o", at)
    return d.withColumns({"px": F.col("px") + F.col("__o.i"), "py": F.col("py") + F.col("__o.j")}).drop("__o")


def neighbours(r: DataFrame, reach: int) -> DataFrame:
    """px, py, n: the cells of ``r`` and how many others stand within ``reach``
    cells in either direction.  Sums along x, then along y, so a cell takes
    part in 2 (2 reach + 1) rows, not in the square of it."""
    cells = r.select("px", "py")
    line = [(i, 0) for i in range(-reach, reach + 1)]
    along = _moved(cells, line).groupBy("px", "py").agg(F.count(F.lit(1)).alias("n"))
    both = _moved(along, [(j, i) for i, j in line]).groupBy("px", "py").agg(F.sum("n").alias("n"))
    return cells.join(both, ["px", "py"]).withColumn("n", F.col("n") - 1)


def density(r: DataFrame, reach: int) -> float:
    """Share of the cells that have another one within ``reach`` cells (one number; 1.0 without cells)."""
    s = neighbours(r, reach).agg(F.count(F.lit(1)), F.count_if(F.col("n") > 0)).first()
    return s[1] / s[0] if s[0] else 1.0


def spread(r: DataFrame, radius: int, width: int, height: int, how: str = "add", value: str = "value") -> DataFrame:
    """Each cell drawn as a disc of ``radius``: a cell of the result holds the
    sum (``how="add"``) or the largest (``"max"``) of the values whose disc
    covers it, inside the canvas.  A stencil over the sparse cells: copies at
    the disc's offsets, added up before the shuffle."""
    agg = {"add": F.sum, "max": F.max}[how]
    d = _moved(r.select("px", "py", value), disc(radius))
    d = d.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))
    return d.groupBy("px", "py").agg(agg(value).alias(value))


def dynamic_spread(r: DataFrame, width: int, height: int, threshold: float = 0.5, most: int = 3, how: str = "add",
                   value: str = "value") -> tuple[DataFrame, int]:
    """(the raster spread so that sparse points can be seen, its radius): the
    radius grows from 1 and stops before the first whose doubled reach finds
    neighbours for over ``threshold`` of the cells, at ``most`` in the end.  The
    raster is checkpointed; each density is one number."""
    checkpoint_dir(r.sparkSession)
    r = r.where(F.col(value).isNotNull()).checkpoint(eager=True)
    radius = 0
    while radius < most and density(r, 2 * (radius + 1)) <= threshold:
        radius += 1
    return (spread(r, radius, width, height, how, value) if radius else r), radius


def raster_equalized(r: DataFrame, n_colors: int = 9, value: str = "value") -> DataFrame:
    """A14 with equalised shading: ``t`` is the share of cells up to a value,
    from 0 at the smallest to 1 at the largest, so each colour bin holds about
    as many cells; null cells have neither ``t`` nor bin.

    A cumulative histogram: values are counted, the counts range-sorted and
    added up inside each range, and the sums before a range are one number per
    range.  The raster is checkpointed once.
    """
    checkpoint_dir(r.sparkSession)
    r = r.checkpoint(eager=True)
    counts = r.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    p = placed(counts, "__v")
    sums = {x[0]: (x[1], x[2]) for x in p.rows.groupBy(p.range).agg(F.sum("__n"), F.min_by("__n", "__v")).collect()}
    before, starts = 0, []
    for k, _ in p.sizes:
        starts.append((k, before))
        before += sums[k][0]
    least = sums[p.sizes[0][0]][1] if p.sizes else 0             # cells of the smallest value
    starts = r.sparkSession.createDataFrame(starts, "r int, s long").toDF(p.range, "__before")
    so_far = Window.partitionBy(p.range).orderBy(p.at).rowsBetween(Window.unboundedPreceding, 0)
    up_to = F.col("__before") + F.sum("__n").over(so_far)
    t = (up_to - F.lit(least)).cast("double") / F.lit(float(before - least)) if before > least else F.lit(0.0)
    scale = p.rows.join(F.broadcast(starts), p.range).select("__v", t.alias("t"))
    out = r.join(scale, F.col(value) == F.col("__v"), "left").drop("__v")
    place = F.floor(F.col("t") * F.lit(float(n_colors))).cast("int")
    return out.withColumn("bin", F.when(F.col("t").isNotNull(), F.least(place, F.lit(n_colors - 1))))

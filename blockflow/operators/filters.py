"""Row selection (P4-P17): view predicates, box select, membership filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# --- fixed values: which migration labels each dashboard view keeps ---------
VIEW_NETS = {
    "total": (0, 1),
    "race": (0, 1),
    "in": (1,),
    "stationary": (0,),
    "out": (-1,),
    "net": None,  # every row
}
# ---------------------------------------------------------------------------

# Bars whose labels refer to the county column.
COUNTY_CHARTS = ("county", "county_top", "county_bottom")

# Above this many ids a membership filter becomes a semi join.
ISIN_MAX = 1000


def view_predicate(view: str, net: str = "net") -> Column:
    """Column predicate for a dashboard view."""
    if view not in VIEW_NETS:
        raise ValueError(f"unknown view {view!r}")
    nets = VIEW_NETS[view]
    if nets is None:
        return F.lit(True)
    if len(nets) == 1:
        return F.col(net) == F.lit(nets[0])
    return F.col(net).isin(*nets)


def filter_view(df: DataFrame, view: str, net: str = "net") -> DataFrame:
    return df if VIEW_NETS.get(view, 0) is None else df.where(view_predicate(view, net))


def race_view_signed(df: DataFrame, race: int | None, col: str = "race") -> DataFrame:
    """All races (None / 0) or one race regardless of in/out sign."""
    if not race:
        return df
    return df.where(F.abs(F.col(col)) == F.lit(race))


def box_predicate(x: str, y: str, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Inclusive 2-D box; corners may come in any order (Q12)."""
    lx, hx = min(x0, x1), max(x0, x1)
    ly, hy = min(y0, y1), max(y0, y1)
    return F.col(x).between(F.lit(lx), F.lit(hx)) & F.col(y).between(F.lit(ly), F.lit(hy))


def box_select(df: DataFrame, box, x: str = "easting", y: str = "northing") -> DataFrame:
    """Keep rows inside ``box = (x0, x1, y0, y1)``."""
    if box is None:
        return df
    return df.where(box_predicate(x, y, *box))


def filter_isin(df: DataFrame, col: str, ids) -> DataFrame:
    """P10: membership filter.

    A short literal list stays an ``IN`` predicate (pushed to the scan); a long
    list or a DataFrame of ids becomes a left-semi join, so no id list is ever
    shipped inside the plan.
    """
    if col in COUNTY_CHARTS:
        col = "county"
    if isinstance(ids, DataFrame):
        keys = ids.select(F.col(ids.columns[0]).alias("__id")).distinct()
        return df.join(keys, F.col(col) == F.col("__id"), "left_semi")
    ids = list(ids)
    if len(ids) <= ISIN_MAX:
        return df.where(F.col(col).isin(ids))
    spark = df.sparkSession
    keys = spark.createDataFrame([(i,) for i in ids], ["__id"])
    return df.join(keys, F.col(col) == F.col("__id"), "left_semi")


def filter_selections(df: DataFrame, selections: dict[str, Iterable] | None) -> DataFrame:
    """P10: several membership filters ANDed (race, county_top, county_bottom)."""
    for col, ids in (selections or {}).items():
        df = filter_isin(df, col, ids)
    return df


def ids_for_labels(dim: DataFrame, labels: Iterable[str], id_col: str = "id",
                   name_col: str = "name") -> DataFrame:
    """Ids of the bars whose labels were selected (a name -> id lookup)."""
    return dim.where(F.col(name_col).isin(list(labels))).select(F.col(id_col).alias("__sel"))


def filter_by_labels(df: DataFrame, col: str, dim: DataFrame, labels: Iterable[str],
                     id_col: str = "id", name_col: str = "name") -> DataFrame:
    """P11 + P10: semi join of points with the dimension rows carrying the labels."""
    if col in COUNTY_CHARTS:
        col = "county"
    sel = ids_for_labels(dim, labels, id_col, name_col)
    return df.join(sel, F.col(col) == F.col("__sel"), "left_semi")


def filter_nonzero(df: DataFrame, col: str) -> DataFrame:
    """P5."""
    return df.where(F.col(col) != 0)


def filter_any_nonzero(df: DataFrame, *cols: str) -> DataFrame:
    """Keep rows where any of the columns is non-zero."""
    cond = F.lit(False)
    for c in cols:
        cond = cond | (F.col(c) != 0)
    return df.where(cond)


def filter_id_range(df: DataFrame, col: str, lo: int, hi: int) -> DataFrame:
    """Inclusive id range (one shard of a state)."""
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))

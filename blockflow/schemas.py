"""Schemas of the census-shaped tables and the fixed code tables."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference's code tables) -------------------
# Race codes; 0 means "All" / race unknown.
RACE_NAMES = {
    0: "All",
    1: "White",
    2: "African American",
    3: "American Indian",
    4: "Asian alone",
    5: "Native Hawaiian",
    6: "Other Race alone",
    7: "Two or More",
}
# State FIPS code -> postal abbreviation (50 states, DC and PR).
STATE_ABBR = {
    1: "AL", 2: "AK", 4: "AZ", 5: "AR", 6: "CA", 8: "CO", 9: "CT", 10: "DE", 11: "DC", 12: "FL",
    13: "GA", 15: "HI", 16: "ID", 17: "IL", 18: "IN", 19: "IA", 20: "KS", 21: "KY", 22: "LA",
    23: "ME", 24: "MD", 25: "MA", 26: "MI", 27: "MN", 28: "MS", 29: "MO", 30: "MT", 31: "NE",
    32: "NV", 33: "NH", 34: "NJ", 35: "NM", 36: "NY", 37: "NC", 38: "ND", 39: "OH", 40: "OK",
    41: "OR", 42: "PA", 44: "RI", 45: "SC", 46: "SD", 47: "TN", 48: "TX", 49: "UT", 50: "VT",
    51: "VA", 53: "WA", 54: "WV", 55: "WI", 56: "WY", 72: "PR",
}
# Web-Mercator sphere radius (EPSG:3857), metres.
EARTH_RADIUS = 6378137.0
# Raster canvas of every map refresh.
CANVAS_W, CANVAS_H = 3840, 2160
# Number of bars in the top / bottom county charts.
TOP_N = 15
# ---------------------------------------------------------------------------

XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(XY)
POLYGON = T.ArrayType(RING)            # rings: first outer, rest holes (even-odd)
MULTIPOLYGON = T.ArrayType(POLYGON)    # parts
MULTIPOLYGON_DDL = "array<array<array<struct<x:double,y:double>>>>"

BLOCK2010_CSV = T.StructType([
    T.StructField("GISJOIN", T.StringType()),
    T.StructField("STATEA", T.IntegerType()),
    *[T.StructField(f"H7X00{k}", T.LongType()) for k in range(1, 9)],
])

BLOCK2020_CSV = T.StructType([
    T.StructField("GISJOIN", T.StringType()),
    T.StructField("GEOCODE", T.LongType()),
    T.StructField("STATEA", T.IntegerType()),
    T.StructField("COUNTY", T.StringType()),
    T.StructField("U7B001", T.IntegerType()),
    *[T.StructField(f"U7B00{k}", T.IntegerType()) for k in range(3, 10)],
])

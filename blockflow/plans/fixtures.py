"""Driver tables -> census-shaped tables.

These adapters only rename and re-shape the TPC-H-like test tables into the
schemas the jobs expect (mapping documented in FIXTURES.md section 3).  They
do none of the jobs' work; every job takes any DataFrame of that schema.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import geo

RACES = range(1, 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual point table: county, state, net, race, lon, lat, easting, northing."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    su = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(su, li.l_suppkey == su.s_suppkey)
    net = (F.when(F.col("l_returnflag") == "N", 1)
           .when(F.col("l_returnflag") == "A", 0).otherwise(-1))
    race = F.when(F.col("l_returnflag") == "R", 0).otherwise(F.col("l_linenumber"))
    lon = F.lit(-125.0) + F.lit(58.0) * (F.col("l_extendedprice") - F.lit(900.0)) / F.lit(104100.0)
    lat = F.lit(24.0) + F.lit(26.0) * (F.col("l_quantity") - F.lit(1.0) + F.lit(9.9) * F.col("l_discount")) / F.lit(50.0)
    p = j.select(F.col("l_suppkey").alias("county"), F.col("s_nationkey").alias("state"),
                 net.cast("int").alias("net"), race.cast("int").alias("race"),
                 lon.alias("lon"), lat.alias("lat"))
    x, y = geo.to_mercator("lon", "lat")
    return p.withColumns({"easting": x, "northing": y})


def points_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with counties, races and coordinates missing in some rows."""
    p = points(spark, sf_dir)
    return p.withColumns({"easting": F.when((F.col("race") != 5) | (F.col("net") != 0), F.col("easting")),
                          "race": F.when(F.col("county") % 7 != 2, F.col("race")),
                          "county": F.when(F.col("county") % 9 != 4, F.col("county"))})


def _race_sums(prefix: str):
    return [F.sum(F.when(F.col("l_linenumber") == k, 1).otherwise(0)).cast("long").alias(f"{prefix}{k}")
            for k in RACES]


def block10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2010 blocks: ID10, P10, R101..R107."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "F")
    return li.groupBy(F.col("l_partkey").alias("ID10")).agg(
        F.count(F.lit(1)).alias("P10"), *_race_sums("R10"))


def block20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2020 blocks: ID20, STATE, COUNTY, P20, R201..R207.

    Lineitems are aggregated per supplier before the (one row per key)
    supplier and nation lookups, so the joins see one row per block.
    """
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == "O")
    agg = li.groupBy(F.col("l_suppkey").alias("ID20")).agg(
        F.count(F.lit(1)).alias("P20"), *_race_sums("R20"))
    su = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ID20"),
                                                 F.col("s_nationkey").alias("STATE"))
    na = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("STATE"),
                                               F.col("n_name").alias("COUNTY"))
    return (agg.join(su, "ID20").join(na, "STATE")
            .select("ID20", "STATE", "COUNTY", "P20", *[f"R20{k}" for k in RACES]))


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many-to-many block crosswalk ID10 -> ID20."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_partkey").alias("ID10"), F.col("l_suppkey").alias("ID20")).distinct()


def crosswalk_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crosswalk rows with repeats and with missing ids on either side."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("ID10"),
                     F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("ID20"))


def dim_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def dim_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def _nation_ring():
    n = F.col("n_nationkey")
    x0 = F.lit(-125.0) + F.lit(11.6) * (n % 5)
    y0 = F.lit(24.0) + F.lit(5.2) * F.floor(n / F.lit(5))
    x1, y1 = x0 + F.lit(11.6), y0 + F.lit(5.2)
    xm, ym = x0 + F.lit(5.8), y0 + F.lit(2.6)
    return geo.ring_of((x0, y0), (x1, y0), (x1, ym), (xm, ym), (xm, y1), (x0, y1))


def state_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State polygons (lon/lat): State_Code, State_Name, geometry (polygon = rings)."""
    na = table(spark, sf_dir, "nation")
    return na.select(F.col("n_nationkey").alias("State_Code"), F.col("n_name").alias("State_Name"),
                     F.array(_nation_ring()).alias("geometry"))


def region_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multipolygons: every nation ring of a region is one part."""
    na = table(spark, sf_dir, "nation")
    return (na.groupBy(F.col("n_regionkey").alias("region"))
            .agg(F.collect_list(F.array(_nation_ring())).alias("geometry")))


def block_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block polygons: one triangle per supplier (GEOID20 = s_suppkey)."""
    s = F.col("s_suppkey")
    cx = F.lit(-120.0) + F.lit(5.0) * (s % 10)
    cy = F.lit(26.0) + F.lit(2.0) * (F.floor(s / F.lit(10)) % 10)
    ring = geo.ring_of((cx - F.lit(1.0), cy - F.lit(0.8)), (cx + F.lit(1.0), cy - F.lit(0.8)),
                       (cx, cy + F.lit(0.8)))
    return table(spark, sf_dir, "supplier").select(s.alias("GEOID20"), F.array(ring).alias("geometry"))


def signed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net-migration points with signed race codes (+ in, - out), stationary rows dropped."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") != "A")
    sign = F.when(F.col("l_returnflag") == "N", 1).otherwise(-1)
    return li.select(F.col("l_suppkey").alias("county"),
                     (F.col("l_linenumber") * sign).cast("int").alias("race"))


def gisjoin_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier rows with a GISJOIN-style id text (state, county, block parts)."""
    su = table(spark, sf_dir, "supplier")
    st = F.col("s_nationkey").cast("string")
    g = F.concat(F.lit("G"), F.lpad(st, 2, "0"), F.lit("0"), F.lpad(st, 3, "0"), F.lit("0"),
                 F.lpad(F.col("s_suppkey").cast("string"), 10, "0"))
    return su.select("s_suppkey", "s_nationkey", g.alias("GISJOIN"))


def county_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier names dressed as county names with accents and CamelCase."""
    su = table(spark, sf_dir, "supplier")
    raw = F.concat(F.lit("Doña Ana "), F.col("s_name"), F.lit(" LaSalle McLean County"))
    return su.select(F.col("s_suppkey").alias("id"), raw.alias("COUNTY"))


def block_multipolygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier a multipolygon: its triangle, plus (when s_suppkey % 3 != 0)
    a second, disjoint triangle 2.5 to the east."""
    s = F.col("s_suppkey")
    cx = F.lit(-120.0) + F.lit(5.0) * (s % 10)
    cy = F.lit(26.0) + F.lit(2.0) * (F.floor(s / F.lit(10)) % 10)

    def tri(x):
        return F.array(geo.ring_of((x - F.lit(1.0), cy - F.lit(0.8)), (x + F.lit(1.0), cy - F.lit(0.8)),
                                   (x, cy + F.lit(0.8))))

    parts = F.when(s % 3 != 0, F.array(tri(cx), tri(cx + F.lit(2.5)))).otherwise(F.array(tri(cx)))
    return table(spark, sf_dir, "supplier").select(s.alias("GEOID20"), parts.alias("geometry"))


def _box(x0, x1, y0, y1):
    return geo.ring_of((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def mixed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of very different sizes: poly, geometry (one large box, one thin
    strip, one small box per supplier)."""
    s = F.col("s_suppkey")
    x, y = F.lit(-124.0) + F.lit(0.05) * (s % 1000), F.lit(26.0) + F.lit(0.02) * (s % 997)
    small = table(spark, sf_dir, "supplier").select((s + 10).alias("poly"), F.array(_box(x, x + F.lit(0.04), y, y + F.lit(0.3))).alias("geometry"))
    one = spark.range(1)
    large = one.select(F.lit(0).cast("long").alias("poly"), F.array(_box(F.lit(-124.0), F.lit(-70.0), F.lit(25.0), F.lit(48.0))).alias("geometry"))
    thin = one.select(F.lit(1).cast("long").alias("poly"), F.array(_box(F.lit(-124.0), F.lit(-68.0), F.lit(33.3), F.lit(33.3) + F.lit(1e-3))).alias("geometry"))
    return small.unionByName(large).unionByName(thin)


def odd_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bow-ties (id = s_suppkey) and squares whose hole is the first ring (id + 1000000)."""
    s = F.col("s_suppkey")
    x, y, w = F.lit(-120.0) + F.lit(5.0) * (s % 10), F.lit(26.0) + F.lit(2.0) * (F.floor(s / F.lit(10)) % 10), F.lit(1.0)
    su = table(spark, sf_dir, "supplier")
    bow = geo.ring_of((x, y), (x + w, y + w), (x + w, y), (x, y + w))
    q = F.lit(0.25)
    hole = _box(x + q, x + w - q, y + q, y + w - q)
    return su.select(s.alias("id"), F.array(bow).alias("geometry")).unionByName(
        su.select((s + 1000000).alias("id"), F.array(hole, _box(x, x + w, y, y + w)).alias("geometry")))

"""Source and sink queries.

Each writes census-shaped data derived from the driver tables into a fresh
folder under the shared checkpoint directory, reads it back through the
library's readers and returns the re-read DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from .catalog import query
from .functions import ids
from .plans import datasets as DS, fixtures as fx, stages
from .plans import fixtures_sql as S
from .session import scratch_path
from .sources import files, sinks

_B20 = "ID20, STATE, COUNTY, P20, R201, R202, R203, R204, R205, R206, R207"
_PROW = "county, state, net, race, lon, lat"

BLOCK20_SCHEMA = T.StructType(
    [T.StructField("ID20", T.LongType()), T.StructField("STATE", T.IntegerType()),
     T.StructField("COUNTY", T.StringType()), T.StructField("P20", T.LongType())]
    + [T.StructField(f"R20{k}", T.LongType()) for k in range(1, 8)])

REL_COLS = ["STATE_2010", "COUNTY_2010", "TRACT_2010", "BLK_2010",
            "STATE_2020", "COUNTY_2020", "TRACT_2020", "BLK_2020"]


def _relationship_rows(spark, sf):
    """Crosswalk pairs dressed as relationship-file columns (fixture)."""
    cw = fx.crosswalk(spark, sf)
    parts = {}
    for yr, key in (("2010", "ID10"), ("2020", "ID20")):
        k = F.col(key)
        parts.update({f"STATE_{yr}": (k % 50 + 1).cast("int"), f"COUNTY_{yr}": (k % 997).cast("int"),
                      f"TRACT_{yr}": k.cast("int"), f"BLK_{yr}": (k % 7919).cast("int")})
    return cw.select(*[parts[c].alias(c) for c in REL_COLS])


def _rel_id_sql(yr: str, key: str) -> str:
    def rj(e, n):
        return (f"(case when length(cast({e} as varchar)) >= {n} then cast({e} as varchar) "
                f"else lpad(cast({e} as varchar), {n}, '0') end)")
    return (f"cast({rj(f'{key} % 50 + 1', 2)} || {rj(f'{key} % 997', 3)} || {rj(key, 6)} || "
            f"{rj(f'{key} % 7919', 4)} as bigint)")


@query("scan_csv_pruned", f"select ID20, P20 from ({S.BLOCK20}) b")
def scan_csv_pruned(spark, sf):
    """CSV with an explicit schema, two of eleven columns kept."""
    p = sinks.write_csv(fx.block20(spark, sf), scratch_path(spark, "block20_csv"))
    return files.read_csv(spark, p, BLOCK20_SCHEMA, cols=["ID20", "P20"])


@query("scan_csv_pipe", f"select distinct {_rel_id_sql('2010', 'ID10')} as ID10, {_rel_id_sql('2020', 'ID20')} as ID20 "
                        f"from ({S.CROSSWALK}) c")
def scan_csv_pipe(spark, sf):
    """S2 + F3: pipe-delimited relationship files with a byte-order mark before
    the header, read back and turned into 15-digit block ids."""
    rel = _relationship_rows(spark, sf)
    # the first header name carries the byte-order mark, as in the published files
    rel = rel.withColumnRenamed("STATE_2010", "﻿STATE_2010")
    p = sinks.write_csv(rel, scratch_path(spark, "relationship"), sep="|")
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in REL_COLS])
    r = files.read_csv(spark, p, schema, sep="|")
    out = r.select(ids.compose_block_id("STATE_2010", "COUNTY_2010", "TRACT_2010", "BLK_2010").alias("ID10"),
                   ids.compose_block_id("STATE_2020", "COUNTY_2020", "TRACT_2020", "BLK_2020").alias("ID20"))
    return out.distinct()


@query("scan_csv_latin1", f"select id, COUNTY from ({S.COUNTY_TEXT}) c")
def scan_csv_latin1(spark, sf):
    """S3: Latin-1 encoded CSV text read back intact."""
    c = fx.county_text(spark, sf)
    p = sinks.write_csv(c, scratch_path(spark, "county_latin1"), encoding="ISO-8859-1")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("COUNTY", T.StringType())])
    return files.read_csv(spark, p, schema, encoding="ISO-8859-1")


@query("scan_multi_file", f"select ID20, STATE, P20 from ({S.BLOCK20}) b")
def scan_multi_file(spark, sf):
    """One CSV per state, read in one scan; the state comes from the file path."""
    base = scratch_path(spark, "by_state_csv")
    fx.block20(spark, sf).write.partitionBy("STATE").option("header", True).csv(base)
    schema = T.StructType([f for f in BLOCK20_SCHEMA.fields if f.name != "STATE"])
    df = files.read_csv_files(spark, base + "/STATE=*/*.csv", schema)
    state = F.regexp_extract(F.col("source_file"), r"STATE=(\d+)", 1).cast("int")
    return df.select("ID20", state.alias("STATE"), "P20")


@query("scan_parquet", f"select {_B20} from ({S.BLOCK20}) b")
def scan_parquet(spark, sf):
    """Parquet write and read back."""
    p = sinks.write_parquet(fx.block20(spark, sf), scratch_path(spark, "block20_pq"), sort_by=["STATE", "ID20"])
    return files.read_parquet(spark, p)


def _points_by_state(spark, sf):
    pts = fx.points(spark, sf).select(*_PROW.split(", "))
    return sinks.write_by_state(pts, scratch_path(spark, "points_by_state"))


@query("dataset_by_state", f"select {_PROW} from ({S.POINTS}) p where state = 7")
def dataset_by_state(spark, sf):
    """One state's points (partition pruning on the state directory)."""
    return files.read_dataset(spark, _points_by_state(spark, sf), 7).select(*_PROW.split(", "))


@query("dataset_all", f"select {_PROW} from ({S.POINTS}) p")
def dataset_all(spark, sf):
    """S6: "USA" - every state."""
    return files.read_dataset(spark, _points_by_state(spark, sf), "USA").select(*_PROW.split(", "))


@query("list_states", f"select distinct cast(s_nationkey as varchar) as name from lineitem join supplier "
                      f"on l_suppkey = s_suppkey union all select 'USA'")
def list_states(spark, sf):
    """States available in the dataset, plus "USA"."""
    return files.list_states(files.read_dataset(spark, _points_by_state(spark, sf)))


@query("scan_polygons", f"select GEOID20, 4 as n_vertices, round(abs(((cx + {S.d(1)}) - (cx - {S.d(1)})) * "
                        f"((cy + {S.d(0.8)}) - (cy - {S.d(0.8)})) / 2), 6) as area from ({S.BLOCK_TRIANGLES}) t")
def scan_polygons(spark, sf):
    """Polygons stored as JSON ring text, parsed with a declared schema."""
    from .functions import geo
    poly = fx.block_polygon(spark, sf).select("GEOID20", F.to_json(F.array(F.col("geometry"))).alias("geometry"))
    p = sinks.write_parquet(poly, scratch_path(spark, "polygons_json"))
    r = files.read_polygons(spark, p)
    return r.select("GEOID20", F.size(F.flatten(F.flatten("geometry"))).alias("n_vertices"),
                    F.round(geo.multipolygon_area("geometry"), 6).alias("area"))


@query("cached_view", f"select state, count(*) as cnt from ({S.POINTS}) p where net = 1 group by state")
def cached_view(spark, sf):
    """A published (cached, named) dataset answering SQL."""
    name = files.publish(fx.points(spark, sf).select(*_PROW.split(", ")))
    try:
        found = spark.sql(f"select state, count(*) as cnt from {name} where net = 1 group by state")
        return stages.materialize(found, "cached_view")
    finally:
        files.unpublish(spark, name)


@query("sink_csv_roundtrip", f"select ID20, STATE, P20 from ({S.BLOCK20}) b")
def sink_csv_roundtrip(spark, sf):
    """K1: CSV sink with header and no index column, read back."""
    p = sinks.write_csv(fx.block20(spark, sf).select("ID20", "STATE", "P20"), scratch_path(spark, "k1"))
    schema = T.StructType([T.StructField("ID20", T.LongType()), T.StructField("STATE", T.IntegerType()),
                           T.StructField("P20", T.LongType())])
    return files.read_csv(spark, p, schema)


@query("sink_parquet_roundtrip", f"select {_B20} from ({S.BLOCK20}) b")
def sink_parquet_roundtrip(spark, sf):
    """K2: Parquet sink, read back."""
    p = sinks.write_parquet(fx.block20(spark, sf), scratch_path(spark, "k2"))
    return spark.read.parquet(p)


@query("sink_by_state", f"select {_PROW} from ({S.POINTS}) p")
def sink_by_state(spark, sf):
    """K3: one directory per state, read back whole."""
    return spark.read.parquet(_points_by_state(spark, sf)).select(*_PROW.split(", "))


_TEXT_STATE = "case when state % 5 = 0 then null else lpad(cast(state as varchar), 2, '0') end"


def _text_state():
    return F.when(F.col("state") % 5 != 0, F.lpad(F.col("state").cast("string"), 2, "0"))


@query("sink_incremental", f"select county, {_TEXT_STATE} as state, net, race, lon, lat from ({S.POINTS}) p")
def sink_incremental(spark, sf):
    """K3: incremental, four runs, the first without rows; text states ("01") and a null state are
    each written once."""
    pts = fx.points(spark, sf).select(*_PROW.split(", "))
    new = pts.withColumn("state", _text_state())
    path = scratch_path(spark, "k3_incremental")
    sinks.write_new_states(new.where("state = 'none'"), path)                # a run without rows
    sinks.write_new_states(new.where("state is null or state < '12'"), path)
    sinks.write_new_states(new.where("state >= '12'"), path)
    sinks.write_new_states(new.where("state is null or state < '20'"), path)
    return files.read_dataset(spark, path, state_type="string").select(*_PROW.split(", "))


@query("list_states_text", f"select distinct {_TEXT_STATE} as name from ({S.POINTS}) p where state % 5 <> 0 union all select 'USA'")
def list_states_text(spark, sf):
    """Text state codes are listed as they were written ("01", not "1")."""
    pts = fx.points(spark, sf).select(*_PROW.split(", ")).withColumn("state", _text_state())
    p = sinks.write_by_state(pts, scratch_path(spark, "text_states"))
    return files.list_states(files.read_dataset(spark, p, state_type="string"))


@query("split_new_states", f"""with pts as (select row_number() over () as pid, * from ({S.POINTS}) p),
hits as (select p.pid, e.State_Code from pts p join ({S.NATION_EDGES}) e on true
  group by p.pid, e.State_Code having sum({S.crossing('p.lon', 'p.lat')}) % 2 = 1)
select p.county, p.net, p.lon, p.lat, h.State_Code as state from hits h join pts p on p.pid = h.pid""")
def split_new_states(spark, sf):
    """Split in two runs; the second joins only the states not yet written."""
    pts = fx.points(spark, sf).select("county", "net", "lon", "lat")
    states, path = fx.state_polygon(spark, sf), scratch_path(spark, "split_new")
    DS.split_new_states(pts, states.where("State_Code < 9"), path)
    DS.split_new_states(pts, states, path)
    return spark.read.parquet(path).select("county", "net", "lon", "lat", "state")


@query("split_by_state", f"""with pts as (select row_number() over () as pid, * from ({S.POINTS}) p),
hits as (select p.pid, e.State_Code from pts p join ({S.NATION_EDGES}) e on true
  group by p.pid, e.State_Code having sum({S.crossing('p.lon', 'p.lat')}) % 2 = 1)
select p.county, p.net, p.race, p.lon, p.lat, h.State_Code as state from hits h join pts p on p.pid = h.pid""")
def split_by_state(spark, sf):
    """Spatial join with the state polygons, written one directory per
    state and read back (a point on a shared border lands in both)."""
    pts = fx.points(spark, sf).select("county", "net", "race", "lon", "lat")
    tagged = DS.split_by_state(pts, fx.state_polygon(spark, sf))
    p = sinks.write_by_state(tagged, scratch_path(spark, "split_by_state"))
    return spark.read.parquet(p).select("county", "net", "race", "lon", "lat", "state")


@query("scan_census_block2020", f"""select ID20, STATE, COUNTY, cast(P20 as integer) as P20,
  {', '.join(f'cast(R20{k} as integer) as R20{k}' for k in range(1, 8))} from ({S.BLOCK20}) b""")
def scan_census_block2020(spark, sf):
    """2020 block counts written in the census CSV layout (Latin-1,
    GISJOIN / GEOCODE / STATEA / COUNTY / U7B001 / U7B003..U7B009) and read back
    by the census reader."""
    from .sources import census
    b = fx.block20(spark, sf)
    st = F.col("STATE").cast("string")
    gis = F.concat(F.lit("G"), F.lpad(st, 2, "0"), F.lit("0"), F.lpad(st, 3, "0"), F.lit("0"),
                   F.lpad(F.col("ID20").cast("string"), 10, "0"))
    layout = b.select(gis.alias("GISJOIN"), F.col("ID20").alias("GEOCODE"), F.col("STATE").alias("STATEA"),
                      "COUNTY", F.col("P20").alias("U7B001"),
                      *[F.col(f"R20{k}").alias(f"U7B00{k + 2}") for k in range(1, 8)])
    p = sinks.write_csv(layout, scratch_path(spark, "census_block2020"), encoding="ISO-8859-1")
    return census.read_block2020(spark, p)


@query("scan_census_relationship", f"""select distinct {_rel_id_sql('2010', 'ID10')} as ID10,
  {_rel_id_sql('2020', 'ID20')} as ID20, cast(ID20 % 50 + 1 as integer) as STATE_2020 from ({S.CROSSWALK}) c
  where ID20 % 50 + 1 <> 7""")
def scan_census_relationship(spark, sf):
    """S2 / S4 + F3: relationship files in the census layout (pipe-delimited,
    byte-order mark before the header, extra columns), two kinds of files with
    different column order and one state missing, read by each file's own
    header and composed into block ids."""
    from .sources import census
    rel = _relationship_rows(spark, sf).withColumn("AREALAND_2020", F.lit(0)).where("STATE_2020 <> 7")
    base = scratch_path(spark, "census_relationship")
    one = rel.where("STATE_2020 <= 25").withColumnRenamed("STATE_2010", "\ufeffSTATE_2010")
    sinks.write_csv(one, f"{base}/a", sep="|")
    # the 2020 columns first, another extra column, no byte-order mark
    two = rel.where("STATE_2020 > 25").select(F.lit("x").alias("NOTE"), *REL_COLS[4:], *reversed(REL_COLS[:4]))
    sinks.write_csv(two, f"{base}/b", sep="|")
    return census.read_relationship(spark, base + "/*/*.csv").distinct()

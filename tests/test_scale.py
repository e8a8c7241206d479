"""Behaviour that must not depend on size, plan shapes that must hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

from blockflow.operators import expand, raster as R, spatial, topk
from blockflow.operators.ranges import placed
from blockflow.plans import apportion as AP, crossfilter as X, datasets as DS, fixtures as fx, stages
from blockflow.sources import census, files, sinks

SF = "/root/testdata/sf0.001"
GEO = "array<array<struct<x:double,y:double>>>"


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in (*xy, xy[0])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_apportion_counts_rows_without_a_target(spark):
    cw = spark.createDataFrame([(1, 100), (1, None), (2, 100), (None, 200)], "ID10 long, ID20 long")
    src = spark.createDataFrame([(1, 10), (2, 3), (None, 99)], "ID10 long, P10 long")
    got = {r.ID20: r.eq_P10 for r in AP.apportion(cw, src, ["P10"]).collect()}
    assert got == {100: 8.0, 200: 0.0}


def test_spatial_join_scans_points_once_and_wants_unique_keys(spark, tmp_path):
    fx.points(spark, SF).select("county", "lon", "lat").write.parquet(f"{tmp_path}/p")
    pts = spark.read.parquet(f"{tmp_path}/p")
    states = fx.state_polygon(spark, SF)
    s = plan_of(DS.split_by_state(pts, states))
    assert s.count("FileScan parquet") == 1
    twice = states.unionByName(states)
    with pytest.raises(ValueError, match="once"):
        DS.split_by_state(pts, twice)
    with pytest.raises(ValueError, match="__cx"):
        spatial.spatial_join(pts.withColumn("__cx", F.lit(1)), states.withColumnRenamed("State_Code", "k"), "k", "lon", "lat")
    # ordinary names clash with nothing
    clash = pts.withColumns({"cx": F.lit(1), "cy": F.lit(2), "boundary": F.lit("b")})
    out = DS.split_by_state(clash, states)
    assert out.count() == DS.split_by_state(pts, states).count() and {"cx", "cy", "boundary"} <= set(out.columns)
    assert DS.split_by_state(pts, states.limit(0)).count() == 0


def test_spatial_join_shuffled_equals_broadcast(spark):
    pts = fx.points(spark, SF).select("county", "lon", "lat")
    boxes = fx.mixed_boxes(spark, SF)
    a = spatial.spatial_join(pts, boxes, "poly", "lon", "lat")
    b = spatial.spatial_join(pts, boxes, "poly", "lon", "lat", max_broadcast_bytes=0)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_cells_per_polygon_are_bounded(spark):
    polys = spark.createDataFrame(
        [(1, [ring((0, 0), (1000, 0), (1000, 1e-9), (0, 1e-9))]), (2, [ring((0, 0), (1e-3, 0), (1e-3, 1e-3), (0, 1e-3))]),
         (3, [ring((0, 0), (1e6, 0), (1e6, 1e6), (0, 1e6))]), (4, [ring((5, 5), (5, 5), (5, 5))])], f"k long, geometry {GEO}")
    cells = spatial.polygon_cells(spatial.with_level(polys), "k")
    n = {r.k: r["count"] for r in cells.groupBy("k").count().collect()}
    assert max(n.values()) <= 18 * 18 and n[1] <= 2 * 18


def test_sampling_in_crossing_and_hole_first_rings(spark):
    bow = [ring((0, 0), (1, 1), (1, 0), (0, 1))]
    holed = [ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)), ring((0, 0), (1, 0), (1, 1), (0, 1))]
    df = spark.createDataFrame([(1, bow), (2, holed)], f"ID20 long, geometry {GEO}")
    p = spatial.sampling_params(df).withColumn("n", F.lit(3000))
    out = spatial.individuals_in_polygon(p, "n", chunk_rows=500)
    assert out.columns == ["ID20", "n", "k", "x", "y", "attempt"] and out.count() == 6000
    one = spatial.points_in_polygon(expand.explode_individuals(p, "n")).select("ID20", "k", "x", "y", "attempt")
    assert one.exceptAll(out.select(one.columns)).count() == 0
    inside = {1: lambda x, y: (x < 0.5) != (y > x) or True, 2: lambda x, y: not (0.25 < x < 0.75 and 0.25 < y < 0.75)}
    for r in out.where("ID20 = 2").collect():
        assert inside[2](r.x, r.y)
    for r in out.where("ID20 = 1").collect():
        assert min(r.x, 1 - r.x) <= 0.5 and (min(r.y, 1 - r.y) >= min(r.x, 1 - r.x) or abs(r.x - 0.5) >= abs(r.y - 0.5))
    line = spark.createDataFrame([(1, [ring((0, 0), (1, 1), (2, 2))])], f"ID20 long, geometry {GEO}")
    assert spatial.sampling_params(line).first()["__attempts"] is None


def test_expansion_width_is_the_shuffle_width(spark):
    df = spark.createDataFrame([(1, 10)], "ID20 long, n long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        assert expand.explode_individuals(df, "n").rdd.getNumPartitions() == 37
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_placed_positions_and_deep_row(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("v"), F.lit("x").alias("w"))
    want = sorted(r.v for r in df.collect())
    got = sorted((r.pos, r.v) for r in placed(df, "v").numbered("pos").collect())
    assert got == list(enumerate(want))
    for i in (0, 17, 4999):
        assert topk.nth_row(df, i, "v", near=0).first().v == want[i] == topk.nth_row(df, i, "v").first().v
    assert topk.nth_row(df, 5000, "v", near=0).count() == 0


def test_shading_of_negative_and_null_cells(spark):
    r = spark.createDataFrame([(0, 0, -1.0), (1, 0, 0.0), (2, 0, 1.0), (3, 0, None)], "px int, py int, value double")
    got = {c.px: (c.t, c.bin) for c in R.raster_scaled(r, 9, "log").collect()}
    assert got[0] == (0.0, 0) and got[2] == (1.0, 8) and got[3] == (None, None) and 0 < got[1][0] < 1
    same = R.raster_scaled(r.where("value = 1"), 9).first()
    assert (same.t, same.bin) == (0.0, 0)
    assert R.raster_scaled(r.where("value > 5"), 9).count() == 0
    for palette in R.PALETTE:
        bins = [c.bin for c in R.raster_scaled(r.where("value is not null"), 9, "linear", palette).orderBy("px").collect()]
        assert bins[0] == 0 and bins[2] == 8 and bins == sorted(bins)


def test_answer_on_one_line_and_on_nothing(spark):
    pts = spark.createDataFrame([(1, 1, 1, 5.0, 7.0), (2, 1, 2, 5.0, 9.0)], "county long, net int, race int, easting double, northing double")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    got = X.answer(pts, X.Request(view="net", width=10, height=10), dim).collect()
    assert sorted((r.grp, r.name) for r in got if r.grp == "county") == [("county", "a"), ("county", "b")]
    assert sum(r.cnt for r in got if r.grp == "cell") == 2
    assert next(r.n_rows for r in got if r.grp == "total") == 2
    assert X.answer(pts.limit(0), X.Request(), dim).count() == 0
    parts = X.crossfilter(pts.limit(0), dim_county=dim)
    assert parts["count"].first().n_rows == 0 and parts["county_top"].count() == 0


def test_relationship_files_with_their_own_headers(spark, tmp_path):
    for name, text in {
        "a": "﻿STATE_2010|COUNTY_2010|TRACT_2010|BLK_2010|STATE_2020|COUNTY_2020|TRACT_2020|BLK_2020\n1|1|200|2000|1|1|300|3000\n",
        "b": "STATE_2020|COUNTY_2020|TRACT_2020|BLK_2020|X|STATE_2010|COUNTY_2010|TRACT_2010|BLK_2010\n1|1|300|3000|y|1|1|200|2000\n",
    }.items():
        with open(f"{tmp_path}/{name} 1.txt", "w", encoding="utf-8") as f:
            f.write(text)
    got = census.read_relationship(spark, f"{tmp_path}/*.txt").collect()
    assert [(r.ID10, r.ID20) for r in got] == [(10010002002000, 10010003003000)] * 2
    with open(f"{tmp_path}/c 1.txt", "w") as f:
        f.write("STATE_2010|BLK_2020\n1|2\n")
    with pytest.raises(ValueError, match="no column"):
        census.read_relationship(spark, f"{tmp_path}/*.txt")


def test_states_keep_their_text_and_null_is_written_once(spark, tmp_path):
    df = spark.createDataFrame([("01", 1), ("36", 2), (None, 3)], "state string, v int")
    path = f"{tmp_path}/s"
    for _ in range(3):
        sinks.write_new_states(df, path)
    back = files.read_dataset(spark, path, state_type="string")
    assert sorted((r.state or "", r.v) for r in back.collect()) == [("", 3), ("01", 1), ("36", 2)]
    assert sorted(r.name for r in files.list_states(back).collect()) == ["01", "36", "USA"]
    assert files.read_dataset(spark, path, "01", state_type="string").count() == 1


def test_published_dataset_can_be_given_back(spark):
    name = files.publish(spark.range(3))
    assert spark.sql(f"select count(*) from {name}").first()[0] == 3
    files.unpublish(spark, name)
    assert not spark.catalog.tableExists(name)


def test_stored_points_are_split_by_state_and_skip_files(spark, tmp_path):
    paths = stages.build_datasets(fx.block10(spark, SF), fx.block20(spark, SF), fx.crosswalk(spark, SF), fx.block_polygon(spark, SF),
                                  fx.dim_state(spark, SF), str(tmp_path), states=fx.state_polygon(spark, SF))
    by_state = spark.read.parquet(paths["by_state"])
    want = DS.split_by_state(spark.read.parquet(paths["net_migration"]).drop("state"), fx.state_polygon(spark, SF), "x", "y")
    assert by_state.count() == want.count() > 0
    # files are ranges of the interleaved cell: a small box meets few of them
    rows = spark.range(20000).select((F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        stages.grid_cluster(rows, "x", "y", 10.0).write.parquet(f"{tmp_path}/grid")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    g = spark.read.parquet(f"{tmp_path}/grid")
    n = len([f for f in os.listdir(f"{tmp_path}/grid") if f.endswith(".parquet")])
    spans = g.groupBy(F.input_file_name().alias("f")).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).collect()
    assert n >= 4 and sum(s.a <= 15 and s.c <= 15 for s in spans) <= n // 2

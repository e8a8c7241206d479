
import pytest
from pyspark.sql import functions as F

from blockflow import queries_prep as QP
from blockflow.functions import geo
from blockflow.operators import expand, spatial, windows
from blockflow.plans import apportion as AP, crossfilter as X, fixtures as fx, migration as MG
from blockflow.queries_core import BOX, VIEWPORT

SF = "/root/testdata/sf0.001"


def test_migration_invariants(spark):
    mig = QP._mig(spark, SF)
    assert mig.where(F.col("eq_P10") != F.col("P20") - F.col("block_diff")).count() == 0
    assert MG.reconcile_violations(QP._rmig(spark, SF)).count() == 0


def test_apportion_conserves(spark):
    cw = fx.crosswalk(spark, SF)
    b10 = fx.block10(spark, SF)
    ap = AP.apportion(cw, b10, ["P10"])
    total = ap.agg(F.sum("eq_P10")).first()[0]
    mapped = b10.join(cw.select("ID10").distinct(), "ID10").agg(F.sum("P10")).first()[0]
    assert total == pytest.approx(mapped)


def test_rows_per_block_and_points_inside(spark):
    races = fx.block20(spark, SF).select("ID20", *[f"R20{k}" for k in range(1, 8)])
    mig = QP._mig(spark, SF)
    from blockflow.plans import datasets as DS
    polys = fx.block_polygon(spark, SF)
    ds = DS.total_population_dataset(mig, races, polys, fx.dim_state(spark, SF))
    per = {r.ID20: r.c for r in ds.groupBy("ID20").agg(F.count("*").alias("c")).collect()}
    exp = {r.ID20: max(r.P20, r.eq_P10) for r in mig.collect() if r.P20 != 0 or r.eq_P10 != 0}
    assert per == {k: v for k, v in exp.items() if v > 0}
    # every generated point lies inside its block polygon
    lon, lat = geo.from_mercator("easting", "northing")
    chk = ds.select("ID20", lon.alias("x"), lat.alias("y")).join(polys, F.col("ID20") == F.col("GEOID20"))
    assert chk.where(~geo.polygon_contains("geometry", "x", "y")).count() == 0


def test_grouping_sets_equal_separate(spark):
    pts = fx.points(spark, SF)
    allq = X.crossfilter_all(pts, "total", box=BOX, viewport=VIEWPORT, width=384, height=216)
    sep = X.crossfilter(pts, "total", box=BOX, viewport=VIEWPORT, width=384, height=216)
    cnt = {r.county: r.cnt for r in allq.where("grp = 'county'").collect()}
    full = {r.county: r.cnt for r in X.county_counts(X.filtered(pts, "total", box=BOX)).collect()}
    assert cnt == full
    cells = {(r.px, r.py): r.cnt for r in allq.where("grp = 'cell'").collect()}
    assert cells == {(r.px, r.py): r.value for r in sep["raster"].collect()}
    assert allq.where("grp = 'total'").first().cnt == sep["count"].first().n_rows


def test_number_within_group_equals_row_number(spark):
    from pyspark.sql import Window
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 != 2, F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    w = Window.partitionBy("g").orderBy("v")
    want = sorted((r.g is None, r.g or 0, r.v, r.rn) for r in df.withColumn("rn", F.row_number().over(w)).collect())
    for most in (1, 100, 1 << 20):
        out = windows.number_within_group(df, "g", ["v"], out="rn", max_rows=most)
        assert sorted((r.g is None, r.g or 0, r.v, r.rn) for r in out.collect()) == want, most


def test_permutation_is_bijection_for_every_size(spark):
    sizes = spark.range(1, 1001).select(F.col("id").alias("ID20"), F.col("id").alias("n"))
    e = expand.explode_individuals(expand.with_permutation(sizes, "n", "ID20"), "n", chunk_rows=64)
    e = e.withColumn("p", expand.permuted_place("k", "n"))
    bad = e.groupBy("ID20", "n").agg(F.count_distinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    assert bad.where("d <> n or lo <> 1 or hi <> n").count() == 0
    assert e.where("k = p").count() < e.count() / 50           # not the identity


def test_permutation_of_a_large_block(spark):
    one = expand.with_permutation(spark.createDataFrame([(7, 1000003)], "ID20 long, n long"), "n", "ID20", seed=3)
    e = expand.explode_individuals(one, "n").withColumn("p", expand.permuted_place("k", "n"))
    r = e.agg(F.count_distinct("p"), F.min("p"), F.max("p"), F.corr("k", "p")).first()
    assert (r[0], r[1], r[2]) == (1000003, 1, 1000003) and abs(r[3]) < 0.01


def test_permutations_of_small_blocks_are_all_drawn(spark):
    blocks = spark.range(0, 6000).select(F.col("id").alias("ID20"), F.lit(4).cast("long").alias("n"))
    e = expand.explode_individuals(expand.with_permutation(blocks, "n", "ID20"), "n").withColumn("p", expand.permuted_place("k", "n"))
    orders = e.groupBy("ID20").agg(F.sort_array(F.collect_list(F.struct("k", "p"))).alias("o")).groupBy("o").count().collect()
    assert len(orders) == 24 and min(r["count"] for r in orders) > 100 and max(r["count"] for r in orders) < 500


def test_permutation_needs_no_shuffle_after_the_explode(spark):
    plan = QP.permute_within_block(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.index("Generate explode")], plan


def test_results_independent_of_partitioning(spark):
    q = QP.total_population_dataset
    a = q(spark, SF)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = q(spark, SF)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sampling_budget_thin_polygon(spark):
    # a sliver filling 1% of its box still gets exact first-hit points
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 0.2}, {"x": 0.0, "y": 0.0}]]
    bbox_ring = [[{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}, {"x": 0.0, "y": 0.0}]]
    polys = spark.createDataFrame([(1, ring + [[{"x": 0.0, "y": 0.0}, {"x": 0.0, "y": 10.0}, {"x": 0.0, "y": 10.0}, {"x": 0.0, "y": 0.0}]])],
                                  "ID20 long, geometry array<array<struct<x:double,y:double>>>")
    del bbox_ring
    p = spatial.sampling_params(polys)
    assert p.first()["__attempts"] > 16
    rows = expand.explode_individuals(p, F.lit(50), spread=False)
    pts = spatial.points_in_polygon(rows).collect()
    assert len(pts) == 50 and all(r.attempt >= 1 for r in pts)


def test_build_datasets_end_to_end(spark, tmp_path):
    from blockflow.plans import stages
    paths = stages.build_datasets(fx.block10(spark, SF), fx.block20(spark, SF), fx.crosswalk(spark, SF),
                                  fx.block_polygon(spark, SF), fx.dim_state(spark, SF), str(tmp_path))
    tp = spark.read.parquet(paths["total_population"])
    direct = QP.total_population_dataset(spark, SF)
    assert tp.count() == direct.count()
    nm = spark.read.parquet(paths["net_migration"])
    assert nm.count() == QP.net_migration_dataset(spark, SF).count()
    # a box filter on the stored coordinates reaches the Parquet scan
    plan = tp.where(F.col("easting").between(-1.2e7, -1.1e7))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(easting), GreaterThanOrEqual(easting" in plan


def test_request_clamps_window_and_projects_box(spark):
    pts = fx.points(spark, SF)
    ext = X.data_extent(pts)
    req = X.Request(view="total", window_lonlat=(-140.0, -60.0, 10.0, 60.0), box_lonlat=(-110.0, -90.0, 44.0, 30.0),
                    width=96, height=54)
    got = {(r.grp, r.county, r.race, r.px, r.py): r.cnt for r in X.answer(pts, req, fx.dim_county(spark, SF), ext).collect()}
    # the window exceeds the data on every side, so the viewport is the data extent itself (up to the
    # lon/lat round trip); the box corners come in any order
    (bx0, by0), (bx1, by1) = geo.mercator_xy(-110.0, 30.0), geo.mercator_xy(-90.0, 44.0)
    exp_df = X.crossfilter_all(pts, "total", box=(bx0, bx1, by0, by1), viewport=ext, width=96, height=54)
    exp = {(r.grp, r.county, r.race, r.px, r.py): r.cnt for r in exp_df.collect()}
    assert {k: v for k, v in got.items() if k[0] != "cell"} == {k: v for k, v in exp.items() if k[0] != "cell"}
    assert sum(v for k, v in got.items() if k[0] == "cell") == sum(v for k, v in exp.items() if k[0] == "cell")


def test_total_population_shuffle_keeps_counts(spark):
    from blockflow.plans import datasets as DS
    races = fx.block20(spark, SF).select("ID20", *[f"R20{k}" for k in range(1, 8)])
    mig = QP._mig(spark, SF)
    args = (mig, races, fx.block_polygon(spark, SF), fx.dim_state(spark, SF))
    a = DS.total_population_dataset(*args).groupBy("ID20", "race", "net").count()
    b = DS.total_population_dataset(*args, shuffle=True)
    # per block the race counts and the net counts are unchanged, only their pairing moves
    ra = {(r.ID20, r.race): r.c for r in a.groupBy("ID20", "race").agg(F.sum("count").alias("c")).collect()}
    rb = {(r.ID20, r.race): r.c for r in b.groupBy("ID20", "race").agg(F.count("*").alias("c")).collect()}
    assert ra == rb


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_results_independent_of_input_partitioning(spark):
    cw, b10 = fx.crosswalk(spark, SF), fx.block10(spark, SF)
    one = AP.apportion(cw.repartition(1), b10.repartition(1), ["P10"])
    seven = AP.apportion(cw.repartition(7, "ID20"), b10.repartition(7), ["P10"])
    r = lambda d: d.select("ID20", F.round("eq_P10", 6).alias("e"))
    assert _same(r(one), r(seven))
    pts = fx.points(spark, SF).select("county", "lon", "lat")
    states = fx.state_polygon(spark, SF).select(F.col("State_Code").alias("state"), "geometry")
    j1 = spatial.spatial_join(pts.repartition(1), states, "state", "lon", "lat")
    j7 = spatial.spatial_join(pts.repartition(7), states.repartition(3), "state", "lon", "lat")
    assert _same(j1, j7)
    g = MG.generation_table(QP._mig(spark, SF))
    p = spatial.sampling_params(fx.block_polygon(spark, SF).withColumnRenamed("GEOID20", "ID20"))
    s1 = spatial.points_in_polygon(expand.explode_individuals(g.join(p, "ID20").repartition(1), "points"))
    s7 = spatial.points_in_polygon(expand.explode_individuals(g.join(p, "ID20").repartition(7), "points", partitions=5))
    cols = ["ID20", "k", "x", "y"]
    assert _same(s1.select(cols), s7.select(cols))


def test_net_migration_on_multipolygon_blocks(spark):
    from blockflow.plans import datasets as DS
    rmig = QP._rmig(spark, SF)
    mp = fx.block_multipolygon(spark, SF)
    ds = DS.net_migration_dataset(rmig, mp, depth=3)
    exp = {r.ID20: r.points for r in rmig.where("points != 0").collect()}
    got = {r.blockid: r.c for r in ds.groupBy("blockid").agg(F.count("*").alias("c")).collect()}
    assert got == exp
    chk = ds.join(mp, ds.blockid == mp.GEOID20)
    assert chk.where(~geo.multipolygon_contains("geometry", "x", "y")).count() == 0
    # both parts of a two-part block receive points
    two = chk.where(F.size("geometry") == 2).select(
        "blockid", (F.col("x") > F.get(F.get(F.get("geometry", 0), 0), 1)["x"]).alias("east"))
    assert two.select("east").distinct().count() == 2

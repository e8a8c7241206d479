"""Loads and stages that go on after a stop, and tables read without a shuffle or a row."""

import os

import pytest
from pyspark.sql import functions as F

from blockflow import queries_stored as QS
from blockflow.operators import expand, windows
from blockflow.plans import apportion as AP, fixtures as fx, stages
from blockflow.session import scratch_path as shared_path
from blockflow.sources import census, files, incremental, sinks

SF = "/root/testdata/sf0.001"


def scratch_path(spark, name):
    return shared_path(spark, name).removeprefix("file:")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- incremental load -------------------------------------------------------------

def new_file(spark, folder, rows):
    spark.createDataFrame(rows, "id long, state string").coalesce(1).write.mode("append").parquet(folder)


def test_each_file_is_taken_once(spark):
    base = scratch_path(spark, "inc")
    schema = spark.createDataFrame([], "id long, state string").schema

    def run():
        return incremental.load_new_files(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck", partition_by=["state"])

    def got():
        return sorted((r["id"], r["state"]) for r in incremental.loaded(spark, f"{base}/out", schema).collect())
    assert got() == []
    os.makedirs(f"{base}/in")
    assert run() == 0 and got() == []
    new_file(spark, f"{base}/in", [(1, "01"), (2, None)])
    assert run() == 1 and got() == [(1, "01"), (2, None)]
    assert run() == 0 and got() == [(1, "01"), (2, None)]
    new_file(spark, f"{base}/in", [(3, "01")])
    new_file(spark, f"{base}/in", [(4, "02")])
    assert run() == 1 and got() == [(1, "01"), (2, None), (3, "01"), (4, "02")]


def test_a_failed_batch_is_repeated_whole(spark):
    base = scratch_path(spark, "inc")
    schema = spark.createDataFrame([], "id long, state string").schema
    for i in range(6):
        new_file(spark, f"{base}/in", [(10 * i + j, str(j)) for j in range(4)])

    def breaking(d):
        return d.withColumn("id", F.when(F.col("id") == 42, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")))

    def run(transform):
        return incremental.load_new_files(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ck", transform=transform, files_per_batch=1)
    with pytest.raises(Exception, match="lost"):
        run(breaking)
    before = [r["id"] for r in incremental.loaded(spark, f"{base}/out", schema).collect()]
    assert 42 not in before and len(before) < 24
    run(None)
    rows = sorted(r["id"] for r in incremental.loaded(spark, f"{base}/out", schema).collect())
    assert rows == sorted(10 * i + j for i in range(6) for j in range(4))


def test_incremental_states_after_an_empty_run(spark):
    path = scratch_path(spark, "k3")
    rows = spark.createDataFrame([(1, "01"), (2, "a/b=c %"), (3, None)], "id long, state string")
    sinks.write_new_states(rows.where("false"), path)
    assert sinks.states_written(spark, path, "state", "string").count() == 0
    for _ in range(2):
        sinks.write_new_states(rows, path)
    assert sorted(files.partition_values(spark, path, "state"), key=str) == sorted(["01", "a/b=c %", None], key=str)
    assert spark.read.parquet(path).count() == 3
    empty = scratch_path(spark, "k3")
    os.makedirs(empty)
    sinks.write_new_states(rows, empty)
    assert spark.read.parquet(empty).count() == 3


# --- relationship files ---------------------------------------------------------------

HEAD = "STATE_2010|COUNTY_2010|TRACT_2010|BLK_2010|STATE_2020|COUNTY_2020|TRACT_2020|BLK_2020"


def relationship(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_text(text, encoding="utf-8")
    return f"{tmp_path}/*.txt"


def test_headers_in_any_case_and_empty_files(spark, tmp_path):
    pattern = relationship(tmp_path, a=f"{HEAD}\n1|1|1|1|1|1|1|1\n", b=f"﻿{HEAD.lower()}|x\r\n2|1|1|1|2|1|1|1|y\r\n", c="")
    assert census.read_relationship(spark, pattern).count() == 2
    assert len(census.files_by_header(spark, pattern)) == 2


@pytest.mark.parametrize("text", ["1|1|1|1|1|1|1|1\n", "STATE_2010|BLK_2020\n1|2\n", "just text\n"])
def test_files_without_the_header_raise(spark, tmp_path, text):
    pattern = relationship(tmp_path, a=f"{HEAD}\n1|1|1|1|1|1|1|1\n", b=text)
    with pytest.raises(ValueError, match="b.txt"):
        census.read_relationship(spark, pattern)


# --- stages and bucketed tables ---------------------------------------------------------

@pytest.fixture(scope="module")
def inputs(spark):
    return (fx.block10(spark, SF), fx.block20(spark, SF), fx.crosswalk(spark, SF), fx.block_polygon(spark, SF), fx.dim_state(spark, SF))


def test_block_tables_join_without_a_shuffle(spark, inputs):
    base = scratch_path(spark, "st")
    paths = stages.build_datasets(*inputs, base, stop_after="race_migration")
    assert not os.path.exists(paths["total_population"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = QS.joined_block_tables(spark, base, paths)
        assert "Exchange" not in plan_of(joined) and plan_of(joined).count("SortMergeJoin") == 2
        counted = joined.groupBy("ID20").agg(F.count("*"))
        assert "Exchange" not in plan_of(counted)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    t = stages.block_tables(spark, base, paths)
    names = [f"{stages._tag(base)}_{n}" for n in stages.STAGES[:3]]
    want = {n: sorted(map(tuple, t[n].collect()), key=str) for n in t}
    for n in names:                                                # as in a new session, whose catalog has no table
        spark.sql(f"drop table {n}")
    again = stages.block_tables(spark, base, paths)
    assert {n: sorted(map(tuple, again[n].collect()), key=str) for n in again} == want


def test_stages_are_resumed_not_repeated(spark, inputs):
    base = scratch_path(spark, "st")
    paths = stages.build_datasets(*inputs, base, stop_after="total_population")
    times = {k: os.path.getmtime(os.path.join(paths[k], "_SUCCESS")) for k in stages.STAGES[:4]}
    broken = (None, inputs[1], None, *inputs[3:])                  # inputs of the finished stages are not asked for
    done = stages.build_datasets(*broken, base, resume=True)
    assert {k: os.path.getmtime(os.path.join(done[k], "_SUCCESS")) for k in times} == times
    n = spark.read.parquet(done["net_migration"]).count()
    os.remove(os.path.join(done["net_migration"], "_SUCCESS"))       # a write that did not end
    assert spark.read.parquet(stages.build_datasets(*broken, base, resume=True)["net_migration"]).count() == n
    whole = stages.build_datasets(*inputs, scratch_path(spark, "st"))
    a, b = (spark.read.parquet(p["net_migration"]) for p in (done, whole))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# --- footers ---------------------------------------------------------------------------

def test_stats_come_from_the_footers(spark):
    path = sinks.write_parquet(fx.points(spark, SF), scratch_path(spark, "pts"))
    want = spark.read.parquet(path).agg(F.count("*"), F.min("lon"), F.max("lon")).first()
    keep = {k: spark.conf.get(k, None) for k in ("spark.sql.sources.useV1SourceList", "spark.sql.parquet.aggregatePushdown")}
    got = files.stored_stats(spark, path, ["lon"])
    assert tuple(got.values()) == tuple(want)
    assert {k: spark.conf.get(k, None) for k in keep} == keep
    try:
        spark.conf.set("spark.sql.sources.useV1SourceList", "")
        spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        assert "PushedAggregation: [COUNT(*), MIN(lon), MAX(lon)]" in plan_of(spark.read.parquet(path).agg(F.count("*"), F.min("lon"), F.max("lon")))
    finally:
        for k, v in keep.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stats_of_files_without_statistics(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double").coalesce(1)
    got = files.stored_stats(spark, sinks.write_parquet(rows, scratch_path(spark, "nan")), ["v"])
    assert got["n_rows"] == 3 and got["min_v"] == 1.0
    path = scratch_path(spark, "mixed")
    for part in (rows.where("v = 1"), rows.where("false"), rows.where("v = 1").withColumn("v", F.lit(5.0))):
        part.write.mode("append").parquet(path)
    assert files.stored_stats(spark, path, ["v"]) == {"n_rows": 2, "min_v": 1.0, "max_v": 5.0}
    none = files.stored_stats(spark, sinks.write_parquet(rows.where("false"), scratch_path(spark, "none")), ["v"])
    assert none["n_rows"] == 0 and none["min_v"] is None


# --- names and lengths -------------------------------------------------------------------

def test_windows_keep_columns_of_any_name(spark):
    d = spark.range(0, 500).select(F.col("id").alias("k"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    for name in ("__range", "__at", "__fill", "__next", "__g", "__n", "__pos", "__start", "__first", "__k"):
        d = d.withColumn(name, F.col("k") + 1)
    out = windows.bfill(d, "v", "k", out="filled")
    assert set(out.columns) == {*d.columns, "filled"}
    assert out.where("filled is not null and filled <> ceil(k / 7) * 7").count() == 0 and out.where("__range <> k + 1").count() == 0
    num = windows.number_within_group(d.withColumn("g", F.col("k") % 3), "g", ["k"], max_rows=10)
    assert set(num.columns) == {*d.columns, "g", "rn"} and num.where("rn <> k div 3 + 1 or __pos <> k + 1").count() == 0
    freq = windows.window_freq(d.withColumn("g", F.col("k") % 2), "g")
    assert freq.where("freq <> 250").count() == 0 and "__k" in freq.columns


def test_lists_of_more_codes_than_an_array_holds(spark):
    big = 3_000_000_000
    d = spark.createDataFrame([(1, big, -5), (2, 0, 0)], "ID20 long, a long, b long")
    p = expand.list_pieces(d, expand.signed_runs(["a", "b"]), chunk_rows=1 << 30)
    r = p.select("first", F.col("__x") if "__x" in p.columns else F.lit(0)).agg(F.count("*"), F.max("first")).first()
    assert r[0] == -(-(big + 5) // (1 << 30)) and r[1] == 2 * (1 << 30) + 1
    small = expand.explode_pieces(expand.list_pieces(d.withColumn("a", F.lit(3)), expand.signed_runs(["a", "b"]), chunk_rows=2))
    assert sorted((r["ID20"], r["k"], r["code"]) for r in small.collect() if r["ID20"] == 1) == \
        [(1, 1, 1), (1, 2, 1), (1, 3, 1), *[(1, k, -2) for k in range(4, 9)]]


# --- points drawn once, crosswalk joined on plain keys ---------------------------------------

def own_blocks(spark):
    ids = spark.range(1, 41)
    races = lambda p, f: [F.when(F.col("id") % 7 + 1 == k, F.lit(f)).otherwise(0).cast("long").alias(f"{p}{k}") for k in range(1, 8)]
    b10 = ids.select(F.col("id").alias("ID10"), F.lit(9).cast("long").alias("P10"), *races("R10", 9))
    b20 = ids.select(F.col("id").alias("ID20"), (F.col("id") % 3).alias("STATE"), F.lit("Kent").alias("COUNTY"),
                     F.lit(13).cast("long").alias("P20"), *races("R20", 13))
    cw = ids.select(F.col("id").alias("ID10"), F.col("id").alias("ID20"))
    x = F.col("id").cast("double")
    tri = F.array(F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in
                            ((x, F.lit(1.0)), (x + 0.9, F.lit(1.0)), (x, F.lit(1.9)), (x, F.lit(1.0)))]))
    return b10, b20, cw, ids.select(F.col("id").alias("GEOID20"), tri.alias("geometry")), spark.createDataFrame([(1, "Kent")], "id long, name string")


def test_points_are_drawn_once_for_a_clustered_write(spark, monkeypatch):
    drawn, kept = spark.sparkContext.accumulator(0), spark.sparkContext._jsc.getPersistentRDDs().size()

    def count(v):
        drawn.add(1)
        return v

    counted = F.udf(count, "double")
    for name, x in (("total_population_dataset", "easting"), ("net_migration_dataset", "x")):
        made = getattr(stages.DS, name)
        monkeypatch.setattr(stages.DS, name, lambda *a, made=made, x=x, **b: made(*a, **b).withColumn(x, counted(x)))
    paths = stages.build_datasets(*own_blocks(spark), scratch_path(spark, "once"))
    n = sum(spark.read.parquet(paths[k]).count() for k in ("total_population", "net_migration"))
    assert n > 40 * 13 and drawn.value == n
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept             # nothing stays on the executors


def test_crosswalk_is_joined_on_plain_keys(spark):
    cw = spark.createDataFrame([(0, 1), (0, 2), (None, 2), (None, 3), (5, None), (5, 4)], "ID10 long, ID20 long")
    src = spark.createDataFrame([(0, 8), (None, 100), (5, 6)], "ID10 long, P10 long")
    out = AP.apportion(cw, src, ["P10"])
    assert {r.ID20: r.eq_P10 for r in out.collect()} == {1: 4.0, 2: 4.0, 3: 0.0, 4: 3.0}   # id 0 and the null id stay apart
    assert "struct(" not in plan_of(out)
    text = AP.apportion(*[d.withColumn("ID10", F.col("ID10").cast("string")) for d in (cw, src)], ["P10"])
    assert {r.ID20: r.eq_P10 for r in text.collect()} == {1: 4.0, 2: 4.0, 3: 0.0, 4: 3.0}

"""The shapefile data source: round trips, holes, pushed filters, hand-made files."""

import os
import random
import struct
from datetime import date

import pytest
from pyspark.sql import functions as F

from blockflow.session import scratch_path
from blockflow.sources import shapefile as SH

GEO = "array<array<array<struct<x:double,y:double>>>>"


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    SH.register(spark)


def ring(*xy):
    return [(float(x), float(y)) for x, y in [*xy, xy[0]]]


def square(x, y, w, clockwise=True):
    r = ring((x, y), (x, y + w), (x + w, y + w), (x + w, y))
    return r if clockwise else r[::-1]


def rows():
    rng = random.Random(1)
    out = [(1, "one", 1.5, True, date(2020, 1, 31), [[square(0, 0, 10), square(1, 1, 2, False), square(5, 5, 3, False)], [square(20, 20, 1)]]),
           (2, "Doña Ana", None, None, None, [[square(-3.25, 7, 1e-9)]]), (3, None, float(2 ** 60), False, date(1999, 12, 1), None),
           (-9223372036854775808, "x" * 254, -1.7976931348623157e308, True, None, [[square(0, 0, 1, False)]]), (4, "empty", 0.1, None, None, [])]
    for i in range(5, 400):
        n = rng.randrange(3, 40)
        pts = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(n)]
        out.append((i, f"n{i}", rng.uniform(-1, 1), i % 2 == 0, None, [[ring(*pts)]]))
    return out


DDL = f"id long, name string, v double, ok boolean, day date, geometry {GEO}"


@pytest.fixture(scope="module")
def path(spark):
    p = scratch_path(spark, "shp")
    spark.createDataFrame(rows(), DDL).repartition(3).write.format("shapefile").mode("append").save(p)
    return p


def canonical(geometry):
    """Parts as sets of vertices, whatever the direction and order of rings."""
    if geometry is None:
        return None
    return sorted([sorted([sorted({(v["x"], v["y"]) if not isinstance(v, tuple) else v for v in r}) for r in part]) for part in geometry])


def test_round_trip(spark, path):
    read = spark.read.format("shapefile").option("records", 50).load(path)
    assert read.columns == ["id", "name", "v", "ok", "day", *SH._BOX, "geometry"]
    got = {r["id"]: r for r in read.collect()}
    want = {r[0]: r for r in rows()}
    assert got.keys() == want.keys() and read.rdd.getNumPartitions() > 8
    for i, w in want.items():
        g = got[i]
        assert (g["name"], g["v"], g["ok"], g["day"]) == w[1:5]
        assert canonical(g["geometry"]) == (canonical(w[5]) if w[5] else None)
        if w[5]:
            xs = [v[0] for p in w[5] for r in p for v in r]
            assert (g["xmin"], g["xmax"]) == (min(xs), max(xs))
    holes = got[1]["geometry"]
    assert sorted(len(p) for p in holes) == [1, 3]
    assert not [f for f in os.listdir(path.removeprefix("file:")) if f.startswith("_")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("condition,pushed", [
    ("id = 7", True), ("id > 100 and id <= 120", True), ("name = 'n17'", True), ("id in (3, 9, 1000)", True), ("v is not null and v < 0", True),
    ("xmin >= 0 and xmax < 5", True), ("ymin > 10 and id > 50", True), ("id = 7 or id = 9", False), ("size(geometry) > 1", False), ("ok", False),
    ("day = date'2020-01-31'", True), ("xmin is null", False), ("not (id > 5)", True)])
def test_filters(spark, path, condition, pushed):
    read = spark.read.format("shapefile").load(path)
    whole = spark.createDataFrame(read.collect(), read.schema)
    got = read.where(condition)
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in whole.where(condition).collect())


def test_pushed_filters_leave_the_plan_and_records_unread(spark, path, monkeypatch):
    got = spark.read.format("shapefile").load(path).where("id = 7 and xmin > -1000")
    assert "Filter (" not in plan_of(got).replace("Filter (isnotnull", "") or "PushedFilters" in plan_of(got)
    reader = SH.Shapefile({"path": path}).reader(SH.Shapefile({"path": path}).schema())
    assert list(reader.pushFilters([SH.ds.EqualTo(("id",), 7)])) == []
    parsed = []
    monkeypatch.setattr(SH, "parts_of", lambda c, f=SH.parts_of: parsed.append(1) or f(c))
    out = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in out) == 1 and len(parsed) == 1


def test_columns_option_leaves_the_shapes_unopened(spark, path, tmp_path):
    only = tmp_path / "t"
    only.mkdir()
    src = path.removeprefix("file:")
    name = next(f for f in os.listdir(src) if f.endswith(".dbf"))
    (only / name).write_bytes(open(os.path.join(src, name), "rb").read())
    (only / name.replace(".dbf", ".shp")).write_bytes(b"")           # opening it would fail
    df = spark.read.format("shapefile").option("columns", "name,id").load(str(only))
    assert df.columns == ["name", "id"] and df.count() > 0 and df.where("id > 5").count() > 0
    with pytest.raises(Exception, match="no column"):
        spark.read.format("shapefile").option("columns", "nope").load(path)


def test_hand_made_file_with_rings_in_any_order(spark, tmp_path):
    # the hole stands before its outer ring; a second outer ring follows; a deleted row and a null shape
    rings = [square(1, 1, 2, False), square(0, 0, 10), square(50, 50, 1), square(51, 60, 0.5, False)]
    xy = [v for r in rings for v in r]
    starts = [0, 5, 10, 15]
    content = struct.pack("<i4d2i", 5, 0, 0, 51.5, 60.5, 4, 20) + struct.pack("<4i", *starts) + struct.pack("<40d", *[c for v in xy for c in v])
    records = [content, struct.pack("<i", 0), content]
    shp, shx, at = b"", b"", 100
    for i, c in enumerate(records):
        shp += struct.pack(">2i", i + 1, len(c) // 2) + c
        shx += struct.pack(">2i", at // 2, len(c) // 2)
        at += 8 + len(c)
    (tmp_path / "A.shp").write_bytes(b"\0" * 100 + shp)
    (tmp_path / "A.shx").write_bytes(b"\0" * 100 + shx)
    field = b"CODE".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([4, 0]) + b"\0" * 14
    text = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6, 0]) + b"\0" * 14
    head = struct.pack("<4BIHH20x", 3, 95, 7, 26, 3, 32 + 64 + 1, 11) + field + text + b"\r"
    (tmp_path / "A.dbf").write_bytes(head + b"   12Do\xf1a  " + b" ****      " + b"*  13gone  " + b"\x1a")
    got = spark.read.format("shapefile").option("encoding", "latin-1").load(str(tmp_path / "A.shp")).collect()
    assert [(r["CODE"], r["NAME"]) for r in got] == [(12, "Doña"), (None, None)] and got[1]["geometry"] is None
    assert [len(p) for p in got[0]["geometry"]] == [2, 2]               # a hole outside all goes to the outer ring before it
    assert got[0]["geometry"][0][1][0]["x"] == 1.0


def test_errors_are_said(spark, tmp_path, path):
    d = spark.createDataFrame(rows()[:2], DDL)
    for bad, what in ((d.withColumnRenamed("name", "a_long_column"), "longer than 10"), (d.drop("geometry"), "geometry"),
                      (d.withColumn("m", F.array(F.lit(1))), "no place"), (d.withColumn("name", F.repeat(F.lit("é"), 200)), "254 bytes")):
        with pytest.raises(Exception, match=what):
            bad.write.format("shapefile").mode("append").save(str(tmp_path / "bad"))
    assert not [f for f in (os.listdir(tmp_path / "bad") if (tmp_path / "bad").exists() else []) if f[0] != "_"]
    with pytest.raises(Exception, match="no .shp file"):
        os.makedirs(tmp_path / "none")
        spark.read.format("shapefile").load(str(tmp_path / "none"))

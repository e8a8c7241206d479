"""Hand-made edge fixtures (FIXTURES.md section 2)."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from blockflow.functions import geo, ids, numeric
from blockflow.operators import expand, filters, raster as R, spatial, topk, windows
from blockflow.plans import apportion as AP, crossfilter as X, migration as MG


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_crosswalk_shapes(spark):
    # 1->1, 1->3, 3->1, 2<->2, duplicated pair, a 2010 id without counts (9),
    # a counted 2010 id missing from the crosswalk (8)
    cw = spark.createDataFrame([
        (1, 10), (2, 20), (2, 21), (2, 22), (3, 30), (4, 30), (5, 30),
        (6, 40), (6, 41), (7, 40), (7, 41), (1, 10), (9, 50)], "ID10 long, ID20 long")
    b10 = spark.createDataFrame([(1, 4), (2, 9), (3, 3), (4, 5), (5, 7), (6, 10), (7, 20), (8, 99)],
                                "ID10 long, P10 long")
    ap = {r.ID20: r.eq_P10 for r in AP.apportion(cw, b10, ["P10"]).collect()}
    # id 1 appears twice (duplicate) -> each row gets 4/2, both land on 10
    assert ap[10] == pytest.approx(4.0)
    assert ap[20] == ap[21] == ap[22] == pytest.approx(3.0)
    assert ap[30] == pytest.approx(15.0)
    assert ap[40] == pytest.approx(15.0) and ap[41] == pytest.approx(15.0)
    assert ap[50] == 0.0                     # 2010 id without counts weighs 0 (Q11)
    # conservation: everything counted and present in the crosswalk is redistributed
    assert sum(ap.values()) == pytest.approx(4 + 9 + 3 + 5 + 7 + 10 + 20)


def test_half_rounding(spark):
    df = spark.createDataFrame([(v,) for v in (-2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 2.4999999999)], "v double")
    got = [r[0] for r in df.select(numeric.round_half_even("v")).collect()]
    assert got == [-2, -2, 0, 0, 2, 2, 2]


def test_reconcile(spark):
    # race diffs whose rounded sum misses P_delta by +1, -1 and 0
    base = {"ID20": 1, "STATE": 1, "COUNTY": "A", "P20": 10, "eq_P10": 7.5}
    recs = []
    for i, eq in enumerate([(0.5,) * 7, (1.5,) * 7, (0.2,) * 7]):
        r = dict(base, ID20=i)
        for k in range(1, 8):
            r[f"R20{k}"] = 2
            r[f"eq_R10{k}"] = float(eq[k - 1])
        recs.append(r)
    df = spark.createDataFrame(pd.DataFrame(recs))
    out = MG.race_migration_table(df)
    assert MG.reconcile_violations(out).count() == 0
    for r in out.collect():
        assert sum(r[f"R{k}_diff"] for k in range(1, 8)) == r.P_delta == 2   # 10 - 7.5 -> 2 (half even)


def test_net_lists_list_equals_ordinal(spark):
    pairs = [(5, 2), (2, 5), (3, 3), (0, 4), (4, 0), (0, 0)]
    df = spark.createDataFrame([(i, p20, p10) for i, (p20, p10) in enumerate(pairs)], "ID20 long, P20 int, P10 int")
    df = df.withColumn("net", numeric.sign_net(F.col("P20") - F.col("P10")))
    pieces = expand.list_pieces(df, expand.net_runs("P20", "P10", "net"), chunk_rows=2)
    assert pieces.where(F.size("codes") > 2).count() == 0
    lst = expand.explode_pieces(pieces, code="lab").where("lab != -99").select("ID20", "k", "lab")
    d2 = df.withColumn("n", expand.rows_per_block("P20", "P10", "net"))
    ordn = expand.explode_individuals(d2, "n", chunk_rows=2).select(
        "ID20", "k", expand.net_label("k", "P20", "P10", "net").alias("lab"))
    assert rows(lst, "ID20", "k", "lab") == rows(ordn, "ID20", "k", "lab")
    counts = {r.ID20: r.c for r in ordn.groupBy("ID20").agg(F.count("*").alias("c")).collect()}
    assert counts == {0: 5, 1: 5, 2: 3, 3: 4, 4: 4}          # max(P20, P10); (0,0) -> none


def test_box_inclusive_any_corner_order(spark):
    pts = spark.createDataFrame([(x, y) for x in (0.0, 0.5, 1.0, 1.5) for y in (0.0, 1.0, 2.0)], "easting double, northing double")
    a = filters.box_select(pts, (0.0, 1.0, 1.0, 0.0)).count()    # top-left / bottom-right as sent
    b = filters.box_select(pts, (1.0, 0.0, 0.0, 1.0)).count()
    assert a == b == 6


@pytest.mark.parametrize("n_groups", [10, 15, 20, 40])
def test_few_groups_top_bottom(spark, n_groups):
    data = [(g, (g * 7) % 5) for g in range(n_groups)]        # many ties
    df = spark.createDataFrame(data, "county long, cnt long")
    top = [r.county for r in topk.top_n(df, "cnt", "county", 15).orderBy("pos").collect()]
    bot = [r.county for r in topk.bottom_n(df, "cnt", "county", 15).orderBy("pos").collect()]
    full = sorted(data, key=lambda t: (-t[1], t[0]))
    assert top == [c for c, _ in full[:15]]
    assert bot == [c for c, _ in full[-15:]][::-1]              # pos 1 = smallest


def _py_pip(poly, x, y):
    inside = False
    for ring in poly:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                inside = not inside
    return inside


SQUARE = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]
ELL = [[(0, 0), (4, 0), (4, 2), (2, 2), (2, 4), (0, 4), (0, 0)]]
TRI = [[(0, 0), (4, 0), (2, 3), (0, 0)]]
HOLE = [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]]
POLYS = {"square": SQUARE, "ell": ELL, "tri": TRI, "hole": HOLE}
PROBES = [(0.5, 0.5), (3, 3), (2, 2), (1.5, 1.5), (0, 0), (4, 2), (2, 0), (2, 3), (3.9, 0.1), (5, 5), (-1, 1), (2, 4)]


def _poly_df(spark):
    recs = [(name, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in poly]) for name, poly in POLYS.items()]
    return spark.createDataFrame(recs, "name string, geometry array<array<struct<x:double,y:double>>>")


def test_rings_pip_matches_python(spark):
    polys = _poly_df(spark)
    probes = spark.createDataFrame([(float(x), float(y)) for x, y in PROBES], "x double, y double")
    j = polys.join(probes, how="cross")  # test-only: 4 polygons x 12 probes
    got = {(r.name, r.x, r.y): (r.a, r.b) for r in j.select(
        "name", "x", "y", geo.polygon_contains("geometry", "x", "y").alias("a"),
        geo.parts_contain(F.array(geo.polygon_edges("geometry")), "x", "y").alias("b")).collect()}
    for name, poly in POLYS.items():
        for x, y in PROBES:
            exp = _py_pip(poly, x, y)
            assert got[(name, float(x), float(y))] == (exp, exp), (name, x, y)


def test_spatial_join_overlap_and_multipart(spark):
    # two overlapping states and a two-part state
    recs = [("A", [[[(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]]]),
            ("B", [[[(1, 0), (3, 0), (3, 2), (1, 2), (1, 0)]]]),
            ("C", [[[(10, 10), (11, 10), (11, 11), (10, 11), (10, 10)]], [[(20, 20), (21, 20), (21, 21), (20, 21), (20, 20)]]])]
    mp = spark.createDataFrame(
        [(n, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in part] for part in parts]) for n, parts in recs],
        "state string, geometry array<array<array<struct<x:double,y:double>>>>")
    pts = spark.createDataFrame([(1.5, 1.0), (0.5, 0.5), (2.5, 1.0), (10.5, 10.5), (20.5, 20.5), (5.0, 5.0)], "x double, y double")
    j = spatial.spatial_join(pts, mp, "state", "x", "y", depth=3, per_side=4)
    got = sorted((r.x, r.y, r.state) for r in j.collect())
    assert got == [(0.5, 0.5, "A"), (1.5, 1.0, "A"), (1.5, 1.0, "B"), (2.5, 1.0, "B"),
                   (10.5, 10.5, "C"), (20.5, 20.5, "C")]


def test_raster_edges_and_mean_cancel(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1), (10.0, 0.0, 1), (0.0, 5.0, 1), (10.0, 5.0, 1), (11.0, 1.0, 1),
                                 (3.3, 3.3, -1), (3.3, 3.3, 1)], "easting double, northing double, net int")
    r = R.raster(pts, (0.0, 10.0, 0.0, 5.0), 10, 5, "count", "net")
    cells = {(c.px, c.py): c.value for c in r.collect()}
    assert cells[(0, 0)] == 1 and cells[(9, 0)] == 1 and cells[(0, 4)] == 1 and cells[(9, 4)] == 1
    assert cells[(3, 3)] == 2 and sum(cells.values()) == 6         # outside point dropped
    m = {(c.px, c.py): c.value for c in R.raster(pts, (0.0, 10.0, 0.0, 5.0), 10, 5, "mean", "net").collect()}
    assert m[(3, 3)] == 0.0                                          # Q16: mean cancels, rows exist
    assert X.row_count(pts).first().n_rows == 7


def test_counties_regex(spark):
    df = spark.createDataFrame([("Doña Ana County",), ("LaSalle Parish",), ("McLean County",), ("DeKalbCOUNTY",)], "c string")
    got = [(r.a, r.b) for r in df.select(ids.clean_county("c").alias("a"), ids.clean_county("c", True).alias("b")).collect()]
    assert got == [("Doa Ana County", "Doa Ana County"), ("Laalle Parish", "LaSalle Parish"),
                   ("Mcean County", "McLean County"), ("DealbCOUNTY", "DeKalb")]


def test_ids(spark):
    df = spark.createDataFrame([("G01000100201001000",)], "g string")
    assert df.select(ids.parse_gisjoin("g")).first()[0] == 10010201001000
    t = spark.createDataFrame([(1, 1, 201, 1000), (6, 37, 1234567, 12)], "s int, c int, t int, b int")
    got = [r[0] for r in t.select(ids.compose_block_id("s", "c", "t", "b")).collect()]
    assert got == [10010002011000, int("06037" + "1234567" + "0012")]   # over-long tract kept whole


def test_bfill_start_middle_end(spark):
    vals = [None, None, 3, None, 5, None, None, 8, None, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v long")
    for rr in (1, 2, 7):
        got = [r.f for r in windows.bfill(df.repartition(rr), "v", "k", out="f").orderBy("k").collect()]
        assert got == [3, 3, 3, 5, 5, 8, 8, 8, None, None], rr


def test_bfill_reads_each_row_of_a_range_once(spark):
    """A frame that ends with the range is read again for every row: its work is the square of the range."""
    n = 120_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("v"),
                               F.when(F.col("id") < n // 2, F.col("id")).alias("w"))
    out = windows.bfill(df, "v", "k", out="f")
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.count() == n and out.where("not f <=> (k div 1000) * 1000 + 999").count() == 0
    tail = windows.bfill(df, "w", "k", out="f")
    assert tail.where(f"not f <=> if(k < {n // 2}, k, null)").count() == 0


def test_bfill_with_rows_and_keys_missing(spark):
    """No value at all, a null key and a repeated row: as the window over all rows says."""
    d = spark.createDataFrame([(None, 7), (1, None), (2, 5), (2, 5), (3, None)], "k long, v long")
    got = sorted(((r.k or 0), r.f or 0) for r in windows.bfill(d, "v", "k", out="f").collect())
    assert got == [(0, 7), (1, 5), (2, 5), (2, 5), (3, 0)]
    assert windows.bfill(d.withColumn("v", F.lit(None).cast("long")), "v", "k", out="f").where("f is not null").isEmpty()


def test_county_lookup_by_name_or_state(spark):
    from blockflow.plans import datasets as DS
    dim = spark.createDataFrame([(1, "Montgomery County", 24), (2, "Montgomery County", 39), (3, "Kent", 10)],
                                "id long, name string, state int")
    blocks = spark.createDataFrame([(100, "Montgomery County", 24), (101, "Montgomery County", 39), (102, "Kent", 10)],
                                   "ID20 long, COUNTY string, STATE int")
    by_name = {r["ID20"]: r["__cid"] for r in DS.with_county_id(blocks, dim).collect()}
    by_state = {r["ID20"]: r["__cid"] for r in DS.with_county_id(blocks, dim, by_state=True).collect()}
    assert by_name == {100: 2, 101: 2, 102: 3}          # parity: same name, one id
    assert by_state == {100: 1, 101: 2, 102: 3}

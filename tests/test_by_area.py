"""Points drawn by area: trapezoids against areas, every point inside, shares even."""

import random

import pytest
from pyspark.sql import functions as F

from blockflow.functions import exact, geo
from blockflow.operators import by_area

GEO = "array<array<struct<x:double,y:double>>>"


def ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in [*xy, xy[0]]]


def star(rng, n, x, y, w):
    """A ring around (x, y) that doesn't cross itself."""
    import math
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    far = [w * rng.uniform(0.2, 1) for _ in angles]
    return ring(*[(x + r * math.cos(a), y + r * math.sin(a)) for r, a in zip(far, angles)])


def shapes():
    rng = random.Random(5)
    out = [(1, [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))]),              # a hole
           (2, [ring((0, 0), (100, 100), (100, 100.0001), (0, 0.0001))]),                                    # a sliver: 1e-6 of its box
           (3, [ring((0, 0), (10, 0), (10, 1), (1, 1), (1, 9), (10, 9), (10, 10), (0, 10))]),                # a C
           (4, [ring((0, 0), (2, 0), (1, 3))]), (5, [ring((0, 0), (0, 3), (2, 3))])]
    return out + [(10 + i, [star(rng, rng.randrange(5, 40), rng.uniform(-100, 100), rng.uniform(-50, 50), 10.0 ** rng.randrange(-3, 2))]) for i in range(25)]


def simple(polys):
    """Those whose rings don't cross themselves (random stars may)."""
    def crosses(r):
        def side(a, b, c):
            return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
        e = list(zip(r, r[1:]))
        return any(side(*p, q[0]) * side(*p, q[1]) < 0 and side(*q, p[0]) * side(*q, p[1]) < 0 for i, p in enumerate(e) for q in e[i + 2:])
    return [(i, g) for i, g in polys if not any(crosses(r) for r in g)]


def test_trapezoids_have_the_polygons_area_and_points_lie_inside(spark):
    rows = simple(shapes())
    assert len(rows) > 15
    polys = spark.createDataFrame(rows, f"ID20 long, geometry {GEO}")
    t = by_area.trapezoids(polys)
    for r in t.select(geo.even_odd_area("geometry").alias("a"), F.element_at("__upto", -1).alias("b")).collect():
        assert r["b"] == pytest.approx(r["a"], rel=1e-9)
    pts = by_area.individuals_by_area(t.withColumn("n", F.lit(500)), "n", chunk_rows=64)
    assert pts.columns == ["ID20", "n", "k", "x", "y"]
    located = pts.join(polys, "ID20").select(exact.locate("geometry", "x", "y").alias("place")).groupBy("place").count().collect()
    assert {r["place"]: r["count"] for r in located} == {1: 500 * len(rows)}
    again = by_area.individuals_by_area(t.withColumn("n", F.lit(500)), "n", chunk_rows=4096, partitions=2)
    assert pts.exceptAll(again).count() == 0                          # the same points however they are dealt


def test_shares_go_by_area(spark):
    polys = spark.createDataFrame(shapes()[:5], f"ID20 long, geometry {GEO}").where("ID20 in (1, 3, 4)")
    n = 40000
    pts = by_area.individuals_by_area(by_area.trapezoids(polys).withColumn("n", F.lit(n)), "n", seed=3)

    def share(i, condition):
        return pts.where((F.col("ID20") == i) & F.expr(condition)).count() / n
    sigma = 4 * 0.5 / n ** 0.5
    assert abs(share(1, "x < 1") - 4 / 12) < sigma and abs(share(1, "y >= 3") - 4 / 12) < sigma
    assert abs(share(3, "x >= 1 and y < 5") - 9 / 28) < sigma and abs(share(3, "x < 1") - 10 / 28) < sigma
    assert abs(share(4, "y < 1") - (1 - (2 / 3) ** 2)) < sigma and abs(share(4, "x < 1") - 0.5) < sigma


def test_multipolygons_and_what_cannot_be_drawn(spark):
    two = spark.createDataFrame([(1, [[ring((0, 0), (1, 0), (1, 1), (0, 1))], [ring((5, 0.5), (8, 0.5), (8, 1.5), (5, 1.5))]])], f"ID20 long, geometry array<{GEO}>")
    pts = by_area.individuals_by_area(by_area.trapezoids(two, depth=3).withColumn("n", F.lit(8000)), "n")
    assert abs(pts.where("x > 4").count() / 8000 - 0.75) < 0.03
    bow = spark.createDataFrame([(1, [ring((0, 0), (2, 2), (2, 0), (0, 2))])], f"ID20 long, geometry {GEO}")
    with pytest.raises(Exception, match="crosses itself"):
        by_area.trapezoids(bow).collect()
    flat = spark.createDataFrame([(1, [ring((0, 0), (2, 2), (1, 1))]), (2, []), (3, None)], f"ID20 long, geometry {GEO}")
    t = by_area.trapezoids(flat.where("ID20 < 3"))
    assert [len(r["__traps"]) for r in t.collect()] == [0, 0]
    with pytest.raises(Exception, match="without area"):
        by_area.individuals_by_area(t.withColumn("n", F.lit(1)), "n").collect()

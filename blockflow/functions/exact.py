"""Point in polygon without rounding (F14): inside, on the border or outside.

The orientation of a point to an edge is the sign of a determinant of
differences.  Three stages, each taken only where the one before can't tell:

1. its floating-point value, where that is larger than its possible error;
2. where the four differences have no rounding error (as for most points near
   an edge), the two products compared: rounding keeps their order, and where
   they round alike the errors of the rounding decide;
3. else the determinant written out as six products of coordinates, each split
   into its rounded value and the error of the rounding, the twelve parts added
   to an expansion whose last part that is not zero has the sign of the whole.

The stages are folds, which Spark interprets node by node: values used more
than once are bound once (:func:`_let`), never written out again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_SPLIT = 134217729.0                                    # 2^27 + 1
_BOUND = 3.3306690738754716e-16                         # error of the determinant relative to its two products
PARTS = "array<double>"


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of ``values``, which are evaluated once."""
    one = F.array(F.struct(*(v.alias(k) for k, v in values.items())))
    return F.get(F.transform(one, body), F.lit(0))


def _sum(a: Column, b: Column) -> tuple[Column, Column]:
    s = a + b
    back = s - a
    return s, (a - (s - back)) + (b - back)


def _lost(a: Column, b: Column, d: Column) -> Column:
    """What rounding took from the difference ``d`` of ``a`` and ``b``."""
    back = a - d
    return (a - (d + back)) + (back - b)


def _high(v: Column) -> Column:
    """The upper half of the digits."""
    c = F.lit(_SPLIT) * v
    return c - (c - v)


def _rest(p: Column, ah: Column, al: Column, bh: Column, bl: Column) -> Column:
    """What rounding took from the product ``p`` of two numbers, given by halves."""
    return ((ah * bh - p) + ah * bl + al * bh) + al * bl


def _grown(expansion: Column, part: Column) -> Column:
    """The expansion with one more part added without loss (parts in growing size)."""
    start = F.struct(part.alias("q"), F.array().cast(PARTS).alias("parts"))

    def step(acc, e):
        s, error = _sum(acc["q"], e)
        return F.struct(s.alias("q"), F.concat(acc["parts"], F.array(error)).alias("parts"))
    return F.aggregate(expansion, start, step, lambda acc: F.concat(acc["parts"], F.array(acc["q"])))


def _exact_sign(ax, ay, bx, by, px, py) -> Column:
    names = ("ax", "ay", "bx", "by", "px", "py")

    def parts(v):
        out = []
        for a, b, sign in (("ax", "by", 1.0), ("ay", "bx", -1.0), ("bx", "py", 1.0), ("by", "px", -1.0), ("px", "ay", 1.0), ("py", "ax", -1.0)):
            p = v[a] * v[b]
            halves = (v[f"{a}h"], v[a] - v[f"{a}h"], v[f"{b}h"], v[b] - v[f"{b}h"])
            out += [F.lit(sign) * p, F.lit(sign) * _rest(p, *halves)]
        return F.array(*out)
    coordinates = dict(zip(names, (ax, ay, bx, by, px, py)))
    split = _let(parts, **coordinates, **{f"{k}h": _high(v) for k, v in coordinates.items()})
    total = F.aggregate(split, F.array().cast(PARTS), _grown)
    return F.aggregate(total, F.lit(0), lambda acc, v: F.when(v != 0, F.signum(v).cast("int")).otherwise(acc))


def _sign_of_products(v: Column) -> Column:
    """The sign of acx * bcy - acy * bcx, rounded to ``left`` and ``right``, for differences without error."""
    def tails(h):
        halves = {k: (h[k], v[k] - h[k]) for k in ("acx", "bcy", "acy", "bcx")}
        return F.signum(_rest(v["left"], *halves["acx"], *halves["bcy"]) - _rest(v["right"], *halves["acy"], *halves["bcx"])).cast("int")
    return F.when(v["left"] != v["right"], F.signum(v["left"] - v["right"]).cast("int")).otherwise(
        _let(tails, **{k: _high(v[k]) for k in ("acx", "bcy", "acy", "bcx")}))


def orientation(ax, ay, bx, by, px, py) -> Column:
    """1, 0 or -1: the point (px, py) lies left of, on or right of the line from (ax, ay) to (bx, by).  Exact."""
    def products(d):
        return _let(sign, acx=d["acx"], bcy=d["bcy"], acy=d["acy"], bcx=d["bcx"], left=d["acx"] * d["bcy"], right=d["acy"] * d["bcx"])

    def sign(v):
        det = v["left"] - v["right"]
        sure = F.abs(det) > F.lit(_BOUND) * (F.abs(v["left"]) + F.abs(v["right"]))
        whole = F.lit(True)
        for a, b, d in ((ax, px, "acx"), (by, py, "bcy"), (ay, py, "acy"), (bx, px, "bcx")):
            whole = whole & (_lost(a, b, v[d]) == 0)
        return F.when(sure, F.signum(det).cast("int")).when(whole, _sign_of_products(v)).otherwise(_exact_sign(ax, ay, bx, by, px, py))
    return _let(products, acx=ax - px, bcy=by - py, acy=ay - py, bcx=bx - px)


def _ring(r: Column, px: Column, py: Column) -> Column:
    """struct(odd, border) of one closed ring."""
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("border"))

    def step(acc, i):
        a, b = F.get(r, i), F.get(r, i + 1)
        return _let(lambda e: edge(acc, *(e[k] for k in ("ax", "ay", "bx", "by"))), ax=a["x"], ay=a["y"], bx=b["x"], by=b["y"])

    def edge(acc, ax, ay, bx, by):
        straddles = (ay > py) != (by > py)
        # only edges whose box the point touches, or that its ray may cross, are asked for their side
        near = (py >= F.least(ay, by)) & (py <= F.greatest(ay, by)) & (px <= F.greatest(ax, bx))
        side = F.when(near, orientation(ax, ay, bx, by, px, py))
        # an upward edge is crossed by points on its left, a downward one by those on its right

        def taken(t, s):
            crossed = straddles & F.coalesce(F.when(by > ay, s > 0).otherwise(s < 0), F.lit(False))
            on = F.coalesce((s == 0) & (px >= F.least(ax, bx)), F.lit(False))
            return F.struct((t["odd"] != crossed).alias("odd"), (t["border"] | on).alias("border"))
        return F.aggregate(F.array(side), acc, taken)          # the side is asked for once
    return F.when(F.size(r) >= 4, F.aggregate(F.sequence(F.lit(0), F.size(r) - 2), start, step)).otherwise(start)


def locate(poly, px, py) -> Column:
    """1 inside, 0 on the border, -1 outside a polygon (rings, even-odd), exactly."""
    poly, px, py = (F.col(c) if isinstance(c, str) else c for c in (poly, px, py))
    start = F.struct(F.lit(False).alias("odd"), F.lit(False).alias("border"))

    def step(acc, r):
        one = F.array(_ring(r, px, py))
        return F.aggregate(one, acc, lambda t, s: F.struct((t["odd"] != s["odd"]).alias("odd"), (t["border"] | s["border"]).alias("border")))
    return F.aggregate(poly, start, step, lambda t: F.when(t["border"], F.lit(0)).when(t["odd"], F.lit(1)).otherwise(F.lit(-1)))


def contains(poly, px, py) -> Column:
    """Strictly inside: a point on the border is out."""
    return locate(poly, px, py) == 1

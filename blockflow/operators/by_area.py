"""Uniform points in polygons without rejection (G2 for thin polygons).

A polygon is cut at the heights of its vertices into slabs; inside a slab its
edges do not meet, so sorted from left to right they pair up (even-odd) into
trapezoids, holes and several parts included.  A point takes one draw: a
trapezoid by its share of the area, a height whose density is the trapezoid's
width there, and a place across.  So the cost of a point does not depend on
how little of its box a polygon fills, as it does for rejection sampling
(``spatial.points_in_polygon``), where a sliver filling a millionth needs a
million attempts.

The trapezoids are made once per polygon, by array expressions on its row (the
work grows with the square of its vertices), and stand once per chunk of
individuals.  Rings that cross themselves have edges whose order changes inside
a slab: that is an error, such polygons are for rejection sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rand import TWO_32
from . import expand

TRAPEZOID = "struct<ya:double,yb:double,la:double,lb:double,ra:double,rb:double,area:double>"


def trapezoids(polys: DataFrame, geom: str = "geometry", depth: int = 2) -> DataFrame:
    """``polys`` with ``__traps`` (the trapezoids from bottom to top, left to
    right) and ``__upto`` (their areas added up).  A polygon without area has
    none; parts of a multipolygon must not overlap."""
    rings = f"flatten(`{geom}`)" if depth == 3 else f"`{geom}`"
    pairs = (f"flatten(transform({rings}, r -> transform(sequence(0, greatest(size(r) - 2, 0)), i -> named_struct("
             "'x1', get(r, i).x, 'y1', get(r, i).y, 'x2', get(r, i + 1).x, 'y2', get(r, i + 1).y))))")
    upward = ("transform(filter(__e, e -> e.y1 != e.y2 and e.x2 is not null), e -> if(e.y1 < e.y2, e, "
              "named_struct('x1', e.x2, 'y1', e.y2, 'x2', e.x1, 'y2', e.y1)))")
    d = polys.withColumn("__e", F.expr(pairs)).withColumn("__e", F.expr(upward))
    d = d.withColumn("__y", F.expr("array_sort(array_distinct(concat(transform(__e, e -> e.y1), transform(__e, e -> e.y2))))"))

    def at(y: str) -> str:                     # the edge's x at a height, its ends exactly
        return f"case when {y} = e.y1 then e.x1 when {y} = e.y2 then e.x2 else e.x1 + (e.x2 - e.x1) * (({y} - e.y1) / (e.y2 - e.y1)) end"
    # x in the middle of the slab first: it orders the edges
    slabs = ("transform(sequence(0, size(__y) - 2), j -> transform(array(named_struct('ya', get(__y, j), 'yb', get(__y, j + 1))), s -> named_struct("
             "'ya', s.ya, 'yb', s.yb, 'across', array_sort(transform(filter(__e, e -> e.y1 <= s.ya and e.y2 >= s.yb), e -> named_struct("
             f"'m', ({at('s.ya')}) + ({at('s.yb')}), 'a', {at('s.ya')}, 'b', {at('s.yb')}))))))")
    d = d.withColumn("__s", F.expr(f"if(size(__y) < 2, null, flatten({slabs}))")).withColumn("__s", F.expr("coalesce(__s, array())"))
    crossed = ("exists(__s, s -> exists(sequence(1, greatest(size(s.across) - 1, 1)), i -> coalesce("
               "get(s.across, i).a < get(s.across, i - 1).a or get(s.across, i).b < get(s.across, i - 1).b, false)))")
    one = ("named_struct('ya', s.ya, 'yb', s.yb, 'la', get(s.across, 2 * i).a, 'lb', get(s.across, 2 * i).b, "
           "'ra', get(s.across, 2 * i + 1).a, 'rb', get(s.across, 2 * i + 1).b, 'area', ((get(s.across, 2 * i + 1).a - get(s.across, 2 * i).a) "
           "+ (get(s.across, 2 * i + 1).b - get(s.across, 2 * i).b)) * (s.yb - s.ya) / 2D)")
    traps = f"flatten(transform(filter(__s, s -> size(s.across) > 1), s -> transform(sequence(0, cast(size(s.across) / 2 as int) - 1), i -> {one})))"
    error = f"cast(raise_error('a ring crosses itself: sample this polygon by rejection') as array<{TRAPEZOID}>)"
    d = d.withColumn("__traps", F.expr(f"if({crossed}, {error}, filter(cast({traps} as array<{TRAPEZOID}>), t -> t.area > 0))"))
    upto = ("if(size(__traps) = 0, cast(array() as array<double>), aggregate(slice(__traps, 2, greatest(size(__traps) - 1, 0)), "
            "array(get(__traps, 0).area), (sums, t) -> concat(sums, array(element_at(sums, -1) + t.area))))")
    return d.withColumn("__upto", F.expr(upto)).drop("__e", "__y", "__s")


def _uniform(h: str, first: int) -> str:
    """Strictly inside (0, 1): the middle of one of 2^32 steps."""
    return f"((cast(conv(substring({h}, {first}, 8), 16, 10) as double) + 0.5D) / {TWO_32!r}D)"


def _point(prefix: str, seed: int) -> str:
    """struct(x, y) from the md5 of ``key:k:area:seed``: hex digits 1-8 pick the trapezoid, 9-16 the height, 17-24 the place across."""
    t, x = "h.t", "h.c"
    share = f"({_uniform(t, 9)} * ({x}.ra - {x}.la + {x}.rb - {x}.lb))"
    bottom, top = f"({x}.ra - {x}.la)", f"({x}.rb - {x}.lb)"
    up = f"({share} / ({bottom} + sqrt({bottom} * {bottom} + {_uniform(t, 9)} * ({top} * {top} - {bottom} * {bottom}))))"
    pick = f"get(__traps, least(size(filter(__upto, u -> u <= {_uniform('d', 1)} * element_at(__upto, -1))), size(__traps) - 1))"
    digest = f"md5(concat({prefix}, 'area:{seed}'))"
    chosen = f"transform(array({digest}), d -> named_struct('t', d, 'c', {pick}))"
    across = f"(w.l + {_uniform('w.t', 17)} * (w.r - w.l))"
    width = (f"transform(transform({chosen}, h -> named_struct('t', h.t, 'c', h.c, 'up', {up})), h -> named_struct('t', h.t, "
             f"'l', {x}.la + h.up * ({x}.lb - {x}.la), 'r', {x}.ra + h.up * ({x}.rb - {x}.ra), 'y', {x}.ya + h.up * ({x}.yb - {x}.ya)))")
    return f"get(transform({width}, w -> named_struct('x', {across}, 'y', w.y)), 0)"


def individuals_by_area(blocks: DataFrame, n, key: str = "ID20", k: str = "k", seed: int = 0, chunk_rows: int = 1 << 12,
                        spread: bool = True, partitions: int | None = None) -> DataFrame:
    """E5 + G2: a uniform point in its polygon for k = 1..n of every block (a row
    of :func:`trapezoids`), one draw each; adds ``k``, ``x`` and ``y``.  An
    individual in a polygon without area is an error."""
    d = expand.chunks(blocks, n, key, chunk_rows, partitions, spread)
    prefix = f"concat(cast(`{key}` as string), ':', cast(i as string), ':')"
    none = "cast(raise_error('polygon without area') as array<struct<k:bigint,p:struct<x:double,y:double>>>)"
    at = f"if(size(__traps) = 0, {none}, transform(sequence(__lo, __hi), i -> named_struct('k', i, 'p', {_point(prefix, seed)})))"
    keep = [f"`{c}`" for c in d.columns if c not in ("__lo", "__hi", "__traps", "__upto", "geometry")]
    d = d.selectExpr(*keep, f"explode({at}) as __i")
    return d.selectExpr(*keep, f"__i.k as `{k}`", "__i.p.x as x", "__i.p.y as y")

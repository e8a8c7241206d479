"""Spatial operators: point-in-polygon join (J8-J10) and random points in
boxes / polygons (G1, G2).

The join turns the theta join "point inside polygon" into an equi-join on a
grid cell: each polygon lists the cells of its bounding box on the grid level
of its own size, each point has one cell per level in use, so a (point,
polygon) pair meets at most once and no nested-loop join is planned.  Cells
that no polygon edge touches are decided once per cell (centre test); only
points in boundary cells pay the exact even-odd ray cast, against the edges
of their polygon's grid row (the only edges a horizontal ray from that row
can cross).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..functions.rand import TWO_32, uniform
from ..session import checkpoint_dir
from . import expand

#: Least share of the box a polygon with an interior is taken to fill, and the
#: factor on the attempts (see :func:`sampling_params`).
LEAST_FILL, SAFETY = 1e-6, 8
CAND = "struct<a:bigint,x:double,y:double>"
#: Polygons of one part with at most this many edges are tested by an unrolled
#: expression, and their first attempt is plain columns (more than one make a
#: method too large for the JVM's compiler: measured three times slower).
FEW = 8


def _edges(geom: str, depth: int):
    """Per-part edge lists (array<array<edge>>) of a polygon or multipolygon."""
    g = F.col(geom)
    return F.array(geo.polygon_edges(g)) if depth == 2 else geo.multipolygon_edges(g)


def with_bounds(polys: DataFrame, geom: str = "geometry", depth: int = 2) -> DataFrame:
    """add ``__minx, __miny, __maxx, __maxy``."""
    b = geo.bounds(geom, depth)
    return polys.withColumn("__b", b).withColumns({
        "__minx": F.col("__b.minx"), "__miny": F.col("__b.miny"),
        "__maxx": F.col("__b.maxx"), "__maxy": F.col("__b.maxy")}).drop("__b")


def with_level(polys: DataFrame, geom: str = "geometry", depth: int = 2, per_side: int = 16) -> DataFrame:
    """Bounds and the polygon's own grid level: cells of 2**level, the
    smallest with at most ``per_side`` of them along the longer side, so a
    polygon of any size or shape has at most (per_side + 2) ** 2 cells."""
    b = with_bounds(polys, geom, depth)
    side = F.greatest(F.col("__maxx") - F.col("__minx"), F.col("__maxy") - F.col("__miny"))
    level = F.when(side > 0, F.ceil(F.log2(side / F.lit(float(per_side))))).otherwise(F.lit(0)).cast("int")
    # cell numbers must stay exact: no level below 2**-40 of the largest coordinate
    reach = F.greatest(F.abs("__minx"), F.abs("__maxx"), F.abs("__miny"), F.abs("__maxy"), F.lit(1e-300))
    level = F.greatest(level, (F.ceil(F.log2(reach)) - 40).cast("int"))
    return b.withColumn("__lvl", level).withColumn("__s", F.pow(F.lit(2.0), F.col("__lvl")))


def _all_edges(geom: str, depth: int) -> Column:
    """Every edge (horizontal ones too) as (x1, y1, x2, y2): for cell tagging."""
    g = F.col(geom)
    rings = F.flatten(g) if depth == 3 else g

    def ring_pairs(r):
        idx = F.sequence(F.lit(0), F.greatest(F.size(r) - 2, F.lit(0)))
        return F.filter(F.transform(idx, lambda i: F.struct(
            F.get(r, i)["x"].alias("x1"), F.get(r, i)["y"].alias("y1"),
            F.get(r, i + 1)["x"].alias("x2"), F.get(r, i + 1)["y"].alias("y2"))),
            lambda e: e["x2"].isNotNull())

    return F.flatten(F.transform(rings, ring_pairs))


def _cells_of_box(x0, x1, y0, y1, s) -> tuple[Column, Column]:
    cx = F.explode(F.sequence(F.floor(x0 / s), F.floor(x1 / s)))
    cy = F.explode(F.sequence(F.floor(y0 / s), F.floor(y1 / s)))
    return cx, cy


def polygon_cells(polys: DataFrame, key: str, geom: str = "geometry", depth: int = 2) -> DataFrame:
    """Grid cells of each polygon (rows of :func:`with_level`), tagged
    ``boundary`` (an edge touches the closed cell) or interior (no edge
    touches it and its centre is inside).  Cells of the bounding box that are
    outside are dropped.  Columns: key, __lvl, __cx, __cy, __boundary.
    """
    s = F.col("__s")
    b = polys.select(key, geom, "__lvl", "__s", "__minx", "__maxx", "__miny", "__maxy")
    # boundary cells: the cells of every edge's bounding box
    e = b.select(key, "__lvl", "__s", F.explode(_all_edges(geom, depth)).alias("e"))
    e = e.select(key, "__lvl", "__s", F.least("e.x1", "e.x2").alias("ex0"), F.greatest("e.x1", "e.x2").alias("ex1"),
                 F.least("e.y1", "e.y2").alias("ey0"), F.greatest("e.y1", "e.y2").alias("ey1"))
    ecx, ecy = _cells_of_box(F.col("ex0"), F.col("ex1"), F.col("ey0"), F.col("ey1"), s)
    boundary = e.withColumn("__cx", ecx).withColumn("__cy", ecy).select(key, "__lvl", "__cx", "__cy").distinct()
    # the remaining cells of the box are wholly inside or wholly outside: test the centre once
    bcx, bcy = _cells_of_box(F.col("__minx"), F.col("__maxx"), F.col("__miny"), F.col("__maxy"), s)
    box = b.withColumn("__cx", bcx).withColumn("__cy", bcy)
    rest = box.join(boundary, [key, "__lvl", "__cx", "__cy"], "left_anti")
    centre_x = (F.col("__cx") + F.lit(0.5)) * s
    centre_y = (F.col("__cy") + F.lit(0.5)) * s
    interior = rest.where(geo.parts_contain(_edges(geom, depth), centre_x, centre_y)).select(key, "__lvl", "__cx", "__cy")
    return (boundary.withColumn("__boundary", F.lit(True))
            .unionByName(interior.withColumn("__boundary", F.lit(False))))


def band_edges(polys: DataFrame, key: str, geom: str = "geometry", depth: int = 2) -> DataFrame:
    """Edge lists per polygon (rows of :func:`with_level`) and grid row: only
    the non-horizontal edges whose y-range meets the row band, kept per part.
    A ray from a point in that band can only cross those edges, so the parity
    test over them equals the test over the whole polygon.  Columns: key,
    __cy, __edges (array<array<edge>>, one list per part).  Grouped per
    polygon row band: the groups are bounded by the polygon's vertex count,
    not by the data.
    """
    s = F.col("__s")
    parts = polys.select(key, "__s", F.posexplode(_edges(geom, depth)).alias("__part", "__pe"))
    e = parts.select(key, "__s", "__part", F.explode("__pe").alias("e"))
    lo, hi = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    e = e.withColumn("__cy", F.explode(F.sequence(F.floor(lo / s), F.floor(hi / s))))
    per_part = e.groupBy(key, "__cy", "__part").agg(F.collect_list("e").alias("__pe"))
    return per_part.groupBy(key, "__cy").agg(F.collect_list("__pe").alias("__edges"))


def spatial_join(points: DataFrame, polys: DataFrame, key: str, x: str = "x", y: str = "y",
                 geom: str = "geometry", depth: int = 2, per_side: int = 16,
                 max_broadcast_bytes: int = 256 << 20) -> DataFrame:
    """Every (point, polygon) pair with the point inside the polygon.

    ``key`` identifies a polygon; a repeated or null key is an error.  The
    other polygon columns are attached to the matches.  A point inside several
    overlapping polygons appears once per polygon; a point inside none
    disappears (Q19).  One pass over the points:

    1. a point takes its cell on each grid level in use (a few numbers) and
       joins the polygon cells on (level, cell);
    2. a match in a boundary cell takes the edges of its polygon's row band
       and runs the even-odd ray cast over those; a match in an interior cell
       joins nothing and is final.

    The polygon-side tables are built and checkpointed when the plan is made
    (jobs over the polygons only).  Either is broadcast only after its size
    in bytes has been checked; otherwise the join shuffles and AQE splits hot
    keys.
    """
    check_names(points, polys, key, geom, set())
    check_key(polys, key)
    checkpoint_dir(polys.sparkSession)
    p = with_level(polys.select(key, geom), geom, depth, per_side).checkpoint(eager=True)
    cells = polygon_cells(p, key, geom, depth).checkpoint(eager=True)
    bands = band_edges(p, key, geom, depth).checkpoint(eager=True)
    levels = sorted(r["__lvl"] for r in p.where(F.col("__lvl").isNotNull()).select("__lvl").distinct().collect())
    if not levels:
        return no_matches(points, polys, key, geom)
    cell_bytes = (48 + key_bytes(polys, key)) * cells.count()
    cells_side = F.broadcast(cells) if cell_bytes <= max_broadcast_bytes else cells

    # one cell per level (the levels span the sizes of the polygons, powers of two)
    pts = points.withColumn("__lvl", F.explode(F.array(*[F.lit(v) for v in levels])))
    s = F.pow(F.lit(2.0), F.col("__lvl"))
    pts = pts.withColumns({"__cx": F.floor(F.col(x) / s), "__cy": F.floor(F.col(y) / s)})
    cand = pts.join(cells_side, ["__lvl", "__cx", "__cy"]).drop("__lvl", "__cx")
    out = decided(cand, bands, key, x, y, key_bytes(polys, key), max_broadcast_bytes)
    return with_attributes(out, polys, key, geom, max_broadcast_bytes)


def check_names(points: DataFrame, polys: DataFrame, key: str, geom: str, more: set[str]) -> None:
    """A column that both sides have, or that the join uses, is an error."""
    names = {"__lvl", "__s", "__cx", "__cy", "__boundary", "__edges", "__bk", "__by", "__row"} | more
    if names & {c.lower() for c in points.columns + polys.columns}:
        raise ValueError(f"column names {sorted(names)} are used by the join")
    shared = {c.lower() for c in points.columns} & {c.lower() for c in polys.columns if c != geom}
    if shared:
        raise ValueError(f"points and polygons both have {sorted(shared)}: rename one side")


def check_key(polys: DataFrame, key: str) -> None:
    n = polys.agg(F.count(F.lit(1)), F.count(key), F.count_distinct(key)).first()
    if n[0] != n[2]:
        raise ValueError(f"{key!r} must name each polygon once: {n[0]} rows, {n[2]} different keys")


def no_matches(points: DataFrame, polys: DataFrame, key: str, geom: str, drop: str | None = None) -> DataFrame:
    none = {f.name: F.lit(None).cast(f.dataType) for f in polys.schema if f.name != geom}
    out = points.where(F.lit(False)).withColumns(none)
    return out.drop(drop) if drop else out


def key_bytes(polys: DataFrame, key: str) -> int:
    kind = polys.schema[key].dataType
    return 8 + (kind.defaultSize() if hasattr(kind, "defaultSize") else 32)


def decided(cand: DataFrame, bands: DataFrame, key: str, x: str, y: str, key_size: int, max_broadcast_bytes: int) -> DataFrame:
    """The candidates (point columns, ``key``, __boundary, __cy: the polygon's
    grid row of the point) that lie inside: interior matches as they are,
    boundary matches after the ray cast over their row's edges."""
    stats = bands.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.flatten("__edges"))).alias("ne")).first()
    edge_bytes = 48 * (stats["ne"] or 0) + (64 + key_size) * stats["n"]
    bands = bands.select(F.col(key).alias("__bk"), F.col("__cy").alias("__by"), "__edges")
    bands_side = F.broadcast(bands) if edge_bytes <= max_broadcast_bytes else bands
    # interior matches have a band key that exists nowhere, spread by their place, should the join shuffle
    far = F.lit(-(1 << 61)) - F.pmod(F.xxhash64(x, y), F.lit(1 << 20))
    cand = cand.withColumn("__row", F.when(F.col("__boundary"), F.col("__cy")).otherwise(far))
    out = cand.join(bands_side, (F.col(key) == F.col("__bk")) & (F.col("__row") == F.col("__by")), "left")
    inside = ~F.col("__boundary") | geo.parts_contain(F.coalesce(F.col("__edges"), F.array()), F.col(x), F.col(y))
    return out.where(inside).drop("__boundary", "__cy", "__row", "__bk", "__by", "__edges")


def with_attributes(matches: DataFrame, polys: DataFrame, key: str, geom: str, max_broadcast_bytes: int) -> DataFrame:
    """The other polygon columns attached to the matches; their table is
    broadcast only when its size, strings measured, is within the bound."""
    attrs = [c for c in polys.columns if c not in (key, geom)]
    if not attrs:
        return matches
    table = polys.select(key, *attrs).checkpoint(eager=True)
    text = [F.sum(F.octet_length(F.to_json(F.struct(F.col(c))))) for c in attrs]
    sizes = table.agg(F.count(F.lit(1)), *text).first()
    small = (32 + key_bytes(polys, key)) * sizes[0] + sum(v or 0 for v in sizes[1:]) <= max_broadcast_bytes
    return matches.join(F.broadcast(table) if small else table.hint("merge"), key)


def count_per_polygon(joined: DataFrame, key: str) -> DataFrame:
    """Points per polygon (per state) after the join."""
    return joined.groupBy(key).agg(F.count(F.lit(1)).alias("points"))


# --- random points ------------------------------------------------------------

def sampling_params(polys: DataFrame, geom: str = "geometry", depth: int = 2,
                    fail_prob: float = 1e-15, first: int = 16) -> DataFrame:
    """Per polygon: bounding box and the attempt budget for rejection sampling.

    With ``fill`` = polygon area / box area, ``attempts`` is the smallest m
    with ``(1 - fill)^m <= fail_prob``, times ``SAFETY`` (rings crossing
    themselves can have less inside than the shoelace sum says), at least
    ``first``.  Where the areas cancel (a bow-tie) the fill is taken as
    ``LEAST_FILL``.  The largest ring is the outer one, whatever the order of
    rings.  A polygon whose vertices lie on one line has no interior: its
    budget is null and sampling in it raises.
    """
    b = with_bounds(polys, geom, depth)
    box = (F.col("__maxx") - F.col("__minx")) * (F.col("__maxy") - F.col("__miny"))
    parts = F.array(F.col(geom)) if depth == 2 else F.col(geom)
    area = F.aggregate(F.transform(parts, geo.even_odd_area), F.lit(0.0), lambda acc, a: acc + a)
    fill = F.least(F.greatest(F.try_divide(area, box), F.lit(LEAST_FILL)), F.lit(1.0))
    m = F.ceil(F.lit(SAFETY * math.log(fail_prob)) / F.log1p(-fill))
    solid = (box > 0) & F.exists(F.flatten(parts), geo.ring_has_corner)
    att = (F.when(~F.coalesce(solid, F.lit(False)), F.lit(None).cast("long"))
           .when(fill >= 1.0 - 1e-12, F.lit(first).cast("long"))
           .otherwise(F.greatest(F.lit(first).cast("long"), m.cast("long"))))
    edges = _edges(geom, depth)
    few = F.when((F.size(edges) == 1) & (F.size(F.get(edges, F.lit(0))) <= FEW), F.get(edges, F.lit(0)))
    return b.withColumns({"__attempts": att, "__edges": edges, "__few": few})


def points_in_bounds(rows: DataFrame, key: str = "ID20", k: str = "k", seed: int = 0) -> DataFrame:
    """G1: uniform point in the bounding box, from md5(key, k, axis, seed)."""
    ux = uniform(F.col(key), F.col(k), F.lit("x"), F.lit(seed))
    uy = uniform(F.col(key), F.col(k), F.lit("y"), F.lit(seed))
    return rows.withColumns({
        "x": F.col("__minx") + ux * (F.col("__maxx") - F.col("__minx")),
        "y": F.col("__miny") + uy * (F.col("__maxy") - F.col("__miny"))})


# The expressions below are SQL text: they nest folds in folds, and as Column
# objects each of their nodes would be a call from Python to the JVM.

def _candidate(h: str, a: str) -> str:
    """Box point of attempt ``a`` from its md5 hex digest: x from hex digits
    1-8, y from 9-16 (each / 2^32)."""
    ux, uy = (f"(cast(conv(substring({h}, {i}, 8), 16, 10) as double) / {TWO_32!r}D)" for i in (1, 9))
    return (f"named_struct('a', cast({a} as bigint), 'x', __minx + {ux} * (__maxx - __minx), "
            f"'y', __miny + {uy} * (__maxy - __miny))")


def _digest(prefix: str, a: str, seed: int) -> str:
    return f"md5(concat({prefix}, cast({a} as string), ':{seed}'))"


def _crossed(e: str, x: str, y: str) -> str:
    return f"((({e}.y1 > {y}) != ({e}.y2 > {y})) and ({x} < ({e}.dx * ({y} - {e}.y1)) / {e}.dy + {e}.x1))"


def _try(prefix: str, a: str, seed: int, edges: str) -> str:
    """The candidate of attempt ``a`` if it lies inside (the test of ``geo.parts_contain``), else null."""
    inside = f"exists({edges}, part -> aggregate(part, false, (odd, e) -> odd != {_crossed('e', 'c.x', 'c.y')}))"
    # digest and candidate are bound once each (one-element arrays)
    return (f"aggregate(array({_digest(prefix, a, seed)}), cast(null as {CAND}), (n1, h) -> "
            f"aggregate(array({_candidate('h', a)}), cast(null as {CAND}), (n2, c) -> if({inside}, c, null)))")


def _first_inside(attempts: str, prefix: str, seed: int, edges: str) -> str:
    """First attempt whose point lies inside; md5 key text ``key:k:a:seed``
    (``prefix`` is ``key:k:``)."""
    return f"aggregate({attempts}, cast(null as {CAND}), (hit, a) -> if(hit is null, {_try(prefix, 'a', seed, edges)}, hit))"


def _located(prefix: str, seed: int, first: int, edges: str, done: int = 0) -> str:
    """struct(a, x, y) of the first attempt inside, up to the polygon's budget;
    attempts up to ``done`` are known to miss."""
    s1 = _first_inside(f"sequence({done + 1}L, {first}L)", prefix, seed, edges)
    # attempts first+1 .. budget in chunks of about sqrt(remaining): a chunk's
    # attempt list is only built while no attempt has hit, so per-row memory
    # stays O(sqrt(budget)) even for very thin polygons
    rest = f"(__attempts - {first}L)"
    size = f"greatest(1024L, cast(ceil(sqrt(cast({rest} as double))) as bigint))"
    chunk = f"sequence({first + 1}L + chunk * {size}, least(__attempts, {first}L + (chunk + 1L) * {size}))"
    s2 = (f"case when __attempts > {first} then aggregate(sequence(0L, cast(ceil({rest} / {size}) as bigint) - 1L), cast(null as {CAND}), "
          f"(found, chunk) -> if(found is null, {_first_inside(chunk, prefix, seed, edges)}, found)) end")
    failed = f"cast(raise_error('points_in_polygon: attempt budget exhausted or polygon without area') as {CAND})"
    # each stage is looked at only where the one before missed
    return f"coalesce({s1}, {s2}, {failed})"


def _prefix(key: str, k: str) -> str:
    return f"concat(cast(`{key}` as string), ':', cast({k} as string), ':')"


def points_in_polygon(rows: DataFrame, key: str = "ID20", k: str = "k", depth: int = 2, seed: int = 0,
                      first: int = 16) -> DataFrame:
    """Exact rejection sampling, one point per row, no shuffle.

    Attempt ``a`` of individual ``(key, k)`` is the box point from
    md5("key:k:a:seed"); the result is the first attempt inside the
    polygon - the same as a rejection loop, reproducible on any cluster.
    Attempts 1..``first`` are tried for every row; rows that miss all of them
    continue with attempts up to the polygon's budget (``sampling_params``).
    Exhausting the budget (probability <= fail_prob) raises instead of
    returning a wrong point.  Adds ``x``, ``y`` and ``attempt``.
    """
    d = rows.withColumn("__p", F.expr(_located(_prefix(key, f"`{k}`"), seed, first, "__edges")))
    return d.withColumns({"x": F.col("__p.x"), "y": F.col("__p.y"), "attempt": F.col("__p.a")}).drop("__p", "__edges", "__few")


def _inside_few(x: str, y: str) -> str:
    """``geo.edges_contain`` for a list of at most ``FEW`` edges, written out
    edge by edge: no fold, so it is part of the generated code."""
    odd = "false"
    for i in range(FEW):
        odd = f"({odd} != coalesce({_crossed(f'get(__few, {i})', x, y)}, false))"
    return odd


def individuals_in_polygon(blocks: DataFrame, n, key: str = "ID20", k: str = "k", seed: int = 0, first: int = 16,
                           chunk_rows: int = 1 << 12, spread: bool = True, partitions: int | None = None) -> DataFrame:
    """E5 + G2 in one step: :func:`points_in_polygon` for k = 1..n of every
    block (a row of :func:`sampling_params`), with the polygon's edges once
    per chunk of ``chunk_rows`` individuals and never in an individual's row.

    Polygons of few edges are sampled by plain columns: the first attempt is
    generated code over the individual's row, and the fold over further
    attempts runs only for those that missed it.
    """
    d = expand.chunks(blocks, n, key, chunk_rows, partitions, spread)
    many = f"transform(sequence(__lo, __hi), i -> named_struct('k', i, 'p', {_located(_prefix(key, 'i'), seed, first, '__edges')}))"
    few = f"transform(sequence(__lo, __hi), i -> named_struct('k', i, 'p', cast(null as {CAND})))"
    box = ["__few", "__attempts", "__minx", "__miny", "__maxx", "__maxy"]
    keep = [c for c in d.columns if c not in ("__lo", "__hi", "__edges", *box, "geometry")]
    names, boxed = [f"`{c}`" for c in keep], ", ".join(box).split(", ")
    d = d.selectExpr(*names, *boxed, f"explode(if(__few is null, {many}, {few})) as __i")
    d = d.selectExpr(*names, *boxed, f"__i.k as `{k}`", "__i.p as __p", f"if(__few is null, null, {_prefix(key, '__i.k')}) as __pre")
    # attempt 1 of polygons with few edges, each value a column of its own
    d = d.selectExpr("*", f"{_digest('__pre', '1', seed)} as __h").selectExpr("*", f"{_candidate('__h', '1')} as __c")
    d = d.selectExpr("*", "__c.x as __x", "__c.y as __y").drop("__h", "__c")
    d = d.selectExpr("*", f"__x is not null and {_inside_few('__x', '__y')} as __in")
    plain = "if(__in, named_struct('a', 1L, 'x', __x, 'y', __y), null)"
    d = d.selectExpr(*names, f"`{k}`", f"coalesce(__p, {plain}, {_located('__pre', seed, first, 'array(__few)', done=1)}) as __p")
    return d.selectExpr(*names, f"`{k}`", "__p.x as x", "__p.y as y", "__p.a as attempt")

"""Data-preparation queries: apportionment, migration tables, row expansion,
joins, and the point datasets (C1, C2, C5, C6, C8, E*, J1-J7, A8-A10, A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .functions import numeric
from .functions.rand import uniform_sql
from .operators import aggregates as A, expand, filters, windows
from .plans import apportion as AP, datasets as DS, fixtures as fx, migration as MG
from .plans import fixtures_sql as S
from .plans.crossfilter import race_names_col
from .plans.fixtures_sql import d
from .schemas import RACE_NAMES
from .sources import dims

MEASURES = ["P10"] + [f"R10{k}" for k in range(1, 8)]
RK = range(1, 8)


# --- Spark side building blocks ---------------------------------------------

def _mapped(spark, sf):
    ap = AP.apportion(fx.crosswalk(spark, sf), fx.block10(spark, sf), MEASURES)
    return AP.mapped_blocks(fx.block20(spark, sf), ap)


def _mig(spark, sf):
    return MG.migration_table(_mapped(spark, sf))


def _rmig(spark, sf):
    return MG.race_migration_table(_mapped(spark, sf))


# --- SQL side building blocks -------------------------------------------------

def _clean(c: str) -> str:
    return (f"regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F]+', '', 'g'), "
            f"'([A-Z][a-z]+)([A-Z]+)', '\\1', 'g')")


def _rhe(x: str) -> str:
    return f"cast(round_even(round(cast({x} as double), 6), 0) as integer)"


_EQ = ", ".join(f"sum(coalesce(w.{m}, 0)) as eq_{m}" for m in MEASURES)
_W = ", ".join(f"cast(b.{m} as double) / f.freq as {m}" for m in MEASURES)
_RD = [f"R{k}_diff" for k in RK]

PREP = f"""with cw as ({S.CROSSWALK}), b10 as ({S.BLOCK10}), b20 as ({S.BLOCK20}),
freq as (select ID10, count(*) as freq from cw group by ID10),
w as (select b.ID10, {_W} from b10 b join freq f on b.ID10 = f.ID10),
ap as (select c.ID20, {_EQ} from cw c left join w on c.ID10 = w.ID10 group by c.ID20),
mapped as (select b.*, {', '.join(f'coalesce(ap.eq_{m}, 0) as eq_{m}' for m in MEASURES)}
           from b20 b left join ap on b.ID20 = ap.ID20),
mig0 as (select ID20, STATE, {_clean('COUNTY')} as COUNTY, cast(P20 as integer) as P20,
         {_rhe('P20 - eq_P10')} as block_diff from mapped),
mig as (select ID20, STATE, COUNTY, P20, cast(P20 - block_diff as integer) as eq_P10, block_diff,
        cast(sign(block_diff) as integer) as block_net,
        cast(case when block_diff < 0 then P20 + (P20 - block_diff) else P20 end as integer) as points from mig0),
rm0 as (select ID20, STATE, {_clean('COUNTY')} as COUNTY, {_rhe('P20 - eq_P10')} as P_delta,
        {', '.join(f"{_rhe(f'R20{k} - eq_R10{k}')} as R{k}_diff" for k in RK)} from mapped),
rmig as (select ID20, STATE, COUNTY, P_delta, {', '.join(_RD[:6])},
         cast(R7_diff + (P_delta - ({' + '.join(_RD)})) as integer) as R7_diff from rm0),
rmig2 as (select *, cast(abs(P_delta) as integer) as number,
          cast({' + '.join(f'abs({c})' for c in _RD[:6])} + abs(R7_diff) as integer) as points from rmig)
"""


@query("apportion_population", PREP + "select ID20, round(eq_P10, 6) as eq_P10 from ap")
def apportion_population(spark, sf):
    """2010 population on 2020 blocks through the many-to-many crosswalk."""
    ap = AP.apportion(fx.crosswalk(spark, sf), fx.block10(spark, sf), ["P10"])
    return ap.select("ID20", F.round("eq_P10", 6).alias("eq_P10"))


@query("apportion_races", PREP + "select ID20, " + ", ".join(f"round(eq_{m}, 6) as eq_{m}" for m in MEASURES) + " from ap")
def apportion_races(spark, sf):
    """Population and the seven race counts apportioned together."""
    ap = AP.apportion(fx.crosswalk(spark, sf), fx.block10(spark, sf), MEASURES)
    return ap.select("ID20", *[F.round(f"eq_{m}", 6).alias(f"eq_{m}") for m in MEASURES])


@query("apportion_null_ids", f"""with cw as (select case when l_partkey % 11 <> 0 then l_partkey end as ID10,
    case when l_suppkey % 7 <> 0 then l_suppkey end as ID20 from lineitem),
  b10 as (select * from ({S.BLOCK10}) b where ID10 % 5 <> 0),
  w as (select c.ID10, max(cast(b.P10 as double)) / count(*) as weight from cw c join b10 b on b.ID10 = c.ID10 group by c.ID10)
select c.ID20, round(sum(coalesce(w.weight, 0)), 6) as eq_P10 from cw c left join w on w.ID10 = c.ID10
where c.ID20 is not null group by c.ID20""")
def apportion_null_ids(spark, sf):
    """Null ids on both sides, repeated pairs and 2010 ids missing on either
    side; the frequency counts every row of a 2010 id."""
    b10 = fx.block10(spark, sf).where(F.col("ID10") % 5 != 0)
    ap = AP.apportion(fx.crosswalk_with_nulls(spark, sf), b10, ["P10"])
    return ap.select("ID20", F.round("eq_P10", 6).alias("eq_P10"))


@query("migration_table", PREP + "select * from mig")
def migration_table(spark, sf):
    """block_diff (half-even), block_net, reconciled eq_P10 and points."""
    return _mig(spark, sf)


@query("race_migration_table", PREP + "select * from rmig2")
def race_migration_table(spark, sf):
    """Race differences reconciled into race 7, number and points."""
    return _rmig(spark, sf)


@query("hsum_reconcile", PREP + f"select ID20, P_delta, cast({' + '.join(_RD)} as integer) as race_sum from rmig2")
def hsum_reconcile(spark, sf):
    """Row-wise sum of the race differences (equals P_delta)."""
    r = _rmig(spark, sf)
    return r.select("ID20", "P_delta", numeric.hsum(MG.RACE_DIFFS).cast("int").alias("race_sum"))


@query("check_reconciled", PREP + f"""select count(*) as violations from (
  select *, case when ID20 % 4 = 0 then R3_diff + 1 else R3_diff end as bad3 from rmig2) r
  where P_delta <> {' + '.join('bad3' if c == 'R3_diff' else c for c in _RD)}""")
def check_reconciled(spark, sf):
    """Rows breaking Sum(Rk_diff) = P_delta, with one injected in every fourth block."""
    r = _rmig(spark, sf).withColumn("R3_diff", F.col("R3_diff") + F.when(F.col("ID20") % 4 == 0, 1).otherwise(0))
    return A.row_count(MG.reconcile_violations(r)).withColumnRenamed("n_rows", "violations")


@query("hsum_abs_points", PREP + "select ID20, points from rmig2")
def hsum_abs_points(spark, sf):
    """points = Sum |Rk_diff| per block."""
    return _rmig(spark, sf).select("ID20", "points")


@query("frame_abs_total", PREP + "select cast(sum(points) as bigint) as abs_total, cast(sum(number) as bigint) as number_total from rmig2")
def frame_abs_total(spark, sf):
    """A10: whole-frame absolute total beside the sum of |P_delta|."""
    return _rmig(spark, sf).agg(F.sum("points").alias("abs_total"), F.sum("number").alias("number_total"))


@query("calc_points", PREP + "select ID20, block_net, points from mig")
def calc_points(spark, sf):
    """P20, plus P10 for losing blocks."""
    return _mig(spark, sf).select("ID20", "block_net", "points")


_EMPTIED = "case when ID20 % 3 = 0 then 0 else {c} end as {c}"


def _with_empty_blocks(df, *cols):
    """Every third block emptied: rows that the filters must drop."""
    return df.withColumns({c: F.when(F.col("ID20") % 3 == 0, 0).otherwise(F.col(c)) for c in cols})


@query("generation_table", PREP + f"select * from (select ID20, STATE, {_EMPTIED.format(c='points')} from mig) m where points <> 0")
def generation_table(spark, sf):
    """P5: blocks that get points; blocks without any are dropped."""
    return MG.generation_table(_with_empty_blocks(_mig(spark, sf), "points"))


@query("filter_or", PREP + """select * from (select ID20, case when ID20 % 3 = 0 then 0 else P20 end as P20,
  case when ID20 % 2 = 0 then 0 else eq_P10 end as eq_P10 from mig) m where P20 <> 0 or eq_P10 <> 0""")
def filter_or(spark, sf):
    """P20 != 0 or P10 != 0 (zeros on either side, and on both)."""
    m = _mig(spark, sf).select("ID20", F.when(F.col("ID20") % 3 == 0, 0).otherwise(F.col("P20")).alias("P20"),
                               F.when(F.col("ID20") % 2 == 0, 0).otherwise(F.col("eq_P10")).alias("eq_P10"))
    return filters.filter_any_nonzero(m, "P20", "eq_P10")


@query("block_diff_histogram", PREP + f"""select cast(floor((cast(block_diff as double) - {d(0.0)}) / {d(10.0)}) as bigint) as bin,
  count(*) as cnt from mig group by 1""")
def block_diff_histogram(spark, sf):
    """Distribution of block_diff in bins of width 10."""
    return A.fixed_width_histogram(_mig(spark, sf), "block_diff", 0.0, 10.0).select("bin", "cnt")


# --- joins J1-J7 -------------------------------------------------------------

@query("join_inner", PREP + "select r.ID20, r.P_delta, m.P20, m.block_diff from rmig2 r join mig m on r.ID20 = m.ID20")
def join_inner(spark, sf):
    """Inner equi-join on ID20."""
    m = _mig(spark, sf).select("ID20", "P20", "block_diff")
    return _rmig(spark, sf).select("ID20", "P_delta").join(m, "ID20", "inner")


@query("join_inner_named_keys", PREP + f"""select t.GEOID20, m.ID20, m.points from ({S.BLOCK_TRIANGLES}) t
  join mig m on t.GEOID20 = m.ID20 where m.points <> 0 and t.GEOID20 % 4 <> 0""")
def join_inner_named_keys(spark, sf):
    """GEOID20 = ID20 (a quarter of the blocks has no polygon)."""
    p = fx.block_polygon(spark, sf).select("GEOID20").where(F.col("GEOID20") % 4 != 0)
    g = MG.generation_table(_mig(spark, sf))
    return p.join(g, p.GEOID20 == g.ID20).select("GEOID20", "ID20", "points")


@query("join_right", PREP + "select b.ID10, f.freq, b.P10 from (select * from freq where ID10 % 3 <> 0) f "
                           "right join b10 b on f.ID10 = b.ID10")
def join_right(spark, sf):
    """Frequencies right-joined to the 2010 populations (a third has no crosswalk row)."""
    cw = fx.crosswalk(spark, sf).where(F.col("ID10") % 3 != 0)
    f = cw.groupBy("ID10").agg(F.count(F.lit(1)).alias("freq"))
    return f.join(fx.block10(spark, sf).select("ID10", "P10"), "ID10", "right")


@query("join_left", PREP + "select c.ID10, c.ID20, round(w.P10, 6) as weight from cw c left join w on c.ID10 = w.ID10 and w.ID10 % 3 <> 0")
def join_left(spark, sf):
    """Crosswalk left-joined to the per-2010-block weights (a third is missing)."""
    cw = fx.crosswalk(spark, sf)
    f = cw.groupBy("ID10").agg(F.count(F.lit(1)).alias("freq"))
    w = fx.block10(spark, sf).where(F.col("ID10") % 3 != 0).join(f, "ID10").select("ID10", (F.col("P10") / F.col("freq")).alias("weight"))
    return cw.join(w, "ID10", "left").select("ID10", "ID20", F.round("weight", 6).alias("weight"))


@query("join_semi", f"select * from ({S.BLOCK20}) b where ID20 in (select ID20 from ({S.CROSSWALK}) c where ID10 % 97 = 5)")
def join_semi(spark, sf):
    """Key existence (left semi join)."""
    cw = fx.crosswalk(spark, sf).where(F.col("ID10") % 97 == 5)
    return fx.block20(spark, sf).join(cw, "ID20", "left_semi")


_RACE_CASE = "case race " + " ".join(f"when {k} then '{v}'" for k, v in RACE_NAMES.items()) + " end"


@query("join_broadcast_decode", f"with points as ({S.POINTS}) select race, count(net) as cnt, {_RACE_CASE} as name "
                                "from points group by race")
def join_broadcast_decode(spark, sf):
    """Race histogram decoded by a broadcast join with the 8-row race table."""
    h = A.count_by(fx.points(spark, sf), "race")
    rd = dims.race_dim(spark).withColumnRenamed("id", "race")
    return h.join(F.broadcast(rd), "race", "left")


@query("decode_race_map", f"with points as ({S.POINTS}) select race, count(net) as cnt, {_RACE_CASE} as name "
                          "from points group by race")
def decode_race_map(spark, sf):
    """The same decode as an in-plan literal map."""
    h = A.count_by(fx.points(spark, sf), "race")
    return h.withColumn("name", race_names_col("race"))


@query("dim_invert", f"select name, max(id) as id from ({S.DIM_COUNTY}) d group by name")
def dim_invert(spark, sf):
    """Name -> id from id -> name (county dimension)."""
    return dims.invert(fx.dim_county(spark, sf))


# --- expansion E1-E9 ---------------------------------------------------------

_GEN = "(select ID20, STATE, points from mig where points <> 0) g"


@query("explode_individuals", PREP + f"select g.ID20, t.k from {_GEN}, generate_series(1, g.points) t(k)")
def explode_individuals(spark, sf):
    """One row per point to draw, k = 1..points (chunked, spread)."""
    g = MG.generation_table(_mig(spark, sf))
    return expand.explode_individuals(g, "points", chunk_rows=64).select("ID20", "k")


@query("expand_county", PREP + f"""select g.ID20, t.k, d.county from mig g
  left join (select name, max(id) as county from ({S.DIM_STATE}) x group by name) d on d.name = g.COUNTY,
  generate_series(1, g.points) t(k) where g.points <> 0""")
def expand_county(spark, sf):
    """County id (looked up by name) repeated for every point of the block."""
    g = _mig(spark, sf).where(F.col("points") != 0)
    g = DS.with_county_id(g, fx.dim_state(spark, sf))
    return expand.explode_individuals(g, "points").select("ID20", "k", F.col("__cid").alias("county"))


def _net_rows_sql() -> str:
    return ("select m.ID20, t.k, cast(case when m.block_net >= 0 then (case when t.k <= m.P20 - m.eq_P10 then 1 else 0 end) "
            "else (case when t.k <= m.P20 then 0 else -1 end) end as integer) as net from mig m, "
            "generate_series(1, case when m.block_net < 0 then m.eq_P10 else m.P20 end) t(k) "
            "where m.P20 <> 0 or m.eq_P10 <> 0")


@query("expand_net_list", PREP + _net_rows_sql())
def expand_net_list(spark, sf):
    """E3 + P8: the label lists in list form, exploded, -99 filler dropped."""
    m = _mig(spark, sf).where((F.col("P20") != 0) | (F.col("eq_P10") != 0))
    runs = expand.net_runs("P20", "eq_P10", "block_net")
    e = expand.explode_pieces(expand.list_pieces(m, runs, chunk_rows=64), code="net").where(F.col("net") != -99)
    return e.select("ID20", "k", F.col("net").cast("int"))


@query("expand_net_ordinal", PREP + _net_rows_sql())
def expand_net_ordinal(spark, sf):
    """E3 (ordinal form): the same labels from k and the counts, no lists."""
    m = _mig(spark, sf).where((F.col("P20") != 0) | (F.col("eq_P10") != 0))
    m = m.withColumn("__rows", expand.rows_per_block("P20", "eq_P10", "block_net"))
    e = expand.explode_individuals(m, "__rows", chunk_rows=128)
    return e.select("ID20", "k", expand.net_label("k", "P20", "eq_P10", "block_net").alias("net"))


def _race_case(pos: str, cols: list[str], codes: list[str]) -> str:
    parts, run = [], []
    for c, code in zip(cols, codes):
        run.append(f"abs({c})")
        parts.append(f"when {pos} <= {' + '.join(run)} then {code}")
    return "cast(case " + " ".join(parts) + " else 0 end as integer)"


_R20 = [f"R20{k}" for k in RK]


@query("expand_race_ordinal", PREP + f"""select b.ID20, t.k, {_race_case('t.k', _R20, [str(k) for k in RK])} as race
  from b20 b, generate_series(1, b.P20) t(k)""")
def expand_race_ordinal(spark, sf):
    """Race of individual k from the cumulative race counts."""
    b, cum = expand.cumulative_columns(fx.block20(spark, sf), _R20)
    e = expand.explode_individuals(b, "P20")
    return e.select("ID20", "k", expand.label_by_cumulative("k", cum, list(RK), 0).alias("race"))


def _only(code: int):
    return lambda c: F.when(F.abs(c) == code, c).otherwise(F.lit(0))


@query("array_repeat_race", PREP + "select ID20, " + ", ".join(
    f"cast(abs(R{k}_diff) as integer) as n{k}, cast(case when R{k}_diff > 0 then {k} when R{k}_diff < 0 then -{k} end as integer) as c{k}"
    for k in RK) + " from rmig2")
def array_repeat_race(spark, sf):
    """Signed race lists per block, built piece by piece (size and code of each list)."""
    r = _rmig(spark, sf)
    pieces = expand.list_pieces(r.select("ID20", *MG.RACE_DIFFS), expand.signed_runs(MG.RACE_DIFFS), chunk_rows=64)
    cols = []
    for k in RK:
        mine = F.array_remove(F.transform("codes", _only(k)), 0)
        cols += [F.sum(F.size(mine)).cast("int").alias(f"n{k}"), F.max(F.get(mine, 0)).alias(f"c{k}")]
    found = pieces.groupBy("ID20").agg(*cols)
    return r.select("ID20").join(found, "ID20", "left").na.fill(0, [f"n{k}" for k in RK])


@query("array_concat_race", PREP + f"""select r.ID20, t.k, {_race_case('t.k', _RD,
      [f"(case when R{k}_diff < 0 then -{k} else {k} end)" for k in RK])} as race
  from rmig2 r, generate_series(1, r.points) t(k) where r.points <> 0""")
def array_concat_race(spark, sf):
    """The seven signed lists concatenated and exploded (list form)."""
    r = _rmig(spark, sf).where(F.col("points") != 0).select("ID20", *MG.RACE_DIFFS)
    pieces = expand.list_pieces(r, expand.signed_runs(MG.RACE_DIFFS), chunk_rows=64)
    return expand.explode_pieces(pieces, code="race").select("ID20", "k", "race")


@query("shuffle_within_block", PREP + f"""select ID20, k, {_race_case('pos', _RD,
      [f"(case when R{k}_diff < 0 then -{k} else {k} end)" for k in RK])} as race from (
  select r.*, t.k, row_number() over (partition by r.ID20 order by md5(concat_ws(':', cast(r.ID20 as varchar),
    cast(t.k as varchar), cast(7 as varchar)))) as pos
  from rmig2 r, generate_series(1, r.points) t(k) where r.points <> 0) s""")
def shuffle_within_block(spark, sf):
    """Races paired with individuals in md5-random order (hash-uniform shuffle).

    The rank of md5(ID20, k, seed) inside the block picks the list position;
    the numbering is skew-safe (large blocks are numbered by a range sort).
    """
    r = _rmig(spark, sf).where(F.col("points") != 0)
    r, cum = expand.cumulative_columns(r, MG.RACE_DIFFS)
    e = expand.explode_individuals(r, "points")
    e = e.withColumn("__h", F.md5(F.concat_ws(":", F.col("ID20").cast("string"), F.col("k").cast("string"),
                                                F.lit("7"))))
    e = windows.number_within_group(e, "ID20", ["__h"], out="__pos")
    return e.select("ID20", "k", expand.label_by_cumulative("__pos", cum, expand.signed_codes(MG.RACE_DIFFS), 0)
                    .alias("race"))


@query("zip_by_ordinal", PREP + f"""select m.ID20, t.k,
  cast(case when m.block_net >= 0 then (case when t.k <= m.P20 - m.eq_P10 then 1 else 0 end)
       else (case when t.k <= m.P20 then 0 else -1 end) end as integer) as net,
  {_race_case('t.k', _R20, [str(k) for k in RK])} as race
  from mig m join b20 b on m.ID20 = b.ID20, generate_series(1, case when m.block_net < 0 then m.eq_P10 else m.P20 end) t(k)
  where m.P20 <> 0 or m.eq_P10 <> 0""")
def zip_by_ordinal(spark, sf):
    """Two per-block lists (net labels, races) paired by the ordinal k."""
    m = _mig(spark, sf).where((F.col("P20") != 0) | (F.col("eq_P10") != 0))
    m = m.withColumn("__rows", expand.rows_per_block("P20", "eq_P10", "block_net"))
    # the blocks are joined by their key before the expansion; afterwards both
    # labels are functions of the same ordinal, and no individual is shuffled
    b, cum = expand.cumulative_columns(fx.block20(spark, sf).select("ID20", *_R20), _R20)
    e = expand.explode_individuals(m.join(b, "ID20"), "__rows")
    return e.select("ID20", "k", expand.net_label("k", "P20", "eq_P10", "block_net").alias("net"),
                    expand.label_by_cumulative("k", cum, list(RK), 0).alias("race"))


# --- point datasets C5, C6, C8 -------------------------------------------------

def _g2_sql(rows: str, cols: str) -> str:
    """First md5 attempt inside the triangle of each (ID20, k) of ``rows``;
    ``rows`` must carry ID20, k and the columns listed in ``cols``."""
    key = "md5(concat_ws(':', cast(c0.ID20 as varchar), cast(c0.k as varchar), cast(a.a as varchar), '0'))"
    ux = f"(('0x' || substr({key}, 1, 8))::BIGINT / 4294967296.0)"
    uy = f"(('0x' || substr({key}, 9, 8))::BIGINT / 4294967296.0)"
    return f"""
, tri as ({S.BLOCK_TRIANGLES}), edges as ({S.BLOCK_EDGES}),
rws as ({rows}),
cand as (select c0.ID20, c0.k, a.a,
    (t.cx - {d(1)}) + {ux} * ((t.cx + {d(1)}) - (t.cx - {d(1)})) as x,
    (t.cy - {d(0.8)}) + {uy} * ((t.cy + {d(0.8)}) - (t.cy - {d(0.8)})) as y
  from rws c0 join tri t on t.GEOID20 = c0.ID20, range(1, 65) a(a)),
hits as (select c.ID20, c.k, c.a, c.x, c.y from cand c join edges e on e.GEOID20 = c.ID20
  group by c.ID20, c.k, c.a, c.x, c.y having sum({S.crossing('c.x', 'c.y')}) % 2 = 1),
firsts as (select ID20, k, arg_min(x, a) as x, arg_min(y, a) as y from hits group by ID20, k)
select {cols} from rws r join firsts f on f.ID20 = r.ID20 and f.k = r.k"""


_TOT_ROWS = f"""select m.ID20, t.k, m.COUNTY,
  cast(case when m.block_net >= 0 then (case when t.k <= m.P20 - m.eq_P10 then 1 else 0 end)
       else (case when t.k <= m.P20 then 0 else -1 end) end as integer) as net,
  {_race_case('t.k', _R20, [str(k) for k in RK])} as race
  from mig m join b20 b on m.ID20 = b.ID20, generate_series(1, case when m.block_net < 0 then m.eq_P10 else m.P20 end) t(k)
  where m.P20 <> 0 or m.eq_P10 <> 0"""


@query("total_population_dataset", PREP + _g2_sql(
    _TOT_ROWS,
    f"r.ID20, r.k, round({S.mercator_x('f.x')}, 3) as easting, round({S.mercator_y('f.y')}, 3) as northing, "
    f"r.race, r.net, (select max(id) from ({S.DIM_STATE}) x where x.name = r.COUNTY) as county"))
def total_population_dataset(spark, sf):
    """Every individual with Mercator location, race, net label and county id."""
    races = fx.block20(spark, sf).select("ID20", *_R20)
    ds = DS.total_population_dataset(_mig(spark, sf), races, fx.block_polygon(spark, sf), fx.dim_state(spark, sf))
    return ds.withColumns({"easting": F.round("easting", 3), "northing": F.round("northing", 3)})


def _h(*parts: str) -> str:
    key = "concat_ws(':', " + ", ".join(f"cast({p} as varchar)" for p in parts) + ")"
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def _feistel_sql(rows: str, n: str) -> str:
    """``rows`` (with ID20, k and ``n``) and ``pos``, the place of k: the network
    of ``expand.permuted_place`` round by round, walked by recursion."""
    halves, left, right = [], "h0l", "h0r"
    for i, (m, w) in enumerate(expand._MULTIPLIERS):
        half = right if i % 2 == 0 else left
        digest = f"((((({half} % 2147483647) * {m} + pk * {2 * i + 1}) % 2147483647) * {w} + pk) % 2147483629) // 512"
        if i % 2 == 0:
            halves.append(f"({left} + {digest}) % pa as l{i}")
            left = f"l{i}"
        else:
            halves.append(f"({right} + {digest}) % pb as r{i}")
            right = f"r{i}"
    step = "select ID20, k, n, pa, pb, pk, {0} // pb as h0l, {0} % pb as h0r, " + ", ".join(halves) + f", {left} * pb + {right} as p from {{1}}"
    keep = "select ID20, k, n, pa, pb, pk, p from"
    return f""", recursive_rows as ({rows}),
fp as (select ID20, k, cast({n} as bigint) as n, cast(ceil(sqrt(cast({n} as double))) as bigint) as pa, {_h('ID20', '0', "'perm'")} as pk from recursive_rows),
fq as (select *, (n + pa - 1) // pa as pb from fp),
walk as ({keep} ({step.format('(k - 1)', 'fq')}) one union all {keep} ({step.format('p', 'walk where p >= n')}) more),
placed as (select r.*, w.p + 1 as pos from recursive_rows r join walk w on w.ID20 = r.ID20 and w.k = r.k and w.p < w.n)"""


_RACE_AT = _race_case('pos', _RD, [f"(case when R{k}_diff < 0 then -{k} else {k} end)" for k in RK])
_PERMUTED = _feistel_sql("select r.*, t.k from rmig2 r, generate_series(1, r.points) t(k) where r.points <> 0", "points")
_RPREP = PREP.replace("with cw as", "with recursive cw as", 1)
_NET_ROWS = f"select ID20, k, STATE, COUNTY, P_delta, {_RACE_AT} as race from placed"


@query("permute_within_block", _RPREP + _PERMUTED + f" select ID20, k, pos, {_RACE_AT} as race from placed")
def permute_within_block(spark, sf):
    """Races paired with individuals by a keyed bijection of each block's
    1..n (Feistel network, cycle walking); nothing is shuffled after the explode."""
    r = _rmig(spark, sf).where(F.col("points") != 0)
    r, cum = expand.cumulative_columns(expand.with_permutation(r, "points", "ID20"), MG.RACE_DIFFS)
    e = expand.explode_individuals(r, "points").withColumn("pos", expand.permuted_place("k", "points"))
    return e.select("ID20", "k", "pos", expand.label_by_cumulative("pos", cum, expand.signed_codes(MG.RACE_DIFFS), 0).alias("race"))


@query("net_migration_dataset", _RPREP + _PERMUTED + _g2_sql(
    _NET_ROWS, "r.ID20 as blockid, r.k, f.x, f.y, r.race, r.STATE as state, r.COUNTY as county, "
               "r.P_delta as block_diff, cast(sign(r.P_delta) as integer) as block_net"))
def net_migration_dataset(spark, sf):
    """Migrating individuals with signed, permuted race codes and locations."""
    return DS.net_migration_dataset(_rmig(spark, sf), fx.block_polygon(spark, sf))


@query("points_in_polygon", PREP + _g2_sql(
    "select g.ID20, t.k from (select ID20, points from mig where points <> 0) g, generate_series(1, g.points) t(k)",
    "r.ID20, r.k, f.x, f.y"))
def points_in_polygon(spark, sf):
    """Rejection-sampled points inside each block triangle, all blocks in one job."""
    from .operators import spatial
    g = MG.generation_table(_mig(spark, sf))
    p = spatial.sampling_params(fx.block_polygon(spark, sf).withColumnRenamed("GEOID20", "ID20"))
    return spatial.individuals_in_polygon(g.join(p, "ID20"), "points").select("ID20", "k", "x", "y")


@query("boxed_population", PREP + f"""select m.ID20, t.k,
  (tr.cx - {d(1)}) + {uniform_sql('m.ID20', 't.k', "'x'", '0')} * ((tr.cx + {d(1)}) - (tr.cx - {d(1)})) as x,
  (tr.cy - {d(0.8)}) + {uniform_sql('m.ID20', 't.k', "'y'", '0')} * ((tr.cy + {d(0.8)}) - (tr.cy - {d(0.8)})) as y,
  m.COUNTY, round(m.P_delta, 6) as P_delta, m.P_net from (
    select ID20, COUNTY, P20 - eq_P10 as P_delta, case when P20 - eq_P10 > 0 then 1 else 0 end as P_net,
      abs({_rhe('P20 - eq_P10')}) as number from mapped) m
  join ({S.BLOCK_TRIANGLES}) tr on tr.GEOID20 = m.ID20, generate_series(1, m.number) t(k) where m.number <> 0""")
def boxed_population(spark, sf):
    """Uniform points in each block's bounding box with block attributes."""
    ds = DS.boxed_population(_mapped(spark, sf), fx.block_polygon(spark, sf))
    return ds.withColumn("P_delta", F.round("P_delta", 6))


@query("points_in_bounds", PREP + f"""select m.ID20, t.k,
  (tr.cx - {d(1)}) + {uniform_sql('m.ID20', 't.k', "'x'", '0')} * ((tr.cx + {d(1)}) - (tr.cx - {d(1)})) as x,
  (tr.cy - {d(0.8)}) + {uniform_sql('m.ID20', 't.k', "'y'", '0')} * ((tr.cy + {d(0.8)}) - (tr.cy - {d(0.8)})) as y
  from (select ID20, points from mig where points <> 0) m join ({S.BLOCK_TRIANGLES}) tr on tr.GEOID20 = m.ID20,
  generate_series(1, m.points) t(k)""")
def points_in_bounds(spark, sf):
    """G1: uniform points in the bounding box of each block polygon."""
    from .operators import spatial
    g = MG.generation_table(_mig(spark, sf))
    p = spatial.with_bounds(fx.block_polygon(spark, sf).withColumnRenamed("GEOID20", "ID20"))
    e = expand.explode_individuals(g.join(p, "ID20"), "points")
    return spatial.points_in_bounds(e).select("ID20", "k", "x", "y")

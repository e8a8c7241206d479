"""Row expansion: one row per individual.

The reference builds Python lists per block ([1]*n + [0]*m ...), explodes
them and zips the pieces by position.  Here a block becomes ``k = 1..n`` by
``explode(sequence)`` and every label is a function of the ordinal ``k`` and
the block's counts, so nothing is ever paired by position (Q3, Q7).

Skew: a block may hold a large share of all individuals.  The explode is done
in two levels - first chunks of at most ``chunk_rows`` ordinals, spread over
the cluster by a hash of (block, chunk), then the ordinals inside a chunk -
so no task generates more than its share of a hot block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rand import hash_int


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def chunks(df: DataFrame, n, key: str = "ID20", chunk_rows: int = 1 << 16, partitions: int | None = None,
           spread: bool = True) -> DataFrame:
    """The block rows cut into chunks of at most ``chunk_rows`` individuals
    (``__lo`` to ``__hi``, from 1), spread over the cluster.  Blocks with
    ``n < 1`` have no chunk."""
    n = _c(n).cast("long")
    d = df.withColumn("__n", n).where(F.col("__n") >= 1)
    nch = F.ceil(F.col("__n") / F.lit(chunk_rows)).cast("long")
    d = d.withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("long"), nch - 1)))
    if spread:
        # an explicit count: AQE keeps it (the chunk rows are tiny, coalescing
        # them would put the whole explode back into a few tasks).  It is the
        # configured shuffle width, not the cores seen while the plan is built:
        # with dynamic allocation these may still be two
        parts = partitions or int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        d = d.repartition(parts, F.col(key), F.col("__chunk"))
    lo = F.col("__chunk") * F.lit(chunk_rows) + 1
    hi = F.least(F.col("__n"), (F.col("__chunk") + 1) * F.lit(chunk_rows))
    return d.withColumns({"__lo": lo, "__hi": hi}).drop("__chunk", "__n")


def explode_individuals(df: DataFrame, n, key: str = "ID20", k: str = "k",
                        chunk_rows: int = 1 << 16, partitions: int | None = None,
                        spread: bool = True) -> DataFrame:
    """One row per individual ``k = 1..n`` carrying the block columns.

    Blocks with ``n < 1`` produce no rows (``sequence(1, 0)`` would be [1, 0]).
    """
    d = chunks(df, n, key, chunk_rows, partitions, spread)
    return d.withColumn(k, F.explode(F.sequence("__lo", "__hi"))).drop("__lo", "__hi")


def rows_per_block(p20, p10, net) -> Column:
    """Rows a block keeps after the reference's -99 drop: P10 if losing else P20."""
    return F.when(_c(net) < 0, _c(p10)).otherwise(_c(p20))


def net_label(k, p20, p10, net) -> Column:
    """E3, ordinal form: gaining/equal block -> first P20-P10 are "in" (1), rest 0;
    losing block -> first P20 stationary (0), next P10-P20 "out" (-1)."""
    k, p20, p10 = _c(k), _c(p20), _c(p10)
    gain = F.when(k <= p20 - p10, F.lit(1)).otherwise(F.lit(0))
    lose = F.when(k <= p20, F.lit(0)).otherwise(F.lit(-1))
    return F.when(_c(net) >= 0, gain).otherwise(lose)


def cumulative_columns(df: DataFrame, counts: list[str], prefix: str = "__cum") -> tuple[DataFrame, list[str]]:
    """Per-block running totals of ``counts`` (computed once, before the explode)."""
    names, run = [], None
    cols = {}
    for i, c in enumerate(counts):
        run = F.abs(F.col(c)) if run is None else run + F.abs(F.col(c))
        name = f"{prefix}{i}"
        cols[name] = run
        names.append(name)
    return df.withColumns(cols), names


def label_by_cumulative(pos, cum_cols: list[str], codes: list, default=0) -> Column:
    """The code of the run that ordinal ``pos`` falls in.

    ``codes`` are ints or Columns (for signed codes); past the last run
    ``default``.
    """
    pos = _c(pos)
    expr = None
    for cum, code in zip(cum_cols, codes):
        code_c = code if isinstance(code, Column) else F.lit(code)
        expr = F.when(pos <= F.col(cum), code_c) if expr is None else expr.when(pos <= F.col(cum), code_c)
    return expr.otherwise(F.lit(default))


def signed_codes(diff_cols: list[str]) -> list[Column]:
    """Race code k signed like its difference (in +k, out -k)."""
    return [F.when(F.col(c) < 0, F.lit(-(i + 1))).otherwise(F.lit(i + 1)) for i, c in enumerate(diff_cols)]


# --- list forms (E1, E2, E3 as the reference writes them) --------------------

#
# A list is a sequence of runs (code, length); it is built piece by piece, each
# piece at most one chunk of individuals long, so no array grows with a block
# and lengths are long numbers.

def list_pieces(df: DataFrame, runs: list[tuple], key: str = "ID20", out: str = "codes", chunk_rows: int = 1 << 16,
                partitions: int | None = None, spread: bool = True) -> DataFrame:
    """The block rows with the concatenated list ``[code] * n + ...`` of
    ``runs`` ((code, n): ints or Columns, n <= 0 for an empty run) in pieces:
    ``out`` (an array of at most ``chunk_rows`` codes) and ``first``, the place
    of its first code in the whole list (from 1)."""
    ends, total = [], F.lit(0).cast("long")
    for _, n in runs:
        total = total + F.greatest(_c(n).cast("long"), F.lit(0).cast("long"))
        ends.append(total)
    names = [f"__end{i}" for i in range(len(runs))]
    d = chunks(df.withColumns(dict(zip(names, ends))), names[-1], key, chunk_rows, partitions, spread)
    parts, start = [], F.lit(0).cast("long")
    for (code, _), end in zip(runs, names):
        n = F.least(F.col(end), F.col("__hi")) - F.greatest(start, F.col("__lo") - 1)
        parts.append(F.array_repeat(code if isinstance(code, Column) else F.lit(code), F.greatest(n, F.lit(0).cast("long")).cast("int")))
        start = F.col(end)
    return d.withColumns({out: F.concat(*parts), "first": F.col("__lo")}).drop("__lo", "__hi", *names)


def explode_pieces(pieces: DataFrame, codes: str = "codes", k: str = "k", code: str = "code") -> DataFrame:
    """One row per code of the lists of :func:`list_pieces`, with its place ``k`` in the whole list."""
    keep = [c for c in pieces.columns if c not in (codes, "first")]
    d = pieces.select(*keep, "first", F.posexplode(codes).alias("__at", code))
    return d.select(*keep, (F.col("first") + F.col("__at")).alias(k), code)


def signed_runs(diffs: list[str]) -> list[tuple]:
    """The runs ``[k]*d`` (d > 0) or ``[-k]*|d|`` (d < 0) of race differences, in order."""
    return [(F.when(F.col(c) < 0, F.lit(-(i + 1))).otherwise(F.lit(i + 1)), F.abs(F.col(c).cast("long"))) for i, c in enumerate(diffs)]


def net_runs(p20, p10, net) -> list[tuple]:
    """The runs of a block's net labels, the -99 filler of losing blocks included (dropped by P8)."""
    p20, p10, gain = _c(p20), _c(p10), _c(net) >= 0
    none = F.lit(0)
    return [(1, F.when(gain, p20 - p10).otherwise(none)), (0, F.when(gain, p10).otherwise(p20)),
            (-1, F.when(gain, none).otherwise(p10 - p20)), (-99, F.when(gain, none).otherwise(p20))]


# --- permutation within a block (E6) -------------------------------------------
#
# A Feistel network on the pairs (p div b, p mod b) of 0..a*b-1, a = ceil(sqrt n)
# and b = ceil(n / a): each round adds a keyed digest of one half to the other,
# which can be undone, so the network is a bijection.  Fewer than a values are
# n or more; these go through the network again until they fall below n (cycle
# walking).  The digest is integer arithmetic below 2^62, keyed once per block,
# so an individual's place costs no hash, no lookup and no shuffle.

PERMUTE_ROUNDS = 6
#: Moduli (primes below 2^31) and multipliers of the digests, one pair of multipliers per round.
_M1, _M2 = 2147483647, 2147483629
_MULTIPLIERS = [(1664525 + 2 * 912559 * i, 69621 * (2 * i + 3)) for i in range(PERMUTE_ROUNDS)]
_WALK = 64


def _digest(half: str, i: int) -> str:
    m, w = _MULTIPLIERS[i]
    return f"(((({half} % {_M1}L) * {m}L + __pk * {2 * i + 1}L) % {_M1}L * {w}L + __pk) % {_M2}L div 512L)"


def _network(p: str) -> str:
    """One pass of ``p`` (SQL text: as Column objects its hundreds of nodes would each be a call to the JVM)."""
    left, right = f"({p} div __pb)", f"({p} % __pb)"
    for i in range(PERMUTE_ROUNDS):
        if i % 2 == 0:
            left = f"(({left} + {_digest(right, i)}) % __pa)"
        else:
            right = f"(({right} + {_digest(left, i)}) % __pb)"
    return f"({left} * __pb + {right})"


def with_permutation(df: DataFrame, n, key, seed: int = 0) -> DataFrame:
    """Block rows with the parameters of their own permutation of 1..n: the
    sides ``__pa``, ``__pb`` and the key ``__pk`` (32 bits of md5), to be added
    before the explode."""
    n = F.greatest(_c(n).cast("long"), F.lit(1).cast("long"))
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return df.withColumns({"__pa": a, "__pb": F.call_function("div", n + a - 1, a),
                           "__pk": hash_int(_c(key), F.lit(seed), F.lit("perm"))})


def permuted_place(k: str, n: str) -> Column:
    """The place (1..n) of individual ``k`` (1..n) in its block's list, a
    bijection drawn by the block's key; the row carries :func:`with_permutation`."""
    k, n = f"cast(`{k}` as bigint)", f"cast(`{n}` as bigint)"
    once = _network(f"({k} - 1L)")
    steps = f"sequence(1L, least({_WALK}L, greatest(__pa * __pb - {n}, 1L)))"
    walked = f"aggregate(array({once}), 0L, (n1, p0) -> aggregate({steps}, p0, (p, n2) -> if(p < {n}, p, {_network('p')})))"
    ended = f"aggregate(array({walked}), 0L, (n3, q) -> if(q < {n}, q, cast(raise_error('cycle walk not ended') as bigint)))"
    return F.expr(f"if({once} < {n}, {once}, {ended}) + 1L")

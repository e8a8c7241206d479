"""Reproducible shuffle into shards: a Feistel permutation of row numbers.

Rows get global numbers 0..n-1 in the order of (id, checksum, size).  A keyed
Feistel network permutes the numbers: with a = ceil(sqrt(n)) and
b = ceil(n / a) a number is the pair (x div b, x mod b), each round adds a
hash of one half to the other (mod a or mod b), which can be undone, so it is
a bijection of the a * b >= n pairs.  A value of n or more is put through
again until it falls below n (cycle walking); fewer than a values are that
large, so nearly all rows need one pass.  The place p of a row gives
shard = p mod shards and slot = p div shards: row counts differ by one at
most, slots have no gap, and both can be computed from (row number, n, seed)
alone, also backwards (:func:`place`, :func:`row_at`).

Plan, DataFrame functions only: each row becomes a digest of some 30 bytes,
Spark range-sorts the digests (rows sharing an id are spread by checksum), the
range number and the position in it are written with the row, and the ranges'
sizes, one number per range, give the offsets.  Written ranges are fixed, so a
lost executor cannot shift a number.

Defined cases: null ids sort first; a null text has size 1 and checksum 0;
repeated rows get a number each; an empty table has no shards' rows.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

ROUNDS, SEED, SHARDS = 6, 20240601, 8
_WALK = 64


def halves(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n and a * b - n < a."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _network(x: Column, a: int, b: int, seed: int) -> Column:
    def digest(half, i, size):
        return F.pmod(F.xxhash64(half, F.lit(seed + i).cast("long")), size)

    a, b = F.lit(a).cast("long"), F.lit(b).cast("long")
    left, right = F.call_function("div", x, b), F.pmod(x, b)
    for i in range(ROUNDS):
        if i % 2 == 0:
            left = F.pmod(left + digest(right, i, a), a)
        else:
            right = F.pmod(right + digest(left, i, b), b)
    return left * b + right


def permuted(row: Column, n: int, seed: int = SEED) -> Column:
    """The place of row number ``row`` (long, below n) in the shuffle."""
    a, b = halves(n)
    once = _network(row, a, b, seed)
    if a * b == n:
        return once
    end = F.lit(n).cast("long")
    steps = F.sequence(F.lit(1), F.lit(min(_WALK, a * b - n)))
    walked = F.aggregate(steps, once, lambda p, _: F.when(p < end, p).otherwise(_network(p, a, b, seed)))
    walked = F.when(walked < end, walked).otherwise(F.raise_error(F.lit("cycle walk not ended")).cast("long"))
    return F.when(once < end, once).otherwise(walked)


def _hash(value: int, key: int) -> int:
    first = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), first)
    return h - (1 << 64) if h >> 63 else h


def place(row: int, n: int, seed: int = SEED) -> int:
    """:func:`permuted` for one number, without Spark."""
    a, b = halves(n)
    while True:
        left, right = divmod(row, b)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + _hash(right, seed + i)) % a
            else:
                right = (right + _hash(left, seed + i)) % b
        row = left * b + right
        if row < n:
            return row


def row_at(spot: int, n: int, seed: int = SEED) -> int:
    """The row number whose place is ``spot``."""
    a, b = halves(n)
    while True:
        left, right = divmod(spot, b)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - _hash(right, seed + i)) % a
            else:
                right = (right - _hash(left, seed + i)) % b
        spot = left * b + right
        if spot < n:
            return spot


def row_numbers(rows: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """(``rows`` with their global number in ``order``, how many there are)."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "__range", F.spark_partition_id()).withColumn(
        "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = written(placed, "row-numbers")
    sizes = sorted(placed.groupBy("__range").agg(F.count("*").alias("n")).collect())     # one row per range
    first, offsets = 0, []
    for r in sizes:
        offsets.append((r["__range"], first))
        first += r["n"]
    base = rows.sparkSession.createDataFrame(offsets, "__range int, __first long")
    numbered = placed.join(F.broadcast(base), "__range").withColumn(name, F.col("__first") + F.col("__at"))
    return numbered.drop("__range", "__at", "__first"), first


def shuffled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, size, text_crc32, row_number, shard and slot per row, and
    the columns in ``carry`` (the texts themselves, say), which then travel
    along; their names must not be those of the result."""
    rows = docs.select(id_col, (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
                       F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("text_crc32"), *carry)
    rows, n = row_numbers(rows, [id_col, "text_crc32", "size"])
    spot = permuted(F.col("row_number"), n, seed)
    return (rows.withColumn("shard", F.pmod(spot, F.lit(shards).cast("long")).cast("int"))
            .withColumn("slot", F.call_function("div", spot, F.lit(shards).cast("long"))))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under the ``rows`` law."""
    out = shuffled(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))

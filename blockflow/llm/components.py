"""Connected components of a link table, by alternating star contractions.

Each round points every node's larger neighbours at its smallest neighbour
(large star), then its smaller neighbours likewise (small star); rounds are a
few shuffles of links, written to the shared folder, and their number grows
with the logarithm of the longest path.  Minima are combined before the
shuffle, so a node with very many links is no hot group; the join that hands
the minimum back is skew-split by Spark (adaptive execution).  Links never
reach the driver: only a count and a checksum per round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame) -> DataFrame:
    """links (a, b) -> (a, b, m): m the smallest of a and its neighbours b."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    return links.join(low, "a").select("a", "b", F.least("a", "low").alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns a, b; order,
    repeats and self links do not matter; rows with a null are ignored), root
    the smallest node of the component."""
    ab = links.where("a is not null and b is not null and a <> b")
    ab = written(ab.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        state = ab.agg(F.count("*"), F.sum((F.xxhash64("a", "b") % 1000000007).cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = ab.unionByName(ab.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _star(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        ab = written(small.where("a <> b").distinct(), "links")
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = ab.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

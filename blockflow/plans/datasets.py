"""Point datasets built from block tables (C5, C6, C8) and the state split.

Every individual is a row ``(ID20, k)``; its labels derive from ``k`` and its
block's counts, its location from md5-keyed uniforms, so the datasets are
reproducible and independent of partitioning.  Block-level lookups (county
id, polygon, counts) happen before the explode, on one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geo, numeric
from ..operators import expand, spatial
from ..sources import sinks
from .migration import RACE_DIFFS


def _polygon_params(polys: DataFrame, id_col: str = "GEOID20", geom: str = "geometry",
                    depth: int = 2) -> DataFrame:
    p = polys.select(F.col(id_col).alias("ID20"), F.col(geom).alias("geometry")).where(F.col("geometry").isNotNull())
    return spatial.sampling_params(p, "geometry", depth)


def county_ids_by_name(dim: DataFrame, by_state: bool = False) -> DataFrame:
    """Q9: county id looked up by name only (``county2id`` = inverted
    ``id2county``), so same-named counties of different states share one id;
    with ``by_state`` the dimension's ``state`` column is part of the key.

    Columns ``[__cstate,] __cname, __cid`` (Spark names are case-insensitive,
    so the id cannot be called ``county`` next to ``COUNTY``).
    """
    keys = ([F.col("state").alias("__cstate")] if by_state else []) + [F.col("name").alias("__cname")]
    return dim.groupBy(*keys).agg(F.max("id").alias("__cid"))


def with_county_id(blocks: DataFrame, dim: DataFrame, by_state: bool = False) -> DataFrame:
    """Attach ``__cid`` to one row per block (before any explode)."""
    c = county_ids_by_name(dim, by_state)
    cond = blocks["COUNTY"] == c["__cname"]
    if by_state:
        cond = cond & (blocks["STATE"] == c["__cstate"])
    return blocks.join(c, cond, "left").drop("__cname", "__cstate")


def total_population_dataset(mig: DataFrame, races20: DataFrame, polys: DataFrame,
                             county_dim: DataFrame, seed: int = 0, spread: bool = True,
                             shuffle: bool = False, depth: int = 2) -> DataFrame:
    """One row per individual with location, race, migration label and county.

    ``mig``: migration_table output; ``races20``: ID20, R201..R207.  Blocks
    with neither 2020 nor 2010 population are skipped (P6), blocks without
    geometry too (P15).  A block keeps ``max(P20, P10)`` individuals: the
    ordinal form of the reference's race / net lists after its -99 drop (Q7).
    Races follow the list order by default (the first P20-P10 individuals of
    a gaining block are "in", Q8); ``shuffle=True`` pairs races with
    individuals through the keyed permutation of ``1..rows`` instead.
    ``polys`` holds polygons (``depth=2``) or multipolygons (``depth=3``).
    Columns: ID20, k, easting, northing, race, net, county.
    """
    b = mig.where((F.col("P20") != 0) | (F.col("eq_P10") != 0)).join(races20, "ID20")
    b = with_county_id(b, county_dim)
    b = b.withColumn("__rows", expand.rows_per_block("P20", "eq_P10", "block_net"))
    b, cum = expand.cumulative_columns(b, [f"R20{k}" for k in range(1, 8)])
    b = b.join(_polygon_params(polys, depth=depth), "ID20")
    b = expand.with_permutation(b, "__rows", "ID20", seed) if shuffle else b
    e = spatial.individuals_in_polygon(b, "__rows", seed=seed, spread=spread)
    e = e.withColumn("__pos", expand.permuted_place("k", "__rows") if shuffle else F.col("k"))
    e = e.withColumns({
        "net": expand.net_label("k", "P20", "eq_P10", "block_net"),
        "race": expand.label_by_cumulative("__pos", cum, list(range(1, 8)), 0)})
    x, y = geo.to_mercator("x", "y")
    return e.select("ID20", "k", x.alias("easting"), y.alias("northing"), "race", "net",
                    F.col("__cid").alias("county"))


def net_migration_dataset(race_mig: DataFrame, polys: DataFrame, seed: int = 0,
                          permute: bool = True, spread: bool = True, depth: int = 2) -> DataFrame:
    """One row per migrating individual with a signed race (+k in, -k out).

    The race list of a block is |R1_diff| codes of race 1, then race 2, ...;
    with ``permute`` the list is reordered by the block's keyed permutation
    (E6) before being paired with the individuals.
    Columns: blockid, k, x, y, race, state, county, block_diff, block_net.
    """
    b = race_mig.where(F.col("points") != 0)
    b, cum = expand.cumulative_columns(b, RACE_DIFFS)
    codes = expand.signed_codes(RACE_DIFFS)
    b = b.join(_polygon_params(polys, depth=depth), "ID20")
    b = expand.with_permutation(b, "points", "ID20", seed) if permute else b
    e = spatial.individuals_in_polygon(b, "points", seed=seed, spread=spread)
    e = e.withColumn("__pos", expand.permuted_place("k", "points") if permute else F.col("k"))
    e = e.withColumn("race", expand.label_by_cumulative("__pos", cum, codes, 0))
    return e.select(F.col("ID20").alias("blockid"), "k", "x", "y", "race", F.col("STATE").alias("state"),
                    F.col("COUNTY").alias("county"), F.col("P_delta").alias("block_diff"),
                    numeric.sign_net("P_delta").alias("block_net"))


def boxed_population(mapped: DataFrame, polys: DataFrame, seed: int = 0, spread: bool = True) -> DataFrame:
    """Check dataset - ``|round(P20 - eq_P10)|`` uniform points in each
    block's bounding box, with the block's COUNTY, P_delta and 2-valued net.
    Columns: ID20, k, x, y, COUNTY, P_delta, P_net.
    """
    m = mapped.select("ID20", "COUNTY", (F.col("P20") - F.col("eq_P10")).alias("P_delta"))
    m = m.withColumns({"P_net": numeric.sign_net2("P_delta"),
                       "number": F.abs(numeric.round_half_even("P_delta"))})
    p = spatial.with_bounds(polys.select(F.col("GEOID20"), F.col("geometry")))
    j = p.join(m, p.GEOID20 == m.ID20).drop("GEOID20", "geometry")
    j = j.where(F.col("number") != 0)
    e = expand.explode_individuals(j, "number", spread=spread)
    e = spatial.points_in_bounds(e, seed=seed)
    return e.select("ID20", "k", "x", "y", "COUNTY", "P_delta", "P_net")


def split_new_states(points: DataFrame, states: DataFrame, path: str, x: str = "lon", y: str = "lat",
                     code: str = "State_Code", depth: int = 2) -> str:
    """C7 + K3: points written one directory per state, for the states not yet
    at ``path`` only: written ones leave the polygons before the spatial join."""
    s = states.select(F.col(code).alias("state"), F.col("geometry"))
    s = sinks.without_written(s, path)
    return sinks.write_new_states(spatial.spatial_join(points, s, "state", x, y, "geometry", depth), path)


def split_by_state(points: DataFrame, states: DataFrame, x: str = "lon", y: str = "lat",
                   code: str = "State_Code", depth: int = 2) -> DataFrame:
    """Points tagged with every state polygon containing them."""
    s = states.select(F.col(code).alias("state"), F.col("geometry"))
    return spatial.spatial_join(points, s, "state", x, y, "geometry", depth)

"""Stage tables: materialise intermediate results in the shared checkpoint
folder so a lost executor re-runs one stage, not the whole lineage.

``build_datasets`` is the batch order of the data preparation: crosswalk
apportionment -> migration tables (written) -> point datasets (written,
clustered by a coarse grid so box filters prune Parquet row groups).
Everything is deterministic (md5-keyed randomness, hash partitioning), so a
recomputed partition is bit-identical to the lost one.
"""

from __future__ import annotations

import os
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from ..sources import files, sinks
from . import apportion as AP, datasets as DS, migration as MG

RACE_MEASURES = ["P10"] + [f"R10{k}" for k in range(1, 8)]


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet (default: a fresh folder under the cluster's
    ``spark.checkpoint.dir``) and return the re-read table."""
    spark = df.sparkSession
    p = path or scratch_path(spark, name)
    sinks.write_parquet(df, p)
    return spark.read.parquet(p)


def interleaved_cell(x: str, y: str, cell: float, bits: int = 16):
    """One number for the grid cell of (x, y) in which near cells are near:
    the bits of the two cell numbers in turn."""
    half = 1 << (bits - 1)
    gx, gy = [F.least(F.greatest(F.floor(F.col(c) / F.lit(cell)) + half, F.lit(0)), F.lit((1 << bits) - 1)) for c in (x, y)]
    key = F.lit(0).cast("long")
    for b in range(bits):
        bit = F.lit(1 << b)
        key = key.bitwiseOR(F.shiftleft(gx.bitwiseAND(bit), b)).bitwiseOR(F.shiftleft(gy.bitwiseAND(bit), b + 1))
    return key


def grid_cluster(df: DataFrame, x: str, y: str, cell: float) -> DataFrame:
    """Rows range-partitioned and sorted by interleaved grid cell, so a file
    covers a compact area and a box filter skips whole files by their min/max
    statistics; a crowded cell is cut by the coordinates."""
    key = interleaved_cell(x, y, cell)
    return df.repartitionByRange(key, F.col(x), F.col(y)).sortWithinPartitions(key)


def write_clustered(df: DataFrame, x: str, y: str, cell: float, path: str) -> str:
    """:func:`grid_cluster` written to ``path``.  The range bounds take a pass
    of their own over the rows; these are kept on the executors' disks for the
    write, so that every row is made once (a lost block is made anew)."""
    rows = df.persist(StorageLevel.DISK_ONLY)
    try:
        return sinks.write_parquet(grid_cluster(rows, x, y, cell), path)
    finally:
        rows.unpersist()


def _tag(out_dir: str) -> str:
    return f"blockflow_{uuid.uuid5(uuid.NAMESPACE_URL, out_dir).hex}"


def block_tables(spark, out_dir: str, paths: dict[str, str], buckets: int | None = None) -> dict[str, DataFrame]:
    """The bucketed block tables of a :func:`build_datasets` run (``buckets`` as given there)."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {n: sinks.bucketed_table(spark, f"{_tag(out_dir)}_{n}", "ID20", buckets, paths[n]) for n in STAGES[:3]}


#: The written tables in order; the first three are block tables, bucketed by ID20.
STAGES = ("mapped_blocks", "total_attr", "race_migration", "total_population", "net_migration", "by_state")


def build_datasets(block10: DataFrame, block20: DataFrame, crosswalk: DataFrame, polys: DataFrame,
                   county_dim: DataFrame, out_dir: str, seed: int = 0,
                   grid_cell_m: float = 100_000.0, states: DataFrame | None = None,
                   resume: bool = False, stop_after: str | None = None, buckets: int | None = None) -> dict[str, str]:
    """Run the whole batch preparation; returns the written table paths.

    ``block10``: ID10, P10, R101..R107; ``block20``: ID20, STATE, COUNTY,
    P20, R201..R207; ``crosswalk``: ID10, ID20; ``polys``: GEOID20,
    geometry; ``county_dim``: id, name.  With ``states`` (State_Code,
    geometry, lon/lat) the net-migration points are also split one directory
    per state (``by_state``), for a reader that opens one state only.

    K4: a stage counts as done when its folder holds the commit mark of the
    write.  With ``resume`` stages already done are read, not run again (a
    half-written one is run anew); ``stop_after`` names the last stage to run.
    The block tables are bucketed and sorted by ID20 (``buckets``, by default
    the shuffle width), so their joins by block move no row.
    """
    spark = block20.sparkSession
    paths = {k: os.path.join(out_dir, k) for k in STAGES[:5]}
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = _tag(out_dir)

    def ended(name: str) -> bool:
        return name == stop_after

    def done(name: str) -> bool:
        return resume and files.path_exists(spark, os.path.join(paths[name], "_SUCCESS"))

    def block_table(name: str, make) -> DataFrame:
        if done(name):
            return sinks.bucketed_table(spark, f"{tag}_{name}", "ID20", buckets, paths[name])
        return sinks.write_bucketed(make(), f"{tag}_{name}", "ID20", buckets, paths[name])

    mapped = block_table("mapped_blocks", lambda: AP.mapped_blocks(block20, AP.apportion(crosswalk, block10, RACE_MEASURES)))
    if ended("mapped_blocks"):
        return paths
    mig = block_table("total_attr", lambda: MG.migration_table(mapped))
    if ended("total_attr"):
        return paths
    rmig = block_table("race_migration", lambda: MG.race_migration_table(mapped))
    if ended("race_migration"):
        return paths
    if not done("total_population"):
        races = mapped.select("ID20", *[f"R20{k}" for k in range(1, 8)])
        total = DS.total_population_dataset(mig, races, polys, county_dim, seed=seed)
        write_clustered(total, "easting", "northing", grid_cell_m, paths["total_population"])
    if ended("total_population"):
        return paths
    if not done("net_migration"):
        net = DS.net_migration_dataset(rmig, polys, seed=seed)
        write_clustered(net, "x", "y", 1.0, paths["net_migration"])
    if states is not None and not ended("net_migration"):
        paths["by_state"] = os.path.join(out_dir, "by_state")
        # states already written are left out there
        DS.split_new_states(spark.read.parquet(paths["net_migration"]).drop("state"), states, paths["by_state"], "x", "y")
    return paths

"""Per-block migration tables (C2) with exact reconciliation (Q4-Q6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import ids, numeric

RACE_DIFFS = [f"R{k}_diff" for k in range(1, 8)]


def migration_table(mapped: DataFrame, clean_names: bool = True) -> DataFrame:
    """Total-population migration per 2020 block.

    ``block_diff = round_half_even(P20 - eq_P10)``; ``block_net`` its sign;
    ``eq_P10`` is then reconciled to ``P20 - block_diff`` (the closed form of
    round-then-correct, Q6); ``points`` = P20, plus P10 for a losing block.
    Columns: ID20, STATE, COUNTY, P20, eq_P10, block_diff, block_net, points.
    """
    diff = numeric.round_half_even(F.col("P20") - F.col("eq_P10"))
    county = ids.clean_county("COUNTY") if clean_names else F.col("COUNTY")
    out = mapped.select("ID20", "STATE", county.alias("COUNTY"), F.col("P20").cast("int").alias("P20"),
                        diff.alias("block_diff"))
    out = out.withColumns({"block_net": numeric.sign_net("block_diff"),
                           "eq_P10": (F.col("P20") - F.col("block_diff")).cast("int")})
    out = out.withColumn("points", numeric.calc_points("P20", "eq_P10", "block_net").cast("int"))
    return out.select("ID20", "STATE", "COUNTY", "P20", "eq_P10", "block_diff", "block_net", "points")


def generation_table(mig: DataFrame) -> DataFrame:
    """Blocks that get points: ID20, STATE, points (P5: points != 0)."""
    return mig.where(F.col("points") != 0).select("ID20", "STATE", "points")


def race_migration_table(mapped: DataFrame, clean_names: bool = True) -> DataFrame:
    """Race migration per 2020 block with Sum(Rk_diff) = P_delta exactly (Q5).

    Input: ID20, STATE, COUNTY, P20, eq_P10, R201..R207, eq_R101..eq_R107.
    Each difference is rounded half-to-even; the rounding error is pushed
    into race 7.  ``number = |P_delta|``, ``points = Sum |Rk_diff|``.
    """
    p_delta = numeric.round_half_even(F.col("P20") - F.col("eq_P10"))
    diffs = [numeric.round_half_even(F.col(f"R20{k}") - F.col(f"eq_R10{k}")).alias(f"R{k}_diff")
             for k in range(1, 8)]
    county = ids.clean_county("COUNTY") if clean_names else F.col("COUNTY")
    d = mapped.select("ID20", "STATE", county.alias("COUNTY"), p_delta.alias("P_delta"), *diffs)
    err = F.col("P_delta") - numeric.hsum(RACE_DIFFS)
    d = d.withColumn("R7_diff", (F.col("R7_diff") + err).cast("int"))
    d = d.withColumns({"number": F.abs(F.col("P_delta")).cast("int"),
                       "points": numeric.hsum_abs(RACE_DIFFS).cast("int")})
    return d.select("ID20", "STATE", "COUNTY", "P_delta", *RACE_DIFFS, "number", "points")


def reconcile_violations(race_mig: DataFrame) -> DataFrame:
    """Rows where the race differences do not add up to P_delta (expect 0)."""
    return race_mig.where(F.col("P_delta") != numeric.hsum(RACE_DIFFS))

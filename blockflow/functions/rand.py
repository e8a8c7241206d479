"""Reproducible uniforms from a hash of row keys.

``rand()`` depends on partitioning and task attempts, so a re-run after an
executor loss could place a point elsewhere.  A uniform computed from the
md5 of the row's own key is the same on every run, on every cluster, and in
DuckDB (``('0x'||substr(md5(t),1,8))::BIGINT / 4294967296.0``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296.0


def hash_key(*parts) -> Column:
    """``p1:p2:...`` text of integer / string key parts."""
    cols = [F.lit(p) if not isinstance(p, Column) else p for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of md5(key)."""
    h = F.substring(F.md5(hash_key(*parts)), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO_32)


def uniform_sql(*parts: str) -> str:
    """The same uniform as DuckDB SQL text (parts are SQL expressions)."""
    key = "concat_ws(':', " + ", ".join(f"cast({p} as varchar)" for p in parts) + ")"
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def hash_int(*parts) -> Column:
    """Non-negative 32-bit integer from md5(key)."""
    return F.conv(F.substring(F.md5(hash_key(*parts)), 1, 8), 16, 10).cast("long")

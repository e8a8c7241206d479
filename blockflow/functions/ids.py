"""Identifier and text functions (F1-F4, F8, F9) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: county clean-up patterns of the reference ----------------
NON_ASCII = r"[^\x00-\x7F]+"
CAMEL_TAIL = r"([A-Z][a-z]+)([A-Z]+)"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_letter(c, letter: str = "G") -> Column:
    """remove every occurrence of ``letter`` (``str.replace('G','')``)."""
    return F.replace(_c(c), F.lit(letter), F.lit(""))


def parse_gisjoin(c) -> Column:
    """GISJOIN text -> 15-digit block id.

    ``G SS 0 CCC 0 TTTTTTBBBB``: after dropping the letter, keep characters
    [0:2] + [3:6] + [7:] and read them as a long.
    """
    s = strip_letter(c)
    return F.concat(F.substring(s, 1, 2), F.substring(s, 4, 3), F.substr(s, F.lit(8))).cast("long")


def rjust(c, width: int, fill: str = "0") -> Column:
    """Left-pad to ``width`` like Python ``str.rjust``: longer input is kept whole
    (Spark ``lpad`` alone would cut it)."""
    s = _c(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, fill))


def compose_block_id(state, county, tract, block) -> Column:
    """state(2) + county(3) + tract(6) + block(4) -> long."""
    return F.concat(rjust(state, 2), rjust(county, 3), rjust(tract, 6), rjust(block, 4)).cast("long")


def clean_county(c, anchored: bool = False) -> Column:
    """F8: drop non-ASCII characters, then cut a trailing run of capitals after a
    capitalised word (``([A-Z][a-z]+)([A-Z]+)`` -> ``$1``).

    Parity mode applies the second pattern anywhere, which also damages
    CamelCase names ("LaSalle" -> "Laalle") exactly as the reference does;
    ``anchored=True`` only applies it at the end of the text.
    """
    s = F.regexp_replace(_c(c), NON_ASCII, "")
    pat = CAMEL_TAIL + "$" if anchored else CAMEL_TAIL
    return F.regexp_replace(s, pat, "$1")


def state_code(c) -> Column:
    """numeric state FIPS -> two-digit text."""
    return rjust(c, 2)

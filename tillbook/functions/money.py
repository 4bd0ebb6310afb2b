"""B1 parse_money, B10 round_cents: money text and rounding, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.sources.schemas import MONEY_SQL

# Leading signed decimal number with an optional exponent, as a JS prefix
# parse reads it ("12abc" -> 12, "1.5e2x" -> 150).
_LEADING_NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def _prefix_number(text: Column) -> Column:
    return F.regexp_extract(F.ltrim(text), _LEADING_NUMBER, 0)


def parse_money(col: Column | str, mode: str = "commas") -> Column:
    """Money text -> decimal(18,2); NULL when nothing parses.

    * ``commas``: thousands commas removed, then the leading number.
    * ``strict``: every char outside ``[0-9.-]`` removed, then the leading
      number ("L 1,234.50" -> 1234.50, "- L 8" -> -8).
    * ``raw``: leading number of the text as is ("1,250.00" -> 1).
    """
    c = F.col(col) if isinstance(col, str) else col
    if mode == "commas":
        text = F.regexp_replace(c, ",", "")
    elif mode == "strict":
        text = F.regexp_replace(c, r"[^0-9.\-]", "")
    elif mode == "raw":
        text = c
    else:
        raise ValueError(f"unknown parse_money mode {mode!r}")
    return _prefix_number(text).try_cast(MONEY_SQL)


def money_or_zero(col: Column | str, mode: str = "commas") -> Column:
    """``parseFloat(x) || 0``: unparseable money is 0."""
    return F.coalesce(parse_money(col, mode), F.lit(0).cast(MONEY_SQL))


def round_cents(col: Column | str) -> Column:
    """Round to cents, ties toward +infinity, in exact decimal arithmetic.

    Spark's ``round`` rounds ties away from zero, which differs on negative
    ties (-0.005 -> -0.01 instead of 0)."""
    c = (F.col(col) if isinstance(col, str) else col).cast("decimal(30,8)")
    cents = F.floor(c * F.lit(100).cast("decimal(3,0)") + F.lit("0.5").cast("decimal(2,1)"))
    return (cents.cast("decimal(28,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(MONEY_SQL)

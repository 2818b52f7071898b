"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COST_SUM_TYPE = "decimal(28,2)"


def cost_sum(c: Column | str) -> Column:
    """SUM of a money column with a fixed result type (NULL when all inputs are NULL)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sum(col).cast(COST_SUM_TYPE)


def share_pct_1dp(part: Column, total: Column) -> Column:
    """P10: ``round(part / total * 100, 1)`` with half-to-even on the binary
    value (``rint(v * 10) / 10``, the same float steps as a numpy round);
    0/0 -> 0. ``try_divide`` avoids the ANSI divide-by-zero error."""
    ratio = F.try_divide(part.cast("double"), total.cast("double"))
    return F.coalesce(F.rint(ratio * F.lit(100.0) * F.lit(10.0)) / F.lit(10.0), F.lit(0.0))


def guarded_ratio(part: Column, total: Column) -> Column:
    """``part / total`` when ``total > 0`` else 0, as double."""
    return F.when(total > 0, part.cast("double") / total.cast("double")).otherwise(F.lit(0.0))


def share_fraction(pct: Column) -> Column:
    """Share in percent -> fraction for export (NULL -> 0)."""
    return F.coalesce(pct, F.lit(0.0)) / F.lit(100.0)

"""Display text of matrix cells (P14) as Columns - no Python formatting per row.

Counts: ``-`` for 0, else thousands grouped with '.'; costs: ``-`` for 0,
else ``R$ `` and the whole amount (half-even) grouped with '.'; shares:
``100%`` on TOTAL, ``-`` for 0, else one decimal and ``%``. Asset numbers are
grouped like counts, 0 included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.config import TOTAL_LABEL


def whole_text(value: Column) -> Column:
    # format_number rounds half-even and groups with ','; the report groups with '.'.
    return F.translate(F.format_number(value, 0), ",", ".")


def count_text(value: Column) -> Column:
    return F.when(value == 0, F.lit("-")).otherwise(whole_text(value))


def cost_text(value: Column) -> Column:
    return F.when(value == 0, F.lit("-")).otherwise(F.concat(F.lit("R$ "), whole_text(value)))


def share_text(value: Column, status: Column) -> Column:
    return (F.when(status == TOTAL_LABEL, F.lit("100%"))
            .when(value == 0, F.lit("-"))
            .otherwise(F.format_string("%.1f%%", value)))

"""Status x bucket matrices.

One aggregate per bucket sums count and cost for every display status and for
TOTAL; shares are divisions inside that row. The rows hold their cells as an
array, which is unpivoted into the long form ``bucket, status_ord, status,
value``, or laid side by side for the wide form with slots ``p1..pN`` (oldest
bucket first), so schemas are static and the summary is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_CONFIG, TOTAL_LABEL, LedgerConfig
from ledgerlens.functions.numeric import COST_SUM_TYPE, share_pct_1dp
from ledgerlens.functions.status import normalised_status
from ledgerlens.operators.summary import with_slice_tags

COUNT = "count"
COST = "cost"
SHARE = "share"
METRICS = (COUNT, SHARE, COST)


def status_normalised(summary: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """P8 on a status summary: adds ``status_norm``."""
    return summary.withColumn("status_norm", normalised_status(F.col("status"), config))


def status_cells(summary: DataFrame, config: LedgerConfig = DEFAULT_CONFIG, by: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """``by, cells``: all cells of a bucket, in display order, TOTAL last.

    A10: a metric is *summed* over types and raw statuses that share a label -
    a pre-invoice present in two types counts twice, as in the source.
    V2: every display status appears for every bucket, 0 if absent.
    V3: TOTAL sums all labels, those outside the display list included.
    V4: labels outside the display list have no cell.
    V5/P10: shares in percent of TOTAL, 0 of 0 is 0, TOTAL itself 100.0.
    """
    labels = (*config.matrix_statuses, TOTAL_LABEL)

    def total(metric: str, label: str) -> Column:
        value = F.col(metric) if label == TOTAL_LABEL else F.when(F.col("status_norm") == label, F.col(metric))
        return F.coalesce(F.sum(value), F.lit(0))

    sums = status_normalised(summary, config).groupBy(*by).agg(
        *(total("pre_invoices", s).cast("bigint").alias(f"n{i}") for i, s in enumerate(labels)),
        *(total("cost", s).cast(COST_SUM_TYPE).alias(f"c{i}") for i, s in enumerate(labels)))
    last = len(labels) - 1

    def cell(i: int, label: str) -> Column:
        share = F.lit(100.0) if i == last else share_pct_1dp(F.col(f"n{i}"), F.col(f"n{last}"))
        return F.struct(F.lit(i + 1).alias("status_ord"), F.lit(label).alias("status"), F.col(f"n{i}").alias(COUNT),
                        share.alias(SHARE), F.col(f"c{i}").alias(COST))

    return sums.select(*by, F.array(*(cell(i, s) for i, s in enumerate(labels))).alias("cells"))


def matrix_all(cells: DataFrame, by: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """Long form of all three metrics: ``by, status_ord, status, count, share, cost``."""
    return cells.select(*by, F.inline("cells"))


def matrix_long(cells: DataFrame, metric: str) -> DataFrame:
    """R1-R3 (and R6-R8): one metric by (bucket, display status) plus TOTAL."""
    return matrix_all(cells).select("bucket", "status_ord", "status", F.col(metric).alias("value"))


def matrix_wide(cells: DataFrame, metric: str, n_slots: int, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """V1/V6: ``status_ord, status, p1..pN``. ``cells`` has at most N rows (the
    recent buckets), which are gathered into one; missing slots are NULL, and
    without buckets there are no rows."""
    found = cells.agg(F.sort_array(F.collect_list(F.struct("bucket", "cells"))).alias("b")).where(F.size("b") > 0)
    rows = F.array(*(
        F.struct(F.lit(i + 1).alias("status_ord"), F.lit(s).alias("status"),
                 *(F.get(F.get("b", F.lit(k))["cells"], F.lit(i))[metric].alias(f"p{k + 1}") for k in range(n_slots)))
        for i, s in enumerate((*config.matrix_statuses, TOTAL_LABEL))))
    return found.select(F.inline(rows)).orderBy("status_ord")


def matrices_by_slice(summary: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """All three matrices of all slices in one pass over an unsliced summary:
    ``slice, bucket, status_ord, status, count, share, cost``."""
    by = ("slice", "bucket")
    return matrix_all(status_cells(with_slice_tags(summary), config, by), by)

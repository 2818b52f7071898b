"""Unresolved pre-invoices: detail, rollup by provider, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import COST_SUM_TYPE, cost_sum
from ledgerlens.functions.status import is_pending, status_group
from ledgerlens.operators.ledger import month_of

DETAIL_KEYS = ("period", "month", "pre_invoice_type", "pre_invoice_id", "provider_id",
               "provider_name", "provider_type", "status_group", "status")
#: Of the latest trace row, which a pre-invoice has one of.
TRACE_VALUES = ("invoice_id", "file_status", "file_accounting_document", "invoice_amount", "last_update")


#: What the ledger rows under the detail are collapsed by, besides (transaction, version).
COLLAPSE_KEYS = ("period_name", "pre_invoice_type", "pre_invoice_id", "provider_id", "provider_name", "provider_type")


def pending_rows(enriched: DataFrame) -> DataFrame:
    """F5 + P6 on ledger rows already joined to providers and the latest trace
    detail (left join, so a missing trace row reads as a NULL status)."""
    return (enriched.where(is_pending(F.col("status"), F.col("provider_type")))
            .withColumns({"status_group": status_group(F.col("status")),
                          "period": F.col("period_name"),
                          "month": month_of(F.col("period_name"))}))


def pending_detail(rows: DataFrame) -> DataFrame:
    """One row per (period, month, type, pre-invoice, provider, status).

    Trace values are constant per pre-invoice, so their MAX is that value; as
    keys they keep the aggregate a hash aggregate, which maxima of strings would
    not. The invoice amount is not summed."""
    return (rows.groupBy(*DETAIL_KEYS, *TRACE_VALUES)
            .agg(cost_sum("cost_amt").alias("cost"),
                 F.count_distinct("transaction_id").alias("transactions"))
            .select(*DETAIL_KEYS, "cost", "transactions", F.col("invoice_id").cast("string").alias("invoice_id"), "file_status",
                    F.col("file_accounting_document").alias("accounting_document"), "invoice_amount", "last_update"))


def pending_by_provider(detail: DataFrame) -> DataFrame:
    """Provider x period x status. NULL keys are groups (a dataframe
    groupby with dropna=False); the type collapses, so transactions are a sum
    of per-type distinct counts; a sum over only missing costs is 0."""
    return (detail.groupBy("provider_id", "provider_name", "provider_type", "period", "month",
                           "status_group", "status")
            .agg(F.count_distinct("pre_invoice_id").alias("pre_invoices"),
                 F.coalesce(F.sum("cost"), F.lit(0)).cast(COST_SUM_TYPE).alias("cost"),
                 F.coalesce(F.sum("transactions"), F.lit(0)).cast("bigint").alias("transactions")))


def pending_summary(detail: DataFrame) -> DataFrame:
    """Rows, distinct pre-invoices, distinct providers of the detail."""
    return detail.agg(F.count(F.lit(1)).alias("rows"),
                      F.count_distinct("pre_invoice_id").alias("pre_invoices"),
                      F.count_distinct("provider_id").alias("providers"))

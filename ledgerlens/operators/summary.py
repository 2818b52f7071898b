"""Status summary (A3, A4) and its type slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import ALL_SLICE, COMPLEMENTARY, REGULAR
from ledgerlens.functions.numeric import cost_sum
from ledgerlens.functions.status import payment_status

SUMMARY_KEYS = ("bucket", "pre_invoice_type", "status")
#: What the collapsed rows under a summary are keyed by, besides (transaction, version).
COLLAPSE_KEYS = ("bucket", "pre_invoice_type", "pre_invoice_id", "provider_type")


def with_payment_status(rows: DataFrame) -> DataFrame:
    """P5 on the left-joined trace status."""
    return rows.withColumn("status", payment_status(F.col("provider_type"), F.col("status")))


def status_summary(rows: DataFrame) -> DataFrame:
    """A3/A4 with J5: by (bucket, type, status): distinct routes of the
    transactions, distinct pre-invoices, summed cost, from rows at their latest
    version with the trace status. A transaction's route is the max over all of its
    rows. NULL type and NULL status are groups of their own; NULL ids are not
    counted; an all-NULL cost sums to NULL. The same over collapsed rows as over
    raw ones.

    Every row gives two entries: its pre-invoice with the cost, and its
    transaction with the row's route. The first aggregate combines both
    map-side to one per group, so what the window sees of a transaction is as many
    rows as there are groups that it occurs in, however many rows it has; pre-invoices
    are distinct after it, and plain counts remain. (A transaction id is not NULL
    at a latest version, so it tells the two kinds apart.)
    """
    none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("pre_invoice_id", "transaction_id", "row_route", "cost_amt")}
    entries = with_payment_status(rows).select(*SUMMARY_KEYS, F.inline(F.array(
        F.struct("pre_invoice_id", none["transaction_id"], none["row_route"], "cost_amt"),
        F.struct(none["pre_invoice_id"], "transaction_id", "row_route", none["cost_amt"]))))
    combined = (entries.groupBy(*SUMMARY_KEYS, "transaction_id", "pre_invoice_id")
                .agg(F.max("row_route").alias("row_route"), F.sum("cost_amt").alias("cost_amt")))
    route = F.max("row_route").over(Window.partitionBy("transaction_id", "pre_invoice_id"))
    return (combined.withColumn("route", route).groupBy(*SUMMARY_KEYS)
            .agg(F.count_distinct("route").alias("routes"),
                 F.count("pre_invoice_id").alias("pre_invoices"),
                 cost_sum("cost_amt").alias("cost")))


def slice_filter(df: DataFrame, slice_name: str) -> DataFrame:
    """one type, or every row for the unsliced report (NULL and third
    types included - it is not regular UNION complementary)."""
    if slice_name == ALL_SLICE:
        return df
    return df.where(F.col("pre_invoice_type") == slice_name)


def slices_of(pre_invoice_type: Column) -> Column:
    """The slices a row belongs to: always ``all``, plus its own type when that
    is one of the two named slices."""
    typed = F.when(pre_invoice_type.isin(REGULAR, COMPLEMENTARY), pre_invoice_type)
    return F.array_compact(F.array(F.lit(ALL_SLICE), typed))


def with_slice_tags(df: DataFrame) -> DataFrame:
    """Each row once for every slice it belongs to, at most twice."""
    return df.withColumn("slice", F.explode(slices_of(F.col("pre_invoice_type"))))


def slice_status(rows: DataFrame) -> DataFrame:
    """V7: ``slice, has_data`` of every slice, from rows with a
    ``pre_invoice_type`` (of the weekly base, or of its summary): one aggregate,
    one flag a slice. An empty slice gets no matrices in the report sink."""
    is_type = lambda t: F.max(F.col("pre_invoice_type") == t)
    flags = rows.agg((F.count(F.lit(1)) > 0).alias(ALL_SLICE), is_type(REGULAR).alias(REGULAR),
                     is_type(COMPLEMENTARY).alias(COMPLEMENTARY))
    return flags.select(F.inline(F.array(*(
        F.struct(F.lit(s).alias("slice"), F.coalesce(F.col(s), F.lit(False)).alias("has_data"))
        for s in (REGULAR, COMPLEMENTARY, ALL_SLICE)))))

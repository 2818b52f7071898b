"""Latest version of each transaction (A1, J1) and latest trace row per
pre-invoice (W1, W2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ledger import only_processed

TRACE_DETAIL_COLUMNS = ("status", "invoice_id", "file_status", "file_accounting_document",
                        "last_update", "invoice_amount")
#: Order of trace rows: the time, then the log's own sequence where there is
#: one, then everything else, so that equal times have one winner in any input order.
RECENCY = ("last_update", "seq", "invoice_id", "status", "file_status", "file_accounting_document", "invoice_amount")


def latest_versions(cost_event: DataFrame) -> DataFrame:
    """A1: ``MAX(version_id)`` per transaction over all processed rows.

    Reads three narrow columns of the whole ledger; the aggregate combines
    map-side, so a transaction with a huge number of versions is reduced to
    one row per task before the shuffle.
    """
    return (only_processed(cost_event).groupBy("transaction_id")
            .agg(F.max("version_id").alias("version_id")))


def collapse(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per (transaction, version, ``keys``, payload values), cost summed.

    The partial aggregate turns tied copies into one row per task before
    anything is shuffled. Ties still add up, because the version is a key. The
    payload values are keys, not maxima: with fixed-size buffers only, this
    stays a hash aggregate, and the maximum over the few rows left follows later.
    """
    payload = [c for c in ("row_route", "row_vehicle", "payload_elements") if c in rows.columns]
    return rows.groupBy("transaction_id", "version_id", *keys, *payload).agg(F.sum("cost_amt").alias("cost_amt"))


def keep_latest(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """Rows at their transaction's max processed version; ties all stay.

    The join is on the transaction *and* the version: the latest side has one
    row per transaction, and the versions of a hot transaction are spread over
    all tasks, where all but one find no partner. NULL transaction ids and NULL
    versions never match.
    """
    return rows.join(latest, ["transaction_id", "version_id"], "inner")


def trace_latest(trace: DataFrame, columns: tuple[str, ...] = ("status",)) -> DataFrame:
    """One row per ``preinvoice_id`` carrying ``columns`` of its most
    recent event (``ROW_NUMBER() ... ORDER BY last_update DESC = 1``).

    The winner is the greatest struct of the row's own fields in ``RECENCY``
    order, so a field travels once, as order and value in one, and the order is
    cut after the last field asked for: the status alone takes five columns of
    the log. The aggregate combines map-side: a pre-invoice with millions of log
    rows sends one row per task through the shuffle. A struct compares field by
    field with NULL lowest, so NULL times rank last. A NULL status on the winning
    row is kept.
    """
    order = RECENCY[: max(RECENCY.index(c) for c in columns) + 1]
    newest = trace.groupBy("preinvoice_id").agg(F.max(F.struct(*order)).alias("t"))
    return newest.select("preinvoice_id", *(F.col(f"t.{c}").alias(c) for c in columns))


def with_trace(rows: DataFrame, latest_trace: DataFrame) -> DataFrame:
    """Left join on the pre-invoice id cast to string.

    The cast is explicit: an implicit bigint = string comparison would equate
    '007' with 7 and fail under ANSI on a non-numeric key. The trace side has
    one row per key, so the join neither drops nor multiplies ledger rows.
    """
    keyed = rows.withColumn("preinvoice_id", F.col("pre_invoice_id").cast("string"))
    return keyed.join(latest_trace, "preinvoice_id", "left").drop("preinvoice_id")

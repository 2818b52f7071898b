"""The reports composed from the operators.

``LedgerReports`` builds DataFrames. All are lazy but the ranking ones: the
ranking reads the pending detail several times (period guard, exclusion,
totals, grand total), so the detail is written once as a table, and positions
need a second one; both go to the folder ``storage`` (by default the session's
checkpoint folder) when such a report is first built, and ``release`` deletes
them. ``ReportSuite`` (``plans.suite``) runs all reports from one snapshot.

Plan shape of the status summary (weekly or monthly):

1. scan the ledger with ``event_status = 'PROCESSED'`` pushed down; parse the
   period name once per row;
2. top buckets: partial distinct -> tiny exchange -> TakeOrderedAndProject;
3. candidates: ledger rows in the top buckets (broadcast semi join, at most N
   rows) with an accepted provider (dimension join), payload parsed once;
4. collapse per (transaction, version, report keys) with map-side combine, so
   copies of a hot transaction never travel;
5. latest version: narrow ``max(version)`` by transaction over the whole
   ledger (map-side combine), joined on (transaction, version);
6. trace: latest status per pre-invoice by the greatest struct (map-side
   combine), left-joined on the string key;
7. by (bucket, type, status): pre-invoices, and transactions with their route,
   combined map-side before a window sees them (``operators.summary``).
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import (ALL_SLICE, COMPLEMENTARY, DEFAULT_CONFIG, GRANULARITIES, REGULAR, SLICES, WEEKLY, LedgerConfig)
from ledgerlens.functions.display import cost_text, count_text, share_text
from ledgerlens.functions.numeric import share_fraction
from ledgerlens.operators import assets as assets_ops
from ledgerlens.operators import matrix as matrix_ops
from ledgerlens.operators import pending as pending_ops
from ledgerlens.operators import ranking as ranking_ops
from ledgerlens.operators.buckets import period_names, restrict_to_buckets, top_buckets
from ledgerlens.operators.latest import TRACE_DETAIL_COLUMNS, collapse, keep_latest, latest_versions, trace_latest, with_trace
from ledgerlens.operators.ledger import in_detail_year, processed_rows, with_provider
from ledgerlens.operators.payload import payload_assets, payload_route, with_payload_values, with_transaction_route
from ledgerlens.operators.summary import COLLAPSE_KEYS, slice_filter, slice_status, status_summary, with_payment_status
from ledgerlens.session import new_folder, remove_folder, write_table
from ledgerlens.sources.tables import PERIOD_MONTH, LedgerTables

ENRICHED_COLUMNS = ("transaction_id", "bucket", "pre_invoice_type", "pre_invoice_id", "provider_id",
                    "provider_type", "cost_amt", "route", "status")


class LedgerReports:
    """Builders for every report and building block."""

    def __init__(self, tables: LedgerTables, config: LedgerConfig = DEFAULT_CONFIG, storage: str | None = None):
        self.tables = tables
        self.config = config
        self.storage = storage
        self._folders: list[str] = []

    # -- shared inputs ------------------------------------------------------
    @cached_property
    def processed(self) -> DataFrame:
        return processed_rows(self.tables.cost_event)

    @cached_property
    def latest(self) -> DataFrame:
        return latest_versions(self.tables.cost_event)

    @cached_property
    def trace_status(self) -> DataFrame:
        return trace_latest(self.tables.trace_event, ("status",))

    @cached_property
    def trace_detail(self) -> DataFrame:
        return trace_latest(self.tables.trace_event, TRACE_DETAIL_COLUMNS)

    def top(self, granularity: str) -> DataFrame:
        return top_buckets(self.period_names(), granularity, self.config.recent_buckets)

    # -- building blocks ----------------------------------------------------
    def period_names(self) -> DataFrame:
        return period_names(self.tables.cost_event)

    def latest_version_rows(self) -> DataFrame:
        """A1/J1 over the whole processed ledger (no bucket restriction)."""
        return keep_latest(self.processed, self.latest).drop("payload", PERIOD_MONTH)

    def candidates(self, granularity: str) -> DataFrame:
        """Rows of the top buckets with an accepted provider (before J1)."""
        rows = restrict_to_buckets(self.processed, self.top(granularity), granularity)
        return with_provider(rows, self.tables.provider, self.config)

    def base(self, granularity: str) -> DataFrame:
        """Candidates collapsed per (transaction, version, report keys), at
        their latest version. The payload is parsed on the candidate side, so
        the exchanges carry short route and vehicle strings, not its text."""
        return keep_latest(collapse(with_payload_values(self.candidates(granularity)), *COLLAPSE_KEYS), self.latest)

    def enriched(self, granularity: str) -> DataFrame:
        """J1-J5 + P5, row by row: what the status summary sums up."""
        rows = with_transaction_route(keep_latest(with_payload_values(self.candidates(granularity)), self.latest))
        return with_payment_status(with_trace(rows, self.trace_status)).select(*ENRICHED_COLUMNS)

    def payload_route(self, granularity: str = WEEKLY) -> DataFrame:
        return payload_route(self.base(granularity))

    def payload_assets(self, granularity: str) -> DataFrame:
        return payload_assets(self.base(granularity))

    # -- R0 status summary ----------------------------------------------------
    def status_summary(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        rows = with_trace(self.base(granularity), self.trace_status)
        return slice_filter(status_summary(rows), slice_name)

    def status_normalised(self, granularity: str = WEEKLY, slice_name: str = ALL_SLICE) -> DataFrame:
        return matrix_ops.status_normalised(self.status_summary(granularity, slice_name), self.config)

    def slice_status(self, granularity: str = WEEKLY) -> DataFrame:
        """V7, from the rows at their latest version: no payload, no trace."""
        return slice_status(keep_latest(self.candidates(granularity).drop("payload"), self.latest))

    # -- R1-R3, R6-R8 matrices --------------------------------------------------
    def cells(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return matrix_ops.status_cells(self.status_summary(granularity, slice_name), self.config)

    def matrix(self, metric: str, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return matrix_ops.matrix_long(self.cells(granularity, slice_name), metric)

    def matrix_wide(self, metric: str, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return matrix_ops.matrix_wide(self.cells(granularity, slice_name), metric, self.config.recent_buckets, self.config)

    def share_fractions(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        """The share matrix as fractions, as it is exported."""
        return self.matrix(matrix_ops.SHARE, granularity, slice_name).withColumn("value", share_fraction(F.col("value")))

    def matrix_display(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        """The three matrices of a slice as display text, long form."""
        return matrix_ops.matrix_all(self.cells(granularity, slice_name)).select(
            "bucket", "status_ord", "status", count_text(F.col("count")).alias("count_text"),
            share_text(F.col("share"), F.col("status")).alias("share_text"), cost_text(F.col("cost")).alias("cost_text"))

    # -- R4/R5, R9/R10 asset counts -------------------------------------------
    def asset_counts(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return assets_ops.asset_counts_slice(self.payload_assets(granularity), slice_name)

    def asset_counts_all_slices(self, granularity: str) -> DataFrame:
        return assets_ops.asset_counts_all_slices(self.payload_assets(granularity))

    def asset_row(self, metric: str, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return assets_ops.asset_row(self.asset_counts(granularity, slice_name), metric, self.config.recent_buckets)

    def asset_display(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return assets_ops.asset_display(self.asset_counts(granularity, slice_name))

    # -- A14 ----------------------------------------------------------------------
    def report_row_counts(self) -> DataFrame:
        """``slice, report, granularity, rows`` of the sliced results, 0 included."""
        def per_slice(df: DataFrame, report: str, granularity: str, counted) -> DataFrame:
            counts = df.agg(*(counted(F.lit(True) if s == ALL_SLICE else F.col("pre_invoice_type") == s).alias(s)
                              for s in (REGULAR, COMPLEMENTARY, ALL_SLICE)))
            return counts.select(F.inline(F.array(*(
                F.struct(F.lit(s).alias("slice"), F.lit(report).alias("report"), F.lit(granularity).alias("granularity"),
                         F.coalesce(F.col(s), F.lit(0)).cast("bigint").alias("rows")) for s in SLICES))))

        parts = []
        for g in GRANULARITIES:
            parts.append(per_slice(self.status_summary(g), "status_summary", g, F.count_if))
            parts.append(per_slice(self.payload_assets(g), "asset_counts", g,
                                   lambda inside: F.count_distinct(F.when(inside, F.col("bucket")))))
        return reduce(DataFrame.unionByName, parts)

    # -- R11-R16 pending, ranking ---------------------------------------------
    def pending_detail(self) -> DataFrame:
        rows = with_provider(in_detail_year(self.processed, self.config), self.tables.provider, self.config)
        rows = keep_latest(collapse(rows, *pending_ops.COLLAPSE_KEYS), self.latest)
        return pending_ops.pending_detail(pending_ops.pending_rows(with_trace(rows, self.trace_detail)))

    def pending_by_provider(self) -> DataFrame:
        return pending_ops.pending_by_provider(self.pending_detail())

    def pending_summary(self) -> DataFrame:
        return pending_ops.pending_summary(self.pending_detail())

    def _folder(self, name: str) -> str:
        self._folders.append(new_folder(self.tables.cost_event.sparkSession, self.storage, name))
        return self._folders[-1]

    @cached_property
    def stored_detail(self) -> DataFrame:
        """The pending detail as a table; building it runs a job."""
        return write_table(self.pending_detail(), self._folder("pending-detail"))

    def ranking_excluded_periods(self) -> DataFrame:
        return ranking_ops.excluded_periods(self.stored_detail, self.config)

    def provider_ranking(self) -> DataFrame:
        return ranking_ops.provider_ranking(self.stored_detail, self.config)

    def provider_ranking_positions(self) -> DataFrame:
        return ranking_ops.with_positions(self.provider_ranking(), self._folder("ranking"))

    def provider_ranking_total(self) -> DataFrame:
        return ranking_ops.ranking_total(self.provider_ranking())

    def release(self) -> None:
        """Delete the tables that ranking reports have written."""
        for folder in self._folders:
            remove_folder(self.tables.cost_event.sparkSession, folder)
        self._folders.clear()
        self.__dict__.pop("stored_detail", None)


__all__ = ["LedgerReports"]

"""Query catalogue: one entry per report and building block, each paired with
its DuckDB oracle SQL. ``__spark_entry__`` exposes these to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.config import ASSET_LABELS, GRANULARITIES, MONTHLY, SLICES, WEEKLY
from ledgerlens.operators.matrix import METRICS
from ledgerlens.plans import oracle
from ledgerlens.plans.reports import LedgerReports
from ledgerlens.plans.suite import ReportSuite
from ledgerlens.sources.standin import standin_tables

Builder = Callable[[LedgerReports], DataFrame]


def _suite(reports: LedgerReports) -> ReportSuite:
    return ReportSuite(reports.tables, reports.config, reports.storage)


def _builders() -> dict[str, tuple[Builder, str | None]]:
    out: dict[str, tuple[Builder, str | None]] = {}

    def add(name: str, fn: Builder, sql: str | None) -> None:
        out[name] = (fn, sql)

    for g in GRANULARITIES:
        for s in SLICES:
            add(f"status_summary_{g}_{s}", lambda r, g=g, s=s: r.status_summary(g, s),
                oracle.status_summary(g, s))
        for s in SLICES:
            for m in METRICS:
                add(f"{m}_matrix_{g}_{s}", lambda r, g=g, s=s, m=m: r.matrix(m, g, s),
                    oracle.matrix_long(m, g, s))
        for s in SLICES:
            add(f"asset_counts_{g}_{s}", lambda r, g=g, s=s: r.asset_counts(g, s),
                oracle.asset_counts(g, s))
        add(f"asset_counts_{g}_by_slice", lambda r, g=g: r.asset_counts_all_slices(g),
            oracle.asset_counts_all_slices(g))
        for s in SLICES:
            for m in METRICS:
                add(f"matrix_wide_{m}_{g}_{s}", lambda r, g=g, s=s, m=m: r.matrix_wide(m, g, s),
                    oracle.matrix_wide(m, g, s))
        add(f"matrix_display_{g}", lambda r, g=g: r.matrix_display(g), oracle.matrix_display(g, "all"))
        for s in SLICES:
            add(f"matrix_display_{g}_{s}", lambda r, g=g, s=s: r.matrix_display(g, s), oracle.matrix_display(g, s))
            add(f"share_fraction_{g}_{s}", lambda r, g=g, s=s: r.share_fractions(g, s), oracle.share_fractions(g, s))
            add(f"asset_display_{g}_{s}", lambda r, g=g, s=s: r.asset_display(g, s), oracle.asset_display(g, s))
            for m in ASSET_LABELS:
                add(f"asset_matrix_wide_{m}_{g}_{s}", lambda r, g=g, s=s, m=m: r.asset_row(m, g, s), oracle.asset_row(m, g, s))
        add(f"ledger_enriched_{g}", lambda r, g=g: r.enriched(g), oracle.ledger_enriched(g))
        add(f"payload_assets_{g}", lambda r, g=g: r.payload_assets(g).select(
            "transaction_id", "bucket", "pre_invoice_type", "route", "vehicle"), oracle.payload_assets(g))

    add("pending_detail", lambda r: r.pending_detail(), oracle.pending_detail())
    add("pending_by_provider", lambda r: r.pending_by_provider(), oracle.pending_by_provider())
    add("provider_ranking", lambda r: r.provider_ranking(), oracle.provider_ranking())
    add("provider_ranking_positions", lambda r: r.provider_ranking_positions(), oracle.provider_ranking_positions())
    add("provider_ranking_total", lambda r: r.provider_ranking_total(), oracle.provider_ranking_total())
    add("pending_summary", lambda r: r.pending_summary(), oracle.pending_summary())
    add("ranking_excluded_periods", lambda r: r.ranking_excluded_periods(), oracle.ranking_excluded_periods())

    add("period_names", lambda r: r.period_names(), oracle.period_names())
    add("top_periods", lambda r: r.top(WEEKLY), oracle.top_buckets(WEEKLY))
    add("top_months", lambda r: r.top(MONTHLY), oracle.top_buckets(MONTHLY))
    add("latest_version_rows", lambda r: r.latest_version_rows().select(
        "transaction_id", "version_id", "period_name", "cost_amt", "pre_invoice_type", "pre_invoice_id",
        "provider_id"), oracle.latest_version_rows())
    add("trace_latest", lambda r: r.trace_status, oracle.trace_latest())
    add("trace_latest_detail", lambda r: r.trace_detail, oracle.trace_latest_detail())
    add("payload_route", lambda r: r.payload_route(WEEKLY), oracle.payload_route(WEEKLY))
    add("status_normalised", lambda r: r.status_normalised(WEEKLY), oracle.status_normalised(WEEKLY))
    add("report_row_counts", lambda r: _suite(r).report_row_counts(), oracle.report_row_counts())
    add("suite_status_matrix", lambda r: _suite(r).datasets()["status_matrix"], oracle.suite_status_matrix())
    add("suite_asset_counts", lambda r: _suite(r).datasets()["asset_counts"], oracle.suite_asset_counts())
    add("slice_status", lambda r: r.slice_status(WEEKLY), oracle.slice_status(WEEKLY))
    return out


_CATALOG = _builders()


def build(name: str, reports: LedgerReports) -> DataFrame:
    """The named report or building block of ``reports``."""
    return _CATALOG[name][0](reports)


def _runner(fn: Builder) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(LedgerReports(standin_tables(spark, sf_dir)))
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _runner(fn) for name, (fn, _) in _CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _CATALOG.items() if sql is not None}

"""All reports of one run from one consistent snapshot, written as datasets (K1).

The analysed job submits 13 independent warehouse queries; each re-reads the
live tables and repeats the latest-version scan. Here three passes over the
ledger (its period names, its latest versions, its rows) build a *snapshot* of
exactly the rows any report can use:

    processed rows  (period in the top periods  OR  month in the top months
                     OR  year = detail year)
      x accepted provider, payload values per row (JSON parsed once)
      collapsed per (transaction, version, report keys)
      x latest version per transaction
      + latest trace detail per pre-invoice    (one dedup of the trace log)

The snapshot is a Parquet table, partitioned by the flags that say which
reports use a row, in a folder under ``storage`` (by default the session's
checkpoint folder, which is shared storage on a cluster). Reports read only
their partitions and columns of it; a lost executor costs a re-read. Per-slice
summaries are filters of the unsliced summary (type is a group key). ``release``
deletes the run's folder.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ledgerlens.config import ALL_SLICE, DEFAULT_CONFIG, GRANULARITIES, MONTHLY, SLICES, WEEKLY, LedgerConfig
from ledgerlens.operators import assets as assets_ops
from ledgerlens.operators import matrix as matrix_ops
from ledgerlens.operators import pending as pending_ops
from ledgerlens.operators import ranking as ranking_ops
from ledgerlens.operators.buckets import period_names, top_buckets
from ledgerlens.operators.latest import (TRACE_DETAIL_COLUMNS, collapse, keep_latest, latest_versions, trace_latest,
                                        with_trace)
from ledgerlens.operators.ledger import folder_of, month_of, processed_rows, with_provider, year_of
from ledgerlens.operators.payload import payload_assets, with_payload_values
from ledgerlens.operators.ranking import order_column
from ledgerlens.operators.summary import slice_filter, slice_status, status_summary
from ledgerlens.plans.runs import new_run, publish
from ledgerlens.session import new_folder, remove_folder, write_table
from ledgerlens.sources.tables import PERIOD_MONTH, LedgerTables

#: Report order (ascending NULLs first, as the warehouse sorts; ties
#: broken by the remaining keys so files are reproducible).
REPORT_ORDER = {  # column, or "-column" for descending (NULLs last)
    "status_summary": ("bucket", "pre_invoice_type", "status"),
    "status_matrix": ("bucket", "status_ord"),
    "asset_counts": ("slice", "bucket"),
    "pending_detail": ("month", "period", "-cost", "pre_invoice_id", "provider_id", "status"),
    "pending_by_provider": ("-cost", "provider_id", "period", "status"),
    "provider_ranking": ("position",),
    "ranking_excluded_periods": ("period",),
    "slice_status": ("slice",),
}
#: Reports that grow with the ledger: range-partitioned, one file per range.
#: All others are bounded by construction (recent buckets x display statuses,
#: slices, dropped periods, totals) and written by one task.
GROWING = ("status_summary", "pending_detail", "pending_by_provider", "provider_ranking")

FLAGS = ("in_top_period", "in_top_month", "in_detail_year")


class ReportSuite:
    def __init__(self, tables: LedgerTables, config: LedgerConfig = DEFAULT_CONFIG, storage: str | None = None):
        self.tables = tables
        self.config = config
        self.spark = tables.cost_event.sparkSession
        self._storage = storage
        self._rows: dict[tuple[str, str], dict[str, int]] = {}

    @cached_property
    def folder(self) -> str:
        """Where this run keeps its tables."""
        return new_folder(self.spark, self._storage, "ledgerlens-run")

    def _keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        return write_table(df, f"{self.folder}/{name}", partition_by)

    def _keep_counted(self, df: DataFrame, report: str, granularity: str, in_slice) -> DataFrame:
        """``_keep``, and the rows of each slice, observed while they are written."""
        seen = Observation()
        kept = self._keep(df.observe(seen, *(F.count_if(in_slice(s)).alias(s) for s in SLICES)), f"{report}_{granularity}")
        self._rows[report, granularity] = seen.get
        return kept

    # -- snapshot -------------------------------------------------------------
    @cached_property
    def processed(self) -> DataFrame:
        return processed_rows(self.tables.cost_event)

    @cached_property
    def top(self) -> dict[str, DataFrame]:
        """Top buckets per granularity, at most N rows each, both from one scan."""
        names = self._keep(period_names(self.tables.cost_event), "period_names")
        return {g: top_buckets(names, g, self.config.recent_buckets) for g in GRANULARITIES}

    def _flag(self, rows: DataFrame, key: str, granularity: str, flag: str) -> DataFrame:
        top = self.top[granularity].select(F.col("bucket").alias(key), F.lit(True).alias(flag))
        return rows.join(F.broadcast(top), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))

    @cached_property
    def snapshot(self) -> DataFrame:
        rows = self.processed.withColumn("month", month_of(F.col("period_name")))
        if PERIOD_MONTH in rows.columns:  # an ingested ledger: only the folders of months that a report uses
            months = reduce(DataFrame.union, (t.select(folder_of(month_of(F.col("bucket")))) for t in self.top.values())).distinct()
            used = [m for m, in months.collect() if m is not None]  # at most as many as top buckets
            rows = rows.where(F.col(PERIOD_MONTH).isin(used) | F.col(PERIOD_MONTH).startswith("m" + self.config.detail_year)).drop(PERIOD_MONTH)
        rows = self._flag(rows, "period_name", WEEKLY, "in_top_period")
        rows = self._flag(rows, "month", MONTHLY, "in_top_month")
        rows = rows.withColumn("in_detail_year", F.coalesce(
            year_of(F.col("period_name")) == F.lit(self.config.detail_year), F.lit(False)))
        rows = rows.where(F.col("in_top_period") | F.col("in_top_month") | F.col("in_detail_year"))
        rows = with_provider(rows, self.tables.provider, self.config)
        # parsed only for rows a bucket report uses
        rows = with_payload_values(rows, F.col("in_top_period") | F.col("in_top_month"))
        rows = keep_latest(collapse(rows, *pending_ops.COLLAPSE_KEYS, "month", *FLAGS), latest_versions(self.tables.cost_event))
        rows = with_trace(rows, trace_latest(self.tables.trace_event, TRACE_DETAIL_COLUMNS))
        return self._keep(rows, "snapshot", FLAGS)

    # -- reports ----------------------------------------------------------------
    def _bucket_rows(self, granularity: str) -> DataFrame:
        flag, bucket = ("in_top_period", "period_name") if granularity == WEEKLY else ("in_top_month", "month")
        return self.snapshot.where(F.col(flag)).withColumn("bucket", F.col(bucket))

    @cached_property
    def summaries(self) -> dict[str, DataFrame]:
        # the snapshot rows already carry the latest raw trace status
        def in_slice(s: str) -> Column:
            return F.lit(True) if s == ALL_SLICE else F.col("pre_invoice_type") == s

        return {g: self._keep_counted(status_summary(self._bucket_rows(g)), "status_summary", g, in_slice)
                for g in GRANULARITIES}

    def status_summary(self, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return slice_filter(self.summaries[granularity], slice_name)

    def matrices(self, granularity: str) -> DataFrame:
        """Count, share and cost matrices of every slice."""
        return matrix_ops.matrices_by_slice(self.summaries[granularity], self.config)

    def matrix(self, metric: str, granularity: str, slice_name: str = ALL_SLICE) -> DataFrame:
        return (self.matrices(granularity).where(F.col("slice") == slice_name)
                .select("bucket", "status_ord", "status", F.col(metric).alias("value")))

    def asset_counts_by_slice(self, granularity: str) -> DataFrame:
        return assets_ops.asset_counts_all_slices(payload_assets(self._bucket_rows(granularity)))

    @cached_property
    def asset_counts(self) -> dict[str, DataFrame]:
        return {g: self._keep_counted(self.asset_counts_by_slice(g), "asset_counts", g, lambda s: F.col("slice") == s)
                for g in GRANULARITIES}

    def report_row_counts(self) -> DataFrame:
        """``slice, report, granularity, rows`` of the sliced results, 0
        included: what their writes counted, no pass over any table of its own."""
        kept = self.summaries, self.asset_counts  # written by now
        rows = [(s, report, g, int(n.get(s) or 0)) for (report, g), n in self._rows.items() for s in SLICES]
        return kept[0][WEEKLY].sparkSession.createDataFrame(rows, "slice string, report string, granularity string, rows bigint")

    @cached_property
    def pending_detail(self) -> DataFrame:
        rows = self.snapshot.where(F.col("in_detail_year"))
        return self._keep(pending_ops.pending_detail(pending_ops.pending_rows(rows)), "pending_detail")

    @cached_property
    def provider_ranking(self) -> DataFrame:
        """With positions."""
        return ranking_ops.with_positions(ranking_ops.provider_ranking(self.pending_detail, self.config), f"{self.folder}/ranking")

    def slice_status(self) -> DataFrame:
        return slice_status(self.summaries[WEEKLY])

    def datasets(self) -> dict[str, DataFrame]:
        """Every report as one DataFrame; sliced reports carry ``granularity``
        and ``slice`` columns (partition columns of the written dataset).

        V7: a slice without weekly data has no sliced reports at all, monthly
        ones included."""
        shown = F.broadcast(self.slice_status().where("has_data").select("slice"))  # as many rows as slices

        def sliced(parts: dict[str, DataFrame]) -> DataFrame:
            tagged = [df.withColumn("granularity", F.lit(g)) for g, df in parts.items()]
            return reduce(DataFrame.unionByName, tagged).join(shown, "slice", "left_semi")

        def all_slices(g: str) -> DataFrame:
            return reduce(DataFrame.unionByName, (self.status_summary(g, s).withColumn("slice", F.lit(s)) for s in SLICES))

        return {
            "status_summary": sliced({g: all_slices(g) for g in GRANULARITIES}),
            "status_matrix": sliced({g: self.matrices(g) for g in GRANULARITIES}),
            "asset_counts": sliced(self.asset_counts),
            "slice_status": self.slice_status(),
            "pending_detail": self.pending_detail,
            "pending_by_provider": pending_ops.pending_by_provider(self.pending_detail),
            "pending_summary": pending_ops.pending_summary(self.pending_detail),
            "ranking_excluded_periods": ranking_ops.excluded_periods(self.pending_detail, self.config),
            "provider_ranking": self.provider_ranking,
            "provider_ranking_total": ranking_ops.ranking_total(self.provider_ranking),
        }

    def write(self, output_dir: str, fmt: str = "parquet", concurrent_jobs: int = 4) -> dict[str, str]:
        """K1: write every report under a folder of this run, ``<output_dir>/run-<id>/<report>``,
        and publish them all at once when the last one is complete (``plans.runs``;
        ``runs.read_report`` follows). If one fails, the run's folder is deleted and
        the run before stays the published one.

        Sliced reports are partitioned by ``granularity`` and ``slice``, all are in report
        order (T3-T6) file by file. Growing reports are range-partitioned
        on that order and written by many tasks. The report jobs are independent,
        so up to ``concurrent_jobs`` are submitted at once from driver threads
        and share the cluster. Nothing is collected to the driver."""
        run = new_run(output_dir)
        jobs = []
        for name, df in self.datasets().items():
            parts = [c for c in ("granularity", "slice") if c in df.columns]
            order = [F.col(c) for c in parts] + [order_column(c) for c in REPORT_ORDER.get(name, ()) if c not in parts]
            df = df.repartitionByRange(*order) if name in GROWING else df.coalesce(1)
            writer = (df.sortWithinPartitions(*order) if order else df).write.mode("errorifexists").format(fmt)
            jobs.append((writer.partitionBy(*parts) if parts else writer, f"{run}/{name}"))
        try:
            with ThreadPoolExecutor(max_workers=max(1, concurrent_jobs)) as pool:
                for done in [pool.submit(w.save, path) for w, path in jobs]:
                    done.result()
        except BaseException:
            remove_folder(self.spark, run)
            raise
        paths = {path.rsplit("/", 1)[1]: path for _, path in jobs}
        rows = {"/".join(key): {s: int(n.get(s) or 0) for s in SLICES} for key, n in self._rows.items()}
        publish(self.spark, output_dir, paths, format=fmt, rows=rows)
        return paths

    def release(self) -> None:
        """Delete the run's folder; frames built from it can no longer be read."""
        if "folder" in self.__dict__:
            remove_folder(self.spark, self.folder)
        for name in ("folder", "top", "snapshot", "summaries", "asset_counts", "pending_detail", "provider_ranking"):
            self.__dict__.pop(name, None)
        self._rows.clear()

"""The one-snapshot suite writes every report and agrees with the per-query plans."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import runs
from ledgerlens.plans.reports import LedgerReports
from ledgerlens.plans.suite import REPORT_ORDER, ReportSuite
from ledgerlens.sources.standin import standin_tables
from tests.conftest import SF_SMALL, cost


def _same(a, b):
    key = str
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.fixture(scope="module")
def pair(spark):
    tables = standin_tables(spark, SF_SMALL)
    suite = ReportSuite(tables)
    yield suite, LedgerReports(tables)
    suite.release()


@pytest.mark.parametrize("g", ["weekly", "monthly"])
@pytest.mark.parametrize("s", ["all", "regular", "complementary"])
def test_suite_summaries_and_matrices(pair, g, s):
    suite, reports = pair
    assert _same(suite.status_summary(g, s), reports.status_summary(g, s))
    for m in ("count", "share", "cost"):
        assert _same(suite.matrix(m, g, s), reports.matrix(m, g, s))


def test_suite_pending_and_ranking(pair):
    suite, reports = pair
    assert _same(suite.pending_detail, reports.pending_detail())
    ds = suite.datasets()
    assert _same(ds["provider_ranking"], reports.provider_ranking_positions())
    assert _same(ds["pending_by_provider"], reports.pending_by_provider())
    assert _same(ds["asset_counts"].where(F.col("granularity") == "weekly").drop("granularity"),
                 reports.asset_counts_all_slices("weekly"))


@pytest.fixture(scope="module")
def paths(spark, pair, tmp_path_factory):
    """All datasets, written once, without AQE joining small partitions."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        return pair[0].write(str(tmp_path_factory.mktemp("reports")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_suite_writes_partitioned_datasets(spark, pair, paths):
    suite, _ = pair
    assert {"status_summary", "status_matrix", "asset_counts", "pending_detail", "pending_by_provider",
            "provider_ranking", "provider_ranking_total", "pending_summary", "ranking_excluded_periods",
            "slice_status"} <= set(paths)
    back = spark.read.parquet(paths["status_summary"])
    assert {"granularity", "slice"} <= set(back.columns)
    assert back.where("granularity = 'weekly' AND slice = 'all'").count() == \
        suite.status_summary("weekly", "all").count()


def _in_file_order(path):
    """Rows as a reader meets them: file by file, by the number of the task that wrote it."""
    import pyarrow.parquet as pq
    files = sorted(Path(path).rglob("*.parquet"), key=lambda f: (str(f.parent), f.name.split("-")[1]))
    return [r for f in files for r in pq.ParquetFile(f).read().to_pylist()], len(files)


def _key(spec, row):
    """Ascending with NULLs first; "-column" descending with NULLs last."""
    v = row[spec.lstrip("-")]
    return (v is None, -(v or 0)) if spec.startswith("-") else (v is not None, v if v is not None else 0)


@pytest.mark.parametrize("name", ["pending_detail", "pending_by_provider", "provider_ranking"])
def test_written_files_are_in_report_order(paths, name):
    rows, files = _in_file_order(paths[name])
    assert files > 1  # written by several tasks
    keys = [tuple(_key(s, r) for s in REPORT_ORDER[name]) for r in rows]
    assert keys == sorted(keys) and len(rows) > 5


@pytest.mark.parametrize("name", ["status_summary", "status_matrix", "asset_counts"])
def test_sliced_files_are_in_report_order(paths, name):
    for folder in {f.parent for f in Path(paths[name]).rglob("*.parquet")}:
        rows, _ = _in_file_order(folder)
        order = [c for c in REPORT_ORDER[name] if c in rows[0]]
        keys = [tuple(_key(s, r) for s in order) for r in rows]
        assert keys == sorted(keys)


def test_empty_weekly_slice_has_no_sliced_reports(spark, tables, tmp_path):
    costs = [cost(k, 1, name, pid=k) for k, name in enumerate(("202612Q2", "202612Q1", "202611Q2", "202611Q1", "202610Q2"))]
    costs.append(cost(50, 1, "202609Q1", pid=50, ptype="complementary"))  # in a top month, in no top period
    suite = ReportSuite(tables(costs), storage=str(tmp_path / "run"))
    paths = suite.write(str(tmp_path / "out"))
    assert {(r["slice"], r["has_data"]) for r in suite.slice_status().collect()} == {
        ("all", True), ("regular", True), ("complementary", False)}
    for name in ("status_summary", "status_matrix", "asset_counts"):
        got = spark.read.parquet(paths[name])
        assert got.where("slice = 'complementary'").count() == 0 and got.where("slice = 'regular'").count() > 0
    assert suite.status_summary("monthly", "complementary").count() == 1
    suite.release()
    assert list((tmp_path / "run").iterdir()) == []


def test_row_counts_come_from_the_writes(spark, pair):
    suite, reports = pair
    counts = suite.report_row_counts()
    assert "FileScan" not in counts._jdf.queryExecution().executedPlan().toString()
    assert _same(counts, reports.report_row_counts())


def test_row_counts_of_an_empty_ledger(tables):
    suite = ReportSuite(tables([]))
    assert {r["rows"] for r in suite.report_row_counts().collect()} == {0} and suite.report_row_counts().count() == 12
    suite.release()


def test_a_failed_run_leaves_the_one_before(spark, tables, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with pytest.raises(LookupError):
        runs.read_report(spark, out, "pending_summary")
    suite = ReportSuite(tables([cost(1, 1), cost(2, 1, pid=2)]), storage=str(tmp_path / "work"))
    suite.write(out)
    suite.release()
    first = runs.latest_run(spark, out)
    assert runs.read_report(spark, out, "status_summary").where("granularity = 'weekly' AND slice = 'all'").first()["pre_invoices"] == 2
    assert first["rows"]["status_summary/weekly"] == {"regular": 1, "complementary": 0, "all": 1}

    second = ReportSuite(tables([cost(1, 1)]), storage=str(tmp_path / "work"))
    good = second.datasets()
    broken = good | {"pending_by_provider": good["pending_by_provider"].withColumn("cost", F.raise_error(F.lit("lost")).cast("int")),
                     "slice_status": good["slice_status"].withColumn("has_data", F.raise_error(F.lit("lost")).cast("boolean"))}
    monkeypatch.setattr(second, "datasets", lambda: broken)
    with pytest.raises(Exception, match="lost"):
        second.write(out)
    assert runs.latest_run(spark, out) == first and len(list((tmp_path / "out").glob("run-*"))) == 1
    assert runs.read_report(spark, out, "status_summary").where("granularity = 'weekly' AND slice = 'all'").first()["pre_invoices"] == 2

    monkeypatch.undo()
    second.write(out)
    assert runs.read_report(spark, out, "status_summary").where("granularity = 'weekly' AND slice = 'all'").first()["pre_invoices"] == 1
    (tmp_path / "out" / "manifests" / "000000000003.json").write_text('{"datasets": {')  # a run cut off while it published
    assert runs.latest_run(spark, out)["rows"]["status_summary/weekly"]["all"] == 1
    runs.prune_runs(spark, out, keep=2)
    assert len(list((tmp_path / "out").glob("run-*"))) == 1 and runs.latest_run(spark, out) != first
    second.release()


def test_reports_read_only_their_columns_and_partitions(spark, pair):
    suite, _ = pair
    plan = suite.asset_counts_by_slice("weekly")._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "row_route" in schema and "invoice_amount" not in schema and "cost_amt" not in schema
    assert "in_top_period" in plan[plan.index("PartitionFilters"):].split("]")[0]

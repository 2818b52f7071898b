"""Tables checked when they are opened (S1-S3), and the ledger stored by month."""

import os
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.config import LedgerConfig
from ledgerlens.plans.reports import LedgerReports
from ledgerlens.plans.suite import ReportSuite
from ledgerlens.sources.ingest import ingest_ledger, ingested_ledger
from ledgerlens.sources.standin import standin_tables
from ledgerlens.sources.tables import (COST_EVENT_SCHEMA, PROVIDER_SCHEMA, TRACE_EVENT_SCHEMA, LedgerTables, conform,
                                       ledger_tables, read_ledger_tables)
from tests.conftest import SF_SMALL, cost, provider, trace


def canon(df):
    return sorted((tuple(repr(v) for v in r) for r in df.select(*sorted(df.columns)).collect()))


@pytest.fixture
def stored(spark, tables, tmp_path):
    t = tables([cost(1, 1), cost(2, 1, pid=2)], [trace("1", "accounting_error")])
    paths = [str(tmp_path / n) for n in ("c", "t", "p")]
    for df, p in zip((t.cost_event, t.trace_event, t.provider), paths):
        df.write.parquet(p)
    return paths


def test_missing_needed_column_raises_and_names_it(spark, stored, tmp_path):
    spark.read.parquet(stored[0]).drop("version_id", "payload").write.parquet(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="cost_event: column version_id is missing; column payload is missing"):
        read_ledger_tables(spark, str(tmp_path / "short"), *stored[1:])


def test_log_without_sequence_reads(spark, stored, tmp_path):
    spark.read.parquet(stored[1]).drop("seq").write.parquet(str(tmp_path / "log"))
    t = read_ledger_tables(spark, stored[0], str(tmp_path / "log"), stored[2])
    assert [tuple(r) for r in LedgerReports(t).trace_status.collect()] == [("1", "accounting_error")]


def test_tables_by_name(spark, stored):
    names = ["contract_c", "contract_t", "contract_p"]
    for n, p in zip(names, stored):
        spark.read.parquet(p).createOrReplaceTempView(n)
    got, want = ledger_tables(spark, *names), read_ledger_tables(spark, *stored)
    assert canon(LedgerReports(got).status_summary("weekly")) == canon(LedgerReports(want).status_summary("weekly"))


@pytest.mark.parametrize("sql, fine", [
    ("CAST(7 AS INT)", True), ("CAST(7 AS DECIMAL(19,0))", False), ("'7'", False), ("CAST(7 AS DOUBLE)", False), ("NULL", True)])
def test_types_that_could_lose_values_raise(spark, sql, fine):
    df = spark.range(1).selectExpr(f"{sql} AS id", "'n' AS NAME", "'MEI' AS type", "1 AS extra")
    if fine:
        assert conform(df, PROVIDER_SCHEMA, "provider").schema.simpleString() == PROVIDER_SCHEMA.simpleString()
    else:
        with pytest.raises(ValueError, match="column id is"):
            conform(df, PROVIDER_SCHEMA, "provider")


@pytest.mark.parametrize("sql, fine", [("CAST(7 AS DECIMAL(10,1))", True), ("CAST(7 AS INT)", True), ("7L", False),
                                       ("CAST(7 AS DECIMAL(18,3))", False), ("CAST(7 AS DOUBLE)", False)])
def test_amounts_keep_all_their_digits(spark, sql, fine):
    df = spark.createDataFrame([], COST_EVENT_SCHEMA).drop("cost_amt").withColumn("cost_amt", F.expr(sql))
    if fine:
        assert conform(df, COST_EVENT_SCHEMA, "c").schema["cost_amt"].dataType == COST_EVENT_SCHEMA["cost_amt"].dataType
    else:
        with pytest.raises(ValueError, match="cost_amt"):
            conform(df, COST_EVENT_SCHEMA, "c")


def test_empty_tables_read(spark, tmp_path):
    t = [spark.createDataFrame([], s) for s in (COST_EVENT_SCHEMA, TRACE_EVENT_SCHEMA, PROVIDER_SCHEMA)]
    assert LedgerReports(LedgerTables(*t)).status_summary("weekly").count() == 0


# -- the ledger by month -------------------------------------------------------------------

@pytest.fixture(scope="module")
def by_month(spark, tmp_path_factory):
    plain = standin_tables(spark, SF_SMALL)
    path = str(tmp_path_factory.mktemp("ledger") / "by_month")
    ingest_ledger(plain.cost_event, path)
    return plain, LedgerTables(ingested_ledger(spark, path), plain.trace_event, plain.provider), path


@pytest.mark.parametrize("report", [
    lambda r: r.status_summary("weekly"), lambda r: r.status_summary("monthly"), lambda r: r.asset_counts_all_slices("monthly"),
    lambda r: r.pending_detail(), lambda r: r.latest_version_rows(), lambda r: r.period_names(), lambda r: r.enriched("weekly")])
def test_reports_are_the_same_on_the_ledger_by_month(by_month, report):
    plain, stored, _ = by_month
    assert canon(report(LedgerReports(stored))) == canon(report(LedgerReports(plain)))


def test_suite_is_the_same_on_the_ledger_by_month(by_month):
    plain, stored, _ = by_month
    a, b = ReportSuite(plain), ReportSuite(stored)
    one, two = a.datasets(), b.datasets()
    for name in one:
        assert canon(two[name]) == canon(one[name]), name
    a.release(), b.release()


def months_read(df):
    """Month folders whose files the scans with a filter on the month have read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, re.findall(r"PartitionFilters: \[([^\]]*period_month[^\]]*)\]", plan)


def test_detail_year_prunes_folders(spark, by_month, tmp_path):
    _, stored, path = by_month
    plan, filters = months_read(LedgerReports(stored).pending_detail())
    assert filters and "StartsWith(period_month" in filters[0]
    # files of other years are not even opened: they may be broken
    import shutil
    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy)
    t = LedgerTables(ingested_ledger(spark, copy), stored.trace_event, stored.provider)
    year = LedgerConfig().detail_year
    others = [d for d in os.listdir(copy) if d.startswith("period_month=") and not d.startswith(f"period_month=m{year}")]
    assert others
    want = canon(LedgerReports(stored).processed.where(F.col("period_month").startswith("m" + year)).select("transaction_id"))
    for d in others:
        for f in os.listdir(f"{copy}/{d}"):
            if f.endswith(".parquet"):
                open(f"{copy}/{d}/{f}", "wb").write(b"broken")
                if os.path.exists(f"{copy}/{d}/.{f}.crc"):
                    os.remove(f"{copy}/{d}/.{f}.crc")
    from ledgerlens.operators.ledger import in_detail_year
    assert canon(in_detail_year(LedgerReports(t).processed).select("transaction_id")) == want


def test_recent_buckets_prune_folders(by_month):
    _, stored, _ = by_month
    _, filters = months_read(LedgerReports(stored).candidates("weekly"))
    assert any("dynamicpruning" in f for f in filters)


def test_odd_periods_by_month(spark, tables, tmp_path):
    costs = [cost(1, 1, ""), cost(2, 1, None, pid=2), cost(3, 1, "2026", pid=3), cost(4, 1, "a/b=c d", pid=4),
             cost(5, 1, period="not json", pid=5), cost(6, 1, "202612Q2", pid=6), cost(7, 1, "202612Q2", pid=7, status="PENDING")]
    plain = tables(costs)
    ingest_ledger(plain.cost_event, str(tmp_path / "odd"))
    ingest_ledger(tables([cost(8, 1, "202612Q1", pid=8)]).cost_event, str(tmp_path / "odd"), mode="append")
    t = LedgerTables(ingested_ledger(spark, str(tmp_path / "odd")), plain.trace_event, plain.provider)
    want = tables([*costs, cost(8, 1, "202612Q1", pid=8)])
    for g in ("weekly", "monthly"):
        assert canon(LedgerReports(t).status_summary(g)) == canon(LedgerReports(want).status_summary(g))
    assert canon(LedgerReports(t).pending_detail()) == canon(LedgerReports(want).pending_detail())
    assert t.cost_event.count() == 8

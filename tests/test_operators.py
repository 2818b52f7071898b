"""Single-operator tests on hand-made edge rows (FIXTURES.md section 3)."""

import json
import re
import subprocess
import sys
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerlens.config import LedgerConfig
from ledgerlens.functions.json import json_array, max_value_for_key, with_json_field
from ledgerlens.operators.latest import trace_latest
from ledgerlens.plans import oracle
from ledgerlens.plans.reports import LedgerReports
from tests.conftest import ROOT, cost, provider, trace

TOP5 = ["202612Q2", "202612Q1", "202611Q2", "202611Q1", "202610Q2"]


def fillers(start=900):
    """One row in each of the five top periods, so other periods fall out."""
    return [cost(start + i, 1, name, pid=start + i, amt="1.00") for i, name in enumerate(TOP5)]


def _key(t):
    return tuple((v is not None, v) for v in t)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=_key)


def summary_for(tables, *costs, traces=(), providers=(provider(1),), slice_name="all", g="weekly"):
    return LedgerReports(tables(list(costs), traces, providers)).status_summary(g, slice_name)


# -- J1 / A1 / F1 / J2 -------------------------------------------------------------

def test_tied_max_versions_both_kept(tables):
    s = summary_for(tables, cost(1, 2, amt="10.00"), cost(1, 2, amt="10.00"), cost(1, 1, amt="99.00"))
    assert rows(s, "pre_invoices", "cost") == [(1, Decimal("20.00"))]


def test_newer_unprocessed_version_does_not_hide_older(tables):
    s = summary_for(tables, cost(1, 2, status="PENDING", amt="50.00"), cost(1, 1, amt="7.00"))
    assert rows(s, "cost") == [(Decimal("7.00"),)]


def test_latest_version_outside_top_buckets_drops_transaction(tables):
    s = summary_for(tables, cost(1, 2, "202001Q1", pid=5, amt="50.00"), cost(1, 1, "202612Q2", pid=5), *fillers())
    assert rows(s, "pre_invoices", "cost") == [(1, Decimal("1.00"))] * 5


def test_null_transaction_never_matches(tables):
    r = LedgerReports(tables([cost(None, 1), cost(2, 1)]))
    assert rows(r.latest_version_rows(), "transaction_id") == [(2,)]


def test_fewer_than_five_periods_all_used(tables):
    r = LedgerReports(tables([cost(1, 1, "202601Q1"), cost(2, 1, "202602Q1")]))
    top = {x[0] for x in rows(r.top("weekly"), "bucket")}
    assert {"202601Q1", "202602Q1"} <= top
    assert rows(r.status_summary("weekly"), "bucket") == [("202601Q1",), ("202602Q1",)]


# -- P1 / P2 / A2 ---------------------------------------------------------------------

def test_json_scalar_edges(spark):
    cases = [('{"name":"a"}', "a"), (' { "name" :\t"a b" }\n', "a b"), ('{"name":{"x":1}}', None), ('{"name":[1]}', None),
             ("not json", None), ('{"name":null}', None), (None, None), ("", None), ('{"name":"{x"}', "{x"), ('{"name":12}', "12"),
             ('{"name":true}', "true"), ('{"name":"a"} trailing', None), ('{"name":"a"},{"name":"b"}', None), ('{"name":"a"', None),
             ('{"name":"a","name":"b"}', "a"), ('{"other":1,"name":"a"}', "a"), ('{"name":"q\\"q"}', 'q"q'), ("{'name':'a'}", None),
             ('{"name":{"x":1},"name":"b"}', None), ('["name"]', None), ('{"name":""}', ""), ('{"name":"a","deep":{"name":"b"}}', "a")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, j string")
    got = with_json_field(df, "j", "name", "v").orderBy("k").collect()
    assert [(r["j"], r["v"]) for r in got] == cases


def element(value):
    return f'{{"key":"external_route_id","value":{value}}}'


PAYLOADS = [  # text, number of elements, greatest route
    (None, None, None), ("", None, None), ("{}", None, None), ('{"payload":[]}', 0, None), ('{"payload":{"a":1}}', None, None), ("bad", None, None),
    ('{"payload":null}', None, None), ('{"payload":"x"}', None, None), ('{"payload":"[1]"}', None, None), ('[{"payload":[1]}]', None, None),
    (f'{{"payload":[7,{element('"R9"')}]}}', 2, "R9"), (f'{{"payload":[{element('"R1"')},{element('"R2"')}]}}', 2, "R2"),
    (f'{{"payload":[{element('{"o":1}')}]}}', 1, None), (f'{{"payload":[{element("[1]")}]}}', 1, None),
    (f'{{"payload":[null,{element("true")},"a",true,[1]]}}', 5, "true"),
    # malformed as a whole
    (f'{{"payload":[{element('"A"')}]}} trailing', None, None), (f'{{"payload":[{element('"A"')}]}}] trailing', None, None),
    (f'{{"payload":[{element('"A"')}]}},{{}}', None, None), (f'{{"payload":[{element('"A"')}]', None, None), ("{'payload':[1]}", None, None),
    # repeated keys: the first, and the other elements stay
    (f'{{"payload":[{{"key":"external_route_id","value":"A","value":"B"}},{element('"0"')}]}}', 2, "A"),
    ('{"payload":[{"key":"external_route_id","key":"z","value":"w"}]}', 1, "w"),
    (f'{{"payload":[{element('"A"')}],"payload":[{element('"B"')},7]}}', 1, "A"), ('{"payload":"x","payload":[1]}', None, None),
    ('{"payload":"[1]","payload":[1]}', None, None), (f'{{"payload":[{{"payload":[1]}},{element('"n"')}]}}', 2, "n"),
    # strings that look like containers
    (f'{{"payload":[{json.dumps(element('"S"'))}]}}', 1, None), (f'{{"payload":[{json.dumps("  " + element('"S"'))}]}}', 1, None),
    (f'{{"payload":[{json.dumps(chr(10) + element('"S"'))}]}}', 1, None), (f'{{"payload":[{element('"{x"')}]}}', 1, "{x"),
    ('{"payload":["\\u007b\\"key\\":\\"external_route_id\\",\\"value\\":\\"S\\"}"]}', 1, None),
    (f'{{"payload":[{element('" [x]"')}]}}', 1, " [x]"), (f'{{"payload":[{element(json.dumps(chr(34) + "{q"))}]}}', 1, '"{q'),
    (f'{{"a":"{{","payload":[{element(json.dumps('{"a":1}'))},"]"]}}', 2, '{"a":1}'),
    # spelling
    (f'{{"payload":[{element("9" * 41)}]}}', 1, "9" * 41), ('{"p\\u0061yload":[1,2]}', 2, None),
    ('{"payload":[{"\\u006bey":"external_route_id","value":"w"}]}', 1, "w"),
    (' {\n "payload" :\t[ {"value" : "v" , "key": "external_route_id"} ] } ', 1, "v"),
]


def test_payload_array_edges(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(PAYLOADS)], "k int, p string")
    arr = json_array("p")
    got = df.orderBy("k").select("p", F.size(arr), max_value_for_key(arr, "external_route_id")).collect()
    assert [tuple(r) for r in got] == PAYLOADS


def test_payload_edges_agree_with_the_oracle():
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INT, payload VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(k, t) for k, (t, _, _) in enumerate(PAYLOADS)])
    elements = oracle.payload_elements("payload")
    got = con.sql(f"SELECT payload, len({elements}), {oracle._best(elements, 'external_route_id')} FROM t ORDER BY k").fetchall()
    assert got == PAYLOADS


def test_empty_payload_still_counts_cost_but_not_assets(tables):
    r = LedgerReports(tables([cost(1, 1, payload='{"payload":[]}', amt="3.00"),
                              cost(2, 1, payload=None, amt="4.00", pid=2)]))
    assert rows(r.status_summary("weekly"), "routes", "pre_invoices", "cost") == [(0, 2, Decimal("7.00"))]
    assert r.asset_counts("weekly").count() == 0


def test_array_without_route_key_gives_bucket_with_zero_routes(tables):
    r = LedgerReports(tables([cost(1, 1, route=None, vehicle="V7")]))
    assert rows(r.asset_counts("weekly"), "bucket", "routes", "vehicles") == [("202612Q2", 0, 1)]


def test_route_is_max_over_tied_rows_of_transaction(tables):
    r = LedgerReports(tables([cost(1, 1, route="R1", pid=1), cost(1, 1, route="R5", pid=2)]))
    assert rows(r.enriched("weekly"), "route") == [("R5",), ("R5",)]


# -- J4 / W1 / P5 -------------------------------------------------------------------------

def test_trace_key_is_compared_as_text(tables):
    s = summary_for(tables, cost(1, 1, pid=7), traces=[trace("007", "accounting_error"), trace("abc", "x")])
    assert rows(s, "status") == [(None,)]


def test_trace_latest_ties_and_null_timestamps(tables):
    r = LedgerReports(tables([cost(1, 1)], traces=[
        trace("1", "old", "2026-01-01 00:00:00", seq=1), trace("1", "tie_low", "2026-02-01 00:00:00", seq=2),
        trace("1", "tie_high", "2026-02-01 00:00:00", seq=3), trace("1", "no_time", None, seq=9),
        trace("2", None, "2026-03-01 00:00:00", seq=1), trace("2", "earlier", "2026-01-01 00:00:00", seq=5)]))
    assert rows(r.trace_status, "preinvoice_id", "status") == [("1", "tie_high"), ("2", None)]


def test_payment_status_rules(tables):
    provs = [provider(1, "TAC-CPF"), provider(2, "TAC-CNPJ")]
    s = summary_for(tables,
                    cost(1, 1, pid=10, prov=1), cost(2, 1, pid=11, prov=1), cost(3, 1, pid=12, prov=1),
                    cost(4, 1, pid=13, prov=2), cost(5, 1, pid=14, prov=2),
                    traces=[trace("11", None), trace("12", "accounting_error"), trace("13", "sap_status_pagado")],
                    providers=provs)
    assert rows(s, "status", "pre_invoices") == sorted(
        [(None, 1), ("nao_emite_nfs", 2), ("accounting_error", 1), ("sap_status_pago_realizado", 1)], key=_key)


def test_rejected_provider_types_drop(tables):
    provs = [provider(1, "OTHER"), provider(2, None), provider(3, "MEI")]
    s = summary_for(tables, cost(1, 1, prov=1), cost(2, 1, prov=2), cost(3, 1, prov=3, pid=3), providers=provs)
    assert rows(s, "pre_invoices") == [(1,)]


def test_equal_times_have_one_winner_in_any_order(tables):
    # real logs have no seq: it reads as NULL
    log = [trace("1", f"s{k}", "2026-02-01 00:00:00", seq=None, invoice_id=100 + k % 3, doc=f"D{k}") for k in range(7)]
    log += [trace("1", None, "2026-02-01 00:00:00", seq=None, invoice_id=102, doc="D9")]
    found = set()
    for shift in range(len(log)):
        r = LedgerReports(tables([cost(1, 1)], traces=log[shift:] + log[:shift]))
        found.update(rows(r.trace_detail.coalesce(1), "status", "invoice_id", "file_accounting_document"))
    assert found == {("s5", 102, "D5")}


def test_one_payload_parse_in_the_plan(tables):
    r = LedgerReports(tables([cost(1, 1)]))
    for df in (r.status_summary("weekly"), r.asset_counts("weekly"), r.payload_route(), r.enriched("monthly")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(ArrayType(StructType(StructField(payload") == 1


def test_latest_status_reads_no_more_than_its_order_needs(spark, tables, tmp_path):
    tables([], traces=[trace("1", "a")]).trace_event.write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = trace_latest(log)._jdf.queryExecution().executedPlan().toString()
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert sorted(c.split(":")[0] for c in schema.split(",")) == ["invoice_id", "last_update", "preinvoice_id", "seq", "status"]


def test_both_forms_of_the_latest_row_agree_on_ties(spark, tables):
    """Equal times and sequences: one winner, of which both forms tell the status."""
    log = [trace("1", s, seq=7, invoice_id=i, doc=f"D{i}") for s, i in (("b", 1), ("a", 9), ("b", 2), (None, 10))]
    log += [trace("2", "x", ts=None, seq=9), trace("2", "y", seq=1)]
    for shift in range(len(log)):
        r = LedgerReports(tables([cost(1, 1)], traces=log[shift:] + log[:shift]))
        assert rows(r.trace_status, "preinvoice_id", "status") == [("1", None), ("2", "y")]
        assert rows(r.trace_detail, "preinvoice_id", "status", "invoice_id") == [("1", None, 10), ("2", "y", 100)]


def test_nothing_runs_while_plans_are_built(spark, tables):
    r = LedgerReports(tables([cost(1, 1)]))
    spark.sparkContext.setJobGroup("building", "no job may run")
    for df in (r.matrix("share", "weekly"), r.matrix_wide("count", "monthly", "regular"), r.matrix_display("weekly"), r.slice_status(),
               r.report_row_counts(), r.asset_row("routes", "weekly"), r.pending_by_provider()):
        df.explain(mode="simple")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("", "")


# -- F3 / A10 / V3-V5 / V7 ----------------------------------------------------------------------

def test_unsliced_includes_null_and_third_types(tables):
    costs = [cost(1, 1, ptype=None, pid=1), cost(2, 1, ptype="spot", pid=2), cost(3, 1, ptype="regular", pid=3)]
    r = LedgerReports(tables(costs))
    assert r.status_summary("weekly", "all").count() == 3
    assert rows(r.status_summary("weekly", "regular"), "pre_invoice_type") == [("regular",)]
    assert r.status_summary("weekly", "complementary").count() == 0


def test_distinct_counts_add_across_types_in_matrix(tables):
    r = LedgerReports(tables([cost(1, 1, ptype="regular", pid=5), cost(2, 1, ptype="complementary", pid=5)]))
    m = r.matrix("count", "weekly", "all")
    assert rows(m.where("status = 'NULL'"), "value") == [(2,)]
    assert rows(m.where("status = 'TOTAL'"), "value") == [(2,)]


def test_hidden_status_in_total_and_share_denominator(tables):
    r = LedgerReports(tables([cost(1, 1, pid=1), cost(2, 1, pid=2), cost(3, 1, pid=3), cost(4, 1, pid=4)],
                             traces=[trace("1", "unlisted_status")]))
    counts = {s: v for s, v in rows(r.matrix("count", "weekly"), "status", "value")}
    assert "unlisted_status" not in counts
    assert counts["NULL"] == 3 and counts["TOTAL"] == 4
    shares = {s: v for s, v in rows(r.matrix("share", "weekly"), "status", "value")}
    assert shares["NULL"] == 75.0 and shares["TOTAL"] == 100.0
    assert shares["sap_status_pago_realizado"] == 0.0
    assert len(counts) == 8  # seven display statuses + TOTAL, zero-filled


def test_zero_total_bucket_shares(tables):
    r = LedgerReports(tables([cost(1, 1, pid=None)]))
    shares = {s: v for s, v in rows(r.matrix("share", "weekly"), "status", "value")}
    assert shares["TOTAL"] == 100.0 and shares["NULL"] == 0.0


def test_empty_slice_flagged(tables):
    r = LedgerReports(tables([cost(1, 1, ptype="regular")]))
    assert rows(r.slice_status(), "slice", "has_data") == [("all", True), ("complementary", False),
                                                            ("regular", True)]


def test_matrix_wide_slots_oldest_first(tables):
    r = LedgerReports(tables([cost(1, 1, "202611Q1", pid=1), cost(2, 1, "202612Q2", pid=2),
                              cost(3, 1, "202612Q2", pid=3)]))
    w = {x["status"]: x for x in r.matrix_wide("count", "weekly").collect()}
    assert (w["TOTAL"]["p1"], w["TOTAL"]["p2"], w["TOTAL"]["p3"]) == (1, 2, None)


# -- F4 / F5 / F6 / A6-A13 / J7 / P9 / P11 ------------------------------------------------------

def _pending(tables, names, **kw):
    costs = [cost(i, 1, n, pid=i, amt="10.00") for i, n in enumerate(names)]
    return LedgerReports(tables(costs, **kw))


def test_excluded_periods_need_at_least_two(tables):
    assert _pending(tables, []).ranking_excluded_periods().count() == 0
    assert _pending(tables, ["202601Q1"]).ranking_excluded_periods().count() == 0
    r2 = _pending(tables, ["202601Q1", "202601Q2"])
    assert rows(r2.ranking_excluded_periods(), "period") == [("202601Q1",), ("202601Q2",)]
    assert r2.provider_ranking().count() == 0
    r3 = _pending(tables, ["202601Q1", "202601Q2", "202602Q1"])
    assert rows(r3.ranking_excluded_periods(), "period") == [("202601Q2",), ("202602Q1",)]
    assert rows(r3.provider_ranking(), "cost", "cost_share") == [(Decimal("10.00"), 1.0)]


def test_pending_predicate_and_year(tables):
    provs = [provider(1, "TAC-CNPJ"), provider(2, "TAC-CPF")]
    costs = [cost(1, 1, "202601Q1", pid=1, prov=1), cost(2, 1, "202601Q1", pid=2, prov=2),
             cost(3, 1, "202601Q1", pid=3, prov=1), cost(4, 1, "202501Q1", pid=4, prov=1),
             cost(5, 1, "202601Q1", pid=5, prov=2)]
    r = LedgerReports(tables(costs, [trace("3", "sap_status_pagado"), trace("5", "accounting_error")], provs))
    assert rows(r.pending_detail(), "pre_invoice_id", "status_group", "status") == [
        (1, "NULL", None), (5, "Outros", "accounting_error")]
    assert rows(r.pending_summary(), "rows", "pre_invoices", "providers") == [(2, 2, 2)]


def test_detail_year_is_a_parameter(tables):
    r = LedgerReports(tables([cost(1, 1, "202501Q1"), cost(2, 1, "202601Q1", pid=2)]),
                      LedgerConfig(detail_year="2025"))
    assert rows(r.pending_detail(), "period") == [("202501Q1",)]


def test_duplicate_provider_id_multiplies_and_fans_out(tables):
    provs = [provider(1, "TAC-CNPJ", "A"), provider(1, "MEI", "B")]
    costs = [cost(1, 1, "202601Q1", pid=1, amt="10.00"), cost(2, 1, "202601Q2", pid=2, amt="1.00"),
             cost(3, 1, "202602Q1", pid=3, amt="1.00"), cost(4, 1, "202602Q2", pid=4, amt="1.00")]
    r = LedgerReports(tables(costs, [], provs))
    assert rows(r.status_summary("weekly"), "cost") == [(Decimal("2.00"),), (Decimal("2.00"),),
                                                       (Decimal("2.00"),), (Decimal("20.00"),)]
    ranking = r.provider_ranking()
    # totals per (id, name, type) = 2 rows; the NULL-group merge on id alone doubles them.
    assert ranking.count() == 4
    assert rows(ranking, "provider_name", "cost_null") == [("A", Decimal("11.00")), ("A", Decimal("11.00")),
                                                          ("B", Decimal("11.00")), ("B", Decimal("11.00"))]


def test_null_costs_stay_null_in_sql_sums_zero_in_rollups(tables):
    costs = [cost(1, 1, "202601Q1", amt=None), cost(2, 1, "202601Q2", amt=None, pid=2),
             cost(3, 1, "202602Q1", amt=None, pid=3)]
    r = LedgerReports(tables(costs))
    assert {x[0] for x in rows(r.status_summary("weekly"), "cost")} == {None}
    assert {x[0] for x in rows(r.pending_detail(), "cost")} == {None}
    assert {x[0] for x in rows(r.matrix("cost", "weekly"), "value")} == {Decimal("0.00")}
    assert rows(r.pending_by_provider(), "cost")[0] == (Decimal("0.00"),)
    assert rows(r.provider_ranking(), "cost", "cost_share") == [(Decimal("0.00"), 0.0)]


def test_non_positive_grand_total_gives_zero_share(tables):
    costs = [cost(1, 1, "202601Q1", amt="-5.00"), cost(2, 1, "202601Q2", pid=2), cost(3, 1, "202602Q1", pid=3)]
    r = LedgerReports(tables(costs))
    assert rows(r.provider_ranking(), "cost", "cost_share") == [(Decimal("-5.00"), 0.0)]
    assert rows(r.provider_ranking_total(), "cost", "cost_share") == [(Decimal("-5.00"), 1.0)]


# -- V8 / P14 / P15 / A14 / T6 ---------------------------------------------------------------

def test_asset_rows_and_text(tables):
    costs = [cost(k, 1, "202611Q1", pid=k, route=f"R{k}", vehicle=None) for k in range(1100)]
    r = LedgerReports(tables([*costs, cost(5000, 1, "202612Q2", pid=7, route="R1", vehicle="V1")]))
    assert [tuple(x) for x in r.asset_row("routes", "weekly").collect()] == [("Rotas distintas", 1100, 1, None, None, None)]
    assert [tuple(x) for x in r.asset_row("vehicles", "weekly").collect()] == [("Veiculos distintos", 0, 1, None, None, None)]
    assert rows(r.asset_display("weekly"), "metric", "bucket", "text") == [
        ("Rotas distintas", "202611Q1", "1.100"), ("Rotas distintas", "202612Q2", "1"),
        ("Veiculos distintos", "202611Q1", "0"), ("Veiculos distintos", "202612Q2", "1")]
    assert r.asset_row("routes", "weekly", "complementary").count() == 0


def test_share_fractions(tables):
    r = LedgerReports(tables([cost(1, 1, pid=1), cost(2, 1, pid=2), cost(3, 1, pid=3)], traces=[trace("1", "sap_status_pagado")]))
    assert {s: round(v, 9) for s, v in rows(r.share_fractions("weekly"), "status", "value") if v} == {
        "sap_status_pago_realizado": 0.333, "NULL": 0.667, "TOTAL": 1.0}


def test_row_counts_name_empty_results(tables):
    r = LedgerReports(tables([cost(1, 1, pid=1), cost(2, 1, "202611Q1", pid=2, payload=None)]))
    got = {x[:3]: x[3] for x in rows(r.report_row_counts(), "slice", "report", "granularity", "rows")}
    assert len(got) == 12
    assert got["regular", "status_summary", "weekly"] == 2 and got["regular", "asset_counts", "weekly"] == 1
    assert got["complementary", "status_summary", "monthly"] == 0 and got["all", "asset_counts", "monthly"] == 1


def test_positions_follow_the_report_order(tables):
    provs = [provider(k) for k in range(1, 40)]
    costs = [cost(100 * p + k, 1, name, pid=100 * p + k, prov=p, amt=f"{p % 7}.00")
             for p in range(1, 40) for k, name in enumerate(("202601Q1", "202601Q2", "202602Q1"))]
    r = LedgerReports(tables(costs, (), provs))
    got = sorted((x["position"], -x["cost"], x["provider_id"]) for x in r.provider_ranking_positions().collect())
    assert [x[0] for x in got] == list(range(1, 40)) and [x[1:] for x in got] == sorted(x[1:] for x in got)
    r.release()
    assert r._folders == []


# -- hot keys --------------------------------------------------------------------------------

def test_hot_transaction_and_pre_invoice_are_split(spark, tables, tmp_path):
    """90 % of the ledger on one transaction and one pre-invoice, most of it
    older versions and copies: right results, and no shuffle hands one task
    more than a fair share of the rows. Measured from the tasks' own counts."""
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "false"
    n = 20_000
    ledger = spark.range(n, numPartitions=8).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 7L ELSE 1000 + id END AS transaction_id", "id AS version_id", "'PROCESSED' AS event_status",
        "'{\"name\":\"202612Q2\"}' AS period", "CAST(1 AS DECIMAL(18,2)) AS cost_amt", "'regular' AS pre_invoice_type",
        "CASE WHEN id % 10 < 9 THEN 1L ELSE id END AS pre_invoice_id", "1L AS provider_id", "CAST(NULL AS STRING) AS payload")
    ledger.write.parquet(str(tmp_path / "ledger"))
    t = tables([], [trace("1", "accounting_error")])
    r = LedgerReports(type(t)(spark.read.parquet(str(tmp_path / "ledger")), t.trace_event, t.provider))
    got = {x["status"]: (x["pre_invoices"], x["cost"]) for x in r.status_summary("weekly").collect()}
    assert got == {"accounting_error": (1, Decimal("1.00")), None: (2000, Decimal("2000.00"))}
    # the same chain up to J1, by the partition its rows land in
    from ledgerlens.operators.latest import collapse
    from ledgerlens.operators.payload import with_payload_values
    from ledgerlens.operators.summary import COLLAPSE_KEYS
    spread = (collapse(with_payload_values(r.candidates("weekly")), *COLLAPSE_KEYS)
              .repartition(8, "transaction_id", "version_id").groupBy(F.spark_partition_id()).count().collect())
    assert len(spread) == 8 and max(x[1] for x in spread) <= 2 * n / 8


def test_no_expand_under_distinct_counts(tables):
    r = LedgerReports(tables([cost(1, 1)]))
    for df in (r.status_summary("weekly"), r.asset_counts("weekly"), r.asset_counts_all_slices("monthly")):
        assert "Expand" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_route_is_of_the_transaction_in_every_group(tables):
    """A transaction's greatest route counts in each (bucket, type, status) that it occurs in."""
    s = summary_for(tables, cost(1, 1, ptype="regular", pid=1, route="R1"), cost(1, 1, ptype="complementary", pid=2, route="R9"),
                    cost(2, 1, ptype="regular", pid=3, route="R9"), cost(3, 1, ptype="regular", pid=None, route=None, amt=None),
                    cost(3, 1, ptype="other", pid=None, payload=None, amt=None))
    assert rows(s, "pre_invoice_type", "routes", "pre_invoices", "cost") == [
        ("complementary", 1, 1, Decimal("10.00")), ("other", 0, 0, None), ("regular", 1, 2, Decimal("20.00"))]


HOT_REPORT = """
import json, sys
from ledgerlens.session import local_session
from ledgerlens.plans.reports import LedgerReports
from ledgerlens.plans.suite import ReportSuite
from ledgerlens.sources.tables import read_ledger_tables
folder, suite = sys.argv[1], sys.argv[2] == "suite"
small = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
         "spark.sql.autoBroadcastJoinThreshold": "3k", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.eventLog.enabled": "true", "spark.eventLog.dir": folder + "/log", "spark.eventLog.compress": "false",
         "spark.eventLog.rolling.enabled": "false"}
spark = local_session(4, 8, extra=small, driver_memory="2g")
tables = read_ledger_tables(spark, *(folder + "/" + n for n in ("ledger", "trace", "provider")))
r = ReportSuite(tables, storage=folder + "/scratch") if suite else LedgerReports(tables)
print(json.dumps(sorted([[x["status"], x["routes"], x["pre_invoices"], str(x["cost"])] for x in r.status_summary("weekly").collect()], key=str)))
spark.stop()
"""


@pytest.mark.parametrize("kind", ["report", "suite"])
def test_hot_version_of_distinct_pre_invoices_is_split(spark, tables, tmp_path, kind):
    """90 % of the ledger on one transaction at one version, each row another
    pre-invoice, so that nothing collapses. The whole report runs in a session
    whose thresholds for splitting are scaled down like the table; no task of it
    may read twice a fair share of the rows from the shuffle."""
    n = 40_000
    spark.range(n, numPartitions=8).selectExpr(
        "CASE WHEN id % 10 < 9 THEN 7L ELSE 1000 + id END AS transaction_id", "1L AS version_id", "'PROCESSED' AS event_status",
        "'{\"name\":\"202612Q2\"}' AS period", "CAST(1 AS DECIMAL(18,2)) AS cost_amt", "'regular' AS pre_invoice_type",
        "id AS pre_invoice_id", "1L AS provider_id",
        "CASE WHEN id % 1000 = 5 THEN '{\"payload\":[{\"key\":\"external_route_id\",\"value\":\"R' || id || '\"}]}' END AS payload"
    ).write.parquet(str(tmp_path / "ledger"))
    t = tables([], [trace("5", "accounting_error"), *(trace(f"x{k}", "other", doc=f"D{k}") for k in range(2000))])
    t.trace_event.write.parquet(str(tmp_path / "trace"))  # too large for the broadcast threshold, as is the ledger
    t.provider.coalesce(1).write.parquet(str(tmp_path / "provider"))
    (tmp_path / "log").mkdir()
    done = subprocess.run([sys.executable, "-c", HOT_REPORT, str(tmp_path), kind], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1]) == [["accounting_error", 1, 1, "1.00"], [None, 1, 39999, "39999.00"]]
    read = [e["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
            for f in (tmp_path / "log").iterdir() for e in map(json.loads, f.open()) if e["Event"] == "SparkListenerTaskEnd"]
    assert max(read) <= 2 * n / 8, sorted(read)[-5:]


def test_plain_payloads_read_like_parsed_ones(spark):
    """Texts of the usual shape are read without the JSON parser, to the same values."""
    from ledgerlens.functions.json import plain_pairs
    from ledgerlens.operators.payload import with_payload_values

    route, vehicle = '{"key":"external_route_id","value":"%s"}', '{"key":"vehicle_id","value":"%s"}'
    plain = ['{"payload":[]}', ' { "payload" : [ ] } ', '{"payload":[%s]}' % (route % "R1"), '{"payload":[%s,%s]}' % (route % "R9", route % "R10"),
             '{"payload":[%s, %s]}' % (vehicle % "V", route % "R"), '{"payload":[{ "key" : "vehicle_id" ,\t"value" : "{[" }]}',
             '{"payload":[%s,%s]}' % (route % "[1]", vehicle % ""), '{"payload":[{"key":"payload","value":"payload"},%s]}' % (route % "é, {"),
             '{"payload":[%s]}' % ",".join([vehicle % "V", route % "R"] * 5_000)]
    other = [None, "", "{}", "[]", "not json", '{"payload":[]} x', '{"payload":[%s],"payload":[]}' % (route % "R"), '{"payload":[7,%s]}' % (route % "R"),
             '{"payload":[%s,]}' % (route % "R"), '{"payload":[{"key":"vehicle_id","value":7}]}', '{"payload":[{"key":"vehicle_id","value":"a","value":"b"}]}',
             '{"payload":[{"value":"a","key":"vehicle_id"}]}', '{"payload":[%s]}' % (route % '\\"'), '{"payload":[%s]}' % (route % "a\tb"),
             '{"payload":[{"key":"vehicle\\u005fid","value":"v"}]}', '{"payload":[{"key":"vehicle_id","value":"\\u005b"}]}',
             '{"payload":"%s"}' % "x", '{"x":1,"payload":[%s]}' % (route % "R"), '{"payload":[%s}' % (route % "R"), '{"payload":null}']
    df = spark.createDataFrame(list(enumerate(plain + other)), "k int, payload string")
    assert [p for _, p in df.select("k", plain_pairs(F.col("payload"))).orderBy("k").collect()] == [True] * len(plain) + [False] * len(other)
    array = json_array("payload")
    want = df.select("k", max_value_for_key(array, "external_route_id"), max_value_for_key(array, "vehicle_id"),
                     F.coalesce(F.size(array), F.lit(-1))).orderBy("k").collect()
    got = with_payload_values(df).select("k", "row_route", "row_vehicle", "payload_elements").orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    skipped = with_payload_values(df, F.col("k") < 0).select("row_route", "row_vehicle", "payload_elements").distinct().collect()
    assert [tuple(r) for r in skipped] == [(None, None, -1)]


def test_compact_period_reads_like_parsed_one(spark):
    texts = {'{"name":"202601Q1"}': "202601Q1", '{"name":""}': "", '{"name":"}': None, '{"name":"a"b"}': None, '{"name":"a","name":"b"}': "a",
             '{"name":"{x"}': "{x", '{"name":"a\\tb"}': "a\tb", '{"name":"a\tb"}': None, '{"name":"é"}': "é", '{ "name":"a"}': "a", '{"name":"a"} ': "a",
             '{"name":"a"}"}': None, '{"name":"\\u007bx"}': "{x", '{"name":"}"}': "}"}
    df = with_json_field(spark.createDataFrame(list(enumerate(texts)), "k int, period string"), "period", "name", "name")
    assert [r.name for r in df.orderBy("k").collect()] == list(texts.values())


def test_pending_detail_is_no_sort_aggregate(spark):
    """Trace values are keys: maxima of strings would sort every pending row."""
    from ledgerlens.operators.pending import pending_detail

    rows = spark.createDataFrame([], "period string, month string, pre_invoice_type string, pre_invoice_id bigint, provider_id bigint, "
                                 "provider_name string, provider_type string, status_group string, status string, cost_amt decimal(28,2), "
                                 "transaction_id bigint, invoice_id bigint, file_status string, file_accounting_document string, "
                                 "invoice_amount decimal(18,2), last_update timestamp_ntz")
    plan = pending_detail(rows)._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan

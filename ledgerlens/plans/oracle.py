"""DuckDB SQL for every query key.

Built from the rules in SURVEY section 2, one relation per rule: the newest
version by QUALIFY, the winning log row as a struct picked by ``max_by``, the
payload with list functions, both granularities and all slices in one relation
that each query filters. DuckDB has the driver's tables registered as views;
the stand-in ledger is derived with the same rules as
``ledgerlens.sources.standin``.

DuckDB specifics: its JSON string extract returns text for objects, so the type
is checked with ``json_type``; sums are cast to the Spark result types.
"""

from __future__ import annotations

from ledgerlens.config import (ACCEPTED_PROVIDER_TYPES, ALL_SLICE, ASSET_LABELS, OTHERS_STATUSES, ROUTE_KEY, SLICES,
                               STATUS_DISPLAY_ORDER, VEHICLE_KEY, WEEKLY)
from ledgerlens.sources.standin import PROVIDER_TYPE_BY_NATION_MOD5, TRACE_STATUS_BY_CODE

N_BUCKETS = 5
DETAIL_YEAR = "2026"
DROPPED_PERIODS = 2


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _in_list(values) -> str:
    return ", ".join(_q(v) for v in values)


def _case(expr: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def _scalar(json_expr: str, path: str) -> str:
    j = f"try_cast({json_expr} AS JSON)"
    return (f"CASE WHEN json_type({j}, '{path}') IN ('OBJECT', 'ARRAY') THEN NULL "
            f"ELSE json_extract_string({j}, '{path}') END")


def payload_elements(text: str) -> str:
    """The elements of the payload array of a JSON text; NULL where there is none."""
    j = f"try_cast({text} AS JSON)"
    return f"CASE WHEN json_type({j}, '$.payload') = 'ARRAY' THEN json_extract({j}, '$.payload[*]') END"


def _best(elements: str, key: str) -> str:
    """The greatest scalar value that ``key`` has among payload elements."""
    wanted = f"list_filter({elements}, lambda e: json_extract_string(e, '$.key') = {_q(key)} AND json_type(e, '$.value') NOT IN ('OBJECT', 'ARRAY'))"
    return f"list_max(list_transform({wanted}, lambda e: json_extract_string(e, '$.value')))"


def _sliced(relation: str) -> str:
    return (f"SELECT *, unnest(list_filter(['all', pre_invoice_type], lambda s: list_contains([{_in_list(SLICES)}], s))) AS slice "
            f"FROM {relation}")


def _display_lines() -> str:
    return ", ".join(f"({i + 1}, {_q(s)})" for i, s in enumerate(STATUS_DISPLAY_ORDER))


_PERIOD = ("CAST(2025 + year(l.l_shipdate) % 2 AS VARCHAR) || lpad(CAST(month(l.l_shipdate) AS VARCHAR), 2, '0') "
           "|| CASE WHEN day(l.l_shipdate) <= 15 THEN 'Q1' ELSE 'Q2' END")

STANDIN = f"""
cost_event AS (
  SELECT
    CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS transaction_id,
    CAST(year(l.l_shipdate) AS BIGINT) AS version_id,
    CASE WHEN l.l_returnflag = 'R' AND l.l_linestatus = 'O' THEN 'PENDING' ELSE 'PROCESSED' END AS event_status,
    CASE l.l_orderkey % 97
      WHEN 0 THEN '{{"name":null}}'
      WHEN 1 THEN 'not json'
      WHEN 2 THEN '{{"name":{{"x":1}}}}'
      WHEN 3 THEN '{{"name":"' || {_PERIOD} || '"}} trailing'
      WHEN 4 THEN '{{"name":"' || {_PERIOD} || '","name":"other"}}'
      ELSE '{{"name":"' || {_PERIOD} || '"}}'
    END AS period,
    CAST(l.l_extendedprice AS DECIMAL(18,2)) AS cost_amt,
    CASE WHEN o.o_orderpriority = '5-LOW' THEN 'complementary'
         WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND l.l_linenumber = 1 THEN NULL
         ELSE 'regular' END AS pre_invoice_type,
    CAST(l.l_suppkey * 100 + month(l.l_shipdate) AS BIGINT) AS pre_invoice_id,
    CAST(l.l_suppkey AS BIGINT) AS provider_id,
    CASE l.l_partkey % 11
      WHEN 0 THEN '{{"payload":[]}}'
      WHEN 1 THEN '{{}}'
      WHEN 2 THEN '{{"payload":[{{"key":"vehicle_id","value":"V' || CAST(l.l_partkey % 37 AS VARCHAR) || '"}}]}}'
      WHEN 3 THEN '{{"payload":[7,{{"key":"external_route_id","value":' || CAST(l.l_partkey % 50 AS VARCHAR) || '}}]}}'
      WHEN 4 THEN '{{"payload":[{{"key":"external_route_id","value":"R' || CAST(l.l_partkey % 500 AS VARCHAR) || '"}}]}} trailing'
      WHEN 5 THEN '{{"payload":[{{"key":"external_route_id","value":"R' || CAST(l.l_partkey % 500 AS VARCHAR)
           || '","value":"Z"}},{{"key":"vehicle_id","value":"V' || CAST(l.l_partkey % 37 AS VARCHAR) || '"}}]}}'
      WHEN 6 THEN '{{"payload":["{{\\"key\\":\\"vehicle_id\\",\\"value\\":\\"Z\\"}}",{{"key":"external_route_id","value":"R'
           || CAST(l.l_partkey % 500 AS VARCHAR) || '"}}],"payload":[{{"key":"vehicle_id","value":"V' || CAST(l.l_partkey % 37 AS VARCHAR) || '"}}]}}'
      ELSE '{{"payload":[{{"key":"external_route_id","value":"R' || CAST(l.l_partkey % 500 AS VARCHAR)
           || '"}},{{"key":"vehicle_id","value":"V' || CAST(l.l_partkey % 37 AS VARCHAR) || '"}}]}}'
    END AS payload
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
trace_event AS (
  SELECT
    CAST(user_id * 100 + event_id % 12 + 1 AS VARCHAR) AS preinvoice_id,
    {_case("CAST(floor(event_id / 12) AS BIGINT) % 14", TRACE_STATUS_BY_CODE)} AS status,
    ts AS last_update,
    CAST(event_id AS BIGINT) AS invoice_id,
    event_type AS file_status,
    'DOC' || CAST(event_id AS VARCHAR) AS file_accounting_document,
    CAST(value AS DECIMAL(18,2)) AS invoice_amount,
    CAST(event_id AS BIGINT) AS seq
  FROM events
  WHERE (user_id + event_id % 12) % 6 <> 0
),
provider AS (
  SELECT CAST(s_suppkey AS BIGINT) AS id, s_name AS name,
         {_case("s_nationkey % 5", PROVIDER_TYPE_BY_NATION_MOD5)} AS type
  FROM supplier
)"""

ACCEPTED = _in_list(ACCEPTED_PROVIDER_TYPES)
OTHERS = _in_list(OTHERS_STATUSES)

#: One relation per rule, each built from those above it; a query names the
#: last one it needs and gets exactly the chain below that.
_RELATIONS: dict[str, str] = {
    # every processed event: its period name, and its payload as a list of elements
    "events": f"""
SELECT * EXCLUDE (period, payload, event_status), {_scalar("period", "$.name")} AS period_name,
       {payload_elements("payload")} AS elements
FROM cost_event WHERE event_status = 'PROCESSED'""",
    "newest": """
SELECT * FROM events WHERE transaction_id IS NOT NULL
QUALIFY version_id = max(version_id) OVER (PARTITION BY transaction_id)""",
    # the winning log row of a pre-invoice, as one struct
    "last_seen": """
SELECT preinvoice_id, max_by(e, {'at': coalesce(e.last_update, TIMESTAMP '0001-01-01'), 'seq': e.seq}) AS seen
FROM trace_event AS e GROUP BY preinvoice_id""",
    "recent": f"""
SELECT g.granularity, unnest(list_reverse_sort(list_distinct(list(
         CASE g.granularity WHEN 'weekly' THEN period_name ELSE left(period_name, 6) END)))[1:{N_BUCKETS}]) AS bucket
FROM events, (VALUES ('weekly'), ('monthly')) AS g(granularity) GROUP BY g.granularity""",
    # newest events once for every recent bucket they fall into, with their provider
    "placed": f"""
SELECT r.granularity, r.bucket, n.*, v.type AS provider_type,
       {_best("n.elements", ROUTE_KEY)} AS own_route, {_best("n.elements", VEHICLE_KEY)} AS own_vehicle
FROM recent AS r
JOIN newest AS n ON r.bucket = CASE r.granularity WHEN 'weekly' THEN n.period_name ELSE left(n.period_name, 6) END
JOIN provider AS v ON v.id = n.provider_id AND list_contains([{ACCEPTED}], v.type)""",
    "routed": """
SELECT p.*, max(own_route) OVER (PARTITION BY granularity, transaction_id) AS route, w.seen.status AS raw_status,
       CASE w.seen.status WHEN 'sap_status_pagado' THEN 'sap_status_pago_realizado'
            ELSE coalesce(w.seen.status, CASE WHEN provider_type = 'TAC-CPF' THEN 'nao_emite_nfs' END) END AS status
FROM placed AS p LEFT JOIN last_seen AS w ON w.preinvoice_id = p.pre_invoice_id::VARCHAR""",
    "assets": """
SELECT granularity, bucket, transaction_id, pre_invoice_type, max(own_route) AS route, max(own_vehicle) AS vehicle
FROM placed GROUP BY ALL HAVING max(len(elements)) > 0""",
    "routed_sliced": _sliced("routed"),
    "assets_sliced": _sliced("assets"),
    "asset_totals": """
SELECT granularity, slice, bucket, count(DISTINCT route) AS routes, count(DISTINCT vehicle) AS vehicles
FROM assets_sliced GROUP BY granularity, slice, bucket""",
    "summary": """
SELECT granularity, slice, bucket, pre_invoice_type, status, count(DISTINCT route) AS routes,
       count(DISTINCT pre_invoice_id) AS pre_invoices, sum(cost_amt)::DECIMAL(28,2) AS cost
FROM routed_sliced GROUP BY ALL""",
    "labelled": f"""
SELECT *, CASE WHEN list_contains([{OTHERS}], status) THEN 'Outros' ELSE coalesce(status, 'NULL') END AS label FROM summary""",
    # every display line of every bucket; TOTAL takes all labels
    "cells": f"""
SELECT granularity, slice, bucket, d.status_ord, d.status,
       coalesce(sum(pre_invoices) FILTER (label = d.status OR d.status = 'TOTAL'), 0)::BIGINT AS n,
       coalesce(sum(cost) FILTER (label = d.status OR d.status = 'TOTAL'), 0)::DECIMAL(28,2) AS money
FROM labelled, (VALUES {_display_lines()}) AS d(status_ord, status) GROUP BY ALL""",
    "matrix": """
SELECT *, CASE status WHEN 'TOTAL' THEN 100.0::DOUBLE ELSE coalesce(round_even(
         n::DOUBLE / nullif(max(n) FILTER (status = 'TOTAL') OVER (PARTITION BY granularity, slice, bucket), 0)::DOUBLE
         * 100.0::DOUBLE * 10.0::DOUBLE, 0) / 10.0::DOUBLE, 0.0::DOUBLE) END AS share,
       dense_rank() OVER (PARTITION BY granularity, slice ORDER BY bucket) AS slot
FROM cells""",
    "open_items": f"""
SELECT n.*, v.name AS provider_name, v.type AS provider_type, w.seen
FROM newest AS n JOIN provider AS v ON v.id = n.provider_id AND list_contains([{ACCEPTED}], v.type)
LEFT JOIN last_seen AS w ON w.preinvoice_id = n.pre_invoice_id::VARCHAR
WHERE starts_with(n.period_name, '{DETAIL_YEAR}')
  AND CASE WHEN w.seen.status IS NULL THEN v.type <> 'TAC-CPF' ELSE list_contains([{OTHERS}], w.seen.status) END""",
    "detail": """
SELECT period_name AS period, left(period_name, 6) AS month, pre_invoice_type, pre_invoice_id, provider_id, provider_name,
       provider_type, if(seen.status IS NULL, 'NULL', 'Outros') AS status_group, seen.status AS status,
       sum(cost_amt)::DECIMAL(28,2) AS cost, count(DISTINCT transaction_id) AS transactions,
       any_value(seen.invoice_id)::VARCHAR AS invoice_id, any_value(seen.file_status) AS file_status,
       any_value(seen.file_accounting_document) AS accounting_document, any_value(seen.invoice_amount) AS invoice_amount,
       any_value(seen.last_update) AS last_update
FROM open_items GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""",
    "dropped": f"""
SELECT unnest(CASE WHEN len(p) >= {DROPPED_PERIODS} THEN list_reverse_sort(p)[1:{DROPPED_PERIODS}] END) AS period
FROM (SELECT list(DISTINCT period) FILTER (period IS NOT NULL) AS p FROM detail)""",
    "by_provider": """
SELECT provider_id, provider_name, provider_type,
       bool_or(status_group = 'NULL') AS any_null, bool_or(status_group = 'Outros') AS any_others,
       count(DISTINCT pre_invoice_id) FILTER (status_group = 'NULL') AS n_null,
       count(DISTINCT pre_invoice_id) FILTER (status_group = 'Outros') AS n_others,
       coalesce(sum(cost) FILTER (status_group = 'NULL'), 0) AS c_null,
       coalesce(sum(cost) FILTER (status_group = 'Outros'), 0) AS c_others,
       count(DISTINCT pre_invoice_id) AS n, coalesce(sum(cost), 0) AS c, coalesce(sum(transactions), 0) AS t
FROM detail ANTI JOIN dropped USING (period) GROUP BY ALL""",
    "ranking": """
SELECT a.provider_id, a.provider_name, a.provider_type,
       coalesce(x.n_null, 0)::BIGINT AS pre_invoices_null, coalesce(x.c_null, 0)::DECIMAL(28,2) AS cost_null,
       coalesce(y.n_others, 0)::BIGINT AS pre_invoices_others, coalesce(y.c_others, 0)::DECIMAL(28,2) AS cost_others,
       a.n::BIGINT AS pre_invoices, a.c::DECIMAL(28,2) AS cost, a.t::BIGINT AS transactions,
       CASE WHEN sum(a.c) OVER () > 0 THEN a.c::DECIMAL(28,2)::DOUBLE / (sum(a.c) OVER ())::DECIMAL(28,2)::DOUBLE ELSE 0.0::DOUBLE END AS cost_share
FROM by_provider AS a
LEFT JOIN by_provider AS x ON x.provider_id = a.provider_id AND x.any_null
LEFT JOIN by_provider AS y ON y.provider_id = a.provider_id AND y.any_others""",
}


def _select(final: str, last: str) -> str:
    """``final`` over the chain of relations up to ``last``."""
    chain = []
    for name, body in _RELATIONS.items():
        chain.append(f"{name} AS ({body}\n)")
        if name == last:
            break
    return "WITH " + STANDIN + ",\n" + ",\n".join(chain) + "\n" + final


def _of(granularity: str, slice_name: str | None = None) -> str:
    return f"granularity = {_q(granularity)}" + (f" AND slice = {_q(slice_name)}" if slice_name else "")


def status_summary(granularity: str, slice_name: str) -> str:
    return _select(f"SELECT * EXCLUDE (granularity, slice) FROM summary WHERE {_of(granularity, slice_name)}", "summary")


_VALUE = {"count": "n", "share": "share", "cost": "money"}


def matrix_long(metric: str, granularity: str, slice_name: str) -> str:
    return _select(f"SELECT bucket, status_ord, status, {_VALUE[metric]} AS value FROM matrix WHERE {_of(granularity, slice_name)}", "matrix")


def share_fractions(granularity: str, slice_name: str) -> str:
    return _select(f"SELECT bucket, status_ord, status, share / 100.0::DOUBLE AS value FROM matrix WHERE {_of(granularity, slice_name)}", "matrix")


def _slots(value: str) -> str:
    return ", ".join(f"any_value({value}) FILTER (slot = {k}) AS p{k}" for k in range(1, N_BUCKETS + 1))


def matrix_wide(metric: str, granularity: str, slice_name: str) -> str:
    return _select(f"SELECT status_ord, status, {_slots(_VALUE[metric])} FROM matrix WHERE {_of(granularity, slice_name)} "
                   "GROUP BY status_ord, status ORDER BY status_ord", "matrix")


def _grouped(value: str) -> str:
    return f"replace(format('{{:,.0f}}', {value}::DOUBLE), ',', '.')"


def matrix_display(granularity: str, slice_name: str) -> str:
    return _select(f"""
SELECT bucket, status_ord, status, if(n = 0, '-', {_grouped("n")}) AS count_text,
       CASE WHEN status = 'TOTAL' THEN '100%' WHEN share = 0 THEN '-' ELSE format('{{:.1f}}%', share) END AS share_text,
       if(money = 0, '-', 'R$ ' || {_grouped("money")}) AS cost_text
FROM matrix WHERE {_of(granularity, slice_name)}""", "matrix")


def asset_counts(granularity: str, slice_name: str) -> str:
    return _select(f"SELECT bucket, routes, vehicles FROM asset_totals WHERE {_of(granularity, slice_name)}", "asset_totals")


def asset_counts_all_slices(granularity: str) -> str:
    return _select(f"SELECT slice, bucket, routes, vehicles FROM asset_totals WHERE {_of(granularity)}", "asset_totals")


def asset_row(metric: str, granularity: str, slice_name: str) -> str:
    return _select(f"""
SELECT {_q(ASSET_LABELS[metric])} AS metric, {_slots(metric)}
FROM (SELECT *, row_number() OVER (ORDER BY bucket) AS slot FROM asset_totals WHERE {_of(granularity, slice_name)})
HAVING count(*) > 0""", "asset_totals")


def asset_display(granularity: str, slice_name: str) -> str:
    lines = " UNION ALL ".join(f"SELECT {_q(label)} AS metric, bucket, {_grouped(c)} AS text FROM asset_totals "
                               f"WHERE {_of(granularity, slice_name)}" for c, label in ASSET_LABELS.items())
    return _select(lines, "asset_totals")


_SLICE_LIST = f"(SELECT unnest([{_in_list(SLICES)}]) AS slice)"


def slice_status(granularity: str = WEEKLY) -> str:
    return _select(f"SELECT slice, slice IN (SELECT slice FROM summary WHERE {_of(granularity)}) AS has_data FROM {_SLICE_LIST}", "summary")


def report_row_counts() -> str:
    # the asset relations stand before the summary in the chain
    return _select(f"""
SELECT s.slice, r.report, r.granularity, count(x.slice) AS rows
FROM {_SLICE_LIST} AS s, (SELECT * FROM (VALUES ('status_summary'), ('asset_counts')) AS a(report), (VALUES ('weekly'), ('monthly')) AS g(granularity)) AS r
LEFT JOIN (SELECT 'status_summary' AS report, granularity, slice FROM summary
           UNION ALL SELECT 'asset_counts', granularity, slice FROM asset_totals) AS x
  ON x.report = r.report AND x.granularity = r.granularity AND x.slice = s.slice
GROUP BY ALL""", "summary")


def _gated(relation: str, columns: str) -> str:
    return f"SELECT {columns} FROM {relation} WHERE slice IN (SELECT slice FROM summary WHERE granularity = 'weekly')"


def suite_status_matrix() -> str:
    return _select(_gated("matrix", "granularity, slice, bucket, status_ord, status, n AS count, share, money AS cost"), "matrix")


def suite_asset_counts() -> str:
    return _select(_gated("asset_totals", "*"), "summary")


# -- building blocks --------------------------------------------------------------

def period_names() -> str:
    return _select("SELECT DISTINCT period_name FROM events", "events")


def top_buckets(granularity: str) -> str:
    return _select(f"SELECT bucket FROM recent WHERE {_of(granularity)}", "recent")


def latest_version_rows() -> str:
    return _select("SELECT * EXCLUDE (elements) FROM newest", "newest")


def trace_latest() -> str:
    return _select("SELECT preinvoice_id, seen.status AS status FROM last_seen", "last_seen")


def trace_latest_detail() -> str:
    return _select("SELECT preinvoice_id, seen.status, seen.invoice_id, seen.file_status, seen.file_accounting_document, "
                   "seen.last_update, seen.invoice_amount FROM last_seen", "last_seen")


def ledger_enriched(granularity: str) -> str:
    return _select("SELECT transaction_id, bucket, pre_invoice_type, pre_invoice_id, provider_id, provider_type, cost_amt, route, status "
                   f"FROM routed WHERE {_of(granularity)}", "routed")


def payload_route(granularity: str = WEEKLY) -> str:
    return _select(f"SELECT transaction_id, max(own_route) AS route FROM placed WHERE {_of(granularity)} "
                   "GROUP BY transaction_id HAVING max(len(elements)) > 0", "placed")


def payload_assets(granularity: str) -> str:
    return _select(f"SELECT * EXCLUDE (granularity) FROM assets WHERE {_of(granularity)}", "assets")


def status_normalised(granularity: str = WEEKLY, slice_name: str = ALL_SLICE) -> str:
    return _select(f"SELECT * EXCLUDE (granularity, slice, label), label AS status_norm FROM labelled WHERE {_of(granularity, slice_name)}", "labelled")


# -- pending, ranking ------------------------------------------------------------

def pending_detail() -> str:
    return _select("SELECT * FROM detail", "detail")


def pending_by_provider() -> str:
    return _select("""
SELECT provider_id, provider_name, provider_type, period, month, status_group, status,
       count(DISTINCT pre_invoice_id) AS pre_invoices, coalesce(sum(cost), 0)::DECIMAL(28,2) AS cost,
       coalesce(sum(transactions), 0)::BIGINT AS transactions
FROM detail GROUP BY ALL""", "detail")


def pending_summary() -> str:
    return _select("SELECT count(*) AS rows, count(DISTINCT pre_invoice_id) AS pre_invoices, "
                   "count(DISTINCT provider_id) AS providers FROM detail", "detail")


def ranking_excluded_periods() -> str:
    return _select("SELECT period FROM dropped", "dropped")


def provider_ranking() -> str:
    return _select("SELECT * FROM ranking", "ranking")


def provider_ranking_positions() -> str:
    return _select("SELECT *, row_number() OVER (ORDER BY cost DESC, provider_id, provider_name, provider_type, cost_null, "
                   "pre_invoices_null, cost_others, pre_invoices_others) AS position FROM ranking", "ranking")


def provider_ranking_total() -> str:
    sums = ", ".join(f"coalesce(sum({c}), 0)::{'DECIMAL(28,2)' if c.startswith('cost') else 'BIGINT'} AS {c}"
                     for c in ("pre_invoices_null", "cost_null", "pre_invoices_others", "cost_others", "pre_invoices", "cost"))
    return _select(f"SELECT {sums}, 1.0::DOUBLE AS cost_share FROM ranking", "ranking")

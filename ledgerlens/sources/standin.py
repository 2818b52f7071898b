"""Stand-in ledger derived from the driver's TPC-H-like tables.

The test data holds no ledger, so the three inputs are derived from
``lineitem``, ``orders``, ``events`` and ``supplier`` (rules in FIXTURES.md
section 2). The DuckDB oracle derives them with the same expressions
(``ledgerlens.plans.oracle``). The derivation scales with the source tables:
it is one join of lineitem to orders plus row-wise projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import write_table
from ledgerlens.sources.tables import LedgerTables

# Fixed values of the derivation (FIXTURES.md section 2), in its order.
TRACE_STATUS_BY_CODE = (
    "accounting_document_update",
    "accounting_error",
    "accounting_sent_sap",
    "escalated_to_external_team",
    "validate_files_fail",
    "validate_provision_success",
    "preconciliation_ok_invoice",
    "sap_status_pago_realizado",
    "sap_status_pagado",
    "sap_status_liberado_para_el_pago",
    "sap_status_en_proceso_de_pago",
    "preconciliation_fail_invoice",
    "unlisted_status",
    None,
)
PROVIDER_TYPE_BY_NATION_MOD5 = ("TAC-CNPJ", "TAC-CPF", "ETC", "MEI", "OTHER")


def _s(c: Column) -> Column:
    return c.cast("string")


def _pick(code: Column, values: tuple) -> Column:
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v).cast("string")
        out = F.when(code == i, lit) if out is None else out.when(code == i, lit)
    return out


def standin_cost_event(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice",
                         "l_returnflag", "l_linestatus", "l_shipdate")
    o = orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    j = li.join(o, "l_orderkey", "inner")
    ship = F.col("l_shipdate")
    name = F.concat(_s(F.lit(2025) + F.year(ship) % 2), F.lpad(_s(F.month(ship)), 2, "0"),
                    F.when(F.dayofmonth(ship) <= 15, F.lit("Q1")).otherwise(F.lit("Q2")))
    okey_mod = F.col("l_orderkey") % 97
    period = (F.when(okey_mod == 0, F.lit('{"name":null}'))
              .when(okey_mod == 1, F.lit("not json"))
              .when(okey_mod == 2, F.lit('{"name":{"x":1}}'))
              .when(okey_mod == 3, F.concat(F.lit('{"name":"'), name, F.lit('"} trailing')))
              .when(okey_mod == 4, F.concat(F.lit('{"name":"'), name, F.lit('","name":"other"}')))
              .otherwise(F.concat(F.lit('{"name":"'), name, F.lit('"}'))))
    pk = F.col("l_partkey")
    pmod = pk % 11
    vehicle = F.concat(F.lit('{"key":"vehicle_id","value":"V'), _s(pk % 37), F.lit('"}'))
    route = F.concat(F.lit('{"key":"external_route_id","value":"R'), _s(pk % 500), F.lit('"}'))
    payload = (F.when(pmod == 0, F.lit('{"payload":[]}'))
               .when(pmod == 1, F.lit("{}"))
               .when(pmod == 2, F.concat(F.lit('{"payload":['), vehicle, F.lit("]}")))
               .when(pmod == 3, F.concat(F.lit('{"payload":[7,{"key":"external_route_id","value":'),
                                         _s(pk % 50), F.lit("}]}")))
               .when(pmod == 4, F.concat(F.lit('{"payload":['), route, F.lit("]} trailing")))
               .when(pmod == 5, F.concat(F.lit('{"payload":[{"key":"external_route_id","value":"R'), _s(pk % 500),
                                         F.lit('","value":"Z"},'), vehicle, F.lit("]}")))
               .when(pmod == 6, F.concat(F.lit('{"payload":["{\\"key\\":\\"vehicle_id\\",\\"value\\":\\"Z\\"}",'), route,
                                         F.lit('],"payload":['), vehicle, F.lit("]}")))
               .otherwise(F.concat(F.lit('{"payload":['), route, F.lit(","), vehicle, F.lit("]}"))))
    prio = F.col("o_orderpriority")
    ptype = (F.when(prio == "5-LOW", F.lit("complementary"))
             .when((prio == "4-NOT SPECIFIED") & (F.col("l_linenumber") == 1), F.lit(None).cast("string"))
             .otherwise(F.lit("regular")))
    pending = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("transaction_id"),
        F.year(ship).cast("bigint").alias("version_id"),
        F.when(pending, F.lit("PENDING")).otherwise(F.lit("PROCESSED")).alias("event_status"),
        period.alias("period"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("cost_amt"),
        ptype.alias("pre_invoice_type"),
        (F.col("l_suppkey") * 100 + F.month(ship)).cast("bigint").alias("pre_invoice_id"),
        F.col("l_suppkey").cast("bigint").alias("provider_id"),
        payload.alias("payload"),
    )


def standin_trace_event(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    code = F.floor(eid / 12).cast("bigint") % 14
    return (events.where((uid + eid % 12) % 6 != 0)
            .select(_s(uid * 100 + eid % 12 + 1).alias("preinvoice_id"),
                    _pick(code, TRACE_STATUS_BY_CODE).alias("status"),
                    F.col("ts").alias("last_update"),
                    eid.cast("bigint").alias("invoice_id"),
                    F.col("event_type").alias("file_status"),
                    F.concat(F.lit("DOC"), _s(eid)).alias("file_accounting_document"),
                    F.col("value").cast("decimal(18,2)").alias("invoice_amount"),
                    eid.cast("bigint").alias("seq")))


def standin_provider(supplier: DataFrame) -> DataFrame:
    return supplier.select(F.col("s_suppkey").cast("bigint").alias("id"),
                           F.col("s_name").alias("name"),
                           _pick(F.col("s_nationkey") % 5, PROVIDER_TYPE_BY_NATION_MOD5).alias("type"))


def standin_tables(spark: SparkSession, sf_dir: str, storage: str | None = None) -> LedgerTables:
    """The stand-in inputs as lazy derivations of the driver's tables.

    With ``storage`` the three tables are written there once and read back:
    what a production ledger is, stored and scanned with column pruning and
    pushed filters. Nothing is written unless the caller names the folder.
    """
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    tables = LedgerTables(standin_cost_event(read("lineitem"), read("orders")), standin_trace_event(read("events")),
                          standin_provider(read("supplier")))
    if storage is None:
        return tables
    return LedgerTables(*(write_table(df, f"{storage.rstrip('/')}/{name}") for name, df in (
        ("cost_event", tables.cost_event), ("trace_event", tables.trace_event), ("provider", tables.provider))))

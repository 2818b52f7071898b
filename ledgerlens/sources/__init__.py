from ledgerlens.sources.tables import (COST_EVENT_SCHEMA, PROVIDER_SCHEMA, TRACE_EVENT_SCHEMA,
                                       LedgerTables, conformed, ledger_tables, read_ledger_tables)
from ledgerlens.sources.standin import standin_tables

__all__ = ["COST_EVENT_SCHEMA", "TRACE_EVENT_SCHEMA", "PROVIDER_SCHEMA", "LedgerTables",
           "conformed", "ledger_tables", "read_ledger_tables", "standin_tables"]

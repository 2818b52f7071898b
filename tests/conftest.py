from __future__ import annotations

import json
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from ledgerlens.session import local_session  # noqa: E402
from ledgerlens.sources.tables import (COST_EVENT_SCHEMA, PROVIDER_SCHEMA, TRACE_EVENT_SCHEMA,  # noqa: E402
                                       LedgerTables)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=4, app="ledgerlens-tests")
    yield s


_UNSET = object()


def cost(tid, ver=1, name="202612Q2", *, period=_UNSET, status="PROCESSED", amt="10.00", ptype="regular",
         pid=1, prov=1, route="R1", vehicle="V1", payload=_UNSET):
    """One cost_event row. ``name`` builds ``{"name": name}``; ``period``
    overrides with raw text. ``route``/``vehicle`` build the payload unless
    ``payload`` gives raw text."""
    if period is _UNSET:
        period = None if name is None else json.dumps({"name": name})
    if payload is _UNSET:
        items = []
        if route is not None:
            items.append({"key": "external_route_id", "value": route})
        if vehicle is not None:
            items.append({"key": "vehicle_id", "value": vehicle})
        payload = json.dumps({"payload": items})
    return (tid, ver, status, period, None if amt is None else Decimal(amt), ptype, pid, prov, payload)


def trace(preinvoice_id, status, ts="2026-01-01 00:00:00", seq=1, invoice_id=100, file_status="ok",
          doc="DOC1", amount="5.00"):
    import datetime as dt
    t = None if ts is None else dt.datetime.fromisoformat(ts)
    return (preinvoice_id, status, t, invoice_id, file_status, doc, None if amount is None else Decimal(amount), seq)


def provider(pid, ptype="TAC-CNPJ", name=None):
    return (pid, name or f"P{pid}", ptype)


@pytest.fixture
def tables(spark):
    def build(costs, traces=(), providers=(provider(1),)):
        return LedgerTables(
            cost_event=spark.createDataFrame(list(costs), COST_EVENT_SCHEMA),
            trace_event=spark.createDataFrame(list(traces), TRACE_EVENT_SCHEMA),
            provider=spark.createDataFrame(list(providers), PROVIDER_SCHEMA),
        )
    return build

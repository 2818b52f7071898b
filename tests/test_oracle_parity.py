"""Every registered query equals its DuckDB oracle on the sf0.001 tables
(the driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from ledgerlens.plans import catalog
from tests.oracle_compare import compare, duck
from tests.conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_report_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_oracle(spark, con, name):
    n, problems = compare(spark, SF_SMALL, name, QUERIES[name], ORACLE[name], con)
    assert not problems, problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["bucket", "pre_invoice_type", "status", "routes", "pre_invoices", "cost"]

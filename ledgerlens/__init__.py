"""ledgerlens: invoice-ledger status analytics as Spark DataFrame plans.

Layout
------
``sources``    readers for the ledger tables, and the stand-in ledger built from
               the driver's TPC-H-like tables.
``functions``  Column builders (guarded JSON extraction, status rules, shares,
               display text). All built-in Spark expressions, no Python UDFs.
``operators``  DataFrame -> DataFrame building blocks (latest version, trace
               dedup, bucket selection, payload values, summaries, matrices,
               pending detail, provider ranking).
``plans``      Composed reports, the one-snapshot report suite, and the query
               catalogue used by ``__spark_entry__``.
"""

from ledgerlens.config import DEFAULT_CONFIG, LedgerConfig

__all__ = ["DEFAULT_CONFIG", "LedgerConfig"]

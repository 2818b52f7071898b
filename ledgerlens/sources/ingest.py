"""A ledger stored by month, so that reports on a year or on recent months skip
the files of all others (S1, F4).

The period is JSON text, which no file statistics can prune. Ingest parses it
once; the name becomes a column, and its month the folder. A report on such a
ledger parses no period at all, and its condition on the period names is also
put to the month, where Spark turns it into partition filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.json import with_json_field
from ledgerlens.operators.ledger import PERIOD_NAME_FIELD, folder_of, month_of
from ledgerlens.sources.tables import COST_EVENT_SCHEMA, PERIOD_MONTH, PERIOD_NAME, conform

INGESTED_SCHEMA = T.StructType([*COST_EVENT_SCHEMA.fields, T.StructField(PERIOD_NAME, T.StringType()),
                                T.StructField(PERIOD_MONTH, T.StringType())])


def ingest_ledger(cost_event: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``cost_event`` under ``path``, a folder per month of the period name.

    Rows are dealt by ranges of (month, transaction): a month that holds a third
    of the ledger is cut into many files, a small one stays in one, and a file
    covers a narrow range of transactions. A hot transaction is cut by its
    versions and pre-invoices. Rows without a name have a folder of their own.
    ``mode`` "append" adds a later load.
    """
    rows = with_json_field(conform(cost_event, COST_EVENT_SCHEMA, "cost_event"), "period", PERIOD_NAME_FIELD, PERIOD_NAME)
    rows = rows.withColumn(PERIOD_MONTH, folder_of(month_of(F.col(PERIOD_NAME))))
    (rows.repartitionByRange(PERIOD_MONTH, "transaction_id", "version_id", "pre_invoice_id")
     .sortWithinPartitions(PERIOD_MONTH, "transaction_id", "version_id")
     .write.mode(mode).partitionBy(PERIOD_MONTH).parquet(path))


def ingested_ledger(spark: SparkSession, path: str) -> DataFrame:
    """An ingested ledger, in place of the cost events in ``LedgerTables``."""
    return spark.read.schema(INGESTED_SCHEMA).parquet(path)

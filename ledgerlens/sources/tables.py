"""The three ledger tables (S1-S3): schemas and readers.

Tables come from files, from the catalog or as DataFrames, and are checked
against the schemas when they are opened. Catalyst then prunes columns and
pushes the ``event_status`` predicate into the parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COST_EVENT_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()),
    T.StructField("version_id", T.LongType()),
    T.StructField("event_status", T.StringType()),
    T.StructField("period", T.StringType()),          # JSON object text, {"name": ...}
    T.StructField("cost_amt", T.DecimalType(18, 2)),
    T.StructField("pre_invoice_type", T.StringType()),
    T.StructField("pre_invoice_id", T.LongType()),
    T.StructField("provider_id", T.LongType()),
    T.StructField("payload", T.StringType()),         # JSON text, {"payload": [{key, value}, ...]}
])

TRACE_EVENT_SCHEMA = T.StructType([
    T.StructField("preinvoice_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("last_update", T.TimestampNTZType()),
    T.StructField("invoice_id", T.LongType()),
    T.StructField("file_status", T.StringType()),
    T.StructField("file_accounting_document", T.StringType()),
    T.StructField("invoice_amount", T.DecimalType(18, 2)),
    T.StructField("seq", T.LongType()),               # tie-break where the log has one; else NULL
])

PROVIDER_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
])

#: Columns that an ingested ledger (``sources.ingest``) has besides: the parsed
#: period name and its month, which the folders are named by.
PERIOD_NAME, PERIOD_MONTH = "period_name", "period_month"


@dataclass(frozen=True)
class LedgerTables:
    """One consistent set of the three inputs every report is built from."""

    cost_event: DataFrame
    trace_event: DataFrame
    provider: DataFrame


#: Columns that a table may lack: they read as NULL.
OPTIONAL = ("seq",)
#: Formats whose files carry their own column names and types.
SELF_DESCRIBING = ("parquet", "orc", "avro", "delta", "iceberg")


def conform(df: DataFrame, schema: T.StructType, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with exactly the columns of ``schema`` (and those of ``keep`` that it
    has), or a ``ValueError`` that names everything wrong with it.

    A column that reports need must be there: read under a given schema it would
    come as NULL unnoticed, and a ledger without versions would look like one
    whose rows never match. Types may differ where no value can be lost: whole
    numbers in whole numbers as wide, any decimal or whole number in a decimal
    that holds it, a timestamp of either kind, any type in text. Other columns
    are dropped.
    """
    found = {f.name.lower(): f for f in df.schema.fields}
    out, wrong = [], []
    for field in schema.fields:
        own = found.get(field.name)
        if own is None and field.name in OPTIONAL:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif own is None:
            wrong.append(f"column {field.name} is missing")
        elif not _holds(own.dataType, field.dataType):
            wrong.append(f"column {field.name} is {own.dataType.simpleString()}, not {field.dataType.simpleString()}")
        else:
            col = F.col(f"`{own.name}`")
            out.append((col if own.dataType == field.dataType else col.cast(field.dataType)).alias(field.name))
    if wrong:
        raise ValueError(f"{name}: " + "; ".join(wrong))
    return df.select(*out, *(F.col(f"`{found[c].name}`").alias(c) for c in keep if c in found))


_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _holds(own: T.DataType, wanted: T.DataType) -> bool:
    """Whether every value of type ``own`` has its equal in type ``wanted``."""
    if own == wanted or isinstance(own, T.NullType):
        return True
    if isinstance(wanted, T.StringType):
        return isinstance(own, (T.StringType, T.VarcharType, T.CharType, T.IntegralType))
    if isinstance(wanted, T.LongType):
        return type(own) in _DIGITS
    if isinstance(wanted, T.DecimalType):
        whole, scale = (own.precision - own.scale, own.scale) if isinstance(own, T.DecimalType) else (_DIGITS.get(type(own), 99), 0)
        return scale <= wanted.scale and whole <= wanted.precision - wanted.scale
    return isinstance(wanted, T.TimestampNTZType) and isinstance(own, (T.TimestampType, T.TimestampNTZType))


def conformed(cost_event: DataFrame, trace_event: DataFrame, provider: DataFrame) -> LedgerTables:
    """The three inputs from any DataFrames, checked against their schemas."""
    return LedgerTables(conform(cost_event, COST_EVENT_SCHEMA, "cost_event", keep=(PERIOD_NAME, PERIOD_MONTH)),
                        conform(trace_event, TRACE_EVENT_SCHEMA, "trace_event"), conform(provider, PROVIDER_SCHEMA, "provider"))


def ledger_tables(spark: SparkSession, cost_event: str, trace_event: str, provider: str) -> LedgerTables:
    """Read the ledger tables by their catalog names (``spark.table``)."""
    return conformed(spark.table(cost_event), spark.table(trace_event), spark.table(provider))


def read_ledger_tables(spark: SparkSession, cost_event_path: str, trace_event_path: str,
                       provider_path: str, fmt: str = "parquet") -> LedgerTables:
    """Read real ledger tables stored as files (parquet by default).

    Files that describe themselves are checked by ``conform``; others (CSV,
    JSON lines) are read under the schema.
    """
    def read(path: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format(fmt)
        return (reader if fmt.lower() in SELF_DESCRIBING else reader.schema(schema)).load(path)

    return conformed(read(cost_event_path, COST_EVENT_SCHEMA), read(trace_event_path, TRACE_EVENT_SCHEMA),
                     read(provider_path, PROVIDER_SCHEMA))

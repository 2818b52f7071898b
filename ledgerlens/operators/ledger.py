"""Ledger row selection (F1, P1, P3, F2, F4) and bucket keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import (DEFAULT_CONFIG, MONTH_PREFIX_LEN, MONTHLY, PROCESSED, WEEKLY,
                               YEAR_PREFIX_LEN, LedgerConfig)
from ledgerlens.functions.json import with_json_field
from ledgerlens.sources.tables import PERIOD_MONTH, PERIOD_NAME

PERIOD_NAME_FIELD = "name"

LEDGER_COLUMNS = ("transaction_id", "version_id", "period_name", "cost_amt", "pre_invoice_type",
                  "pre_invoice_id", "provider_id", "payload")


def month_of(period_name: Column) -> Column:
    """First six characters of the period name (NULL stays NULL)."""
    return F.substring(period_name, 1, MONTH_PREFIX_LEN)


def year_of(period_name: Column) -> Column:
    return F.substring(period_name, 1, YEAR_PREFIX_LEN)


def folder_of(month: Column) -> Column:
    """Name of a month's folder in an ingested ledger. The letter keeps the empty
    month apart from NULL, which Spark would store as one."""
    return F.concat(F.lit("m"), month)


def bucket_of(period_name: Column, granularity: str) -> Column:
    if granularity == WEEKLY:
        return period_name
    if granularity == MONTHLY:
        return month_of(period_name)
    raise ValueError(f"unknown granularity {granularity!r}")


def only_processed(cost_event: DataFrame) -> DataFrame:
    """F1."""
    return cost_event.where(F.col("event_status") == PROCESSED)


def processed_rows(cost_event: DataFrame) -> DataFrame:
    """F1 + P1: processed events with the period name parsed once per row.

    The status predicate is a plain comparison on a scan column, so it reaches
    the parquet reader as a pushed filter; only the columns a report touches
    are read (column pruning follows the later projections). An ingested ledger
    has the name already, and its month besides.
    """
    rows = only_processed(cost_event)
    if PERIOD_NAME not in rows.columns:
        return with_json_field(rows, "period", PERIOD_NAME_FIELD, PERIOD_NAME).select(*LEDGER_COLUMNS)
    return rows.select(*LEDGER_COLUMNS, *(c for c in (PERIOD_MONTH,) if c in rows.columns))


def accepted_providers(provider: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """F2 on the dimension: providers whose type is accepted (NULL type drops)."""
    return (provider.where(F.col("type").isin(*config.accepted_provider_types))
            .select(F.col("id").alias("provider_id"), F.col("name").alias("provider_name"),
                    F.col("type").alias("provider_type")))


def with_provider(rows: DataFrame, provider: DataFrame,
                  config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """J3 + F2: inner join to accepted providers.

    No broadcast hint: the provider table is a dimension, and Spark broadcasts
    it on its own only when its measured size is under
    ``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks at run time). A
    provider id listed twice multiplies rows, as an inner join must.
    """
    return rows.join(accepted_providers(provider, config), "provider_id", "inner")


def in_detail_year(rows: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """period names of the detail year (NULL names drop). On an ingested
    ledger the month begins with the same year, which prunes its folders."""
    if PERIOD_MONTH in rows.columns:
        rows = rows.where(F.col(PERIOD_MONTH).startswith("m" + config.detail_year)).drop(PERIOD_MONTH)
    return rows.where(year_of(F.col("period_name")) == F.lit(config.detail_year))

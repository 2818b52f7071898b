"""Most recent buckets (T1, T2, A15) and the restriction to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.json import with_json_field
from ledgerlens.operators.ledger import PERIOD_NAME_FIELD, bucket_of, folder_of, month_of, only_processed
from ledgerlens.sources.tables import PERIOD_MONTH, PERIOD_NAME


def period_names(cost_event: DataFrame) -> DataFrame:
    """Distinct period names of processed events (NULL included). Each task
    combines equal period texts before any is parsed; an ingested ledger has the
    names already."""
    rows = only_processed(cost_event)
    if PERIOD_NAME not in rows.columns:
        rows = with_json_field(rows.select("period").distinct(), "period", PERIOD_NAME_FIELD, PERIOD_NAME)
    return rows.select(PERIOD_NAME).distinct()


def top_buckets(names: DataFrame, granularity: str, n: int) -> DataFrame:
    """The ``n`` greatest distinct buckets of the period names of all
    processed rows, before version choice and provider filters. NULL sorts
    last, so it takes a slot only when fewer than ``n`` real names exist (and
    then never joins).

    Plan: partial distinct per task -> one small exchange ->
    ``TakeOrderedAndProject``; no global sort of the ledger.
    """
    return (names.select(bucket_of(F.col("period_name"), granularity).alias("bucket"))
            .distinct()
            .orderBy(F.col("bucket").desc_nulls_last())
            .limit(n))


def restrict_to_buckets(rows: DataFrame, top: DataFrame, granularity: str) -> DataFrame:
    """Keep rows whose bucket is among ``top``; adds column ``bucket``.

    ``top`` has at most ``n`` rows (a LIMIT), a proven bound, so it is
    broadcast and the semi join never shuffles the ledger. On an ingested
    ledger the buckets' months are joined to the folder column too; that is where
    dynamic pruning leaves out the files of all other months.
    """
    if PERIOD_MONTH in rows.columns:
        months = top.select(folder_of(month_of(F.col("bucket"))).alias(PERIOD_MONTH)).distinct()
        rows = rows.join(F.broadcast(months), PERIOD_MONTH, "left_semi").drop(PERIOD_MONTH)
    with_bucket = rows.withColumn("bucket", bucket_of(F.col("period_name"), granularity))
    return with_bucket.join(F.broadcast(top), "bucket", "left_semi")

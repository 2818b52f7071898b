"""Distinct routes and vehicles per bucket (A5, V8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.config import ASSET_LABELS
from ledgerlens.functions.display import whole_text
from ledgerlens.operators.summary import slice_filter, with_slice_tags


def asset_counts(assets: DataFrame, *by: str) -> DataFrame:
    """A5: distinct routes and vehicles per bucket, across types and statuses.
    A bucket appears only if it has payload rows. Routes and vehicles go through
    one distinct as (kind, value), combined map-side; plain counts remain."""
    value = lambda c: F.struct(F.lit(c).alias("kind"), F.col(c).alias("value"))
    values = assets.select(*by, "bucket", F.inline(F.array(value("route"), value("vehicle")))).distinct()
    count = lambda c: F.count(F.when(F.col("kind") == c, F.col("value")))
    return values.groupBy(*by, "bucket").agg(count("route").alias("routes"), count("vehicle").alias("vehicles"))


def asset_counts_slice(assets: DataFrame, slice_name: str) -> DataFrame:
    return asset_counts(slice_filter(assets, slice_name))


def asset_counts_all_slices(assets: DataFrame) -> DataFrame:
    """A5 for the three slices in one pass."""
    return asset_counts(with_slice_tags(assets), "slice")


def asset_row(counts: DataFrame, metric: str, n_slots: int) -> DataFrame:
    """V8: one row ``metric, p1..pN``: the metric of each bucket, oldest first,
    0 where a bucket has none, NULL in slots without a bucket. ``counts`` has at
    most N rows (its buckets are the recent ones); without any there is no row."""
    found = counts.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce(metric, F.lit(0)).alias("v")))).alias("b"))
    return found.where(F.size("b") > 0).select(
        F.lit(ASSET_LABELS[metric]).alias("metric"), *(F.get("b", F.lit(i))["v"].alias(f"p{i + 1}") for i in range(n_slots)))


def asset_display(counts: DataFrame) -> DataFrame:
    """P14 of the asset lines: ``metric, bucket, text``, thousands grouped by '.'."""
    lines = F.array(*(F.struct(F.lit(label).alias("metric"), whole_text(F.col(c)).alias("text"))
                      for c, label in ASSET_LABELS.items()))
    return counts.select("bucket", F.inline(lines)).select("metric", "bucket", "text")

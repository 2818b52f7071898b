"""Provider ranking by unresolved cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.config import DEFAULT_CONFIG, NULL_LABEL, OTHERS_LABEL, LedgerConfig
from ledgerlens.functions.numeric import COST_SUM_TYPE, guarded_ratio
from ledgerlens.session import write_table

PROVIDER_KEYS = ("provider_id", "provider_name", "provider_type")
#: T6, with every other column as a tie-break, so that positions are reproducible.
RANKING_ORDER = ("-cost", "provider_id", "provider_name", "provider_type", "cost_null", "pre_invoices_null", "cost_others",
                 "pre_invoices_others")


def order_column(spec: str):
    """``column``, or ``-column`` for descending; NULLs as the warehouse sorts them."""
    return F.col(spec[1:]).desc_nulls_last() if spec.startswith("-") else F.col(spec).asc_nulls_first()


def excluded_periods(detail: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """the most recent ``k`` distinct non-NULL periods of the pending
    detail - but none at all when fewer than ``k`` exist."""
    k = config.ranking_trailing_periods_dropped
    last_k = (detail.where(F.col("period").isNotNull()).select("period").distinct()
              .orderBy(F.col("period").desc()).limit(k))
    n_found = last_k.select(F.count(F.lit(1))).scalar()
    return last_k.where(n_found >= F.lit(k))


def ranking_base(detail: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """Detail rows outside the excluded periods (a NULL period is kept).
    The excluded list has at most ``k`` rows, so it is broadcast."""
    return detail.join(F.broadcast(excluded_periods(detail, config)), "period", "left_anti")


def provider_totals(base: DataFrame) -> DataFrame:
    """A8 and A9 in one aggregate by (id, name, type): totals, and the same of
    each status group by conditional sums."""

    def costs(condition=None):
        value = F.col("cost") if condition is None else F.when(condition, F.col("cost"))
        return F.coalesce(F.sum(value), F.lit(0)).cast(COST_SUM_TYPE)

    def ids(condition=None):
        return F.count_distinct(F.col("pre_invoice_id") if condition is None else F.when(condition, F.col("pre_invoice_id")))

    groups = []
    for label, suffix in ((NULL_LABEL, "null"), (OTHERS_LABEL, "others")):
        inside = F.col("status_group") == label
        groups += [F.max(inside).alias(f"has_{suffix}"), ids(inside).alias(f"pre_invoices_{suffix}"),
                   costs(inside).alias(f"cost_{suffix}")]
    return base.groupBy(*PROVIDER_KEYS).agg(
        *groups, ids().alias("pre_invoices"), costs().alias("cost"),
        F.coalesce(F.sum("transactions"), F.lit(0)).cast("bigint").alias("transactions"))


def provider_ranking(detail: DataFrame, config: LedgerConfig = DEFAULT_CONFIG) -> DataFrame:
    """Per provider totals with the NULL / Outros split and cost share.

    J7 attaches the group columns by ``provider_id`` only - a provider id with
    several (name, type) pairs fans out, as the source's merge does: each of
    its rows meets every one of the id's rows that has the group. The window
    holds the pairs of one id, as many as the provider table lists it.
    P9 turns missing group values into 0; P11/A12 divide by the grand total
    when it is positive (a scalar subquery, no cross join, no one-task window).
    """
    of_id = Window.partitionBy("provider_id")
    merged = provider_totals(ranking_base(detail, config))
    for suffix in ("null", "others"):
        own = F.struct(F.col(f"pre_invoices_{suffix}").alias("n"), F.col(f"cost_{suffix}").alias("c"))
        merged = merged.withColumn(f"all_{suffix}", F.collect_list(F.when(F.col(f"has_{suffix}"), own)).over(of_id))
    for suffix in ("null", "others"):
        merged = (merged.drop(f"pre_invoices_{suffix}", f"cost_{suffix}")
                  .withColumn("one", F.explode_outer(f"all_{suffix}"))
                  .withColumns({f"pre_invoices_{suffix}": F.coalesce("one.n", F.lit(0)).cast("bigint"),
                                f"cost_{suffix}": F.coalesce("one.c", F.lit(0)).cast(COST_SUM_TYPE)}))
    merged = merged.select(*PROVIDER_KEYS, "pre_invoices_null", "cost_null", "pre_invoices_others", "cost_others",
                           "pre_invoices", "cost", "transactions")
    grand = merged.select(F.sum("cost")).scalar()
    return merged.withColumn("cost_share", guarded_ratio(F.col("cost"), F.coalesce(grand, F.lit(0))))


def with_positions(ranking: DataFrame, folder: str, order: tuple[str, ...] = RANKING_ORDER) -> DataFrame:
    """``ranking`` with ``position`` (1 is the first), in parallel.

    The rows are range-partitioned in report order and written to ``folder``
    with their partition and place in it; a partition's offset is the number of
    rows before it (a running sum over one row per partition).
    """
    by = [order_column(c) for c in order]
    row_id = F.monotonically_increasing_id()  # partition in the upper bits, place in the lower 33
    placed = write_table(ranking.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", row_id), folder)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    offsets = (placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
               .select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    return (placed.withColumn("_part", part).join(offsets, "_part")
            .withColumn("position", F.col("_before") + place + 1).drop("_part", "_before", "_at"))


def ranking_total(ranking: DataFrame) -> DataFrame:
    """The TOTAL line: sums of the six value columns, share fixed at 1.0."""
    def total(c: str, kind: str):
        return F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c)

    return ranking.agg(
        total("pre_invoices_null", "bigint"), total("cost_null", COST_SUM_TYPE),
        total("pre_invoices_others", "bigint"), total("cost_others", COST_SUM_TYPE),
        total("pre_invoices", "bigint"), total("cost", COST_SUM_TYPE), F.lit(1.0).alias("cost_share"))

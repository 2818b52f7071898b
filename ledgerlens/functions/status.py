"""Status rules as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.config import (DEFAULT_CONFIG, NO_INVOICE_PROVIDER_TYPE, NO_INVOICE_STATUS,
                               NULL_LABEL, OTHERS_LABEL, PAID_STATUS, PAID_STATUS_ALIASES,
                               LedgerConfig)


def payment_status(provider_type: Column, raw_status: Column) -> Column:
    """P5: first matching arm wins.

    1. no-invoice provider type with a NULL status (no trace row or a NULL
       status alike) -> ``nao_emite_nfs``;
    2. both paid spellings -> one paid status;
    3. otherwise the raw status, NULL kept.
    """
    return (F.when((provider_type == NO_INVOICE_PROVIDER_TYPE) & raw_status.isNull(),
                   F.lit(NO_INVOICE_STATUS))
            .when(raw_status.isin(*PAID_STATUS_ALIASES), F.lit(PAID_STATUS))
            .otherwise(raw_status))


def status_group(raw_status: Column) -> Column:
    """NULL -> 'NULL', anything else -> 'Outros' (on the raw status)."""
    return F.when(raw_status.isNull(), F.lit(NULL_LABEL)).otherwise(F.lit(OTHERS_LABEL))


def normalised_status(status: Column, config: LedgerConfig = DEFAULT_CONFIG) -> Column:
    """Report label of a (P5) status: NULL -> 'NULL', others list -> 'Outros'."""
    return (F.when(status.isNull(), F.lit(NULL_LABEL))
            .when(status.isin(*config.others_statuses), F.lit(OTHERS_LABEL))
            .otherwise(status))


def is_pending(raw_status: Column, provider_type: Column,
               config: LedgerConfig = DEFAULT_CONFIG) -> Column:
    """unresolved pre-invoice. Evaluated on the left-joined trace columns,
    so a missing trace row counts as a NULL status (the join stays outer)."""
    return ((raw_status.isNull() & (provider_type != NO_INVOICE_PROVIDER_TYPE))
            | raw_status.isin(*config.others_statuses))

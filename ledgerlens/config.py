"""Domain constants of the invoice-ledger reports.

Everything that must equal the analysed job's values for right results is
listed once, below, under FIXED VALUES. The knobs that the job hard-coded but
that a user may want to move (year of the pending detail, number of recent
buckets, trailing periods dropped from the ranking) are fields of
``LedgerConfig`` with the job's values as defaults.
"""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the analysed job; natural order as it lists them)
# ---------------------------------------------------------------------------
PROCESSED = "PROCESSED"

ACCEPTED_PROVIDER_TYPES = ("TAC-CNPJ", "TAC-CPF", "ETC", "MEI")

NO_INVOICE_PROVIDER_TYPE = "TAC-CPF"
NO_INVOICE_STATUS = "nao_emite_nfs"

PAID_STATUS = "sap_status_pago_realizado"
PAID_STATUS_ALIASES = ("sap_status_pago_realizado", "sap_status_pagado")

OTHERS_STATUSES = (
    "accounting_document_update",
    "accounting_error",
    "accounting_sent_sap",
    "escalated_to_external_team",
    "validate_files_fail",
    "validate_provision_success",
    "preconciliation_ok_invoice",
)

STATUS_DISPLAY_ORDER = (
    "sap_status_pago_realizado",
    "sap_status_liberado_para_el_pago",
    "sap_status_en_proceso_de_pago",
    "nao_emite_nfs",
    "preconciliation_fail_invoice",
    "NULL",
    "Outros",
    "TOTAL",
)

NULL_LABEL = "NULL"
OTHERS_LABEL = "Outros"
TOTAL_LABEL = "TOTAL"

REGULAR = "regular"
COMPLEMENTARY = "complementary"
ALL_SLICE = "all"
SLICES = (REGULAR, COMPLEMENTARY, ALL_SLICE)

ASSET_LABELS = {"routes": "Rotas distintas", "vehicles": "Veiculos distintos"}

ROUTE_KEY = "external_route_id"
VEHICLE_KEY = "vehicle_id"

PAYLOAD_KEY = "payload"
PAYLOAD_KEY_PATH = "$.key"
PAYLOAD_VALUE_PATH = "$.value"

MONTH_PREFIX_LEN = 6
YEAR_PREFIX_LEN = 4
# ---------------------------------------------------------------------------

WEEKLY = "weekly"
MONTHLY = "monthly"
GRANULARITIES = (WEEKLY, MONTHLY)


@dataclass(frozen=True)
class LedgerConfig:
    """Parameters of one report run."""

    recent_buckets: int = 5
    detail_year: str = "2026"
    ranking_trailing_periods_dropped: int = 2
    accepted_provider_types: tuple[str, ...] = ACCEPTED_PROVIDER_TYPES
    others_statuses: tuple[str, ...] = OTHERS_STATUSES
    status_display_order: tuple[str, ...] = STATUS_DISPLAY_ORDER

    @property
    def matrix_statuses(self) -> tuple[str, ...]:
        """Display statuses that are matrix body rows (everything but TOTAL)."""
        return tuple(s for s in self.status_display_order if s != TOTAL_LABEL)


DEFAULT_CONFIG = LedgerConfig()

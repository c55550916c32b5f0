"""Values of the data contract, and the few settings a site has to choose itself."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: they must equal the source system's, or results differ. ---

TABLES = ("clientes", "productos", "pedidos", "detalle_pedidos", "eventos")

GOLD_TABLES = (
    "gold_ventas_por_pais",
    "gold_ventas_por_canal",
    "gold_ventas_mensuales",
    "gold_top_productos",
    "gold_segmento_clientes",
    "gold_conversion_funnel",
    "gold_clientes_rfm",
    "gold_resumen_calidad",
)

AUDIT_COLUMNS = ("_source_file", "_ingestion_timestamp", "_row_hash")

INVALID_PHONE = "N/A"
UNKNOWN_CITY = "Desconocida"

# Texts of the repair log.
ACTION_EMAIL = "null → '{placeholder}'"
ACTION_PHONE = "'N/A' → null"
ACTION_CITY = "vacío → 'Desconocida'"
ACTION_STOCK = "null → 0"
ACTION_ORDERS = "deduplicación (keep first)"
ACTION_DURATION = "null → mediana por tipo_evento"

ORDER_STATES = ("pendiente", "enviado", "entregado", "cancelado", "devuelto")
LOST_STATES = ("cancelado", "devuelto")
FUNNEL_STEPS = ("page_view", "product_view", "add_to_cart", "checkout", "purchase")

PII_COLUMNS = ("nombre", "apellido", "email", "telefono", "fecha_consentimiento")

EMAIL_PATTERN = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE_PATTERN = r"\b\d{3}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}\b|\b57\d{10}\b|\b\d{10,12}\b"
PHONE_CUES = ("telefono", "phone", "cel", "móvil")
EMAIL_TAG = "[EMAIL_REDACTED]"
PHONE_TAG = "[PHONE_REDACTED]"

# Shared mailboxes of the company; their addresses are not personal data.
SAFE_MAILBOXES = (
    "unknown", "crm", "marketing", "ventas", "catalogo", "analytics",
    "governance", "finanzas", "logistica", "compras", "legal",
)

# --- Site settings ---


@dataclass(frozen=True)
class Site:
    """What differs from company to company.

    ``mail_domain`` is the company's own mail domain: the placeholder for missing addresses
    and the safe list are built from it (``unknown@<domain>``, ``crm@<domain>`` and so on).
    """

    mail_domain: str = "example.com"

    @property
    def missing_email(self) -> str:
        return f"unknown@{self.mail_domain}"

    @property
    def safe_emails(self) -> tuple[str, ...]:
        return tuple(f"{box}@{self.mail_domain}" for box in SAFE_MAILBOXES)


DEFAULT_SITE = Site()

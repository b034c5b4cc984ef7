"""Entity specs, value domains and lookup values. Data only."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: closed status domains --------------------------------------
ORDER_STATUSES = ("placed", "shipped", "delivered", "returned", "cancelled")
PAYMENT_STATUSES = ("authorized", "captured", "refunded", "failed")
PAYMENT_METHODS = ("credit_card", "debit_card", "paypal", "bank_transfer", "wallet")
UNREALISED_STATUSES = ("cancelled", "returned")

# --- fixed values: failure keys, rules and evidence surfaces -------------------
FAILURE_KEYS = (
    "negative_price",
    "missing_customer",
    "invalid_quantity",
    "duplicate_order",
    "late_arrival",
    "volume_spike",
    "schema_drift",
    "orphan_payment",
    "recurring_incident",
    "ambiguous_anomaly",
    "destructive_fix",
    "malformed_data",
    "slow_source",
    "multi_failure_cascade",
)
CASCADE_KEY = "multi_failure_cascade"
CASCADE_MEMBERS = ("missing_customer", "volume_spike", "schema_drift")
HUMAN_GATED_KEYS = ("destructive_fix",)
PIPELINE_MEMBERS = ("schema_drift", "slow_source")
RECURRING_RULE = {"recurring_incident": "negative_price"}
ALIASES = (
    ("recurring_incident", "negative_price"),
    ("negative_price", "recurring_incident"),
)
EXPECTED_SURFACE = {
    "negative_price": "silver_orders_rejects",
    "missing_customer": "silver_orders_rejects",
    "invalid_quantity": "silver_orders_rejects",
    "duplicate_order": "silver_orders_rejects",
    "malformed_data": "silver_orders_rejects",
    "destructive_fix": "silver_orders_rejects",
    "recurring_incident": "silver_orders_rejects",
    "orphan_payment": "silver_payments_rejects",
    "late_arrival": "silver_orders.is_late",
    "schema_drift": "silver_orders._schema_drift",
    "volume_spike": "silver_orders.count",
    "slow_source": "dagster_logs",
}
ORDER_REJECT_KEYS = (
    "negative_price",
    "missing_customer",
    "invalid_quantity",
    "duplicate_order",
    "malformed_data",
    "destructive_fix",
    "recurring_incident",
)
PAYMENT_REJECT_KEYS = ("orphan_payment",)
FLAG_COLUMNS = {"late_arrival": "is_late", "schema_drift": "_schema_drift"}
CASCADE_EVIDENCE = "silver_orders_rejects + silver_orders.is_late/_schema_drift + dbt run_results"
AMBIGUOUS_EVIDENCE = "silver_orders.status + silver_products.unit_price"
ORPHAN_ORDER_ID = 999999999

# --- fixed values: text contracts ----------------------------------------------
FAILURE_LINE_PREFIX = "BACKBONE_RUN_FAILURE"
FAILED_NODE_STATUSES = ("error", "fail", "runtime error", "skipped")
GARBAGE_MARKERS = ("<script>", "0x00", "\x00", "�")
MIN_ROOT_CAUSE_CHARS = 12
WRITER_APP = "oltp_writer"
ANALYTICS_APP = "dagster_ingest"

# --- fixed values: thresholds ---------------------------------------------------
LOOKBACK = "7 days"
PK_BAND = 1000
LATE_DAYS = 7
FRESHNESS_BUDGET_S = 300.0
SPIKE_FACTOR = 10
SPIKE_FLOOR = 200
LOAD_FLOORS = {"full": 75_000, "smoke": 10_000}

BUSINESS_KEY = (
    "customer_id",
    "product_id",
    "quantity",
    "unit_price",
    "total_amount",
    "status",
    "ordered_at",
)


@dataclass(frozen=True)
class EntitySpec:
    """One source table: key, watermark column, typed columns, pk arms on or off."""

    name: str
    pk: str
    watermark: str
    columns: tuple[tuple[str, str], ...]
    pk_arms: bool

    @property
    def column_names(self) -> list[str]:
        return [name for name, _ in self.columns]

    @property
    def ddl(self) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in self.columns)

    @property
    def lineage(self) -> list[str]:
        stamps = ["_ingested_at", "_source_watermark"]
        return stamps + (["_schema_drift"] if self.name == "orders" else [])


ENTITIES = {
    "customers": EntitySpec(
        "customers",
        "customer_id",
        "created_at",
        (
            ("customer_id", "BIGINT"),
            ("full_name", "STRING"),
            ("email", "STRING"),
            ("country", "STRING"),
            ("city", "STRING"),
            ("segment", "STRING"),
            ("created_at", "TIMESTAMP"),
        ),
        pk_arms=False,
    ),
    "products": EntitySpec(
        "products",
        "product_id",
        "created_at",
        (
            ("product_id", "BIGINT"),
            ("sku", "STRING"),
            ("name", "STRING"),
            ("category", "STRING"),
            ("unit_price", "DECIMAL(10,2)"),
            ("cost", "DECIMAL(10,2)"),
            ("created_at", "TIMESTAMP"),
        ),
        pk_arms=False,
    ),
    "orders": EntitySpec(
        "orders",
        "order_id",
        "ordered_at",
        (
            ("order_id", "BIGINT"),
            ("customer_id", "BIGINT"),
            ("product_id", "BIGINT"),
            ("quantity", "INT"),
            ("unit_price", "DECIMAL(10,2)"),
            ("total_amount", "DECIMAL(12,2)"),
            ("status", "STRING"),
            ("ordered_at", "TIMESTAMP"),
        ),
        pk_arms=True,
    ),
    "payments": EntitySpec(
        "payments",
        "payment_id",
        "paid_at",
        (
            ("payment_id", "BIGINT"),
            ("order_id", "BIGINT"),
            ("method", "STRING"),
            ("amount", "DECIMAL(12,2)"),
            ("status", "STRING"),
            ("paid_at", "TIMESTAMP"),
        ),
        pk_arms=True,
    ),
}

# Orders come before payments: a payment's verdict needs the accepted orders.
ENTITY_ORDER = ("customers", "products", "orders", "payments")

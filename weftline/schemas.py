"""Canonical business tables: columns, types, keys and value domains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DateType, DecimalType, StringType, StructField, StructType

MONEY = DecimalType(18, 2)


@dataclass(frozen=True)
class TableContract:
    """What the quality gate and the typed reader expect of one business table."""

    name: str
    fields: tuple[tuple[str, object], ...]
    key: str
    join_keys: tuple[str, ...]
    status: tuple[str, tuple[str, ...]] | None = None
    dates: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.fields)

    @property
    def struct(self) -> StructType:
        return StructType([StructField(name, kind) for name, kind in self.fields])


_S, _D = StringType(), DateType()

# Table names, columns, keys, status words and checked columns.
PARTNERS = TableContract(
    "business_partners",
    (("partner_id", _S), ("partner_name", _S), ("country", _S), ("email", _S)),
    key="partner_id",
    join_keys=("partner_id",),
)
ORDERS = TableContract(
    "sales_orders",
    (
        ("sales_order_id", _S), ("partner_id", _S), ("country", _S), ("product", _S),
        ("order_status", _S), ("effective_date", _D), ("expiry_date", _D), ("net_value_eur", MONEY),
    ),
    key="sales_order_id",
    join_keys=("sales_order_id", "partner_id"),
    status=("order_status", ("RELEASED", "CLOSED", "CANCELLED")),
    dates=("effective_date",),
    amounts=("net_value_eur",),
)
POSTINGS = TableContract(
    "acdoca_financials",
    (
        ("journal_entry_id", _S), ("sales_order_id", _S), ("partner_id", _S), ("country", _S),
        ("product", _S), ("posting_status", _S), ("posting_date", _D),
        ("amount_in_company_currency_eur", MONEY),
    ),
    key="journal_entry_id",
    join_keys=("journal_entry_id", "sales_order_id", "partner_id"),
    status=("posting_status", ("POSTED", "CLEARED", "REVERSED", "DUPLICATE")),
    dates=("posting_date",),
    amounts=("amount_in_company_currency_eur",),
)
BILLING = TableContract(
    "billing_documents",
    (
        ("billing_doc_id", _S), ("sales_order_id", _S), ("partner_id", _S), ("country", _S),
        ("product", _S), ("billing_date", _D), ("billed_amount_eur", MONEY),
    ),
    key="billing_doc_id",
    join_keys=("billing_doc_id", "sales_order_id", "partner_id"),
    dates=("billing_date",),
    amounts=("billed_amount_eur",),
)
CONTRACTS = (POSTINGS, BILLING, PARTNERS, ORDERS)

# Countries and the two status rules.
COUNTRIES = ("FR", "GB", "DE")
QUALIFYING_POSTING = ("POSTED", "CLEARED")
ACTIVE_SALES_ORDER = ("RELEASED",)

# One row per RDF triple; o_kind is iri, bnode or literal.
TRIPLE_COLUMNS = ("graph", "s", "p", "o", "o_kind", "datatype", "lang")

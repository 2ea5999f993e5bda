"""From a loaded table to the canonical columns of its role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import parse_money, parse_number
from ledgerloom.functions.text import clean_header, match_key

# Accepted names per canonical field, first hit wins.
ALIASES = {
    "invoice_number": (
        "invoicenumber", "invoice_no", "inv_no", "invno", "invoice #", "invoice#",
        "invoice number", "invoice_id", "invoiceid", "inv_id", "invid", "inv_number",
        "invnumber", "bill_number", "billno",
    ),
    "vendor_name": (
        "vendorname", "vendor", "supplier", "supplier_name", "suppliername", "company",
        "company_name", "companyname", "seller", "seller_name",
    ),
    "amount": (
        "invoiceamount", "invoice_amount", "total", "total_amount", "totalamount", "amt",
        "value", "grand_total", "grandtotal", "net_amount", "netamount", "invoice_total",
        "invoicetotal",
    ),
    "po_number": (
        "ponumber", "po_no", "purchase_order", "purchaseorder", "po number", "po#", "po_id",
        "poid", "purchase_order_number", "purchaseordernumber", "order_number", "orderno",
    ),
    "date": ("invoicedate", "invoice_date", "date_of_invoice"),
    "currency": ("cur", "curr", "currency_code", "ccy"),
    "tax": ("tax_amount", "taxamount", "gst", "vat", "hsn", "tax_amt", "sales_tax"),
    "quantity": (
        "qty", "quantity_received", "quantity_ordered", "units", "unit_qty", "received_qty",
        "qty_ordered", "quantity_billed", "billed_qty",
    ),
    "unit_price": (
        "unitprice", "unit_cost", "price_per_unit", "contracted_rate", "contract_price",
        "rate", "price",
    ),
}
# The second invoice layout, which adds due date and status.
SECOND_LAYOUT = {
    "invoice_number": ("invoice_number", "invoice_no", "inv_no", "inv_num", "invoice#"),
    "vendor_name": ("vendor_name", "vendor", "supplier", "supplier_name", "party_name", "from"),
    "amount": ("amount", "total", "total_amount", "invoice_amount", "value", "net_amount"),
    "date": ("date", "invoice_date", "inv_date", "transaction_date", "bill_date"),
    "po_number": ("po_number", "po_no", "purchase_order", "po#", "po_ref", "order_number"),
    "due_date": ("due_date", "payment_due", "due"),
    "status": ("status", "payment_status", "paid", "approval_status"),
    "currency": ("currency", "curr", "ccy"),
    "tax": ("tax", "tax_amount", "gst", "vat", "hsn"),
}


def clean_names(df: DataFrame) -> DataFrame:
    """Header cleaning as one plan-time rename; bookkeeping names stay."""
    return df.toDF(*[c if c.startswith("_") else clean_header(c) for c in df.columns])


def canonicalise(df: DataFrame) -> DataFrame:
    """Add the canonical columns that are missing, from the first alias present.

    A canonical name that is already there wins, and the source columns stay.
    """
    df = clean_names(df)
    for name, aliases in ALIASES.items():
        if name in df.columns:
            continue
        found = next((a for a in map(clean_header, aliases) if a in df.columns), None)
        if found is not None:
            df = df.withColumn(name, F.col(found))
    return df


def pick_layout(df: DataFrame, layout: dict[str, tuple[str, ...]]) -> DataFrame:
    """Project a table to a fixed layout; fields without a source are NULL."""
    lowered = {c.lower(): c for c in df.columns}
    out = []
    for name, aliases in layout.items():
        found = next((lowered[a] for a in aliases if a in lowered), None)
        out.append((F.col(found) if found else F.lit(None).cast("string")).alias(name))
    extra = [F.col(c) for c in df.columns if c.startswith("_")]
    return df.select(*extra, *out)


def second_layout(df: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """The second invoice layout: vendor in lower case, a made-up number where it is missing."""
    picked = pick_layout(df, SECOND_LAYOUT)
    number = F.coalesce(
        match_key("invoice_number"), F.concat(F.lit("INV-"), F.col(row_id).cast("string"))
    )
    vendor = F.regexp_replace(F.lower(F.trim("vendor_name")), r"\s+", " ")
    return picked.withColumns({"invoice_number": number, "vendor_name": vendor})


def _has(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def typed(df: DataFrame, name: str, money: bool = True) -> Column:
    """The parsed number of a canonical column, NULL when the column is missing."""
    kind = df.schema[name].dataType if name in df.columns else T.StringType()
    c = _has(df, name, "string")
    if isinstance(kind, T.StringType):
        return parse_money(c) if money else parse_number(c)
    return c.cast("decimal(18,2)" if money else "double")


def text(df: DataFrame, name: str) -> Column:
    return _has(df, name, "string").cast("string")


def with_row_id(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """Add ``_row_id``.

    With ``order_by`` (a total order) the id is a struct of those columns, which
    sorts the same way and costs no shuffle.  Without it the place in the file is
    used; such ids are stable only while the file layout stays the same.
    """
    if "_row_id" in df.columns:
        return df
    if order_by:
        return df.withColumn("_row_id", F.struct(*order_by))
    return df.withColumn(
        "_row_id",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("at"),
            F.monotonically_increasing_id().alias("n"),
        ),
    )

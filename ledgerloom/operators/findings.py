"""Checks on matched invoices and the findings they raise."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import (
    half_up, money_text, parse_number, plain_money_text, priority_words, severity,
)
from ledgerloom.functions.text import (
    currency_code, match_key, null_if_blank, trim_all, vendor_key_a,
)
from ledgerloom.operators.duplicates import duplicate_lines
from ledgerloom.operators.matching import spread_null
from ledgerloom.session import cut_lineage
from ledgerloom.sources.roles import text, typed

AMOUNT_SHARE = 0.02
TAX_PERCENT = 2
QUANTITY_PERCENT = 5
PRICE_PERCENT = 3

# The answers offered per finding; the first is what a rule answers.
OPTIONS = {
    "no_po_match": (
        "Approve for payment", "Request PO number from vendor", "Hold for review", "Reject invoice",
    ),
    "currency_mismatch": (
        "Approve — currencies confirmed correct", "Hold for currency verification", "Reject invoice",
    ),
    "amount_mismatch": (
        "Approve invoice amount", "Use PO amount", "Hold for clarification", "Reject invoice",
    ),
    "tax_discrepancy": (
        "Approve as stated", "Request corrected invoice from vendor", "Hold for review", "Reject invoice",
    ),
    "no_goods_receipt": (
        "Approve — goods confirmed received", "Hold until goods receipt is recorded", "Reject invoice",
    ),
    "quantity_mismatch": (
        "Approve as billed", "Approve for received quantity only", "Hold for review", "Reject invoice",
    ),
    "contract_price_variance": (
        "Approve at invoiced price", "Approve at contracted price", "Hold for vendor clarification",
        "Reject invoice",
    ),
    "duplicate_invoice": (
        "Keep first occurrence only", "Keep all (each is a separate transaction)",
        "Hold all for manual review",
    ),
}
# The question asked per finding; names in braces are filled in.
QUESTIONS = {
    "no_po_match": 'Invoice "{number}" from "{vendor}" for {shown} has no matching PO. How should this be handled?',
    "currency_mismatch": 'Invoice "{number}" is in {currency} but the matched PO is in {po_currency}. '
    "Amounts cannot be reliably compared across currencies. How should this be resolved?",
    "amount_mismatch": 'Invoice "{number}" amount is {shown} but PO amount is {po_shown} — a difference of {off} ({share}%). '
    "How should this be resolved?",
    "tax_discrepancy": 'Invoice "{number}" line items plus tax add up to {expected}, but the invoice total is {shown}. '
    "How should this discrepancy be resolved?",
    "no_goods_receipt": 'Invoice "{number}" references PO "{po}", but no goods receipt has been recorded against that PO yet. '
    "How should this be handled?",
    "quantity_mismatch": 'Invoice "{number}" bills for {actual} units, but {expected} units were recorded as received against '
    'PO "{po}" ({share}% difference). How should this be resolved?',
    "contract_price_variance": 'Invoice "{number}" unit price is {actual}, but the contracted rate for "{vendor}" is {expected} '
    "({share}% variance). How should this be resolved?",
    "duplicate_invoice": "Invoice number '{number}' has the same line submitted {copies} times. "
    "Which occurrence should be kept for payment?",
    "near_duplicate": 'Same vendor "{vendor}", amount {amount} within {days} day(s).',
}
# Position of a check inside its invoice; duplicates follow all invoices.
CHECK_ORDER = {"status": 0, "tax": 1, "receipt": 2, "contract": 3, "duplicate": 9}


# --- side tables ------------------------------------------------------------


def received_quantities(receipts: DataFrame) -> DataFrame:
    """Received quantity per order key, summed over all receipts."""
    return (
        receipts.select(
            match_key(text(receipts, "po_number")).alias("po_key"),
            typed(receipts, "quantity", money=False).cast("decimal(18,4)").alias("q"),
        )
        .filter("po_key is not null and q is not null")
        .groupBy("po_key")
        .agg(F.sum("q").cast("double").alias("received_quantity"))
    )


def contract_prices(contracts: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """Contract price per vendor key A; the last row of a vendor wins."""
    return (
        contracts.select(
            F.when(
                null_if_blank(text(contracts, "vendor_name")).isNotNull(),
                vendor_key_a(text(contracts, "vendor_name")),
            ).alias("vendor_key"),
            typed(contracts, "unit_price", money=False).alias("price"),
            F.col(row_id),
        )
        .filter("vendor_key is not null and price is not null")
        .groupBy("vendor_key")
        .agg(F.max_by("price", F.col(row_id)).alias("contract_price"))
    )


def with_received(pos: DataFrame, receipts: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """Order rows with the quantity received for their number (NULL when none).

    For order rows on their own.  The match takes the quantities itself (``received``), in its one shuffle.
    """
    received = received_quantities(receipts).withColumnRenamed("po_key", "_po_join")
    return (
        pos.withColumn("_po_join", spread_null(match_key(text(pos, "po_number")), row_id))
        .join(received, "_po_join", "left")
        .drop("_po_join")
    )


def with_contract(matched: DataFrame, contracts: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """Matched invoices with the contract price of their vendor (NULL when none)."""
    # Written first: Spark then knows the size of the price table and need not shuffle the invoices to a small one.
    prices = cut_lineage(contract_prices(contracts, row_id)).withColumnRenamed("vendor_key", "_vendor_join")
    key = F.nullif(vendor_key_a(text(matched, "vendor_name")), F.lit(""))
    return (
        matched.withColumn("_vendor_join", spread_null(key, row_id))
        .join(prices, "_vendor_join", "left")
        .drop("_vendor_join")
    )


# --- row checks -------------------------------------------------------------


def items_total(items: Column) -> Column:
    """Sum of the line item totals; a missing total counts as 0."""
    return F.aggregate(
        items,
        F.lit(0).cast("double"),
        lambda acc, x: acc + F.coalesce(x["total"].cast("double"), F.lit(0.0)),
    )


def with_items_total(invoices: DataFrame) -> DataFrame:
    """Invoices with ``_items_total`` (NULL without line items) in place of ``line_items``, for checks that need no more."""
    total = F.when(F.size("line_items") > 0, items_total(F.col("line_items")))
    return invoices.withColumn("_items_total", total).drop("line_items")


def match_status(matched: DataFrame) -> DataFrame:
    """Add ``status``: no_po_match, currency_mismatch, amount_mismatch or matched."""
    return matched.withColumn(
        "status",
        F.when(F.col("po").isNull(), "no_po_match")
        .when(F.col("currency_status") == "mismatch", "currency_mismatch")
        .when(F.col("amount_diff_pct") > AMOUNT_SHARE, "amount_mismatch")
        .otherwise("matched"),
    )


def _question(kind: str, **values: Column) -> Column:
    """The question of a finding with its values filled in."""
    parts = re.split(r"\{(\w+)\}", QUESTIONS[kind])
    return F.concat(*[values[part].cast("string") if i % 2 else F.lit(part) for i, part in enumerate(parts) if part])


def offered(kind: Column) -> Column:
    """The answers offered for a finding type."""
    table = [F.lit(kind) if i == 0 else F.array(*[F.lit(o) for o in options]) for kind, options in OPTIONS.items() for i in (0, 1)]
    return F.create_map(*table)[kind]


def _finding(kind: str, check: str, base: str, amount: Column, texts: bool, values: dict[str, Column], **shown: Column) -> Column:
    """One finding struct; ``shown`` are the values of its question, which is left out without ``texts``."""
    null = F.lit(None)
    number = lambda name: values.get(name, null).cast("double").alias(name)
    words = [
        F.concat(priority_words(amount), _question(kind, **shown)).alias("question"),
        F.array(*[F.lit(o) for o in OPTIONS[kind]]).alias("options"),
    ]
    return F.struct(
        F.lit(kind).alias("finding_type"),
        F.lit(CHECK_ORDER[check]).alias("check_order"),
        severity(base, amount).alias("severity"),
        *[number(name) for name in ("diff", "diff_pct", "expected", "actual")],
        *(words if texts else []),
    )


def _plain(number: Column) -> Column:
    """A quantity as short text: no decimals when whole."""
    return F.regexp_replace(F.format_string("%.6f", number), r"\.?0+\z", "")


def _pct(share: Column) -> Column:
    # Through four decimals, so that the rounding does not meet binary fractions.
    tenths = F.floor((F.round(share * 10_000).cast("long") + 5) / 10)
    return F.format_string("%.1f", tenths / F.lit(10.0))


def invoice_findings(
    matched: DataFrame,
    row_id: str = "_row_id",
    receipts: bool = False,
    contracts: bool = False,
    texts: bool = True,
) -> DataFrame:
    """Findings of the row checks, one row per finding, from one pass over the matches.

    Every check is a CASE that yields a finding struct or NULL; the array of them
    is exploded, and NULLs are dropped.  So the match table is read once, whatever the number of checks.
    Without ``texts`` the questions and answers are not built (``with_texts`` adds
    them to the rows that are shown).
    """
    m = match_status(matched)
    amount = F.col("_amount")
    number = F.coalesce(null_if_blank(trim_all(text(m, "invoice_number"))), F.lit("UNKNOWN"))
    vendor = F.coalesce(null_if_blank(trim_all(text(m, "vendor_name"))), F.lit("Unknown Vendor"))
    currency = text(m, "currency")
    shown = money_text(amount, currency)
    po_amount = F.col("po.amount")
    out: list[Column] = []

    def check(when: Column, kind: str, order: str, base: str, values: dict[str, Column], **words: Column) -> None:
        out.append(F.when(when, _finding(kind, order, base, amount, texts, values, number=number, **words)))

    check(
        F.col("status") == "no_po_match", "no_po_match", "status", "High", {"actual": amount}, vendor=vendor, shown=shown
    )
    check(
        F.col("status") == "currency_mismatch", "currency_mismatch", "status", "High", {"expected": po_amount, "actual": amount},
        currency=F.coalesce("_currency", F.lit("an unspecified currency")),
        po_currency=F.coalesce("po.currency", F.lit("a different currency")),
    )
    check(
        F.col("status") == "amount_mismatch", "amount_mismatch", "status", "Medium",
        {"diff": F.col("amount_diff"), "diff_pct": F.col("amount_diff_pct"), "expected": po_amount, "actual": amount},
        shown=shown, po_shown=money_text(po_amount, F.col("po.currency")),
        off=plain_money_text(F.col("amount_diff")), share=_pct(F.col("amount_diff_pct")),
    )
    if "line_items" in m.columns or "_items_total" in m.columns:
        items = F.col("_items_total") if "_items_total" in m.columns else F.when(F.size("line_items") > 0, items_total(F.col("line_items")))
        expected = items + typed(m, "tax", money=False)
        off = F.abs(amount.cast("double") - expected)
        check(
            (items > 0) & (expected > 0) & (off * 100 > expected * TAX_PERCENT),
            "tax_discrepancy", "tax", "Medium", {"diff": off, "diff_pct": off / expected, "expected": expected, "actual": amount},
            expected=plain_money_text(expected, currency), shown=shown,
        )
    quantity = typed(m, "quantity", money=False)
    if receipts:
        got = F.col("po.received_quantity")
        po_key = match_key("po.po_number")
        known = F.col("po").isNotNull() & po_key.isNotNull() & quantity.isNotNull()
        off = F.abs(quantity - got)
        check(known & got.isNull(), "no_goods_receipt", "receipt", "Medium", {"actual": quantity}, po=po_key)
        check(
            known & (got > 0) & (off * 100 > got * QUANTITY_PERCENT), "quantity_mismatch", "receipt", "Medium",
            {"diff": off, "diff_pct": off / got, "expected": got, "actual": quantity},
            actual=_plain(quantity), expected=_plain(got), po=po_key, share=_pct(off / got),
        )
    if contracts:
        price = F.col("contract_price")
        actual = amount.cast("double") / quantity
        # Compared without the division: gap and limit both times the quantity.
        off = F.abs(amount.cast("double") - price * quantity)
        gap = F.abs(actual - price)
        check(
            (quantity != 0) & (amount != 0) & (price > 0) & (off * 100 > price * F.abs(quantity) * PRICE_PERCENT),
            "contract_price_variance", "contract", "Medium",
            {"diff": gap, "diff_pct": gap / price, "expected": price, "actual": actual},
            actual=plain_money_text(actual, currency), vendor=vendor, expected=plain_money_text(price, currency),
            share=_pct(gap / price),
        )

    found = m.select(
        F.col(row_id).alias("inv_row_id"),
        F.col("po.row_id").alias("po_row_id"),
        trim_all(text(m, "invoice_number")).alias("invoice_number"),
        trim_all(text(m, "vendor_name")).alias("vendor_name"),
        amount.alias("amount"),
        F.col("_currency").alias("currency"),
        F.array(*out).alias("_out"),
    )
    # All checks of a row are evaluated once, as compiled code: not in the explode, nor, as before an inner one, by a
    # filter on what is exploded.
    found = found.withColumn("f", F.explode_outer("_out")).filter("f is not null")
    return found.select(
        "inv_row_id", "po_row_id", "invoice_number", "vendor_name", "amount", "currency", "f.*",
        F.lit(None).cast("string").alias("group_key"),
        F.lit(1).cast("long").alias("group_rows"),
    )


FINDING_KEY = ("inv_row_id", "check_order", "finding_type", "group_key")


def with_texts(queue: DataFrame, findings: DataFrame) -> DataFrame:
    """Add ``question`` and ``options`` to rows of a queue that was built without texts.

    ``findings`` are the same run's findings with texts.  Meant for the rows that are shown, such as one page: a
    finding is told by its invoice row, check, type and group.
    """
    same = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    keys = [same(c).alias(f"_key_{c}") for c in FINDING_KEY]
    named = findings.select(*keys, "question", "options")
    columns = [c for c in queue.columns if c not in ("question", "options")]
    joined = queue.select(*columns, *keys).join(named, [f"_key_{c}" for c in FINDING_KEY], "left")
    return joined.select(*columns, "question", "options")


def duplicate_findings(invoices: DataFrame, row_id: str = "_row_id", texts: bool = True) -> DataFrame:
    """One finding per group of repeated invoice lines, under its first row; ``texts`` as for the row checks."""
    groups = duplicate_lines(invoices, row_id)
    words = [
        _question("duplicate_invoice", number=F.col("invoice_key"), copies=F.col("copies")).alias("question"),
        F.array(*[F.lit(o) for o in OPTIONS["duplicate_invoice"]]).alias("options"),
    ]
    return groups.select(
        F.col("first_row_id").alias("inv_row_id"),
        F.lit(None).cast(invoices.schema[row_id].dataType).alias("po_row_id"),
        F.col("invoice_key").alias("invoice_number"),
        F.lit(None).cast("string").alias("vendor_name"),
        F.lit(None).cast("decimal(18,2)").alias("amount"),
        F.lit(None).cast("string").alias("currency"),
        F.lit("duplicate_invoice").alias("finding_type"),
        F.lit(CHECK_ORDER["duplicate"]).alias("check_order"),
        F.lit("High").alias("severity"),
        *[F.lit(None).cast("double").alias(c) for c in ("diff", "diff_pct", "expected", "actual")],
        *(words if texts else []),
        F.col("line_key").alias("group_key"),
        F.col("copies").alias("group_rows"),
    )


def near_duplicate_findings(near: DataFrame, invoices: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """One finding per link of ``near_duplicates``: an invoice and the one it repeats.

    An invoice whose only partners come later has no link of its own; it is the
    other end of theirs.
    """
    links = near.filter(F.col("linked_row_id").isNotNull())
    shown = invoices.select(
        F.col(row_id), trim_all(text(invoices, "vendor_name")).alias("vendor_name"),
        currency_code(text(invoices, "currency")).alias("currency"),
    )
    return links.join(shown, row_id).select(
        F.col(row_id).alias("inv_row_id"),
        F.col("linked_row_id").alias("other_row_id"),
        F.lit("near_duplicate").alias("finding_type"),
        F.lit("Medium").alias("severity"),
        "partners",
        _question(
            "near_duplicate", vendor=F.col("vendor_name"), days=F.col("linked_days"),
            amount=F.concat(F.col("bucket_amount").cast("string"), F.coalesce(F.concat(F.lit(" "), F.col("currency")), F.lit(""))),
        ).alias("question"),
    )

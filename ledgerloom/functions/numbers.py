"""Number and money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import col_of, match_key, trim_all

MONEY = "decimal(18,2)"

# Amounts from which wording and severity change.
HIGH_AMOUNT = 10_000
MEDIUM_AMOUNT = 1_000


def _stripped(c: Column | str) -> Column:
    text = F.regexp_replace(col_of(c).cast("string"), r"[^0-9.\-]", "")
    return F.nullif(text, F.lit(""))


def parse_number(c: Column | str) -> Column:
    """Everything but digits, dot and minus dropped; NULL when no number is left."""
    return _stripped(c).try_cast("double")


def parse_money(c: Column | str) -> Column:
    """Like ``parse_number`` but exact, in cents."""
    return _stripped(c).try_cast(MONEY)


def number_prefix(c: Column | str) -> Column:
    """The number a text starts with (``12abc`` -> 12), NULL when there is none."""
    head = F.regexp_extract(
        trim_all(col_of(c).cast("string")),
        r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?",
        0,
    )
    return F.nullif(head, F.lit("")).try_cast("double")


def amount_key(c: Column | str) -> Column:
    """Amount for near-duplicate buckets: commas dropped, number prefix, two decimals."""
    return number_prefix(F.regexp_replace(col_of(c).cast("string"), ",", "")).try_cast(MONEY)


def is_integer_text(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), ",", "").rlike(r"\A\s*[+-]?[0-9]+\s*\z")


def is_float_text(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), "[,$₹€£]", "").rlike(
        r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*\z"
    )


def money_text(amount: Column, currency: Column | str, default: str = "USD") -> Column:
    """``USD 1,234.50``; N/A when there is no amount."""
    code = F.coalesce(F.nullif(trim_all(col_of(currency)), F.lit("")), F.lit(default))
    return F.when(
        amount.isNotNull(),
        trim_all(F.concat(code, F.lit(" "), F.format_number(amount.cast("decimal(18,2)"), 2))),
    ).otherwise(F.lit("N/A"))


def plain_money_text(amount: Column, currency: Column | None = None) -> Column:
    """Like ``money_text`` but with no default currency in front."""
    text = F.format_number(amount.cast("decimal(18,2)"), 2)
    if currency is not None:
        text = F.concat_ws(" ", match_key(currency), text)
    return F.when(amount.isNotNull(), text).otherwise(F.lit("N/A"))


def priority_words(amount: Column) -> Column:
    return (
        F.when(amount >= HIGH_AMOUNT, F.lit("High-value — "))
        .when(amount >= MEDIUM_AMOUNT, F.lit("Medium-value — "))
        .otherwise(F.lit(""))
    )


def severity(base: str, amount: Column) -> Column:
    """Base severity, raised to High for large amounts, never lowered."""
    return F.when(amount >= HIGH_AMOUNT, F.lit("High")).otherwise(F.lit(base))


def half_up(numerator: Column, denominator: Column, scale: int) -> Column:
    """``numerator / denominator`` of non-negative whole numbers, rounded half up.

    Whole-number arithmetic, so the result does not depend on binary fractions.
    """
    whole = "decimal(38,0)"
    top = (numerator * (2 * 10**scale) + denominator).cast(whole)
    under = (denominator * 2).cast(whole)
    # The remainder goes first: dividing decimals directly would round the quotient.
    return ((top - top % under) / under).cast("double") / F.lit(float(10**scale))


def cents(amount: Column) -> Column:
    """Money as a whole number of cents."""
    return (amount * 100).cast("decimal(20,0)")


def percent(part: Column, total: Column) -> Column:
    """Share in percent with one decimal; 0 for an empty total."""
    return F.when(total == 0, F.lit(0.0)).otherwise(half_up(part * 100, total, 1))

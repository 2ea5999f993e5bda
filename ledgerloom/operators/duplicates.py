"""Repeated rows, repeated invoice lines and numbers, near-duplicates.

Groups are reported in long form (one row per member with its group key), never
as one collected list, so a group may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import (
    business_columns, currency_code, match_key, null_if_blank, row_fingerprint, vendor_key_b,
)
from ledgerloom.session import cut_lineage

NEAR_DAYS = 7
NO_CURRENCY = "__NOCURRENCY__"


# --- whole rows -------------------------------------------------------------


def exact_duplicate_groups(df: DataFrame, row_id: str = "_row_id", columns: list[str] | None = None) -> DataFrame:
    """One row per group of equal rows: fingerprint, member count, first member."""
    columns = columns or business_columns(df)
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_copies"), F.min(row_id).alias("_first"))
        .filter("_copies > 1")
        .select(
            row_fingerprint(columns).alias("row_hash"),
            F.col("_copies").alias("copies"),
            F.col("_first").alias("first_row_id"),
        )
    )


def exact_duplicate_members(df: DataFrame, row_id: str = "_row_id", columns: list[str] | None = None) -> DataFrame:
    """One row per member of those groups, with its group's fingerprint and size."""
    columns = columns or business_columns(df)
    # Fingerprints are made and written once; the wide rows are not shuffled.
    hashed = cut_lineage(df.select(F.col(row_id), row_fingerprint(columns).alias("row_hash")))
    groups = (
        hashed.groupBy("row_hash")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_row_id"))
        .filter("copies > 1")
    )
    return (
        hashed.join(groups, "row_hash")
        .select("row_hash", row_id, "copies", (F.col(row_id) == F.col("first_row_id")).alias("is_first"))
    )


def exact_duplicate_count(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: all rows, groups with repeats, rows beyond the first of each group."""
    columns = columns or business_columns(df)
    return (
        df.groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_rows"),
            F.count_if(F.col("_copies") > 1).alias("groups"),
            F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("excess_rows"),
        )
    )


# --- invoice lines and numbers ----------------------------------------------


def with_line_key(invoices: DataFrame) -> DataFrame:
    """Add ``_number_key`` and ``_line_key`` (number key and content of the line)."""
    data = [c for c in business_columns(invoices)]
    return invoices.withColumn("_number_key", match_key("invoice_number")).withColumn(
        "_line_key", F.when(F.col("_number_key").isNotNull(), row_fingerprint(data))
    )


def duplicate_lines(invoices: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """Same line more than once under one invoice number: one row per group."""
    return (
        with_line_key(invoices)
        .filter(F.col("_number_key").isNotNull())
        # The key as 16 bytes, not as 32 digits, while it is shuffled.
        .groupBy("_number_key", F.unhex("_line_key").alias("_line"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_row_id"))
        .filter("copies > 1")
        .select(
            F.col("_number_key").alias("invoice_key"),
            F.lower(F.hex("_line")).alias("line_key"),
            "copies",
            "first_row_id",
        )
    )


def duplicate_line_members(invoices: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """One row per member of ``duplicate_lines``."""
    groups = duplicate_lines(invoices, row_id)
    return (
        with_line_key(invoices)
        .join(groups, F.col("_line_key") == F.col("line_key"))
        .select("invoice_key", "line_key", F.col(row_id), "copies",
                (F.col(row_id) == F.col("first_row_id")).alias("is_first"))
    )


def duplicate_numbers(
    invoices: DataFrame, row_id: str = "_row_id", skip_generated: bool = False
) -> DataFrame:
    """Invoice numbers (case-blind) that occur more than once, most frequent first.

    ``skip_generated`` leaves out every number that starts with ``INV-``, the
    form of numbers made up for rows without one.
    """
    number = F.lower(match_key("invoice_number"))
    keyed = invoices.select(number.alias("invoice_key"), F.col(row_id)).filter("invoice_key is not null")
    if skip_generated:
        keyed = keyed.filter(~F.col("invoice_key").startswith("inv-"))
    return (
        keyed.groupBy("invoice_key")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(row_id).alias("first_row_id"))
        .filter("copies > 1")
        .orderBy(F.col("copies").desc(), F.col("invoice_key"))
    )


# --- near-duplicates --------------------------------------------------------


def _near_keyed(invoices: DataFrame, row_id: str) -> DataFrame:
    """Rows that can have a near-duplicate, with their bucket and day number.

    ``amount`` is the parsed amount and ``invoice_date`` the invoice's date.
    """
    return invoices.select(
        F.col(row_id),
        vendor_key_b("vendor_name").alias("vendor_key"),
        F.col("amount").alias("bucket_amount"),
        currency_code("currency", NO_CURRENCY).alias("bucket_currency"),
        F.unix_date("invoice_date").alias("day"),
    ).filter(
        null_if_blank("vendor_name").isNotNull()
        & F.col("amount").isNotNull()
        & F.col("invoice_date").isNotNull()
    )


_BUCKET = ["vendor_key", "bucket_amount", "bucket_currency"]


def near_duplicate_days(invoices: DataFrame, row_id: str = "_row_id", days: int = NEAR_DAYS) -> DataFrame:
    """One row per bucket and day: rows, partners within ``days`` on either side, anchor.

    Rows are counted per (bucket, day) before any window, so the windows see at
    most one row per calendar day, however many invoices a bucket holds.  Pairs
    are counted, not formed.

    ``anchor_row_id`` is the first row of the day; ``link_row_id`` the first row
    of the closest earlier day within reach (NULL when there is none).
    """
    return _keyed_days(_near_keyed(invoices, row_id), row_id, days)


def _keyed_days(keyed: DataFrame, row_id: str, days: int) -> DataFrame:
    daily = keyed.groupBy(*_BUCKET, "day").agg(F.count(F.lit(1)).alias("rows"), F.min(row_id).alias("anchor_row_id"))
    part = Window.partitionBy(*_BUCKET).orderBy("day")
    before = F.coalesce(F.sum("rows").over(part.rangeBetween(-days, -1)), F.lit(0))
    after = F.coalesce(F.sum("rows").over(part.rangeBetween(1, days)), F.lit(0))
    last_day, last_anchor = F.lag("day").over(part), F.lag("anchor_row_id").over(part)
    return daily.select(
        *_BUCKET,
        "day",
        "rows",
        "anchor_row_id",
        before.alias("rows_before"),
        after.alias("rows_after"),
        F.when(F.col("day") - last_day <= days, last_anchor).alias("link_row_id"),
        F.when(F.col("day") - last_day <= days, F.col("day") - last_day).alias("link_days"),
    ).withColumn(
        # Pairs inside the day plus pairs with the days before; summed over days each pair counts once.
        "pairs",
        F.floor(F.col("rows") * (F.col("rows") - 1) / 2) + F.col("rows") * F.col("rows_before"),
    )


def near_duplicates(invoices: DataFrame, row_id: str = "_row_id", days: int = NEAR_DAYS) -> DataFrame:
    """One row per invoice that has a near-duplicate.

    ``partners`` is the number of invoices with the same vendor key, amount and
    currency at most ``days`` apart.  ``linked_row_id`` names one of them: the
    first of the same day, or for that first one the first of the closest earlier
    day (NULL for the earliest of a chain).  Following the links joins exactly
    the invoices that a list of all pairs would join.
    """
    # Keys are made and written once, for the counts and for the rows.
    keyed = cut_lineage(_near_keyed(invoices, row_id))
    daily = _keyed_days(keyed, row_id, days).filter(
        (F.col("rows") > 1) | (F.col("rows_before") + F.col("rows_after") > 0)
    )
    first = F.col(row_id) == F.col("anchor_row_id")
    return keyed.join(daily, [*_BUCKET, "day"]).select(
        F.col(row_id),
        *_BUCKET,
        (F.col("rows") - 1 + F.col("rows_before") + F.col("rows_after")).alias("partners"),
        (F.col("rows_before") + F.col("rows") - 1).alias("partners_up_to_day"),
        F.when(first, F.col("link_row_id")).otherwise(F.col("anchor_row_id")).alias("linked_row_id"),
        F.when(first, F.col("link_days")).otherwise(F.lit(0)).alias("linked_days"),
    )


def near_duplicate_buckets(invoices: DataFrame, row_id: str = "_row_id", days: int = NEAR_DAYS) -> DataFrame:
    """Exact number of near-duplicate pairs and of invoices involved, per bucket."""
    return (
        near_duplicate_days(invoices, row_id, days)
        # Days without a pair add nothing; buckets without one need not be added up.
        .filter((F.col("rows") > 1) | (F.col("rows_before") + F.col("rows_after") > 0))
        .groupBy(*_BUCKET)
        .agg(F.sum("pairs").alias("pairs"), F.sum("rows").alias("invoices"))
        .filter("pairs > 0")
    )


def affected_invoices(invoices: DataFrame, row_id: str = "_row_id") -> DataFrame:
    """One row: distinct invoices in any repeated-number group or near-duplicate pair."""
    numbers = invoices.select(F.lower(match_key("invoice_number")).alias("invoice_key"), F.col(row_id)).join(
        duplicate_numbers(invoices, row_id).select("invoice_key"), "invoice_key", "left_semi"
    )
    members = numbers.select(row_id).unionAll(near_duplicates(invoices, row_id).select(row_id))
    return members.agg(F.count_distinct(row_id).alias("affected_invoices"))

"""Schema checks, post-clean checks, step guards and status transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import percent
from ledgerloom.functions.text import business_columns, is_blank, trim_all
from ledgerloom.operators.blocks import previous_in_group
from ledgerloom.operators.cleaning import Step
from ledgerloom.operators.duplicates import exact_duplicate_count
from ledgerloom.operators.profile import leading_values
from ledgerloom.plans.steps import step_name

# Field groups that invoices must have, with the accepted names.
REQUIRED_GROUPS = {
    "Invoice identifier": ("invoice_number", "invoicenumber", "invoice_no", "inv_no", "invoice_#"),
    "Vendor / Supplier": ("vendor_name", "vendorname", "vendor", "supplier", "supplier_name"),
    "Amount / Total": ("amount", "total", "invoiceamount", "invoice_amount", "total_amount"),
}
# Allowed next status of each status.
NEXT_STATUS = {
    "building": ("ready", "failed"),
    "ready": ("executing", "building", "failed"),
    "executing": ("complete", "failed"),
    "complete": (),
    "failed": ("building",),
}


def _has_segments(column: str, alias: str) -> bool:
    have = [p for p in column.split("_") if p]
    want = [p for p in alias.replace(" ", "_").split("_") if p]
    return bool(want) and any(have[i : i + len(want)] == want for i in range(len(have)))


def required_groups(spark: SparkSession, columns: list[str]) -> DataFrame:
    """One row per required field group: is it there, and under which column."""
    lowered = {c: "".join(ch if ch.isascii() and (ch.isalnum() or ch == "_") else "_" for ch in c.lower()) for c in columns}
    rows = []
    for label, aliases in REQUIRED_GROUPS.items():
        hit = next(
            (c for a in aliases for c, low in lowered.items() if low == a or _has_segments(low, a)),
            None,
        )
        rows.append((label, hit is not None, hit))
    return spark.createDataFrame(rows, "field_group string, found boolean, column string")


def column_report(profiled: DataFrame, generic: bool = False) -> DataFrame:
    """Quality word and warnings per column of a profile."""
    limit = 80 if generic else 50
    words = "Very high null rate: " if generic else "High null rate: "
    warn = [
        F.when(
            F.col("null_pct") > limit,
            F.concat(F.lit(words), F.col("null_pct").cast("string"), F.lit("%")),
        ),
        F.when(
            (F.col("unique_count") == 1) & (F.col("null_pct") < 100),
            F.lit("All non-null values are identical — may be a constant column"),
        ),
    ]
    if not generic:
        warn.insert(1, F.when(F.col("type") == "unknown", F.lit("Could not infer column type")))
    return profiled.select(
        "column",
        "type",
        "null_pct",
        F.when(F.col("null_pct") > 50, "poor")
        .when((F.col("null_pct") > 20) | (F.col("type") == "unknown"), "fair")
        .otherwise("good")
        .alias("quality"),
        F.concat_ws("; ", *warn).alias("warnings"),
    )


def repeated_names(names: list[str]) -> list[str]:
    """Column names that occur again after their first place, in order."""
    return [n for i, n in enumerate(names) if n in names[:i]]


def check_clean(
    df: DataFrame, types: dict[str, str] | None = None, row_id: str = "_row_id"
) -> DataFrame:
    """Problems left after cleaning, one row per problem; no row means clean.

    ``types`` gives the profile label per column; numbers and dates are checked
    for columns labelled so.  All cell counts come from one aggregation.
    """
    columns = business_columns(df)
    types = types or {}
    tests: list[tuple[str, str, object]] = []
    for c in columns:
        tests.append((c, "remaining_nulls", is_blank(c)))
        text = F.regexp_replace(trim_all(F.col(c).cast("string")), r"[,$\s]", "")
        if types.get(c) in ("integer", "float"):
            number = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
            tests.append((c, "invalid_number", ~is_blank(c) & ~text.rlike(number) & (text != "")))
        if types.get(c) == "date":
            tests.append((c, "invalid_date", ~is_blank(c) & _parsed_date(c).isNull()))
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(test).alias(f"t{i}") for i, (_, _, test) in enumerate(tests)],
    )
    found = F.array(
        F.struct(
            F.lit(None).cast("string").alias("column"),
            F.lit("empty_dataset").alias("problem"),
            F.when(F.col("rows") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("count"),
        ),
        *[
            F.struct(
                F.lit(c).alias("column"), F.lit(kind).alias("problem"), F.col(f"t{i}").alias("count")
            )
            for i, (c, kind, _) in enumerate(tests)
        ],
    )
    cells = counted.select(F.inline(found))
    repeats = exact_duplicate_count(df, columns).select(
        F.lit(None).cast("string").alias("column"),
        F.lit("duplicate_rows").alias("problem"),
        F.col("excess_rows").alias("count"),
    )
    return (
        cells.unionByName(repeats)
        .filter("count > 0")
        .withColumn("count", F.when(F.col("problem") == "empty_dataset", F.lit(0)).otherwise(F.col("count")))
    )


def _parsed_date(c: str):
    """A date the way a script engine reads it: year first, or month before day."""
    text = trim_all(F.col(c).cast("string"))
    us = r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"
    turned = F.concat_ws(
        "-",
        F.regexp_extract(text, us, 3),
        F.lpad(F.regexp_extract(text, us, 1), 2, "0"),
        F.lpad(F.regexp_extract(text, us, 2), 2, "0"),
    )
    iso = F.when(text.rlike(us), turned).otherwise(F.substring(text, 1, 10))
    m = F.substring(iso, 6, 2).try_cast("int")
    d = F.substring(iso, 9, 2).try_cast("int")
    # Days past the end of a short month roll over there, so only 1..31 is asked for.
    ok = iso.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, iso)


def invalid_samples(
    df: DataFrame, column: str, kind: str, row_id: str = "_row_id", n: int = 3
) -> DataFrame:
    """The first ``n`` offending values of a number or date column."""
    text = F.regexp_replace(trim_all(F.col(column).cast("string")), r"[,$\s]", "")
    if kind == "date":
        bad = _parsed_date(column).isNull()
    else:
        bad = ~text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    return leading_values(df.filter(~is_blank(column) & bad).select(row_id, column), row_id, n, [column])


def guard_steps(steps: list[Step], profiled: DataFrame, issues: DataFrame) -> DataFrame:
    """Steps that need a second look, and heavy issues that no such step covers.

    The steps are a handful of plan-time records, so they become CASE branches
    over the profile instead of a join.
    """
    nulls, total = F.col("null_count"), F.col("total_count")
    guard = lambda test, name, severity, action, n: F.when(
        test,
        F.struct(F.lit(name).alias("guard"), F.lit(severity).alias("severity"), F.lit(action).alias("action"), n.alias("affected_count")),
    )
    found = []
    for s in steps:
        action, mine = step_name(s.action), F.col("column") == s.column
        if action == "removeNulls":
            found.append(guard(mine & (total > 0) & (nulls / total > 0.15), "large_deletion", "High", action, nulls))
        elif action == "dropColumn":
            found.append(guard(mine & (total - nulls > 0), "drop_non_empty_column", "Medium", action, total - nulls))
    heavy = issues.filter((F.col("severity") == "High") & (F.col("affected_pct") > 20)).select(
        "column", F.col("affected_count").alias("_heavy")
    )
    # One row per column on both sides, so each is read once.
    both = profiled.select("column", "null_count", "total_count").join(heavy, "column", "full")
    guards = F.array_compact(F.array(*found)) if found else None
    rest = guard(F.col("_heavy").isNotNull(), "high_impact_issue", "High", None, F.col("_heavy"))
    every = F.when(F.size(guards) > 0, guards).otherwise(F.array_compact(F.array(rest))) if found else F.array_compact(F.array(rest))
    return both.select("column", F.explode(every).alias("g")).select("g.guard", "g.severity", "g.action", "column", "g.affected_count")


def bad_transitions(
    log: DataFrame, key: str, order: list[str], block, status: str = "status"
) -> DataFrame:
    """Status changes that the status table does not allow.

    A first entry must be ``building``; ``block`` splits long histories (see
    ``previous_in_group``).
    """
    seen = previous_in_group(log, [key], order, block, [status])
    prev, now = F.col(f"prev_{status}"), F.col(status)
    allowed = F.lit(False)
    for before, after in NEXT_STATUS.items():
        if after:
            allowed = allowed | ((prev == before) & now.isin(*after))
    allowed = F.when(prev.isNull(), now == "building").otherwise(allowed)
    return seen.filter(~allowed)

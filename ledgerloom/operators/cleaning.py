"""Cleaning steps: each is a function DataFrame -> DataFrame with eager schema checks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.dates import layout_date, read_date_cell
from ledgerloom.functions.numbers import number_prefix
from ledgerloom.functions.text import collapse_spaces, is_blank, title_case, trim_all
from ledgerloom.operators.stats import exact_mean, exact_median, exact_mode

ROW_ID = "_row_id"


class StepError(ValueError):
    """A step that cannot be planned on the given columns."""


@dataclass
class Step:
    action: str
    column: str | None = None
    parameters: dict[str, Any] = field(default_factory=dict)
    status: str = "confirmed"


def _need(df: DataFrame, column: str | None, action: str) -> str:
    if not column:
        raise StepError(f"{action} needs a column")
    if column not in df.columns:
        raise StepError(f"{action}: column {column!r} does not exist")
    return column


def _with(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, value)


# --- rows out ---------------------------------------------------------------


def remove_nulls(df: DataFrame, column: str) -> DataFrame:
    """Drop rows whose cell is blank."""
    return df.filter(~is_blank(_need(df, column, "removeNulls")))


def dedup_exact(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Keep the first of equal whole rows.

    One hash aggregation on the data columns; equal rows are merged before the
    shuffle, so many copies of one row cost nothing extra.
    """
    data = [c for c in df.columns if c != row_id]
    return df.groupBy(*data).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def dedup_subset(df: DataFrame, columns: list[str], row_id: str = ROW_ID) -> DataFrame:
    """Keep the first row per key, where first means the smallest row id."""
    if not columns:
        raise StepError("deduplicate by subset needs columns")
    for c in columns:
        _need(df, c, "deduplicate")
    rest = [c for c in df.columns if c not in columns]
    first = F.min_by(F.struct(*rest), F.col(row_id)).alias("_first")
    kept = df.groupBy(*columns).agg(first)
    return kept.select(
        *[F.col(c) if c in columns else F.col("_first")[c].alias(c) for c in df.columns]
    )


NUMBER_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def row_test(column: str, operator: str, value: Any = None) -> Column:
    """Predicate of the filter step; NULL where a number test meets no number."""
    cell = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    want = F.lit(None if value is None else str(value))
    if operator == "eq":
        return cell == want
    if operator == "neq":
        return cell != want
    if operator == "ieq":
        return F.lower(cell) == F.lower(want)
    if operator == "ineq":
        return F.lower(cell) != F.lower(want)
    if operator == "contains":
        return F.contains(F.lower(cell), F.lower(want))
    if operator == "is_null":
        return is_blank(column)
    if operator == "not_null":
        return ~is_blank(column)
    if operator in NUMBER_TESTS:
        return NUMBER_TESTS[operator](number_prefix(F.col(column)), number_prefix(want))
    raise StepError(f"filterRows: unknown operator {operator!r}")


def filter_rows(
    df: DataFrame, column: str, operator: str, value: Any = None, strict_numeric: bool = True
) -> DataFrame:
    """Keep rows that pass; a cell without a number fails the job when strict, else the row goes."""
    _need(df, column, "filterRows")
    test = row_test(column, operator, value)
    if operator not in NUMBER_TESTS:
        return df.filter(test)
    if not strict_numeric:
        return df.filter(F.coalesce(test, F.lit(False)))
    shown = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    message = F.concat(F.lit(f"filterRows: non-numeric value for {operator} in {column}: "), shown)
    return df.filter(F.when(test.isNull(), F.raise_error(message).cast("boolean")).otherwise(test))


def filter_report(df: DataFrame, column: str, operator: str, value: Any = None) -> DataFrame:
    """One row: rows kept, removed by the test, and skipped for want of a number."""
    test = row_test(column, operator, value)
    return df.agg(
        F.count_if(F.coalesce(test, F.lit(False))).alias("kept"),
        F.count_if(~test).alias("removed"),
        F.count_if(test.isNull()).alias("parse_errors"),
    )


# --- cells changed ----------------------------------------------------------


def fill_missing(
    df: DataFrame, column: str, method: str, value: Any = None, row_id: str = ROW_ID
) -> DataFrame:
    """Fill blank cells with one value.

    Computed values arrive as an uncorrelated scalar subquery: Spark runs the
    aggregation once and plans the fill as a plain projection.
    """
    _need(df, column, "fillMissing")
    kind = df.schema[column].dataType
    if method == "custom":
        if value is None:
            raise StepError("fillMissing by custom needs a value")
        fill = F.lit(value)
    elif method == "zero":
        fill = F.lit(0)
    elif method == "empty_string":
        fill = F.lit("")
    elif method == "mean":
        fill = exact_mean(df, column).scalar()
    elif method == "median":
        fill = exact_median(df, column).scalar()
    elif method == "mode":
        fill = F.coalesce(
            exact_mode(df, column, row_id).scalar().cast(kind),
            F.raise_error(F.lit(f"column {column} has no values")).cast(kind),
        )
    else:
        raise StepError(f"fillMissing: unknown method {method!r}")
    if method in ("mean", "median") and kind.simpleString() == "string":
        # A whole number is written without its ".0" in a text column.
        fill = F.regexp_replace(fill.cast("string"), r"\.0\z", "")
    return _with(df, column, F.when(is_blank(column), fill.cast(kind)).otherwise(F.col(column)))


def format_dates(df: DataFrame, column: str, target: str, policy: str = "flag") -> DataFrame:
    """Rewrite readable dates in one layout; everything else stays as it is."""
    _need(df, column, "formatDates")
    cell = read_date_cell(column, policy)
    ok = cell["status"] == "ok"
    return _with(df, column, F.when(ok, layout_date(cell, target)).otherwise(F.col(column)))


def date_report(df: DataFrame, column: str, target: str, policy: str = "flag") -> DataFrame:
    """One row: cells rewritten, unreadable, and left for their ambiguous order."""
    cell = read_date_cell(column, policy)
    work = df.select(
        F.col(column).alias("raw"), cell["status"].alias("s"), layout_date(cell, target).alias("t")
    )
    return work.agg(
        F.count_if((F.col("s") == "ok") & (F.col("t") != F.col("raw"))).alias("formatted"),
        F.count_if(F.col("s") == "failed").alias("failed"),
        F.count_if(F.col("s") == "ambiguous").alias("ambiguous"),
    )


def trim_whitespace(df: DataFrame, column: str, collapse: bool = False) -> DataFrame:
    _need(df, column, "trimWhitespace")
    if df.schema[column].dataType.simpleString() != "string":
        return df
    cell = trim_all(column)
    return _with(df, column, collapse_spaces(cell) if collapse else cell)


def standardize_case(df: DataFrame, column: str, mode: str, skip_non_string: bool = False) -> DataFrame:
    _need(df, column, "standardizeCase")
    change = {"lower": F.lower, "upper": F.upper, "title": title_case}.get(mode)
    if change is None:
        raise StepError("standardizeCase: mode must be lower, upper or title")
    if df.schema[column].dataType.simpleString() != "string":
        if skip_non_string:
            return df
        raise StepError(f"standardizeCase: column {column!r} is not text")
    return _with(df, column, change(F.col(column)))


def replace_values(df: DataFrame, column: str, find: Any, replace: Any, strict: bool = True) -> DataFrame:
    """Equal cells replaced; strict also wants the same type, loose compares as text."""
    _need(df, column, "replaceValues")
    cell, kind = F.col(column), df.schema[column].dataType
    number = kind.simpleString() not in ("string", "boolean", "date", "timestamp")
    same_type = (
        isinstance(find, bool) and kind.simpleString() == "boolean"
        or isinstance(find, str) and kind.simpleString() == "string"
        or isinstance(find, (int, float)) and not isinstance(find, bool) and number
        or find is None
    )
    if isinstance(find, float) and find != find:
        hit = F.isnan(cell) if kind.simpleString() in ("double", "float") else F.lit(False)
    elif same_type:
        hit = cell.eqNullSafe(F.lit(find))
    elif strict:
        return df
    else:
        hit = cell.cast("string").eqNullSafe(F.lit(str(find)))
    return _with(df, column, F.when(hit, F.lit(replace).cast(kind)).otherwise(cell))


# --- columns ----------------------------------------------------------------


def rename_column(df: DataFrame, column: str, new_name: str) -> DataFrame:
    _need(df, column, "renameColumn")
    if not new_name or not str(new_name).strip():
        raise StepError("renameColumn needs a new name")
    if new_name == column:
        return df
    if new_name in df.columns:
        raise StepError(f"renameColumn: column {new_name!r} already exists")
    return df.withColumnRenamed(column, new_name)


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(_need(df, column, "dropColumn"))


def flag_for_review(df: DataFrame, column: str | None) -> DataFrame:
    """Mark rows whose cell is blank; without a column every row is marked."""
    blank = is_blank(column) if column else F.lit(True)
    return df.withColumns(
        {
            "_review_flag": F.when(blank, F.lit("FLAGGED")),
            "_review_column": F.when(blank, F.lit(column)),
        }
    )


def keep_as_is(df: DataFrame) -> DataFrame:
    return df


def stamp_instruction(df: DataFrame, instruction: str = "custom") -> DataFrame:
    return df.withColumn("_custom_instruction", F.lit(instruction))

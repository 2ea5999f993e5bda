"""Column profiles and the issues read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_layout, is_date_text
from ledgerloom.functions.numbers import is_float_text, is_integer_text, percent
from ledgerloom.functions.text import business_columns, is_blank
from ledgerloom.operators.blocks import first_rows_per_key
from ledgerloom.operators.duplicates import exact_duplicate_count

# Values the original looks at, for ``strict_reference``.
STRICT_LABEL_ROWS = 100
STRICT_LAYOUT_ROWS = 200
SAMPLES = 3


def _cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long form: one row per cell (``column``, ``value`` as text)."""
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
            for c in columns
        ]
    )
    return df.select(F.inline(pairs))


def _shares(weight) -> list:
    """Sums of ``weight`` over the values of each kind, and the date layouts met."""
    among = lambda test: F.coalesce(F.sum(F.when(test, weight)), F.lit(0))
    return [
        among(is_date_text("value")).alias("dates"),
        among(is_integer_text("value")).alias("integers"),
        among(is_float_text("value")).alias("floats"),
        # At most as many members as there are layout names.
        F.array_sort(F.collect_set(date_layout("value"))).alias("layouts"),
    ]


def _labelled(facts: DataFrame) -> DataFrame:
    """Type label of each column from the shares of its values: date, integer, float or string."""
    filled = F.col("total_count") - F.col("null_count")
    return facts.withColumn(
        "type",
        F.when(filled == 0, "unknown")
        .when(F.col("dates") / filled > 0.7, "date")
        .when(F.col("integers") / filled > 0.8, "integer")
        .when(F.col("floats") / filled > 0.7, "float")
        .otherwise("string"),
    ).drop("dates", "integers", "floats")


def column_facts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """total, blank and distinct counts, type label and date layouts per column, in one pass over all cells.

    Exact form: cells are counted per (column, value) first, before the shuffle
    on the map side; labels and layouts are then read off the distinct values,
    weighted by their counts.  ``approx`` replaces the value shuffle by one
    sketch per column and looks at every cell where it is read.
    """
    columns = columns or business_columns(df)
    cells = _cells(df, columns).withColumn("value", F.when(~is_blank("value"), F.col("value")))
    if approx:
        return _labelled(
            cells.groupBy("column").agg(
                F.count(F.lit(1)).alias("total_count"),
                F.count_if(F.col("value").isNull()).alias("null_count"),
                F.approx_count_distinct("value").alias("unique_count"),
                *_shares(F.lit(1)),
            )
        )
    per_value = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return _labelled(
        per_value.groupBy("column").agg(
            F.sum("n").alias("total_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("unique_count"),
            *_shares(F.col("n")),
        )
    )


def column_counts(df: DataFrame, columns: list[str] | None = None, approx: bool = False) -> DataFrame:
    """total, blank and distinct counts per column."""
    return column_facts(df, columns, approx).select("column", "total_count", "null_count", "unique_count")


def leading_values(
    df: DataFrame, row_id: str, n: int, columns: list[str] | None = None
) -> DataFrame:
    """The first ``n`` non-blank values of each column in row order, from one scan.

    Cells are spread by row before they are ranked (``first_rows_per_key``), and
    ranks over ``n`` are dropped before each shuffle, so a task passes on few.
    """
    columns = columns or business_columns(df)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = df.select(F.col(row_id).alias("_at"), F.explode(pairs).alias("c")).select("c.column", "_at", "c.value")
    return first_rows_per_key(cells.filter(~is_blank("value")), ["column"], [F.col("_at")], n)


def _strict(facts: DataFrame, df: DataFrame, row_id: str, columns: list[str]) -> DataFrame:
    """Labels from the first 100 and layouts from the first 200 values, as the original has them."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy("_at"))
    heads = leading_values(df, row_id, STRICT_LAYOUT_ROWS, columns).withColumn("_rank", rank)
    few = F.col("_rank") <= STRICT_LABEL_ROWS
    share = lambda test: F.avg(F.when(few, F.when(test, 1.0).otherwise(0.0)))
    seen = heads.groupBy("column").agg(
        F.when(share(is_date_text("value")) > 0.7, "date")
        .when(share(is_integer_text("value")) > 0.8, "integer")
        .when(share(is_float_text("value")) > 0.7, "float")
        .otherwise("string")
        .alias("type"),
        F.array_sort(F.collect_set(date_layout("value"))).alias("layouts"),
    )
    return facts.drop("type", "layouts").join(seen, "column", "left").withColumn("type", F.coalesce("type", F.lit("unknown")))


def profile(
    df: DataFrame, row_id: str = "_row_id", columns: list[str] | None = None, approx: bool = False,
    strict_reference: bool = False,
) -> DataFrame:
    """One row per column: label, blank count and share, distinct count, first samples.

    The label comes from all values; ``strict_reference`` looks at the first ones only.
    """
    columns = columns or business_columns(df)
    facts = column_facts(df, columns, approx)
    if strict_reference:
        facts = _strict(facts, df, row_id, columns)
    heads = leading_values(df, row_id, SAMPLES, columns).groupBy("column").agg(
        # At most SAMPLES values per column reach this point.
        F.array_sort(F.collect_list(F.struct("_at", "value")))["value"].alias("sample")
    )
    return facts.join(heads, "column", "left").select(
        "column",
        "type",
        "null_count",
        percent(F.col("null_count"), F.col("total_count")).alias("null_pct"),
        "unique_count",
        F.coalesce("sample", F.array().cast("array<string>")).alias("sample"),
        "total_count",
    )


def issue_severity(pct: str):
    return (
        F.when(F.col(pct) > 10, "High").when(F.col(pct) > 3, "Medium").otherwise("Low")
    )


def missing_issues(counts: DataFrame) -> DataFrame:
    """Columns with blanks, graded by their share."""
    return (
        counts.filter("null_count > 0")
        .withColumn("affected_pct", percent(F.col("null_count"), F.col("total_count")))
        .select(
            F.lit("missing").alias("issue"),
            "column",
            issue_severity("affected_pct").alias("severity"),
            F.col("null_count").alias("affected_count"),
            "affected_pct",
            F.concat(
                F.col("null_count").cast("string"),
                F.lit(" null values — "),
                F.col("affected_pct").cast("string"),
                F.lit("% of rows"),
            ).alias("detail"),
        )
    )


def layout_issues(facts: DataFrame) -> DataFrame:
    """Columns whose values mix date layouts."""
    filled = F.col("total_count") - F.col("null_count")
    return facts.filter(F.size("layouts") > 1).select(
        F.lit("format_inconsistency").alias("issue"),
        "column",
        F.lit("Low").alias("severity"),
        filled.alias("affected_count"),
        percent(filled, F.col("total_count")).alias("affected_pct"),
        F.concat(F.lit("Mixed formats: "), F.array_join("layouts", ", ")).alias("detail"),
    )


def issues(
    df: DataFrame,
    row_id: str = "_row_id",
    columns: list[str] | None = None,
    duplicates: bool = False,
    strict_reference: bool = False,
) -> DataFrame:
    """Missing cells, mixed date layouts and (optional) repeated rows."""
    columns = columns or business_columns(df)
    facts = column_facts(df, columns)
    if strict_reference:
        facts = _strict(facts, df, row_id, columns)
    found = missing_issues(facts).unionByName(layout_issues(facts))
    if duplicates:
        found = found.unionByName(duplicate_issue(df, columns))
    return found


def duplicate_issue(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return (
        exact_duplicate_count(df, columns)
        .filter("excess_rows > 0")
        .withColumn("pct", percent(F.col("excess_rows"), F.col("total_rows")))
        .select(
            F.lit("duplicate").alias("issue"),
            F.lit(None).cast("string").alias("column"),
            F.lit("Medium").alias("severity"),
            F.col("excess_rows").alias("affected_count"),
            F.col("pct").alias("affected_pct"),
            F.concat(F.col("excess_rows").cast("string"), F.lit(" exact duplicate rows")).alias("detail"),
        )
    )


def cleaning_summary(counts: DataFrame) -> DataFrame:
    """One row: rows, columns, cells, blank cells, blank share, ready flag."""
    return counts.agg(
        F.coalesce(F.max("total_count"), F.lit(0)).alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.coalesce(F.sum("total_count"), F.lit(0)).alias("total_cells"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_cells"),
    ).select(
        "*",
        percent(F.col("null_cells"), F.col("total_cells")).alias("null_pct"),
        (F.col("total_cells") > 0).alias("ready_to_clean"),
    )

"""Exact column statistics without collecting a column anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import number_prefix
from ledgerloom.functions.text import is_blank


def numeric_cells(df: DataFrame, column: str) -> DataFrame:
    """The leading numbers of the cells that have one, as ``x``."""
    x = number_prefix(F.col(column))
    return df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))


def exact_mean(df: DataFrame, column: str) -> DataFrame:
    """One row (``fill``): mean rounded to two decimals, halves upwards.

    Values of ordinary size are added as decimals, so their sum does not depend
    on the order of the partitions.  A value with too many digits for that is
    added as a double, and then so is the rest.
    """
    x = F.col("x")
    digits = F.when(F.abs(x) < 1e20, x.try_cast("decimal(38,6)"))
    exact = digits.isNotNull() & (digits.cast("double") == x)
    total = F.when(F.count_if(~exact) == 0, F.try_sum(F.when(exact, digits)).cast("double"))
    mean = F.coalesce(total, F.sum(x)) / F.count(F.lit(1))
    # From 2**53 on a double has no decimals left to round.
    rounded = F.when(F.abs(mean * 100) < 2.0**53, F.floor(mean * 100 + 0.5) / F.lit(100.0)).otherwise(mean)
    message = F.lit(f"no numeric values in column {column}")
    return numeric_cells(df, column).agg(
        F.when(F.count(F.lit(1)) == 0, F.raise_error(message).cast("double"))
        .otherwise(rounded)
        .alias("fill")
    )


def order_key(x: Column) -> Column:
    """A long that orders doubles as they compare, one step per double: sign, power of two, 52 bits of mantissa.

    Scaling by a power of two is exact, so no two doubles share a key, but the two
    zeros.  Infinities are the ends.
    """
    size = F.when((x != 0) & (F.abs(x) != float("inf")), F.abs(x))
    guess = F.floor(F.log2(size))
    # The logarithm rounds, so just below a power of two it may name that power.  Below the smallest
    # power of full precision all doubles are steps of one size.
    power = F.greatest(guess - F.when(size < F.pow(F.lit(2.0), guess), 1).otherwise(0), F.lit(-1022))
    magnitude = (power + 1022) * F.lit(1 << 52) + (size / F.pow(F.lit(2.0), power) * F.lit(2.0**52)).cast("long")
    key = F.coalesce(magnitude, F.when(x == 0, F.lit(0)).otherwise(F.lit(2047 << 52)))
    return F.when(x < 0, -key).otherwise(key).cast("long")


#: Bits of the order key that are left to tell after each counting pass.
_LEFT = (42, 21, 0)


def exact_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (``column``, ``fill``, ``n``) per column that holds numbers: the middle value, or the mean of the middle two.

    A radix selection on ``order_key``, exact to the last digit: three passes,
    whatever the number of columns and values.  Each counts the cells per column
    and next 21 bits, before the shuffle, and keeps the group that holds a wanted
    rank: at most 2**22 counts of a column meet in a window.  A cell is read once
    a pass; the two middle ranks of an even number share the counts, and are two
    groups only from where they part.
    """
    x = F.col("x")
    cell = lambda i, c: F.struct(F.lit(i).alias("at"), number_prefix(F.col(c)).alias("x"))
    stacked = df.select(F.inline(F.array(*[cell(i, c) for i, c in enumerate(columns)])))
    cells = stacked.filter(x.isNotNull() & ~F.isnan(x)).select("at", "x", order_key(x).alias("key"))
    found = None
    for left in _LEFT:
        part = F.shiftright("key", left)
        if found is None:
            counted = cells.groupBy("at", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("x"))
            group = Window.partitionBy("at")
            n = F.sum("c").over(group)
            ranks = F.array_distinct(F.array(F.floor((n + 1) / 2), F.floor(n / 2 + 1)))
            counted = counted.select("at", "part", "c", "x", n.alias("n"), ranks.alias("ranks"))
        else:
            # At most two rows a column: a broadcast of proven size.
            inside = cells.join(F.broadcast(found), (cells["at"] == F.col("of")) & (F.shiftright("key", before) == F.col("prefix")))
            counted = inside.groupBy("at", "prefix", "n", "ranks", part.alias("part")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("x"))
            group = Window.partitionBy("at", "prefix")
        below = F.sum("c").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
        own = F.filter("ranks", lambda r: (r > F.col("below")) & (r <= F.col("below") + F.col("c")))
        here = counted.withColumn("below", below).withColumn("own", own).filter(F.size("own") > 0)
        found = here.select(
            F.col("at").alias("of"), F.col("part").alias("prefix"), "n", F.transform("own", lambda r: r - F.col("below")).alias("ranks"), "x"
        )
        before, last = left, found
        found = found.drop("x")
    # The halves are summed, so that two large numbers do not overflow.
    middle = F.when(F.count(F.lit(1)) == 1, F.max("x")).otherwise(F.sum(x / 2))
    halved = F.when(F.abs(middle * 100) < 2.0**53, F.floor(middle * 100 + 0.5) / F.lit(100.0)).otherwise(middle)
    names = F.array(*[F.lit(c) for c in columns])
    return last.groupBy("of", "n").agg(F.when(F.col("n") % 2 == 0, halved).otherwise(middle).alias("fill")).select(
        names[F.col("of")].alias("column"), "fill", "n"
    )


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row (``fill``): ``exact_medians`` of one column; an error where it holds no number."""
    message = F.lit(f"no numeric values in column {column}")
    return exact_medians(df, [column]).agg(
        F.when(F.count(F.lit(1)) == 0, F.raise_error(message).cast("double")).otherwise(F.max("fill")).alias("fill")
    )


def exact_mode(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """One row (``fill``): the most frequent non-blank value, the first seen on ties."""
    return (
        df.filter(~is_blank(column))
        .groupBy(F.col(column).alias("fill"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("first"))
        .orderBy(F.col("n").desc(), F.col("first").asc())
        .limit(1)
        .select("fill")
    )

"""Per-key operations that stay balanced when one key holds much of the data.

A plain window sorts every row of a key in one task.  These helpers first cut
each key into blocks of bounded size, work inside the blocks, then carry what is
needed from block to block over the (few) block summaries:

* ``nearest_by_key``      closest value below and above, per key
* ``previous_in_group``   values of the row before, per key
* ``running_totals``      running sums, per key
* ``first_rows_per_key``  first n rows, per key
* ``dense_positions``     0-based position in a total order
* ``frequent_keys``       keys that hold very many rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import cut_lineage


def first_rows_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salts: int = 32
) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (exact).

    Rows are ranked per (key, salt) first, so a large key is spread over
    ``salts`` tasks and at most ``salts * n`` of its rows meet in one task.
    """
    named = [F.col(k) for k in keys]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    part = Window.partitionBy(*named, "_salt").orderBy(*order)
    some = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n)
    whole = Window.partitionBy(*named).orderBy(*order)
    return (
        some.drop("_salt", "_rank")
        .withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= n)
        .drop("_rank")
    )


def frequent_keys(df: DataFrame, key: str, least: int, most: int, fan: int = 16) -> DataFrame:
    """At most ``most`` keys that may hold ``least`` rows and more, one row each (Misra-Gries sketch, no shuffle of rows).

    A sketch of ``8 * most`` counters misses by less than a ``2 * most``-th of all rows, so what is not named holds
    fewer than ``least`` rows plus that, or stands behind ``most`` larger keys.  Keys may be named for less.
    """
    tracked = F.lit(8 * most)
    sketch = lambda fn, c, *more: F.call_function(fn, F.col(c), *[F.lit(m) for m in more])
    parts = (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(fan)).alias("_fan"))
        .agg(sketch("approx_top_k_accumulate", key, tracked).alias("_s"))
    )
    # Grouped by a constant: a task without rows then adds no empty sketch, which cannot be combined.
    merged = parts.groupBy(F.lit("all")).agg(sketch("approx_top_k_combine", "_s", tracked).alias("_s"))
    found = merged.select(F.inline(sketch("approx_top_k_estimate", "_s", most)))
    return found.filter(F.col("count") >= least).select(F.col("item").alias(key))


def nearest_by_key(
    probes: DataFrame, targets: DataFrame, keys: list[str], value: str, width: int = 1000
) -> DataFrame:
    """Closest target at or below and at or above each probe value, per key.

    ``probes`` holds distinct (keys, value); ``targets`` distinct (keys, value)
    plus a struct column ``target`` that contains the value.  Values are money in
    cents, so a block of ``width`` currency units has at most ``width * 100``
    distinct values, however many rows the key has.  Returns the probe columns
    plus ``below`` and ``above`` (the target structs, NULL when there is none).
    No pair is formed besides these two.
    """
    block = F.floor(F.col(value) / F.lit(width)).cast("long")
    empty = F.lit(None).cast(targets.schema["target"].dataType)
    both = (
        targets.select(*keys, value, "target", F.lit(False).alias("_probe"))
        .unionByName(probes.select(*keys, value, empty.alias("target"), F.lit(True).alias("_probe")))
        .withColumn("_block", block)
        # One shuffle for both uses below; they read the same columns, so Spark reuses it.
        .repartition(*keys, "_block")
    )
    inside = Window.partitionBy(*keys, "_block")
    up = inside.orderBy(F.col(value).asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = inside.orderBy(F.col(value).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("_below", F.last("target", ignorenulls=True).over(up)).withColumn(
        "_above", F.last("target", ignorenulls=True).over(down)
    )
    ends = both.groupBy(*keys, "_block").agg(
        F.max_by("target", F.when(~F.col("_probe"), F.col(value))).alias("_high"),
        F.min_by("target", F.when(~F.col("_probe"), F.col(value))).alias("_low"),
    )
    across = Window.partitionBy(*keys)
    lower = across.orderBy(F.col("_block").asc()).rowsBetween(Window.unboundedPreceding, -1)
    higher = across.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        "_block",
        F.last("_high", ignorenulls=True).over(lower).alias("_from_below"),
        F.last("_low", ignorenulls=True).over(higher).alias("_from_above"),
    )
    return (
        near.filter("_probe")
        .join(carried, [*keys, "_block"])
        .select(
            *keys,
            value,
            F.coalesce("_below", "_from_below").alias("below"),
            F.coalesce("_above", "_from_above").alias("above"),
        )
    )


def previous_in_group(
    df: DataFrame, keys: list[str], order: list[str], block: Column, values: list[str]
) -> DataFrame:
    """Add ``prev_<value>`` of the row before in the key's order.

    ``block`` must not decrease along ``order`` (for example the day of a time
    column); it decides how a large key is split.
    """
    blocked = df.withColumn("_block", block)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    here = blocked.withColumn("_prev", F.lag(F.struct(*values)).over(inside))
    ends = blocked.groupBy(*keys, "_block").agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("_end")
    )
    carried = ends.select(
        *keys,
        "_block",
        F.lag("_end").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carried"),
    )
    joined = here.join(carried, [*keys, "_block"])
    prev = F.coalesce(F.col("_prev"), F.col("_carried"))
    return joined.select(*df.columns, *[prev[v].alias(f"prev_{v}") for v in values])


def running_totals(
    df: DataFrame, keys: list[str], order: str, values: dict[str, Column], block: int = 10_000
) -> DataFrame:
    """Add running sums (current row included) along a whole-number ``order``."""
    blocked = df.select(
        "*",
        F.floor(F.col(order) / block).alias("_block"),
        *[v.alias(f"_v_{name}") for name, v in values.items()],
    )
    inside = (
        Window.partitionBy(*keys, "_block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    here = blocked.select(
        "*", *[F.sum(f"_v_{name}").over(inside).alias(f"_s_{name}") for name in values]
    )
    sums = blocked.groupBy(*keys, "_block").agg(
        *[F.sum(f"_v_{name}").alias(f"_t_{name}") for name in values]
    )
    # The block sums are summed up in two steps as well: inside groups of blocks, then over the groups,
    # so the window over a whole key sees one row per block * block rows.
    group = sums.withColumn("_group", F.floor(F.col("_block") / block))
    upto = lambda *more: (
        Window.partitionBy(*keys, *more).orderBy("_group" if not more else "_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    groups = group.groupBy(*keys, "_group").agg(*[F.sum(f"_t_{name}").alias(f"_g_{name}") for name in values])
    starts = groups.select(
        *keys, "_group", *[F.coalesce(F.sum(f"_g_{name}").over(upto()), F.lit(0)).alias(f"_g_{name}") for name in values]
    )
    within = group.select(
        *keys, "_group", "_block",
        *[F.coalesce(F.sum(f"_t_{name}").over(upto("_group")), F.lit(0)).alias(f"_c_{name}") for name in values],
    )
    carried = within.join(starts, [*keys, "_group"]).select(
        *keys, "_block", *[(F.col(f"_c_{name}") + F.col(f"_g_{name}")).alias(f"_c_{name}") for name in values]
    )
    return here.join(carried, [*keys, "_block"]).select(
        *df.columns,
        *[
            (F.coalesce(F.col(f"_s_{name}"), F.lit(0)) + F.col(f"_c_{name}")).alias(name)
            for name in values
        ],
    )


def dense_positions(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the total order ``order``.

    Range-partitioned sort, numbering inside the partitions, then one offset per
    partition.  The sorted rows are written once (``cut_lineage``), so the
    partition a row was numbered in cannot change when a lost task is repeated.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    written = cut_lineage(ranged)
    # One row per partition: n rows, so the single-task window and the broadcast are bounded.
    offsets = (
        written.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            "_part",
            F.coalesce(
                F.sum("_rows").over(
                    Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    return (
        written.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_offset")
    )

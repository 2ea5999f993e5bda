"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets its j-th block (j = 0, 1, ...) released at slot j / w and
due by slot (j + 1) / w.  Each slot goes to the released block with the earliest
deadline.  With weights that add up to one, every source then stays within one
block of its due share at every slot.

Weights are whole numbers over ``PERIOD``, so large that rounding them moves a source's
due share by less than a thousandth of a block in a thousand million slots.  The schedule is
worked out for the blocks there are, one row each, by one task that holds a counter per
source; no row of the data takes part in it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

PERIOD = 1 << 40  # weights are multiples of 1 / PERIOD
MOST_SOURCES = 10_000  # the bound of the schedule; more sources are an error
BLOCK_BYTES = 32_768
FLATTEN = 0.7  # default target weight of a source: its size to this power


def whole_weights(weights: dict, period: int = PERIOD) -> dict:
    """Weights as whole numbers of at least 1 that add up to the period (largest remainders)."""
    if len(weights) > MOST_SOURCES:
        raise ValueError(f"{len(weights)} sources; at most {MOST_SOURCES}")
    period = max(period, 4 * len(weights))
    total = sum(weights.values())
    exact = {s: max(w / total * period, 1.0) if total else period / len(weights) for s, w in weights.items()}
    scale = sum(exact.values())
    shares = {s: max(int(x * period / scale), 1) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (shares[s] - exact[s] * period / scale, str(s)))
    while (missing := period - sum(shares.values())) > 0:
        for s in order[:missing]:
            shares[s] += 1
    while (over := sum(shares.values()) - period) > 0:
        for s in sorted((s for s in shares if shares[s] > 1), key=lambda s: -shares[s])[:over]:
            shares[s] -= 1
    return shares


def slots(shares: dict, blocks: dict) -> Iterator[tuple]:
    """``(source, block, slot, due slot)`` of all blocks: earliest deadline first among released blocks.

    A slot stays empty only when no block is released, which can happen once a source has run out.
    """
    period = sum(shares.values())
    names = sorted(shares, key=lambda s: (s is None, str(s)))
    weight, number = [shares[s] for s in names], [blocks[s] for s in names]
    waiting = [(0, i, 0) for i in range(len(names)) if number[i]]  # by release
    heapq.heapify(waiting)
    ready: list[tuple] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            due, after = -(-(j + 1) * period // weight[i]), (j + 1) * period // weight[i]
            # A tie goes to the block whose successor is released first, then to the heavier source.
            heapq.heappush(ready, (due, after, -weight[i], i, j))
        due, after, _, i, j = heapq.heappop(ready)
        yield names[i], j, slot, due
        if j + 1 < number[i]:
            heapq.heappush(waiting, (after, i, j + 1))
        slot += 1


def schedule(shares: dict) -> list[tuple]:
    """``(source, block of the period, slot)`` for one period."""
    return [(s, j, slot) for s, j, slot, _ in slots(shares, shares)]


def deviation(plan: list[tuple], weights: dict) -> float:
    """The largest distance of any source from its due share by the weights over all slots, in blocks."""
    worst, had = Fraction(0), dict.fromkeys(weights, 0)
    total = sum(map(Fraction, weights.values()))
    due = {s: Fraction(w) / total for s, w in weights.items()}
    for source, _, slot in plan:
        had[source] += 1
        for s, w in due.items():
            worst = max(worst, abs(had[s] - w * (slot + 1)))
    return float(worst)


def _offsets(docs: DataFrame, source: str, text: str, doc_id: str, scratch: Scratch) -> DataFrame:
    """Each row's first byte within its source, in id order: ``_source, _id, _row, _bytes, _before``.

    Range-partitioned by (source, id) and summed inside the partitions, so a source
    with a third of all rows is spread over a third of the tasks.  Totals of (partition, source),
    at most partitions + sources rows, are summed by source.
    """
    rows = docs.select(
        F.col(source).cast("string").alias("_source"), F.col(doc_id).alias("_id"),
        F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).cast("long").alias("_bytes"),
    )
    inside = Window.partitionBy("_part", "_source").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = scratch.cut(
        rows.repartitionByRange(F.col("_source").asc_nulls_last(), F.col("_id").asc_nulls_last(), "_bytes")
        .sortWithinPartitions(F.col("_source").asc_nulls_last(), F.col("_id").asc_nulls_last(), "_bytes")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id()),
        "placed",
    )
    totals = placed.groupBy("_source", "_part").agg(F.sum("_bytes").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried")
    )
    own = placed.withColumn("_own", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
    return own.join(carried, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p"))).select(
        "_source", "_id", "_bytes", "_place", (F.col("_own") + F.col("_carried")).alias("_before")
    )


def source_bytes(sized: DataFrame) -> dict:
    """Bytes of each source.  One row per source comes to the driver, ``MOST_SOURCES`` at most."""
    sums = sized.groupBy("_source").agg(F.sum("_bytes").alias("n")).limit(MOST_SOURCES + 1).collect()
    return {r["_source"]: r["n"] for r in sums}


def _schedule_table(spark: SparkSession, shares: dict, blocks: dict) -> DataFrame:
    """The schedule of all blocks, made in batches by one task."""
    names = ["s", "j", "slot", "due_slot"]

    def run(batches):
        if sum(batch.num_rows for batch in batches):
            plan = slots(shares, blocks)
            while part := list(islice(plan, 50_000)):
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names=names)

    return spark.range(1, numPartitions=1).mapInArrow(run, "s string, j long, slot long, due_slot long")


def mix_order(docs: DataFrame, weights: dict | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id",
              block_bytes: int = BLOCK_BYTES, period: int = PERIOD, scratch: Scratch | None = None) -> DataFrame:
    """Where each row stands in the mixture.

    ``doc_id, source, block, share, period, slot, due_slot, before, n_bytes, in_mix``: ``block`` is the
    source's block in which the row begins (documents in id order, cut every ``block_bytes``), ``slot`` its
    place in the schedule; rows are read in the order of (slot, before, doc_id).  ``in_mix`` marks the slots before
    the first source has run out: there every source is within one block of its weight, ``share / period``,
    which differs from the given weight by about 1 / ``PERIOD`` at most.
    Every row has a place: nothing is dropped or repeated.  Rows without a source are a
    source of their own; a source missing from ``weights`` is an error.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spark = docs.sparkSession
    sized = scratch.cut(_offsets(docs, source, text, doc_id, scratch), "sized")
    sizes = source_bytes(sized)
    if weights is None:
        weights = {s: float(max(n, 1)) ** FLATTEN for s, n in sizes.items()}
    if missing := set(sizes) - set(weights):
        raise ValueError(f"no weight for {sorted(map(str, missing))}")
    shares = whole_weights({s: float(weights[s]) for s in sizes}, period) if sizes else {}
    total = sum(shares.values())
    # The slot after the last block of the first source to run out.
    horizon = min((-(-n // block_bytes) * total // shares[s] for s, n in sizes.items()), default=0)
    # A row may begin where its source's last block ends, so there is one block more.
    blocks = {s: n // block_bytes + 1 for s, n in sizes.items()}
    plan = scratch.cut(_schedule_table(spark, shares, blocks), "schedule")
    share_table = spark.createDataFrame(list(shares.items()), "t string, share long")  # one row per source
    placed = (
        sized.withColumn("block", F.floor(F.col("_before") / F.lit(block_bytes)).cast("long"))
        .join(F.broadcast(share_table), F.col("_source").eqNullSafe(F.col("t")))
        .join(plan, F.col("_source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("j")))
    )
    return placed.select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "block", "share", F.lit(total).cast("long").alias("period"), "slot",
        "due_slot", F.col("_before").alias("before"), F.col("_bytes").alias("n_bytes"), (F.col("slot") < F.lit(horizon)).alias("in_mix"),
    )


def mixed(docs: DataFrame, weights: dict | None = None, source: str = "source", text: str = "text", doc_id: str = "doc_id",
          scratch: Scratch | None = None) -> DataFrame:
    """All rows of ``docs`` in the order of the mixture: files and rows in files follow the schedule.

    Rows repeated with the same id and source stand together at the first one's place.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    order = scratch.cut(
        mix_order(docs, weights, source, text, doc_id, scratch=scratch)
        .groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"))
        .agg(F.min(F.struct("slot", "before")).alias("_at")),
        "order",
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    match = F.col("_doc")[doc_id].eqNullSafe(F.col("_id")) & F.col("_doc")[source].cast("string").eqNullSafe(F.col("_source"))
    place = [F.col("_at.slot"), F.col("_at.before"), F.col("_id")]
    ordered = rows.join(order, match, "left").repartitionByRange(*place).sortWithinPartitions(*place)
    return ordered.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

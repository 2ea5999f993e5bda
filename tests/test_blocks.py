"""Blocked operators against plain Python on keys that hold most of the rows."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.operators import blocks as B


def test_nearest_by_key(spark):
    rnd = random.Random(1)
    cents = lambda: Decimal(rnd.randrange(0, 900_000)) / 100
    targets = {("hot", cents()) for _ in range(300)} | {("b", Decimal("5.00"))}
    probes = {("hot", cents()) for _ in range(200)} | {("b", Decimal("7.00")), ("none", Decimal("1.00"))}
    t = spark.createDataFrame(list(targets), "k string, v decimal(18,2)").select(
        "k", "v", F.struct(F.col("v").alias("amount")).alias("target")
    )
    p = spark.createDataFrame(list(probes), "k string, v decimal(18,2)")
    got = {(r.k, r.v): (r.below and r.below.amount, r.above and r.above.amount) for r in B.nearest_by_key(p, t, ["k"], "v").collect()}
    for k, v in probes:
        mine = [x for kk, x in targets if kk == k]
        want = (max((x for x in mine if x <= v), default=None), min((x for x in mine if x >= v), default=None))
        assert got[(k, v)] == want


def test_previous_and_totals(spark):
    data = [("hot", i, i % 7) for i in range(1, 120)] + [("b", 5, 1)]
    df = spark.createDataFrame(data, "k string, i long, v long")
    prev = {(r.k, r.i): r.prev_v for r in B.previous_in_group(df, ["k"], ["i"], F.floor(F.col("i") / 10), ["v"]).collect()}
    assert prev[("hot", 1)] is None and prev[("b", 5)] is None
    assert all(prev[("hot", i)] == (i - 1) % 7 for i in range(2, 120))
    run = {(r.k, r.i): r.total for r in B.running_totals(df, ["k"], "i", {"total": F.col("v")}, block=10).collect()}
    total = 0
    for k, i, v in data[:-1]:
        total += v
        assert run[(k, i)] == total


def test_first_rows_and_positions(spark):
    df = spark.range(500).select(F.col("id"), F.when(F.col("id") < 490, "hot").otherwise("b").alias("k"))
    first = B.first_rows_per_key(df, ["k"], [F.col("id").desc()], 3, salts=4)
    assert sorted((r.k, r.id) for r in first.collect()) == [("b", 497), ("b", 498), ("b", 499), ("hot", 487), ("hot", 488), ("hot", 489)]
    placed = B.dense_positions(df.withColumn("o", -F.col("id")), ["o"], "at", partitions=5)
    assert all(r.at == 499 - r.id for r in placed.collect())

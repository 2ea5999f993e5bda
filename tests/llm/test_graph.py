"""Connected components: rounds on long chains, and results against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import graph
from ledgerloom.session import Scratch

N = 10_000


def links(spark, kind):
    path = spark.range(N - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    if kind == "path":
        return path
    if kind == "star":
        return spark.range(N).select(F.lit(N // 2).cast("long").alias("a"), F.col("id").alias("b"))
    return path.unionAll(spark.range(N).select(F.col("id").alias("a"), (F.col("id") + 10 * N).alias("b")))


@pytest.mark.parametrize("kind", ["path", "star", "comb"])
def test_rounds_grow_with_the_logarithm_of_the_chain(spark, kind):
    scratch = Scratch(spark)
    assert len(graph.contract(links(spark, kind), scratch)) <= 20
    scratch.close()


def test_components_equal_union_find(spark, rows):
    rng = random.Random(6)
    pairs = [(rng.randint(-60, 400), rng.randint(-60, 400)) for _ in range(260)]
    pairs += [(i, i - 1) for i in range(1000, 1060)] + [(5, 5), (2000, 2000)] + [(b, a) for a, b in pairs[:40]]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    scratch = Scratch(spark)
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    assert rows(graph.components(frame, scratch)) == sorted(((i, find(i)) for i in up), key=repr)
    assert graph.components(frame.filter("a = b"), scratch).collect() == []
    scratch.close()

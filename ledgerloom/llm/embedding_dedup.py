"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

A table of hashes has two pseudo-random rotations (three rounds of random signs
and a fast Hadamard transform each).  A rotation's code is the axis nearest to the
rotated vector, with its sign; a bucket is the pair of codes.  Every vector lies in
its own bucket of each table and looks into the next nearest ones.  At a cosine of
0.93 a pair meets in one table with probability 0.70, in one of ``TABLES`` with 0.999.

Every pair that meets is verified by its cosine in double precision.  No pair
leaves its task: a bucket gives, per vector, the number of verified partners (a pair
that meets in several buckets is counted in the first of them, which both vectors'
codes tell) and the connected part it belongs to.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.session import Scratch

TABLES = 6
PROBES = 4  # buckets a vector is found in or looks into, per table
LEAST_COSINE = 0.93
TILE = 1500  # rows of a bucket compared in one task; larger buckets are cut into tiles
_SMALL = 48  # groups up to this size are compared side by side with others


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of the rows; their length is a power of two."""
    n, size = x.shape
    step = 1
    while step < size:
        y = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def bucket_codes(vectors: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """n x tables x probes bucket codes of unit vectors, each vector's own bucket first."""
    n, dim = vectors.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dim] = vectors
    near = min(3, size)
    ways = list(itertools.product(range(near), repeat=2))
    out = np.empty((n, tables, min(probes, len(ways))), np.int64)
    for t in range(tables):
        signs = np.random.default_rng([size, t]).choice([-1.0, 1.0], (2, 3, size))
        codes, heights = [], []
        for part in range(2):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[part, r])
            axis = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            value = np.take_along_axis(y, axis, 1)
            codes.append(axis * 2 + (value < 0))
            heights.append(np.abs(value))
        cost = np.stack([sum((h[:, 0] - h[:, w]) ** 2 for h, w in zip(heights, way)) for way in ways], axis=1)
        # The own bucket costs nothing, so it comes first.
        order = np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]]
        both = np.stack([codes[0][:, a] * (2 * size) + codes[1][:, b] for a, b in ways], axis=1)
        out[:, t] = np.take_along_axis(both, order, 1)
    return out


def usable(vector: str | Column) -> Column:
    """True for vectors that can be compared: not null or empty, all components finite, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(v) > 0) & F.forall(v, good) & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(batch, dim: int) -> np.ndarray:
    x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _code_rows(batches):
    """``id, codes``: all bucket codes of a vector."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for dim in np.unique(dims):
            for_dim = batch.filter(pa.array(dims == dim))
            for begin in range(0, for_dim.num_rows, 2048):
                part = for_dim.slice(begin, 2048)
                codes = bucket_codes(_units(part, int(dim))).astype(np.int32)
                flat = pa.array(codes.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * codes[0].size), flat)
                yield pa.record_batch([part.column("id"), lists], names=["id", "codes"])


def _first_meeting(codes_a, codes_b, ids_a, ids_b):
    """For pairs: the first table in which they meet and the bucket that owns the pair there."""
    found = np.full(len(ids_a), -1)
    owner = np.zeros(len(ids_a), np.int64)
    swap = ids_a > ids_b
    low, high = np.where(swap[:, None, None], codes_b, codes_a), np.where(swap[:, None, None], codes_a, codes_b)
    for t in range(codes_a.shape[1]):
        at_low = (high[:, t] == low[:, t, :1]).any(axis=1)
        at_high = (low[:, t] == high[:, t, :1]).any(axis=1)
        new = (found < 0) & (at_low | at_high)
        found[new] = t
        owner[new] = np.where(at_low, low[:, t, 0], high[:, t, 0])[new]
    return found, owner


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each member's connected part."""
    part = np.arange(n)
    while True:
        least = np.minimum(part[a], part[b])
        new = part.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, part[a], least)
        np.minimum.at(new, part[b], least)
        new = new[new]
        if (new == part).all():
            return part
        part = new


def _compare(rows: pa.Table, tables: int) -> pa.RecordBatch | None:
    """Verified partners and parts of all groups of ``rows``, which are complete and in group order."""
    rows = rows.combine_chunks().to_batches()[0]
    dim = rows.column("dim")[0].as_py()
    group = np.asarray(rows.column("group"))
    n = len(group)
    bounds = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    sizes = np.diff(bounds)
    units = _units(rows, dim)
    own = rows.column("own").to_numpy(zero_copy_only=False)
    tile = np.asarray(rows.column("tile"))
    crossing = np.asarray(rows.column("t0")) != np.asarray(rows.column("t1"))
    left, right = [], []
    end_of = np.repeat(bounds[1:], sizes)
    size_of = np.repeat(sizes, sizes)
    for k in range(1, min(int(sizes.max()), _SMALL)):
        i = np.flatnonzero((size_of <= _SMALL) & (np.arange(n) + k < end_of))
        if len(i):
            near = np.einsum("ij,ij->i", units[i], units[i + k]) >= LEAST_COSINE
            left.append(i[near])
            right.append(i[near] + k)
    for g in np.flatnonzero(sizes > _SMALL):
        a, b = bounds[g], bounds[g + 1]
        for begin in range(a, b, 512):
            stop = min(begin + 512, b)
            i, j = np.nonzero(units[begin:stop] @ units[a:b].T >= LEAST_COSINE)
            i, j = i + begin, j + a
            left.append(i[i < j])
            right.append(j[i < j])
    i, j = np.concatenate([np.zeros(0, int), *left]), np.concatenate([np.zeros(0, int), *right])
    fits = (own[i] | own[j]) & (~crossing[i] | (tile[i] != tile[j]))
    i, j = i[fits], j[fits]
    if not len(i):
        return None
    # One rounding for every pair, however it was found: the sum of products in double precision.
    sure = np.einsum("ij,ij->i", units[i], units[j]) >= LEAST_COSINE
    i, j = i[sure], j[sure]
    ids, weight = np.asarray(rows.column("id")), np.asarray(rows.column("copies"))
    codes = np.asarray(rows.column("codes").flatten()).reshape(n, tables, -1)
    table, bucket = np.asarray(rows.column("table")), np.asarray(rows.column("code"))
    links = np.zeros(n, np.int64)
    for begin in range(0, len(i), 100_000):
        a, b = i[begin : begin + 100_000], j[begin : begin + 100_000]
        found, owner = _first_meeting(codes[a], codes[b], ids[a], ids[b])
        mine = (found == table[a]) & (owner == bucket[a])
        np.add.at(links, a[mine], weight[b[mine]])
        np.add.at(links, b[mine], weight[a[mine]])
    part = _parts(n, i, j)
    some = np.flatnonzero((links > 0) | (part != np.arange(n)))
    return pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[part[some]])], names=["id", "links", "other"])


def _group_rows(tables: int):
    def run(batches):
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            group = np.asarray(rows.column("group"))
            # The last group may go on in the next batch; vectors of one length at a time.
            starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, int)
            cut = int(starts[-1]) if len(starts) else 0
            kept = rows.slice(cut)
            yield from _by_dim(rows.slice(0, cut), tables)
        if kept is not None:
            yield from _by_dim(kept, tables)

    return run


def _by_dim(rows: pa.Table, tables: int):
    dims = np.asarray(rows.column("dim"))
    for dim in np.unique(dims):
        found = _compare(rows.filter(pa.array(dims == dim)), tables)
        if found is not None:
            yield found


def vector_groups(vectors: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id",
                  scratch: Scratch | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors``.

    Rows are compared when their labels are equal and not null.  Equal vectors of a label are one
    class with its number of copies; classes are compared through the index.  Vectors that are null,
    empty, zero or hold null or non-finite components, rows without label or id, and vectors of
    different lengths link with nothing; such a row is its own component (none without an id) and is
    kept.  Repeated rows count as other vectors.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.transform(F.col(vector), lambda x: x.cast("double")).alias("vector"),
    ).withColumn("fit", usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    classes = scratch.cut(
        rows.filter("fit").groupBy("label", "vector").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dim", F.size("vector")),
        "classes",
    )
    coded = scratch.cut(classes.select("id", "vector", "dim").mapInArrow(_code_rows, "id long, codes array<int>"), "codes")
    width = F.floor(F.size("codes") / TABLES).cast("int")
    looks = (
        coded.select("id", F.posexplode("codes").alias("at", "code"), width.alias("width"))
        .select("id", F.floor(F.col("at") / F.col("width")).cast("int").alias("table"), "code", (F.col("at") % F.col("width") == 0).alias("own"))
        .join(classes.select("id", "label", "dim"), "id")
    )
    bucket = ["label", "dim", "table", "code"]
    looks = scratch.cut(looks, "looks")
    meeting = scratch.cut(
        looks.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), F.max("own").alias("owned")).filter("size > 1 AND owned")
        .select(*bucket, F.ceil(F.col("size") / TILE).cast("int").alias("tiles")),
        "meeting",
    )
    tiled = (
        looks.join(meeting, bucket)
        .withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("t0", F.least("tile", "other"))
        .withColumn("t1", F.greatest("tile", "other"))
        .withColumn("group", F.xxhash64(*bucket, "t0", "t1"))
        .select("id", "own", "table", "code", "tile", "t0", "t1", "group")
        .join(coded.join(classes.drop("label"), "id"), "id")
        .select("id", "own", "table", "code", "tile", "t0", "t1", "group", "codes", "vector", "dim", "copies")
        .repartition("group")
        .sortWithinPartitions("group", "dim", "table", "code", "t0", "t1", "id")
    )
    found = scratch.cut(tiled.mapInArrow(_group_rows(TABLES), "id long, links long, other long"), "found")
    parts = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = scratch.cut(
        classes.join(links, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left").select(
            "label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        ),
        "named",
    )
    linked = rows.filter("fit").join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

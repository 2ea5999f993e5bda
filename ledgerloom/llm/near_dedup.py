"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

A document's set holds its distinct 5-word shingles (64-bit hashes).  Its
signature has ``SLOTS`` b-bit MinHash values.  The signature is split into chunks
of ``CHUNK`` slots.  Two signatures that differ in fewer than ``2 * chunks`` slots
differ in at most one slot of some chunk (pigeonhole), so listing, for every
chunk, each way to leave one slot out gives equal keys to all such pairs: within
that signature distance no pair is missed.  At a similarity of 0.75 a pair misses
all chunks with probability 5e-10.

No bucket is expanded into its pairs.  First each member of a bucket is checked
against the smallest and the largest member, which joins groups of copies with
linear work.  Then only buckets that still hold several components are looked at
again: members of different components are compared by a second, longer signature
inside the bucket's task, each pair in the first bucket it shares, and only pairs
that pass are checked.  Every check is on the full shingle sets.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.graph import components
from ledgerloom.session import Scratch

SHINGLE = 5
SLOTS = 64
CHUNK = 4
PERCENT = 75
FINE_SLOTS = 1024  # 8-bit values of the second signature
NEAR_FINE = 331  # differing ones up to which a pair is checked: 5.5 standard deviations at similarity 0.75
TILE = 1500  # members of a mixed bucket compared in one task; larger buckets are cut into tiles

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * tk.U64(2) + tk.U64(1)
_FINE_MULTIPLIERS = _rng.integers(1, 1 << 63, FINE_SLOTS, dtype=np.uint64) * tk.U64(2) + tk.U64(1)
_SHINGLE_MULTIPLIERS = _rng.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * tk.U64(2) + tk.U64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than five words are one shingle."""
    data, offsets = tk.text_bytes(texts)
    words, rows = tk.word_hashes(data, offsets)
    at = tk.row_bounds(rows, len(offsets) - 1)
    total = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for j, m in enumerate(_SHINGLE_MULTIPLIERS):
        total += words[j : j + len(total)] * m
    total = tk.mix(total)
    sets = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            sets.append(np.unique(total[a : b - SHINGLE + 1]))
        elif b > a:
            short = (words[a:b] * _SHINGLE_MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + tk.U64(b - a)
            sets.append(tk.mix(np.array([short])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _smallest(members: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Of each permutation the smallest member, mixed."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for begin in range(0, len(members), 4096):
        some = members[begin : begin + 4096]
        np.minimum(least, (multipliers[:, None] * some[None, :]).min(axis=1), out=least)
    return tk.mix(least)


def signature(members: np.ndarray) -> np.ndarray:
    """``SLOTS`` 16-bit values: of each slot's smallest permuted member."""
    return (_smallest(members, _MULTIPLIERS) >> tk.U64(48)).astype(np.uint16)


def _fine_rows(batches):
    for batch in batches:
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in batch.column("members")]
        fine = [(_smallest(s, _FINE_MULTIPLIERS) >> tk.U64(56)).astype(np.uint8).tobytes() for s in sets]
        yield pa.record_batch([batch.column("id"), pa.array(fine, pa.binary())], names=["id", "fine"])


def _feature_rows(batches):
    for part in tk.text_slices(batches):
        sets = shingle_sets(part.column("text"))
        yield pa.record_batch(
            [
                part.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([md5(s.tobytes()).digest() for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_digest", "signature"],
        )


def _set_rows(batches):
    for part in tk.text_slices(batches):
        sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
        yield pa.record_batch([part.column("id"), pa.array(sets, pa.binary())], names=["id", "members"])


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """For n signatures, the n x SLOTS keys: each chunk with each one of its slots left out."""
    n = len(signatures)
    slots = signatures.astype(np.uint64).reshape(n, SLOTS // CHUNK, CHUNK)
    keys = np.empty((n, SLOTS // CHUNK, CHUNK), np.uint64)
    for left_out in range(CHUNK):
        key = np.zeros((n, SLOTS // CHUNK), np.uint64)
        for slot in range(CHUNK):
            if slot != left_out:
                key = (key << tk.U64(16)) | slots[:, :, slot]
        # Three 16-bit slots, then the chunk and the slot left out: no two meanings share a key.
        place = np.arange(SLOTS // CHUNK, dtype=np.uint64) * tk.U64(CHUNK) + tk.U64(left_out)
        keys[:, :, left_out] = (key << tk.U64(16)) | place
    return keys.reshape(n, SLOTS).view(np.int64)


def _key_rows(batches):
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            raw = b"".join(part.column("signature").to_pylist())
            keys = chunk_keys(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS))
            ids = np.repeat(part.column("id").to_numpy(), SLOTS)
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])


def _near_pairs(key, table):
    """Pairs of one bucket (or of two of its tiles) in different components with near fine signatures.

    A pair that shares several buckets is left to the first: that of the first
    chunk in which it differs in one slot at most.
    """
    ids, parts = table.column("id").to_numpy(), table.column("component").to_numpy()
    tiles = table.column("tile").to_numpy()
    slots = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS // CHUNK, CHUNK)
    fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(-1, FINE_SLOTS)
    chunk, left_out = divmod(key[0].as_py() & 0xFFFF, CHUNK)
    crossing = key[1].as_py() != key[2].as_py()  # pairs inside a tile belong to that tile's own task
    found = [np.zeros((0, 2), np.int64)]
    for i in range(len(ids) - 1):
        hit = np.flatnonzero(parts[i + 1 :] != parts[i]) + i + 1
        if crossing:
            hit = hit[tiles[hit] != tiles[i]]
        differ = slots[hit, : chunk + 1] != slots[i, : chunk + 1]
        here = differ[:, chunk].copy()
        here[:, left_out] = False  # the bucket's own three slots agree
        first_way = differ[:, chunk, left_out] if left_out else np.ones(len(hit), bool)
        before = (differ[:, :chunk].sum(axis=2) <= 1).any(axis=1)
        hit = hit[~before & first_way & ~here.any(axis=1)]
        hit = hit[(fine[hit] != fine[i]).sum(axis=1) <= NEAR_FINE]
        found.append(np.column_stack([np.full(len(hit), ids[i]), ids[hit]]))
    pairs = np.sort(np.concatenate(found), axis=1)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _agree(batches):
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"))):
            one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep[i] = 100 * common >= PERCENT * (len(one) + len(two) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_agree, "a long, b long")


def _links(classes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Confirmed links between classes (by their representative's id) that connect all that is connected."""
    buckets = scratch.cut(
        classes.select("id", "signature")
        .mapInArrow(_key_rows, "key long, id long")
        .groupBy("key")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"))
        .filter("low < high"),
        "buckets",
    )
    members = scratch.cut(
        classes.select("id", "signature").mapInArrow(_key_rows, "key long, id long").join(buckets, "key"), "members"
    )
    sets = scratch.cut(
        docs.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_set_rows, "id long, members binary"), "sets"
    )
    ends = [members.filter(f"id <> {end}").select(F.least("id", end).alias("a"), F.greatest("id", end).alias("b")) for end in ("low", "high")]
    tried = scratch.cut(ends[0].unionAll(ends[1]).distinct(), "tried")
    first = scratch.cut(_confirmed(tried, sets), "links")
    found = components(first, scratch)
    placed = scratch.cut(
        members.join(found.withColumnRenamed("node", "id"), "id", "left").select(
            "key", "id", F.coalesce("component", "id").alias("component")
        ),
        "placed",
    )
    mixed = (
        placed.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
        .filter("low < high")
        .select("key", F.ceil(F.col("size") / TILE).cast("int").alias("tiles"))
    )
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    spread = scratch.cut(placed.join(scratch.cut(mixed, "mixed"), "key").withColumn("tile", tile), "spread")
    fine = scratch.cut(sets.join(spread.select("id").distinct(), "id", "left_semi").mapInArrow(_fine_rows, "id long, fine binary"), "fine")
    tiled = (
        spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), "tile", "id", "component")
        .join(fine.join(classes.select("id", "signature"), "id"), "id")
    )
    near = tiled.groupBy("key", "t0", "t1").applyInArrow(_near_pairs, "a long, b long").distinct()
    second = _confirmed(near.join(tried, ["a", "b"], "left_anti"), sets)
    return first.unionAll(scratch.cut(second, "links"))


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    Ids are whole numbers.  Documents with an equal set are one class, named by its
    smallest id; classes are linked as the module says.  Documents without words
    (null and empty texts too) and rows without an id link with nothing: the first
    are their own component, the latter have no component and are kept.  Repeated
    rows share a component.  An empty table gives an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    inputs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    features = scratch.cut(
        inputs.mapInArrow(_feature_rows, "doc_id long, n_shingles long, set_digest binary, signature binary"), "features"
    )
    classes = scratch.cut(
        features.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_digest")
        .agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature")),
        "classes",
    )
    links = _links(classes, inputs.withColumnRenamed("doc_id", "id").filter("id IS NOT NULL"), scratch)
    found = components(links, scratch)
    named = scratch.cut(
        classes.join(found.withColumnRenamed("node", "id"), "id", "left").select(
            "set_digest", F.coalesce("component", "id").alias("component_id")
        ),
        "named",
    )
    worded = features.filter("n_shingles > 0 AND doc_id IS NOT NULL").join(named, "set_digest")
    rest = features.filter("n_shingles = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    return (
        worded.select("doc_id", "n_shingles", "component_id")
        .unionAll(rest.select("doc_id", "n_shingles", "component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one document of each group, and all that are in none."""
    scratch = scratch or Scratch(docs.sparkSession)
    groups = near_groups(docs, text, doc_id, scratch)
    gone = scratch.cut(groups.filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    stay = rows.join(gone, F.col("_doc")[doc_id].cast("long") == F.col("_gone"), "left_anti")
    return stay.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])

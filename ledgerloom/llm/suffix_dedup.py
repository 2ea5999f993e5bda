"""Removing byte strings that occur more than once: a logarithmic family of sparse suffix arrays.

Which suffixes are kept.  Of the ``GRAM``-byte strings in a window of ``LENGTH`` bytes
the one with the smallest hash (the leftmost on a tie) is the window's anchor.
Equal windows have equal anchors at equal places, whatever surrounds them, so only
suffixes that start at anchors need to be compared: about one in eighty.

A suffix array holds the anchors of a batch of documents, ordered by the hash of the
suffix's first ``GRAM`` bytes (``key``) and of the whole stretch of text whose windows have
this anchor (``context``); equal entries are one row with a count.  ``SuffixFamily`` keeps
arrays in levels: a new batch is merge-scanned against every level for shared keys,
then takes its place, and two arrays of one level merge into one of the next.  Every
pair of batches is compared once, and an entry is rewritten once per level.

What a shared key proves.  An equal context means that all its windows are repeated.
Only anchors that share a key but have a context of their own are looked at byte by
byte: their windows are hashed and compared inside the key.  Keys with very many
contexts are spread by window instead of by key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.session import Scratch

LENGTH = 200
GRAM = 40
BATCHES = 4
MOST_CONTEXTS = 4000  # contexts of a key compared in one task; beyond, windows are spread by their hash

_ANCHOR = "doc_id long, tag int, start int, windows int, key long, context long"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor: first window, number of windows, key, context."""
    n = len(data) - length + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty
    sums = tk.prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = tk.span_hashes(sums, at, at + gram)
    least = (grams & ~tk.U64(0xFFFFFFFF)) | at.astype(np.uint64)
    width, want = 1, length - gram + 1
    while width < want:  # smallest of `width` neighbours, doubled until it is all of a window
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.flatnonzero(row[:n] == row[length - 1 :][:n])  # windows inside one document
    if not len(first):
        return empty, empty, empty, empty
    anchor = (least[first] & tk.U64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(first), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    begin = np.flatnonzero(new)
    windows = np.diff(np.append(begin, len(first)))
    start = first[begin]
    return start, windows, grams[anchor[begin]], tk.span_hashes(sums, start, start + windows - 1 + length)


def _anchor_rows(batches):
    for part in tk.text_slices(batches, limit=2 << 20):
        data, offsets = tk.text_bytes(part.column("text"))
        start, windows, key, context = anchors(data, offsets)
        row = np.searchsorted(offsets, start, side="right") - 1
        yield pa.record_batch(
            [part.column("doc_id").take(pa.array(row)), part.column("tag").take(pa.array(row)),
             pa.array((start - offsets[row]).astype(np.int32)), pa.array(windows.astype(np.int32)),
             pa.array(key.astype(np.uint64).view(np.int64)), pa.array(context.astype(np.uint64).view(np.int64))],
            names=["doc_id", "tag", "start", "windows", "key", "context"],
        )


class SuffixFamily:
    """Suffix arrays in levels; level k holds the anchors of 2**k batches, or nothing."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch = scratch
        self.levels: list[DataFrame | None] = []
        self.matches: list[DataFrame] = []

    def add(self, batch: DataFrame) -> None:
        """Take in the anchors ``(key, context)`` of a batch."""
        array = self._array(batch.withColumn("n", F.lit(1).cast("long")))
        repeated = array.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts")).filter("n > 1").select("key")
        found = [repeated]
        for level in self.levels:
            if level is not None:  # merge-scan: both sides are read in key order
                found.append(array.select("key").join(level.select("key"), "key", "left_semi"))
        matched = found[0]
        for more in found[1:]:
            matched = matched.unionAll(more)
        self.matches.append(self.scratch.cut(matched.distinct(), "matches"))
        k = 0
        while k < len(self.levels) and self.levels[k] is not None:
            merged = self._array(array.unionAll(self.levels[k]))
            self.scratch.drop(array, self.levels[k])
            array, self.levels[k] = merged, None
            k += 1
        if k == len(self.levels):
            self.levels.append(None)
        self.levels[k] = array

    def _array(self, entries: DataFrame) -> DataFrame:
        return self.scratch.cut(
            entries.groupBy("key", "context").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "context"), "array"
        )

    def shared(self) -> DataFrame:
        """``key, context, n, contexts`` of all entries whose key occurs more than once."""
        keys = self.matches[0]
        for more in self.matches[1:]:
            keys = keys.unionAll(more)
        keys = keys.distinct()
        entries = None
        for level in self.levels:
            if level is not None:
                entries = level if entries is None else entries.unionAll(level)
        whole = self.scratch.cut(
            entries.join(keys, "key", "left_semi").groupBy("key", "context").agg(F.sum("n").alias("n")), "shared"
        )
        sizes = whole.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"))
        return self.scratch.cut(whole.join(self.scratch.cut(sizes, "sizes"), "key"), "shared")


def _stretches(batches):
    """The bytes of the stretches listed for each document."""
    for part in tk.text_slices(batches, limit=2 << 20):
        texts = [t.encode() for t in part.column("text").to_pylist()]
        out: dict[str, list] = {k: [] for k in ("row", "start", "key", "alone", "many", "bytes")}
        for i, (text, listed) in enumerate(zip(texts, part.column("listed").to_pylist())):
            for s in listed:
                out["row"].append(i)
                out["start"].append(s["start"])
                out["key"].append(s["key"])
                out["alone"].append(s["alone"])
                out["many"].append(s["many"])
                out["bytes"].append(text[s["start"] : s["start"] + s["windows"] - 1 + LENGTH])
        row = pa.array(out["row"], pa.int32())
        yield pa.record_batch(
            [part.column("doc_id").take(row), part.column("tag").take(row), pa.array(out["start"], pa.int32()), pa.array(out["key"], pa.int64()),
             pa.array(out["alone"], pa.bool_()), pa.array(out["many"], pa.bool_()), pa.array(out["bytes"], pa.binary())],
            names=["doc_id", "tag", "start", "key", "alone", "many", "bytes"],
        )


def _window_hashes(stretches: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each window of each stretch, its stretch and its place there."""
    raw = stretches.to_pylist()
    sizes = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    begin = np.cumsum(sizes) - sizes
    many = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(raw)), many)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = begin[owner] + place
    return tk.span_hashes(tk.prefix_sums(data), at, at + LENGTH), owner, place


def _compare_rows(batches):
    """Repeated windows of the stretches that are alone with their context, as spans; rows come in key order."""

    def spans(rows: pa.Table):
        for begin in _pieces(rows):
            part = begin
            hashes, owner, place = _window_hashes(part.column("bytes").combine_chunks())
            _, back, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            alone = part.column("alone").to_numpy()
            hit = np.flatnonzero((counts[back] > 1) & alone[owner])
            owner, place = owner[hit], place[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(hit)) - 1 if len(hit) else first
            row = pa.array(owner[first])
            start = np.asarray(part.column("start"))[owner[first]]
            yield pa.record_batch(
                [part.column("doc_id").combine_chunks().take(row), part.column("tag").combine_chunks().take(row),
                 pa.array((start + place[first]).astype(np.int32)), pa.array((start + place[last] + LENGTH).astype(np.int32))],
                names=["doc_id", "tag", "begin", "end"],
            )

    def _pieces(rows: pa.Table):
        """Whole keys, about 4000 stretches at a time."""
        key = np.asarray(rows.column("key"))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        a = 0
        while a < len(key):
            later = starts[starts >= a + 4000]
            b = int(later[0]) if len(later) else len(key)
            yield rows.slice(a, b - a)
            a = b

    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        key = np.asarray(rows.column("key"))
        cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
        if cut:
            yield from spans(rows.slice(0, cut))
        kept = rows.slice(cut)
    if kept is not None:
        yield from spans(kept)


def _spread_rows(batches):
    """One row per window, for keys with very many contexts."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            hashes, owner, place = _window_hashes(part.column("bytes"))
            row = pa.array(owner)
            start = np.asarray(part.column("start"))[owner] + place
            yield pa.record_batch(
                [part.column("doc_id").take(row), part.column("tag").take(row), part.column("alone").take(row),
                 pa.array(start.astype(np.int32)), pa.array(hashes.view(np.int64))],
                names=["doc_id", "tag", "alone", "begin", "hash"],
            )


def _cut_rows(with_text: bool):
    def run(batches):
        for part in tk.text_slices(batches, limit=2 << 20):
            out = []
            for text, spans in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                data = (text or "").encode()
                kept, at, removed, runs = [], 0, 0, 0
                reach = -1  # end of the last removed run
                for span in sorted((s["begin"], s["end"]) for s in spans or ()):
                    begin, end = max(span[0], at), span[1]
                    if span[0] > reach:
                        runs += 1
                    reach = max(reach, end)
                    if end <= at:
                        continue
                    kept.append(data[at:begin])
                    removed += end - begin
                    at = end
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
            columns = [part.column("doc_id"), *[pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array([o[4] for o in out], pa.binary()))
                names.append("kept_bytes")
            yield pa.record_batch(columns, names=names)

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """Spans ``(doc_id, tag, begin, end)`` of ``docs(doc_id, tag, text)`` that cover all repeated windows."""
    path = scratch.path("anchors")
    batch = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(batches)).cast("int")
    docs.mapInArrow(_anchor_rows, _ANCHOR).withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    table = docs.sparkSession.read.schema(f"{_ANCHOR}, batch int").parquet(path)
    family = SuffixFamily(scratch)
    for k in range(batches):
        family.add(table.filter(F.col("batch") == k).select("key", "context"))
    shared = family.shared()
    hits = scratch.cut(table.drop("batch").join(shared, ["key", "context"]), "hits")
    last = F.col("start") + F.col("windows") - 1 + LENGTH
    found = hits.filter("n > 1").select("doc_id", "tag", F.col("start").alias("begin"), last.alias("end"))
    # Of each context of a key with several, one occurrence is looked at.
    chosen = (
        hits.filter("contexts > 1")
        .groupBy("key", "context")
        .agg(
            F.min(F.struct("doc_id", "tag", "start", "windows")).alias("s"), F.first("n").alias("n"), F.first("contexts").alias("contexts")
        )
        .select("s.doc_id", "s.tag", F.struct("s.start", "s.windows", "key", (F.col("n") == 1).alias("alone"), (F.col("contexts") > MOST_CONTEXTS).alias("many")).alias("one"))
        .groupBy("doc_id", "tag")
        .agg(F.collect_list("one").alias("listed"))  # no more than the anchors of one document
        .withColumnsRenamed({"doc_id": "_d", "tag": "_t"})
    )
    stretches = scratch.cut(
        docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")))
        .dropDuplicates(["doc_id", "tag"])
        .select("doc_id", "tag", "text", "listed")
        .mapInArrow(_stretches, "doc_id long, tag int, start int, key long, alone boolean, many boolean, bytes binary"),
        "stretches",
    )
    span = "doc_id long, tag int, begin int, end int"
    near = stretches.filter("NOT many").repartition("key").sortWithinPartitions("key").mapInArrow(_compare_rows, span)
    windows = stretches.filter("many").mapInArrow(_spread_rows, "doc_id long, tag int, alone boolean, begin int, hash long")
    windows = scratch.cut(windows, "windows")
    twice = scratch.cut(windows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "twice")
    far = windows.filter("alone").join(twice, "hash").select("doc_id", "tag", "begin", (F.col("begin") + LENGTH).alias("end"))
    return found.unionAll(near).unionAll(far)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", scratch: Scratch | None = None, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept_bytes``) for each row of ``docs``.

    Every byte covered by a ``LENGTH``-byte string that also starts elsewhere goes, all occurrences
    alike.  A null text is an empty one; texts shorter than ``LENGTH`` bytes stay.  Rows are told apart by
    id and text, so rows without an id, repeated rows and rows that share an id are handled; the copies
    of a repeated row remove each other.  Ids are whole numbers.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text")).withColumn("tag", F.hash("text"))
    spans = (
        repeated_spans(rows, scratch)
        .groupBy("doc_id", "tag")
        .agg(F.collect_list(F.struct("begin", "end")).alias("spans"))  # no more than the windows of one document
        .withColumnsRenamed({"doc_id": "_d", "tag": "_t"})
    )
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tag") == F.col("_t")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    return joined.select("doc_id", "text", "spans").mapInArrow(_cut_rows(with_text), schema)

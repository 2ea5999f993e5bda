"""Packing documents into sequences of fixed length: bounded-space online best-fit.

Documents are tokenised where they are read; only five numbers per piece are
shuffled.  Full pieces are sequences of their own.  Every packer (one per task)
keeps a fixed number of open bins in a bitset keyed by free space: a piece goes
where it leaves the least room; if it fits nowhere and all bins are open, the
fullest bin is closed.

With an order, packers take ranges of it and their pieces in that order, so sequences
follow the order of the documents as far as ``OPEN_BINS`` open bins let them.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.encoding import piece_encoder, word_bpe_path
from ledgerloom.session import Scratch

LENGTH = 4096
END_ID = 1
OPEN_BINS = 1024


class BestFit:
    """Open bins by free space; bit f of ``mask`` is set if a bin with f free tokens is open."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]
        self.mask = 0
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.bins[free]
        number = bins.pop()
        if not bins:
            self.mask ^= 1 << free
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset for a piece of ``size`` tokens."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1  # the least room that is enough
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.mask & -self.mask).bit_length() - 1)  # the fullest closes
            free, number = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            if not self.bins[left]:
                self.mask |= 1 << left
            self.bins[left].append(number)
            self.open += 1
        return number, self.length - free


_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, length: int = LENGTH,
                 with_ids: bool = False, order: Sequence[Column] = ()) -> DataFrame:
    """One row per piece of each document: ids, then the end id, cut every ``length`` tokens.

    A null text is an empty one: a single piece that holds the end id.  With
    ``with_ids`` the ids follow as little-endian unsigned 32-bit bytes; with ``order``
    the document's place, ``_place``.
    """
    path = path or word_bpe_path()
    placed = bool(order)
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["_place"] * placed

    def run(batches):
        encoder = piece_encoder(path, False)
        for part in tk.text_slices(batches):
            rows, piece, start, size, crc, raw = [], [], [], [], [], []
            for i, ids in enumerate(encoder.encode(part.column("text").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    size.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    raw.append(own if with_ids else b"")
            columns = [part.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            columns += [pa.array(raw, pa.binary())] * with_ids
            if placed:
                columns.append(part.column("_place").take(pa.array(rows, pa.int32())))
            yield pa.record_batch(columns, names=names)

    place = [F.struct(*order).alias("_place")] if placed else []
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *place)
    schema = _PIECES.format(id=docs.schema[doc_id].dataType.simpleString()) + ", ids binary" * with_ids
    if placed:
        schema += f", _place {read.schema['_place'].dataType.simpleString()}"
    return read.mapInArrow(run, schema)


def pack(pieces: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to ``length`` tokens.

    Pieces are dealt over the shuffle partitions by hash, or in ranges of ``_place`` if they
    have one, and reach each packer in a fixed order, so a repeated task packs alike.  A packer holds ``open_bins`` bins
    and no more, whatever the number of pieces.
    """

    def run(batches):
        bins = None
        for batch in batches:
            if bins is None:
                bins, base = BestFit(length, open_bins), int(batch.column("_packer")[0].as_py()) << 40
            at = [bins.place(n) for n in batch.column("length").to_pylist()]
            yield pa.record_batch(
                [*[batch.column(c) for c in names], pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    if placed := "_place" in names:
        dealt, order = pieces.repartitionByRange("_place", "piece"), [F.col("_place"), F.col("piece")]
    else:
        dealt, order = pieces.repartition("doc_id", "piece"), [F.xxhash64("doc_id", "piece")]
    return (
        dealt.withColumn("_packer", F.spark_partition_id())
        .sortWithinPartitions(*order, "doc_id", "piece", "start", "length", *(["ids_crc32"] if "ids_crc32" in names else []))
        .mapInArrow(run, schema)
        .drop(*["_place"] * placed)
    )


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, length: int = LENGTH,
                   order: Sequence[Column] = (), scratch: Scratch | None = None) -> DataFrame:
    """Where each piece of each document stands: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Rows without an id are packed too; repeated rows are packed once each.  With ``order``
    sequences are filled and numbered in the order of these columns of ``docs``.
    """
    pieces = token_pieces(docs, text, doc_id, path, length, order=order)
    if order:
        # Written once: the ranges are found by sampling, which would tokenise a second time.
        pieces = (scratch or Scratch(docs.sparkSession)).cut(pieces, "pieces")
    return pack(pieces, length)


def packed_sequences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, length: int = LENGTH) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, ids`` (array of at most ``length`` ids)."""
    placed = pack(token_pieces(docs, text, doc_id, path, length, with_ids=True), length)

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in row), "<u4").astype(np.int64) for row in batch.column("parts").to_pylist()]
            yield pa.record_batch(
                [batch.column("sequence_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array(ids, pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "ids"],
            )

    # A sequence holds at most ``length`` tokens, so what is gathered per key is bounded.
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.mapInArrow(run, "sequence_id long, n_tokens long, ids array<long>")

"""Token ids as bit-packed files: every id in the fewest bits its vocabulary needs.

A shard is one file:

    header   "PACKIDS1", bits per id (u32), ids per block (u32)
    blocks   ids packed from the lowest bit up; each block begins at a byte
    docs     id of each document (i64) and n + 1 offsets of their ids (u64)
    offsets  first byte of each block (u64)
    footer   ids, documents, blocks, place of ``docs``, place of ``offsets`` (u64 each), "PACKIDS1"

All numbers are little-endian.  A reader of any id range opens only the blocks that
hold it, and unpacks them with numpy.  Shards hold ascending ids and follow one another.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.llm.encoding import byte_bpe_path, piece_encoder
from ledgerloom.session import Scratch

MAGIC = b"PACKIDS1"
BLOCK_IDS = 1 << 16
END_ID = 0
_HEADER = struct.Struct("<8sII")
_FOOTER = struct.Struct("<QQQQQ8s")
NO_ID = np.iinfo(np.int64).min  # stands for a document without an id


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids below ``2**bits`` packed from the lowest bit up, filled to a whole byte."""
    ids = ids.astype("<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {ids.max()} needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = ((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(spread.ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from the ``first`` on."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)])
    at = (first + np.arange(count, dtype=np.int64)) * bits
    byte = at >> 3
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k].astype(np.uint64) << tk.U64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & tk.U64((1 << bits) - 1)).astype("<u4")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; the file appears under its name only when it is complete."""

    def __init__(self, uri: str, bits: int, attempt: str) -> None:
        self.files, self.path = _open(uri)
        self.partial = f"{self.path}.{attempt}.partial"
        self.files.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.files.open_output_stream(self.partial)
        self.bits = bits
        self.out.write(_HEADER.pack(MAGIC, bits, BLOCK_IDS))
        self.size = _HEADER.size
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.docs: list[int] = []
        self.starts = [0]
        self.blocks: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 16 * BLOCK_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        stop = len(ids) if last else len(ids) - len(ids) % BLOCK_IDS
        for at in range(0, stop, BLOCK_IDS):
            data = pack_ids(ids[at : min(at + BLOCK_IDS, stop)], self.bits)
            self.blocks.append(self.size)
            self.out.write(data)
            self.size += len(data)
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> int:
        self._flush(True)
        docs_at = self.size
        tables = np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes()
        self.out.write(tables)
        self.out.write(np.array(self.blocks, "<u8").tobytes())
        self.out.write(_FOOTER.pack(self.ids, len(self.docs), len(self.blocks), docs_at, docs_at + len(tables), MAGIC))
        self.out.close()
        self.files.move(self.partial, self.path)
        return self.ids


class Shard:
    """Random access to the ids of one shard."""

    def __init__(self, uri: str) -> None:
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        self.n_ids, n_docs, n_blocks, docs_at, blocks_at, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        head, self.bits, self.block_ids = _HEADER.unpack(self.file.read_at(_HEADER.size, 0))
        if head != MAGIC or magic != MAGIC:
            raise ValueError(f"{uri} is not a whole shard")
        self.doc_ids = np.frombuffer(self.file.read_at(8 * n_docs, docs_at), "<i8")
        self.starts = np.frombuffer(self.file.read_at(8 * (n_docs + 1), docs_at + 8 * n_docs), "<u8").astype(np.int64)
        offsets = np.frombuffer(self.file.read_at(8 * n_blocks, blocks_at), "<u8").astype(np.int64)
        self.offsets = np.append(offsets, docs_at)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` (not included), from the blocks that hold them."""
        found = [np.zeros(0, "<u4")]
        while start < stop:
            block = start // self.block_ids
            begin, end = self.offsets[block], self.offsets[block + 1]
            take = min(stop, (block + 1) * self.block_ids) - start
            found.append(unpack_ids(self.file.read_at(int(end - begin), int(begin)), self.bits, take, start % self.block_ids))
            start += take
        return np.concatenate(found)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


def write_token_files(docs: DataFrame, folder: str, text: str = "text", doc_id: str = "doc_id", path: str | None = None,
                      shards: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """Encode every whole text, add the end id, write shards in ascending id order; the list of shards.

    ``folder`` is one that all executors can write to.  Ids are whole numbers; rows without one come
    last, repeated rows stay.  A null text is an empty one.  Columns of the result: ``shard, uri, n_docs,
    n_ids, start`` with ``start`` the ids of all shards before.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    path = path or byte_bpe_path()
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([END_ID], "<u4")

    def run(batches):
        encoder = piece_encoder(path, True)
        context = TaskContext.get()
        writer = None
        for part in tk.text_slices(batches):
            if writer is None:
                shard = part.column("_shard")[0].as_py()
                uri = f"{folder.rstrip('/')}/shard-{shard:06d}.ids"
                writer = ShardWriter(uri, bits_for(encoder.tokenizer.get_vocab_size()), f"{context.taskAttemptId()}")
            for key, raw in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                writer.add(key, np.concatenate([np.frombuffer(raw, "<u4"), end]))
        if writer is not None:
            n = writer.close()
            yield pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(writer.docs)], pa.int64()), pa.array([n], pa.int64())],
                names=["shard", "uri", "n_docs", "n_ids"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    written = scratch.cut(
        rows.repartitionByRange(shards, order)
        .withColumn("_shard", F.spark_partition_id())
        .sortWithinPartitions(order, F.xxhash64("text"))
        .mapInArrow(run, "shard int, uri string, n_docs long, n_ids long"),
        "shards",
    )
    # One row per shard.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, read back from the files."""

    def run(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist()):
                shard = Shard(uri)
                n = len(shard.doc_ids)
                a = 0
                while a < n:  # as many documents as about sixteen blocks hold
                    limit = shard.starts[a] + 16 * BLOCK_IDS
                    b = max(a + 1, int(np.searchsorted(shard.starts, limit, side="right")) - 1)
                    raw = memoryview(shard.ids(int(shard.starts[a]), int(shard.starts[b])).tobytes())
                    at = (shard.starts[a : b + 1] - shard.starts[a]).tolist()
                    crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at, at[1:])]
                    keys = shard.doc_ids[a:b]
                    yield pa.record_batch(
                        [pa.array(keys, mask=keys == NO_ID), pa.array(shard.starts[a:b] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    a = b

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(tasks).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

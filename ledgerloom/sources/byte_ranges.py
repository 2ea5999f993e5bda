"""Parts of files as Spark data sources: leading bytes, and the directories of zip archives.

A file of any size costs the bytes asked for.  Files are listed once and dealt to
tasks in groups; each task opens its files one after the other and reads ranges, so
no cell ever holds a whole file.  Any file system pyarrow opens will do.
"""

from __future__ import annotations

import fnmatch
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

GROUP = 256  # files of one task
TAIL = 66_000  # bytes that hold the end record of an archive and its longest comment
CHUNK = 1 << 20  # bytes of a directory read at a time


def opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path inside it, and what stands before that path in Spark's names."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path), "file:"
    system, inside = fs.FileSystem.from_uri(path)
    return system, inside, path[: path.rindex(inside)] if inside in path else path.split("://")[0] + "://"


def list_paths(paths: list[str]) -> Iterator[tuple[str, int]]:
    """Name and size of all files under the paths (folders, files, or patterns), empty ones too; hidden names are skipped."""
    for path in paths:
        parts = path.split("/")
        wild = next((i for i, part in enumerate(parts) if any(c in part for c in "*?[")), len(parts))
        system, base, prefix = opened("/".join(parts[:wild]) or "/")
        info = system.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(base, recursive=True))
        pattern = "/".join([base.rstrip("/"), *parts[wild:]])
        for f in sorted((f for f in found if f.is_file), key=lambda f: f.path):
            hidden = any(p[:1] in "._" for p in f.path[len(base) :].split("/") if p)
            fits = wild == len(parts) or fnmatch.fnmatchcase(f.path, pattern) or fnmatch.fnmatchcase(f.path, pattern + "/*")
            if fits and (info.is_file or not hidden):
                yield prefix + f.path, f.size


@dataclass
class Group(InputPartition):
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Group]:
        files = list(list_paths(json.loads(self.options["paths"])))
        ending = tuple(json.loads(self.options.get("endings", "[]")))
        files = [f for f in files if not ending or f[0].lower().endswith(ending)]
        size = max(1, min(GROUP, -(-len(files) // int(self.options.get("tasks", "1")))))
        return [Group(files[i : i + size]) for i in range(0, len(files), size)] or [Group([])]

    def read(self, partition: Group) -> Iterator[tuple]:
        for path, length in partition.files:
            yield from self.rows(path, length)


class HeadReader(_Reader):
    def rows(self, path: str, length: int) -> Iterator[tuple]:
        system, inside, _ = opened(path)
        wanted, head = int(self.options.get("bytes", "4096")), b""
        opens = path.lower().endswith(tuple(json.loads(self.options.get("opens", '[""]'))))
        if length and wanted and opens and length <= int(self.options.get("most", str(length))):
            plain = {"compression": None} if self.options.get("raw", "true") == "true" else {}
            with system.open_input_stream(inside, **plain) as stream:
                # With "lines" the head grows until it holds a line that is not empty.
                while piece := stream.read(wanted):
                    head += piece
                    text = head.lstrip(b"\r\n\0")
                    if "lines" not in self.options or b"\n" in text or b"\r" in text:
                        break
        yield path, length, head


class FileHeads(DataSource):
    """path, length and the first bytes of each file."""

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> HeadReader:
        return HeadReader(dict(self.options))


def directory_place(tail: bytes, length: int, read_at) -> tuple[int, int] | None:
    """Offset and size of a zip archive's central directory, from its last bytes; None when it has no end record.

    ``read_at`` (offset, size) serves the one further record of archives with 64-bit places.
    """
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        return None
    size, offset = struct.unpack_from("<II", tail, at + 12)
    locator = at - 20
    if 0xFFFFFFFF in (size, offset) and locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
        (end,) = struct.unpack_from("<Q", tail, locator + 8)
        record = read_at(end, 56)
        if record[:4] != b"PK\x06\x06":
            return None
        size, offset = struct.unpack_from("<QQ", record, 40)
    return (offset, size) if offset + size <= length else None


def _long_sizes(extra: bytes, file_size: int, compressed: int) -> tuple[int, int]:
    """Sizes from the extra field with 64-bit values, where the plain ones are full."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = list(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            file_size = values.pop(0) if file_size == 0xFFFFFFFF and values else file_size
            compressed = values.pop(0) if compressed == 0xFFFFFFFF and values else compressed
        at += 4 + size
    return file_size, compressed


def directory_entries(chunks: Iterator[bytes]) -> Iterator[tuple[str, int, int, bool]]:
    """(name, compressed size, size, encrypted) of each entry of a central directory that comes in chunks."""
    held = b""
    for chunk in chunks:
        held += chunk
        at = 0
        while len(held) >= at + 46 and held[at : at + 4] == b"PK\x01\x02":
            flags, compressed, size = struct.unpack_from("<8xH10xII", held, at)
            name, extra, comment = struct.unpack_from("<HHH", held, at + 28)
            end = at + 46 + name + extra + comment
            if len(held) < end:
                break
            text = held[at + 46 : at + 46 + name].decode("utf-8" if flags & 0x800 else "cp437", "replace")
            size, compressed = _long_sizes(held[at + 46 + name : at + 46 + name + extra], size, compressed)
            yield text, compressed, size, bool(flags & 1)
            at = end
        held = held[at:]


class EntryReader(_Reader):
    def rows(self, path: str, length: int) -> Iterator[tuple]:
        system, inside, _ = opened(path)
        with system.open_input_file(inside) as file:

            def read_at(offset: int, size: int) -> bytes:
                file.seek(offset)
                return file.read(size)

            place = directory_place(read_at(max(0, length - TAIL), TAIL), length, read_at)
            if place is not None:
                offset, size = place
                chunks = (read_at(at, min(CHUNK, offset + size - at)) for at in range(offset, offset + size, CHUNK))
                for i, entry in enumerate(directory_entries(chunks)):
                    yield path, i, *entry


class ArchiveEntries(DataSource):
    """One row per entry of each zip archive; archives without a readable directory give none."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return "archive_id string, entry_no long, name string, compressed_size long, file_size long, encrypted boolean"

    def reader(self, schema) -> EntryReader:
        return EntryReader(dict(self.options))


def _load(spark: SparkSession, source: type[DataSource], path: str | list[str], **options: str) -> DataFrame:
    spark.dataSource.register(source)
    paths = [path] if isinstance(path, str) else list(path)
    tasks = str(spark.sparkContext.defaultParallelism)
    return spark.read.format(source.name()).options(paths=json.dumps(paths), tasks=tasks, **options).load()


def file_heads(
    spark: SparkSession,
    path: str | list[str],
    size: int = 4096,
    lines: bool = False,
    opens: list[str] | None = None,
    most: int | None = None,
) -> DataFrame:
    """(path, length, head): the first ``size`` bytes of each file, empty files and any extension included.

    With ``lines`` compressed files are unpacked and a head grows, by ``size`` at a time, until it holds a whole line.
    Only names that end in one of ``opens`` (in any case) and files of at most ``most`` bytes are opened; the head of
    the others is empty.
    """
    more = {"lines": "true", "raw": "false"} if lines else {}
    if opens is not None:
        more["opens"] = json.dumps(opens)
    if most is not None:
        more["most"] = str(most)
    return _load(spark, FileHeads, path, bytes=str(size), **more)


def archive_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of the ``.zip`` files under a path, read from the archives' directories alone."""
    return _load(spark, ArchiveEntries, path, endings=json.dumps([".zip"]))

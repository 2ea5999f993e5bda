"""File sources and sinks: CSV, XML, file triage, archive manifests, batch status."""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.blocks import running_totals
from ledgerloom.sources.byte_ranges import archive_entries, file_heads

HEAD_BYTES = 1 << 16  # bytes of a file that are read for its header line

# Extensions and limits of the file checks.
TABLE_EXTENSIONS = (".csv", ".xlsx", ".xls", ".xml")
ARCHIVE_EXTENSIONS = (".zip", ".rar", ".7z", ".gz", ".tar", ".bz2", ".xz")
DANGEROUS_EXTENSIONS = (
    ".exe", ".bat", ".sh", ".py", ".js", ".php", ".rb",
    ".dll", ".so", ".bin", ".cmd", ".ps1", ".vbs",
)
# Uploads are refused for these as well.
REFUSED_UPLOADS = (*DANGEROUS_EXTENSIONS, ".jar", ".msi", ".dmg", ".app", ".scr", ".pif", ".com")
TEXT_EXTENSIONS = (".csv", ".xml", ".txt")
SIGNATURES = {
    ".pdf": ("25504446",),
    ".zip": ("504B0304",),
    ".xlsx": ("504B0304", "D0CF11E0"),
    ".xls": ("504B0304", "D0CF11E0"),
    ".png": ("89504E47",),
    ".jpg": ("FFD8FF",),
    ".jpeg": ("FFD8FF",),
    ".tif": ("49492A", "4D4D00"),
    ".tiff": ("49492A", "4D4D00"),
    ".bmp": ("424D",),
    ".webp": ("52494646",),
}
MAX_FILE_BYTES = 200 * 1024 * 1024
MAX_ARCHIVE_FILES = 200
MAX_ARCHIVE_BYTES = 500 * 1024 * 1024
MAX_RATIO = 100
PREVIEW_LIMIT = 1000
WIDEST = 100  # columns that one repeated child may take
DELIMITERS = (",", "\t", ";", "|")


# --- CSV --------------------------------------------------------------------


def _delimiter(sample: list[str]) -> str:
    """The delimiter that splits the lines most evenly."""
    best, best_score = ",", (0, 0)
    for d in DELIMITERS:
        counts = [line.count(d) for line in sample]
        if not counts or not counts[0]:
            continue
        score = (sum(c == counts[0] for c in counts), counts[0])
        if score > best_score:
            best, best_score = d, score
    return best


def _lines(head: bytes, encoding: str, most: int) -> list[str]:
    """The first lines of a file's head that are not empty, without a byte order mark."""
    text = head.decode(encoding, "replace").lstrip("\ufeff")
    return [line for line in re.split(r"\r\n|\n|\r", text) if line][:most]


def sniff_delimiter(spark: SparkSession, path: str, lines: int = 40, encoding: str = "UTF-8") -> str:
    """Delimiter judged on the first lines of a file, of which the first 64 KB are read."""
    first = file_heads(spark, path, HEAD_BYTES, lines=True).filter("length > 0").limit(1).collect()
    return _delimiter([line for r in first for line in _lines(r["head"], encoding, lines)])


def header_groups(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> list[tuple[str, list[str]]]:
    """Files by header line, in the order of their names: (header, files).

    Of each file the first 64 KB are read, more only where the header is longer.  One
    row per file comes to the driver, as the scans that follow list files anyway.
    """

    @F.pandas_udf("string")
    def header(heads: pd.Series) -> pd.Series:
        return heads.map(lambda head: next(iter(_lines(head, encoding, 1)), None))

    found = file_heads(spark, path, HEAD_BYTES, lines=True).filter("length > 0")
    groups: dict[str, list[str]] = {}
    for r in found.select("path", header("head").alias("header")).filter("header IS NOT NULL").orderBy("path").collect():
        groups.setdefault(r["header"], []).append(r["path"])
    return list(groups.items())


def _header_names(header: str, sep: str) -> list[str]:
    """Column names of a header line; repeated names get their position, empty ones ``_c`` and it."""
    names = next(csv.reader([header], delimiter=sep), [])
    lowered = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lowered.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    sep: str | None = None,
    encoding: str = "UTF-8",
    max_rows: int | None = None,
    multi_line: bool = False,
    tag: bool = False,
) -> DataFrame:
    """Header CSV as text columns; a row that does not fit goes to ``_corrupt_record``.

    Every file is read by its own header: files with one header are one scan, and
    the scans are joined by column name, so columns may stand in any order and
    may be missing in some files.  Bytes that are not valid in ``encoding`` become
    the replacement character.  ``multi_line`` allows line breaks inside quoted
    cells; such files cannot be split, so each is read by one task.  ``tag`` adds
    ``_file`` (a row's file) and ``_bad`` (it did not fit).
    """
    frames = []
    for header, members in header_groups(spark, path, encoding):
        own = sep or sniff_delimiter(spark, members[0], encoding=encoding)
        schema = T.StructType(
            [T.StructField(n, T.StringType()) for n in [*_header_names(header, own), "_corrupt_record"]]
        )
        df = (
            spark.read.options(header=True, sep=own, encoding=encoding, quote='"', escape='"', multiLine=multi_line)
            .option("mode", "PERMISSIVE")
            # With pruning the parser would not notice missing or surplus cells.
            .option("columnPruning", False)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("enforceSchema", True)
            .schema(schema)
            .csv(members)
        )
        frames.append(tag_files(df) if tag else df)
    if not frames:
        raise ValueError(f"no header line in {path}")
    df = union_files(frames)
    df = df.select(*[c for c in df.columns if c != "_corrupt_record"], "_corrupt_record")
    return df.limit(max_rows) if max_rows else df


def is_malformed(df: DataFrame) -> Column:
    """Test for rows that did not fit the header.

    Spark refuses to read the corrupt-record column alone, so the test also
    touches a data column.
    """
    first = next(c for c in df.columns if c != "_corrupt_record")
    return F.col("_corrupt_record").isNotNull() & (F.length(F.concat_ws("", F.col(f"`{first}`"))) >= 0)


def malformed_rows(df: DataFrame) -> DataFrame:
    """One row: number of rows that did not fit the header."""
    return df.agg(F.count_if(is_malformed(df)).alias("malformed_rows"))


def tag_files(df: DataFrame) -> DataFrame:
    """Rows of one scan with ``_file`` (their file) and ``_bad`` (did not fit)."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), is_malformed(df).alias("_bad"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header over all columns; rows with fewer columns were unioned by name before."""
    df.write.mode("overwrite").option("header", True).csv(path)


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Tables with different columns under one union of the columns."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def preview(df: DataFrame, rows: int = 100, order: list[str] | None = None) -> DataFrame:
    """The first rows, between 1 and 1000; in the order of ``order`` if given, else as the source has them."""
    return (df.orderBy(*order) if order else df).limit(max(1, min(PREVIEW_LIMIT, rows)))


# --- XML --------------------------------------------------------------------


def choose_row_tag(spark: SparkSession, path: str) -> str:
    """The most frequent tag besides the root; the root itself when nothing repeats."""
    tags = spark.read.text(path).select(
        F.posexplode(F.regexp_extract_all("value", F.lit(r"<([A-Za-z_][\w.:\-]*)"), 1)).alias("_at", "raw"),
        F.monotonically_increasing_id().alias("_line"),
    )
    counted = tags.groupBy(F.regexp_replace("raw", r"\A.*:", "").alias("tag")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_line", "_at")).alias("first")
    )
    # Two single rows come back: the first tag of the file and the most frequent other one.
    root = counted.orderBy("first").limit(1).collect()
    if not root:
        raise ValueError("no tags found")
    best = (
        counted.filter((F.col("tag") != root[0]["tag"]) & (F.col("n") > 1))
        .orderBy(F.col("n").desc(), "first")
        .limit(1)
        .collect()
    )
    return best[0]["tag"] if best else root[0]["tag"]


def _flat_cells(c: Column, kind: T.DataType, name: str, level: int, depth: int) -> Column:
    """All values under ``c`` as an array of (name, text), named as the columns would be, repeats of any number."""
    if isinstance(kind, T.StructType) and level <= depth:
        inner = lambda f: name if f.name == "_VALUE" else f"{name}_{f.name.removeprefix('_')}"
        parts = [_flat_cells(c[f.name], f.dataType, inner(f), level + 1, depth) for f in kind.fields]
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType) and level <= depth:
        # Inside the repeat, names are relative to it; its number is put before them.
        def numbered(item: Column, i: Column) -> Column:
            cells = _flat_cells(item, kind.elementType, "", level, depth)
            return F.transform(cells, lambda x: F.struct(F.concat(F.lit(f"{name}_"), i.cast("string"), x["name"]).alias("name"), x["value"].alias("value")))

        return F.coalesce(F.flatten(F.transform(c, numbered)), F.array().cast("array<struct<name: string, value: string>>"))
    return F.array(F.struct(F.lit(name).alias("name"), c.cast("string").alias("value")))


def flatten_structs(df: DataFrame, max_items: dict[str, int], depth: int = 5, widest: int = WIDEST) -> DataFrame:
    """Nested XML columns to flat ones: ``child_field``, repeats numbered ``child_0_field``.

    ``max_items`` gives the number of columns to make per repeated child, by its
    name without numbers.  A child that would take more than ``widest`` of them (one
    inside repeats times theirs) becomes one map column ``child`` instead, from the
    names the columns would have had to their texts; values that are missing have no
    entry.  So the number of columns is bounded by the tags of a record, not by its
    repeats, and nothing is left out.
    """
    out: list[Column] = []

    def walk(c: Column, kind: T.DataType, name: str, plain: str, level: int, copies: int) -> None:
        if isinstance(kind, T.StructType) and level <= depth:
            for f in kind.fields:
                clean = f.name.removeprefix("_")
                under = lambda above: above if f.name == "_VALUE" else (f"{above}_{clean}" if above else clean)
                walk(c[f.name], f.dataType, under(name), under(plain), level + 1, copies)
        elif isinstance(kind, T.ArrayType) and level <= depth:
            copies *= max_items.get(plain, 0)
            if copies > widest:
                present = F.filter(_flat_cells(c, kind, name, level, depth), lambda x: x["value"].isNotNull())
                out.append(F.map_from_entries(present).alias(name))
            else:
                for i in range(max_items.get(plain, 0)):
                    walk(F.get(c, F.lit(i)), kind.elementType, f"{name}_{i}", plain, level, copies)
        else:
            out.append(c.cast("string").alias(name))

    for f in df.schema.fields:
        if f.name.startswith("_parent_"):
            out.append(F.col(f.name))
        else:
            name = f.name.removeprefix("_")
            walk(F.col(f"`{f.name}`"), f.dataType, name, name, 1, 1)
    return df.select(*out)


def _array_sizes(df: DataFrame) -> dict[str, int]:
    """Longest length of each repeated child, inside repeats too (one aggregation, one row back)."""
    paths: list[tuple[str, Column]] = []

    def walk(longest: Callable[[Callable[[Column], Column]], Column], kind: T.DataType, name: str) -> None:
        # ``longest`` gives the largest value that a function takes on the instances of this place in a record.
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                clean = f.name.removeprefix("_")
                under = name if f.name == "_VALUE" else (f"{name}_{clean}" if name else clean)
                walk(lambda fn, f=f: longest(lambda c: fn(c[f.name])), f.dataType, under)
        elif isinstance(kind, T.ArrayType):
            paths.append((name, longest(F.size)))
            walk(lambda fn: longest(lambda c: F.array_max(F.transform(c, lambda x: fn(x)))), kind.elementType, name)

    for f in df.schema.fields:
        walk(lambda fn, f=f: fn(F.col(f"`{f.name}`")), f.dataType, f.name.removeprefix("_"))
    if not paths:
        return {}
    row = df.agg(*[F.max(c).alias(f"s{i}") for i, (_, c) in enumerate(paths)]).first()
    return {name: max(0, int(row[f"s{i}"] or 0)) for i, (name, _) in enumerate(paths)}


def read_xml(
    spark: SparkSession, path: str, row_tag: str | None = None, parent_tag: str | None = None, widest: int = WIDEST
) -> DataFrame:
    """XML records as flat text columns; a child with more than ``widest`` repeats is a map column (``flatten_structs``).

    With ``parent_tag`` the parent's attributes are copied to each record as
    ``_parent_<tag>_<attribute>``.
    """
    row_tag = row_tag or choose_row_tag(spark, path)
    read = lambda tag: spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).load(path)
    if parent_tag is None:
        df = read(row_tag)
    else:
        parents = read(parent_tag)
        attrs = [c for c in parents.columns if c.startswith("_") and c != "_VALUE"]
        copied = [F.col(c).alias(f"_parent_{parent_tag}{c}") for c in attrs]
        child = parents.schema[row_tag].dataType
        records = F.col(row_tag) if isinstance(child, T.ArrayType) else F.array(row_tag)
        df = parents.select(*copied, F.explode(records).alias("_r")).select(
            *[F.col(f"_parent_{parent_tag}{c}") for c in attrs], "_r.*"
        )
    return flatten_structs(df, _array_sizes(df), widest=widest)


# --- batches of files and file triage ---------------------------------------


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)\z", 1))


def plain_path(c: Column) -> Column:
    """A path in one spelling: listings and scans write file:///x and file:/x."""
    return F.regexp_replace(c, r"\A([a-z0-9]+):/+", "$1:/")


def list_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Path, size and extension of files, empty ones too, without opening them."""
    return file_heads(spark, path, 0).select(plain_path(F.col("path")).alias("path"), "length", extension(F.col("path")).alias("ext"))


def batch_status(files: DataFrame, rows: DataFrame) -> DataFrame:
    """Status per file of a batch: success with its row count, failed or skipped.

    ``rows`` are the rows read, tagged (``read_csv(..., tag=True)`` or ``tag_files``).
    """
    counted = rows.groupBy(F.col("_file").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("_bad").alias("bad")
    )
    good = F.coalesce(F.col("rows") - F.col("bad"), F.lit(0))
    return files.join(counted.withColumn("path", plain_path(F.col("path"))), "path", "left").select(
        "path",
        F.when(~F.col("ext").isin(".csv", ".xml"), "skipped")
        .when((F.col("length") == 0) | (good == 0), "failed")
        .otherwise("success")
        .alias("status"),
        good.alias("row_count"),
    )


def batch_totals(status: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(
        F.count(F.lit(1)).alias("files"),
        n("success").alias("succeeded"),
        n("failed").alias("failed"),
        n("skipped").alias("skipped"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows"),
    )


def signature_verdict(ext: Column, length: Column, head: Column, text_head: Column) -> Column:
    """Verdict on one file: ``ok`` or the reason it is refused.

    ``head`` are the first 12 bytes in hex, ``text_head`` the first 4 KB as text.
    """
    match = F.lit(None).cast("boolean")
    for e, starts in SIGNATURES.items():
        hit = F.lit(False)
        for s in starts:
            hit = hit | head.startswith(s)
        if e == ".webp":
            hit = hit & (F.substring(head, 17, 8) == "57454250")
        match = F.when(ext == e, hit).otherwise(match)
    opening = F.lower(F.ltrim(text_head))
    markup = opening.rlike(r"\A\s*(<!doctype\s+html|<html|<svg)")
    entity = text_head.rlike(r"(?i)<!DOCTYPE\s") & text_head.rlike(r"(?i)<!ENTITY\s")
    xml = F.regexp_replace(text_head, r"\A\x{feff}", "").rlike(r"\A\s*<[?!A-Za-z_]")
    return (
        F.when(ext.isin(*REFUSED_UPLOADS), "dangerous_extension")
        .when(~ext.isin(*TABLE_EXTENSIONS, *SIGNATURES, *TEXT_EXTENSIONS), "unsupported_extension")
        .when(length == 0, "empty_file")
        .when(length > F.when(ext == ".zip", MAX_ARCHIVE_BYTES).otherwise(MAX_FILE_BYTES), "file_too_large")
        .when((ext == ".xml") & markup, "not_xml_markup")
        .when((ext == ".xml") & ~xml, "invalid_xml")
        .when((ext == ".xml") & entity, "entity_declaration")
        .when(~ext.isin(*TEXT_EXTENSIONS) & (length < 8), "too_small")
        .when(match == F.lit(False), "signature_mismatch")
        .otherwise("ok")
    )


def triage_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Verdict per file from name, size and leading bytes; every file gets one, whatever the case of its extension.

    The first 4 KB are read, and only of files with an accepted extension and size.
    """
    accepted = sorted({*TABLE_EXTENSIONS, *SIGNATURES, *TEXT_EXTENSIONS})
    seen = file_heads(spark, path, 4096, opens=accepted, most=MAX_ARCHIVE_BYTES)
    ext = extension(F.col("path"))
    head, text_head = F.hex(F.substring("head", 1, 12)), F.coalesce(F.decode("head", "ISO-8859-1"), F.lit(""))
    return seen.select(
        plain_path(F.col("path")).alias("path"),
        "length",
        ext.alias("ext"),
        signature_verdict(ext, F.col("length"), head, text_head).alias("verdict"),
    )


# --- archives ---------------------------------------------------------------


def archive_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per archive entry: archive_id, entry_no, name, compressed_size, file_size, encrypted.

    Only an archive's last bytes and its directory are read, the latter in pieces, so archives of any size do.
    """
    return archive_entries(spark, path).withColumn("archive_id", plain_path(F.col("archive_id")))


def safe_entry_name(name: Column) -> Column:
    """Entry name without drive, leading slashes and ``..`` parts; empty when nothing is left."""
    slashed = F.regexp_replace(name, r"\\", "/")
    rooted = F.regexp_replace(slashed, r"\A([a-zA-Z]:)?/+", "")
    parts = F.filter(F.split(rooted, "/"), lambda p: (p != "") & (p != ".."))
    return F.array_join(parts, "/")


def archive_verdicts(manifest: DataFrame) -> DataFrame:
    """Verdict per entry: extracted, a reason for refusal, or not_reached.

    Reading stops once 200 files are taken or the sizes taken add up to more
    than 500 MB; the entry that crosses the size limit is not taken either.
    """
    name = safe_entry_name(F.col("name"))
    ext = F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)\z", 1))
    ratio = F.col("file_size") / F.when(F.col("compressed_size") > 0, F.col("compressed_size"))
    early = (
        F.when(name == "", "unsafe_path")
        .when(ext.isin(*DANGEROUS_EXTENSIONS), "dangerous_extension")
        .when(ext.isin(*ARCHIVE_EXTENSIONS), "nested_archive")
        .when(ratio > MAX_RATIO, "compression_ratio")
        .when(F.col("file_size") > MAX_ARCHIVE_BYTES, "exceeds_size")
    )
    locked = manifest.groupBy("archive_id").agg(F.bool_or("encrypted").alias("_locked"))
    checked = manifest.withColumns({"safe_name": name, "_early": early})
    taken = F.col("_early").isNull()
    summed = running_totals(
        checked, ["archive_id"], "entry_no",
        {
            "_files": F.when(taken, 1).otherwise(0),
            "_bytes": F.when(taken, F.col("file_size")).otherwise(0),
        },
    )
    files_before = F.col("_files") - F.when(taken, 1).otherwise(0)
    stopped = (files_before >= MAX_ARCHIVE_FILES) | (F.col("_bytes") > MAX_ARCHIVE_BYTES)
    return summed.join(locked, "archive_id").select(
        "archive_id",
        "entry_no",
        "safe_name",
        "file_size",
        F.when(F.col("_locked"), "encrypted_archive")
        .when(stopped, "not_reached")
        .otherwise(F.coalesce("_early", F.lit("extracted")))
        .alias("verdict"),
    )

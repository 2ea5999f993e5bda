"""Queries on file sources: tables written as files to the shared folder, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.text import is_blank
from ledgerloom.operators import validate as V
from ledgerloom.plans.catalog import query
from ledgerloom.plans.fixture_sql import blank, with_
from ledgerloom.plans.fixtures import fx_dirty, table
from ledgerloom.session import Scratch
from ledgerloom.sources import files
from ledgerloom.sources.byte_ranges import opened

_CUSTOMER = ["c_custkey", "c_name", "c_mktsegment"]


def _customers(spark, sf):
    return table(spark, sf, "customer").select(*_CUSTOMER)


def _keyed(df):
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), *[c for c in df.columns if c != "c_custkey" and c[0] != "_"])


@query("csv_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, sf):
    folder = Scratch(spark).path("csv")
    files.write_csv(_customers(spark, sf), folder)
    return _keyed(files.read_csv(spark, folder))


@query(
    "csv_mixed_headers",
    "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 = 1 THEN 'x;y' END AS note FROM customer",
)
def csv_mixed_headers(spark, sf):
    """Three files sets in one folder: other column order, a column more, a column less, another delimiter."""
    folder, customers = Scratch(spark).path("csv"), _customers(spark, sf)
    part = lambda k: customers.filter(F.col("c_custkey") % 3 == k)
    part(0).select("c_name", "c_custkey").write.csv(f"{folder}/a", header=True, sep=";")
    part(1).select("c_mktsegment", F.lit("x;y").alias("note"), "c_custkey", "c_name").write.csv(f"{folder}/b", header=True)
    part(2).write.csv(f"{folder}/c", header=True, sep="\t")
    return _keyed(files.read_csv(spark, [f"{folder}/{x}" for x in "abc"])).select("c_custkey", "c_name", "c_mktsegment", "note")


@query(
    "csv_malformed",
    """SELECT count(*) AS rows, count(*) FILTER (c_custkey % 10 IN (3, 7)) AS malformed_rows FROM customer""",
)
def csv_malformed(spark, sf):
    """Lines with a cell too many or too few."""
    folder = Scratch(spark).path("csv")
    k = F.col("c_custkey")
    line = F.concat_ws(",", k, F.when(k % 10 != 3, F.col("c_name")), "c_mktsegment", F.when(k % 10 == 7, F.lit("more")))
    lines = _customers(spark, sf).select(line.alias("a,b,c"))
    lines.write.csv(folder, header=True, sep="\x01", quote="")
    df = files.read_csv(spark, folder, sep=",")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(files.is_malformed(df)).alias("malformed_rows"))


@query("csv_line_breaks", "SELECT c_custkey, c_name || chr(10) || 'said \"hello\", twice' AS c_name FROM customer")
def csv_line_breaks(spark, sf):
    folder = Scratch(spark).path("csv")
    text = F.concat("c_name", F.lit('\nsaid "hello", twice'))
    _customers(spark, sf).select("c_custkey", text.alias("c_name")).write.csv(folder, header=True, escape='"')
    return _keyed(files.read_csv(spark, folder, sep=",", multi_line=True))


@query("csv_encoding", "SELECT c_custkey, c_name || ' é' AS c_name FROM customer")
def csv_encoding(spark, sf):
    folder = Scratch(spark).path("csv")
    named = _customers(spark, sf).select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"))
    named.write.csv(folder, header=True, encoding="ISO-8859-1")
    return _keyed(files.read_csv(spark, folder, encoding="ISO-8859-1"))


@query("xml_round_trip", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def xml_round_trip(spark, sf):
    folder = Scratch(spark).path("xml")
    _customers(spark, sf).write.format("xml").option("rowTag", "customer").option("rootTag", "customers").save(folder)
    return _keyed(files.read_xml(spark, folder, "customer"))


@query(
    "xml_parents",
    """SELECT n_name AS _parent_nation_name, c_custkey, count(*) OVER (PARTITION BY n_nationkey) AS siblings
 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def xml_parents(spark, sf):
    """Customers inside their nation, with the nation's attribute on each."""
    folder = Scratch(spark).path("xml")
    nested = (
        table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        # An element holds at most a thousand customers, so a nation of any size has as many as it needs.
        .groupBy(F.col("n_name").alias("_name"), F.floor(F.col("c_custkey") / 1000).alias("part"))
        .agg(F.collect_list(F.struct("c_custkey")).alias("customer"))
    )
    nested.drop("part").write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(folder)
    read = files.read_xml(spark, folder, "customer", "nation")
    sizes = read.groupBy("_parent_nation_name").agg(F.count(F.lit(1)).alias("siblings"))
    return read.join(sizes, "_parent_nation_name").select("_parent_nation_name", F.col("c_custkey").cast("long").alias("c_custkey"), "siblings")


@query(
    "xml_many_children",
    "SELECT n_name, c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def xml_many_children(spark, sf):
    """Records with up to a thousand children: maps, listed as rows again."""
    folder = Scratch(spark).path("xml")
    nested = (
        table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("_name"), F.floor(F.col("c_custkey") / 1000).alias("_part"))
        .agg(F.collect_list(F.struct(F.col("c_custkey").alias("_key"), F.col("c_name").alias("name"))).alias("customer"))
    )
    nested.write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(folder)
    read = files.read_xml(spark, folder, "nation", widest=5)
    cells = read.select("name", "part", F.explode("customer").alias("cell", "value"))
    number, field = (F.regexp_extract("cell", r"\Acustomer_(\d+)_(\w+)\z", i) for i in (1, 2))
    value = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    children = cells.withColumns({"number": number, "field": field}).groupBy("name", "part", "number")
    return children.agg(value("key").cast("long").alias("c_custkey"), value("name").alias("c_name")).select(
        F.col("name").alias("n_name"), "c_custkey", "c_name"
    )


@query(
    "batch_status",
    """SELECT s.status, s.files, CASE s.status WHEN 'success' THEN (SELECT count(*) FROM customer) ELSE 0 END AS row_count
 FROM (VALUES ('success', 2), ('failed', 1), ('skipped', 1)) s(status, files)""",
)
def batch_status(spark, sf):
    """Two good files, one with a header only, one of another kind."""
    folder, customers = Scratch(spark).path("batch"), _customers(spark, sf)
    for name, part in (("a", F.col("c_custkey") % 2 == 0), ("b", F.col("c_custkey") % 2 == 1), ("empty", F.lit(False))):
        customers.filter(part).coalesce(1).write.csv(f"{folder}/{name}", header=True)
    customers.limit(1).select(F.col("c_name")).coalesce(1).write.text(f"{folder}/other")
    listed = files.list_files(spark, folder)
    rows = files.read_csv(spark, [f"{folder}/{name}" for name in ("a", "b", "empty")], sep=",", tag=True)
    return files.batch_status(listed, rows).groupBy("status").agg(
        F.count(F.lit(1)).cast("int").alias("files"), F.sum("row_count").alias("row_count")
    )


@query(
    "schema_groups",
    with_(
        "dirty",
        f"""SELECT 'Invoice identifier' AS field_group, false AS found, NULL AS "column", 0 AS filled
 UNION ALL SELECT 'Vendor / Supplier', true, 'supplier_name', count(*) FILTER (NOT {blank('name')}) FROM dirty
 UNION ALL SELECT 'Amount / Total', true, 'amount', count(*) FILTER (NOT {blank('amount')}) FROM dirty""",
    ),
)
def schema_groups(spark, sf):
    """Required field groups of a table, and how many cells their column fills."""
    df = fx_dirty(spark, sf).withColumnRenamed("name", "supplier_name")
    columns = [c for c in df.columns if c[0] != "_"]
    filled = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    counts = filled.groupBy("column").agg(F.count_if(~is_blank("value")).alias("filled"))
    return V.required_groups(spark, columns).join(counts, "column", "left").select(
        "field_group", "found", "column", F.coalesce("filled", F.lit(0)).alias("filled")
    )


_TRIAGE = "element_at(array('.Csv', '.eXe', '.Pdf', '.xmL', '.doc', '.PNG'), cast(pmod(doc_id, 6) as int) + 1)"


def _write_each(df, folder: str):
    """Write each row's ``content`` as a file ``name``; a task run again writes the same files."""

    def write(batches):
        for batch in batches:
            system, base, _ = opened(folder)
            system.create_dir(base, recursive=True)
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with system.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content)
            yield batch.select(["name"])

    df.select("name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


@query(
    "file_triage",
    r"""SELECT doc_id, ext, bytes AS length, CASE WHEN ext = '.exe' THEN 'dangerous_extension' WHEN ext = '.doc' THEN 'unsupported_extension'
 WHEN bytes = 0 THEN 'empty_file' WHEN ext = '.xml' AND regexp_matches(lower(head), '^\s*(<!doctype\s+html|<html|<svg)') THEN 'not_xml_markup'
 WHEN ext = '.xml' AND NOT regexp_matches(head, '^\s*<[?!A-Za-z_]') THEN 'invalid_xml'
 WHEN ext = '.xml' AND regexp_matches(head, '(?i)<!DOCTYPE\s') AND regexp_matches(head, '(?i)<!ENTITY\s') THEN 'entity_declaration'
 WHEN ext IN ('.pdf', '.png') AND bytes < 8 THEN 'too_small' WHEN ext IN ('.pdf', '.png') AND NOT signed THEN 'signature_mismatch' ELSE 'ok' END AS verdict
FROM (SELECT doc_id, ext, left(body, 4096) AS head, strlen(body) + CASE WHEN signed THEN 4 ELSE 0 END AS bytes, signed FROM (
 SELECT doc_id, ext, doc_id % 5 <> 0 AND doc_id % 7 = 0 AND ext IN ('.pdf', '.png') AS signed,
  CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 AND ext = '.xml' THEN '<a>' || coalesce(text, '') ELSE coalesce(text, '') END AS body
 FROM (SELECT *, (['.csv', '.exe', '.pdf', '.xml', '.doc', '.png'])[(doc_id % 6 + 1)::INT] AS ext FROM documents)))""",
)
def file_triage(spark, sf):
    """All documents written as files, extensions in any case, every fifth empty, then judged by their leading bytes."""
    folder = Scratch(spark).path("triage")
    ext, doc = F.expr(_TRIAGE), F.col("doc_id")
    # Every seventh file begins as its kind should.
    start = F.when(doc % 7 == 0, F.when(ext == ".Pdf", F.lit("25504446")).when(ext == ".PNG", F.lit("89504E47")).when(ext == ".xmL", F.hex(F.lit("<a>"))))
    body = F.concat(F.unhex(F.coalesce(start, F.lit(""))), F.coalesce("text", F.lit("")).cast("binary"))
    _write_each(
        table(spark, sf, "documents").select(
            F.concat(doc.cast("string"), ext).alias("name"), F.when(doc % 5 == 0, F.lit(b"")).otherwise(body).alias("content")
        ),
        folder,
    )
    number = F.regexp_extract("path", r"(\d+)\.[A-Za-z]+\z", 1).cast("long")
    return files.triage_files(spark, folder).select(number.alias("doc_id"), "ext", "length", "verdict")

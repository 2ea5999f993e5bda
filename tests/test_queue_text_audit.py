"""Selections, commands, text fields, hash chains, files and streams."""

import datetime as dt
import gzip
import json
import os
import random
import tempfile
import zipfile

from pyspark.sql import functions as F

from ledgerloom.functions.text import clean_cell
from ledgerloom.operators import audit as A
from ledgerloom.operators import decisions as D
from ledgerloom.operators import selections as L
from ledgerloom.operators import text_fields as X
from ledgerloom.operators.runs import gap_runs, list_runs, union_runs
from ledgerloom.sources import byte_ranges, files
from ledgerloom.streaming import approvals as P
from ledgerloom.streaming import events as E
from ledgerloom.streaming import reconcile_stream as R
from ledgerloom.streaming.reconcile_stream import clean_stream
from ledgerloom.operators.cleaning import Step


def folder():
    return tempfile.mkdtemp(prefix="run-")


def test_a_field_is_searched_once_per_pattern(spark, capsys):
    """The first pattern with a value decides, and the plan names each search once."""
    df = spark.createDataFrame([("Invoice No: A-1\nref: B",), ("ref: B",), ("nothing",), (None,)], "t string")
    got = df.select(X.first_match(F.col("t"), X.PATTERNS["invoice_number"]).alias("n"))
    assert [r.n for r in got.collect()] == ["A-1", "B", None, None]
    one = df.select(X.first_match(F.col("t"), X.PATTERNS["tax"]).alias("n"))
    one.explain()
    assert capsys.readouterr().out.count("regexp_extract(") == 1


def test_commands(spark):
    texts = ["approve items 51 to 100", "reject first 5 rows", "please approve row number 3", "hold the remaining", "request purchase order for items 2 - 4", "sing"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
    got = [(r.verb, r.scope, r.start, r.end, r.picked) for r in L.parse_commands(df, "c", F.lit(60), F.lit(7)).orderBy("i").collect()]
    assert got == [
        ("approve", "range", 50, 59, 10), ("reject", "count", 7, 11, 5), ("approve", "single", 2, 2, 1), ("hold", "remaining", 7, 59, 53),
        ("request_po", "range", 1, 3, 3), (None, None, None, None, 0),
    ]


def test_selections(spark):
    queue = spark.range(20_000).select(F.col("id").alias("finding_id"), (F.col("id") % 2 == 0).alias("answered"))
    sel = spark.createDataFrame(
        [(1, "range", 2, 7, None, None), (2, "indices", None, None, None, [4, 5, 99999]), (3, "count", None, None, 3, None), (4, "empty", None, None, None, None), (5, "remaining", None, None, None, None)],
        "selection_id int, kind string, start long, end long, n int, positions array<long>",
    )
    got = L.resolve_selections(queue, sel).groupBy("selection_id").agg(F.count("*").alias("n"), F.sum("finding_id").alias("s")).collect()
    assert sorted(map(tuple, got)) == [(1, 3, 15), (2, 2, 9), (3, 3, 9), (5, 9996, 99999984)]


def test_conflicts(spark):
    a = spark.createDataFrame([(1, "approve", 0, 9), (1, "reject", 5, 12), (1, "hold", 20, 30), (2, "approve", 0, 3), (2, "approve", 3, 3)], "command_id int, verb string, start long, end long")
    got = sorted(map(tuple, L.conflicts(a).collect()))
    assert got == [(1, "approve", "reject", 5, [5, 6, 7, 8, 9]), (2, "approve", "approve", 1, [3])]


def test_text_fields(spark):
    text = "Tax Invoice No: A-77\nFrom: Bright Ideas GmbH\nDate: 3 May 2024\nSub Total $ 90.00\nGrand Total: $1,100.50\nAUD only"
    r = X.extract_fields(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.invoice_number, r.date, r.amount, r.currency) == ("A-77", "2024-05-03", 1100.5, "AUD")
    conf = X.extract_fields(spark.createDataFrame([("nothing here",)], "t string"), "t").select(X.confidence(rows=0)).first()[0]
    assert conf == 0.2
    tags = {x.line_no: (x.tag, x.tag_value) for x in X.tag_lines(spark.createDataFrame([(1, text)], "d int, t string"), "t").collect()}
    assert tags[0] == ("invoice_number", "A-77") and tags[4] == ("amount", "1,100.50")


def test_chain_accepts_what_it_builds(spark):
    df = spark.range(7).select(F.lit("2024-01-01").alias("d"), "id", F.format_string('{"n":%d}', "id").alias("b"))
    lines = A.build_chain(df, ["d"], "id", "b")
    assert json.loads(lines.first().line)["prevHash"] == A.GENESIS
    assert A.verify_chain(lines, ["d"]).first().valid
    bad = lines.withColumn("line", F.when(F.col("line_no") == 3, F.replace("line", F.lit('"n":2'), F.lit('"n":9'))).otherwise(F.col("line")))
    assert A.verify_chain(bad, ["d"]).select("valid", "broken_at_line", "problem").first() == (False, 3, "edited")
    gone = lines.filter("line_no != 4").withColumn("line_no", F.when(F.col("line_no") > 4, F.col("line_no") - 1).otherwise(F.col("line_no")))
    assert A.verify_chain(gone, ["d"]).first().broken_at_line == 4


def test_csv_xml_and_archives(spark):
    d = folder()
    with open(f"{d}/a.csv", "w") as f:
        f.write("Invoice #;Total\nA1;5\nA2;6\nA3\n")
    df = files.read_csv(spark, f"{d}/a.csv")
    assert df.columns[:2] == ["Invoice #", "Total"] and df.count() == 3
    assert files.malformed_rows(df).first()[0] == 1
    files.write_csv(df.drop("_corrupt_record"), f"{d}/out")
    assert files.read_csv(spark, f"{d}/out", sep=",").count() == 3

    os.mkdir(f"{d}/many")
    for name, body in (("x.csv", "p;q\n1;2\n"), ("y.csv", "p;q\n3;4\n5;6\n"), ("z.doc", "?"), ("e.csv", "")):
        with open(f"{d}/many/{name}", "w") as f:
            f.write(body)
    read = files.read_csv(spark, [f"{d}/many/x.csv", f"{d}/many/y.csv"], tag=True)
    status = files.batch_status(files.list_files(spark, f"{d}/many"), read)
    assert {(os.path.basename(r.path), r.status, r.row_count) for r in status.collect()} == {
        ("x.csv", "success", 1), ("y.csv", "success", 2), ("z.doc", "skipped", 0), ("e.csv", "failed", 0),
    }
    assert files.batch_totals(status).first().asDict() == {"files": 4, "succeeded": 2, "failed": 1, "skipped": 1, "rows": 3}

    with open(f"{d}/b.xml", "w") as f:
        f.write('<orders region="EU"><order id="1"><line><q>2</q></line><line><q>3</q></line></order><order id="2"><note>x</note></order>'
                '<order id="3"/></orders>')
    assert files.choose_row_tag(spark, f"{d}/b.xml") == "order"
    x = files.read_xml(spark, f"{d}/b.xml", "order", "orders")
    got = {r.id: r.asDict() for r in x.collect()}
    assert got["1"]["line_0_q"] == "2" and got["1"]["line_1_q"] == "3" and got["2"]["note"] == "x"
    assert got["3"]["_parent_orders_region"] == "EU"

    with zipfile.ZipFile(f"{d}/c.zip", "w") as z:
        for name in ("ok.csv", "../up.csv", "bad.exe", "in.zip"):
            z.writestr(name, "x" * 50)
    verdicts = files.archive_verdicts(files.archive_manifest(spark, f"{d}/c.zip"))
    assert {(r.safe_name, r.verdict) for r in verdicts.collect()} == {
        ("ok.csv", "extracted"), ("up.csv", "extracted"), ("bad.exe", "dangerous_extension"), ("in.zip", "nested_archive"),
    }
    with open(f"{d}/fake.xlsx", "wb") as f:
        f.write(b"not a workbook")
    with open(f"{d}/x.xml", "w") as f:
        f.write('<!DOCTYPE a [<!ENTITY b "c">]><a/>')
    os.mkdir(f"{d}/empty")
    open(f"{d}/empty/e.csv", "w").close()
    seen = {os.path.basename(r.path): r.verdict for r in files.triage_files(spark, d).collect()}
    assert {k: seen[k] for k in ("fake.xlsx", "x.xml", "c.zip", "a.csv", "e.csv")} == {
        "fake.xlsx": "signature_mismatch", "x.xml": "entity_declaration", "c.zip": "ok", "a.csv": "ok", "e.csv": "empty_file",
    }
    assert seen["z.doc"] == "unsupported_extension"


def test_xml_repeats_as_columns_or_maps(spark):
    """Repeats inside repeats; a record with many children makes one map column, whose entries are the columns it replaces."""
    d = folder()
    lines = "".join(f'<line no="{i}"><q>{i % 7}</q>{"<tag>a</tag><tag>b</tag>" if i == 1 else "<tag>c</tag>"}</line>' for i in range(3))
    with open(f"{d}/a.xml", "w") as f:
        f.write(f'<orders><order id="1">{lines}</order><order id="2"><line no="9"/></order><order id="3"><note>n</note></order></orders>')
    wide = {r.id: {k: v for k, v in r.asDict().items() if v is not None} for r in files.read_xml(spark, f"{d}/a.xml", "order").collect()}
    assert wide["1"] == {"id": "1", **{f"line_{i}_no": str(i) for i in range(3)}, **{f"line_{i}_q": str(i) for i in range(3)},
                         "line_0_tag_0": "c", "line_1_tag_0": "a", "line_1_tag_1": "b", "line_2_tag_0": "c"}
    maps = files.read_xml(spark, f"{d}/a.xml", "order", widest=2)
    assert set(maps.columns) == {"id", "line", "note"}
    for r in maps.collect():
        assert {"id": r.id, **({"note": r.note} if r.note else {}), **(r.line or {})} == wide[r.id]
    # Three lines fit, their tags (three times two) do not.
    some = files.read_xml(spark, f"{d}/a.xml", "order", widest=3)
    row = some.filter("id = 1").first()
    assert row.line_1_no == "1" and row.line_1_tag == {"line_1_tag_0": "a", "line_1_tag_1": "b"} and "line_1_tag_0" not in some.columns

    with open(f"{d}/b.xml", "w") as f:
        f.write('<all><r id="x">' + "".join(f"<v>{i}</v>" for i in range(20_000)) + '</r><r id="y"><v>1</v><v>2</v></r></all>')
    many = files.read_xml(spark, f"{d}/b.xml", "r")
    assert set(many.columns) == {"id", "v"}
    assert {r.id: (r.n, r.last) for r in many.selectExpr("id", "size(v) AS n", "v['v_19999'] AS last").collect()} == {"x": (20_000, "19999"), "y": (2, None)}


def test_byte_ranges(spark):
    """Large files, mixed-case names, 64-bit archives and odd ones, read in part only."""
    d = folder()
    for name in ("a.csv", "b.Csv", "c.CSV", "d.Pdf", "e.pdf", "_f.csv", ".g.csv", "sub/h.eXe"):
        os.makedirs(os.path.dirname(f"{d}/t/{name}"), exist_ok=True)
        with open(f"{d}/t/{name}", "w") as f:
            f.write("x,y\n1,2\n")
    with open(f"{d}/t/huge.Pdf", "wb") as f:
        f.write(b"%PDF-1.7 ")
        f.truncate(480 << 20)
    seen = {os.path.basename(r.path): (r.ext, r.verdict) for r in files.triage_files(spark, f"{d}/t").collect()}
    assert seen == {
        "a.csv": (".csv", "ok"), "b.Csv": (".csv", "ok"), "c.CSV": (".csv", "ok"), "d.Pdf": (".pdf", "signature_mismatch"),
        "e.pdf": (".pdf", "signature_mismatch"), "h.eXe": (".exe", "dangerous_extension"), "huge.Pdf": (".pdf", "file_too_large"),
    }
    heads = {os.path.basename(r.path): (r.length, bytes(r.head)) for r in byte_ranges.file_heads(spark, [f"{d}/t/*.Pdf"], 4).collect()}
    assert heads == {"d.Pdf": (8, b"x,y\n"), "huge.Pdf": (480 << 20, b"%PDF")}
    with open(f"{d}/wide.csv", "w") as f:
        f.write(",".join(f"c{i}" for i in range(20_000)) + "\n" + ",".join("1" * 20_000) + "\n")
    ((header, _),) = files.header_groups(spark, f"{d}/wide.csv")
    assert header.count(",") == 19_999
    with gzip.open(f"{d}/z.csv.gz", "wt") as f:
        f.write("k;v\n1;2\n")
    assert [tuple(r) for r in files.read_csv(spark, f"{d}/z.csv.gz").select("k", "v").collect()] == [("1", "2")]

    os.makedirs(f"{d}/zips")
    names = [f"dir/näme{i}.csv" for i in range(30_000)]
    with zipfile.ZipFile(f"{d}/zips/many.ZIP", "w") as z:
        for i, name in enumerate(names):
            z.writestr(name, b"y" * (i % 3))
        z.comment = b"c" * 60_000
    with open(f"{d}/zips/holes.zip", "wb") as f:
        f.truncate(5 << 30)
        f.seek(0, 2)
        with zipfile.ZipFile(f, "a") as z:
            z.writestr("late.txt", "z" * 9)
    for name, content in (("no.zip", b"PK nothing"), ("empty.zip", b"")):
        with open(f"{d}/zips/{name}", "wb") as f:
            f.write(content)
    got = files.archive_manifest(spark, f"{d}/zips").collect()
    rows = sorted((r.entry_no, r.name, r.file_size, r.compressed_size, r.encrypted) for r in got if r.archive_id.endswith("many.ZIP"))
    assert rows == [(i, name, i % 3, i % 3, False) for i, name in enumerate(names)]
    assert [(r.name, r.file_size) for r in got if not r.archive_id.endswith("many.ZIP")] == [("late.txt", 9)]


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_first_sightings_are_greedy(spark):
    df = spark.createDataFrame([("a", at(h)) for h in (0, 1, 24, 25, 40, 60)] + [("b", at(3))], "event_id string, ts timestamp")
    got = sorted((r.event_id, r.ts) for r in E.first_sightings(df).collect())
    assert got == [("a", at(0)), ("a", at(25)), ("a", at(60)), ("b", at(3))]


def _kept(times, span):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t > last + span:
            out.append(t)
            last = t
    return out


def test_first_sightings_of_a_hot_id_in_stretches(spark):
    """Dense, sparse, regular and repeated times, before 1970 too, equal the plain walk, in stretches of any length."""
    rnd = random.Random(11)
    hour = dt.timedelta(hours=1)
    start = dt.datetime(1969, 12, 1)
    times = {
        "hot": [start + hour * rnd.uniform(0, 24 * 90) for _ in range(6000)],
        "regular": [start + hour * 24 * i for i in range(200)] + [start + hour * 12 * i for i in range(300)],
        "sparse": [start + hour * rnd.uniform(0, 24 * 2000) for _ in range(80)],
        "burst": [start + hour * 24 * 8 * k + hour * rnd.uniform(-1, 1) for k in range(12) for _ in range(5)],
        None: [start + hour * rnd.uniform(0, 24 * 40) for _ in range(50)],
    }
    rows = [(i, t) for i, own in times.items() for t in own] * 2 + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "event_id string, ts timestamp")
    want = sorted(((i, t) for i, own in times.items() for t in _kept(own, hour * 24)), key=repr)
    for stretch in (1, 2, 8):
        got = sorted(map(tuple, E.first_sightings(df, stretch=stretch).collect()), key=repr)
        assert got == want, stretch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups and steps that go on over batches
    try:
        assert sorted(map(tuple, E.first_sightings(df, stretch=3).collect()), key=repr) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert E.first_sightings(df.limit(0)).count() == 0


def test_steps_of_a_stretch():
    """A hot stretch is told by few steps where its walks meet, and its tasks get an equal share of the times."""
    import numpy as np
    import pyarrow as pa

    at = np.unique(np.random.default_rng(3).integers(0, 8_000, 3_000))
    batch = lambda **columns: pa.RecordBatch.from_pydict({"id": [1] * len(columns["us"]), "stretch": [0] * len(columns["us"]), **columns})
    steps = E._steps(batch(us=at), 1_000)
    for memory in range(-1, 1_000, 7):
        kept = E._walk(batch(kind=[0] + [1] * len(at), us=np.append(memory, at)), 1_000).column("us")
        step = np.searchsorted(steps.column("upto").to_numpy(), memory, side="right")
        assert steps.column("left")[step] == kept[len(kept) - 1]
    assert steps.num_rows < 400


def _stream(spark, df, parts):
    d = folder()
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(f"{d}/in/{i}")
    return d, spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{d}/in")


def _run(stream, d, mode):
    name = "t" + os.path.basename(d).replace("-", "_")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return stream.sparkSession.table(name)


def test_streams_agree_with_batch(spark):
    acts = [(1, i, dt.datetime(2024, 1, 1, 0, 0, s), a, u) for i, (s, a, u) in enumerate(
        [(0, "lock", "ann"), (5, "approve", "bob"), (10, "renew", "ann"), (41, "lock", "bob"), (42, "approve", "bob"), (43, "reject", "ann")])]
    df = spark.createDataFrame(acts, "approval_id long, action_id long, ts timestamp, action string, actor string")
    want = sorted(map(tuple, P.approval_outcomes(df).collect()))
    assert [r[4] for r in want] == ["locked", "locked_by_other", "renewed", "locked", "approved", "already_resolved"]
    d, stream = _stream(spark, df, [df])
    assert sorted(map(tuple, _run(P.approval_stream(stream), d, "append").collect())) == want

    ev = spark.createDataFrame(
        [("a", at(0)), ("a", at(1)), ("b", at(2))], "event_id string, ts timestamp"
    )
    d, stream = _stream(spark, ev, [ev])
    assert _run(E.drop_repeats(stream), d, "append").count() == E.first_sightings(ev).count() == 2

    d, stream = _stream(spark, ev, [ev])
    cleaned = clean_stream(stream, [Step("filterRows", None, {"column": "event_id", "operator": "eq", "value": "a"})])
    assert _run(cleaned, d, "append").count() == 2


def test_subscription_stream(spark):
    rows = [
        (1, 7, at(0), "subscription.activated", "p1", "active", "r1", "s1", None),
        (2, 7, at(1), "subscription.updated", None, "trialing", "r2", None, None),
        (3, 7, at(2), "subscription.canceled", None, None, None, None, "c1"),
        (4, 8, at(0), "subscription.past_due", None, None, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "event_id long, user_id long, ts timestamp, event_type string, plan string, status string, renews_at string, subscription_id string, canceled_at string"
    )
    want = sorted(map(tuple, E.subscription_state(df, order=["ts", "event_id"]).collect()))
    assert want == [(7, False, "p1", "canceled", "r2", "s1", "c1"), (8, None, None, "past_due", None, None, None)]
    d, stream = _stream(spark, df, [df])
    assert sorted(map(tuple, _run(E.subscription_stream(stream), d, "update").collect())) == want


def test_subscription_stream_out_of_order(spark):
    """The same events in several micro-batches, later ones first, give the batch result."""
    rnd = random.Random(4)
    kinds = ("subscription.activated", "subscription.updated", "subscription.canceled", "subscription.past_due", "transaction.completed")
    rows = [
        (i, rnd.randrange(3), at(rnd.randrange(40)), rnd.choice(kinds), rnd.choice([None, "p1", "p2"]), rnd.choice(["active", "trialing"]), f"r{i}", f"s{i}", f"c{i}")
        for i in range(90)
    ] + [(90, 9, at(5), kinds[2], None, None, None, None, "c"), (91, 9, at(0), kinds[0], "p", "active", "r", "s", None)]
    df = spark.createDataFrame(
        rows, "event_id long, user_id long, ts timestamp, event_type string, plan string, status string, renews_at string, subscription_id string, canceled_at string"
    )
    d = folder()
    for part in (df.filter("event_id % 3 = 1 OR event_id = 90"), df.filter("event_id % 3 = 2"), df.filter("event_id % 3 = 0 AND event_id <> 90"), df.filter("event_id = 91")):
        part.coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    seen = _run(E.subscription_stream(stream), d, "update")
    want = sorted(map(tuple, E.subscription_state(df, order=["ts", "event_id"]).collect()), key=repr)
    # The last record a user got is the one after all batches; each batch only adds.
    assert {tuple(r) for r in want} <= {tuple(r) for r in seen.collect()}


def test_subscription_stream_forgets_idle_users(spark):
    """The state holds the users of the last ``idle`` only; one who comes back starts anew, one who stays keeps all fields."""
    event = lambda i, user, hours, kind, plan: (i, user, at(hours), kind, plan, "active", f"r{i}", f"s{i}", None)
    day = 24
    batches = [
        [event(i, i, 0, "subscription.activated", "p") for i in range(40)],
        *[[event(100 + d, 0, d * day, "subscription.updated", None), event(200 + d, 200 + d, d * day, "subscription.activated", "q")] for d in range(5, 60, 5)],
        [event(300, 7, 60 * day, "subscription.updated", None)],
    ]
    schema = "event_id long, user_id long, ts timestamp, event_type string, plan string, status string, renews_at string, subscription_id string, canceled_at string"
    d = folder()
    out: list = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
        stream = spark.readStream.schema(schema).parquet(f"{d}/in")
        q = (
            E.subscription_stream(stream, idle="10 days", late="1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{d}/cp")
            .foreachBatch(lambda df, _: out.extend(map(tuple, df.collect()))).trigger(availableNow=True).start()
        )
        q.awaitTermination(240)
    kept = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    # A user holds a record, a newest time and a timer with its index; some five of the 51 users are within reach.
    assert kept <= 6 * 6, kept
    assert [r for r in out if r[0] == 0][-1][2] == "p"
    assert [r for r in out if r[0] == 7] == [(7, True, "p", "active", "r7", "s7", None), (7, None, None, "active", "r300", None, None)]


def test_reconcile_stream_finds_lines_of_earlier_batches(spark):
    from ledgerloom.streaming.reconcile_stream import reconcile_stream

    schema = "_row_id long, invoice_number string, vendor_name string, po_number string, amount string, currency string, line_items array<struct<total: double>>"
    row = lambda i, number, amount: (i, number, "V", "P1", amount, "USD", None)
    batches = [[row(1, "A", "10"), row(2, "B", "10")], [row(3, "A", "10"), row(4, "B", "11"), row(5, "C", "1")], [row(6, "c ", "1"), row(7, "C", "1")]]
    pos = spark.createDataFrame([(1, "P1", "V", "10", "USD")], "_row_id long, po_number string, vendor_name string, amount string, currency string")
    d = folder()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{d}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    got, matched = [], 0

    def sink(run, batch_id):
        nonlocal matched
        got.extend((r._row_id, r.first_batch) for r in run.repeats.collect())
        matched += run.matches.filter("po is not null").count()

    reconcile_stream(stream, pos, sink, f"{d}/cp", fuzzy=False).awaitTermination(240)
    assert matched == 7
    # Which file comes first is up to the listing; every repeat is found once, in the later batch.
    assert len(got) == 2 and {i for i, _ in got} <= {1, 3, 5, 7}


def test_runs(spark):
    """Union, gaps and listing of runs against sets of numbers, with small blocks and crowded ones."""
    rnd = random.Random(6)
    spans = [(a, a + rnd.randrange(40)) for a in (rnd.randrange(1, 300) for _ in range(12))]
    frame = spark.createDataFrame(spans + [(5, None), (9, 3), (60, 60), (61, 61)], "start long, end long")
    inside = {i for a, b in spans for i in range(a, b + 1)} | {60, 61}
    merged = sorted(map(tuple, union_runs(frame, block=7).collect()))
    assert {i for a, b in merged for i in range(a, b + 1)} == inside
    assert all(b + 1 < c for (_, b), (c, _) in zip(merged, merged[1:]))
    for last in (400, 250):
        gaps = sorted(map(tuple, gap_runs(frame, 1, last, block=7).collect()))
        assert [i for a, b in gaps for i in range(a, b + 1)] == [i for i in range(1, last + 1) if i not in inside]
    assert [tuple(r) for r in gap_runs(frame.filter("start < 0"), 1, 9).collect()] == [(1, 9)]
    items = spark.range(1, 400).select("id", (F.col("id") * 10).alias("v"))
    many = [(k, 1, 3 + k % 20) for k in range(700)] + [(1000, 250, 399)]
    got = list_runs(spark.createDataFrame(many, "k long, start long, end long"), items, "k", "id", "v", block=16).collect()
    assert sorted(map(tuple, got)) == sorted((k, i * 10) for k, a, b in many for i in range(a, b + 1))


def test_selections_equal_sets(spark):
    rnd = random.Random(9)
    answered = [rnd.random() < 0.4 for _ in range(500)]
    queue = spark.createDataFrame(list(enumerate(answered)), "finding_id long, answered boolean")
    sel = [(i, "range", rnd.randrange(-5, 520), rnd.randrange(0, 560), None, None) for i in range(20)]
    sel += [(20, "all", None, None, None, None), (21, "count", None, None, 30, None), (22, "count", None, None, 9999, None), (23, "count", None, None, 0, None)]
    sel += [(24, "indices", None, None, None, [0, 3, 3, 499, 500, -1])]
    for first in (4, 19, 30):
        rows = sel + [(first + 0.5, "remaining", None, None, None, None), (40.5, "remaining", None, None, None, None)]
        frame = spark.createDataFrame([(float(i), *r) for i, *r in rows], "selection_id double, kind string, start long, end long, n int, positions array<long>")
        open_ = [i for i in range(500) if not answered[i]]
        want, taken = [], set()
        for i, kind, start, end, n, positions in sorted(rows, key=lambda r: r[0]):
            got = {
                "range": lambda: [p for p in open_ if start <= p <= end], "all": lambda: open_, "count": lambda: open_[: n or 0],
                "indices": lambda: sorted({p for p in positions if 0 <= p < 500}), "remaining": lambda: [p for p in open_ if p not in taken],
            }[kind]()
            taken |= set(got)
            want += [(float(i), p) for p in got]
        assert sorted(map(tuple, L.resolve_selections(queue, frame).collect())) == sorted(want)
    few = frame.filter("kind = 'range' AND selection_id < 3")
    covered = {p for i, _, a, b, *_ in sel[:3] for p in range(a, b + 1)}
    assert sorted(r.finding_id for r in L.unclaimed_items(queue, few).collect()) == [p for p in open_ if p not in covered]


def test_csv_files_with_other_headers(spark):
    d = folder()
    os.makedirs(f"{d}/in")
    for name, text in (
        ("a.csv", "Invoice_ID,Amount\nA1,10\n"), ("b.csv", "﻿Amount,Invoice_ID\n20,B1\n"), ("c.csv", "Invoice_ID;Note\nC1;\"two, words\"\n"),
        ("d.csv", "Invoice_ID,Amount\nD1,40\nD2\n"), ("e.csv", "x,X,\n1,2,3\n"),
    ):
        with open(f"{d}/in/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    df = files.read_csv(spark, f"{d}/in", tag=True)
    got = {r.Invoice_ID: (r.Amount, r.Note, os.path.basename(r._file), r._bad) for r in df.filter("Invoice_ID is not null").collect()}
    assert got == {
        "A1": ("10", None, "a.csv", False), "B1": ("20", None, "b.csv", False), "C1": (None, "two, words", "c.csv", False),
        "D1": ("40", None, "d.csv", False), "D2": (None, None, "d.csv", True),
    }
    odd = df.filter("Invoice_ID is null").select("x0", "X1", "_c2").collect()
    assert [tuple(r) for r in odd] == [("1", "2", "3")]
    with open(f"{d}/lines.csv", "w") as f:
        f.write('k,v\n1,"a\nb"\n2,c\n')
    assert sorted(tuple(r) for r in files.read_csv(spark, f"{d}/lines.csv", multi_line=True).select("k", "v").collect()) == [("1", "a\nb"), ("2", "c")]


def test_pages_of_any_depth(spark, monkeypatch):
    monkeypatch.setattr(D, "PAGE_RANGES", 5)
    monkeypatch.setattr(D, "PAGE_ROWS", 4)
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 5, 5, 5, rnd.randrange(-50, 50)]), i if i % 9 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "at int, id long").repartition(3)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, -(r[1] or 0)))
    for offset, limit in ((0, 5), (60, 7), (100, 3), (110, 60), (150, 100), (199, 5), (250, 5), (3, 0)):
        got = [tuple(r) for r in D.newest_page(df, "at", "id", offset, limit).collect()]
        assert got == order[offset : offset + limit], (offset, limit)
    assert D.newest_page(df.limit(0), "at", "id", 3, 5).collect() == []
    texts = df.select(F.col("at").cast("string").alias("at"), "id")
    assert len(D.newest_page(texts, "at", "id", 10, 5).collect()) == 5


def test_line_memory_reads_touched_buckets_only(spark):
    d = folder()
    schema = "_row_id long, invoice_number string, amount string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    first = [(i, f"N{i}", "5") for i in range(200)]
    assert R.earlier_repeats(frame(first), 0, f"{d}/seen", buckets=64).count() == 0
    again = [(900, "N7", "5"), (901, "N7", "6"), (902, None, "5"), (903, "N900", "1")]
    for _ in range(2):  # a batch run again gives the same
        got = R.earlier_repeats(frame(again), 1, f"{d}/seen", buckets=64).collect()
        assert [(r._row_id, r.first_batch) for r in got] == [(900, 0)]
    assert R.earlier_repeats(frame([(1, None, "x")]), 2, f"{d}/seen", buckets=64).count() == 0
    touched = os.listdir(f"{d}/seen")
    assert len([t for t in touched if t.startswith("bucket=")]) > 50
    two = R.seen_lines(spark, f"{d}/seen", [int(t.split("=")[1]) for t in touched if t.startswith("bucket=")][:2])
    assert len({os.path.dirname(os.path.dirname(f)) for f in two.inputFiles()}) == 2


def test_timed_approvals_equal_the_twin_in_any_order(spark):
    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    rows = [
        (rnd.randrange(3), i, t0 + dt.timedelta(seconds=7 * i + rnd.randrange(3)), rnd.choice(["lock", "renew", "release", "approve", "reject", "odd"]), rnd.choice(["ann", "bob"]))
        for i in range(90)
    ]
    late = [(r[0] + 3, r[1] + 100, *r[2:]) for r in rows if r[3] not in ("approve", "reject")]
    schema = "approval_id long, action_id long, ts timestamp, action string, actor string"
    rows += late
    shuffled = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rnd.randrange(100)))
    end = [(99, 9999, t0 + dt.timedelta(days=1), "lock", "ann")]
    d = folder()
    for at in range(0, len(shuffled), 30):
        spark.createDataFrame(shuffled[at : at + 30], schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    spark.createDataFrame(end, schema).coalesce(1).write.mode("append").parquet(f"{d}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    P.timed_approval_stream(stream).writeStream.option("checkpointLocation", f"{d}/cp").trigger(availableNow=True).start(
        f"{d}/out", format="parquet"
    ).awaitTermination(400)
    got = sorted(map(tuple, spark.read.parquet(f"{d}/out").collect()))
    assert got == sorted(map(tuple, P.approval_outcomes(spark.createDataFrame(rows, schema)).collect()))


def test_line_memory_keeps_distinct_hashes_only(spark):
    """What is kept of a line is its hash, once per batch: no text key and no row id is written or shuffled for it."""
    d = folder()
    schema = "_row_id long, invoice_number string, amount string"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    R.earlier_repeats(frame([(1, "n1", "5"), (2, "n1", "5"), (None, "N2", None)]), 0, f"{d}/seen", buckets=4)
    kept = spark.read.parquet(f"{d}/seen")
    assert sorted(kept.columns) == ["batch", "bucket", "hash"] and kept.count() == 2
    got = R.earlier_repeats(frame([(7, "N2", None), (8, "n1", "5"), (8, "n1", "5"), (9, "N1", "5")]), 1, f"{d}/seen", buckets=4).collect()
    assert sorted((r._row_id, r.first_batch, r.line_key.split("|")[0]) for r in got) == [(7, 0, "N2"), (8, 0, "N1"), (8, 0, "N1")]


ODD_LINES = (
    "Vendor: Acme", "Thank you", "a b", "   Total   :: 5 ", "Date\t2024", "x", "", "key:", ": value", "K\x01ey: v\x02al", "a/b#c. d", "Amount = 7",
    "GRAND TOTAL $ 9", "total: ", "p.o. 77", "P O 5", "purchase order: 3", "bılled by me", "purcha\u017fe order 8", "\u212aey: 1", "Invoice No: INV-1/2",
    "invoice numbers", "update: now", "from  here", "Balance Due: 4 total 6", "a\u2028b: c", "Zahl\u00a0: \u00e4", "due date: x", "PO7", "Rechnung: 1.000",
)


def test_lines_are_searched_once_with_the_same_result(spark, capsys):
    """Each line is searched once per pattern, and results equal the plain patterns one after the other."""
    df = spark.createDataFrame([(0, "\n".join(ODD_LINES)), (1, None), (2, " \n ")], "d int, t string")
    lines = X.text_lines(df, "t")
    pattern = r"\A([A-Za-z\s#/\.]+)[\s:]+(.+)\z"
    part = lambda i: clean_cell(F.regexp_extract("line", pattern, i))
    plain = lines.filter((F.length("line") >= 5) & F.col("line").rlike(pattern)).select("d", "line_no", part(1).alias("k"), part(2).alias("v"))
    expected = plain.filter("k != '' and v != ''").collect()
    found = X.key_values(df, "t")
    assert sorted(map(tuple, found.select("d", "line_no", "key", "value").collect())) == sorted(map(tuple, expected)) and len(expected) > 10
    tags = X.tag_lines(df, "t")
    got = {(r.d, r.line_no): (r.tag, r.tag_value) for r in tags.collect()}
    for r in lines.collect():
        one = spark.range(1).select(*[F.regexp_extract(F.lit(r.line), "(?iU)" + p, 1) for _, p in X.LINE_TAGS]).first()
        hit = next(((name, v.strip()) for (name, _), v in zip(X.LINE_TAGS, one) if v), (None, None))
        assert got[r.d, r.line_no] == hit, r.line
    capsys.readouterr()
    found.explain()
    assert capsys.readouterr().out.count("regexp_extract") == 2
    tags.explain()
    assert capsys.readouterr().out.lower().count("rlike") == len(X.LINE_TAGS)

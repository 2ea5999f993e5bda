"""What the match by number shuffles, and what the buckets of near-duplicates hold in memory."""

from pyspark.sql import functions as F

from ledgerloom.operators import duplicates as D
from ledgerloom.operators import matching as M

INV = "_row_id string, invoice_number string, vendor_name string, po_number string, amount string, currency string"
PO = "_row_id string, po_number string, vendor_name string, amount string, currency string"


def tables(spark):
    inv = [
        ("000-1", "a", "V", "p1", "240", "USD"), ("x", "b", "V", " P1", None, "USD"), (None, "c", "V", "p1", "90", "USD"),
        ("000-4", "d", "V", "", "10", "USD"), ("000-4", "e", "V", None, "10", "USD"), (None, "f", "V", " ", "10", "USD"),
        ("", "g", "V", "p9", "10", "USD"),
    ]
    po = [("10-1", "P1", "Va", "100", "USD"), ("9", "P1", "Vb", "250", "USD"), ("a-1", "P1", "Vc", "100", "USD")]
    return spark.createDataFrame(inv, INV), spark.createDataFrame(po, PO)


def test_text_ids_come_back_from_the_shuffle(spark):
    ids = ["1", "12", "0-1-", "", "-", "--", "é", "FF", "12A", "000-1\n", "000123-4", None]
    df = spark.createDataFrame([(i,) for i in ids], "id string").select("id", M.packed_id(F.col("id")).alias("p"))
    assert all(r.id == r.back for r in df.withColumn("back", M.unpacked_id(F.col("p"))).collect())
    assert df.filter("id = '000123-4'").first().p == bytes.fromhex("000123A4FF")


def test_text_ids_and_missing_numbers_keep_every_invoice(spark):
    inv, po = tables(spark)
    m = {r.invoice_number: r for r in M.match_by_number(inv, po).collect()}
    assert {k: r._row_id for k, r in m.items()} == {r.invoice_number: r._row_id for r in inv.collect()}
    # Of lines as near the earlier row, in the order of texts; the first row for an invoice without an amount.
    assert [m[k].po.row_id for k in "abc"] == ["9", "10-1", "10-1"]
    assert all(m[k].po is None for k in "defg")


def test_match_is_dealt_in_a_fixed_number_of_parts_without_missing_numbers(spark, capsys):
    inv, po = tables(spark)
    capsys.readouterr()
    M.match_by_number(inv, po, fields=()).explain()
    plan = capsys.readouterr().out
    assert "REPARTITION_BY_NUM" in plan
    assert "to_json" not in plan  # no invoice is shuffled under a key of its own


def test_fuzzy_names_carry_only_named_order_columns(spark):
    inv, po = tables(spark)
    m = M.match_invoices(inv, po, fields=("vendor_name", "currency"))
    assert m.schema["po"].dataType.names == ["row_id", "vendor_name", "amount", "currency"]
    assert m.filter("po is not null").select("po.vendor_name").first() is not None


def test_buckets_without_pairs_are_dropped_before_they_are_added_up(spark, capsys):
    rows = [("1", "V", 10, "2024-01-01"), ("2", "V", 10, "2024-01-05"), ("3", "V", 10, "2024-03-01"), ("4", "V", 20, "2024-01-01")]
    df = spark.createDataFrame(rows, "_row_id string, vendor_name string, amount int, d string").selectExpr(
        "_row_id", "vendor_name", "cast(amount as decimal(18,2)) amount", "'USD' currency", "to_date(d) invoice_date"
    )
    found = D.near_duplicate_buckets(df)
    assert [(r.pairs, r.invoices) for r in found.collect()] == [(1, 2)]
    capsys.readouterr()
    found.explain(mode="extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    added = plan.index("Aggregate", plan.index("Filter"))
    assert "Filter ((rows" in plan[added:]


def test_checks_are_evaluated_once_a_row(spark):
    from ledgerloom.operators import findings as R

    invoices = spark.createDataFrame([("i1", "P1", "10.00", "A"), ("i2", "P9", "5", "B")], "_row_id string, po_number string, amount string, vendor_name string")
    orders = spark.createDataFrame([("o1", "P1", "20.00", "A")], "_row_id string, po_number string, amount string, vendor_name string")
    found = R.invoice_findings(M.match_invoices(invoices, orders, fuzzy=False), texts=False)
    assert {(r.inv_row_id, r.finding_type) for r in found.collect()} == {("i1", "amount_mismatch"), ("i2", "no_po_match")}
    # An inner explode would come with a filter on the size of the array, which evaluates all checks again.
    assert "size(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_vendor_amount_match_carries_named_columns_only(spark):
    cols = "_row_id string, po_number string, amount string, vendor_name string, currency string"
    invoices = spark.createDataFrame([("i1", "P1", "10.00", "Acme Ltd", "USD"), ("i2", "", "99", "acme", ""), ("i3", "", "50", "acme", "")], cols)
    orders = spark.createDataFrame([("o1", " p1 ", "20.00", "Acme", "USD"), ("o2", "P2", "100", "ACME Inc", "EUR")], cols)
    row = lambda r: (r._row_id, r.match_type, r.po and r.po.row_id, r.currency_warning)
    got = M.match_vendor_amount(invoices, orders, fields=())
    want = [("i1", "po_number", "o1", False), ("i2", "vendor_amount", "o2", True), ("i3", None, None, None)]
    assert sorted(map(row, got.collect())) == sorted(map(row, M.match_vendor_amount(invoices, orders).collect())) == want
    assert got.schema["po"].dataType.names == ["row_id", "amount", "currency", "date"]

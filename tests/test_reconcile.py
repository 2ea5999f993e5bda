"""Matching, findings, duplicates and decisions on hand-written cases and against brute force."""

import random

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import decisions as X
from ledgerloom.operators import duplicates as D
from ledgerloom.operators import findings as R
from ledgerloom.operators import matching as M
from ledgerloom.operators.decisions import Rule
from ledgerloom.plans.reconcile import number_findings, reconcile, run_summary

INV = "_row_id long, invoice_number string, vendor_name string, po_number string, amount string, currency string, quantity string"
PO = "_row_id long, po_number string, vendor_name string, amount string, currency string"


def test_best_line_status_and_limits(spark):
    inv = spark.createDataFrame(
        [
            (1, "a", "V", "p1", "240", "USD", None), (2, "b", "V", " P1", None, "USD", None), (3, "c", "V", "p2", "1020.04", "USD", None),
            (4, "d", "V", "p2", "1020.10", "USD", None), (5, "e", "V", "p2", "5000", "EUR", None), (6, "f", "V", "p3", "10", "USD", None),
            (7, "g", "V", "", "10", "USD", None),
        ],
        INV,
    )
    po = spark.createDataFrame(
        [(1, "P1", "V", "100", "USD"), (2, "P1", "V", "250", "USD"), (3, "P2", "V", "1000", "USD"), (4, "P3", "V", "", "USD")], PO
    )
    m = {r._row_id: r for r in R.match_status(M.match_invoices(inv, po, fuzzy=False)).collect()}
    assert m[1].po.row_id == 2 and m[2].po.row_id == 1
    assert [m[i].status for i in range(3, 8)] == ["matched", "amount_mismatch", "currency_mismatch", "matched", "no_po_match"]
    assert m[6].amount_unknown and m[3].amount_diff_pct == 0.02
    # Every invoice once.
    assert len(m) == 7


def test_order_numbers_of_any_size_give_the_same_lines(spark):
    """Sorted runs and blocks agree: all numbers taken as small, some as large, all as large."""
    rnd = random.Random(5)
    key = lambda: rnd.choice(["hot", "hot", "hot", None, "", *(f"k{i}" for i in range(6))])
    price = lambda: rnd.choice([None, "", "x", f"{rnd.randrange(1, 60)}.50", str(1000 * rnd.randrange(4))])
    po = spark.createDataFrame([(rnd.randrange(90) if i % 9 else None, key(), "V", price(), "USD") for i in range(120)], PO)
    inv = spark.createDataFrame([(i // 2, "n", "V", key(), price(), "USD", None) for i in range(160)], INV)
    rows = lambda large: sorted(
        (r._row_id, r._po_key or "", str(r._amount), r.po.row_id if r.po else -1, str(r.po.amount) if r.po else "")
        for r in M.match_by_number(inv, po, large=large).collect()
    )
    few, some, many = rows(10_000), rows(30), rows(0)
    # Rows that share an id may stand for each other.
    ids = lambda found: [r[:4] for r in found]
    assert len(few) == 160 and ids(few) == ids(some) == ids(many)


def test_numbers_match_shuffles_each_table_once(spark, capsys):
    """The match by number sorts both tables in one shuffle; the rest moves sketches and large numbers only."""
    po = spark.createDataFrame([(1, "p", "V", "1", "USD")], PO)
    inv = spark.createDataFrame([(1, "n", "V", "p", "1", "USD", None)], INV)
    small = M._match_small(
        inv.withColumns({"_po_key": F.col("po_number"), "_amount": F.lit(1).cast("decimal(18,2)")}),
        po.select(F.col("po_number").alias("_po_key"), M.order_struct(po, "_row_id").alias("_target")), "_row_id",
    )
    small.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1


def test_long_orders_equal_short_ones(spark):
    """The two ways through an order number give the same lines, also for a key with most rows."""
    rnd = random.Random(3)
    keys = lambda: "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(9)}"
    po = spark.createDataFrame([(i, keys(), "V", rnd.choice(["", f"{rnd.randrange(1, 400)}.{rnd.randrange(10)}0"]), "USD") for i in range(150)], PO)
    inv = spark.createDataFrame([(i, "n", "V", keys(), rnd.choice([None, str(rnd.randrange(1, 400))]), "USD", None) for i in range(120)], INV)
    got = {r._row_id: r.po and r.po.row_id for r in M.match_by_number(inv, po).collect()}
    lines = [r.asDict() for r in po.collect()]
    for r in inv.collect():
        mine = [p for p in lines if p["po_number"] == r.po_number]
        priced = [p for p in mine if p["amount"]]
        want = min(mine, key=lambda p: p["_row_id"], default=None)
        if r.amount and priced:
            want = min(priced, key=lambda p: (round(abs(float(p["amount"]) - float(r.amount)), 2), p["_row_id"]))
        assert got[r._row_id] == (want and want["_row_id"])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize("strict", [False, True])
def test_fuzzy_names_against_brute_force(spark, strict):
    rnd = random.Random(5)
    words = ["Acme", "Acmee", "Boreal", "Trading", "Tradng", "Metals", "North", "Ltd", "Inc", "Supply 001", "Supply 002"]
    name = lambda: " ".join(rnd.sample(words, rnd.randrange(1, 4)))
    po_names = [name() for _ in range(60)]
    asked = sorted({name() for _ in range(60)} | {"Zzyzx Ltd", "Boreall Metals"})
    po = spark.createDataFrame([(i, "", n, "1", "USD") for i, n in enumerate(po_names)], PO)
    got = {r.vendor_name: r.po.row_id for r in M.fuzzy_vendor_names(spark.createDataFrame([(n,) for n in asked], "vendor_name string"), po, strict_reference=strict).collect()}
    key = {n: k for n, k in zip(*[[r[i] for r in spark.createDataFrame([(n,) for n in {*po_names, *asked}], "n string").select("n", M.vendor_key_a("n")).collect()] for i in (0, 1)])}
    sort = lambda n: " ".join(sorted(n.split()))
    for n in asked:
        block = range(len(po_names))
        if strict:
            block = [i for i in block if key[po_names[i]][:3] == key[n][:3]] or block
        score = lambda i: 200 * lcs(sort(n), sort(po_names[i])) / (len(sort(n)) + len(sort(po_names[i])))
        best = max(block, key=lambda i: (score(i), -i))
        assert got.get(n) == (best if score(best) >= 85 else None), n


def test_similar_names_find_every_pair(spark):
    """Short and long texts, repeated characters, percentages down to where no pair of characters need be common."""
    rnd = random.Random(11)

    def spoilt(t):
        t = list(t)
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(t) + 1)
            t[at : at + rnd.randrange(2)] = rnd.choice(["", "x", "a", "é"])
        return "".join(t)

    base = ["".join(rnd.choice("ab c") for _ in range(rnd.randrange(1, 14))) for _ in range(40)] + ["q" * 90, "abc " * 20, "z"]
    left, right = sorted({spoilt(b) for b in base} - {""}), sorted({spoilt(b) for b in base} | set(base))
    frame = lambda names: spark.createDataFrame([("", n) for n in names], "block string, name string")
    for percent in (94, 85, 60, 30):
        got = {(r.l_name, r.r_name): r.score for r in M.similar_names(frame(left), frame(right), percent).collect()}
        scores = {(a, b): 200 * lcs(a, b) / (len(a) + len(b)) for a in left for b in right if b}
        want = {k: v for k, v in scores.items() if 200 * lcs(*k) >= percent * (len(k[0]) + len(k[1]))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want), percent


def test_vendor_amount_prefers_smallest_share(spark):
    inv = spark.createDataFrame([(1, "a", "ACME Ltd", "", "100", "USD", None), (2, "b", "Acme", "", "100", "", None), (3, "c", "Acme", "", "103", "USD", None)], INV)
    po = spark.createDataFrame([(1, "X", "Acme, Inc", "101", "USD"), (2, "Y", "acme", "99.5", "EUR"), (3, "Z", "acme", "98.5", "")], PO)
    got = {r._row_id: (r.po and r.po.row_id, r.currency_warning) for r in M.match_vendor_amount(inv, po).collect()}
    assert got == {1: (1, False), 2: (2, True), 3: (1, False)}


def test_tax_quantity_and_price_findings(spark):
    item = "array<struct<quantity double, unit_price double, total double, description string>>"
    inv = spark.createDataFrame(
        [
            (1, "a", "Acme Ltd", "p1", "110", "USD", "10", "10", [(None, None, 60.0, None), (None, None, 40.0, None)]),
            (2, "b", "Acme Ltd", "p1", "120", "USD", "11", "10", [(None, None, 60.0, None), (None, None, 40.0, None)]),
            (3, "c", "Acme Ltd", "p2", "110", "USD", "10", None, None),
            (4, "d", "Acme Ltd", "p3", "110", "USD", "10", None, None),
        ],
        INV + f", tax string, line_items {item}",
    )
    po = spark.createDataFrame([(1, "P1", "Acme", "110", "USD"), (2, "P2", "Acme", "110", "USD"), (3, "P3", "Acme", "110", "USD")], PO)
    receipts = spark.createDataFrame([("P1", "6"), ("p1 ", "4"), ("P3", "0")], "po_number string, quantity string")
    contracts = spark.createDataFrame([(1, "ACME", "99"), (2, "Acme", "11")], "_row_id long, vendor_name string, unit_price string")
    run = reconcile(inv, po, receipts, contracts, fuzzy=False)
    got = sorted((r.inv_row_id, r.finding_type) for r in run.findings.collect())
    assert got == [(2, "amount_mismatch"), (2, "quantity_mismatch"), (2, "tax_discrepancy"), (3, "no_goods_receipt")]
    assert run_summary(run).first().asDict() == {"total": 4, "matched": 3, "flagged": 1, "findings": 4, "duplicates": 0}


def near(spark, *items):
    df = spark.createDataFrame(
        [(i, v, a, c, d) for i, (v, a, c, d) in enumerate(items)], "_row_id long, vendor_name string, a string, currency string, d string"
    )
    return df.select("_row_id", "vendor_name", F.col("a").cast("decimal(18,2)").alias("amount"), "currency", F.to_date("d").alias("invoice_date"))


def test_near_duplicates(spark):
    df = near(
        spark, ("Abc Ltd", "100", "USD", "2024-01-01"), ("ABC", "100.00", "usd ", "2024-01-08"), ("abc", "100", "EUR", "2024-01-02"),
        ("abc", "100", "USD", "2024-01-16"), ("abc", "100", "USD", "2024-01-08"), ("abc", "100", "USD", None),
    )
    got = {r._row_id: (r.partners, r.linked_row_id) for r in D.near_duplicates(df).collect()}
    assert got == {0: (2, None), 1: (2, 0), 4: (2, 1)}
    assert D.near_duplicate_buckets(df).first()["pairs"] == 3


def test_duplicate_lines(spark):
    inv = spark.createDataFrame(
        [(1, "N1", "V", "p", "1", "USD", None), (2, "N1", "V", "p", "2", "USD", None), (3, "N2", "V", "p", "3", "USD", None), (4, "N2", "V", "p", "3", "USD", None)], INV
    )
    got = D.duplicate_lines(inv).collect()
    assert [(r.invoice_key, r.copies, r.first_row_id) for r in got] == [("N2", 2, 3)]
    assert [(r.invoice_key, r.copies) for r in D.duplicate_numbers(inv).collect()] == [("n1", 2), ("n2", 2)]


def test_rules_and_decisions(spark):
    inv = spark.createDataFrame(
        [(1, "a", "Acme", "p1", "10", "USD", None), (2, "b", "Acme", "", "20", "USD", None), (3, "c", "Zed", "", "30", "USD", None), (4, "d", "Acme", "p1", "50", "USD", None),
         (5, "e", "Acme", "p1", "10", "USD", None), (5 + 1, "e", "Acme", "p1", "10", "USD", None)],
        INV,
    )
    po = spark.createDataFrame([(1, "P1", "Acme", "10", "USD")], PO)
    run = reconcile(inv, po, fuzzy=False)
    found = number_findings(run.findings).cache()
    assert [(r.finding_id, r.finding_type) for r in found.orderBy("finding_id").collect()] == [
        (0, "no_po_match"), (1, "no_po_match"), (2, "amount_mismatch"), (3, "duplicate_invoice"),
    ]
    rules = [Rule("off", "vendor_in", vendors=["zed"], applies_to=["no_po_match"], enabled=False), Rule("v", "vendor_in", vendors=[" ACME"], applies_to=["no_po_match", "amount_mismatch"]),
             Rule("all", "amount_under", 1000, applies_to=["amount_mismatch"])]
    items = {r.finding_id: (r.rule_id, r.status, r.response) for r in X.approval_items(found, rules).collect()}
    assert items == {0: ("v", "approved", "Approve for payment"), 1: (None, "pending", None), 2: ("v", "approved", "Approve invoice amount"), 3: (None, "pending", None)}

    answers = spark.createDataFrame(
        [(0, "approved", "Approve for payment", "dashboard"), (1, "rejected", "not ours", "dashboard"), (3, "approved", "Hold all for manual review", "voice")],
        "finding_id long, status string, response string, responded_via string",
    )
    shown = lambda strict: sorted((r._row_id, r._reconciliation_status) for r in X.apply_decisions(run, found, answers, inv, strict_reference=strict).collect())
    base = [(1, "matched"), (2, "approved_with_flag"), (4, "held"), (5, "matched"), (6, "matched")]
    assert shown(False) == base
    assert shown(True) == sorted(base + [(3, "held"), (5, "duplicate_kept"), (6, "duplicate_kept")])


def test_repeated_rows_are_told_by_written_fingerprints(spark, capsys):
    """Members of repeated rows, NULL cells included; the wide rows are in no shuffle."""
    rows = [(1, "a", None), (2, "a", None), (3, "a", "x"), (4, None, None), (5, None, None), (6, None, "null")]
    members = D.exact_duplicate_members(spark.createDataFrame(rows, "_row_id long, wide string, other string"))
    got = {r._row_id: (r.copies, r.is_first) for r in members.collect()}
    assert got == {1: (2, True), 2: (2, False), 4: (2, True), 5: (2, False)}
    members.explain()
    assert "wide" not in capsys.readouterr().out


def test_received_quantities_ride_on_the_match(spark, capsys):
    """The match brings the received quantity itself: order rows are not joined to receipts before it."""
    inv = spark.createDataFrame(
        [(1, "a", "Acme Foods", "p1", "5", "USD", "3"), (1, "a", "Acme Foods", "p1", "5", "USD", "3"), (2, "b", "Acme Foods", "P2", None, "USD", "3"),
         (3, "c", "Acme Foods", None, "5", "USD", "3"), (4, "d", "Other", "p9", "5", "USD", "3")],
        INV,
    )
    po = spark.createDataFrame(
        [(1, "P1", "Acme Foods", "5", "USD"), (2, " p1 ", "Acme Foods", "9", "USD"), (3, "P2", "Acme Foods", "5", "USD"), (None, "P9", "Z", "1", "USD")], PO
    )
    receipts = spark.createDataFrame([("p1", "2"), ("P1 ", "1.5"), (None, "4"), ("P9", "7"), ("P2", None)], "po_number string, quantity string")
    received = R.received_quantities(receipts)
    got = lambda m: sorted((r._row_id, r.po and r.po.received_quantity) for r in m.collect())
    expected = [(1, 3.5), (1, 3.5), (2, None), (3, None), (4, None)]
    for large in (10_000, 0):
        assert got(M.match_by_number(inv, po, large=large, received=received)) == expected
    # A vendor found by name takes the quantity of the order that was found.
    assert got(M.match_invoices(inv, po, received=received).dropDuplicates(["_row_id"])) == [(1, 3.5), (2, None), (3, 3.5), (4, None)]
    run = reconcile(inv, po, receipts, fuzzy=False)
    capsys.readouterr()
    run.matches.explain()
    assert "_po_join" not in capsys.readouterr().out


def test_only_named_order_columns_are_shuffled(spark):
    """``fields`` limits ``po`` and the shuffle; the lines found stay the same on both ways through an order number."""
    rnd = random.Random(7)
    po = spark.createDataFrame([(i, f"k{i % 5}", f"V{i}", rnd.choice(["", f"{i % 13}.50"]), rnd.choice(["USD", None])) for i in range(60)], PO)
    inv = spark.createDataFrame([(i // 2, "n", "V", rnd.choice(["k1", "K2 ", None, "x"]), rnd.choice([None, "3", "9"]), "USD", None) for i in range(60)], INV)
    for large in (10_000, 0):
        slim = M.match_by_number(inv, po, large=large, fields=("currency",))
        assert slim.schema["po"].dataType.names == ["row_id", "amount", "currency"]
        key = lambda rows: sorted(map(repr, rows))
        full = M.match_by_number(inv, po, large=large).select("_row_id", "po").collect()
        assert key((r._row_id, r.po and (r.po.row_id, r.po.amount, r.po.currency)) for r in full) == key(
            (r._row_id, r.po and (r.po.row_id, r.po.amount, r.po.currency)) for r in slim.collect()
        )


def test_small_price_table_does_not_shuffle_the_invoices(spark, capsys):
    """Whatever contracts are made from, the size of the price table itself decides how it is joined."""
    inv = spark.createDataFrame([(1, "Acme Ltd"), (2, None), (3, "Other")], "_row_id long, vendor_name string")
    contracts = spark.range(50_000_000).filter("id < 2").selectExpr("id as _row_id", "'ACME' as vendor_name", "cast(id + 1 as string) as unit_price")
    priced = R.with_contract(inv, contracts)
    capsys.readouterr()
    priced.explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted((r._row_id, r.contract_price) for r in priced.collect()) == [(1, 2.0), (2, None), (3, None)]


def test_totals_of_line_items_give_the_same_findings(spark):
    items = "array<struct<total: double>>"
    inv = spark.createDataFrame(
        [(1, "a", "V", "p", "100", "USD", "1", "5", [(60.0,), (20.0,)]), (2, "b", "V", "p", "85", "USD", "1", "5", [(60.0,), (20.0,)]),
         (3, "c", "V", "p", "100", "USD", "1", "5", []), (4, "d", "V", "p", "100", "USD", "1", "5", None), (5, "e", "V", "p", "100", "USD", "1", "5", [(None,)])],
        f"{INV}, tax string, line_items {items}",
    )
    po = spark.createDataFrame([(1, "p", "V", "100", "USD")], PO)
    found = lambda i: sorted(map(repr, R.invoice_findings(M.match_invoices(i, po, fuzzy=False), texts=False).collect()))
    assert found(R.with_items_total(inv)) == found(inv)
    assert sum("tax_discrepancy" in r for r in found(inv)) == 1


def test_tables_read_in_parts_are_not_shuffled_to_deal_them(spark):
    from ledgerloom.plans.fixtures import dealt

    half = spark.range(0, 100, 1, spark.sparkContext.defaultParallelism // 2)
    assert dealt(half, "id") is half
    one = spark.range(0, 100, 1, 1)
    assert dealt(one, "id") is not one

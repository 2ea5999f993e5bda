"""Single-cell functions against hand-written values."""

from pyspark.sql import functions as F

from ledgerloom.functions import dates as D
from ledgerloom.functions import numbers as N
from ledgerloom.functions import text as T
from ledgerloom.plans.queries_cells import text_quality
from ledgerloom.sources.roles import canonicalise, typed, with_row_id


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_vendor_keys(spark):
    assert one(spark, T.vendor_key_a("c"), "Acme Pvt Ltd", "Acme Private Limited", "ltd", "Caffé Co") == [
        "acme pvt", "acme", "ltd", "caff",
    ]
    assert one(spark, T.vendor_key_b("c"), "ABC Pvt. Ltd.", "A, B  Corp", "Coco Inc") == ["abc", "a b", "coco"]
    assert one(spark, T.vendor_key_c("c"), "ABC Pvt. Ltd.", "GmbH Works LLC") == ["abc", "gmbh works"]
    assert one(spark, T.token_sorted("c"), " b  a C ") == ["C a b"]


def test_numbers(spark):
    assert one(spark, N.parse_number("c"), "$1,234.50", "abc", "12-34", "-5", "1.2.3") == [1234.5, None, None, -5.0, None]
    assert one(spark, N.number_prefix("c"), "12abc", " -3.5 kg", "abc", ".5", "1e2x") == [12.0, -3.5, None, 0.5, 100.0]
    assert one(spark, N.money_text(N.parse_money("c"), F.lit("")), "1234.5", "x") == ["USD 1,234.50", "N/A"]
    assert one(spark, N.severity("Medium", N.parse_money("c")), "10000", "9999.99", None) == ["High", "Medium", "Medium"]
    assert one(spark, N.half_up(F.length("c") * 0 + 5, F.lit(8), 2), "x") == [0.63]
    assert one(spark, N.is_integer_text("c"), "1,000", "1.0", " 7 ", "1_0") == [True, False, True, False]


def test_blank_and_trim(spark):
    assert one(spark, T.is_blank("c"), None, "", " \t ", "x", "0") == [True, True, True, False, False]
    assert one(spark, T.is_blank("c", T.BLANK_WORDS), "N/A", "--", "none ", "no") == [True, True, True, False]
    assert one(spark, T.trim_all("c"), "  a b\t\n") == ["a b"]


def test_title_case(spark):
    got = one(spark, T.title_case("c"), "o'connor", "smith-jones", "mcdonald", "ibm llc", "JOSÉ  macleod", "mace")
    assert got == ["O'Connor", "Smith-Jones", "McDonald", "IBM LLC", "José  MacLeod", "Mace"]


def test_dates(spark):
    values = ("13/02/2024", "02/13/2024", "05/06/2024", "31/02/2025", "29/02/2023", "29/02/2024", "2024-13-01", "x", " ")
    cell = D.read_date_cell("c")
    assert one(spark, cell["status"], *values) == [
        "ok", "ok", "ambiguous", "failed", "failed", "ok", "failed", "failed", "blank",
    ]
    assert one(spark, D.layout_date(D.read_date_cell("c", "assume_mdy"), "DD/MM/YYYY"), "5-6-2024") == ["06/05/2024"]
    got = one(
        spark, D.free_text_date("c"), "15 January 2025", "Jan 5, 2025", "1.2.2025", "03/04/25", "02/13/2024", "soon", "2025/1/9", "1/2/70"
    )
    assert got == ["2025-01-15", "2025-01-05", "2025-02-01", "2025-04-03", "2024-02-13", "soon", "2025-01-09", "1970-02-01"]
    assert one(spark, D.free_text_date("c", "MDY"), "03/04/2025") == ["2025-03-04"]


def test_headers():
    assert T.clean_header(" Invoice # ") == "invoice"
    assert T.unique_headers(["Total", "total", "", "TOTAL "]) == ["total", "total_1", "col", "total_2"]


def test_payload_and_redaction(spark):
    assert one(spark, T.short_text("c", 3), "abcdef", "abc") == ["abc…[truncated 6 chars]", "abc"]
    assert one(spark, T.redact_json("c"), '{"token":"x","ip":"1"}') == ['{"token":"[REDACTED]","ip":"1"}']
    assert one(spark, T.text_quality("c"), "Invoice 123 $", "", "?! ?!") == [0.8, 0.0, 0.0]


def test_canonical_names(spark):
    df = spark.createDataFrame([("7", "A", "9")], ["Invoice_ID", "Supplier", "PO#"])
    got = canonicalise(df)
    assert {"invoice_number", "vendor_name", "invoice_id"} <= set(got.columns)
    assert canonicalise(spark.createDataFrame([("1", "2")], ["amount", "Total"])).first()["amount"] == "1"
    assert df.select(typed(df, "missing")).first()[0] is None
    assert with_row_id(df, ["Supplier"]).first()["_row_id"].Supplier == "A"


def test_text_quality_equals_the_plain_patterns(spark, capsys):
    """Counts and marks as the plain classes give them, and texts of one row group dealt over the cores."""
    texts = [
        None, "", " \u00a0", "a", "ab c1 d-e", "é ab\u2003cd\u200bx", "x\x00y z", "pay 123 US$", "USDX EUR_ aUSD", "1 USD", "\nUSD", "EUR", "ÄGBP é", "€5",
        "\u0664\u0665\u0666 ok", "ab\ufeffcd", "(ab) ab, a:b", "日本語 テキスト", "x\x1fy\x7f zz", "\U0001f600USD 😀 ab😀", "CNY\u0301 AEDé",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    total = F.regexp_count("text", F.lit(rf"{T.NOT_SPACE}++"))
    good = F.regexp_count("text", F.lit(rf"(?<!{T.NOT_SPACE})[\p{{L}}\p{{N}}_.,\-/:]{{2,}}+(?!{T.NOT_SPACE})"))
    mark = r"[$£€₹¥₩]|(?<![\p{L}\p{N}_])(?:USD|EUR|GBP|INR|NPR|AED|SAR|CNY)(?![\p{L}\p{N}_])"
    extra = lambda p: F.when(F.col("text").rlike(p), 200).otherwise(0)
    score = F.least(F.lit(1000), F.floor((good * 1200 + total) / (total * 2)) + extra(r"\p{Nd}{3}") + extra(mark)) / F.lit(1000.0)
    plain = F.when(T.is_blank("text"), F.lit(0.0)).otherwise(score)
    for r in df.select("i", "text", T.text_quality("text").alias("a"), plain.alias("b")).collect():
        assert r.a == r.b, r.text
    capsys.readouterr()
    text_quality(spark, "/root/testdata/sf0.001").explain()
    assert "REPARTITION" in capsys.readouterr().out


def test_plain_vendor_keys_equal_the_step_by_step_ones(spark):
    import random
    import re

    rng = random.Random(3)
    parts = ["acme", "Foods", "ltd", "PVT", "inc", "co", "corp", "llc", "private", "limited", "gmbh", "x1", "Co.", "é", "a,b"]
    names = [rng.choice(["", "", " "]) + rng.choice([" ", " ", " ", "  ", "\t"]).join(rng.choices(parts[: rng.choice([12, 15])], k=rng.randint(1, 5))) for _ in range(400)]

    def key_a(name):
        name = name.lower().strip()
        for w in T.KEY_A_ENDINGS:
            name = name.removesuffix(f" {w}").rstrip() if name.endswith(f" {w}") else name
        return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", "", name)).strip()

    def key_c(name):
        dropped = re.sub(rf"(?<![A-Za-z0-9_])(?:{'|'.join(T.KEY_C_WORDS)})(?![A-Za-z0-9_])", "", name.lower())
        return re.sub(r"\s+", " ", re.sub("[.,]", "", dropped)).strip()

    assert one(spark, T.vendor_key_a("c"), *names, None) == [*map(key_a, names), None]
    assert one(spark, T.vendor_key_c("c"), *names, None) == [*map(key_c, names), None]
    # Plain names skip the searches that the others need.
    df = spark.createDataFrame([("a",)], "c string")
    assert all("a-z0-9 ]*" in df.select(k("c"))._jdf.queryExecution().optimizedPlan().toString() for k in (T.vendor_key_a, T.vendor_key_c))

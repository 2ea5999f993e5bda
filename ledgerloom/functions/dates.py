"""Date texts: layout tests, free-text parsing, re-formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import SPACE, col_of, is_blank, trim_all

# Output layouts of the date step.
TARGET_LAYOUTS = {
    "YYYY-MM-DD": ("{y}", "-", "{m}", "-", "{d}"),
    "DD/MM/YYYY": ("{d}", "/", "{m}", "/", "{y}"),
    "MM/DD/YYYY": ("{m}", "/", "{d}", "/", "{y}"),
}
POLICIES = ("flag", "assume_dmy", "assume_mdy")

# Layouts that count as a date when a column is labelled.
DATE_TESTS = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{2}/[0-9]{2}/[0-9]{4}",
    r"[0-9]{2}-[0-9]{2}-[0-9]{4}",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
)
# Layout names reported for mixed columns.
LAYOUT_NAMES = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "YYYY-MM-DD"),
    (r"[0-9]{2}/[0-9]{2}/[0-9]{4}", "DD/MM/YYYY"),
    (r"[0-9]{2}-[0-9]{2}-[0-9]{4}", "DD-MM-YYYY"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "D/M/YY"),
)


def is_date_text(c: Column | str) -> Column:
    return trim_all(col_of(c)).rlike(rf"\A(?:{'|'.join(DATE_TESTS)})\z")


def date_layout(c: Column | str) -> Column:
    """Name of the first fitting layout, NULL when none fits."""
    text = trim_all(col_of(c))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(LAYOUT_NAMES):
        out = F.when(text.rlike(rf"\A{pattern}\z"), F.lit(name)).otherwise(out)
    return out


def calendar_date(y: Column, m: Column, d: Column) -> Column:
    """Date of three number texts, NULL when the calendar has no such day."""
    text = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")


def _two_digit_year(y: Column) -> Column:
    # 69..99 belong to the 1900s, 00..68 to the 2000s.
    n = y.try_cast("int")
    return F.when(F.length(y) == 2, F.when(n >= 69, n + 1900).otherwise(n + 2000).cast("string")).otherwise(y)


def free_text_date(c: Column | str, prefer: str = "DMY") -> Column:
    """ISO text of a date found in an invoice text; unchanged when nothing fits.

    Year-first, month-name, dash and dot layouts are read one way only; with
    slashes ``prefer`` decides the order and the other order is the second try.
    """
    text = trim_all(col_of(c))
    words = F.regexp_replace(text, rf"{SPACE}+", " ")

    def parts(pattern: str, order: str) -> Column:
        got = {p: F.regexp_extract(text, pattern, i + 1) for i, p in enumerate(order)}
        found = calendar_date(_two_digit_year(got["y"]), got["m"], got["d"])
        return F.when(text.rlike(pattern), found)

    def named(pattern: str, layouts: tuple[str, ...]) -> Column:
        tries = [F.try_to_timestamp(words, F.lit(f)).cast("date") for f in layouts]
        return F.when(words.rlike(pattern), F.coalesce(*tries))

    n = "([0-9]{1,2})"
    slashes = [
        parts(rf"\A{n}/{n}/([0-9]{{4}})\z", "dmy"),
        parts(rf"\A{n}/{n}/([0-9]{{2}})\z", "dmy"),
    ]
    turned = [
        parts(rf"\A{n}/{n}/([0-9]{{4}})\z", "mdy"),
        parts(rf"\A{n}/{n}/([0-9]{{2}})\z", "mdy"),
    ]
    tries = [
        parts(rf"\A([0-9]{{4}})-{n}-{n}\z", "ymd"),
        parts(rf"\A([0-9]{{4}})/{n}/{n}\z", "ymd"),
        named(r"\A[0-9]{1,2} [A-Za-z]+ [0-9]{4}\z", ("d MMMM yyyy", "d MMM yyyy")),
        named(r"\A[A-Za-z]+ [0-9]{1,2}, [0-9]{4}\z", ("MMMM d, yyyy", "MMM d, yyyy")),
        parts(rf"\A{n}-{n}-([0-9]{{4}})\z", "dmy"),
        parts(rf"\A{n}\.{n}\.([0-9]{{4}})\z", "dmy"),
        *(turned + slashes if prefer.upper() == "MDY" else slashes + turned),
    ]
    iso = F.date_format(F.coalesce(*tries), "yyyy-MM-dd")
    return F.coalesce(iso, text)


def read_date_cell(c: Column | str, policy: str = "flag") -> Column:
    """Struct (status, y, m, d) of one cell for the date step.

    status: ``blank``, ``ok``, ``ambiguous`` (both parts could be the month and
    the policy is to flag) or ``failed`` (unknown layout or impossible day).
    """
    if policy not in POLICIES:
        raise ValueError(f"ambiguous date policy must be one of {POLICIES}")
    text = trim_all(col_of(c).cast("string"))
    iso = r"\A([0-9]{4})-([0-9]{2})-([0-9]{2})\z"
    two = r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})\z"
    p1 = F.regexp_extract(text, two, 1).try_cast("int")
    p2 = F.regexp_extract(text, two, 2).try_cast("int")
    plausible = p1.between(1, 31) & p2.between(1, 31)
    open_order = plausible & (p1 <= 12) & (p2 <= 12)
    day_first = (p1 > 12) | ((p2 <= 12) & F.lit(policy != "assume_mdy"))
    y = F.when(text.rlike(iso), F.regexp_extract(text, iso, 1)).otherwise(F.regexp_extract(text, two, 3))
    pad = lambda n: F.lpad(n.cast("string"), 2, "0")
    m = F.when(text.rlike(iso), F.regexp_extract(text, iso, 2)).otherwise(F.when(day_first, pad(p2)).otherwise(pad(p1)))
    d = F.when(text.rlike(iso), F.regexp_extract(text, iso, 3)).otherwise(F.when(day_first, pad(p1)).otherwise(pad(p2)))
    status = F.when(is_blank(col_of(c)), F.lit("blank"))
    if policy == "flag":
        status = status.when(open_order, F.lit("ambiguous"))
    status = (
        status.when(
            (text.rlike(iso) | plausible) & calendar_date(y, m, d).isNotNull(), F.lit("ok")
        )
        .otherwise(F.lit("failed"))
    )
    return F.struct(status.alias("status"), y.alias("y"), m.alias("m"), d.alias("d"))


def layout_date(cell: Column, target: str) -> Column:
    """Text of a ``read_date_cell`` struct in one of the target layouts."""
    if target not in TARGET_LAYOUTS:
        raise ValueError(f"target layout must be one of {sorted(TARGET_LAYOUTS)}")
    pieces = [cell[p[1]] if p.startswith("{") else F.lit(p) for p in TARGET_LAYOUTS[target]]
    return F.concat(*pieces)

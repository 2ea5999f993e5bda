"""Text expressions: blanks, trimming, vendor keys, header names, redaction.

Everything here is Column -> Column (or plan-time name handling); no UDF.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that count as white space when a cell is trimmed.
SPACE = (
    r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
)
NOT_SPACE = SPACE.replace("[", "[^", 1)
# The same characters as one text, for the trim functions.
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Cell texts that the wide blank test also treats as missing.
BLANK_WORDS = ("", "null", "none", "n/a", "na", "undefined", "-", "--")

# Vendor key A, endings taken off one after the other, in this order.
KEY_A_ENDINGS = (
    "pvt", "ltd", "llc", "inc", "corp", "co", "gmbh",
    "plc", "ag", "limited", "private", "incorporated",
)
# Vendor key B, legal forms removed anywhere as whole words.
KEY_B_WORDS = (
    "pvt", "private", "limited", "ltd", "inc", "corp", "llc", "llp",
    "co", "pty", "gmbh", "srl", "bv", "ag", "sa", "incorporated",
)
# Vendor key C, legal forms removed anywhere as whole words.
KEY_C_WORDS = ("pvt", "limited", "ltd", "inc", "corp", "llc")

# Title case keeps these tokens upper case.
ACRONYMS = (
    "LLC", "LLP", "PLC", "INC", "CORP", "LTD",
    "IBM", "SAP", "HP", "GE",
    "USA", "UK", "UAE", "EU",
    "VAT", "GST", "PO", "ID", "ETA", "ETD",
)

# Marks of money that make a text look like one about amounts.
MONEY_SIGNS = ("$", "£", "€", "₹", "¥", "₩")
MONEY_CODES = ("USD", "EUR", "GBP", "INR", "NPR", "AED", "SAR", "CNY")

REDACTED = "[REDACTED]"
# Keys whose values never reach an audit export.
AUDIT_SECRET_KEYS = (
    "previousValue", "newValue", "aiExplanation", "invoiceAmount", "vendorName",
    "approvalResponse", "response", "question", "sourceFile",
)
# Keys whose values never reach a security log.
SECURITY_SECRET_KEYS = (
    "password", "passwordHash", "token", "accessToken", "refreshToken",
    "code", "totpCode", "secret", "mfaSecret", "backupCode", "backupCodes",
    "apiKey", "authorization",
)


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str, words: tuple[str, ...] | None = None) -> Column:
    """NULL or nothing but white space; with ``words`` also those texts (case-blind)."""
    text = col_of(c).cast("string")
    blank = F.coalesce(trim_all(text) == "", F.lit(True))
    if words:
        blank = blank | F.coalesce(F.lower(trim_all(text)).isin(*words), F.lit(False))
    return blank


def trim_all(c: Column | str) -> Column:
    """Trim every kind of white space, not only the blank character."""
    return F.btrim(col_of(c), F.lit(SPACE_CHARS))


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(col_of(c), rf"{SPACE}+", " ")


def null_if_blank(c: Column | str) -> Column:
    c = col_of(c)
    return F.when(~is_blank(c), c)


def match_key(c: Column | str) -> Column:
    """Upper-cased, trimmed key for number columns; NULL when blank."""
    return F.upper(F.nullif(trim_all(col_of(c).cast("string")), F.lit("")))


def vendor_key_a(c: Column | str) -> Column:
    """Key for fuzzy blocks and contracts: endings cut one pass, then a-z 0-9 only."""
    endings = F.array(*[F.lit(f" {w}") for w in KEY_A_ENDINGS])

    # Most names are plain words with one blank between them: one search at the end does for them.  The endings are
    # cut in their order from the right, so from the left they stand the other way round.
    lowered = F.lower(col_of(c))
    plain = lowered.rlike(r"\A[a-z0-9 ]*\z") & ~F.contains(lowered, F.lit("  "))
    at_end = "(?= )" + "".join(f"(?: {w})?" for w in reversed(KEY_A_ENDINGS)) + r"\z"

    def cut(name: Column, ending: Column) -> Column:
        shorter = F.rtrim(F.substr(name, F.lit(1), F.length(name) - F.length(ending)), F.lit(SPACE_CHARS))
        return F.when(F.endswith(name, ending), shorter).otherwise(name)

    bare = F.aggregate(endings, trim_all(F.lower(col_of(c))), cut)
    cleaned = trim_all(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9\s]", ""), r"\s+", " "))
    return F.when(plain, F.regexp_replace(F.btrim(lowered), at_end, "")).otherwise(cleaned)


def _drop_words(c: Column, words: tuple[str, ...]) -> Column:
    # ASCII word edges: Java's \b would also treat accented letters as word characters.
    return F.regexp_replace(
        c, rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])", ""
    )


def vendor_key_b(c: Column | str) -> Column:
    """Key for near-duplicates: dots after words and 16 legal forms do not count."""
    undotted = F.regexp_replace(F.lower(col_of(c)), r"(?<![A-Za-z0-9_])([A-Za-z0-9_]+)\.", "$1")
    bare = F.regexp_replace(_drop_words(undotted, KEY_B_WORDS), "[.,]", "")
    return trim_all(collapse_spaces(bare))


def vendor_key_c(c: Column | str) -> Column:
    """Key for the vendor-and-amount matcher: 6 legal forms do not count."""
    lowered = F.lower(col_of(c))
    bare = F.regexp_replace(_drop_words(lowered, KEY_C_WORDS), "[.,]", "")
    # Plain words need no search for word edges and other white space.
    padded = F.concat(F.lit(" "), lowered, F.lit(" "))
    words = F.regexp_replace(padded, rf" (?:{'|'.join(KEY_C_WORDS)})(?= )", "")
    plain = F.btrim(F.regexp_replace(words, "  +", " "))
    return F.when(lowered.rlike(r"\A[a-z0-9 ]*\z"), plain).otherwise(trim_all(collapse_spaces(bare)))


def token_sorted(c: Column | str) -> Column:
    """Words of a name in sorted order, joined by one blank."""
    words = F.filter(F.split(col_of(c), rf"{SPACE}+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


# Name prefixes after which a capital follows, as the place where a word is cut.
NAME_PREFIX_CUTS = (
    r"(?<=\A(?:Mc|mc|MC))(?=.)",
    r"(?<=\A(?:Mac|mac|MAC))(?=[A-Za-z\x{00c0}-\x{024f}].{2})",
)


def title_case(c: Column | str) -> Column:
    """Title case that keeps acronyms and knows hyphens, Mc/Mac and apostrophes.

    A text is cut wherever a capital may begin: at white space and hyphens, then
    after a name prefix or, in words without one, after each apostrophe.  Every
    piece gets its leading run of letters capitalised; nothing else changes, and
    the pieces are put together again as they stood.
    """

    def lead(piece: Column) -> Column:
        letters = F.regexp_extract(piece, r"\A\p{L}+", 0)
        lowered = F.concat(F.upper(F.substring(letters, 1, 1)), F.lower(F.substr(letters, F.lit(2))))
        return F.concat(lowered, F.substr(piece, F.length(letters) + 1))

    prefix = "|".join(NAME_PREFIX_CUTS)
    cut = lambda word: F.when(word.rlike(prefix), F.split(word, prefix)).otherwise(F.split(word, "(?<=')"))
    glue = lambda pieces, fn: F.array_join(F.transform(pieces, fn), "")
    word = lambda w: glue(cut(w), lead)
    token = lambda t: F.when(F.upper(t).isin(*ACRONYMS), F.upper(t)).otherwise(
        glue(F.regexp_extract_all(t, F.lit("([^-]+|-+)"), 1), word)
    )
    return glue(F.regexp_extract_all(col_of(c), F.lit(rf"({SPACE}+|{NOT_SPACE}+)"), 1), token)


def clean_header(name: str) -> str:
    """Header text to a column name: lower case, other characters become ``_``."""
    return re.sub(r"[^a-z0-9_]", "_", name.lower().strip()).strip("_")


def unique_headers(names: list[str]) -> list[str]:
    """Cleaned table headers; the first of several equal names keeps its name."""
    used: dict[str, int] = {}
    out = []
    for name in names:
        clean = re.sub(r"[^a-z0-9]", "_", name.lower().strip()).strip("_") or "col"
        repeat = used.get(clean, 0)
        used[clean] = repeat + 1
        out.append(f"{clean}_{repeat}" if repeat else clean)
    return out


def business_columns(df: DataFrame) -> list[str]:
    """Columns that are data; names starting with ``_`` are bookkeeping."""
    return sorted(c for c in df.columns if not c.startswith("_"))


def row_text(columns: list[str]) -> Column:
    """Canonical JSON text of the given columns, all as text, in name order."""
    return F.to_json(
        F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]),
        {"ignoreNullFields": "false"},
    )


def row_fingerprint(columns: list[str]) -> Column:
    return F.md5(row_text(columns))


def currency_code(c: Column | str, missing: str | None = None) -> Column:
    """Trimmed upper-case code; blank gives NULL, or ``missing`` when given."""
    code = match_key(c)
    return code if missing is None else F.coalesce(code, F.lit(missing))


def currency_status(a: Column, b: Column) -> Column:
    return (
        F.when(a.isNull() | b.isNull(), F.lit("unknown"))
        .when(a == b, F.lit("ok"))
        .otherwise(F.lit("mismatch"))
    )


def short_text(c: Column | str, limit: int = 500) -> Column:
    """Long text cut to ``limit`` characters with a note of the full length."""
    c = col_of(c)
    note = F.concat(
        F.substring(c, 1, limit), F.lit("…[truncated "), F.length(c).cast("string"), F.lit(" chars]")
    )
    return F.when(F.length(c) > limit, note).otherwise(c)


def short_list(c: Column | str, limit: int = 10) -> Column:
    """Long text list cut to ``limit`` entries plus an entry counting the rest."""
    c = col_of(c)
    more = F.concat(F.lit("...and "), (F.size(c) - limit).cast("string"), F.lit(" more"))
    return F.when(
        F.size(c) > limit, F.concat(F.slice(c, 1, limit), F.array(more))
    ).otherwise(c)


def redact_columns(df: DataFrame, keys: tuple[str, ...] = AUDIT_SECRET_KEYS) -> DataFrame:
    """Non-NULL values of the named columns replaced by a fixed mark."""
    return df.select(
        *[
            F.when(F.col(c).isNotNull(), F.lit(REDACTED)).alias(c) if c in keys else F.col(c)
            for c in df.columns
        ]
    )


def redact_json(c: Column | str, keys: tuple[str, ...] = SECURITY_SECRET_KEYS) -> Column:
    """The same for a JSON object held as text (flat, values as text)."""
    fields = F.from_json(col_of(c), "map<string,string>")
    return F.to_json(
        F.transform_values(
            fields,
            lambda k, v: F.when(k.isin(*keys) & v.isNotNull(), F.lit(REDACTED)).otherwise(v),
        )
    )


def clean_cell(c: Column | str) -> Column:
    """Control characters out (tab and line breaks stay), then trimmed."""
    return trim_all(
        F.regexp_replace(
            F.coalesce(col_of(c), F.lit("")), r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f]", ""
        )
    )


def text_quality(c: Column | str) -> Column:
    """Share of word-like tokens x 0.6, + 0.2 for a run of 3 digits, + 0.2 for a currency mark.

    Counted in thousandths so that the rounding is exact (half up).
    """
    c = col_of(c)
    # Both counts run over the text itself; no list of words is made.
    # Plain ASCII characters are tried first: the wide classes cost several tests per character.
    edge = rf"(?:[!-~]|{NOT_SPACE})"
    total = F.regexp_count(c, F.lit(rf"[!-~]++(?:{NOT_SPACE}++)?+|{NOT_SPACE}++"))
    good = F.regexp_count(c, F.lit(rf"(?<!{edge})[\p{{L}}\p{{N}}_.,\-/:]{{2,}}+(?!{edge})"))
    share = F.floor((good * 1200 + total) / (total * 2))
    digits = F.when(c.rlike(r"[0-9\p{Nd}]{3}"), 200).otherwise(0)
    # Word edges are looked at only in texts that hold a mark at all.
    holds = lambda words: reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words])
    code = rf"(?:{'|'.join(MONEY_CODES)})(?<![\p{{L}}\p{{N}}_].{{3}})(?![\p{{L}}\p{{N}}_])"
    money = F.when(holds(MONEY_SIGNS), 200).when(holds(MONEY_CODES) & c.rlike("(?s)" + code), 200).otherwise(0)
    score = F.least(F.lit(1000), share + digits + money) / F.lit(1000.0)
    return F.when(is_blank(c), F.lit(0.0)).otherwise(score)

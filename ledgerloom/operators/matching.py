"""Invoices to purchase orders: by number, by fuzzy vendor name, by vendor and amount.

No step forms the pairs of a key.  The order line closest in amount is one of
two neighbours in sorted order: per order number in one sorted run, for order
numbers that hold very many rows in blocks (``nearest_by_key``).  So one order
number may hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.numbers import cents, half_up
from ledgerloom.functions.text import (
    currency_code, currency_status, match_key, null_if_blank, token_sorted, trim_all,
    vendor_key_a, vendor_key_c,
)
from ledgerloom.operators.blocks import frequent_keys, nearest_by_key
from ledgerloom.session import cut_lineage
from ledgerloom.sources.roles import text, typed

FUZZY_PERCENT = 85
AMOUNT_PERCENT = 2
STALE_DAYS = 730
MATCH_SHARES = 4  # parts of the match by number per shuffle partition: two sorts of a part are held at once
LARGE_ORDER = 100_000  # rows of one order number that one task sorts without blocks
LARGE_ORDERS = 2_000  # order numbers of that size told apart; beyond them stand only smaller ones than a 2,000th of all rows


# --- shared pieces ----------------------------------------------------------


def order_struct(pos: DataFrame, row_id: str, fields: tuple[str, ...] | None = None) -> Column:
    """The order columns carried with a match; with ``fields`` only those, besides ``row_id`` and ``amount``."""
    date = F.col("date") if "date" in pos.columns else F.lit(None).cast("date")
    columns = {
        "row_id": F.col(row_id),
        "po_number": F.trim(text(pos, "po_number")),
        "vendor_name": trim_all(text(pos, "vendor_name")),
        "amount": typed(pos, "amount"),
        "currency": currency_code(text(pos, "currency")),
        "date": date,
        **{c: F.col(c) for c in ("received_quantity",) if c in pos.columns},
    }
    carried = [name for name in columns if fields is None or name in ("row_id", "amount", *fields)]
    return F.struct(*[columns[name].alias(name) for name in carried])


def spread_null(key: Column, row_id: str) -> Column:
    """Join key whose NULLs do not meet: each gets a text of its own that matches nothing."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.to_json(F.struct(row_id))))


def packed_id(row_id: Column) -> Column:
    """A text id as bytes to be shuffled: two digits or dashes a byte, any other text behind a byte FF; ``unpacked_id`` undoes it."""
    ends = F.when(F.length(row_id) % 2 == 0, "FF").otherwise("F")
    digits = F.unhex(F.concat(F.replace(row_id, F.lit("-"), F.lit("A")), ends))
    return F.when(row_id.rlike(r"\A[0-9-]+\z"), digits).otherwise(F.concat(F.unhex(F.lit("FF")), row_id.cast("binary")))


def unpacked_id(packed: Column) -> Column:
    other = F.substring(packed, 1, 1) == F.unhex(F.lit("FF"))
    return F.when(other, F.substr(packed, F.lit(2)).cast("string")).otherwise(
        F.replace(F.rtrim(F.hex(packed), F.lit("F")), F.lit("A"), F.lit("-"))
    )


def amount_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def with_metrics(matched: DataFrame) -> DataFrame:
    """Add gap, gap share (4 decimals, half up) and currency status of ``_amount`` against ``po``."""
    inv, po = F.col("_amount"), F.col("po.amount")
    both = (inv != 0) & (po != 0)
    gap = F.when(both, amount_gap(inv, po)).otherwise(F.lit(0).cast("decimal(18,2)"))
    share = F.when(
        both, F.signum(po) * half_up(cents(amount_gap(inv, po)), cents(F.abs(po)), 4)
    ).otherwise(F.lit(0.0))
    hit = F.col("po").isNotNull()
    return matched.withColumns(
        {
            "amount_diff": F.when(hit, gap.cast("decimal(18,2)")),
            "amount_diff_pct": F.when(hit, share),
            "amount_unknown": F.when(hit, ~F.coalesce(both, F.lit(False))),
            "currency_status": F.when(hit, currency_status(F.col("_currency"), F.col("po.currency"))),
        }
    )


def closer(below: Column, above: Column, value: Column) -> Column:
    """Of two target structs the one nearer to ``value``; the earlier row when both are as near."""
    down, up = value - below["amount"], above["amount"] - value
    take_below = (down < up) | ((down == up) & (below["row_id"] <= above["row_id"]))
    return (
        F.when(below.isNull(), above).when(above.isNull(), below).when(take_below, below).otherwise(above)
    )


# --- by order number --------------------------------------------------------


def match_by_number(
    invoices: DataFrame, pos: DataFrame, row_id: str = "_row_id", large: int = LARGE_ORDER, received: DataFrame | None = None,
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """Left match on the order number, with the order line closest in amount.

    Adds ``_amount``, ``_currency``, ``_po_key`` and ``po`` (NULL without a match).
    Among the lines of an order: the smallest amount gap wins, then the earlier
    row; the first row when the invoice has no amount or no line has one.

    Both tables are shuffled once, by order number (invoices without one are not shuffled), and each invoice looks up and down the sorted amounts of its
    order.  Order numbers that hold ``large`` rows and more would be too much for one task; they are settled per
    distinct amount in blocks (``_match_large``), so an order number may hold any share of the rows.

    ``received`` (``received_quantities``) gives ``po`` the quantity received for its number, in the same shuffle.
    ``fields`` names the columns of ``po`` that are read later (``order_struct``): no others are shuffled.
    """
    orders = pos.select(match_key(text(pos, "po_number")).alias("_po_key"), order_struct(pos, row_id, fields).alias("_target")).filter(
        F.col("_po_key").isNotNull() & F.col("_target.row_id").isNotNull()
    )
    keyed = invoices.withColumns(
        {
            "_amount": typed(invoices, "amount"),
            "_currency": currency_code(text(invoices, "currency")),
            "_po_key": match_key(text(invoices, "po_number")),
        }
    )
    # Told apart by hash: a number that shares the hash of a large one takes the other way, with the same result.
    mark = F.when(F.col("_po_key").isNotNull(), F.xxhash64("_po_key")).alias("_mark")
    orders, keyed = orders.withColumn("_mark", mark), keyed.withColumn("_mark", mark)
    # At most LARGE_ORDERS rows, whatever the tables hold.
    many = F.broadcast(frequent_keys(orders.select("_mark").unionAll(keyed.select("_mark")), "_mark", large, LARGE_ORDERS))
    some = lambda df, how: df.join(many, "_mark", how).drop("_mark")
    numbered = keyed.filter(F.col("_po_key").isNotNull())
    small = _match_small(some(numbered, "left_anti"), some(orders, "left_anti"), row_id, received)
    big = _match_large(some(numbered, "left_semi"), some(orders, "left_semi"), received)
    keyed = keyed.drop("_mark")
    columns = [*keyed.columns, "po"]
    # Invoices without a number meet nothing.
    alone = keyed.filter(F.col("_po_key").isNull()).withColumn("po", F.lit(None).cast(small.schema["po"].dataType))
    return small.select(*columns).unionByName(big.select(*columns)).unionByName(alone.select(*columns))


def _with_quantity(po: Column, quantity: Column) -> Column:
    """An order struct (or NULL) with the quantity received for it."""
    return F.when(po.isNotNull(), po.withField("received_quantity", quantity))


def _match_small(keyed: DataFrame, orders: DataFrame, row_id: str, received: DataFrame | None = None) -> DataFrame:
    """Order lines and invoices of a number in one sorted run: the last line passed on the way up and on the way down."""
    names = orders.schema["_target"].dataType.names
    # Plain columns are shuffled, the amount once and text ids packed; the order struct is put together behind the shuffle.
    lines = orders.select(
        "_po_key", F.col("_target.amount").alias("_amount"), *[F.col(f"_target.{f}").alias(f"_target_{f}") for f in names if f != "amount"]
    )
    both = keyed.unionByName(lines, allowMissingColumns=True)
    if received is not None:
        got = received.filter("received_quantity is not null").select(
            F.col("po_key").alias("_po_key"), F.col("received_quantity").alias("_received")
        )
        both = both.unionByName(got, allowMissingColumns=True)
    texts = [c for c in dict.fromkeys((row_id, "_target_row_id")) if both.schema[c].dataType == T.StringType()]
    # A fixed number of parts: joined to parts of the usual size in bytes, such well packed rows do not fit a task's memory unpacked.
    parts = MATCH_SHARES * int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumns({c: packed_id(F.col(c)) for c in texts}).repartition(parts, "_po_key")
    both = both.withColumns({c: unpacked_id(F.col(c)) for c in texts})
    line = F.col("_target_row_id").isNotNull()
    target = F.struct(*[F.col("_amount" if f == "amount" else f"_target_{f}").alias(f) for f in names])
    both = both.select(
        *[c for c in both.columns if not c.startswith("_target_")],
        F.when(line, target).alias("_target"),
        (~line if received is None else ~line & F.col("_received").isNull()).alias("_asks"),
    )
    part = Window.partitionBy("_po_key")
    # Lines before invoices of the same amount, the earliest of equal lines last.
    rest = [F.col("_target").isNull(), F.col("_target.row_id").desc()]
    passed = lambda amount: F.last(F.when(F.col("_amount").isNotNull(), F.col("_target")), ignorenulls=True).over(
        part.orderBy(amount, *rest).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = both.select(
        "*",
        F.min_by("_target", F.col("_target.row_id")).over(part).alias("_first"),
        passed(F.col("_amount").asc()).alias("_below"),
        passed(F.col("_amount").desc()).alias("_above"),
        *([] if received is None else [F.max("_received").over(part).alias("_quantity")]),
    ).filter("_asks")
    best = F.when(F.col("_amount").isNotNull(), closer(F.col("_below"), F.col("_above"), F.col("_amount")))
    po = F.coalesce(best, F.col("_first"))
    return near.select(*keyed.columns, (po if received is None else _with_quantity(po, F.col("_quantity"))).alias("po"))


def _match_large(keyed: DataFrame, orders: DataFrame, received: DataFrame | None = None) -> DataFrame:
    """The same for numbers of any size: the best line per distinct (order number, invoice amount) with ``nearest_by_key``.

    Each invoice meets only the result for its own amount; no list of lines travels with a row.
    """
    by_amount = (
        orders.filter(F.col("_target.amount").isNotNull())
        .groupBy("_po_key", F.col("_target.amount").alias("_value"))
        .agg(F.min_by("_target", F.col("_target.row_id")).alias("target"))
    )
    asked = keyed.filter(F.col("_amount").isNotNull()).select("_po_key", F.col("_amount").alias("_value")).distinct()
    near = nearest_by_key(asked, by_amount, ["_po_key"], "_value")
    best = near.select("_po_key", "_value", closer(F.col("below"), F.col("above"), F.col("_value")).alias("_best"))
    # The first row of an order serves invoices without an amount and orders without one.
    firsts = orders.groupBy("_po_key").agg(F.min_by("_target", F.col("_target.row_id")).alias("_first"))
    answered = asked.join(best, ["_po_key", "_value"], "left").join(firsts, "_po_key").withColumn("_best", F.coalesce("_best", "_first"))
    unasked = firsts.withColumn("_value", F.lit(None).cast("decimal(18,2)")).withColumn("_best", F.col("_first"))
    as_key = lambda value: F.coalesce(F.col(value).cast("string"), F.lit("")).alias("_value_key")
    found = answered.unionByName(unasked).select("_po_key", as_key("_value"), "_best")
    if received is not None:
        found = found.join(received.withColumnRenamed("po_key", "_po_key"), "_po_key", "left").select(
            "_po_key", "_value_key", _with_quantity(F.col("_best"), F.col("received_quantity")).alias("_best")
        )
    # The narrow tables above settle everything, so the wide invoice rows are joined once.
    return keyed.select("*", as_key("_amount")).join(found, ["_po_key", "_value_key"], "left").select(*keyed.columns, F.col("_best").alias("po"))


# --- by fuzzy vendor name ---------------------------------------------------


@F.pandas_udf(T.IntegerType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence: one bit row per pair, folded over all pairs of a batch at once."""

    def one(x: str, y: str) -> int:
        places: dict[str, int] = {}
        for i, ch in enumerate(x):
            places[ch] = places.get(ch, 0) | (1 << i)
        full = (1 << len(x)) - 1
        row = full
        for ch in y:
            hit = row & places.get(ch, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    def letters(texts: list[str]) -> np.ndarray:
        width = -(-max(map(len, texts)) // 8) * 8
        return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)

    def many(xs: list[str], ys: list[str]) -> np.ndarray:
        x, y = letters(xs), letters(ys)
        sizes, ends = np.array([len(t) for t in xs]), np.array([len(t) for t in ys])
        full = (np.uint64(1) << sizes.astype(np.uint64)) - np.uint64(1)
        row = full.copy()
        bits = np.zeros((len(xs), 8), np.uint8)
        for j in range(int(ends.max())):
            bits[:, : x.shape[1] // 8] = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little")
            hit = row & bits.view("<u8").ravel() & np.where(j < ends, full, np.uint64(0))
            row = ((row + hit) | (row - hit)) & full
        return sizes - np.bitwise_count(row)

    longest = a.str.len().to_numpy()
    out = np.zeros(len(a), np.int32)
    short = np.flatnonzero((longest > 0) & (longest < 64) & (b.str.len().to_numpy() > 0))
    for at in range(0, len(short), 4096):
        rows = short[at : at + 4096]
        out[rows] = many(a.iloc[rows].tolist(), b.iloc[rows].tolist())
    for i in np.flatnonzero(longest >= 64):
        out[i] = one(a.iloc[i], b.iloc[i])
    return pd.Series(out)


def _least_common(total: Column, percent: int) -> Column:
    """Shortest common subsequence that two texts of this total length need."""
    return F.ceil(total * percent / 200).cast("int")


def _bigrams(name: str) -> Column:
    """The pairs of neighbouring characters of a text, repeated ones told apart by their number.

    Both ends count as a character of their own, so a text of n characters has n + 1 pairs.
    """
    padded = F.concat(F.lit("\x02"), F.col(name), F.lit("\x03"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) + 1), lambda i: F.substr(padded, i, F.lit(2)))
    return F.transform(
        pairs, lambda pair, i: F.concat(pair, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda p: p == pair)).cast("string"))
    )


def candidate_names(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (block, l_name, r_name, total) that hold every pair whose similarity reaches ``percent``.

    A pair of lengths n and m within reach has a common subsequence of at least L characters, so n + m - 2L
    inserts and deletes, each of which breaks at most two character pairs.  Of the n + 1 and m + 1 pairs at least
    o = L + 1 - (n + m - 2L) are common.  In one order of all pairs, rarest first, two texts with o common pairs
    share one among their first n + 2 - o and m + 2 - o: only these first ones are joined, and only pairs with o
    common ones in all are kept.  Common words weigh nothing, as their pairs stand last.  Lengths that leave o at
    zero (short texts at a low percentage) are joined on their block alone.
    """
    names = left.select("block", "name", F.lit(True).alias("asked")).unionByName(
        right.select("block", "name", F.lit(False).alias("asked"))
    )
    texts = cut_lineage(names.filter("name != ''").withColumn("grams", _bigrams("name")))
    pairs = texts.select("block", "name", "asked", F.explode("grams").alias("gram"))
    rarity = pairs.groupBy("block", "gram").agg(F.count(F.lit(1)).alias("times"))
    ranked = (
        pairs.join(rarity, ["block", "gram"])
        .groupBy("block", "name", "asked")
        .agg(F.array_sort(F.collect_list(F.struct("times", "gram"))).alias("order"))
    )
    n, m = F.length("l_name"), F.length("r_name")
    least = _least_common(n + m, percent)
    common = 3 * least + 1 - n - m

    # The longest and the shortest partner within reach; the first pairs that any of them may need are joined.
    size = F.length("name")
    ends = [F.floor(size * (200 - percent) / percent).cast("int"), F.greatest(F.ceil(size * percent / (200 - percent)).cast("int"), F.lit(1))]
    needed = lambda other: size + 2 - (3 * _least_common(size + other, percent) + 1 - size - other)
    rows = ranked.select(
        "block", "name", "asked",
        F.posexplode(F.slice("order", F.lit(1), F.greatest(F.lit(1), F.array_max(F.transform(F.sequence(ends[1], ends[0]), needed))))).alias("place", "pair"),
    ).select("block", "name", "asked", "place", F.col("pair.gram").alias("gram"))
    l_rows = rows.filter("asked").select("block", "gram", F.col("name").alias("l_name"), F.col("place").alias("l_place"))
    r_rows = rows.filter("not asked").select("block", "gram", F.col("name").alias("r_name"), F.col("place").alias("r_place"))
    near = least <= F.least(n, m)
    first = (F.col("l_place") < n + 2 - common) & (F.col("r_place") < m + 2 - common)
    by_pair = l_rows.join(r_rows, ["block", "gram"]).filter(near & (common > 0) & first).select("block", "l_name", "r_name").distinct()
    # Whether o can be zero at all is known from the lengths; texts whose every partner needs a pair stay out.
    loose = texts.filter(F.array_min(F.transform(F.sequence(ends[1], ends[0]), lambda o: size + 2 - needed(o))) <= 0)
    l_loose = loose.filter("asked").select("block", F.col("name").alias("l_name"))
    r_loose = loose.filter("not asked").select("block", F.col("name").alias("r_name"))
    by_block = l_loose.join(r_loose, "block").filter(near & (common <= 0))
    l_grams = texts.filter("asked").select("block", F.col("name").alias("l_name"), F.col("grams").alias("l_grams"))
    r_grams = texts.filter("not asked").select("block", F.col("name").alias("r_name"), F.col("grams").alias("r_grams"))
    counted = (
        by_pair.join(l_grams, ["block", "l_name"])
        .join(r_grams, ["block", "r_name"])
        .filter(F.size(F.array_intersect("l_grams", "r_grams")) >= common)
        .select("block", "l_name", "r_name")
    )
    return counted.unionByName(by_block).withColumn("total", n + m)


def similar_names(left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (block, l_name, r_name, score) whose similarity, 200 * LCS / (length sum), reaches ``percent``.

    Both sides have ``block`` and ``name`` (distinct).  Every pair within reach is found; only candidates are scored.
    """
    scored = candidate_names(left, right, percent).withColumn("_common", common_subsequence("l_name", "r_name"))
    return scored.filter(F.col("_common") * 200 >= F.col("total") * percent).select(
        "block", "l_name", "r_name", (F.col("_common") * 200.0 / F.col("total")).alias("score")
    )


def fuzzy_vendor_names(
    names: DataFrame,
    pos: DataFrame,
    row_id: str = "_row_id",
    tiers: tuple[int, ...] = (94, FUZZY_PERCENT),
    strict_reference: bool = False,
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """Best order row per distinct vendor name: (``vendor_name``, ``po``, ``score``).

    Every name is compared with all orders' names, so a slip in its first letters costs nothing.  With
    ``strict_reference`` names are compared inside the block of the first three characters of vendor key A only, or
    with all orders when the block has none.  Equal token-sorted text scores 100 and is an equi join; what is left
    goes through similarity tiers from strict to wide, and a name found in one tier skips the wider ones.
    """
    prefix = lambda name: F.substring(vendor_key_a(name), 1, 3)
    orders = pos.select(
        prefix(text(pos, "vendor_name")).alias("block"),
        token_sorted(trim_all(text(pos, "vendor_name"))).alias("name"),
        order_struct(pos, row_id, fields).alias("target"),
    ).filter(F.coalesce(F.col("name"), F.lit("")) != "")
    pick = F.min_by("target", F.col("target.row_id")).alias("target")
    asked = (
        names.select("vendor_name")
        .distinct()
        .withColumn("_block", prefix(F.col("vendor_name")))
        .withColumn("name", token_sorted(trim_all("vendor_name")))
        .filter("name != ''")
    )
    # Distinct names are few next to the rows; they are written once because every
    # tier reads them again.
    known = orders.withColumn("block", F.lit("")).groupBy("block", "name").agg(pick)
    if strict_reference:
        known = cut_lineage(orders.filter("block != ''").groupBy("block", "name").agg(pick).unionByName(known))
        blocks = known.filter("block != ''").select(F.col("block").alias("_block"), F.lit(True).alias("_taken")).distinct()
        asked = asked.filter("_block != ''").join(blocks, "_block", "left").withColumn(
            "block", F.when(F.col("_taken"), F.col("_block")).otherwise(F.lit(""))
        )
    else:
        known = cut_lineage(known)
        asked = asked.withColumn("block", F.lit(""))
    asked = cut_lineage(asked.select("vendor_name", "block", "name"))
    wanted = asked.select("block", "name").distinct()
    equal = wanted.join(known, ["block", "name"]).select("block", "name", "target", F.lit(100.0).alias("score"))
    found = equal
    for percent in tiers:
        rest = wanted.join(found.select("block", "name"), ["block", "name"], "left_anti")
        close = similar_names(rest, known.select("block", "name"), percent)
        # Highest score first, then the earlier order row.
        rank = F.struct(-F.col("score"), F.col("target.row_id"), "target", "score")
        first = (
            close.join(known.withColumnRenamed("name", "r_name"), ["block", "r_name"])
            .groupBy("block", F.col("l_name").alias("name"))
            .agg(F.min(rank).alias("best"))
            .select("block", "name", "best.target", "best.score")
        )
        found = cut_lineage(found.unionByName(first))
    return asked.join(found, ["block", "name"]).select("vendor_name", F.col("target").alias("po"), "score")


def match_invoices(
    invoices: DataFrame, pos: DataFrame, row_id: str = "_row_id", fuzzy: bool = True, strict_reference: bool = False,
    received: DataFrame | None = None, fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """All invoices with their best order: number first, then fuzzy vendor name.

    ``strict_reference`` keeps fuzzy names inside the block of their first three characters.  Adds ``po``, ``match_type`` (``po_number``, ``fuzzy_vendor_name`` or NULL),
    ``amount_diff``, ``amount_diff_pct``, ``amount_unknown``, ``currency_status``.  ``received`` (``received_quantities``)
    adds ``received_quantity`` to ``po``.  ``fields`` are the columns of ``po`` that are read later, the currency among them;
    with fuzzy names and ``received`` the order number as well.
    """
    by_number = F.when(F.col("po").isNotNull(), F.lit("po_number"))
    if not fuzzy:
        return with_metrics(match_by_number(invoices, pos, row_id, received=received, fields=fields).withColumn("match_type", by_number))
    # Both ways are settled on the few columns they need; the wide rows are joined once, to the outcome.
    needed = [c for c in (row_id, "po_number", "amount", "currency", "vendor_name") if c in invoices.columns]
    narrow = match_by_number(invoices.select(*needed), pos, row_id, received=received, fields=fields).withColumn("match_type", by_number)
    # The names still open need the order keys only, not the match itself.
    keys = pos.select(match_key(text(pos, "po_number")).alias("_join_key")).filter("_join_key is not null").distinct()
    open_names = (
        invoices.select(
            trim_all(text(invoices, "vendor_name")).alias("vendor_name"),
            spread_null(match_key(text(invoices, "po_number")), row_id).alias("_join_key"),
        )
        .filter(null_if_blank("vendor_name").isNotNull())
        .join(keys, "_join_key", "left_anti")
        .select("vendor_name")
    )
    by_name = fuzzy_vendor_names(open_names, pos, row_id, strict_reference=strict_reference, fields=fields).select(
        F.col("vendor_name").alias("_name_key"), F.col("po").alias("_fuzzy")
    )
    if received is not None:
        number = spread_null(match_key(F.col("_fuzzy.po_number")), "_name_key")
        by_name = by_name.withColumn("po_key", number).join(received, "po_key", "left").select(
            "_name_key", _with_quantity(F.col("_fuzzy"), F.col("received_quantity")).alias("_fuzzy")
        )
    open_name = F.when(F.col("po").isNull(), trim_all(text(invoices, "vendor_name")))
    outcome = (
        narrow.withColumn("_name_key", spread_null(open_name, row_id))
        .join(by_name, "_name_key", "left")
        .select(
            row_id, "_amount", "_currency", "_po_key",
            F.coalesce("po", "_fuzzy").alias("po"),
            F.coalesce("match_type", F.when(F.col("_fuzzy").isNotNull(), F.lit("fuzzy_vendor_name"))).alias("match_type"),
        )
    )
    numbered = invoices.join(outcome, row_id, "left")
    return with_metrics(numbered)


def unmatched(matched: DataFrame) -> DataFrame:
    return matched.filter(F.col("po").isNull())


# --- by vendor and amount ---------------------------------------------------


def match_vendor_amount(
    invoices: DataFrame, pos: DataFrame, row_id: str = "_row_id", percent: int = AMOUNT_PERCENT,
    fields: tuple[str, ...] | None = None,
) -> DataFrame:
    """The alternative matcher: first row of the order number, else vendor and amount.

    The second way wants the same vendor key C, no currency conflict and an
    amount gap of at most ``percent`` of the order amount; the smallest share
    wins, then the earlier row.  An order is entered under its currency and under
    "any"; an invoice with a currency looks under its own and under "none", one
    without looks under "any".  The best order is then one of the two neighbours
    in amount, so no pairs are formed.  ``fields`` names the columns of ``po`` that are read later, besides row id,
    amount, currency and date: no others are shuffled.
    """
    carried = None if fields is None else ("currency", "date", *fields)
    orders = pos.select(
        F.trim(text(pos, "po_number")).alias("_number"), trim_all(text(pos, "vendor_name")).alias("_name"),
        currency_code(text(pos, "currency")).alias("_code"), order_struct(pos, row_id, carried).alias("target"),
    )
    firsts = (
        orders.select(match_key("_number").alias("_po_key"), "target")
        .filter("_po_key is not null")
        .groupBy("_po_key")
        .agg(F.min_by("target", F.col("target.row_id")).alias("_first"))
    )
    keyed = invoices.withColumns(
        {
            "_amount": typed(invoices, "amount"),
            "_currency": currency_code(text(invoices, "currency")),
            "_vendor_key": F.when(
                null_if_blank(text(invoices, "vendor_name")).isNotNull(),
                vendor_key_c(text(invoices, "vendor_name")),
            ),
        }
    ).withColumn("_po_join", spread_null(match_key(text(invoices, "po_number")), row_id))
    # Both ways are settled on these columns alone; the wide rows are joined once, to the outcome.
    numbered = keyed.select(row_id, "_po_join", "_vendor_key", "_currency", "_amount").join(
        firsts.withColumnRenamed("_po_key", "_po_join"), "_po_join", "left"
    )

    usable = orders.filter((F.col("target.amount") != 0) & null_if_blank("_name").isNotNull())
    slots = F.array(F.coalesce(F.concat(F.lit("="), F.col("_code")), F.lit("none")), F.lit("any"))
    targets = (
        usable.select(
            vendor_key_c("_name").alias("_vendor_key"), F.explode(slots).alias("_slot"), "target"
        )
        .groupBy("_vendor_key", "_slot", F.col("target.amount").alias("_value"))
        .agg(F.min_by("target", F.col("target.row_id")).alias("target"))
    )
    looks = F.when(
        F.col("_currency").isNotNull(), F.array(F.concat(F.lit("="), F.col("_currency")), F.lit("none"))
    ).otherwise(F.array(F.lit("any")))
    # Which amounts to look for needs the order keys only, not the joined orders.
    asked = (
        keyed.filter(F.col("_vendor_key").isNotNull() & (F.col("_amount") != 0))
        .select("_po_join", "_vendor_key", "_currency", F.col("_amount").alias("_value"))
        .join(firsts.select(F.col("_po_key").alias("_po_join")), "_po_join", "left_anti")
        .select("_vendor_key", "_currency", "_value")
        .distinct()
    )
    probes = asked.select("_vendor_key", F.explode(looks).alias("_slot"), "_value").distinct()
    near = nearest_by_key(probes, targets, ["_vendor_key", "_slot"], "_value")

    po_amount = F.col("cand.amount")
    off = cents(F.abs(F.col("_value") - po_amount))
    share = off.cast("double") / cents(po_amount).cast("double")
    close = (
        near.select("_vendor_key", "_slot", "_value", F.explode(F.array("below", "above")).alias("cand"))
        .filter(F.col("cand").isNotNull())
        .withColumn("_share", share)
        .filter(off * 100 <= cents(po_amount) * percent)
        .groupBy("_vendor_key", "_slot", "_value")
        .agg(F.min(F.struct("_share", F.col("cand.row_id").alias("_rid"), "cand")).alias("best"))
    )
    best = (
        asked.withColumn("_slot", F.explode(looks))
        .join(close, ["_vendor_key", "_slot", "_value"])
        .groupBy("_vendor_key", F.coalesce("_currency", F.lit("")).alias("_cur"), "_value")
        .agg(F.min("best").alias("best"))
        .select("_vendor_key", "_cur", "_value", F.col("best.cand").alias("_by_amount"))
    )
    # Rows that do not look get a key of their own, so they do not meet in one task.
    looking = F.col("_first").isNull() & F.col("_vendor_key").isNotNull() & (F.col("_amount") != 0)
    outcome = (
        numbered.withColumns(
            {
                "_vk": spread_null(F.when(looking, F.col("_vendor_key")), row_id),
                "_cur": F.coalesce("_currency", F.lit("")),
                "_value": F.col("_amount"),
            }
        )
        .join(best.withColumnRenamed("_vendor_key", "_vk"), ["_vk", "_cur", "_value"], "left")
        .select(row_id, "_first", "_by_amount")
    )
    joined = keyed.drop("_po_join").join(outcome, row_id, "left")
    po = F.coalesce("_first", "_by_amount")
    zero = F.lit(0).cast("decimal(18,2)")
    out = joined.withColumn("po", po).withColumn(
        "match_type",
        F.when(F.col("_first").isNotNull(), "po_number").when(F.col("_by_amount").isNotNull(), "vendor_amount"),
    )
    gap = F.abs(F.coalesce("_amount", zero) - F.coalesce(F.col("po.amount"), zero))
    has_po_amount = F.coalesce(F.col("po.amount"), zero) != 0
    stale = (
        F.datediff("invoice_date", F.col("po.date")) > STALE_DAYS
        if "invoice_date" in invoices.columns
        else F.lit(False)
    )
    hit = F.col("po").isNotNull()
    return out.withColumns(
        {
            "amount_diff": F.when(hit, gap),
            "amount_diff_pct": F.when(
                hit, F.when(has_po_amount, gap.cast("double") / F.col("po.amount").cast("double")).otherwise(0.0)
            ),
            "stale_po": F.when(hit, F.coalesce(stale, F.lit(False))),
            "currency_warning": F.when(
                hit,
                (F.col("match_type") == "vendor_amount")
                & (F.col("_currency").isNull() | F.col("po.currency").isNull()),
            ),
        }
    ).drop("_first", "_by_amount", "_vendor_key")

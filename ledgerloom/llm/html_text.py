"""Main text of web pages: a suffix array per host finds what its pages repeat.

Each page becomes a stream of text blocks, which goes into its host's suffix array:
suffixes from every block's start and, inside long blocks, from every word, in the order
of their characters.  Neighbours in that order give the longest run a suffix shares with
another page of the host.  Blocks that such runs cover are boilerplate, blocks that stand
in furniture (menus, footers, forms and the like, told by tag, role or class) are as well;
unique runs are the main text.  Where markup encloses an article, the article's blocks are
the main text, but for those covered by runs that other pages have both inside their articles
and around them.  Copies of articles, passages that articles share and headlines quoted around
other articles are content; what a host shows around its articles and repeats inside them is not.

So a suffix inside an article matters only if its first ``MIN_RUN`` characters begin a
suffix outside articles.  All of them are asked, at every word, against a filter of these
beginnings; those the filter lets pass go into the array.

A host may hold a third of all pages: equal suffixes are merged before the shuffle,
ranges are cut by host and first characters, and runs return to their pages by the
suffixes' hashes, so no host is ever one group.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk
from ledgerloom.session import Scratch

SUFFIX = 64  # characters of a suffix that are compared
MIN_RUN = 24  # characters a repeated run has at least
COVERED = 0.5  # share of a block's characters that runs must cover
PROSE = 100  # characters of a block that may stay on a page that would lose all text
FILTER_BITS = 1 << 27  # of the filter of beginnings, at most; beyond some 20 million beginnings it lets more and more pass
PROBES = 3  # bits of a beginning in the filter

# HTML elements by what they do to text, and names that pages give to furniture.
_BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody "
    "tfoot thead tr ul".split()
)
_VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW_TAGS = frozenset("script style noscript iframe noembed noframes textarea title template svg canvas object".split())
_FURNITURE_TAGS = frozenset("nav aside footer header form menu dialog button select head".split())
_FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner sponsored sponsor promo cookie cookies consent notice notices popup modal newsletter "
    "subscribe nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments respond disqus "
    "share sharing social related widget form login search pagination".split()
)
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_COMMENT_NAMES = frozenset("comment comments respond disqus".split())
_LAYOUT_NAMES = frozenset("has with no layout wrapper container page site".split())
_ARTICLE_HEAD = frozenset({"header", "banner"})

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z][a-z]*")
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_WORD = re.compile(r"\S+")

ARTICLE, MAIN, OPEN, FURNITURE = 0, 1, 2, 3
LOOSE, AROUND, INSIDE = 0, 1, 2  # where a suffix stands: on a page without an article, around an article, inside one


def _zone(tag: str, attributes: str, inside: int) -> int:
    """The zone an element's content belongs to, given the zone around it."""
    names: set[str] = set()
    roles: set[str] = set()
    body = False
    if attributes and tag not in ("html", "body"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value, key = a or b or c, key.lower()
            if key in ("class", "id"):
                names |= {n.lower() for n in _NAME.findall(value)}
            elif key == "role":
                roles |= set(value.lower().split())
            else:
                body = body or value == "articleBody"
    if inside == FURNITURE:
        return FURNITURE
    if tag == "article" or body:
        return FURNITURE if names & _COMMENT_NAMES else ARTICLE
    if tag == "main" or "main" in roles:
        return min(inside, MAIN)
    # A frame named after what it has beside the text ("with-sidebar") is not furniture.
    marks, heads = frozenset() if names & _LAYOUT_NAMES else _FURNITURE_NAMES, tag in _FURNITURE_TAGS
    if inside == ARTICLE:
        marks, heads = marks - _ARTICLE_HEAD, heads and tag != "header"
    return FURNITURE if heads or names & marks or roles & _FURNITURE_ROLES else inside


def page_blocks(page: str) -> list[tuple[int, str]]:
    """Zone and text of each block, in page order; references decoded, white space joined, empty blocks left out.

    Elements that are never text (scripts, styles, templates and so on) and comments go; an element left open ends
    with the one around it or with the page.
    """
    blocks: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []
    zone, at, parts = OPEN, 0, []

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            blocks.append((zone, text))
        parts.clear()

    find = _TAG.search
    while found := find(page, at):
        parts.append(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _RAW_TAGS:
            if not found[1] and not found[3].endswith("/"):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in _VOID_TAGS:
            if tag == "hr":
                close()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in _BLOCK_TAGS:
            close()
        elif tag in ("td", "th"):
            parts.append(" ")
        if found[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag not in _BLOCK_TAGS and stack[depth][1] != zone:
                        close()
                    zone = stack[depth][1]
                    del stack[depth:]
                    break
        elif not found[3].endswith("/"):
            if tag == "body":  # ends a head left open
                stack.clear()
                zone = OPEN
            inside = _zone(tag, found[3], zone)
            if inside != zone:
                close()
            stack.append((tag, zone))
            zone = inside
    parts.append(page[at:])
    close()
    return blocks


def marked_article(blocks: list[tuple[int, str]]) -> int | None:
    """The zone whose blocks are the article: article markup, else a main element, else none."""
    zones = {zone for zone, _ in blocks}
    return ARTICLE if ARTICLE in zones else MAIN if MAIN in zones else None


def stream(blocks: list[tuple[int, str | int]]) -> list[tuple[int, int]]:
    """Start and end of each block in the page's stream of text.

    A block is followed by a line feed, and by a null character as well where the page passes into or out of its
    article.  Of a block that is only its length, the length counts.
    """
    article = marked_article(blocks)
    at, spans = 0, []
    for i, (zone, words) in enumerate(blocks):
        if i and (zone == article) != (blocks[i - 1][0] == article):
            at += 1
        size = words if isinstance(words, int) else len(words)
        spans.append((at, at + size))
        at += size + 1
    return spans


def stream_text(blocks: list[tuple[int, str]], spans: list[tuple[int, int]]) -> str:
    """The text of the stream.  No suffix passes a null character."""
    parts = []
    for (_, words), (_, end), after in zip(blocks, spans, [*(start for start, _ in spans[1:]), -1]):
        parts += [words, "\n", "\0" if after == end + 2 else ""]
    return "".join(parts)


def anchors(text: str, spans: list[tuple[int, int, int]]) -> Iterator[int]:
    """Where suffixes start: at every block, and inside long ones at every word; ``spans`` are (block, start, end)."""
    for _, start, end in spans:
        yield start
        if end - start > SUFFIX:
            yield from (at for m in _WORD.finditer(text, start, end) if (at := m.start()) > start)


def page_stream(source: str) -> tuple[str, list[int], Iterator[int]]:
    """A page's stream of text, the anchors outside its article, and those inside, found when asked for."""
    blocks = page_blocks(source)
    article, places = marked_article(blocks), stream(blocks)
    text = stream_text(blocks, places)
    spans = [(i, *place) for i, place in enumerate(places)]
    some = lambda inside: anchors(text, [x for x in spans if (blocks[x[0]][0] == article) == inside])
    return text, list(some(False)), some(True)


def suffix_at(text: str, at: int) -> str:
    return text[at : at + SUFFIX].split("\0", 1)[0]


def shared_prefix(a: str, b: str) -> int:
    """Characters that two strings have in common from the left."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size
    low, high = 0, size - 1
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


_SUFFIXES = "host string, suffix string, page long, at int, kind int"


def _suffix_batch(rows: list[tuple[str, str, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32())
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "suffix", "page", "at", "kind"])


def _outside(batches) -> Iterator[pa.RecordBatch]:
    """Suffixes outside the article of each page, with the host, the page's hash and the place."""
    for batch in batches:
        rows = []
        for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
            text, outside, inside = page_stream(source)
            kind = LOOSE if next(inside, None) is None else AROUND
            for at in outside:
                suffix = suffix_at(text, at)
                if len(suffix) >= MIN_RUN:
                    rows.append((host, suffix, page, at, kind))
        yield _suffix_batch(rows)


_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(MIN_RUN, _BASE, np.uint64), dtype=np.uint64)


def _host_hash(host: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest()))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def beginning_hashes(text: str, places: list[int], host: np.uint64) -> np.ndarray:
    """Hashes of the ``MIN_RUN`` characters from each place of a host's text."""
    letters = _letters(text)
    out = np.full(len(places), host, np.uint64)
    at = np.array(places, np.int64)
    for i in range(MIN_RUN):
        out += letters[at + i] * _POWERS[i]
    return tk.mix(out)


def filter_places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The ``PROBES`` places of each hash in a filter of ``bits`` (a power of two) bits."""
    for i in range(PROBES):
        yield ((hashes + tk.U64(i) * (tk.mix(hashes) | tk.U64(1))) >> tk.U64(20) & tk.U64(bits - 1)).astype(np.int64)


def _filter_rows(bits: int):
    def run(batches):
        for batch in batches:
            found, seen = [], {}
            for host, suffix in zip(batch.column("host").to_pylist(), batch.column("suffix").to_pylist()):
                seen.setdefault(host, set()).add(suffix[:MIN_RUN])
            for host, heads in seen.items():
                text = "".join(heads)
                hashes = beginning_hashes(text, list(range(0, len(text), MIN_RUN)), _host_hash(host))
                found += filter_places(hashes, bits)
            yield pa.record_batch([pa.array(np.unique(np.concatenate(found)) if found else [], pa.int64())], names=["place"])

    return run


def beginnings_filter(suffixes: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of the first ``MIN_RUN`` characters of each suffix, with its host; ``FILTER_BITS`` at most."""
    bits = min(FILTER_BITS, max(1 << 15, 1 << (16 * suffixes.count()).bit_length()))
    places = suffixes.select("host", "suffix").mapInArrow(_filter_rows(bits), "place long")
    # These functions count from 1, in buckets of as many bits as a part below has.
    bucket, position = (F.call_function(f, F.col("place") + 1) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    parts = places.groupBy(bucket.alias("bucket")).agg(F.call_function("bitmap_construct_agg", position).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.collect():
        part = np.frombuffer(bytes(row.bits), np.uint8)
        out[(row.bucket - 1) * len(part) : row.bucket * len(part)] = part
    return out


def _inside(beginnings):
    """Suffixes inside the article of each page that may begin like one outside articles, though not like one outside its own."""

    def run(batches):
        known = beginnings.value
        bits = 8 * len(known)
        for batch in batches:
            rows = []
            for host, page, source in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                text, outside, inside = page_stream(source)
                inside = [at for at in inside if at + MIN_RUN <= len(text)]
                if not inside:
                    continue
                there = np.ones(len(inside), bool)
                for place in filter_places(beginning_hashes(text, inside, _host_hash(host)), bits):
                    there &= (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                if not there.any():
                    continue
                own = {text[at : at + MIN_RUN] for at in outside}
                for at in np.array(inside)[there].tolist():
                    suffix = suffix_at(text, at)
                    if len(suffix) >= MIN_RUN and suffix[:MIN_RUN] not in own:
                        rows.append((host, suffix, page, at, INSIDE))
            yield _suffix_batch(rows)

    return run


def neighbour_runs(rows: Iterator[tuple[str, str, int, int]]) -> Iterator[tuple[str, str, int]]:
    """From distinct (host, suffix, least page, greatest page) in order: the run each suffix shares with another page.

    The nearest suffixes of other pages stand right before and after a stretch of one page's suffixes; what a suffix
    shares with them is its longest run, as in any suffix array.  A suffix that two pages have is shared whole.
    """
    stretch: list[tuple[str, str, int, int]] = []
    before: tuple[str, str, int, int] | None = None

    def runs(after: tuple[str, str, int, int] | None) -> Iterator[tuple[str, str, int]]:
        for host, suffix, least, greatest in stretch:
            if least != greatest:
                run = len(suffix)
            else:
                run = max((shared_prefix(suffix, o[1]) for o in (before, after) if o is not None and o[0] == host), default=0)
            if run >= MIN_RUN:
                yield host, suffix, run

    for row in rows:
        own = stretch and row[2] == row[3] == stretch[0][2] == stretch[0][3] and row[0] == stretch[0][0]
        if stretch and not own:
            yield from runs(row)
            before, stretch = stretch[-1], []
        stretch.append(row)
    yield from runs(None)


def _runs(batches) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("host", "suffix", "least", "greatest")))

    out: list[tuple[str, str, int]] = []

    def batch() -> pa.RecordBatch:
        hosts, suffixes, runs = zip(*out) if out else ((), (), ())
        return pa.record_batch(
            [pa.array(hosts, pa.string()), pa.array(suffixes, pa.string()), pa.array(runs, pa.int32())], names=["host", "suffix", "run"]
        )

    for run in neighbour_runs(rows()):
        out.append(run)
        if len(out) == 10_000:
            yield batch()
            out.clear()
    yield batch()


def _ranged(suffixes: DataFrame, *more: Column) -> DataFrame:
    """Distinct suffixes of each host in parts that never separate two with the same first ``MIN_RUN`` characters."""
    distinct = suffixes.groupBy("host", "suffix").agg(F.min("page").alias("least"), F.max("page").alias("greatest"), *more)
    return distinct.withColumn("head", F.substring("suffix", 1, MIN_RUN)).repartitionByRange("host", "head")


def repeated_runs(suffixes: DataFrame) -> DataFrame:
    """``(host, suffix, run)``: suffixes of which at least ``MIN_RUN`` characters stand on another page of the host.

    Equal suffixes are merged before they are shuffled.  A range never separates suffixes that share their first
    ``MIN_RUN`` characters, so a neighbour in another range cannot share a run.
    """
    ranged = _ranged(suffixes).select("host", "suffix", "least", "greatest").sortWithinPartitions("host", "suffix")
    return ranged.mapInArrow(_runs, "host string, suffix string, run int")


def _shared(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("suffix", "before", "after"))
        runs = [max((shared_prefix(s, o) for o in (a, b) if o is not None), default=0) for s, a, b in zip(*columns)]
        yield pa.record_batch([batch.column("host"), batch.column("suffix"), pa.array(runs, pa.int32())], names=["host", "suffix", "run"])


def runs_around(suffixes: DataFrame) -> DataFrame:
    """``(host, suffix, run)``: suffixes inside articles of which at least ``MIN_RUN`` characters stand around articles.

    Given those that do not begin like a suffix outside the article of their own page, so the other one is another
    page's.  The nearest suffixes around articles, one up and one down in the order, share the longest run.
    """
    some = suffixes.filter(F.col("kind") != LOOSE)
    ranged = _ranged(some, *[F.bool_or(F.col("kind") == kind).alias(name) for kind, name in ((INSIDE, "asks"), (AROUND, "around"))])
    part = Window.partitionBy("host", "head")
    nearest = lambda order: F.last(F.when(F.col("around"), F.col("suffix")), ignorenulls=True).over(
        part.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    near = ranged.withColumn("after", nearest(F.col("suffix").desc())).withColumn("before", nearest(F.col("suffix").asc()))
    asked = near.filter("asks and (before is not null or after is not null)").select("host", "suffix", "before", "after")
    return asked.mapInArrow(_shared, "host string, suffix string, run int").filter(F.col("run") >= MIN_RUN)


def choose_blocks(blocks: list[tuple[int, str | int]], runs: list[tuple[int, int]]) -> list[str]:
    """Texts of the blocks that stay, given the repeated runs (start, length) in the page's stream.

    Of a page with an article, the runs inside it are those that other pages have inside and around theirs.
    """
    places = stream(blocks)
    end = places[-1][1] + 1 if places else 0
    marks = np.zeros(end + 1, np.int32)
    for start, size in runs:
        marks[start] += 1
        marks[min(start + size, end)] -= 1
    total = np.concatenate([[0], np.cumsum(np.cumsum(marks) > 0)])
    unique = [total[b] - total[a] <= COVERED * (b - a) for a, b in places]
    article = marked_article(blocks)
    if article is not None:
        own = [(text, alone) for (zone, text), alone in zip(blocks, unique) if zone == article]
        return [text for text, alone in own if alone] or [text for text, _ in own]
    free = [(text, alone) for (zone, text), alone in zip(blocks, unique) if zone != FURNITURE]
    return [text for text, alone in free if alone] or [text for text, _ in free if len(text) >= PROSE]


def _packed(batches) -> Iterator[pa.RecordBatch]:
    """Pages as compressed blocks: text that may stay, the length of the rest."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blobs = []
        for source in batch.column("html").to_pylist():
            blocks = page_blocks(source)
            article = marked_article(blocks)
            short = [
                (zone, len(text) if zone == FURNITURE or (article is not None and zone != article) else text) for zone, text in blocks
            ]
            blobs.append(pack.compress(json.dumps(short, ensure_ascii=False).encode("utf-8", "surrogatepass")))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), batch.column("key"), pa.array(blobs, pa.binary())],
            names=["page_id", "url", "key", "blob"],
        )


def _texts(batches) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = []
        for blob, runs in zip(batch.column("blob").to_pylist(), batch.column("runs").to_pylist()):
            blocks = json.loads(unpack.decompress(blob).decode("utf-8", "surrogatepass"))
            text = "\n\n".join(choose_blocks(blocks, [(r["at"], r["run"]) for r in runs or ()]))
            texts.append(text.encode("utf-8", "replace").decode())
        yield pa.record_batch(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the main text of every page.

    Null html counts as empty and gives an empty text.  Pages without a url, or with one that names no host, share
    the empty host.  Equal pages of one host count as one page, so a copy does not make boilerplate of its text.  An
    article loses blocks that other pages have inside and around theirs, unless it would lose all or its own page has
    them around it, too.  A
    page without article markup of which another is a near copy would lose all of it; its blocks of ``PROSE``
    characters and more stay then.  Repeated rows and rows with null ids are answered one by one.  An empty table
    gives no rows.  Further columns are ignored, whatever their names.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    source = F.coalesce(F.col("html").cast("string"), F.lit(""))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host.alias("host"), source.alias("html"))
    sources = named.select("host", F.xxhash64("html").alias("page"), "html")
    outside = scratch.cut(sources.mapInArrow(_outside, _SUFFIXES), "outside")
    # A filter of fixed size at most; with it every word inside the articles is asked where it is read.
    beginnings = pages.sparkSession.sparkContext.broadcast(beginnings_filter(outside))
    inside = scratch.cut(sources.mapInArrow(_inside(beginnings), _SUFFIXES), "inside")
    beginnings.destroy()
    suffixes = outside.unionAll(inside)
    by_hash = lambda df, *more: df.select(F.xxhash64("host", "suffix").alias("hash"), *more)
    both = repeated_runs(inside).join(runs_around(suffixes).withColumnRenamed("run", "around"), ["host", "suffix"])
    found = by_hash(repeated_runs(suffixes), "run", F.lit(LOOSE).alias("kind")).unionAll(
        by_hash(both, F.least("run", "around").alias("run"), F.lit(INSIDE).alias("kind"))
    )
    # What stands around an article goes anyway, so it asks nothing.
    runs = (
        by_hash(suffixes.filter(F.col("kind") != AROUND), F.xxhash64("host", "page").alias("key"), "at", "kind")
        .join(found, ["hash", "kind"])
        .groupBy("key")
        .agg(F.collect_set(F.struct("at", "run")).alias("runs"))
    )
    packed = named.select("page_id", "url", F.xxhash64("host", F.xxhash64("html")).alias("key"), "html").mapInArrow(
        _packed, "page_id long, url string, key long, blob binary"
    )
    return (
        packed.join(runs, "key", "left")
        .select("page_id", "url", "blob", "runs")
        .mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
    )

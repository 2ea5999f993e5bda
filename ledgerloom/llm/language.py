"""Language of a document by rank-order profiles.

A language's profile holds its ``PROFILE`` most frequent letter n-grams (1 to 3,
words padded with a space) in order.  A document's own most frequent n-grams are
compared with each profile: the distance is the sum of how far each n-gram is out of
place, ``PROFILE`` for one that the profile lacks.  The nearest language wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk

PROFILE = 300
SAMPLE = 3000  # documents a language's profile is learned from, about
MOST_LANGUAGES = 1000  # the bound of the profile table; more are an error
UNKNOWN = "und"
_SLICE = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ranked_ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distinct n-grams of each text: row, 40-bit hash and count, most frequent first within a row.

    Equal counts are ordered by hash, so the order depends on the text alone.
    """
    lowered = [f" {t.lower()} " if t else "" for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    letter = _letters()[points]
    # " word word ": one space before, between and after words, whatever stood there.
    before = np.zeros(len(points), bool)
    before[1:] = letter[:-1]
    first = np.ones(len(points), bool)
    first[1:] = rows[1:] != rows[:-1]
    keep = letter | before | first
    points, rows, letter = points[keep].astype(np.uint64), rows[keep], letter[keep]
    points[~letter] = 32
    shift = lambda a, k: a[k:] if k else a
    found = []
    for n in (1, 2, 3):
        size = len(points) - n + 1
        if size <= 0:
            continue
        code = np.zeros(size, np.uint64)
        for k in range(n):
            code = (code << tk.U64(21)) | shift(points, k)[:size]
        good = rows[:size] == shift(rows, n - 1)[:size]
        # A space inside would join two words; spaces alone say nothing.
        good &= letter[1 : size + 1] if n == 3 else letter[:size] | shift(letter, n - 1)[:size]
        hashes = tk.mix(code[good] + tk.U64(n)) >> tk.U64(24)
        found.append((rows[:size][good].astype(np.uint64) << tk.U64(40)) | hashes)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = np.unique(np.concatenate(found), return_counts=True)
    owner = (keys >> tk.U64(40)).astype(np.int64)
    order = np.lexsort([keys, -counts, owner])
    return owner[order], (keys & tk.U64((1 << 40) - 1)).astype(np.int64)[order], counts[order]


class Profiles:
    """Ranks of n-grams by language, for looking up many n-grams at once."""

    def __init__(self, ranks: dict[str, dict[int, int]]) -> None:
        self.languages = sorted(ranks)
        self.known = np.array(sorted({h for r in ranks.values() for h in r}), np.int64)
        self.rank = np.full((len(self.known) + 1, len(self.languages)), -1, np.int64)
        for k, name in enumerate(self.languages):
            hashes = np.array(list(ranks[name]), np.int64)
            self.rank[np.searchsorted(self.known, hashes), k] = list(ranks[name].values())

    def nearest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Nearest language of each text and 1 - distance / largest distance; ``und`` without a letter."""
        rows, hashes, _ = ranked_ngrams(texts)
        at = tk.row_bounds(rows, len(texts))
        place = np.arange(len(rows)) - at[rows] if len(rows) else np.zeros(0, np.int64)
        top = place < PROFILE
        rows, hashes, place = rows[top], hashes[top], place[top]
        many = np.bincount(rows, minlength=len(texts))
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        where = np.searchsorted(self.known, hashes)
        where[where == len(self.known)] = 0
        where[self.known[where] != hashes] = len(self.known)  # the last row: in no profile
        rank = self.rank[where]
        apart = np.where(rank < 0, PROFILE, np.abs(rank - place[:, None]))
        distance = np.stack([np.bincount(rows, apart[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        best = distance.argmin(axis=1)  # the first in name order on a tie
        worst = np.maximum(many * PROFILE, 1)
        score = np.where(many > 0, 1 - distance[np.arange(len(texts)), best] / worst, 0.0)
        return [self.languages[b] if m else UNKNOWN for b, m in zip(best, many)], score


def _count_rows(batches):
    """``lang, gram, n``: n-gram counts of the texts of a batch, added up by language."""
    for part in tk.text_slices(batches, limit=_SLICE):
        names = part.column("lang").to_pylist()
        languages = sorted(set(names))
        number = {name: i for i, name in enumerate(languages)}
        rows, hashes, counts = ranked_ngrams(part.column("text").to_pylist())
        of = np.array([number[n] for n in names], np.int64)[rows] if len(rows) else rows
        keys, back = np.unique((of << 40) | hashes, return_inverse=True)
        total = np.bincount(back, counts, len(keys)).astype(np.int64)
        yield pa.record_batch(
            [pa.array([languages[k] for k in (keys >> 40).tolist()], pa.string()), pa.array(keys & ((1 << 40) - 1)), pa.array(total)],
            names=["lang", "gram", "n"],
        )


def learn_profiles(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Profiles:
    """Profiles from rows with a language: about ``sample`` documents of each, those first in hash order.

    A language with fewer documents is learned from all of them.  At most ``PROFILE`` rows per
    language come to the driver.
    """
    usable = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("id")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    sizes = usable.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    if len(sizes.limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # At most MOST_LANGUAGES rows.
    chosen = usable.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    counts = chosen.select("lang", "text").mapInArrow(_count_rows, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranks: dict[str, dict[int, int]] = {}
    for r in counts.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < PROFILE).collect():
        ranks.setdefault(r["lang"], {})[r["gram"]] = r["rank"]
    return Profiles(ranks)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row, from its whole text.

    A null or empty text, or one without a letter, is ``und`` with score 0; so is everything when no
    language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded by MOST_LANGUAGES x PROFILE ranks

    def run(batches):
        for part in tk.text_slices(batches, limit=_SLICE):
            names, score = shared.value.nearest(part.column("text").to_pylist())
            yield pa.record_batch([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double"
    )

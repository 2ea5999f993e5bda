"""Document quality: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2])

The bracket is the sum-of-squares form of all pairwise interactions, linear in
the number of features of a document.  Features are made inside Arrow tasks from
whole texts; the fitted model is a few megabytes and goes to the tasks with the
function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import textkit as tk

BUCKETS = 1 << 16
RANK = 6
SAMPLE = 12_000  # labelled rows the model is fitted on, at most
THRESHOLD = 0.3
EPOCHS = 6

STATS = (
    "log bytes", "log words", "mean word length", "upper share", "digit share", "symbol share", "line share",
    "non-ASCII share", "distinct word share", "top word share", "repeat share", "shouted share", "log n_chars",
)
N_STATS = len(STATS)

_KIND = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 symbol, 4 line end, 5 beyond ASCII
_KIND[33:127] = 3
_KIND[48:58] = 2
_KIND[65:91] = 1
_KIND[97:123] = 0
_KIND[10] = 4
_KIND[128:] = 5
for _mark in b".,;:'\"-?()":  # ordinary punctuation
    _KIND[_mark] = 0


@dataclass
class Features:
    """Sparse rows: ``bucket[at[i]:at[i+1]]`` with ``value``, and the dense statistics."""

    at: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def features(texts: pa.Array, n_chars: pa.Array | None) -> Features:
    """Features of whole texts; an empty text has no words and zero shares."""
    data, offsets = tk.text_bytes(texts)
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    starts, ends, rows = tk.word_spans(data, offsets)
    hashes = tk.span_hashes(tk.prefix_sums(tk.lower_ascii(data)), starts, ends)
    at = tk.row_bounds(rows, n)
    words = np.diff(at)
    key = (rows.astype(np.uint64) << tk.U64(16)) | (hashes & tk.U64(BUCKETS - 1))
    key, counts = np.unique(key, return_counts=True)
    owner = (key >> tk.U64(16)).astype(np.int64)
    cell = tk.row_bounds(owner, n)
    length = np.sqrt(np.bincount(owner, counts.astype(float) ** 2, n))
    kind = _KIND[data]
    row_of = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(row_of * 6 + kind, minlength=6 * n).reshape(n, 6)
    safe_bytes, safe_words = np.maximum(sizes, 1), np.maximum(words, 1)
    top = np.zeros(n)
    np.maximum.at(top, owner, counts)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    uppers = np.concatenate([[0], np.cumsum(kind == 1)])
    shouted = (uppers[ends] - uppers[starts] >= 2) if len(starts) else np.zeros(0, bool)
    meta = np.zeros(n) if n_chars is None else np.nan_to_num(np.array(n_chars.cast(pa.float64()).to_numpy(zero_copy_only=False), float))
    stats = np.column_stack(
        [
            np.log1p(sizes), np.log1p(words), np.bincount(rows, ends - starts, n) / safe_words,
            kinds[:, 1] / safe_bytes, kinds[:, 2] / safe_bytes, kinds[:, 3] / safe_bytes, kinds[:, 4] / safe_bytes,
            kinds[:, 5] / safe_bytes, np.diff(cell) / safe_words, top / safe_words,
            np.bincount(rows[same], minlength=n) / safe_words, np.bincount(rows[shouted], minlength=n) / safe_words,
            np.log1p(np.maximum(meta, 0)),
        ]
    ).astype(np.float32)
    value = (counts / length[owner]).astype(np.float32) if len(owner) else np.zeros(0, np.float32)
    return Features(cell, (key & tk.U64(BUCKETS - 1)).astype(np.int32), value, stats)


def _row_sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(x) + 1)
    np.cumsum(x, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # of the statistics, then of the word buckets
    factor: np.ndarray  # the same rows, RANK columns
    mean: np.ndarray
    spread: np.ndarray

    def logits(self, f: Features) -> np.ndarray:
        dense = np.clip((f.stats - self.mean) / self.spread, -6, 6)
        where = f.bucket + N_STATS
        total = self.bias + dense @ self.weight[:N_STATS] + _row_sums(f.value * self.weight[where], f.at)
        for k in range(self.factor.shape[1]):
            v = self.factor[:, k]
            term = f.value * v[where]
            plain = dense @ v[:N_STATS] + _row_sums(term, f.at)
            squares = dense**2 @ v[:N_STATS] ** 2 + _row_sums(term**2, f.at)
            total += 0.5 * (plain**2 - squares)
        return total

    def scores(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(f), -30, 30)))


def fit(f: Features, labels: np.ndarray, rank: int = RANK, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Minibatch AdaGrad on the logistic loss, with weight decay; labels 0 or 1."""
    rng = np.random.default_rng(seed)
    n, size = len(labels), N_STATS + BUCKETS
    mean, spread = f.stats.mean(0), f.stats.std(0) + 1e-3
    dense = np.clip((f.stats - mean) / spread, -6, 6)
    share = np.clip(labels.mean(), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    # Column 0 is the linear weight, the others are the factors.
    p = np.zeros((size, rank + 1), np.float32)
    p[:, 1:] = rng.normal(0, 0.02, (size, rank))
    seen = np.full((size, rank + 1), 1e-3, np.float32)
    for _ in range(epochs):
        order = rng.permutation(n)
        for begin in range(0, n, 256):
            rows = order[begin : begin + 256]
            lengths = f.at[rows + 1] - f.at[rows]
            pick = np.repeat(f.at[rows] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            owner = np.repeat(np.arange(len(rows)), lengths)
            x, where = f.value[pick], f.bucket[pick] + N_STATS
            at = np.concatenate([[0], np.cumsum(lengths)])
            d = dense[rows]
            own = p[where]
            sums = np.column_stack([_row_sums(x * own[:, k], at) for k in range(rank + 1)]) + d @ p[:N_STATS]
            squares = np.column_stack([_row_sums((x * own[:, k]) ** 2, at) for k in range(1, rank + 1)]) + d**2 @ p[:N_STATS, 1:] ** 2
            logit = bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1)
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[rows]) / len(rows)
            bias -= 0.5 * float(error.sum())
            pull = error[owner][:, None]
            grad = np.empty_like(own)
            grad[:, :1] = pull * x[:, None]
            grad[:, 1:] = pull * (x[:, None] * sums[owner, 1:] - own[:, 1:] * x[:, None] ** 2)
            touched, back = np.unique(where, return_inverse=True)
            total = np.column_stack([np.bincount(back, grad[:, k], len(touched)) for k in range(rank + 1)])
            total += 2e-5 * p[touched]
            dgrad = np.column_stack([d.T @ error, d.T @ (error[:, None] * sums[:, 1:]) - p[:N_STATS, 1:] * (d**2).T.dot(error)[:, None]])
            touched = np.concatenate([np.arange(N_STATS), touched])
            total = np.concatenate([dgrad + 1e-4 * p[:N_STATS], total])
            seen[touched] += total**2
            p[touched] -= 0.1 * total / np.sqrt(seen[touched])
    return Model(bias, p[:, 0].copy(), p[:, 1:].copy(), mean, spread)


_FEATURE_SCHEMA = "label double, bucket binary, value binary, stats binary"


def _feature_rows(batches):
    for part in tk.text_slices(batches):
        f = features(part.column("text"), part.column("n_chars"))
        cut = lambda a: [a[f.at[i] : f.at[i + 1]].tobytes() for i in range(part.num_rows)]
        yield pa.record_batch(
            [part.column("label").cast(pa.float64()), pa.array(cut(f.bucket), pa.binary()), pa.array(cut(f.value), pa.binary()),
             pa.array([s.tobytes() for s in f.stats], pa.binary())],
            names=["label", "bucket", "value", "stats"],
        )


def _inputs(docs: DataFrame, doc_id: str, text: str, n_chars: str):
    chars = F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")
    return [F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), chars.alias("n_chars")]


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality",
                doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> Model:
    """Fit on the ``sample`` labelled rows of ``labels(doc_id, label)`` first in hash order.

    Ids and labels that are null are left out; a document labelled twice counts
    twice.  The sample is bounded, so it is broadcast to the scan of ``docs``, which
    is not shuffled, and the features of the sample (a few kilobytes a row) are
    fitted on the driver.  Without any labelled row every score is 0.5.
    """
    chosen = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("double").alias("label"))
        .filter("_id IS NOT NULL AND label IS NOT NULL")
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(sample)
    )
    rows = (
        docs.select(*_inputs(docs, doc_id, text, n_chars))
        .join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
        .select("label", "text", "n_chars")
        .mapInArrow(_feature_rows, _FEATURE_SCHEMA)
        .toArrow()
    )
    if rows.num_rows == 0:
        zero = np.zeros(N_STATS + BUCKETS, np.float32)
        return Model(0.0, zero, zero[:, None], np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32))
    join = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    sizes = np.array([len(b) // 4 for b in rows.column("bucket").to_pylist()])
    f = Features(
        np.concatenate([[0], np.cumsum(sizes)]), join("bucket", np.int32), join("value", np.float32),
        join("stats", np.float32).reshape(-1, N_STATS),
    )
    truth = rows.column("label").to_numpy()
    # Tasks deliver rows in any order; a fixed order makes the fit repeatable.
    order = np.lexsort([truth, f.stats[:, 2], f.stats[:, 8], f.stats[:, 0]])
    lengths = sizes[order]
    pick = np.repeat(f.at[order] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    ordered = Features(np.concatenate([[0], np.cumsum(lengths)]), f.bucket[pick], f.value[pick], f.stats[order])
    return fit(ordered, truth[order])


def score_quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``doc_id, score, predicted`` for each row; null and empty texts are scored on their statistics."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by BUCKETS x (RANK + 1) floats

    def run(batches):
        for part in tk.text_slices(batches):
            score = shared.value.scores(features(part.column("text"), part.column("n_chars")))
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(*_inputs(docs, doc_id, text, n_chars)).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` scored at least ``THRESHOLD``, all columns, in one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    has_chars = n_chars in docs.columns

    def run(batches):
        for part in tk.text_slices(batches, text):
            f = features(part.column(text), part.column(n_chars) if has_chars else None)
            yield part.filter(pa.array(shared.value.scores(f) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    """True for rows whose crc32 of the id as text leaves ``part`` modulo ``parts``; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == part, F.lit(False))

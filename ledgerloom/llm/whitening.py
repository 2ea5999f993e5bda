"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation on distributed rows.

X is the table of centred rows, far too long for one machine; a row has few entries.
A step multiplies ``X v`` and ``X^T u``, each one pass over the written rows.  A left
vector ``u`` is as long as the table and is never stored: it is ``X w`` for a short
``w``, so a pass makes the left vectors it needs from its own rows.  Both sides are
orthogonalised against all earlier vectors, twice.  The small bidiagonal matrix then
gives the singular values, hence the deviations, and the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import Scratch

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
BLOCK_BYTES = 1 << 19  # entries of one block of rows
_LARGEST = float(2**62)
_BLOCK = "dim int, ids array<bigint>, x binary"


def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Usable vectors of a batch as whole numbers, per length, with their ids."""
    lists = batch.column("v").cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets) * np.asarray(lists.is_valid())
    values = lists.values.to_numpy(zero_copy_only=False)  # null entries become NaN
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        v = values[offsets[rows][:, None] + np.arange(dim)] * SCALE
        good = (np.abs(v) < _LARGEST).all(axis=1)  # false for NaN
        yield np.floor(v[good]).astype(np.int64) + SHIFT, batch.column("id").take(pa.array(rows[good]))


def _pack(batches) -> Iterator[pa.RecordBatch]:
    """Rows as blocks of whole numbers, four bytes each where they fit."""
    for batch in batches:
        for x, ids in _vectors(batch):
            step = max(1, BLOCK_BYTES // (8 * x.shape[1]))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                small = len(part) and np.abs(part).max() < 2**31
                yield pa.record_batch(
                    [
                        pa.array([part.shape[1]], pa.int32()),
                        pa.array([ids[at : at + step].to_pylist()], pa.list_(pa.int64())),
                        pa.array([part.astype("<i4" if small else "<i8").tobytes()], pa.binary()),
                    ],
                    names=["dim", "ids", "x"],
                )


def _blocks(batches) -> Iterator[tuple[pa.Scalar, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, dim = batch.column("ids")[i], batch.column("dim")[i].as_py()
            raw = batch.column("x")[i].as_py()
            width = len(raw) // (len(ids) * dim)
            yield ids, np.frombuffer(raw, f"<i{width}").astype(np.int64).reshape(len(ids), dim)


@dataclass
class Rows:
    """The written rows, their number, exact sums per dimension, and their total variance."""

    blocks: DataFrame
    n: int
    sums: list[int]
    trace: float = 0.0

    def centre(self) -> Callable[[np.ndarray], np.ndarray]:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return lambda x: (x - whole) - rest

    def total(self, of_block: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of a short vector over all blocks of centred rows: added up in the tasks, then by index."""
        centre = self.centre()

        def add(batches):
            total = None
            for _, x in _blocks(batches):
                part = of_block(centre(x))
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "v"])

        sums = self.blocks.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        return np.array([r.v for r in sorted(sums.collect())])


@dataclass
class Whitening:
    rows: Rows
    components: np.ndarray  # dim x k, unit columns
    variances: np.ndarray  # k, falling
    identity_error: float


def read_rows(vectors: DataFrame, vec_id: str, vector: str, scratch: Scratch) -> Rows:
    """Write the usable vectors once, as blocks, and sum them up exactly."""
    named = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = scratch.cut(named.mapInArrow(_pack, _BLOCK), "rows").filter(F.size("ids") > 0)
    lengths = blocks.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        return Rows(blocks, 0, [])
    blocks = blocks.filter(F.col("dim") == lengths.dim)

    def sums(batches):
        high = low = 0
        for _, x in _blocks(batches):
            high, low = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if not isinstance(high, int):
            i = pa.array(np.arange(len(high)), pa.int32())
            yield pa.record_batch([i, pa.array(high), pa.array(low)], names=["i", "high", "low"])

    exact = (
        blocks.mapInArrow(sums, "i int, high long, low long")
        .groupBy("i")
        .agg(F.sum(F.col("high").cast("decimal(20,0)")).alias("high"), F.sum(F.col("low").cast("decimal(20,0)")).alias("low"))
    )
    rows = Rows(blocks, lengths.n, [(int(r.high) << 32) + int(r.low) for r in sorted(exact.collect())])
    rows.trace = float(rows.total(lambda x: np.array([np.square(x).sum()]))[0]) / rows.n
    return rows


def _orthogonal(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def bidiagonalise(rows: Rows, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V and upper bidiagonal B with ``X V = U B``, X being the centred rows over sqrt(n).

    Ends when ``wanted`` singular values have converged and what is left of the variance is smaller than the
    last of them, so that no repeated value can be missing, or when V spans the whole space.  Where a space
    closes (beta is 0), a new direction orthogonal to it is taken.
    """
    dim, n, root = len(rows.sums), rows.n, np.sqrt(rows.n)
    tiny = np.finfo(float).eps * dim * np.sqrt(rows.trace)
    random = np.random.default_rng(dim)
    V, W, Z = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    alphas, betas = [], []
    v, beta = random.standard_normal(dim), 0.0
    v /= np.linalg.norm(v)
    while True:
        # X v: the new left vector, as the short w that makes it.
        w = v - beta * W[:, -1] if len(alphas) else v

        def onto_left(x: np.ndarray, w: np.ndarray = w, W: np.ndarray = W) -> np.ndarray:
            return (x @ W).T @ (x @ w) / n

        if W.shape[1]:
            w = w - W @ rows.total(onto_left)

        # X^T u, and once more onto the earlier left vectors.
        def onto_right(x: np.ndarray, w: np.ndarray = w, W: np.ndarray = W) -> np.ndarray:
            u = x @ w / root
            return np.concatenate([[u @ u], x.T @ u / root, (x @ W).T @ u / root])

        sums = rows.total(onto_right)
        square, z, onto = sums[0], sums[1 : dim + 1], sums[dim + 1 :]
        w, z = w - W @ onto, z - Z @ onto
        alpha = float(np.sqrt(max(0.0, square - onto @ onto)))
        if alpha <= tiny:
            alpha, w, z = 0.0, np.zeros(dim), np.zeros(dim)
        else:
            w, z = w / alpha, z / alpha
        V, W, Z = np.column_stack([V, v]), np.column_stack([W, w]), np.column_stack([Z, z])
        alphas.append(alpha)
        v = _orthogonal(z - alpha * v, V)
        beta = float(np.linalg.norm(v))
        if V.shape[1] == dim:
            break
        if beta <= tiny:
            beta, v = 0.0, _orthogonal(random.standard_normal(dim), V)
        v = _orthogonal(v / np.linalg.norm(v), V)
        v /= np.linalg.norm(v)
        B = np.diag(alphas) + np.diag(betas, 1)
        left, values, _ = np.linalg.svd(B)
        unseen = rows.trace - np.square(values).sum()
        if len(values) >= wanted and unseen < values[wanted - 1] ** 2:
            if (beta * np.abs(left[-1, :wanted]) <= tiny).all():
                break
        betas.append(beta)
    return V, np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1)


def fit_whitening(
    vectors: DataFrame, count: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding", scratch: Scratch | None = None
) -> Whitening:
    """Components and variances of the usable vectors.

    Vectors that are null, empty, or hold null, non-finite entries or entries whose whole number passes a long are
    left out; where lengths differ, the most frequent one counts (the shorter on ties) and other vectors are left out
    too.  Repeated rows count as often as they stand there.  A direction without variance is no component: constant
    vectors, one vector alone and an empty table have none.  Equal variances share their components' plane in some
    orthonormal way.  Each component's largest entry is positive.  Further columns are ignored.
    """
    rows = read_rows(vectors, vec_id, vector, scratch or Scratch(vectors.sparkSession))
    dim = len(rows.sums)
    if rows.trace <= 0:
        return Whitening(rows, np.zeros((dim, 0)), np.zeros(0), 0.0)
    V, B = bidiagonalise(rows, min(count, dim))
    _, values, right = np.linalg.svd(B)
    real = values[:count] > np.finfo(float).eps * dim * values[0]
    components = (V @ right.T)[:, :count][:, real]
    components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    variances = np.square(values[:count][real])

    scaled, k = components / np.sqrt(variances), len(variances)

    def moments(x: np.ndarray) -> np.ndarray:
        y = x @ scaled
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    sums = rows.total(moments) / rows.n
    covariance = sums[k:].reshape(k, k) - np.outer(sums[:k], sums[:k])
    return Whitening(rows, components, variances, float(np.abs(covariance - np.eye(k)).max()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sum of (n x - S)^2 of each row; null where it passes a long."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    centred = x - whole
    if np.square((np.abs(centred).astype(float) + 1) * n).sum(axis=1).max(initial=0.0) < _LARGEST:
        return pa.array(np.square(centred * n - rest).sum(axis=1))
    exact = [sum((int(c) * n - r) ** 2 for c, r in zip(row, rest.tolist())) for row in centred]
    return pa.array([e if e < 2**63 else None for e in exact], pa.int64())


def whiten(model: Whitening) -> DataFrame:
    """One row per vector and component: whitened value, with the vector's exact deviation and the model's figures."""
    rows, k = model.rows, len(model.variances)
    centre = rows.centre() if rows.n else None
    scaled = model.components / np.sqrt(model.variances)
    n, sums, error = rows.n, rows.sums, model.identity_error
    explained = model.variances / rows.trace if k else model.variances

    def apply(batches):
        for ids, x in _blocks(batches):
            y, m = centre(x) @ scaled, len(ids)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    ids.values.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n)),
                    _deviations(x, n, sums).take(each),
                    pa.array(y.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return (rows.blocks if k else rows.blocks.filter(F.lit(False))).mapInArrow(apply, schema)

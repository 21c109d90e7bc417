"""Whitening of embeddings by spectral divide and conquer on polar decompositions.

Entries are turned into whole numbers, so that equal vectors are equal exactly; each distinct vector
counts once in the fit. Spark sums the dimensions, then the products of the centred entries. The
covariance, as small as the vectors are long, is split on the driver: the polar factor of the matrix
shifted into its spectrum, found by the dynamically weighted Halley iteration on QR factors (QDWH),
is plus one on the eigenvalues above the shift and minus one below; it gives the projector of an
invariant subspace, and both sides are split again until single components are left. The whitening
matrix is sent to the tasks as it is bounded by the square of the vectors' length.

A null vector, and one with a null or non-finite entry, gives no rows; neither does one whose length
isn't the commonest (of equally common ones the shortest). Repeated rows get the same answer each, a
null id stays null. Entries beyond 2**62 in size count as that. Components without variance are left
out, so a table with fewer than two distinct vectors gives no rows, like an empty one. Of equal
eigenvalues any basis may be taken, the same one for all rows. ``deviation`` is null where it doesn't
fit into a long. Other columns of any name are no matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rideflow.session import stage

COMPONENTS = 16
STEP = 64
OFFSET = 1_000_000
_BOUND = 2.0**62 - 2.0**40
# Shares of the trace below which a component counts as having no variance.
_NO_VARIANCE = 1e-13
_EPS = np.finfo(float).eps
_SLICE = 1 << 14


# Spectral divide and conquer


def polar_sign(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, its eigenvalues being -1 and 1.

    An eigenvalue of zero, or one so small that it can't be told from it, stays between the two.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    low = _EPS
    for _ in range(30):
        square = low * low
        turn = (4 * (1 - square) / square**2) ** (1 / 3)
        root = np.sqrt(1 + turn)
        weight = root + np.sqrt(8 - 4 * turn + 8 * (2 - square) / (square * root)) / 2
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.concatenate([np.sqrt(c) * x, np.eye(n)]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (weight + b * square) / (1 + c * square))
        if moved <= 10 * _EPS * np.sqrt(n) and 1 - low <= 10 * _EPS:
            break
    return x


def _halves(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the subspaces above and below the shift; None if it doesn't split."""
    n = len(a)
    sign = polar_sign(a - shift * np.eye(n))
    projector = (sign + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-8 * n:
        return None
    drawn = np.random.default_rng(n).standard_normal((n, rank))
    for _ in range(3):
        drawn, _ = np.linalg.qr(projector @ drawn)
    both, _ = np.linalg.qr(drawn, mode="complete")
    return both[:, :rank], both[:, rank:]


def components(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns."""
    n = len(a)
    wanted = n if wanted is None else min(n, wanted)
    scale = np.linalg.norm(a) if n else 0.0
    found: list[np.ndarray] = []
    # Subspaces still to be split, the one of the largest eigenvalues last.
    todo = [np.eye(n)]
    have = 0
    while todo and have < wanted:
        basis = todo.pop()
        part = basis.T @ a @ basis
        part = (part + part.T) / 2
        m = len(part)
        mean = float(np.trace(part)) / m
        split = None
        if m > 1 and np.linalg.norm(part - mean * np.eye(m)) > 4 * _EPS * scale:
            middle = float(np.median(np.diag(part)))
            split = _halves(part, middle)
            if split is None:
                split = _halves(part, mean)
            if split is None and m > 1:
                # An eigenvalue lies on both shifts: another one between the least and the greatest.
                spread = float(np.diag(part).max() - mean) or np.linalg.norm(part - mean * np.eye(m)) / m
                split = _halves(part, mean + 0.37 * spread)
        if split is None:
            found.append(basis)
            have += m
        else:
            todo += [basis @ split[1], basis @ split[0]]
    vectors = np.concatenate(found, 1) if found else np.zeros((n, 0))
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], vectors[:, order]


# Sums over all vectors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _slices(batches: Iterator[pa.RecordBatch], name: str, width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield _matrix(batch.slice(at, _SLICE).column(name), width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers: of 64 bits where they fit, else of any size."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1)
    if n * most < 1 << 62 and max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``x`` of the rows that take part, all of one length."""
    vector = F.col(vector_col)
    usable = rows.select(F.col(id_col).alias("vec_id"), vector.alias("v")).where(
        F.col("v").isNotNull()
        & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    )
    entry = lambda c: F.greatest(
        F.least(F.floor(STEP * c.cast("double")).cast("double"), F.lit(_BOUND)), F.lit(-_BOUND)
    ).cast("long") + OFFSET
    return usable.select("vec_id", F.transform("v", entry).alias("x"))


def _commonest_length(vectors: DataFrame) -> int:
    sizes = vectors.groupBy(F.size("x").alias("size")).count()
    first = sizes.orderBy(F.desc("count"), "size").first()
    return first["size"] if first else 0


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of their entries; each task sums its own first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for x in _slices(batches, "x", width):
            n += len(x)
            low += (x & 0xFFFFFFFF).sum(0)
            high += (x >> 32).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array([n] * width, pa.int64()), pa.array(low), pa.array(high)],
            names=["at", "n", "low", "high"],
        )

    parts = fit.mapInArrow(partial, "at long, n long, low long, high long")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "low", "high")]
    found = {r["at"]: r for r in parts.groupBy("at").agg(*wide).collect()}
    if not found:
        return 0, [0] * width
    return int(found[0]["n"]), [int(found[i]["low"]) + (int(found[i]["high"]) << 32) for i in range(width)]


def _products(fit: DataFrame, size: int, entries) -> np.ndarray:
    """Sum of the outer products of ``entries(batch of x)``; each task sums its own first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for y in entries(batches):
            total += y.T @ y
        i, j = np.divmod(np.arange(size * size), size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "s"]
        )

    parts = fit.mapInArrow(partial, "i long, j long, s double")
    out = np.zeros((size, size))
    for r in parts.groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return out


def whitened(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = COMPONENTS
) -> DataFrame:
    """For each row that takes part and each of the leading components: vec_id, component, n,
    deviation, whitened, explained, identity_error."""
    vectors = _vectors(rows, id_col, vector_col)
    width = _commonest_length(vectors)
    kind = (
        f"vec_id {rows.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, "
        "whitened double, explained double, identity_error double"
    )
    none = rows.sparkSession.createDataFrame([], kind)
    names = none.columns
    if not width:
        return none
    vectors = vectors.where(F.size("x") == width)
    # Copies of a vector are folded within each task before they are shuffled.
    fit = stage(vectors.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, width)

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for x in _slices(batches, "x", width):
            yield (centred(x, n, sums) / n).astype(float)

    covariance = _products(fit, width, offsets) / n
    trace = float(np.trace(covariance))
    values, axes = components(covariance, wanted)
    some = values > _NO_VARIANCE * trace
    values, axes = values[some], axes[:, some]
    if not len(values):
        return none
    matrix = axes / np.sqrt(values)
    explained = values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for y in offsets(batches):
            yield np.concatenate([y @ matrix, np.ones((len(y), 1))], 1)

    # The last row holds the sums of the whitened entries, which are all but zero.
    found = _products(fit, len(values) + 1, projected) / n
    mean = found[-1, :-1]
    error = float(np.abs(found[:-1, :-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    count = len(values)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                part = batch.slice(at, _SLICE)
                off = centred(_matrix(part.column("x"), width), n, sums)
                size = len(off)
                most = int(np.abs(off).max(initial=0))
                if most * most * width < 1 << 63:
                    far = pa.array((off * off).sum(1))
                else:
                    exact = [sum(int(v) ** 2 for v in row) for row in off]
                    far = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
                repeat = np.repeat(np.arange(size), count)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(repeat)),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                        pa.array(np.full(size * count, n, np.int64)),
                        far.take(pa.array(repeat)),
                        pa.array(((off / n).astype(float) @ matrix).ravel()),
                        pa.array(np.tile(explained, size)),
                        pa.array(np.full(size * count, error)),
                    ],
                    names=names,
                )

    return vectors.mapInArrow(answer, kind)

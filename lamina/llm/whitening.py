"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

A vector's entries become integers x = floor(SCALE * c) + OFFSET, whose sums per dimension are exact. The
matrix X of centred rows x - S/n is never squared and never gathered. Steps alternate two passes over the
rows: one multiplies them with a block of right vectors (Xv) and holds the result against all left vectors so
far, one multiplies the new left vectors with the rows (X'u). Blocks are BLOCK vectors wide, so a table
is read 2 / BLOCK times as often as with single vectors, and eigenvalues that occur up to BLOCK times are found. Left
vectors are as long as the table; each is kept as the combination of columns that makes it, and tasks work
it out again from their rows. Both kinds are orthogonalised against all earlier ones, twice. The singular
value decomposition of the small banded matrix between them gives components and deviations; steps end
when the wanted components' residuals are within TOLERANCE, or the dimensions are used up.

What reaches the driver is sums over rows: at most (dimensions + left vectors) x BLOCK numbers a pass, added up
by a shuffle first. Tasks hold a piece of their rows at a time.

Defined cases: rows go whose vector is null, holds null or non-finite entries or entries of 2^50 or more, or has
another length than most (ties: the longer); null and repeated ids and repeated rows stay; other columns are
ignored. Components whose variance is under RANK of the first one's are rounding and are left out, so equal
vectors, one vector and an empty table have none and give no rows. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.ragged import map_batches
from lamina.session import stage

SCALE, OFFSET = 1024, 100000
COMPONENTS = 8
BLOCK = 8
TOLERANCE = 1e-14
RANK = 1e-12
PIECE_ROWS = 8192
#: Entries from here on are not counted as finite: their x has no exact sum in parts.
LARGEST = 2.0**50
_LOW = 31


@dataclass
class Whitening:
    """``vectors`` are columns; ``variances`` their eigenvalues; ``explained`` their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entries, begin of each list, length of each list, whether all of its entries are finite)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    held = values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~(np.abs(held) < LARGEST)  # null entries are NaN here
    before = np.concatenate([[0], np.cumsum(bad)])
    clean = (before[offsets[1:]] == before[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    return held, offsets[:-1], np.diff(offsets), clean


def _scaled(held: np.ndarray, begin: np.ndarray, width: int) -> np.ndarray:
    """Integer rows x of the lists that begin there."""
    taken = held[begin[:, None] + np.arange(width)]
    return np.floor(SCALE * taken).astype(np.int64) + OFFSET


def _pieces(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(x, rows of the batch that they are, batch) of vectors of ``width``, some at a time."""
    for batch in batches:
        held, begin, size, clean = _lists(batch.column(batch.num_columns - 1))
        own = np.flatnonzero(clean & (size == width))
        step = max(1, min(PIECE_ROWS, (8 << 20) // (8 * max(width, 1))))
        for at in range(0, len(own), step):
            some = own[at : at + step]
            yield _scaled(held, begin[some], width), some, batch


def _vectors(rows: DataFrame, column: str, *others: str) -> DataFrame:
    return rows.select(*others, F.col(column).cast("array<double>").alias("_v"))


def dimension_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(vectors kept, sum of x by dimension), exact; the length that most vectors have decides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many: dict[int, int] = {}
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            held, begin, size, clean = _lists(batch.column(batch.num_columns - 1))
            for width in np.unique(size[clean & (size > 0)]).tolist():
                own = np.flatnonzero(clean & (size == width))
                for at in range(0, len(own), PIECE_ROWS):
                    x = _scaled(held, begin[own[at : at + PIECE_ROWS]], width)
                    parts = sums.setdefault(width, [np.zeros(width, np.int64), np.zeros(width, np.int64)])
                    parts[0] += (x >> _LOW).sum(axis=0)
                    parts[1] += (x & ((1 << _LOW) - 1)).sum(axis=0)
                    many[width] = many.get(width, 0) + len(x)
            if sum(sums) > 1 << 20:  # many lengths
                yield from told(many, sums)
                many, sums = {}, {}
        yield from told(many, sums)

    def told(many: dict, sums: dict) -> Iterator[pa.RecordBatch]:
        for width, (high, low) in sums.items():
            fixed = [pa.array(np.full(width, k)) for k in (width, many[width])]
            made = [fixed[0], pa.array(np.arange(width)), fixed[1], pa.array(high), pa.array(low)]
            yield pa.RecordBatch.from_arrays(made, ["width", "at", "n", "high", "low"])

    parts = map_batches(vectors, run, "width long, at long, n long, high long, low long")
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    summed = stage(parts.groupBy("width", "at").agg(F.sum("n").alias("n"), total("high"), total("low")), "whitening-sums")
    most = summed.where("at = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if most is None:
        return 0, []
    own = summed.where(F.col("width") == most["width"]).orderBy("at").collect()  # one row a dimension
    return most["n"], [(int(r["high"]) << _LOW) + int(r["low"]) for r in own]


def _added(vectors: DataFrame, n: int, sums: list[int], work: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows of what ``work`` makes of pieces of centred rows."""
    width = len(sums)
    shapes = [m.shape for m in work(np.zeros((1, width)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for x, _, _ in _pieces(batches, width):
            own = np.concatenate([m.ravel() for m in work(centred(x, n, sums))])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "v"])

    added = map_batches(vectors, run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(sum(int(np.prod(s)) for s in shapes))
    flat[added.column("at").to_numpy()] = added.column("v").to_numpy()
    out, at = [], 0
    for shape in shapes:
        out.append(flat[at : at + int(np.prod(shape))].reshape(shape))
        at += int(np.prod(shape))
    return out


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n: the whole part of the mean goes off exactly, its fraction as a double."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([s % n / n for s in sums])
    return (x - whole) - part


def _fresh(block: np.ndarray, before: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(orthonormal columns, what makes ``block`` of them) orthogonal to ``before``; directions under rounding go."""
    for _ in range(2):
        block = block - before @ (before.T @ block)
    left, size, right = np.linalg.svd(block, full_matrices=False)
    keep = size > scale
    q = left[:, keep]
    for _ in range(2):
        q = q - before @ (before.T @ q)
        q = np.linalg.qr(q)[0] if q.shape[1] else q
    return q, q.T @ block


def _root(gram: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(r, s) with p = u r and u = p s orthonormal, for columns p of that Gram matrix; directions of norm up to floor go."""
    size, turn = np.linalg.eigh(gram)
    keep = size > floor**2
    root = np.sqrt(size[keep])
    return root[:, None] * turn[:, keep].T, turn[:, keep] / root


def bidiagonalise(
    added: Callable[[Callable], list[np.ndarray]], width: int, wanted: int, block: int, seed: int = 5
) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as columns, singular values falling, sum of squares of X).

    ``added(work)`` sums what ``work`` makes of centred rows. ``v`` holds the right vectors, ``w`` the
    combinations of columns whose images are the left ones, ``z`` the rows' products with the left ones and
    ``band`` the small matrix between them.
    """
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(block, width))))[0]
    w, z, band = np.zeros((width, 0)), np.zeros((width, 0)), np.zeros((0, 0))
    new, squares, found = v, 0.0, None
    while new.shape[1]:
        old, k = w, w.shape[1]
        # Xv, held against all left vectors.
        (over, total) = added(lambda x, o=old, p=new: [(x @ o).T @ (x @ p), np.array((x * x).sum())])
        squares = float(total) if found is None else squares
        floor = 1e-8 * np.sqrt(max(squares, 1e-300))
        made = new - old @ over
        # X'u of what is left, and the second orthogonalisation.
        again, gram, product = added(
            lambda x, o=old, p=made: [(x @ o).T @ (u := x @ p), u.T @ u, x.T @ u]
        )
        over, made = over + again, made - old @ again
        r, s = _root(gram - again.T @ again, floor)
        grown = np.zeros((k + r.shape[0], band.shape[1] + new.shape[1]))
        grown[:k, : band.shape[1]] = band
        grown[:k, band.shape[1] :], grown[k:, band.shape[1] :] = over, r
        band = grown
        w, z = np.hstack([w, made @ s]), np.hstack([z, (product - z @ again) @ s])
        left, sizes, right = np.linalg.svd(band, full_matrices=False)
        found = v @ right.T, sizes
        if not len(sizes):
            break
        beyond = z - v @ (v.T @ z)
        residual = np.linalg.norm(beyond @ left[:, :wanted], axis=0)
        if v.shape[1] >= width or (v.shape[1] > wanted and (residual <= TOLERANCE * sizes[0]).all()):
            break
        new, _ = _fresh(beyond[:, k:] if k < w.shape[1] else beyond, v, floor * 1e-4)
        v = np.hstack([v, new])
    return found[0], found[1], squares


def fit(docs: DataFrame, column: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> Whitening:
    """Mean, components and deviations of all vectors; at least ``components`` wide blocks keep repeated eigenvalues."""
    vectors = _vectors(docs, column)
    n, sums = dimension_sums(vectors)
    none = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0), 0.0)
    if not n:
        return none
    added = lambda work: _added(vectors, n, sums, work)
    turned, sizes, squares = bidiagonalise(added, len(sums), components, max(block, components))
    keep = (np.arange(len(sizes)) < components) & (sizes**2 > RANK * sizes.max(initial=0.0) ** 2)
    if not keep.any():
        return none
    turned, variances = turned[:, keep], sizes[keep] ** 2 / n
    turned = turned * np.where(np.take_along_axis(turned, np.abs(turned).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    scaled = turned / np.sqrt(variances)
    gram, mean = added(lambda x: [(y := x @ scaled).T @ y, y.sum(axis=0)])
    error = np.abs(gram / n - np.outer(mean / n, mean / n) - np.eye(len(variances))).max()
    return Whitening(n, sums, turned, variances, variances / (squares / n), float(error))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond 64 bits."""
    whole = np.array([s // n for s in sums], np.int64)
    part = [s % n for s in sums]
    gap = x - whole
    largest = int(np.abs(gap).max(initial=0)) * n + n
    if largest**2 * x.shape[1] < 2**63:
        return ((gap * n - np.array(part, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((gap.astype(object) * n - np.array(part, object)) ** 2).sum(axis=1)
    return [int(e) if e < 2**63 else None for e in exact]


def whiten(docs: DataFrame, model: Whitening, column: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = _vectors(docs, column, F.col(id_col).alias("_id"))
    kind = rows.schema["_id"].dataType.simpleString()
    shape = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    many = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled = model.vectors / np.sqrt(model.variances)
        for x, own, batch in _pieces(batches, model.width) if many else ():
            rows, size = np.repeat(own, many), len(own) * many
            far = pa.array(deviations(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(own))),
                    pa.array(np.full(size, model.n)),
                    far.take(pa.array(np.repeat(np.arange(len(own)), many))),
                    pa.array((centred(x, model.n, model.sums) @ scaled).ravel()),
                    pa.array(np.tile(model.explained, len(own))),
                    pa.array(np.full(size, model.identity_error)),
                ],
                ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return map_batches(rows, run, shape).withColumnRenamed("_id", id_col)

"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators are hashed byte 4-grams and trigrams of word shapes (case, closing symbol, repetition of
the word before). Each indicator is scaled by the log ratio of its frequency in good and bad texts;
a linear hinge-loss model is then fitted by dual coordinate descent and its margins are turned into
probabilities on rows kept aside. Fitting uses at most ``fit_rows`` labelled rows, half of each
label where both suffice, chosen by a hash of the id; scoring is one scan of all texts.

Defined cases: null and empty texts have no indicators and get the score of the intercept; rows with
a null id or label teach nothing; a doc_id labelled twice counts once, with its lowest label; with one
label or none to learn from, every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.ragged import flat, map_batches, pieces, slice_hashes, words

GRAM_BITS = 16
GRAMS = 1 << GRAM_BITS
SHAPES = 1 << 12
FEATURES = GRAMS + SHAPES
FIT_ROWS = 4000
SMOOTH = 1.0
COST = 1.0
EPOCHS = 20
THRESHOLD = 0.3


@dataclass
class Model:
    """``weights`` apply to unscaled indicators; ``squares`` give the norm of the scaled ones."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def indicators(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram occurrence, in order of the text."""
    n = len(buf)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams = np.zeros(0, np.int64)
    owner = np.zeros(0, np.int64)
    if n >= 4:
        quad = np.ndarray(n - 3, "<u4", buf.tobytes(), strides=(1,))
        inside = text[:-3] == text[3:]
        grams = ((quad * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS))[inside].astype(np.int64)
        owner = text[:-3][inside]
    starts, ends, of = words(buf, offsets)
    if len(starts) < 3:
        return owner, grams
    hashes = slice_hashes(buf, starts, ends)
    first, last = buf[starts], buf[ends - 1]
    upper = lambda b: (b >= 65) & (b <= 90)
    second = np.where(ends - starts > 1, buf[np.minimum(starts + 1, n - 1)], first)
    repeated = np.zeros(len(starts), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    letter = upper(last & 0xDF) | (last >= 0x80)
    shape = upper(first) * 1 + upper(second) * 2 + ~letter * 4 + repeated * 8
    same = of[2:] == of[:-2]
    trigram = GRAMS + shape[:-2] * 256 + shape[1:-1] * 16 + shape[2:]
    both = np.concatenate([owner, of[2:][same]])
    order = np.argsort(both, kind="stable")
    return both[order], np.concatenate([grams, trigram[same]])[order]


def _fitted(rows: list[np.ndarray], labels: np.ndarray, prior: float, seed: int = 11) -> Model:
    """Naive Bayes ratios, dual coordinate descent, then the calibration on every fifth row."""
    good = labels == 1
    seen = [np.full(FEATURES, SMOOTH), np.full(FEATURES, SMOOTH)]
    for own, label in zip(rows, good, strict=True):
        seen[int(label)][own] += 1
    ratio = np.log((seen[1] / (good.sum() + 2 * SMOOTH)) / (seen[0] / ((~good).sum() + 2 * SMOOTH)))
    squares = ratio * ratio
    scale = [np.sqrt(squares[own].sum()) or 1.0 for own in rows]
    values = [(ratio[own] / s).astype(np.float32) for own, s in zip(rows, scale, strict=True)]
    sign = np.where(good, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(rows)) % 5 == 0
    taught = np.flatnonzero(~aside)
    weight, bias, dual = np.zeros(FEATURES), 0.0, np.zeros(len(rows))
    for _ in range(EPOCHS):
        for i in rng.permutation(taught):
            gap = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - gap / 2, 0), COST)  # a row's own product is 1, and 1 for the intercept
            if new != dual[i]:
                step = (new - dual[i]) * sign[i]
                weight[rows[i]] += step * values[i]
                bias += step
                dual[i] = new
    held = np.flatnonzero(aside)
    margins = np.array([weight[rows[i]] @ values[i] + bias for i in held])
    slope, shift = _calibrated(margins, good[held], prior)
    return Model((weight * ratio).astype(np.float32), squares.astype(np.float32), bias, slope, shift)


def _calibrated(margins: np.ndarray, good: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic fit by Newton steps, with rows weighted to the share of label 1 among all labels."""
    share = min(max(good.mean(), 1e-3), 1 - 1e-3)
    weight = np.where(good, prior / share, (1 - prior) / (1 - share))
    aim = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (weight * (p - aim)) + 1e-3 * theta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    text: str = "text",
    id_col: str = "doc_id",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """Fit on at most ``fit_rows`` rows of ``docs`` that ``labels`` marks 0 or 1."""
    marked = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y"))
        .where("_id is not null and _y in (0, 1)")
        .groupBy("_id")
        .agg(F.min("_y").cast("int").alias("_y"))
    )
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if len(counts) == 2:
        few = min(counts.values())
        most = {y: max(fit_rows // 2, fit_rows - few) if n > few else fit_rows // 2 for y, n in counts.items()}
        ordered = [
            marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n) for y, n in sorted(most.items())
        ]
        chosen = F.broadcast(ordered[0].unionAll(ordered[1]))  # at most fit_rows pairs of integers
        rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id")
        kind = rows.schema["_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for piece in pieces(batches, "_text", 4 << 20):
                buf, offsets = flat(piece.column(1))
                owner, feature = indicators(buf, offsets)
                cut = np.searchsorted(owner, np.arange(piece.num_rows + 1))
                own = [np.unique(feature[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                sizes = np.array([len(x) for x in own])
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                    pa.array(np.concatenate([*own, np.zeros(0, np.int64)]), pa.int32()),
                )
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(2), listed], ["_id", "_y", "own"])

        held = map_batches(rows, run, f"_id {kind}, _y int, own array<int>").toArrow()
        held = held.sort_by([("_id", "ascending")]).combine_chunks()
        y = held.column("_y").to_numpy()
        own = [x.values.to_numpy() for x in held.column("own")]  # views of one buffer
        if len(set(y.tolist())) == 2:
            model = _fitted(own, y, prior)
            del own, held, y
            pa.default_memory_pool().release_unused()  # the driver may have little memory and much to do yet
            return model
    flat_ = np.zeros(FEATURES, np.float32)
    known = (counts.get(1, 0) / sum(counts.values())) if counts else 0.5
    return Model(flat_, flat_, 0.0, 1.0, float(np.log(max(known, 1e-9) / max(1 - known, 1e-9))))


def margins(buf: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Margin of each text."""
    owner, feature = indicators(buf, offsets)
    cut = np.searchsorted(owner, np.arange(len(offsets)))
    out = np.full(len(offsets) - 1, model.bias)
    seen = np.zeros(FEATURES, np.float32)
    for i, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            own = feature[a:b]
            seen[own] = 1
            out[i] += seen @ model.weights / (np.sqrt(seen @ model.squares) or 1.0)
            seen[own] = 0
    return out


def score(
    docs: DataFrame,
    model: Model,
    text: str = "text",
    id_col: str = "doc_id",
    threshold: float = THRESHOLD,
    piece_bytes: int = 2 << 20,
) -> DataFrame:
    """(id, score, predicted) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", piece_bytes):
            p = model.probability(margins(*flat(piece.column(1)), model))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(p)], ["_id", "score"])

    scored = map_batches(rows, run, f"_id {kind}, score double")
    return scored.select(
        F.col("_id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, piece_bytes: int = 2 << 20
) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, piece_bytes):
            p = model.probability(margins(*flat(piece.column(at)), model))
            yield piece.filter(pa.array(p >= threshold))

    return map_batches(docs, run, docs.schema)

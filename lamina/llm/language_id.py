"""Language identification by a byte-level convolutional network, trained and applied in numpy.

A window of WINDOW bytes of lower-cased text is embedded byte by byte, filters of several widths
slide over it, each keeps its maximum, and a softmax over the learned languages follows. A text is
cut into windows from end to end; its prediction is the mean of their log-probabilities, weighted by
the bytes they hold. Training uses a sample of at most about ``fit_texts`` texts of each language,
chosen by a hash of the id, with ``fit_windows`` windows spread over each text.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn
from, every text is ``und``; ids may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.ragged import flat, map_batches, pieces

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 10
DEPTH = 8
FIT_TEXTS = 600
FIT_WINDOWS = 4
EPOCHS = 12
BATCH = 128
UNKNOWN = "und"
ROWS = 1024


@dataclass
class Network:
    """Byte embedding, one bank of filters for each width, and the softmax layer."""

    labels: list[str]
    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        n = FILTERS * len(WIDTHS)
        return cls(
            labels,
            rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
            [rng.normal(0, 1 / np.sqrt(w * DEPTH), (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            rng.normal(0, 1 / np.sqrt(n), (n, len(labels))).astype(np.float32),
            np.zeros(len(labels), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.banks, *self.biases, self.out, self.out_bias]

    def pair_tables(self) -> list[list[np.ndarray]]:
        """Answers of each filter to two bytes at once (to one where the width is odd)."""
        made = []
        for bank in self.banks:
            one = [self.embed @ bank[k] for k in range(len(bank))]
            tables = [
                (one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(one) - 1, 2)
            ]
            made.append(tables + ([one[-1]] if len(one) % 2 else []))
        return made

    def features(self, windows: np.ndarray, tables: list[list[np.ndarray]], argmax: bool = False):
        """Rectified maxima of all filters over each window, and where they are."""
        pairs = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        most, where = [], []
        for bank, bias, held in zip(self.banks, self.biases, tables, strict=True):
            width = len(bank)
            n = windows.shape[1] - width + 1
            answer = np.take(held[0], pairs[:, :n], axis=0)
            for k, table in enumerate(held[1:], 1):
                source = pairs if len(table) == 65536 else windows
                answer += np.take(table, source[:, 2 * k : 2 * k + n], axis=0)
            if argmax:
                where.append(answer.argmax(axis=1))
            most.append(np.maximum(answer.max(axis=1) + bias, 0))
        return np.concatenate(most, axis=1), where

    def log_shares(self, features: np.ndarray) -> np.ndarray:
        raw = features @ self.out + self.out_bias
        raw -= raw.max(axis=1, keepdims=True)
        return raw - np.log(np.exp(raw).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        features, where = self.features(windows, self.pair_tables(), argmax=True)
        error = np.exp(self.log_shares(features))
        error[np.arange(len(wanted)), wanted] -= 1
        error /= len(wanted)
        back = (error @ self.out.T) * (features > 0)
        embed = np.zeros_like(self.embed)
        banks, biases = [], []
        rows = np.arange(len(windows))[:, None]
        for i, (bank, at) in enumerate(zip(self.banks, where, strict=True)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(bank)
            for k in range(len(bank)):
                seen = windows[rows, at + k]
                grad[k] = np.einsum("nf,nfd->df", own, self.embed[seen])
                np.add.at(embed, seen, own[:, :, None] * bank[k].T[None])
            banks.append(grad)
            biases.append(own.sum(axis=0))
        return [embed, *banks, *biases, features.T @ error, error.sum(axis=0)]


def train(windows: np.ndarray, wanted: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Adam on class-balanced batches; half of the windows are cut short at random, for short texts."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, rng)
    held = [(np.zeros_like(w), np.zeros_like(w)) for w in net.weights()]
    classes = [np.flatnonzero(wanted == k) for k in range(len(labels))]
    size = windows.shape[1]
    steps = max(1, EPOCHS * len(windows) // BATCH)
    for step in range(1, steps + 1):
        picked = np.concatenate([rng.choice(c, -(-BATCH // len(classes))) for c in classes])
        batch = windows[picked].copy()
        cut = np.where(rng.random(len(batch)) < 0.5, rng.integers(8, size + 1, len(batch)), size)
        batch[np.arange(size)[None] >= cut[:, None]] = 0
        rate = 0.01 * (1 - step / (steps + 1))
        for weight, (mean, power), grad in zip(net.weights(), held, net.gradients(batch, wanted[picked]), strict=True):
            mean += 0.1 * (grad - mean)
            power += 0.001 * (grad * grad - power)
            weight -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """WINDOW bytes from each start, zero beyond the end."""
    at = starts[:, None] + np.arange(WINDOW)[None]
    return np.where(at < ends[:, None], buf[np.minimum(at, max(len(buf) - 1, 0))], 0).astype(np.uint8)


def classify(buf: np.ndarray, offsets: np.ndarray, net: Network, tables: list) -> tuple[np.ndarray, np.ndarray]:
    """(number of the label, mean probability) of each text; all windows of all texts in one run."""
    sizes = np.diff(offsets)
    many = -(-sizes // WINDOW)
    total = np.zeros((len(sizes), len(net.labels)))
    if many.sum():
        text = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        starts, ends = offsets[text] + nth * WINDOW, offsets[text + 1]
        for a in range(0, len(text), ROWS):
            own = slice(a, a + ROWS)
            shares = net.log_shares(net.features(cut_windows(buf, starts[own], ends[own]), tables)[0])
            weight = np.minimum(ends[own] - starts[own], WINDOW)
            np.add.at(total, text[own], shares * weight[:, None])
    mean = total / np.maximum(sizes, 1)[:, None]
    best = mean.argmax(axis=1)
    shares = np.exp(mean - mean.max(axis=1, keepdims=True))
    return best, 1 / shares.sum(axis=1)


def fit(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    id_col: str = "doc_id",
    fit_texts: int = FIT_TEXTS,
    fit_windows: int = FIT_WINDOWS,
) -> Network | None:
    """Train on a bounded sample of the labelled rows of ``docs``; None if there is none."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    rows = rows.where("_lang is not null and length(_text) > 0")
    counts = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    share = F.lit(0.0)
    for name in labels:
        share = F.when(F.col("_lang") == name, F.lit(min(1.0, fit_texts / counts[name]))).otherwise(share)
    place = F.pmod(F.xxhash64("_id", F.length("_text")), F.lit(1 << 30)) / float(1 << 30)
    size = F.length("_text")
    spread = F.transform(
        F.sequence(F.lit(0), F.lit(fit_windows - 1)),
        lambda k: F.substring(
            "_text", (F.greatest(size - WINDOW, F.lit(0)) * k / fit_windows).cast("int") + 1, F.lit(WINDOW)
        ),
    )
    sample = rows.where(place < share).select(
        F.col("_lang"), F.explode(F.array_distinct(F.when(size <= WINDOW, F.array("_text")).otherwise(spread))).alias("w")
    )
    held = sample.select("_lang", F.lower("w").alias("w")).toArrow()
    held = held.combine_chunks().sort_by([("_lang", "ascending"), ("w", "ascending")])
    buf, offsets = flat(held.column("w").combine_chunks())
    wanted = np.searchsorted(labels, held.column("_lang").to_pylist())
    present = sorted(set(wanted.tolist()))
    return train(
        cut_windows(buf, offsets[:-1], offsets[1:]), np.searchsorted(present, wanted), [labels[k] for k in present]
    )


def predict(
    docs: DataFrame, net: Network | None, text: str = "text", id_col: str = "doc_id", piece_bytes: int = 4 << 20
) -> DataFrame:
    """(id, lang_pred, score) of every row."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.lower(F.col(text)).alias("_text"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered"),
    )
    if net is None:
        return rows.select(F.col("_id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.pair_tables()
        names = np.array([*net.labels, UNKNOWN], object)
        for piece in pieces(batches, "_text", piece_bytes):
            buf, offsets = flat(piece.column(1))
            best, score = classify(buf, offsets, net, tables)
            lettered = piece.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(lettered, best, len(net.labels))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(names[best], pa.string()), pa.array(np.where(lettered, score, 0.0))],
                ["_id", "lang_pred", "score"],
            )

    return map_batches(rows, run, f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)

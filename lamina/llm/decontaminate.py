"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, in lower case. A seed is a window of words of which a fixed mask
ignores some positions, so a substituted word spares the seeds that ignore it. MASKS leave a seed in
every stretch of 13 words or more of which MATCHED are equal; items of under 13 words must be held whole,
and have masks of their own length (``masks_for``) that ignore any words that may differ. Seeds of benchmark items go into
a bitmap of ROOM to 2 x ROOM cells a seed, PROBES of them set, which each task holds against all windows of its
documents; windows that may be seeds go on with the words around them, are joined with the items' seeds by hash,
and every hit is verified on its diagonal: the longest stretch with at least ``matched`` equal words must reach
the words that its item asks for (``needed``). The bitmap is a filter only, by which fewer than one in a million
other windows pass. It grows with the benchmark to 2 ** MOST_BITS cells (32 MB), where ROOM holds for 4 million
seeds; with more it fills up and lets more windows through to the join, which decides.

Rows that leave the scan are few, one per stretch of hits; a popular item is one row on the small side
of each join, whose large side Spark may split.

Defined cases: null and empty texts hold nothing; items of under LEAST words are not searched (they
occur by chance); repeated items and ids
give one row per pair of ids; a null id is reported as null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.ragged import U64, flat, map_batches, mix, pieces, slice_hashes, words
from lamina.session import stage

MASKS = ("111001011", "10111011", "110001000111", "111101001")
WHOLE = 13
LEAST = 5
ROOM = 64
PROBES = 6
LEAST_BITS, MOST_BITS = 16, 28
AROUND = 64
MATCHED = 0.8
PIECE_BYTES = 2 << 20

GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_ODD = mix(np.arange(101, 165, dtype=U64)) | U64(1)


def needed(n_words: int) -> int:
    """Words that a stretch must reach: half of the item, 13 at least and 50 at most, or the whole item if shorter."""
    return min(n_words, 50, max(13, -(-n_words // 2)))


def masks_for(n_words: int, matched: float = MATCHED) -> tuple[str, ...]:
    """The masks that search an item of so many words.

    The words inside a short item form two groups more than words may differ; each mask ignores as many
    groups as words may differ.
    """
    if n_words >= WHOLE:
        return MASKS
    spare = min(int(n_words * (1 - matched) + 1e-9), n_words - 2)
    groups = [set(range(1 + g, n_words - 1, spare + 2)) for g in range(spare + 2)]
    ignored = [set().union(*some) for some in combinations(groups, spare)]
    return tuple(sorted({"".join("0" if k in out else "1" for k in range(n_words)) for out in ignored}))


def seed_hashes(w: np.ndarray, of: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every window of ``mask`` that stays in its text."""
    span = len(mask)
    if len(w) < span:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    n = len(w) - span + 1
    h = np.full(n, int("1" + mask, 2), U64) * _ODD[0]
    for k, kept in enumerate(mask):
        if kept == "1":
            h += w[k : k + n] * _ODD[k + 1]
    inside = np.flatnonzero(of[:n] == of[span - 1 : span - 1 + n])
    return inside, mix(h[inside])


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text) of every word, and the first word of each text."""
    buf, offsets = flat(column)
    starts, ends, of = words(buf, offsets, GAP)
    return slice_hashes(buf, starts, ends), of, np.searchsorted(of, np.arange(len(offsets)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    sizes = np.array([len(a) for a in arrays], np.int64)
    held = np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(held))


def item_words(benchmark: DataFrame, text: str, item_col: str, matched: float = MATCHED) -> DataFrame:
    """(_item, _words, _seeds, _at) of every item that is searched."""
    rows = benchmark.select(F.col(item_col).alias("_item"), F.lower(F.col(text)).alias("_text"))
    kind = rows.schema["_item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            w, _, first = _word_hashes(piece.column(1))
            own, seeds, at, keep = [], [], [], []
            for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                if b - a < LEAST:
                    continue
                found = [seed_hashes(w[a:b], np.zeros(b - a), m) for m in masks_for(int(b - a), matched)]
                keep.append(i)
                own.append(w[a:b].view(np.int64))
                at.append(np.concatenate([x for x, _ in found]))
                seeds.append(np.concatenate([h for _, h in found]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(keep, pa.int64())), _lists(own), _lists(seeds), _lists(at)],
                ["_item", "_words", "_seeds", "_at"],
            )

    return stage(
        map_batches(rows, run, f"_item {kind}, _words array<long>, _seeds array<long>, _at array<long>"), "items"
    )


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """PROBES cells for each seed, in 64-bit words; their number, a power of two, follows the benchmark's seeds."""
    distinct = seeds.select("_seed").distinct()
    bits = min(MOST_BITS, max(LEAST_BITS, (distinct.count() * ROOM - 1).bit_length()))
    last = F.lit((1 << bits) - 1).cast("long")
    begin, step = F.shiftrightunsigned("_seed", 64 - bits), F.col("_seed").bitwiseAND(last).bitwiseOR(F.lit(1).cast("long"))
    slots = distinct.select(F.explode(F.array(*[(begin + step * k).bitwiseAND(last) for k in range(PROBES)])).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    cells = slots.groupBy(F.shiftright("slot", 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    held = cells.toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[held.column("cell").to_numpy()] = held.column("bits").to_numpy()
    return out.view(U64)


def may_hold(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes whose cells are all set."""
    last = U64(len(bitmap) * 64 - 1)
    bits = int(last).bit_length()
    at = np.arange(len(h))
    for k in range(PROBES):
        slot = ((h >> U64(64 - bits)) + ((h & last) | U64(1)) * U64(k)) & last
        hit = (bitmap[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1
        at, h = at[hit], h[hit]
    return at


def _stretches(docs: DataFrame, bitmap: np.ndarray, masks: list[str], text: str, id_col: str) -> DataFrame:
    """(_id, _row, _words, _seeds, _at): words around windows that may be seeds."""
    rows = docs.select(F.col(id_col).alias("_id"), F.lower(F.col(text)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            w, of, first = _word_hashes(piece.column(1))
            at, hashes, reach = [], [], []
            for mask in masks:
                place, h = seed_hashes(w, of, mask)
                hit = may_hold(bitmap, h)
                place, h = place[hit], h[hit]
                at.append(place)
                hashes.append(h)
                reach.append(np.full(len(place), len(mask)))
            at, hashes, reach = np.concatenate(at), np.concatenate(hashes), np.concatenate(reach)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, hashes, reach = at[order], hashes[order], reach[order]
            text_of = of[at]
            split = np.flatnonzero((np.diff(at) > AROUND) | (np.diff(text_of) != 0)) + 1
            begin = np.concatenate([[0], split])
            end = np.concatenate([split, [len(at)]])
            owner = text_of[begin]
            a = np.maximum(at[begin] - AROUND, first[owner])
            b = np.minimum(np.maximum.reduceat(at + reach, begin) + AROUND, first[owner + 1])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column(0).take(pa.array(owner)),
                    _lists([w[x:y].view(np.int64) for x, y in zip(a, b, strict=True)]),
                    _lists([hashes[x:y].view(np.int64) for x, y in zip(begin, end, strict=True)]),
                    _lists([at[x:y] - z for x, y, z in zip(begin, end, a, strict=True)]),
                ],
                ["_id", "_words", "_seeds", "_at"],
            )

    found = map_batches(rows, run, f"_id {kind}, _words array<long>, _seeds array<long>, _at array<long>")
    # The key comes from the contents: equal stretches of one document stand for each other.
    return stage(found.withColumn("_row", F.xxhash64("_id", "_words")), "stretches")


def longest(equal: np.ndarray, matched: float = MATCHED) -> tuple[int, int]:
    """(words, equal words) of the longest stretch that begins and ends with an equal word and has enough of them."""
    places = np.flatnonzero(equal)
    if not len(places):
        return 0, 0
    # With score 1 - matched for equal words and -matched for others, enough means a sum of 0 or more.
    sums = np.concatenate([[0.0], np.cumsum(np.where(equal, 1 - matched, -matched))])
    ends = sums[places + 1]
    later = np.maximum.accumulate(ends[::-1])[::-1]
    best, j = (0, 0), 0
    lowest = np.inf
    for i, p in enumerate(places):
        if sums[p] < lowest:  # only a new lowest start can reach farther
            lowest = sums[p]
            j = max(j, i)
            while j + 1 < len(places) and later[j + 1] >= sums[p] - 1e-9:
                j += 1
            size = int(places[j] - p + 1)
            if size > best[0] and ends[j] >= sums[p] - 1e-9:
                best = (size, j - i + 1)
    return best


def overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    item_text: str = "text",
    item_col: str = "item_id",
    matched: float = MATCHED,
) -> DataFrame:
    """(id, item, item_words, overlap_words, matched_words) of every document that holds a benchmark item."""
    items = item_words(benchmark, item_text, item_col, matched)
    items = items.withColumn("_ik", F.xxhash64("_words"))
    pairs = lambda df, *keep: df.select(*keep, F.explode(F.arrays_zip("_seeds", "_at")).alias("_x")).select(
        *keep, F.col("_x._seeds").alias("_seed"), F.col("_x._at").alias("_at")
    )
    item_seeds = pairs(items, "_item", "_ik")
    short = [r["n"] for r in items.select(F.size("_words").alias("n")).where(f"n < {WHOLE}").distinct().collect()]
    masks = [*MASKS, *(m for n in sorted(short) for m in masks_for(n, matched))]
    found = _stretches(docs, _bitmap(item_seeds), masks, text, id_col)
    hits = (
        pairs(found, "_row")
        .join(item_seeds.withColumnRenamed("_at", "_ia"), "_seed")
        .select("_row", "_item", "_ik", (F.col("_at") - F.col("_ia")).alias("_shift"))
        .distinct()
    )
    sides = (
        hits.join(found.select("_row", "_id", "_words").dropDuplicates(["_row"]), "_row")
        .join(items.select("_item", "_ik", F.col("_words").alias("_iw")).dropDuplicates(["_item", "_ik"]), ["_item", "_ik"])
        .select("_id", "_item", "_shift", "_words", "_iw")
    )
    kind, item_kind = sides.schema["_id"].dataType.simpleString(), sides.schema["_item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sizes = [], []
            for i in range(batch.num_rows):
                text_w = batch.column(3)[i].values.to_numpy(zero_copy_only=False)
                item_w = batch.column(4)[i].values.to_numpy(zero_copy_only=False)
                shift = batch.column(2)[i].as_py()
                a, b = max(0, -shift), min(len(item_w), len(text_w) - shift)
                size, equal = longest(item_w[a:b] == text_w[a + shift : b + shift], matched)
                if size >= needed(len(item_w)) or equal >= needed(len(item_w)):
                    keep.append(i)
                    sizes.append((len(item_w), size, equal))
            part = batch.select(["_id", "_item"]).take(pa.array(keep, pa.int64()))
            told = np.array(sizes, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(told[:, k]) for k in range(3))],
                ["_id", "_item", "item_words", "overlap_words", "matched_words"],
            )

    told = map_batches(
        sides, run, f"_id {kind}, _item {item_kind}, item_words long, overlap_words long, matched_words long"
    )
    best = told.groupBy("_id", "_item").agg(
        F.max(F.struct("matched_words", "overlap_words", "item_words")).alias("m")
    )
    return best.select(
        F.col("_id").alias(id_col), F.col("_item").alias(item_col), "m.item_words", "m.overlap_words", "m.matched_words"
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id holds no benchmark item."""
    leaked = overlaps(docs.select(F.col(id_col), F.col(text)), benchmark, text, id_col).select(F.col(id_col).alias("_id"))
    leaked = leaked.distinct()
    return docs.join(leaked, docs[id_col].eqNullSafe(leaked["_id"]), "left_anti").select(docs.columns)

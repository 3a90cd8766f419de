"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A piece of a batch is cut into pre-tokens by array operations on code points; equal pre-tokens are
merged once. All pre-tokens then advance together: a round finds every sequence's lowest-ranked pair
with one segmented minimum, merges all its occurrences from the left, and drops sequences that have
no pair left. What survives is the token count. Pieces hold a few MB, so memory doesn't follow the
size of a partition, and the job is one scan without a shuffle.

Files whose settings this can't follow (a normalizer, another pre-tokenizer, added tokens with flags, prefixes, byte
fallback) are refused. The table of merges is sized by their number.

Defined cases: null and empty texts have no bytes and no tokens; ids may be null or repeated; other
columns are ignored; a text of any length is one piece of its own.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.ragged import flat, map_batches, pieces, slice_hashes

PIECE_BYTES = 4 << 20
NEVER = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE, OTHER, BREAK = 0, 1, 2, 3, 4

#: The code points that the pattern's \\s matches.
SPACE_POINTS = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    table[SPACE_POINTS] = SPACE
    return table


def refusal(held: dict) -> str | None:
    """Why a tokenizer file can't be followed; None where it can."""
    model, cut = held.get("model") or {}, held.get("pre_tokenizer") or {}
    if model.get("type") != "BPE":
        return "its model is not BPE"
    if held.get("normalizer") is not None:
        return "it has a normalizer"
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return "its pre-tokenizer is not the byte-level pattern without a leading space"
    for name in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"):
        if model.get(name):
            return f"its model sets {name}"
    for token in held.get("added_tokens") or ():
        if any(token.get(flag) for flag in ("single_word", "lstrip", "rstrip")):
            return f"added token {token.get('content')!r} has flags"
    if not set(_byte_letters()) <= set(model.get("vocab") or ()):
        return "its vocabulary lacks some bytes"
    return None


class Merges:
    """Ranks and results of all merges, looked up by arrays of symbol pairs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        if why := refusal(held):
            raise ValueError(f"tokenizer file {path}: {why}")
        vocab = held["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        self.specials = sorted((t["content"].encode() for t in held["added_tokens"]), key=len, reverse=True)
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], np.int32)
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = max(10, (4 * len(pairs)).bit_length())  # at most a quarter full
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NEVER, np.int32)
        keys, ranks = (left << 32) | right, np.arange(len(pairs), dtype=np.int32)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] == -1
            chosen = np.unique(np.where(free, slots, -1), return_index=True)
            take = chosen[1][chosen[0] >= 0]
            self.keys[slots[take]], self.ranks[slots[take]] = keys[take], ranks[take]
            rest = np.ones(len(keys), bool)
            rest[take] = False
            keys, ranks, slots = keys[rest], ranks[rest], slots[rest]
            taken = self.keys[slots] != -1
            slots = np.where(taken, (slots + 1) & (size - 1), slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NEVER)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out

    def counts(self, held: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Tokens of each byte sequence of ``held``; sequences follow one another and aren't empty."""
        out = np.zeros(len(starts), np.int64)
        if not len(starts):
            return out
        symbols = self.of_byte[held]
        names = np.arange(len(starts))
        sizes = np.diff(np.append(starts, len(held)))
        last = np.zeros(len(held), bool)
        last[starts[1:] - 1] = True
        last[-1] = True
        ranks = np.full(len(held), NEVER, np.int32)
        inner = np.flatnonzero(~last)
        ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])
        while True:
            starts = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == NEVER
            if done.any():
                out[names[done]] = sizes[done]
                if done.all():
                    return out
                stay = np.repeat(~done, sizes)
                symbols, ranks, last = symbols[stay], ranks[stay], last[stay]
                names, sizes, lowest = names[~done], sizes[~done], lowest[~done]
                starts = np.cumsum(sizes) - sizes
            chosen = ranks == np.repeat(lowest, sizes)
            if (chosen[1:] & chosen[:-1]).any():  # the same symbol thrice or more: pairs from the left
                at = np.arange(len(chosen))
                since = at - np.maximum.accumulate(np.where(chosen, -1, at))
                chosen &= since % 2 == 1
            merged = np.flatnonzero(chosen)
            symbols[merged] = self.made[ranks[merged]]
            last[merged] = last[merged + 1]
            keep = np.ones(len(symbols), bool)
            keep[merged + 1] = False
            sizes = sizes - np.add.reduceat(chosen, starts, dtype=np.int64)
            place = np.cumsum(keep)[merged] - 1
            symbols, ranks, last = symbols[keep], ranks[keep], last[keep]
            begins = np.zeros(len(symbols) + 1, bool)
            begins[np.cumsum(sizes)] = True
            begins[0] = True
            again = np.unique(np.concatenate([place, place[~begins[place]] - 1]))
            inner = again[~last[again]]
            ranks[again] = NEVER
            ranks[inner] = self.rank(symbols[inner], symbols[inner + 1])


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


@lru_cache(2)
def _merges(path: str) -> Merges:
    return Merges(path)


def split_points(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Marks of code points that begin a pre-token; BREAK points stand between texts and begin one too."""
    n = len(codes)
    begins = np.ones(n, bool)
    begins[1:] = kinds[1:] != kinds[:-1]
    begins |= kinds == BREAK
    runs = np.flatnonzero(begins)
    kind = kinds[runs]
    size = np.diff(np.append(runs, n))
    follow = np.append(kind[1:], BREAK)
    # The last space of a run joins what follows if it is U+0020, else it stands alone.
    spaced = (kind == SPACE) & (follow != BREAK)
    ends = runs + size - 1
    begins[ends[spaced]] = True
    joins = np.zeros(n + 1, bool)
    plain = spaced & (codes[ends] == 0x20)
    joins[ends[plain] + 1] = True
    begins[ends[plain] + 1] = False
    # An apostrophe that begins a pre-token takes a known ending from the letters after it.
    tick = np.flatnonzero((kind == OTHER) & (size == 1) & (codes[runs] == 0x27) & (follow == LETTER) & ~joins[runs])
    at = runs[tick]
    long = size[tick + 1]
    one = codes[at + 1]
    two = np.where(long >= 2, codes[np.minimum(at + 2, n - 1)], 0)
    took = np.zeros(len(at), np.int64)
    for ending in reversed(ENDINGS):
        fits = one == ord(ending[0])
        if len(ending) == 2:
            fits &= two == ord(ending[1])
        took[fits] = len(ending)
    got = took > 0
    begins[at[got] + 1] = False
    rest = got & (long > took)
    begins[at[rest] + 1 + took[rest]] = True
    return begins


def count_piece(buf: np.ndarray, offsets: np.ndarray, merges: Merges) -> np.ndarray:
    """Tokens of each text of a piece."""
    out = np.zeros(len(offsets) - 1, np.int64)
    if not len(buf):
        return out
    whole = buf.tobytes()
    codes = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    byte_at = np.cumsum(width) - width
    kinds = _classes()[codes]
    # Texts and added tokens are split apart before the pattern runs.
    cuts = np.zeros(len(codes) + 1, bool)
    cuts[np.searchsorted(byte_at, offsets)] = True
    special = np.zeros(len(codes), bool)
    for name in merges.specials:
        at = whole.find(name)
        while at >= 0:
            end = at + len(name)
            text = np.searchsorted(offsets, at, "right") - 1
            a, b = np.searchsorted(byte_at, (at, end))
            if end <= offsets[text + 1] and not special[a:b].any():
                special[a:b] = True
                cuts[a] = cuts[b] = True
                out[text] += 1
                at = whole.find(name, end)
            else:
                at = whole.find(name, at + 1)
    inner = np.flatnonzero(cuts[:-1])
    at = inner + np.arange(len(inner))
    spread_codes = np.insert(codes, inner, 0)
    spread_kinds = np.insert(kinds, inner, BREAK)
    begins = split_points(spread_codes, spread_kinds)
    begins = np.delete(begins, at)
    begins[inner] = True
    if special.any():
        starts = np.flatnonzero(begins)
        starts = starts[~special[starts]]
        ends = np.append(np.flatnonzero(begins), len(codes))
        ends = ends[np.searchsorted(ends, starts, "right")]
    else:
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(codes))
    edges = np.append(byte_at, len(buf))
    starts, ends = edges[starts], edges[ends]
    text = np.searchsorted(offsets, starts, "right") - 1
    np.add.at(out, text, _distinct_counts(buf, starts, ends, merges))
    return out


def _distinct_counts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, merges: Merges) -> np.ndarray:
    """Tokens of each slice, working out equal slices once (found by hash, then compared byte by byte)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashes = slice_hashes(buf, starts, ends)
    _, first, name = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends - starts
    like = first[name]
    same = sizes == sizes[like]
    long = np.where(same, sizes, 0)
    at = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    equal = buf[at + np.repeat(starts, long)] == buf[at + np.repeat(starts[like], long)]
    if not equal.all():
        owner = np.repeat(np.arange(len(starts)), long)
        same[owner[~equal]] = False
    own = np.concatenate([first, np.flatnonzero(~same)])
    place = name.copy()
    place[~same] = len(first) + np.arange(int((~same).sum()))
    long = sizes[own]
    begin = np.cumsum(long) - long
    at = np.arange(int(long.sum())) - np.repeat(begin, long) + np.repeat(starts[own], long)
    return merges.counts(buf[at], begin)[place]


def token_counts(
    docs: DataFrame, path: str, limit: int, text: str = "text", id_col: str = "doc_id", piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, for the vocabulary file at ``path``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(path)
        for piece in pieces(batches, "_text", piece_bytes):
            buf, offsets = flat(piece.column(1))
            tokens = count_piece(buf, offsets, merges)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.diff(offsets)), pa.array(tokens)], ["_id", "n_bytes", "n_tokens"]
            )

    counted = map_batches(rows, run, f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )

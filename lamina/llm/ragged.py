"""Ragged numpy views of Arrow text columns: many texts as one byte array with offsets."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where this package lies; Python workers on the same machine need not have it installed.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

U64 = np.uint64
_MIX1, _MIX2, _STEP = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers also look for packages beside this one."""
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, HOME])
    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _STEP)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins (one more offset than texts); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        offsets = flat(batch.column(batch.schema.get_field_index(text)))[1]
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of the text) of every maximal run of bytes outside ``gap``."""
    n = len(buf)
    inside = ~gap[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after = np.ones(n, bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:n]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def slice_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte slice; slices are ordered, not empty and don't overlap."""
    if not len(starts):
        return np.zeros(0, U64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    if total == len(buf):
        held, at = buf, np.arange(total) - np.repeat(first, sizes)
    else:
        shift = np.repeat(starts - first, sizes)
        held = buf[np.arange(total) + shift]
        at = np.arange(total) - np.repeat(first, sizes)
    power = np.cumprod(np.full(int(sizes.max()), _STEP, U64))
    return mix(np.add.reduceat(_BYTE[held] * power[at], first) + sizes.astype(U64) * _MIX2)

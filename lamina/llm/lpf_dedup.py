"""Repeated byte strings across documents, by longest-previous-factor arrays of candidate windows.

Every byte covered by a LEAST-byte string that also starts earlier (in a document of smaller id, or
earlier in the same one) is removed; strings are judged on the input.

1. Anchors. Of every LEAST-byte string, the GRAM-byte piece of least hash is its anchor, so equal
   strings have equal anchors at equal distance. The strings that share one anchor place form a
   window, about one for 35 bytes. Windows leave the scan packed by numbers, in buckets of their anchor.
2. In a bucket, windows of equal contents are one class: all but its first are covered whole. Classes
   that share an anchor with another one may still share strings; their first windows go on.
3. These windows are gathered by anchor, their suffixes are sorted, and the longest previous factor of
   each suffix follows from its previous and next smaller positions in suffix order. A factor of
   LEAST bytes or more covers.
4. Covered stretches meet their texts, which are joined by id.

Equal windows of a piece of a batch are settled in place, so a passage in a third of all documents
reaches a bucket once for each piece. Anchors with more than GROUP classes are dealt to several
groups; strings that are first in theirs meet again by their own hash. No window is dropped.

Classes are told by 64-bit hashes of whole windows beside the anchor's 40 bits.

Defined cases: null and empty texts have no bytes; rows of a null id come after all others; rows that
repeat an id and a text are one document for the order, and each gets its result; other columns are
ignored. Ids are integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.ragged import U64, flat, map_batches, mix, pieces
from lamina.session import stage

LEAST = 100
GRAM = 24
SPAN = LEAST - GRAM + 1
PIECE_BYTES = 2 << 20
SEGMENT = 1 << 22
GROUP = 40000
SUFFIXES = 200000
CHUNK = 4096
NO_ID = 2**63 - 1
_PLACE = U64((1 << 24) - 1)
_C = mix(np.arange(1, 9, dtype=U64)) | U64(1)
_LETTER = mix(np.arange(1000, 1256, dtype=U64))
_BASE = int(_C[3])


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def windows(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor hash, contents hash, text, first start, strings, distance of the anchor) of every window."""
    parts = []
    for a in range(0, len(buf) - LEAST + 1, SEGMENT):
        parts.append(_segment_windows(buf[a : a + SEGMENT + LEAST - 1], offsets - a, a))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(U64), none.astype(U64), none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segment_windows(buf: np.ndarray, offsets: np.ndarray, shift: int) -> tuple[np.ndarray, ...]:
    raw = buf.tobytes()
    n = len(buf) - GRAM + 1
    eight = np.ndarray(len(buf) - 7, "<u8", raw, strides=(1,))
    grams = mix(eight[:n] * _C[0] + mix(eight[8 : 8 + n] + _C[1]) + eight[16 : 16 + n] * _C[2])
    # The place in the low bits makes ties fall to the left and names the least gram.
    low = (grams & ~_PLACE) | np.arange(n, dtype=U64)
    size = 1
    while size * 2 <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: size - SPAN], low[SPAN - size :])
    anchor = (low & _PLACE).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(len(anchor)), "right") - 1
    fits = np.arange(len(anchor)) + LEAST <= offsets[text + 1]
    begins = np.ones(len(anchor), bool)
    begins[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(begins)
    held = np.add.reduceat(fits, starts, dtype=np.int64)  # strings that fit come first in their run
    starts, held = starts[held > 0], held[held > 0]
    ends = starts + held - 1 + LEAST
    power = _powers(len(buf) + 1, _BASE)
    unpower = _powers(len(buf) + 1, pow(_BASE, -1, 1 << 64))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(_LETTER[buf] * power[:-1], dtype=U64)])
    away = anchor[starts] - starts
    contents = mix((sums[ends] - sums[starts]) * unpower[starts] + ((away << 8) | held).astype(U64) * _C[4])
    return grams[anchor[starts]], contents, text[starts], starts + shift, held, away


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, byte by byte, compressed."""
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(count, 8, -1)
    return [np.ascontiguousarray(raw[k].T).view(np.int64).ravel() for k in range(count)]


def _joined(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals [a, b) of ascending (key, a), joined where they touch."""
    if not len(a):
        return a, b, key
    reach = np.empty(len(b), np.int64)
    fresh = np.ones(len(a), bool)
    fresh[1:] = key[1:] != key[:-1]
    # Ends as far as seen, within a key: keys are lifted apart so that one running maximum will do.
    lift = np.cumsum(fresh) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift) - lift
    fresh[1:] |= a[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    return a[at], np.maximum.reduceat(b, at), key[at]


def _keyed(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, _doc, _tie, _text): id as given, id for the order, and a few bits that tell texts of one id apart."""
    return docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_doc"),
        F.coalesce(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 16)), F.lit(0)).cast("long").alias("_tie"),
        F.col(text).alias("_text"),
    )


def _place(tie: np.ndarray, start: np.ndarray, away: np.ndarray, held: np.ndarray) -> np.ndarray:
    """One number that orders windows inside a document id: tie 16 bits, start 33, distance 7, strings 7."""
    return (tie << 47) | (start << 14) | (away << 7) | held


def _unplace(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 47, (place >> 14) & ((1 << 33) - 1), (place >> 7) & 127, place & 127


def _class_starts(*keys: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(keys[0]), bool)
    if len(fresh):
        fresh[1:] = False
        for k in keys:
            fresh[1:] |= k[1:] != k[:-1]
    return fresh


def _packed_windows(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, blob): windows by anchor; buckets beyond ``buckets`` hold what is covered already, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            doc, tie = piece.column(1).to_numpy(), piece.column(2).to_numpy()
            anchor, contents, text, start, held, away = windows(*flat(piece.column(3)))
            if not len(anchor):
                continue
            place = _place(tie[text], start - flat(piece.column(3))[1][text], away, held)
            order = np.lexsort((place, doc[text], contents, anchor))
            anchor, contents, place, owner = anchor[order], contents[order], place[order], doc[text[order]]
            fresh = _class_starts(anchor, contents)
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            again = ~fresh & ((owner != owner[first]) | (place != place[first]))
            out = []
            bucket = (mix(anchor) % U64(buckets)).astype(np.int64)
            keep = np.flatnonzero(fresh)
            keep = keep[np.argsort(bucket[keep], kind="stable")]
            cut = np.searchsorted(bucket[keep], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cut)):
                own = keep[cut[k] : cut[k + 1]]
                out.append((int(k), _pack([anchor[own].view(np.int64), contents[own].view(np.int64), owner[own], place[own]])))
            if again.any():
                tied, a, _, n = _unplace(place[again])
                who = owner[again]
                by = np.lexsort((a, tied, who))
                who, tied, a, b = who[by], tied[by], a[by], (a + n - 1 + LEAST)[by]
                name = np.cumsum(_class_starts(who, tied))
                a, b, name2 = _joined(a, b, name)
                at = np.searchsorted(name, name2)
                who, tied = who[at], tied[at]
                bucket = buckets + (mix(who.astype(U64)) % U64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                values, begin = np.unique(bucket[by], return_index=True)
                for k, own in zip(values, np.split(by, begin[1:]), strict=True):
                    out.append((int(k), _pack([who[own], tied[own], a[own], b[own]])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())],
                ["bucket", "blob"],
            )

    return map_batches(rows, run, "bucket long, blob binary")


FOUND = "_doc long, _tie long, a long, b long, anchor long, classes long"


def _settled(packed: DataFrame, buckets: int) -> DataFrame:
    """FOUND: covered stretches [a, b), and first windows (anchor set, a their place) of classes with company."""

    def settle(bucket: int, blobs: list[bytes]) -> pa.RecordBatch:
        one, two, three, four = (np.concatenate(x) for x in zip(*(_unpack(b, 4) for b in blobs), strict=True))
        if bucket >= buckets:
            none = pa.nulls(len(one), pa.int64())
            return pa.RecordBatch.from_arrays(
                [*(pa.array(x) for x in (one, two, three, four)), none, none], FOUND.replace(" long", "").split(", ")
            )
        order = np.lexsort((four, three, two, one))
        anchor, contents, owner, place = one[order], two[order], three[order], four[order]
        fresh = _class_starts(anchor, contents)
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        again = np.flatnonzero(~fresh & ((owner != owner[first]) | (place != place[first])))
        tied, a, _, n = _unplace(place[again])
        heads = np.flatnonzero(fresh)
        group = _class_starts(anchor[heads])
        many = np.diff(np.append(np.flatnonzero(group), len(heads)))
        count = np.repeat(many, many)
        open_ = heads[count > 1]
        empty = np.zeros(len(again), bool)
        mask = np.concatenate([~empty, np.zeros(len(open_), bool)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([owner[again], owner[open_]])),
                pa.array(np.concatenate([tied, place[open_] >> 47])),
                pa.array(np.concatenate([a, place[open_]])),
                pa.array(np.concatenate([a + n - 1 + LEAST, np.zeros(len(open_), np.int64)])),
                pa.array(np.concatenate([np.zeros(len(again), np.int64), anchor[open_]]), mask=mask),
                pa.array(np.concatenate([np.zeros(len(again), np.int64), count[count > 1]]), mask=mask),
            ],
            FOUND.replace(" long", "").split(", "),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now and held:
                    yield settle(now, held)
                    held = []
                now = bucket
                held.append(blob.as_py())
        if held:
            yield settle(now, held)

    gathered = packed.repartition("bucket").sortWithinPartitions("bucket")
    return stage(map_batches(gathered, run, FOUND), "repeats")


def longest_previous(order: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix, by suffix rank.

    ``order`` has the positions of suffixes in suffix order, ``lcp`` the common prefix of each with the
    one before. A suffix whose position is above both neighbours' has its previous and next smaller
    positions beside it: its factor is the longer common prefix, and without it its neighbours share the
    shorter one. All such peaks are taken at once, until none is left.
    """
    out = np.zeros(len(order), np.int64)
    names = np.arange(len(order))
    while len(names):
        left = np.concatenate([[-1], order[:-1]])
        right = np.concatenate([order[1:], [-1]])
        after = np.concatenate([lcp[1:], [0]])
        peak = (order > left) & (order > right)
        out[names[peak]] = np.maximum(lcp[peak], after[peak])
        kept = np.flatnonzero(~peak)
        # Peaks aren't neighbours, so at most one goes between two that stay.
        gone = np.zeros(len(names), bool)
        gone[1:] = peak[:-1]
        joined = np.where(gone, np.minimum(lcp, np.concatenate([[0], lcp[:-1]])), lcp)
        names, order, lcp = names[kept], order[kept], joined[kept]
    return out


def _covered_strings(buf: np.ndarray, at: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the string at each place of ``buf`` has an earlier equal one in its group; ``order`` ranks them all."""
    raw = np.concatenate([buf, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray(len(buf), ">u8", raw, strides=(1,))
    steps = [*range(0, LEAST - 7, 8), LEAST - 8]
    keys = [eight[at + s].astype(U64) for s in steps]
    # Ties in the text fall in a scrambled order, which keeps the peaks many.
    suffix = np.lexsort((mix(order.astype(U64)), *reversed(keys), group))
    lcp = np.zeros(len(at), np.int64)
    open_ = np.arange(1, len(at))
    open_ = open_[group[suffix[1:]] == group[suffix[:-1]]]
    for k, s in enumerate(steps):
        differ = keys[k][suffix[open_]] ^ keys[k][suffix[open_ - 1]]
        some = differ != 0
        shared = np.zeros(int(some.sum()), np.int64)
        for byte in range(1, 8):
            shared += (differ[some] >> U64(64 - 8 * byte)) == 0
        lcp[open_[some]] = s + shared
        open_ = open_[~some]
    lcp[open_] = LEAST
    out = np.zeros(len(at), bool)
    out[suffix] = longest_previous(order[suffix], lcp) >= LEAST
    return out


TOLD = "_doc long, _tie long, a long, b long, k1 long, k2 long"


def _compared(found: DataFrame, rows: DataFrame) -> DataFrame:
    """TOLD: covered stretches; and, with hashes k1 and k2, strings that are first in one of several groups of an anchor."""
    firsts = found.where("anchor is not null").groupBy("_doc", "_tie").agg(
        F.collect_list(F.struct("a", "anchor", "classes")).alias("_w")  # bounded by the text
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            buf, offsets = flat(piece.column(2))
            listed = piece.column(3)
            many = np.diff(listed.offsets.to_numpy()).astype(np.int64)
            own = listed.flatten()
            place, anchor, classes = (own.field(k).to_numpy() for k in range(3))
            text = np.repeat(np.arange(piece.num_rows), many)
            _, start, _, n = _unplace(place)
            a = offsets[text] + start
            size = n - 1 + LEAST
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
            ends = np.concatenate([[0], np.cumsum(size)])
            held = pa.Array.from_buffers(
                pa.binary(), len(place), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(buf[at])]
            )
            parts = -(-classes // GROUP)
            part = (mix(place.astype(U64) ^ mix(piece.column(0).to_numpy()[text].astype(U64))) % parts.astype(U64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor), pa.array(part), pa.array(parts),
                    piece.column(0).take(pa.array(text)), pa.array(place), held,
                ],
                ["anchor", "part", "parts", "_doc", "place", "bytes"],
            )

    joined = rows.select("_doc", "_tie", "_text").join(firsts, ["_doc", "_tie"]).select("_doc", "_tie", "_text", "_w")
    spread = map_batches(joined, cut, "anchor long, part long, parts long, _doc long, place long, bytes binary")

    def told(doc, tie, a, b, k1=None, k2=None) -> pa.RecordBatch:
        none = pa.nulls(len(doc), pa.int64())
        keys = [none, none] if k1 is None else [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64))]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(x) for x in (doc, tie, a, b)), *keys], TOLD.replace(" long", "").split(", ")
        )

    def judge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor, part, parts, doc, place = (table.column(k).to_numpy() for k in range(5))
        group = np.cumsum(_class_starts(anchor, part))
        held = table.column(5).combine_chunks()
        held = held.chunk(0) if isinstance(held, pa.ChunkedArray) else held
        ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        buf = np.frombuffer(held.buffers()[2], np.uint8)
        tie, start, away, n = _unplace(place)
        window = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        at, where = ends[window] + nth, start[window] + nth
        order = np.empty(len(at), np.int64)
        order[np.lexsort((where, tie[window], doc[window]))] = np.arange(len(at))
        # Equal strings lie equally far from their anchor, so distances are sorted apart, some at a time.
        covered = np.zeros(len(at), bool)
        distance = away[window] - nth
        slices = -(-len(at) // SUFFIXES)
        for k in range(slices):
            own = np.flatnonzero(distance % slices == k)
            covered[own] = _covered_strings(buf, at[own], group[window[own]], order[own])
        hit = np.flatnonzero(covered)
        if len(hit):
            a, b, own = _joined(where[hit], where[hit] + LEAST, window[hit])
            yield told(doc[own], tie[own], a, b)
        left = np.flatnonzero(~covered & (parts[window] > 1))
        if len(left):
            eight = np.ndarray(len(buf) - 7, "<u8", buf.tobytes(), strides=(1,))
            k1, k2 = np.zeros(len(left), U64), np.zeros(len(left), U64)
            for s in [*range(0, LEAST - 7, 8), LEAST - 8]:
                k1, k2 = mix(k1 + eight[at[left] + s] + _C[5]), mix(k2 * _C[6] + (eight[at[left] + s] ^ _C[7]))
            own = window[left]
            yield told(doc[own], tie[own], where[left], where[left] + LEAST, k1, k2)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held < CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            fresh = np.flatnonzero(_class_starts(table.column(0).to_numpy(), table.column(1).to_numpy()))
            cuts = [0]
            for f in [*fresh[1:], None]:
                if f is not None and f - cuts[-1] >= CHUNK:
                    cuts.append(int(f))
            end = int(fresh[-1])  # the last group may go on
            if end > 0:
                edges = [c for c in cuts if c < end] + [end]
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    yield from judge(table.slice(x, y - x))
            rest = table.slice(end)
            held, rows_held = rest.to_batches(), rest.num_rows
        if held:
            yield from judge(pa.Table.from_batches(held))

    grouped = spread.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return map_batches(grouped, compare, TOLD)


def repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, stretches): keyed rows, and covered stretches (_doc, _tie, a, b) in bytes, which may overlap."""
    rows = _keyed(docs, text, id_col)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = _settled(_packed_windows(rows, buckets), buckets)
    told = stage(_compared(found, rows), "compared")
    again = told.where("k1 is not null")
    least = again.groupBy("k1", "k2").agg(F.min(F.struct("_doc", "_tie", "a")).alias("m"))
    later = again.join(least, ["k1", "k2"]).where(F.struct("_doc", "_tie", "a") != F.col("m"))
    columns = ["_doc", "_tie", "a", "b"]
    covered = (
        found.where("anchor is null").select(columns)
        .unionAll(told.where("k1 is null").select(columns))
        .unionAll(later.select(columns))
    )
    return rows, covered


def remove(docs: DataFrame, text: str = "text", id_col: str = "doc_id", kept_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, and with ``kept_bytes`` the bytes that stay."""
    rows, covered = repeats(docs, text, id_col)
    lists = covered.groupBy("_doc", "_tie").agg(F.collect_list(F.struct("a", "b")).alias("_s"))  # bounded by the text
    joined = rows.join(lists, ["_doc", "_tie"], "left").select("_id", "_text", "_s")
    kind = joined.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" if kept_bytes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            buf, offsets = flat(piece.column(1))
            listed = piece.column(2).fill_null([]) if piece.column(2).null_count else piece.column(2)
            own = listed.flatten()
            a_all, b_all = own.field(0).to_numpy(), own.field(1).to_numpy()
            cut = np.concatenate([[0], np.cumsum(np.diff(listed.offsets.to_numpy()))]).astype(np.int64)
            removed, spans, digests, kept = [], [], [], []
            for i in range(piece.num_rows):
                mine = buf[offsets[i] : offsets[i + 1]]
                a, b = a_all[cut[i] : cut[i + 1]], b_all[cut[i] : cut[i + 1]]
                if len(a):
                    by = np.argsort(a, kind="stable")
                    a, b, _ = _joined(a[by], b[by], np.zeros(len(a), np.int64))
                    stay = np.ones(len(mine), bool)
                    for x, y in zip(a, b, strict=True):
                        stay[x:y] = False
                    mine = mine[stay]
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                digests.append(hashlib.sha256(mine.tobytes()).hexdigest())
                if kept_bytes:
                    kept.append(mine.tobytes())
            columns = [
                piece.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(digests, pa.string()),
            ]
            names = ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if kept_bytes:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return map_batches(joined, run, schema).withColumnRenamed("_id", id_col)

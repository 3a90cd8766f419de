"""Near-duplicate documents by order MinHash, verified by banded alignment.

A k-mer is SHINGLE words, labelled with its occurrence number in the text, so k-mers of a text are
distinct. A sketch keeps the SAMPLE k-mers of least hash and hashes them in text order: texts agree
on a sketch when they share these k-mers in the same order. Texts that agree on a sketch share a
bucket.

Two texts are linked when the longest chain of common labelled k-mers that keeps their order, inside
the band of shifts that the threshold allows, is at least ``threshold`` of their union. As labelled
k-mers are distinct, the chain is a longest increasing run of positions.

1. Equal word sequences are collapsed to their least id.
2. In every bucket all members are compared with the least one; links give components.
3. Buckets that hold several components are looked at again. Where at most BUCKET texts share a bucket,
   members of different components are compared. Fuller buckets are first split by a second sketch, which parts texts that share a passage; a text is listed under a pair of sketches only where both lie in such buckets, as
   texts that share the pair share both buckets. Parts still full are families of copies that differ
   pairwise. Their k-mers are counted over the families, and each text is also listed under its rarest
   ones: as many as leave too few others for a link, so linked texts meet there. In every part and under every
   k-mer, members are compared with the most central one, which joins most of a family.
4. Under every such k-mer all members that are still in different components are compared with one
   another, except where sizes and the k-mers that follow in the order are too few for a link.
5. Links of all rounds give the classes.
So a passage in a third of all texts, or thousands of copies of one text, cost a few rows for each
member. A family whose texts are linked with few others costs up to all pairs of texts that share a rarest
k-mer. Pairs are first held against their sketches (two equal ones at least) and their sizes;
texts of candidates are read once. No bucket, chain or group is cut off. At similarity 0.8 a pair
misses all buckets, or agrees on a single sketch, with probability 1e-5; and one that meets in full
buckets only misses their parts with probability 1e-3 (less the more alike, and only where no chain of
other links joins the two).

Defined cases: a text without words is alone in its class; a null id has a null class; a repeated id or
row gives a row each time; texts under SHINGLE words are one k-mer; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.components import components
from lamina.llm.ragged import U64, flat, map_batches, mix, pieces, slice_hashes, words
from lamina.session import stage

SHINGLE = 5
SAMPLE = 3
SKETCHES = 20
THRESHOLD = 0.8
BUCKET = 8
NEXT = 2
TEAM = 5
PIECE_BYTES = 1 << 20
_ODD = mix(np.arange(1, 65, dtype=U64)) | U64(1)
_TOP = U64(2**64 - 1)


def labelled_kmers(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of labelled k-mers in text order, k-mers of each text, two hashes of each word sequence)."""
    texts = len(offsets) - 1
    starts, ends, of = words(buf, offsets)
    w = slice_hashes(buf, starts, ends)
    n = np.bincount(of, minlength=texts) if len(of) else np.zeros(texts, np.int64)
    first = np.cumsum(n) - n
    many = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    whole = np.zeros((texts, 2), U64)
    if not len(w):
        return np.zeros(0, U64), many, whole
    at = np.arange(len(w)) - np.repeat(first, n)
    own = n > 0
    power = mix(at.astype(U64) + U64(7)) | U64(1)
    whole[own, 0] = mix(np.add.reduceat(w * power, first[own]))
    whole[own, 1] = mix(np.add.reduceat(mix(w ^ U64(0x5851F42D4C957F2D)) * power, first[own]))
    padded = np.concatenate([w, np.zeros(SHINGLE, U64)])
    at_kmer = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin = np.repeat(first, many) + at_kmer
    short = np.repeat(np.where(n < SHINGLE, n, SHINGLE), many)
    kmers = np.zeros(len(begin), U64)
    for k in range(SHINGLE):
        kmers += np.where(k < short, padded[begin + k], U64(0)) * _ODD[k]
    kmers = mix(kmers)
    # Occurrence numbers: equal k-mers of a text in order.
    owner = np.repeat(np.arange(texts), many)
    tagged = kmers ^ mix(owner.astype(U64))
    order = np.argsort(tagged, kind="stable")
    ranked = tagged[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    if not fresh.all():
        since = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        count = np.zeros(len(order), np.int64)
        count[order] = since
        kmers = np.where(count > 0, mix(kmers + count.astype(U64) * _ODD[9]), kmers)
    return kmers, many, whole


def sketches(kmers: np.ndarray, many: np.ndarray) -> np.ndarray:
    """SKETCHES order sketches of each text (zero for texts without words)."""
    out = np.zeros((len(many), SKETCHES), U64)
    own = np.flatnonzero(many > 0)
    if not len(own):
        return out
    sizes = many[own]
    first = np.cumsum(sizes) - sizes
    index = np.arange(len(kmers))
    for j in range(SKETCHES):
        v = (kmers ^ _ODD[10 + j]) * _ODD[32 + j]
        v ^= v >> U64(29)
        places = np.zeros((SAMPLE, len(own)), np.int64)
        for s in range(SAMPLE):
            least = np.minimum.reduceat(v, first)
            hit = np.flatnonzero(v == np.repeat(least, sizes))
            segment = np.searchsorted(first, hit, "right") - 1
            places[s, segment[::-1]] = hit[::-1]
            v[hit] = _TOP
        places.sort(axis=0)
        sketch = np.full(len(own), _ODD[j], U64)
        for s in range(SAMPLE):
            held = np.where(sizes > s, kmers[index[places[s]]], U64(0))
            sketch = mix(sketch * _ODD[31] + held)
        out[own, j] = sketch
    return out


def chain(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two texts of labelled k-mers are linked."""
    if not len(a) or not len(b):
        return False
    enough = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < enough - 1e-9:
        return False
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = len(a) + len(b) - 2 * enough
    near = np.abs(in_a - in_b) <= band
    order = np.argsort(in_a[near])
    places = in_b[near][order]
    if len(places) < enough - 1e-9:
        return False
    if (np.diff(places) > 0).all():
        return True
    tails: list[int] = []
    for p in places.tolist():
        at = bisect_left(tails, p)
        if at == len(tails):
            tails.append(p)
        else:
            tails[at] = p
    return len(tails) >= enough - 1e-9


def sketched(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_id, _k1, _k2, _n, _s) of every row; staged, so that texts are sketched once."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            kmers, many, whole = labelled_kmers(*flat(piece.column(1)))
            made = sketches(kmers, many).view(np.int64)
            listed = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), SKETCHES).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(whole[:, 0].view(np.int64)), pa.array(whole[:, 1].view(np.int64)), pa.array(many), listed],
                ["_id", "_k1", "_k2", "_n", "_s"],
            )

    return stage(map_batches(rows, run, f"_id {kind}, _k1 long, _k2 long, _n long, _s array<long>"), "sketches")


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sizes allow a link and that agree on two sketches."""
    side = lambda x: nodes.select(F.col("_id").alias(x), F.col("_s").alias(f"_s{x}"), F.col("_n").alias(f"_n{x}"))
    equal = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda same: same))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb"))
        .where(equal >= 2)
        .select("a", "b")
    )


def _told(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, _ta, _tb) of pairs (a, b)."""
    return (
        pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("_ta")), "a")
        .join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("_tb")), "b")
        .select("a", "b", "_ta", "_tb")
    )


def _kmer_pairs(piece: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    left, n_left, _ = labelled_kmers(*flat(piece.column(2)))
    right, n_right, _ = labelled_kmers(*flat(piece.column(3)))
    for x, n, y, m in zip(np.cumsum(n_left), n_left, np.cumsum(n_right), n_right, strict=True):
        yield left[x - n : x], right[y - m : y]


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are linked."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_ta", PIECE_BYTES):
            linked = [chain(x, y, threshold) for x, y in _kmer_pairs(piece)]
            yield piece.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    told = _told(_likely(pairs, nodes, threshold), texts)
    return stage(map_batches(told, run, f"a {kind}, b {kind}"), "verified")


def _families(parts: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """For parts (_key, _id): pairs (a, b) with central members, and (_key, _id, _n, _left) of rarest k-mers.

    A k-mer's count is the number of family members that have it; the most central member of a group
    is the one whose k-mers have the highest mean count. Linked texts share at least threshold of
    the k-mers of each, so with all k-mers ordered by count they share one of the first
    n - ceil(threshold * n) + 1 of each; those that no other member has are left out after counting.
    _left counts the text's k-mers from this one on in that order.
    """
    ids = parts.select("_id").distinct()
    rows = texts.join(ids, "_id", "left_semi").repartition("_id").select("_id", "_text")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", PIECE_BYTES):
            kmers, many, _ = labelled_kmers(*flat(piece.column(1)))
            at = pa.array(np.repeat(np.arange(piece.num_rows), many))
            size = pa.array(np.repeat(many, many))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(at), pa.array(kmers.view(np.int64)), size], ["_id", "_kmer", "_n"]
            )

    listed = stage(map_batches(rows, run, f"_id {kind}, _kmer long, _n long"), "kmers")
    shared = listed.groupBy("_kmer").agg(F.count("*").alias("_df")).where("_df > 1")
    counted = stage(listed.join(shared, "_kmer"), "counted")
    held = counted.groupBy("_id").agg(
        F.first("_n").alias("_n"),
        (F.sum("_df") / F.first("_n")).alias("_score"),
        F.sort_array(F.collect_list(F.struct("_df", "_kmer"))).alias("_k"),  # bounded by the text
    )
    held = stage(held, "family")
    first = F.col("_n") - F.ceil(threshold * F.col("_n") - 1e-9) + 1
    rarest = F.slice("_k", F.lit(1), F.greatest(first - (F.col("_n") - F.size("_k")), F.lit(0)).cast("int"))
    own = held.select("_id", "_score", "_n", F.size("_k").alias("_many"), F.posexplode(rarest).alias("_at", "_x")).select(
        F.col("_x._kmer").alias("_key"), "_id", "_score", "_n", (F.col("_many") - F.col("_at")).alias("_left")
    )
    groups = parts.join(held.select("_id", "_score"), "_id").select("_key", "_id", "_score")
    groups = groups.unionAll(own.select("_key", "_id", "_score"))
    centre = groups.groupBy("_key").agg(F.max(F.struct("_score", "_id"))["_id"].alias("c"))
    stars = groups.join(centre, "_key").where("_id <> c").select(F.least("c", "_id").alias("a"), F.greatest("c", "_id").alias("b"))
    return stars.distinct(), own.select("_key", "_id", "_n", "_left")


def _mixed(members: DataFrame) -> DataFrame:
    """Rows (_key, _id, component, ...) of buckets with several components, and the members and least id of each."""
    held = members.groupBy("_key").agg(
        F.count("*").alias("_many"),
        F.min("_id").alias("_least"),
        F.min("component").alias("_c1"),
        F.max("component").alias("_c2"),
    )
    return members.join(held.where("_c1 <> _c2").drop("_c1", "_c2"), "_key")


def _across(members: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of rows that share _key and differ in component."""
    left = members.select("_key", F.col("_id").alias("a"), F.col("component").alias("_ca"))
    right = members.select("_key", F.col("_id").alias("b"), F.col("component").alias("_cb"))
    return left.join(right, "_key").where("_ca < _cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _split(full: DataFrame) -> DataFrame:
    """(_id, component, _key) of pairs of sketches that both lie in buckets of ``full``."""
    held = full.groupBy("_id").agg(
        F.first("component").alias("component"), F.collect_list(F.struct("_j", *[f"_p{d}" for d in range(1, NEXT + 1)])).alias("_x")
    )  # at most SKETCHES a text
    of = F.transform("_x", lambda x: x["_j"])

    def keys(d: int) -> Column:
        paired = F.filter("_x", lambda x: F.array_contains(of, _mate(x["_j"], d)))
        return F.transform(paired, lambda x: x[f"_p{d}"])

    pairs = F.concat(*[keys(d) for d in range(1, NEXT + 1)])
    return held.select("_id", "component", F.explode(pairs).alias("_key"))


def _mate(j: Column, d: int) -> Column:
    """The sketch ``d`` places on in a team; teams of TEAM = 2 * NEXT + 1 have all their pairs once."""
    return (F.floor(j / TEAM) * TEAM + F.pmod(j + d, F.lit(TEAM))).cast("int")


def _rest(members: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b), a < b, of rows (_key, _id, _n, _left, component) that differ in component and may be linked.

    Under the first k-mer that two texts share, what is left of each from there on bounds what they share.
    """
    side = lambda x: members.select("_key", *[F.col(c).alias(c + x) for c in ("_id", "_n", "_left", "component")])
    enough = threshold / (1 + threshold) * (F.col("_na") + F.col("_nb")) - 1e-9
    return (
        side("a")
        .join(side("b"), "_key")
        .where((F.col("componenta") < F.col("componentb")) & (F.least("_lefta", "_leftb") >= enough))
        .select(F.least("_ida", "_idb").alias("a"), F.greatest("_ida", "_idb").alias("b"))
        .distinct()
    )


def classes(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, class_id) of every row; a class is named by its least id."""
    all_rows = sketched(docs, text, id_col)
    worded = all_rows.where("_n > 0 and _id is not null")
    nodes = worded.groupBy("_k1", "_k2").agg(
        F.min("_id").alias("_id"), F.first("_n").alias("_n"), F.first("_s").alias("_s")
    )
    nodes = stage(nodes, "texts")
    pair = lambda d: F.xxhash64("_j", "_v", _mate(F.col("_j"), d), F.get("_s", _mate(F.col("_j"), d))).alias(f"_p{d}")
    placed = nodes.select("_id", "_s", F.posexplode("_s").alias("_j", "_v")).select(
        "_id", "_j", F.xxhash64("_j", "_v").alias("_key"), *[pair(d) for d in range(1, NEXT + 1)]
    )
    buckets = placed.groupBy("_key").agg(F.count("*").alias("_many"), F.min("_id").alias("_least")).where("_many > 1")
    members = stage(placed.join(buckets, "_key"), "buckets")

    # Only texts in a bucket with another one are read again.
    held = members.select("_id").distinct()
    texts = stage(
        docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
        .join(held, "_id", "left_semi")
        .dropDuplicates(["_id"]),
        "candidates",
    )
    small = nodes.join(held, "_id", "left_semi").dropDuplicates(["_id"])

    stars = members.where("_id <> _least").select(F.col("_least").alias("a"), F.col("_id").alias("b")).distinct()
    links = _verified(stars, small, texts, threshold)
    named = components(links, "a", "b")

    part_of = lambda df, named: df.join(named.withColumnRenamed("node", "_id"), "_id", "left").withColumn(
        "component", F.coalesce("component", "_id")
    )
    open_ = stage(_mixed(part_of(members.drop("_many", "_least"), named)), "open")
    few = open_.where(F.col("_many") <= BUCKET)
    split = _split(open_.where(F.col("_many") > BUCKET))
    parts = stage(_mixed(split), "parts")
    central, rarest = _families(parts.where(F.col("_many") > BUCKET).select("_key", "_id"), texts, threshold)
    across = few.select("_key", "_id", "component").unionAll(
        parts.where(F.col("_many") <= BUCKET).select("_key", "_id", "component")
    )
    across = _across(across).unionAll(central).distinct().join(stars, ["a", "b"], "left_anti")
    every = links.unionAll(_verified(across, small, texts, threshold))
    named = components(every, "a", "b")

    left = stage(_mixed(part_of(rarest, named)).drop("_many", "_least"), "left")
    every = every.unionAll(_verified(_rest(left, threshold), small, texts, threshold))
    named = components(every, "a", "b")

    keyed = nodes.select("_k1", "_k2", F.col("_id").alias("_rep"))
    found = (
        worded.select("_id", "_k1", "_k2")
        .join(keyed, ["_k1", "_k2"])
        .join(named.withColumnRenamed("node", "_rep"), "_rep", "left")
        .select(F.col("_id").alias(id_col), F.coalesce("component", "_rep").alias("class_id"))
    )
    alone = all_rows.where("_n = 0 or _id is null").select(F.col("_id").alias(id_col), F.col("_id").alias("class_id"))
    return found.unionAll(alone)


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` less all but one document of each class; rows with a null id stay.

    An id that is not the name of its class goes; of rows that repeat an id, one stays.
    """
    columns = docs.columns
    named = classes(docs, text, id_col, threshold).toDF("_id", "_class")
    gone = named.where("_id <> _class").select("_id").distinct()
    left = docs.join(gone, docs[id_col] == gone["_id"], "left_anti")
    known = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
    return known.unionAll(left.where(F.col(id_col).isNull())).select(columns)

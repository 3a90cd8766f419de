"""Divergence of the sources of each language: count vectors, group sums, and a sparse evaluation of pairs.

Documents become exact sparse count vectors, as CountVectorizer with minDF = LEAST_DOCS and the largest integer as
vocabSize makes them for each language on its own: no term is cut off and none is hashed. Its fitted vocabulary
would lie whole on the driver; here it is a table. Tasks add the vectors of the documents that they read, by
(language, source), as a summarizer does, so what is shuffled is a row for each task, group and term. Terms in too few
documents of their language go after that. One shuffle by (language, term) brings the sums of a term together.

With N the count sum of a group and V the kept terms of its language, p = 1 + floor(UNIT (count + 1) / (N + V)) is a smoothed
share in parts of UNIT, and f(p, q) = floor((p - q)^2 / q). Pairs of sources sum f over all kept terms, most of which
neither has. With p0 the share of a term that a group lacks, the sum over all V terms is

    V f(p0, q0)  +  terms of s: f(p, q0) - f(p0, q0)  +  terms of t: f(p0, q) - f(p0, q0)
                 +  terms of both: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The middle parts need only how many terms of a source have each count, the last one only terms that two sources share; it
is added up inside tasks to a row for each task and pair. The result has a row for each pair of sources of a language, by contract.

All arithmetic is on integers, exact while (N + V) UNIT_STEP < 2^63.

Defined cases: null text, language and source are empty; a group without kept terms has pairs and no terms; a language without
kept terms has pairs of value 0; repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.ragged import map_batches
from lamina.session import stage

LEAST_DOCS = 3
UNIT = 1_000_000_000
UNIT_STEP = 1000
MOST_TERMS = 200
#: Distinct terms that a task holds before it hands them on.
HELD = 200_000
#: Pairs of entries that a task evaluates at a time, and sums of pairs that it holds.
PAIRS = 1 << 20

#: Letters by byte: A to Z lower-cased, bytes of other code points kept, all else a gap.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text: runs of letters and of other code points, A to Z lower-cased."""
    return text.translate(_LETTERS).split()


def _named(docs: DataFrame, text: str, lang: str, source: str, *others: Column) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("_text"), *others)


def vectors(docs: DataFrame, text: str = "text", id_col: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, lang, source, terms, counts) of every row: its sparse vector over all terms, in UTF-8 order of the terms."""
    rows = _named(docs, text, lang, source, F.col(id_col).alias("_id"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                held = [sorted(Counter(terms_of(t)).items()) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(3), some.column(0), some.column(1),
                        pa.array([[t for t, _ in h] for h in held], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                        pa.array([[c for _, c in h] for h in held], pa.list_(pa.int64())),
                    ],
                    ["_id", "lang", "source", "terms", "counts"],
                )

    shape = f"_id {kind}, lang string, source string, terms array<string>, counts array<long>"
    return map_batches(rows, run, shape).withColumnRenamed("_id", id_col)


def group_sums(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, count, docs): vectors of documents added up in tasks, then by a shuffle on (lang, term)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, tuple[Counter, Counter]] = {}
        seen = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                columns = [c.to_pylist() for c in batch.slice(at, 64).columns]
                for name, of, raw in zip(*columns, strict=True):
                    count, docs_with = sums.setdefault((name, of), (Counter(), Counter()))
                    vector = Counter(terms_of(raw))
                    seen -= len(count)
                    count.update(vector)
                    seen += len(count)
                    docs_with.update(vector.keys())
                if seen > HELD:
                    yield from told(sums)
                    sums, seen = {}, 0
        yield from told(sums)

    def told(sums: dict) -> Iterator[pa.RecordBatch]:
        for (name, of), (count, docs_with) in sums.items():
            if count:
                fixed = [pa.array([x] * len(count), pa.string()) for x in (name, of)]
                made = [pa.array(count.keys(), pa.binary()).cast(pa.string()), pa.array(count.values(), pa.int64())]
                held = pa.array([docs_with[t] for t in count], pa.int64())
                yield pa.RecordBatch.from_arrays([*fixed, *made, held], ["lang", "source", "term", "count", "docs"])

    parts = map_batches(_named(docs, text, lang, source), run, "lang string, source string, term string, count long, docs long")
    # Tasks have added up already; dealt by (lang, term), both this sum and the one over sources are in place.
    return (
        parts.repartition("lang", "term")
        .groupBy("lang", "source", "term")
        .agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    )


def kept_terms(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, total, sums) of each language's vocabulary; ``sums`` lists (source, count) of the sources that have it."""
    sums = group_sums(docs, text, lang, source)
    of_term = sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"),
        F.sum("count").alias("total"),
        F.collect_list(F.struct("source", "count")).alias("sums"),  # at most one a source
    )
    return stage(of_term.where(F.col("docs") >= least_docs), "divergence-terms")


def vocabulary(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, docs, total) of all kept terms."""
    return kept_terms(docs, text, lang, source, least_docs).select("lang", "term", "docs", "total")


def share(count: Column, whole: Column) -> Column:
    """1 + floor(UNIT (count + 1) / whole) for count < whole, digit by digit, without leaving 64 bits."""
    rest, out = count + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * UNIT_STEP
        out, rest = out * UNIT_STEP + _div(rest, whole), rest % whole
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def groups(docs: DataFrame, terms: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, n, v, p0, lang_n) of every occurring group; p0 is null where the language keeps no term."""
    occurring = _named(docs, lang, lang, source).select("lang", "source").distinct()
    sums = terms.select("lang", F.explode("sums").alias("s")).groupBy("lang", F.col("s.source").alias("source"))
    kept = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    zero = F.lit(0).cast("long")
    joined = (
        occurring.join(sums.agg(F.sum("s.count").alias("n")), ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "v", "lang_n")])
    )
    p0 = F.when(F.col("v") > 0, share(zero, F.greatest(F.col("n") + F.col("v"), F.lit(1))))
    return stage(joined.withColumn("p0", p0), "divergence-groups")


def shares(terms: DataFrame, named: DataFrame) -> DataFrame:
    """(lang, term, source, p, p0, q): a row for each kept term of a group, q being the language's share."""
    rows = terms.select("lang", "term", "total", F.explode("sums").alias("s")).select(
        "lang", "term", "total", "s.source", "s.count"
    )
    joined = rows.join(named, ["lang", "source"])
    return stage(
        joined.select(
            "lang", "term", "source",
            share(F.col("count"), F.col("n") + F.col("v")).alias("p"),
            "p0",
            share(F.col("total"), F.col("lang_n") + F.col("v")).alias("q"),
        ),
        "divergence-shares",
    )


def top_terms(rows: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """(lang, source, item, value, rank) of terms that a source has more often than its language; ranks to ``most``.

    The rank's bound lets Spark cut every partition to its first ``most`` rows of a group before the shuffle.
    """
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most)


def _shared(rows: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms that both sources have add to a pair's sum, for both orders."""
    of_term = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("e"))
    held = of_term.where(F.size("e") > 1).select("lang", *[F.col(f"e.{c}").alias(c) for c in ("source", "p", "p0")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                for key, value in _pair_sums(batch.slice(at, 4096)):
                    total[key] = total.get(key, 0) + value
                if len(total) > PAIRS:
                    yield told(total)
                    total = {}
        if total:
            yield told(total)

    def told(total: dict) -> pa.RecordBatch:
        made = [pa.array(c, pa.string()) for c in zip(*total, strict=True)]
        return pa.RecordBatch.from_arrays([*made, pa.array(total.values(), pa.int64())], ["lang", "source", "item", "value"])

    return map_batches(held, run, "lang string, source string, item string, value long")


def _pair_sums(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int]]:
    """((lang, s, t), sum) over all ordered pairs of entries of each row."""
    lists = batch.column(1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    first, size = offsets[:-1], np.diff(offsets)
    entries = slice(int(offsets[0]), int(offsets[-1]))
    first = first - offsets[0]
    sources = lists.values[entries].dictionary_encode()
    p, p0 = (batch.column(k).values[entries].to_numpy() for k in (2, 3))
    langs = batch.column(0).dictionary_encode()
    lang = np.repeat(langs.indices.to_numpy(), size)
    code = sources.indices.to_numpy().astype(np.int64)
    names, tongues = sources.dictionary.to_pylist(), langs.dictionary.to_pylist()
    f = lambda a, b: (a - b) * (a - b) // b
    partners, begin = np.repeat(size, size), np.repeat(first, size)
    until = np.concatenate([[0], np.cumsum(partners)])
    at = 0
    while at < len(code):  # entries of at most PAIRS pairs, or one entry, at a time
        end = max(at + 1, int(np.searchsorted(until, until[at] + PAIRS, "right")) - 1)
        many = partners[at:end]
        i = np.repeat(np.arange(at, end), many)
        j = np.arange(len(i)) - np.repeat(until[at:end] - until[at], many) + np.repeat(begin[at:end], many)
        i, j = i[i != j], j[i != j]
        value = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
        key = (lang[i] * len(names) + code[i]) * len(names) + code[j]
        keys, place = np.unique(key, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, place, value)
        for k, v in zip(keys.tolist(), sums.tolist(), strict=True):
            st, t = divmod(k, len(names))
            yield (tongues[st // len(names)], names[st % len(names)], names[t]), v
        at = end


def pair_values(rows: DataFrame, named: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank) of every ordered pair of a language's sources."""
    s = named.select("lang", "source", F.col("p0").alias("a0"), "v")
    t = named.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"))
    pairs = stage(s.join(t, "lang").where("source <> item"), "divergence-pairs")  # the rows of the result
    none = F.coalesce(distance(F.col("a0"), F.col("b0")), F.lit(0).cast("long"))
    base = pairs.select("lang", "source", "item", (F.col("v") * none).alias("value"))
    # Of each source, how many terms have each share: as few rows as a term has counts.
    often = rows.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    own = pairs.join(often, ["lang", "source"]).select(
        "lang", "source", "item", (F.col("m") * (distance(F.col("p"), F.col("b0")) - none)).alias("value")
    )
    theirs = pairs.join(often.withColumnRenamed("source", "item"), ["lang", "item"]).select(
        "lang", "source", "item", (F.col("m") * (distance(F.col("a0"), F.col("p")) - none)).alias("value")
    )
    total = base.unionAll(own).unionAll(theirs).unionAll(_shared(rows)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return total.withColumn("rank", F.row_number().over(first))


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term`` of every group."""
    terms = kept_terms(docs, text, lang, source, least_docs)
    named = groups(docs, terms, lang, source)
    rows = shares(terms, named)
    told = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return told("pair", pair_values(rows, named)).unionAll(told("term", top_terms(rows, most_terms)))

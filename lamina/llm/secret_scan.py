"""Secret scan: fixed patterns, and a randomness test battery with length-aware control of false finds.

Base patterns find assignments, access keys and hex runs. All other runs of TOKEN_LEAST token characters or more are tested:
the narrowest encoding that fits is inferred, and chi-squared uniformity over its alphabet, the runs
test about its middle and the lag-1 serial correlation give p-values under randomness, joined by
Bonferroni's bound. Secrets keep high p-values, ordinary tokens don't.

Classes are by length, and by whether a token has digits among letters, which is rare in prose. Per class, a histogram
of all p-values tells how many random tokens there are: of those, (1 - a/3)^3 reach a p-value of a, and the bin of
the highest p-values holds few others. The class's cut is the lowest at which the estimated share of others among the accepted stays within
``false_share``. A class in which no cut does so has none, and accepts nothing. Classes of mixed tokens count one random token
in advance, so that a single key is found; classes of letters or digits alone count two standard deviations fewer than they
show, so long words stay.

Column expressions only. Spans are code points, end exclusive. Nothing is shuffled but one histogram
of bounded size, so hot sources and huge documents change nothing but a task's length.

Defined cases: null and empty texts have no spans; ids may be null or repeated; other columns are kept
by ``redact`` and ignored by ``scan``; a class without tokens has no cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.quality_rules import let
from lamina.session import stage

#: The base patterns, with the least length of the part that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LEAST = 12
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 18
HEX, HEX_LEAST = r"[0-9a-f]+", 16

#: By rank; random tokens are mixed ones (MIXED) or of letters, digits or marks alone (PLAIN).
KINDS = ("assign", "access", "hex", "random", "random")
MIXED, PLAIN = 4, 5
TOKEN_LEAST = 16
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+" % TOKEN_LEAST
REDACTED = "[secret]"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from narrow to wide: a pattern that a token must fit, and the alphabet in order.
ENCODINGS = (
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    (r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    (r"^", UPPER + LOWER + DIGITS + "+/-_"),
)
LENGTH_EDGES = (20, 28, 40, 64, 128)
BINS = 100
CUTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
HIGHEST = 0.95
FALSE_SHARE = 0.1

SPAN = "array<struct<start:int,rank:int,end:int,value:string,p:double>>"


def _prefix_sums(sizes: Column) -> Column:
    """Sum of the elements before each one, by blocks of about the root of their number."""
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def from_blocks(b: Column) -> Column:
        ahead = F.transform(b, lambda _, k: total(F.slice(b, 1, k)))
        return let(
            ahead,
            lambda h: F.transform(
                sizes,
                lambda _, i: F.get(h, F.floor(i / step).cast("int"))
                + total(F.slice(sizes, (F.floor(i / step) * step + 1).cast("int"), F.pmod(i, step))),
            ),
        )

    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(sizes) / step).cast("int")),
        lambda k: total(F.slice(sizes, k * step + 1, step)),
    )
    return let(blocks, from_blocks)


def _matches(text: Column, pattern: str, rank: int, counted: int, least: int) -> Column:
    """Spans of leftmost non-overlapping matches whose group ``counted`` has ``least`` characters or more."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(counted)) if counted else whole

    def spans(g: Column) -> Column:
        def placed(w: Column) -> Column:
            lengths = F.transform(w, lambda x, i: F.length(x) + F.length(F.get(g, i)))
            begins = let(lengths, _prefix_sums)
            held = F.zip_with(begins, w, lambda b, x: F.struct(b.alias("b"), x.alias("x")))
            return F.transform(
                held,
                lambda s, i: F.struct(
                    (s["b"] + F.length(F.get(g, i))).cast("int").alias("start"),
                    F.lit(rank).alias("rank"),
                    (s["b"] + F.length(F.get(g, i)) + F.length(s["x"])).cast("int").alias("end"),
                    s["x"].alias("value"),
                    F.lit(None).cast("double").alias("p"),
                ),
            )

        return let(whole, placed)

    every = let(gaps, spans)
    if counted:
        pairs = F.zip_with(every, part, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
        return F.transform(F.filter(pairs, lambda x: F.length(x["v"]) >= least), lambda x: x["s"])
    return F.filter(every, lambda s: s["end"] - s["start"] >= least)


def _where(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed patterns, by start and kind."""
    lowered = F.lower(text)
    named = F.lit(False)
    for word in ASSIGN_WORDS:
        named = named | F.contains(lowered, F.lit(word))
    # A maximal run of k characters fits {k,} exactly when it fits + and is long enough.
    runs = _matches(text, HEX.replace("+", "{%d,}" % HEX_LEAST), 3, 0, HEX_LEAST)
    return F.array_sort(
        F.concat(
            _where(named, _matches(text, ASSIGN, 1, 2, ASSIGN_LEAST)),
            _where(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS, 2, 0, ACCESS_LEAST)),
            _where(text.rlike(HEX.replace("+", "{%d,}" % HEX_LEAST)), runs),
        )
    )


def _upper_tail(z: Column) -> Column:
    """Normal upper tail by its logistic approximation."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.07056 * z * z * z))))


def battery(token: Column) -> Column:
    """p-value of a token under randomness in its inferred encoding."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tested(held: Column) -> Column:
        letters, n = held["a"], F.length(held["t"]).cast("double")
        size = F.length(letters).cast("double")
        squares = F.aggregate(
            F.filter(F.split(letters, ""), lambda c: c != ""),
            F.lit(0.0),
            lambda s, c: s + F.pow(n - F.length(F.replace(held["t"], c, F.lit(""))), F.lit(2.0)),
        )
        chi = size / n * squares - n
        k = size - 1
        spread = 2 / (9 * k)
        uniform = _upper_tail((F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
        places = F.transform(
            F.filter(F.split(held["t"], ""), lambda c: c != ""), lambda c: F.instr(letters, c).cast("double")
        )

        def sequence_tests(x: Column) -> Column:
            mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
            return let(F.struct(x.alias("x"), mean.alias("m")), lambda v: about(v["x"], v["m"]))

        def about(x: Column, mean: Column) -> Column:
            power = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
            lagged = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                                lambda a, b: (a - mean) * (b - mean))
            serial = F.aggregate(lagged, F.lit(0.0), lambda s, v: s + v) / F.greatest(power, F.lit(1e-9))
            high = F.size(F.filter(x, lambda v: v > size / 2)).cast("double")
            low = n - high
            runs = 1 + F.size(
                F.filter(
                    F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1),
                               lambda a, b: (a > size / 2) != (b > size / 2)),
                    lambda changed: changed,
                )
            )
            expected = 2 * high * low / n + 1
            deviation = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
            by_runs = 2 * _upper_tail(F.abs((runs - expected) / deviation))
            by_lag = 2 * _upper_tail(F.abs((serial + 1 / n) * F.sqrt(n)))
            return F.least(by_runs, by_lag)

        return F.least(F.lit(1.0), 3 * F.least(uniform, let(places, sequence_tests)))

    return let(F.struct(token.alias("t"), alphabet.alias("a")), tested)


def tested_spans(text: Column, base: Column) -> Column:
    """Other tokens that touch no base span, each with its p-value and its rank."""
    every = _matches(text, TOKEN, MIXED, 0, TOKEN_LEAST)
    apart = F.filter(every, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    judged = F.transform(
        apart,
        lambda s: s.withField("p", battery(s["value"])).withField("rank", F.when(mixed(s["value"]), MIXED).otherwise(PLAIN)),
    )
    return _where(text.rlike(TOKEN), judged)


def token_class(span: Column) -> Column:
    """Length class, times two, and one more for tokens that aren't mixed."""
    size = span["end"] - span["start"]
    out = F.lit(0)
    for edge in LENGTH_EDGES:
        out = out + F.when(size >= edge, 2).otherwise(0)
    return out + (span["rank"] - MIXED)


def reach(a: float) -> float:
    """Share of random tokens whose p-value is at least ``a``: three tests under Bonferroni's bound."""
    return (1 - a / 3) ** 3


def cut_of(counts: dict[int, int], mixed: bool, false_share: float = FALSE_SHARE) -> float | None:
    """The least p-value that a class accepts, from its histogram by bin; None where none keeps within ``false_share``."""
    above = lambda a: sum(n for b, n in counts.items() if b >= round(a * BINS))
    top = above(HIGHEST)
    sure = top + 1 if mixed else max(0.0, top - 2 * top**0.5)
    random = min(sure / reach(HIGHEST), above(0.0) + mixed)
    fits = [a for a in CUTS if above(a) and above(a) - random * reach(a) <= false_share * above(a)]
    return fits[0] if fits else None


def cuts(spans: DataFrame, false_share: float = FALSE_SHARE) -> dict[int, float]:
    """The cut of each class that has one, from the histogram of all ``spans._t``.

    Reads one row per class and bin, at most 2 * (len(LENGTH_EDGES) + 1) * (BINS + 1).
    """
    counted = (
        spans.select(F.explode("_t").alias("s"))
        .groupBy(token_class(F.col("s")).alias("k"), F.floor(F.col("s.p") * BINS).alias("b"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    found = {k: cut_of({r["b"]: r["n"] for r in counted if r["k"] == k}, k % 2 == 0, false_share) for k in {r["k"] for r in counted}}
    return {k: cut for k, cut in sorted(found.items()) if cut is not None}


def _with_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with base spans ``_b`` and tested tokens ``_t`` of ``_text``."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    return rows.withColumn("_b", base_spans(whole)).withColumn("_t", tested_spans(whole, F.col("_b")))


def _accepted(found: DataFrame, limits: dict[int, float]) -> DataFrame:
    """All spans that stay, as ``_s``."""
    least = F.lit(2.0)
    kept = F.filter("_t", lambda s: s["p"] >= _limit(s, limits, least))
    return found.withColumn("_s", F.array_sort(F.concat("_b", kept)))


def _limit(span: Column, limits: dict[int, float], otherwise: Column) -> Column:
    out = otherwise
    for k, cut in limits.items():
        out = F.when(token_class(span) == k, F.lit(cut)).otherwise(out)
    return out


def _written(spans: Column) -> Column:
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", false_share: float = FALSE_SHARE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    bare = lambda c: F.transform(c, lambda s: s.dropFields("value")).alias(c)
    found = stage(_with_spans(rows).select("_id", bare("_b"), bare("_t")), "secrets")  # texts are scanned once
    found = _accepted(found, cuts(found, false_share))
    many = lambda column, k: F.size(F.filter(column, lambda s: s["rank"] >= k if k == MIXED else s["rank"] == k)).cast("long")
    return found.select(
        F.col("_id").alias(id_col),
        many("_b", 1).alias("n_assign"),
        many("_b", 2).alias("n_access"),
        many("_b", 3).alias("n_hex"),
        F.sha2(_written(F.col("_b")), 256).alias("base_sha256"),
        _written(F.col("_s")).alias("spans"),
        many("_s", MIXED).alias("n_random"),
    )


def redact(docs: DataFrame, text: str = "text", mark: str = REDACTED, false_share: float = FALSE_SHARE) -> DataFrame:
    """``docs`` with every span, overlapping ones joined, replaced by ``mark``; other columns as they are."""
    found = _with_spans(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")))
    limits = cuts(found.select("_t"), false_share)
    whole = F.col("_text")

    def step(state: Column, s: Column) -> Column:
        begins = s["start"] >= state["at"]
        return F.struct(
            F.when(begins, F.concat(state["out"], F.substring(whole, state["at"] + 1, s["start"] - state["at"]), F.lit(mark)))
            .otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    clean = F.aggregate(
        "_s", start, step, lambda x: F.concat(x["out"], F.substring(whole, x["at"] + 1, F.length(whole)))
    )
    changed = F.when(F.size("_s") > 0, clean).otherwise(whole)
    return _accepted(found, limits).select(
        *[changed.alias(c) if c == text else F.col("_row")[c].alias(c) for c in docs.columns]
    )

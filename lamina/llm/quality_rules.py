"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is a column expression: words, lines and ratios are array functions over the row's own
text, so the job is a scan without a shuffle and a hot source or a huge document changes nothing.

Defined cases: a null or blank text has no words and fails; doc_id may be null or repeated (one row
out per row in); other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages served.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur se ne "
    "el los las y del por con una su para no al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only while ``low <= metric <= high``."""

    metric: str
    low: float
    high: float


#: Production thresholds. Ratios are per word, except line ratios, which are per line with a word.
RULES = (
    Rule("mean_word_chars", 2.0, 16.0),
    Rule("symbol_ratio", 0.0, 0.1),
    Rule("stop_ratio", 0.02, 1.0),
    Rule("dup_line_ratio", 0.0, 0.5),
    Rule("mean_line_words", 1.5, 100000.0),
)

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, whose lambdas may use it freely."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.filter(F.split(spaced, " ", -1), lambda w: w != "")


def line_array(text: Column) -> Column:
    """Lines that hold a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.filter(lines, lambda x: F.translate(x, SPACES, "") != "")


def _windows(words: Column) -> Column:
    some = F.size(words) >= 3
    triples = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(some, triples).otherwise(F.array().cast("array<string>"))


def _covered(windows: Column) -> Column:
    """Words inside windows found twice or more; windows cover three words each."""
    labelled = F.sort_array(F.transform(windows, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def places(s: Column) -> Column:
        again = F.filter(
            s,
            lambda e, j: F.coalesce(F.get(s, j - 1)["g"] == e["g"], F.lit(False))
            | F.coalesce(F.get(s, j + 1)["g"] == e["g"], F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda e: e["i"]))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(3), F.get(p, k + 1) - x), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    counted = let(labelled, lambda s: let(places(s), total))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(counted)


def measure(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, counts, ratios) of every row."""
    whole = F.coalesce(F.col("_t"), F.lit(""))
    base = (
        docs.select(F.col(id_col).alias(id_col), F.col(text).alias("_t"))
        .withColumns({"_w": word_array(F.col("_t")), "_l": line_array(F.col("_t"))})
        .withColumn("_g", _windows(F.col("_w")))
    )
    stop = F.size(F.filter(F.col("_w"), lambda w: w.isin(*STOP_WORDS)))
    counts = base.select(
        F.col(id_col),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate(whole, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_g")).cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        stop.cast("long").alias("n_stop_words"),
    )
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    return counts.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "stop_ratio": F.col("n_stop_words") / words,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
            "mean_line_words": F.col("n_words") / lines,
        }
    )


def verdict(rules=RULES) -> Column:
    """The rule table as one boolean expression."""
    passed = F.lit(True)
    for rule in rules:
        passed = passed & F.col(rule.metric).between(rule.low, rule.high)
    return passed


def first_failure(rules=RULES) -> Column:
    """Name of the first rule a row breaks; null where it keeps them all."""
    return F.coalesce(*[F.when(~F.col(r.metric).between(r.low, r.high), F.lit(r.metric)) for r in rules])


def judge(docs: DataFrame, rules=RULES, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Counts, ratios, ``base_failed``, ``failed_rule`` and ``kept`` of every row."""
    failed = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return measure(docs, text, id_col).withColumns(
        {"base_failed": failed, "failed_rule": first_failure(rules), "kept": ~failed & verdict(rules)}
    )

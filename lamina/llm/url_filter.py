"""URL filter by rules and by a tree of path templates learned for each host.

Urls that a rule decides are the labelled ones. The paths of a host form a tree of segments. Level by
level, a segment of a node stays as it is when it is frequent there (by share or by count) and differs from its siblings:

* A branch with LABELLED labelled urls is held against the node's other labelled urls by a z-test of the share of blocked ones.
* A branch with fewer is held against the node's other such branches of the same shape and with the same majority below by z-tests of
  what lies below: the share of urls that end there, and that of urls that go on with a digit.

Labelled branches that are alike merge into a group by shape (digits, letters, other), others into one by shape and majority; segments
that are not frequent are variable and become a wildcard by shape. A template is the path so rewritten, with everything
beyond DEPTH segments as ``**``. Its purity is the share of blocked urls among its labelled ones, smoothed towards the node
above: its prior is the node's share of blocked urls, in which undecided ones count half. Urls that no rule decides are
blocked when their template is at least PURE.

Levels are aggregates and joins by (host, template so far, segment), so a host with a third of all urls
is aggregated before it is shuffled, and its joins are against tables of merged and kept segments only. Each
level is written to the staging folder, which keeps the plan as short at every depth.

Defined cases: a null url or one without ``://`` has empty host and path; ids may be null or repeated
(one row out per row in); an empty table has no templates; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values: (verdict, host, path) of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DEPTH = 4
LEAST = 3
SHARE = 0.05
MANY = 20
LABELLED = 5
ALIKE = 1.96
PURE = 0.9
SMOOTH = 2.0
#: Shapes of segments, and the marks of a wildcard and of a group of labelled branches.
SHAPES = (("9", "^[0-9]+$"), ("a", "^[A-Za-z]+$"))
OTHER_SHAPE = "-"
WILD, LABELLED_GROUP = "*", "+"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, of, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(begin)
        rule = F.when(fits, F.lit(of + begin)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _counts() -> list[Column]:
    """Urls, labelled urls and blocked ones of a group."""
    return [
        F.count("*").alias("n"),
        F.count("_label").alias("labelled"),
        F.coalesce(F.sum("_label"), F.lit(0)).alias("blocked"),
    ]


def _shape(segment: Column) -> Column:
    named = F.lit(OTHER_SHAPE)
    for name, pattern in reversed(SHAPES):
        named = F.when(segment.rlike(pattern), F.lit(name)).otherwise(named)
    return named


def _alike(own: Column, n: Column, all_own: Column, all_n: Column) -> Column:
    """Whether a share doesn't differ from that of the others, which the totals hold as well, by a z-test."""
    rest = F.greatest(all_n - n, F.lit(1))
    size = F.greatest(n, F.lit(1))
    pooled = (all_own + 0.5) / (all_n + 1.0)
    gap = F.abs(own / size - (all_own - own) / rest)
    return gap <= ALIKE * F.sqrt(pooled * (1.0 - pooled) * (1.0 / size + 1.0 / rest))


def rewritten_segments(rows: DataFrame, level: int) -> DataFrame:
    """(_host, _template, _segment, _step) of the frequent segments of a level: themselves, or their group."""
    branches = (
        rows.where(F.size("_parts") > level)
        .groupBy("_host", "_template", F.get("_parts", F.lit(level)).alias("_segment"))
        .agg(
            *_counts(),
            F.count_if(F.size("_parts") == level + 1).alias("ended"),
            F.count_if(F.coalesce(F.get("_parts", F.lit(level + 1)).rlike("^[0-9]"), F.lit(False))).alias("digits"),
        )
        .withColumn("_shape", _shape(F.col("_segment")))
    )
    node = ["_host", "_template"]
    nodes = branches.groupBy(*node).agg(
        F.sum("n").alias("_n"), F.sum("labelled").alias("_labelled"), F.sum("blocked").alias("_blocked")
    )
    frequent = (F.col("n") >= LEAST) & ((F.col("n") >= SHARE * F.col("_n")) | (F.col("n") >= MANY))
    most = lambda c, name, rest: F.when(F.col(c) * 2 > F.col("n"), F.lit(name)).otherwise(rest)
    below = most("ended", "$", most("digits", "9", F.lit(OTHER_SHAPE)))
    held = branches.join(nodes, node).where(frequent).withColumn("_below", below)
    free = F.col("labelled") < LABELLED
    total = lambda c: F.sum(F.when(free, F.col(c)).otherwise(0)).alias(f"_all_{c}")
    kind = [*node, "_shape", "_below"]
    shapes = held.groupBy(kind).agg(total("n"), total("ended"), total("digits"))
    others = F.col("_labelled") - F.col("labelled") >= LABELLED
    by_label = ~free & others & _alike(F.col("blocked"), F.col("labelled"), F.col("_blocked"), F.col("_labelled"))
    same = lambda c: _alike(F.col(c), F.col("n"), F.col(f"_all_{c}"), F.col("_all_n"))
    by_children = free & (F.col("_all_n") > F.col("n")) & same("ended") & same("digits")
    group = F.concat(F.lit(WILD), F.col("_shape"))
    step = F.when(by_label, F.concat(group, F.lit(LABELLED_GROUP))).when(by_children, F.concat(group, "_below")).otherwise(F.col("_segment"))
    return held.join(shapes, kind).select(*node, "_segment", step.alias("_step"))


def templates(rows: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``rows`` (_host, _path, ...) with the _template of each and that of the node above."""
    parts = F.filter(F.split("_path", "/"), lambda s: s != "")
    rows = rows.withColumn("_parts", parts).withColumns({"_template": F.lit(""), "_above": F.lit("")})
    for level in range(depth):
        joined = rows.withColumn("_segment", F.get("_parts", F.lit(level))).join(
            rewritten_segments(rows, level), ["_host", "_template", "_segment"], "left"
        )
        wild = F.concat(F.lit(WILD), _shape(F.col("_segment")))
        ended = F.col("_segment").isNull()
        step = F.when(ended, F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("_step", wild)))
        rows = joined.withColumns(
            {"_above": F.when(ended, F.col("_above")).otherwise(F.col("_template")), "_template": F.concat("_template", step)}
        ).drop("_segment", "_step")
        rows = stage(rows, "url-level")  # read twice by the next level
    deeper = F.size("_parts") > depth
    return rows.withColumns(
        {
            "_above": F.when(deeper, F.col("_template")).otherwise(F.col("_above")),
            "_template": F.concat("_template", F.when(deeper, F.lit("/**")).otherwise(F.lit(""))),
        }
    )


def purities(placed: DataFrame) -> DataFrame:
    """(_host, _template, purity) of every template."""
    counted = placed.groupBy("_host", "_above", "_template").agg(*_counts())
    steps = F.split("_template", "/")
    up_to = F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1)))
    passing = F.explode(F.transform(up_to, lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))).alias("_above")
    nodes = counted.select("_host", passing, "n", "labelled", "blocked").groupBy("_host", "_above").agg(
        F.sum("n").alias("_n"), F.sum("labelled").alias("_labelled"), F.sum("blocked").alias("_blocked")
    )
    prior = (F.col("_blocked") + 0.5 * (F.col("_n") - F.col("_labelled"))) / F.col("_n")
    purity = (F.col("blocked") + SMOOTH * prior) / (F.col("labelled") + SMOOTH)
    return counted.join(nodes, ["_host", "_above"]).select("_host", "_template", purity.alias("purity"))


def judge(pages: DataFrame, rules=RULES, url: str = "url", id_col: str = "page_id", depth: int = DEPTH) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of every row."""
    host, path = parsed(F.col(url))
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("_host"), path.alias("_path"))
    rule, verdict = ruled(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict}).withColumn(
        "_label", F.when(F.col("_verdict").isNotNull(), (F.col("_verdict") == "block").cast("long"))
    )
    placed = templates(rows, depth)
    return placed.join(purities(placed), ["_host", "_template"]).select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.when(F.col("purity") >= PURE, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("_template").alias("template"),
        "purity",
    )

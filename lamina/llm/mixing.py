"""Mixing sources to target weights: fixed-length blocks of words dealt to output shards.

The words of each source, its documents in hashed order, form one stream that is cut into blocks of
BLOCK words. Every source owes ``want`` words, made of whole passes over its stream and a part of
one more; each is a run of slots. Output shards draw how many slots of each source they get: the counts of a source over the
shards are a multinomial draw, made by halving. Half of a range of shards gets a binomial share of the range's slots, by
coin flips from a hash of seed, source and place, and the other half gets the rest, so totals are exact at every
size. A shard's slots of a source are a run of the source's slots. Within a pass, slots meet
blocks through the source's own pseudorandom index permutation. Blocks then join documents by index.

Only column expressions, joins, windows and aggregates are used. A hot source is spread: running
offsets are taken in hashed buckets of about BUCKET_ROWS documents, slots are made from (source, shard) rows in a number of
tasks that follows their number, and the join key holds the block number. Windows over the table of sources, and over
the buckets of a source, expect fewer of those than a task can hold. One number reaches the driver, that of all slots.

Defined cases: a null text has no words; a null source is a source, ordered last; a source without
words has target 0; ids may be null or repeated (one row out per row in); an empty table gives an
empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import stage

BLOCK = 32
SHARD_SLOTS = 4096
BUCKET_ROWS = 5000
SLOTS_A_TASK = 1 << 19
#: So many halvings are one job; from SPREAD_LEVEL on the ranges of shards are spread over tasks.
HALVINGS = 4
SPREAD_LEVEL = 12
#: Coins flipped one by one; more are summed up by their normal limit.
COINS = 4096
WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_TIMES = 2
WORD = r"[^\x20\x09-\x0D]+"


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """A bijection of 0..n-1 for each key: three Feistel rounds on a grid, walking on while outside."""
    high = F.ceil(F.sqrt(n.cast("double")))
    low = F.ceil(n / high)

    def once(x: Column) -> Column:
        a, b = F.floor(x / low), F.pmod(x, low)
        a = F.pmod(a + F.pmod(F.xxhash64(F.lit(1), *key, b), high), high)
        b = F.pmod(b + F.pmod(F.xxhash64(F.lit(2), *key, a), low), low)
        a = F.pmod(a + F.pmod(F.xxhash64(F.lit(3), *key, b), high), high)
        return (a * low + b).cast("long")

    first = once(index)
    # At most high * low - n values lie outside, so that many steps end every walk.
    walk = F.aggregate(
        F.sequence(F.lit(0).cast("long"), high * low - n), first, lambda x, _: F.when(x >= n, once(x)).otherwise(x)
    )
    return F.when(first < n, first).otherwise(walk)


def document_sizes(docs: DataFrame, text: str, source: str, id_col: str) -> DataFrame:
    """(_id, _source, _size, _tie) of every row, staged: texts are read once."""
    return stage(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source).alias("_source"),
            F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("_size"),
            F.xxhash64(F.col(text)).alias("_tie"),
        ),
        "mix-sizes",
    )


def source_plan(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST_TIMES) -> DataFrame:
    """One row per source: size, target and how its slots are laid out.

    Targets share ``budget`` times all words by weight, none above ``most`` times its source. Ordered
    by the level at which a source is full, the final level is the largest of the levels that arise
    when exactly the sources before a row are full.
    """
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    by_level = Window.orderBy(F.col("_cap") / F.col("_weight"), "_src")
    all_rows = Window.partitionBy()
    names = F.array(*[F.lit(w) for w in weights])
    level = (budget * F.sum("_total").over(all_rows) - F.coalesce(
        F.sum("_cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )) / F.sum("_weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    plan = (
        sizes.groupBy("_source")
        .agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
        .withColumn("_src", F.row_number().over(by_name))
        .withColumn("_weight", F.element_at(names, F.pmod(F.col("_src") - 1, F.lit(len(weights))) + 1))
        .withColumn("_cap", F.col("_total") * most)
        .withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(all_rows))
        .withColumn("_target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight")))
        .withColumn("_want", F.least(F.col("_cap"), F.floor(F.col("_target") + 0.5)))
        .withColumn("_full", F.floor(F.col("_total") / BLOCK))
        .withColumn("_blocks", F.ceil(F.col("_total") / BLOCK))
        .withColumn("_passes", F.when(F.col("_total") > 0, F.floor(F.col("_want") / F.col("_total"))).otherwise(0))
        .withColumn("_rest", F.col("_want") - F.col("_passes") * F.col("_total"))
        .withColumn("_slots", F.col("_passes") * F.col("_blocks") + F.ceil(F.col("_rest") / BLOCK))
        .withColumn("_buckets", F.ceil(F.col("_rows") / BUCKET_ROWS))
    )
    return stage(plan.drop("_level", "_cap"), "mix-sources")


def binomial(n: Column, *key: Column) -> Column:
    """Heads among n coins that depend on ``key``: bits of hashes, or their normal limit beyond COINS."""
    flipped = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / 63)),
        F.lit(0).cast("long"),
        lambda heads, k: heads
        + F.bit_count(
            F.xxhash64(k, *key).bitwiseAND(
                F.call_function("shiftright", F.lit(2**63 - 1), (63 - F.least(n - k * 63, F.lit(63))).cast("int"))
            )
        ),
    )
    even = lambda tag: (F.pmod(F.xxhash64(F.lit(tag), *key), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    normal = F.sqrt(-2 * F.log(even("r"))) * F.cos(even("a") * (2 * math.pi))
    limit = F.greatest(F.lit(0), F.least(n, F.floor(n / 2 + F.sqrt(n.cast("double")) / 2 * normal + 0.5)))
    return F.when(n < 1, F.lit(0)).when(n <= COINS, flipped).otherwise(limit).cast("long")


def shards_for(slots: int, shard_slots: int = SHARD_SLOTS) -> int:
    """Halvings that leave shards of about ``shard_slots`` slots."""
    return max(0, math.ceil(math.log2(max(slots, 1) / shard_slots)))


def shard_counts(plan: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The plan's rows by shard: (..., shard, _begin, _count), the run of the source's slots that a shard gets."""
    every = plan.agg(F.coalesce(F.sum("_slots"), F.lit(0))).first()[0]
    tasks = max(1, math.ceil(every / SLOTS_A_TASK))
    levels = shards_for(every, shard_slots)
    rows = plan.where("_slots > 0").withColumns(
        {"shard": F.lit(0).cast("long"), "_begin": F.lit(0).cast("long"), "_count": F.col("_slots")}
    )
    for level in range(levels):
        if level and level % HALVINGS == 0:
            rows = stage(rows.repartition(tasks) if level >= SPREAD_LEVEL else rows, "mix-shards")
        heads = rows.withColumn("_heads", binomial(F.col("_count"), F.lit(seed), F.lit(level), "shard", "_src"))
        left = F.struct((F.col("shard") * 2).alias("shard"), F.col("_begin"), F.col("_heads").alias("_count"))
        right = F.struct(
            (F.col("shard") * 2 + 1).alias("shard"),
            (F.col("_begin") + F.col("_heads")).alias("_begin"),
            (F.col("_count") - F.col("_heads")).alias("_count"),
        )
        halves = heads.withColumn("_half", F.explode(F.array(left, right))).drop("shard", "_begin", "_count", "_heads")
        rows = halves.select("*", "_half.*").drop("_half").where("_count > 0")
    return rows.repartition(tasks)


def slots(plan: DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(_src, shard, slot, position, _block, _words) of every output slot; a shard is read in order of position."""
    key = F.lit(seed)
    one = shard_counts(plan, seed, shard_slots).withColumn(
        "slot", F.explode(F.sequence(F.col("_begin"), F.col("_begin") + F.col("_count") - 1))
    )
    turn = one.withColumns(
        {"_pass": F.floor(F.col("slot") / F.col("_blocks")), "_at": F.pmod("slot", "_blocks")}
    )  # the last, shorter block ends every pass
    placed = turn.withColumn(
        "_block",
        F.when(F.col("_at") < F.col("_full"), permuted(F.col("_at"), F.col("_full"), key, F.col("_src"), F.col("_pass")))
        .otherwise(F.col("_full")),
    )
    due = F.col("_want") - F.col("_pass") * F.col("_total") - F.col("_at") * BLOCK
    held = F.least(F.lit(BLOCK), F.col("_total") - F.col("_block") * BLOCK)
    return placed.select(
        "_src",
        "shard",
        "slot",
        F.xxhash64(key, F.col("shard"), F.col("_src"), F.col("slot")).alias("position"),
        "_block",
        F.least(due, held).cast("long").alias("_words"),
    )


def offsets(sizes: DataFrame, plan: DataFrame, seed: int = 0) -> DataFrame:
    """Documents with the place of their first word in the stream of their source."""
    named = plan.select("_source", "_src", "_buckets", "_total", "_target")
    rows = sizes.join(named, sizes["_source"].eqNullSafe(named["_source"])).drop("_source")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_id", "_size"), F.col("_buckets")))
    before = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("_src", "_bucket")
        .agg(F.sum("_size").alias("_n"))
        .select("_src", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_src", "_bucket").orderBy("_id", "_size", "_tie")
    placed = rows.join(starts, ["_src", "_bucket"]).withColumn(
        "_first", F.col("_start") + F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    )
    return stage(placed.select("_src", "_id", "_size", "_total", "_target", "_first"), "mix-places")


def mix(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): documents with size, target and place; what each output slot takes from which.

    ``pieces`` has (shard, position, slot, document columns, first_word, words): a slot takes ``words`` words
    of a document from its word ``first_word`` on, and the slots of a shard are read in order of ``position``.
    """
    sizes = document_sizes(docs, text, source, id_col)
    plan = source_plan(sizes)
    placed = offsets(sizes, plan, seed)
    spread = placed.where("_size > 0").withColumn(
        "_block",
        F.explode(F.sequence(F.floor(F.col("_first") / BLOCK), F.floor((F.col("_first") + F.col("_size") - 1) / BLOCK))),
    )
    begin = F.greatest(F.col("_first"), F.col("_block") * BLOCK)
    end = F.least(F.col("_first") + F.col("_size"), F.col("_block") * BLOCK + F.col("_words"))
    pieces = (
        spread.select("_src", "_block", "_id", "_size", "_first")
        .join(slots(plan, seed).hint("merge"), ["_src", "_block"])  # its size can't be told from the sources'
        .where(end > begin)
        .select(
            "shard", "position", "slot", "_src", "_id", "_size", "_first",
            (begin - F.col("_first")).alias("first_word"), (end - begin).alias("words"),
        )
    )
    return placed, pieces


def taken(
    docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", seed: int = 0
) -> DataFrame:
    """(id, size, source_size, target, taken) of every row: words the mix takes, repeats counted."""
    placed, pieces = mix(docs, text, source, id_col, seed)
    drawn = pieces.select("_src", "_first", "words").unionAll(
        placed.where("_size > 0").select("_src", "_first", F.lit(0).cast("long"))
    )
    # A source's words have one owner each, so the place of the first names a row with words.
    sums = drawn.groupBy("_src", "_first").agg(F.sum("words").alias("taken"))
    full = placed.where("_size > 0").join(sums, ["_src", "_first"])
    empty = placed.where("_size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = [
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_total").alias("source_size"),
        F.col("_target").alias("target"),
        "taken",
    ]
    return full.select(columns).unionAll(empty.select(columns))

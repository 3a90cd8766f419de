"""Running computations that never put one whole group, or the whole table, in one task.

A plain ordered window sends every row of a group to one task. Here the order column is
cut into blocks, rows are scanned inside (group, block), and each block's summary, one row
per block, carries the running value across blocks. Global numbering uses a staged range
partitioning instead and needs one summary row per partition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import large
from lamina.session import stage_large as stage

BLOCK = 1 << 16
_B = "__block"


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / block).cast("bigint"))


def _carry(df: DataFrame, keys: Sequence[str], summary: Column) -> DataFrame:
    """Per (keys, block): the summaries of all earlier blocks, folded by the caller's window."""
    return large(df.groupBy(*keys, _B).agg(summary.alias("__own")))


def _earlier(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)


def rank_in_group(
    df: DataFrame, keys: Sequence[str], order: str, out: str, block: int = BLOCK
) -> DataFrame:
    """0-based position of each row in its group by the integer column ``order``.

    ``order`` must be unique within a group, which also bounds a block to ``block`` rows.
    """
    rows = _blocked(df, order, block)
    before = _carry(rows, keys, F.count(F.lit(1))).withColumn(
        "__before", F.coalesce(F.sum("__own").over(_earlier(keys)), F.lit(0))
    )
    local = rows.withColumn(
        "__local", F.row_number().over(Window.partitionBy(*keys, _B).orderBy(order))
    )
    joined = local.join(before.drop("__own"), [*keys, _B])
    return joined.withColumn(out, F.col("__before") + F.col("__local") - 1).drop(
        _B, "__local", "__before"
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], block: int = BLOCK
) -> DataFrame:
    """Inclusive running sums in each group, all in one scan; ``values`` maps names to addends."""
    own = [f"__v{i}" for i in range(len(values))]
    rows = _blocked(df.withColumns(dict(zip(own, values.values()))), order, block)
    before = large(rows.groupBy(*keys, _B).agg(*[F.sum(v).alias(v) for v in own])).select(
        *keys, _B, *[F.coalesce(F.sum(v).over(_earlier(keys)), F.lit(0)).alias("__before" + v) for v in own]
    )
    frame = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.withColumns({"__local" + v: F.sum(v).over(frame) for v in own}).join(before, [*keys, _B])
    return joined.withColumns(
        {name: F.col("__before" + v) + F.col("__local" + v) for name, v in zip(values, own)}
    ).drop(_B, *own, *["__local" + v for v in own], *["__before" + v for v in own])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """Inclusive running sum of ``value`` in each group."""
    return running_sums(df, keys, order, {out: value}, block)


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    block: int = BLOCK,
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` at or before each row of its group, or strictly before it."""
    rows = _blocked(df.withColumn("__v", value), order, block)
    latest = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(order)))
    before = _carry(rows, keys, latest).withColumn(
        "__before", F.last("__own", ignorenulls=True).over(_earlier(keys))
    )
    frame = Window.partitionBy(*keys, _B).orderBy(order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    joined = rows.withColumn("__local", F.last("__v", ignorenulls=True).over(frame)).join(
        before.drop("__own"), [*keys, _B]
    )
    return joined.withColumn(out, F.coalesce("__local", "__before")).drop(
        _B, "__v", "__local", "__before"
    )


def number_rows(df: DataFrame, order: Sequence[Column | str], out: str, label: str) -> DataFrame:
    """Dense 1-based number over the whole table in the given order.

    Range partitions are sorted and staged, so their bounds are sampled once; offsets come
    from one count per partition, a table as small as the partition count.
    """
    ranged = stage(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__slot", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftright("__slot", 33)
    ranged = ranged.withColumn("__part", part)
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    place = F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        ranged.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__off") + place + 1)
        .drop("__slot", "__part", "__off")
    )


def rank_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, label: str, most: int = BLOCK
) -> DataFrame:
    """0-based position in a group for any sort order; rows without a key are left out.

    Groups of up to ``most`` rows are sorted where their rows meet. Larger ones, fewer than one for ``most`` rows of the
    table, so that their keys may be broadcast, take the global numbering.
    """
    keyed = df.dropna(subset=list(keys))
    crowded = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1
    if crowded.isEmpty():
        return large(keyed.withColumn(out, place))
    crowded = F.broadcast(stage(crowded, label))
    numbered = number_rows(keyed.join(crowded, list(keys), "left_semi"), [*keys, *order], "__place", label)
    first = large(numbered.groupBy(*keys).agg(F.min("__place").alias("__first")))
    ranked = numbered.join(first, list(keys)).withColumn(out, F.col("__place") - F.col("__first")).drop("__place", "__first")
    return large(keyed.join(crowded, list(keys), "left_anti").withColumn(out, place).unionByName(ranked))

"""Block scans and global numbering against plain windows, with one group holding most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data, seen = [], set()
    for i in range(3000):
        group = 0 if rng.random() < 0.6 else rng.randint(1, 40)
        order = rng.randint(-500, 20000)
        if (group, order) not in seen:
            seen.add((group, order))
            data.append((group, order, rng.choice([None, i])))
    return spark.createDataFrame(data, "g long, o long, v long").cache()


def same(got, want):
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_rank_in_group(rows):
    w = Window.partitionBy("g").orderBy("o")
    got = scans.rank_in_group(rows, ["g"], "o", "n", block=64).select("g", "o", "n")
    same(got, rows.select("g", "o", (F.row_number().over(w) - 1).alias("n")))


def test_running_sum(rows):
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce("v", F.lit(1))
    got = scans.running_sum(rows, ["g"], "o", value, "s", block=64).select("g", "o", "s")
    same(got, rows.select("g", "o", F.sum(value).over(w).alias("s")))


@pytest.mark.parametrize("inclusive", [True, False])
def test_last_before(rows, inclusive):
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    got = scans.last_before(rows, ["g"], "o", F.col("v"), "l", block=64, inclusive=inclusive).select("g", "o", "l")
    same(got, rows.select("g", "o", F.last("v", ignorenulls=True).over(w).alias("l")))


def test_number_rows_is_dense(rows):
    got = scans.number_rows(rows, ["g", "o"], "n", "test").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))
    assert [(r.g, r.o) for r in got] == sorted((r.g, r.o) for r in got)


def test_rank_sorted(rows):
    w = Window.partitionBy("g").orderBy(F.col("o").desc())
    got = scans.rank_sorted(rows, ["g"], [F.col("o").desc()], "n", "test").select("g", "o", "n")
    same(got, rows.select("g", "o", (F.row_number().over(w) - 1).alias("n")))


def test_small_groups_are_ranked_without_numbering_the_table(spark, monkeypatch):
    rows = spark.createDataFrame([(g, v) for g in range(9) for v in range(g + 1)] + [(None, 1)], "g long, v long").repartition(4)
    want = sorted((g, v, g - v) for g in range(9) for v in range(g + 1))
    ranked = lambda **more: sorted(tuple(r) for r in scans.rank_sorted(rows, ["g"], [F.col("v").desc()], "at", "t", **more).collect())
    assert ranked(most=5) == want
    monkeypatch.setattr(scans, "number_rows", None)
    assert ranked() == want

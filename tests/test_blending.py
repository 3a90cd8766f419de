"""Blend modes on the whole 256 x 256 grid and the fold against plain Python."""


import pytest
from pyspark.sql import functions as F

from lamina.functions import blending as B


@pytest.fixture(scope="module")
def grid(spark):
    s = spark.range(256).select(F.col("id").alias("s"))
    d = spark.range(256).select(F.col("id").alias("d"))
    cols = [F.col("s").alias("sr"), F.lit(128).alias("sg"), (255 - F.col("s")).alias("sb"), F.lit(255).alias("sa")]
    cols += [F.col("d").alias("dr"), F.col("d").alias("dg"), F.lit(37).alias("db"), F.lit(255).alias("da")]
    return s.crossJoin(d).select("s", "d", *cols, F.lit(1.0).alias("alpha")).cache()


def near(x):
    return min(255, max(0, round(x)))


EXPECTED = {
    "normal": lambda s, d: s,
    "darken": min,
    "lighten": max,
    "multiply": lambda s, d: s * d // 255,
    "screen": lambda s, d: s + d - s * d // 255,
    "linear-dodge": lambda s, d: min(255, s + d),
    "linear-burn": lambda s, d: max(0, s + d - 255),
    "difference": lambda s, d: abs(s - d),
    "subtract": lambda s, d: max(0, d - s),
    "divide": lambda s, d: 0 if d == 0 else 255 if s == 0 else near(min(255, d / s * 255)),
    "color-dodge": lambda s, d: 0 if d == 0 else 255 if s == 255 else near(min(255, d * 255 / (255 - s))),
    "color-burn": lambda s, d: 255 if d == 255 else 0 if s == 0 else near(255 - min(255, (255 - d) / s * 255)),
    "pin-light": lambda s, d: min(2 * s, d) if s < 128 else max(2 * (s - 128), d),
    "linear-light": lambda s, d: near(d + 2 * s - 255 if s < 128 else d + 2 * (s - 128)),
}


@pytest.mark.parametrize("mode", list(EXPECTED))
def test_mode_on_grid(grid, mode):
    for row in B.blend_rows(grid, mode).select("s", "d", "r", "a").collect():
        assert (row.r, row.a) == (EXPECTED[mode](row.s, row.d), 255), (mode, row)


@pytest.mark.parametrize("mode", B.SEPARABLE_MODES + B.WHOLE_COLOR_MODES)
def test_tables_folds_and_expressions_agree(grid, mode):
    src = F.struct(*[F.col("s" + n).cast("bigint").alias(n) for n in "rgba"])
    dst = F.struct(*[F.col("d" + n).cast("bigint").alias(n) for n in "rgba"])
    some = grid.filter("(s * 7 + d) % 23 = 0").withColumn("alpha", F.lit(0.7)).withColumn("da", (F.col("d") + 9) % 256)
    got = B.blend_rows(some, mode).select("s", "d", "r", "g", "b", "a")
    one = some.withColumn("p", B.blend(mode, src, dst, F.col("alpha"))).select("s", "d", "p.*")
    any_ = some.withColumn("p", B.blend_any(F.lit(mode), src, dst, F.col("alpha"), (mode,))).select("s", "d", "p.*")
    want = sorted(map(tuple, got.collect()))
    assert want == sorted(map(tuple, one.collect()))
    assert want == sorted(map(tuple, any_.collect()))


def test_alpha_zero_keeps_backdrop(grid):
    rows = B.blend_rows(grid.withColumn("sa", F.lit(0)), "multiply")
    assert rows.filter("r <> dr or g <> dg or b <> db or a <> da").count() == 0


def test_user_rule(spark):
    px = lambda *v: F.struct(*[F.lit(c).cast("bigint").alias(n) for c, n in zip(v, "rgba")])
    swap = {"swap": lambda s, d: (s[2], s[1], s[0])}
    out = spark.range(1).select(B.blend_any(F.lit("swap"), px(1, 2, 3, 255), px(9, 9, 9, 255), F.lit(1.0), (), swap).alias("p"))
    assert tuple(out.first().p) == (3, 2, 1, 255)


def test_porter_duff_corner_cases(spark):
    px = lambda *v: F.struct(*[F.lit(c).cast("bigint").alias(n) for c, n in zip(v, "rgba")])
    out = spark.range(1).select(
        *[B.porter_duff(op, px(10, 20, 30, 255), px(200, 100, 50, 128), F.lit(1.0)).alias(op) for op in B.PORTER_DUFF_MODES]
    ).first()
    assert tuple(out["clear"]) == (0, 0, 0, 0)
    assert tuple(out["copy"]) == (10, 20, 30, 255)
    assert tuple(out["source-in"]) == (10, 20, 30, 128)
    assert tuple(out["source-out"]) == (10, 20, 30, 127)
    assert tuple(out["destination-in"]) == (200, 100, 50, 128)
    assert tuple(out["destination-out"]) == (0, 0, 0, 0)

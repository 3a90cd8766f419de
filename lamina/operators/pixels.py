"""Pixels as rows: masks, clipping, stacking, comparison, geometry.

Rows are ``(doc_id, seq_id, x, y, r, g, b, a)`` with BIGINT channels 0..255, not premultiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import blending as B
from lamina.operators.scans import rank_sorted
from lamina.session import stage

C = F.col
SPOT = ["x", "y"]
CHANNELS = ["r", "g", "b", "a"]
ALL_MODES = tuple(B.SEPARABLE_MODES + B.WHOLE_COLOR_MODES)

# Layers of one pixel that are folded in one go; taller stacks are folded in rounds.
MAX_STACK = 1024

DRAW, SAVE, MIX = 0, 1, 2


def _px(prefix: str = "") -> Column:
    return F.struct(*[C(prefix + n).cast("bigint").alias(n) for n in CHANNELS])


def _clear() -> Column:
    return F.struct(*[B.num(0).alias(n) for n in CHANNELS])


def mix_masked(group: Column, backdrop: Column, m: Column) -> Column:
    """Masked pass-through: both sides weighted by the mask, truncated separately."""
    return F.struct(
        *[(B.mul255(group[n], m) + B.mul255(backdrop[n], 255 - m)).alias(n) for n in CHANNELS]
    )


# -- folding ----------------------------------------------------------------------------------


def _step(modes: Sequence[str], grouped: bool):
    """Fold step over op structs; ``grouped`` folds also keep saved backdrops."""

    def draw(acc: Column, op: Column) -> Column:
        return B.blend_any(op["mode"], op["px"], acc, op["alpha"], modes)

    if not grouped:
        return draw

    def step(acc: Column, op: Column) -> Column:
        p, saved = acc["p"], acc["saved"]
        drawn = F.struct(draw(p, op).alias("p"), saved.alias("saved"))
        kept = F.struct(p.alias("p"), F.concat(saved, F.array(p)).alias("saved"))
        last = F.try_element_at(saved, F.lit(-1))
        mixed = F.struct(
            mix_masked(p, last, op["m"]).alias("p"),
            F.slice(saved, F.lit(1), F.greatest(F.size(saved) - 1, F.lit(0))).alias("saved"),
        )
        return F.when(op["kind"] == SAVE, kept).when(op["kind"] == MIX, mixed).otherwise(drawn)

    return step


def _op(grouped: bool) -> Column:
    fields = [C("z"), C("mode"), C("alpha"), _px().alias("px")]
    if grouped:
        fields += [C("kind"), C("m")]
    return F.struct(*fields)


def _start(grouped: bool, base: Column | None) -> Column:
    p = _clear() if base is None else base
    if not grouped:
        return p
    none = F.array().cast("array<struct<r:bigint,g:bigint,b:bigint,a:bigint>>")
    return F.struct(p.alias("p"), none.alias("saved"))


def stack_bound(ops: DataFrame, keys: Sequence[str]) -> int:
    """Most ops on one pixel. A narrow integer z proves a bound from column minima and maxima."""
    if dict(ops.dtypes)["z"] in ("int", "bigint"):
        low, high = ops.agg(F.min("z"), F.max("z")).first()
        if low is None or high - low < MAX_STACK:
            return 0 if low is None else high - low + 1
    return ops.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def fold_pixels(
    ops: DataFrame,
    keys: Sequence[str],
    modes: Sequence[str] = ALL_MODES,
    base: DataFrame | None = None,
    bound: int | None = None,
) -> DataFrame:
    """(keys, r, g, b, a): ops blended in order of ``z``, from transparent or from ``base``.

    ``ops``: keys, z (unique per pixel, any orderable type), mode, alpha, r, g, b, a and, for
    pass-through groups, kind and m. With ``base`` only its pixels come out. Stacks up to
    ``MAX_STACK`` fold in one aggregation; taller ones in rounds of that many layers, with the
    running pixel carried between rounds.
    """
    grouped = "kind" in ops.columns
    step = _step(modes, grouped)
    keys = list(keys)
    if bound is None:
        bound = stack_bound(ops, keys)
    rounds = max(1, -(-bound // MAX_STACK))
    if rounds > 1:
        ops = stage(rank_sorted(ops, keys, ["z"], "__at", "stack"), "stack")
    acc = None if base is None else base.select(*keys, _start(grouped, _px()).alias("__acc"))
    for i in range(rounds):
        part = ops if rounds == 1 else ops.filter(F.expr(f"`__at` div {MAX_STACK}") == i)
        stacks = part.groupBy(*keys).agg(F.sort_array(F.collect_list(_op(grouped))).alias("__ops"))
        none = F.slice("__ops", 1, 0)
        if acc is None:
            rows = stacks.select(*keys, "__ops", _start(grouped, None).alias("__acc"))
        else:
            rows = acc.join(stacks, keys, "left" if base is not None else "full").select(
                *keys, "__ops", F.coalesce("__acc", _start(grouped, None)).alias("__acc")
            )
        folded = F.when(C("__ops").isNull(), C("__acc")).otherwise(F.aggregate("__ops", C("__acc"), step))
        acc = rows.select(*keys, folded.alias("__acc"))
        if rounds > 1:
            acc = stage(acc, "fold")
    p = "__acc.p" if grouped else "__acc"
    return acc.select(*keys, *[C(f"{p}.{n}").alias(n) for n in CHANNELS])


def compose_pixels(
    pixels: DataFrame,
    keys: Sequence[str] = ("doc_id",),
    modes: Sequence[str] = ALL_MODES,
    bound: int | None = None,
) -> DataFrame:
    """Ordered blend of all layers on each pixel. ``pixels``: keys, x, y, z, mode, opacity, r, g, b, a."""
    ops = pixels.withColumn("alpha", C("opacity").cast("double") / 255)
    return fold_pixels(ops, [*keys, *SPOT], modes, bound=bound)


# -- masks and clipping -----------------------------------------------------------------------


def mask_pixels(pixels: DataFrame, masks: DataFrame, layers: DataFrame) -> DataFrame:
    """Alpha times mask; layers without ``mask_default`` pass unchanged.

    Outside the mask's own pixels its default, 0 or 255, applies.
    """
    facts = layers.filter("mask_default is not null").select("doc_id", "seq_id", "mask_default")
    rows = pixels.join(facts, ["doc_id", "seq_id"], "left").join(
        masks.select("doc_id", "seq_id", *SPOT, "m"), ["doc_id", "seq_id", *SPOT], "left"
    )
    m = F.when(C("mask_default").isNull(), 255).otherwise(F.coalesce("m", "mask_default")).cast("bigint")
    return rows.select("doc_id", "seq_id", *SPOT, "r", "g", "b", B.mul255(C("a").cast("bigint"), m).alias("a"))


def mask_pass_through(group: DataFrame, backdrop: DataFrame, mask: DataFrame, default: int = 0) -> DataFrame:
    """A pass-through group cut by its mask against what was below it."""
    keys = ["doc_id", *SPOT]
    g = group.select(*keys, _px().alias("__g"))
    d = backdrop.select(*keys, _px().alias("__d"))
    rows = g.join(d, keys, "full").join(mask.select(*keys, "m"), keys, "left")
    m = F.coalesce("m", F.lit(default)).cast("bigint")
    mixed = mix_masked(F.coalesce("__g", _clear()), F.coalesce("__d", _clear()), m)
    return rows.select(*keys, mixed.alias("p")).select(*keys, *[C("p." + n).alias(n) for n in CHANNELS])


def clip_group(base: DataFrame, clipped: DataFrame, modes: Sequence[str] = ALL_MODES) -> DataFrame:
    """Clipped layers blended onto an opaque copy of their base, which then gets its alpha back.

    ``base``: doc_id, group_id, x, y, channels. ``clipped``: the same with z, mode and opacity.
    """
    keys = ["doc_id", "group_id", *SPOT]
    return _clip_fold(base, clipped.withColumn("alpha", C("opacity").cast("double") / 255), keys, modes)


def _clip_fold(
    base: DataFrame, ops: DataFrame, keys: list[str], modes: Sequence[str], bound: int | None = None
) -> DataFrame:
    solid = base.select(*keys, "r", "g", "b", F.lit(255).cast("bigint").alias("a"))
    inside = ops.join(base.select(*keys), keys, "left_semi")
    painted = fold_pixels(inside, keys, modes, base=solid, bound=bound).drop("a")
    return painted.join(base.select(*keys, "a"), keys)


def clip_separately(base: DataFrame, clipped: DataFrame) -> DataFrame:
    """Clipped layers cut by the base's alpha, each to be blended alone with its own mode."""
    keys = ["doc_id", "group_id", *SPOT]
    alpha = base.select(*keys, C("a").alias("__ba"))
    cut = B.store(B.real(C("a")) * B.real(C("__ba")) / 255)
    return clipped.join(alpha, keys).withColumn("a", cut).drop("__ba")


# -- geometry and comparison ------------------------------------------------------------------


def place(pixels: DataFrame, docs: DataFrame) -> DataFrame:
    """Shift by the document's origin."""
    o = docs.select("doc_id", C("x").alias("__ox"), C("y").alias("__oy"))
    return pixels.join(o, "doc_id").withColumn("x", C("x") + C("__ox")).withColumn("y", C("y") + C("__oy")).drop("__ox", "__oy")


def clip_to_canvas(pixels: DataFrame, docs: DataFrame) -> DataFrame:
    """Pixels inside the canvas."""
    size = docs.select("doc_id", C("canvas_w").alias("__w"), C("canvas_h").alias("__h"))
    inside = (C("x") >= 0) & (C("y") >= 0) & (C("x") < C("__w")) & (C("y") < C("__h"))
    return pixels.join(size, "doc_id").filter(inside).drop("__w", "__h")


def auto_trim(pixels: DataFrame, extents: DataFrame) -> DataFrame:
    """Pixels inside the document's extent, moved so that it starts at the origin."""
    e = extents.select("doc_id", *[C(n).alias("__" + n) for n in ("x", "y", "width", "height")])
    x, y = C("x") - C("__x"), C("y") - C("__y")
    inside = (x >= 0) & (y >= 0) & (x < C("__width")) & (y < C("__height"))
    return (
        pixels.join(e, "doc_id")
        .filter(inside)
        .withColumns({"x": x, "y": y})
        .drop("__x", "__y", "__width", "__height")
    )


def flip_pixels(pixels: DataFrame, docs: DataFrame, axis: str) -> DataFrame:
    """Mirror inside the canvas: flipx, flipy or flipxy."""
    size = docs.select("doc_id", C("canvas_w").alias("__w"), C("canvas_h").alias("__h"))
    x = C("__w") - 1 - C("x") if axis in ("flipx", "flipxy") else C("x")
    y = C("__h") - 1 - C("y") if axis in ("flipy", "flipxy") else C("y")
    return pixels.join(size, "doc_id").withColumns({"x": x, "y": y}).drop("__w", "__h")


def image_diff(a: DataFrame, b: DataFrame, tol: int = 2, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keys, max_delta, over): premultiplied distance of two pictures; missing pixels are clear."""
    on = [*keys, *SPOT]

    def shown(df: DataFrame, name: str) -> DataFrame:
        alpha = C("a").cast("bigint")
        parts = [B.premultiply(C(n).cast("bigint"), alpha).alias(n) for n in "rgb"]
        return df.select(*on, F.struct(*parts, alpha.alias("a")).alias(name))

    rows = shown(a, "p").join(shown(b, "q"), on, "full")
    gap = F.greatest(
        *[F.abs(F.coalesce(C("p." + n), F.lit(0)) - F.coalesce(C("q." + n), F.lit(0))) for n in CHANNELS]
    )
    return rows.groupBy(*keys).agg(F.max(gap).alias("max_delta"), F.count_if(gap > tol).alias("over"))


def channels_to_pixels(planes: DataFrame) -> DataFrame:
    """Planar arrays (r, g, b, a or null) and width to pixel rows; missing alpha is opaque."""
    alpha = F.coalesce("a", F.array_repeat(F.lit(255).cast("bigint"), F.size("r")))
    rows = planes.select(
        "doc_id", "seq_id", "width", F.posexplode(F.arrays_zip("r", "g", "b", alpha.alias("a"))).alias("at", "p")
    )
    return rows.select(
        "doc_id",
        "seq_id",
        (C("at") % C("width")).alias("x"),
        F.floor(C("at") / C("width")).alias("y"),
        *[C("p." + n).alias(n) for n in CHANNELS],
    )


GAMMA = 2.2  # fixed value


def downscale(pixels: DataFrame, docs: DataFrame, scale: float) -> DataFrame:
    """Area average in linear light, weighted by alpha. ``docs`` has canvas_w and canvas_h."""
    target = lambda side: F.greatest(F.lit(1), F.floor(C(side) * scale)).cast("bigint")
    size = docs.select("doc_id", C("canvas_w").alias("__w"), C("canvas_h").alias("__h"), target("canvas_w").alias("__tw"), target("canvas_h").alias("__th"))
    rows = pixels.join(size, "doc_id")

    def spans(at: str, full: str, small: str) -> Column:
        """Target cells a source pixel reaches on one axis, with the covered share."""
        ratio = C(small) / C(full)
        lo, hi = C(at) * ratio, (C(at) + 1) * ratio
        first = F.floor(lo)
        # nudged so that a right edge on a cell border does not reach into the next cell
        last = F.least(C(small) - 1, F.greatest(first, F.ceil(hi - 1e-9) - 1))
        return F.transform(
            F.sequence(first, last),
            lambda t: F.struct(t.alias("t"), (F.least(hi, t + 1.0) - F.greatest(lo, t + 0.0)).alias("w")),
        )

    rows = rows.withColumn("sx", F.explode(spans("x", "__w", "__tw"))).withColumn("sy", F.explode(spans("y", "__h", "__th")))
    w = C("sx.w") * C("sy.w")
    wa = w * C("a")
    light = lambda n: F.sum(wa * F.pow(C(n) / 255, F.lit(GAMMA))).alias(n)
    sums = rows.groupBy("doc_id", C("sx.t").alias("x"), C("sy.t").alias("y")).agg(
        light("r"), light("g"), light("b"), F.sum(wa).alias("wa"),
        F.any_value(C("__tw") * C("__th") / (C("__w") * C("__h"))).alias("unit"),
    )
    back = lambda n: F.when(C("wa") > 0, B.store(F.pow(C(n) / C("wa"), F.lit(1 / GAMMA)) * 255)).otherwise(B.num(0)).alias(n)
    # missing source pixels are clear, so alpha is divided by the whole cell, whose area is 1
    return sums.select("doc_id", "x", "y", back("r"), back("g"), back("b"), B.store(C("wa")).alias("a"))

"""Blend modes as column expressions over 8-bit channels.

Channels are BIGINT 0..255. ``mul255`` keeps the fixed-point product of the byte
format: ``x * y * 32897 >> 23`` is ``x * y / 255`` without the fraction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

# Fixed-point reciprocal of 255 and its scaled one.
RECIP = 32897
ONE = 8388735

# Blend modes a layer may name.
SEPARABLE_MODES = [
    "normal", "darken", "multiply", "color-burn", "linear-burn",
    "lighten", "screen", "color-dodge", "linear-dodge",
    "overlay", "soft-light", "hard-light", "vivid-light", "linear-light", "pin-light", "hard-mix",
    "difference", "exclusion", "subtract", "divide",
]
WHOLE_COLOR_MODES = ["darker-color", "lighter-color", "hue", "saturation", "color", "luminosity"]
COPY_MODES = ["copy-alpha", "copy-opaque"]
BLEND_MODES = SEPARABLE_MODES + WHOLE_COLOR_MODES + COPY_MODES
PORTER_DUFF_MODES = [
    "clear", "copy", "destination", "source-over", "destination-over", "source-in",
    "destination-in", "source-out", "destination-out", "source-atop", "destination-atop", "xor",
]


def num(v) -> Column:
    return F.lit(v).cast("bigint")


def shr(v: Column, n: int) -> Column:
    return F.shiftright(v, n)


def to_int(v: Column) -> Column:
    """Drop the fraction toward zero."""
    return v.cast("bigint")


def mul255(x: Column, y: Column) -> Column:
    return shr(x * y * RECIP, 23)


def store(v: Column) -> Column:
    """Value kept by a clamped byte: half to even, then 0..255."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(v.cast("double")))).cast("bigint")


def real(v: Column) -> Column:
    return v.cast("double")


def premultiply(c: Column, a: Column) -> Column:
    return mul255(c, a)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside lambdas, where common subexpressions are not shared."""
    return F.transform(F.array(value), body)[0]


# -- colour helpers ---------------------------------------------------------------------------


def lum(r: Column, g: Column, b: Column) -> Column:
    return shr(r * 77 + g * 151 + b * 28, 8)


def sat(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def _rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"))


def _triple(pixel: Column) -> RGB:
    return pixel["r"], pixel["g"], pixel["b"]


def _clip(color: Column) -> Column:
    """``clip_color`` on a struct of luminosity in 0..255, giving a struct; inputs are bound once."""
    return _clip_around(color, lum(*_triple(color)))


def _clip_around(color: Column, base: Column) -> Column:
    r, g, b = _triple(color)
    facts = F.struct(
        r.alias("r"), g.alias("g"), b.alias("b"),
        base.alias("base"), F.least(r, g, b).alias("low"), F.greatest(r, g, b).alias("high"),
    )

    def fix(v: Column, c: Column) -> Column:
        base, low, high = v["base"], v["low"], v["high"]
        lifted = F.when(low < 0, real(base) + real((c - base) * base) / real(base - low)).otherwise(
            real(c)
        )
        capped = real(base) + ((lifted - real(base)) * real(255 - base)) / real(high - base)
        return to_int(F.when(high > 255, capped).otherwise(lifted))

    return let(facts, lambda v: _rgb(*(fix(v, c) for c in _triple(v))))


def _relit(color: Column, target: Column) -> Column:
    """``set_lum`` on a struct, giving a struct."""

    def shifted(v: Column) -> Column:
        shift = v["t"] - lum(*_triple(v["c"]))
        return let(shift, lambda k: _rgb(*(c + k for c in _triple(v["c"]))))

    bound = F.struct(color.alias("c"), target.alias("t"))
    return let(let(bound, shifted), _clip)


def _saturated(color: RGB, target: Column) -> Column:
    """``set_sat`` as a struct with its inputs bound once."""
    bound = F.struct(F.least(*color).alias("low"), sat(*color).alias("span"), target.alias("t"))

    def spread(v: Column) -> Column:
        scaled = [to_int(real((c - v["low"]) * v["t"]) / real(v["span"])) for c in color]
        return F.when(v["span"] == 0, _rgb(num(0), num(0), num(0))).otherwise(_rgb(*scaled))

    return let(bound, spread)


def clip_color(r: Column, g: Column, b: Column) -> RGB:
    """Pull channels back into range around their luminosity, keeping the first maximum.

    Luminosity is held to 0..255 first, so colours darker or lighter than that become black or white.
    """
    return _triple(_clip_around(_rgb(r, g, b), F.greatest(num(0), F.least(num(255), lum(r, g, b)))))


def set_lum(r: Column, g: Column, b: Column, target: Column) -> RGB:
    return _triple(_relit(_rgb(r, g, b), target))


def set_sat(r: Column, g: Column, b: Column, target: Column) -> RGB:
    return _triple(_saturated((r, g, b), target))


# -- modes ------------------------------------------------------------------------------------


def _burn(s: Column, d: Column) -> Column:
    return (
        F.when(d == 255, F.lit(255.0))
        .when(s == 0, F.lit(0.0))
        .otherwise(255 - F.least(F.lit(255.0), real(255 - d) / real(s) * 255))
    )


def _dodge(s: Column, d: Column) -> Column:
    return (
        F.when(d == 0, F.lit(0.0))
        .when(s == 255, F.lit(255.0))
        .otherwise(F.least(F.lit(255.0), real(d * 255) / real(255 - s)))
    )


def _overlay(s: Column, d: Column) -> Column:
    bright = 255 - shr((255 - (d - 128) * 2) * (255 - s) * RECIP, 23)
    return F.when(d < 128, shr(s * d * RECIP, 22)).otherwise(bright)


def _soft(s: Column, d: Column) -> Column:
    dark = d - mul255(mul255(255 - s * 2, d), 255 - d)
    cubic = shr((shr((d * 16 - 3060) * RECIP, 23) * d + 1020) * d * RECIP, 23)
    root = F.when(d < 64, real(cubic)).otherwise(F.sqrt(real(d) / 255) * 255)
    bright = d + shr(to_int(real(s * 2 - 255) * (root - real(d)) * RECIP), 23)
    return F.when(s < 128, dark).otherwise(bright)


def _hard(s: Column, d: Column) -> Column:
    t = s * 2 - 255
    return F.when(s < 128, shr(d * s * RECIP, 22)).otherwise(d + t - mul255(d, t))


def _vivid(s: Column, d: Column) -> Column:
    t = (s - 128) * 2 + 1
    return (
        F.when(s == 0, F.lit(0.0))
        .when(s < 128, F.greatest(F.lit(0.0), 255 - real((255 - d) * 255) / real(s * 2)))
        .when(t == 255, F.lit(255.0))
        .otherwise(F.least(F.lit(255.0), real(d * 255) / real(255 - t)))
    )


def _hard_mix(s: Column, d: Column) -> Column:
    level = F.when((s >= 128) & (d == 0), F.lit(0.0)).otherwise(_vivid(s, d))
    return F.when(level < 128, num(0)).otherwise(num(255))


def _divide(s: Column, d: Column) -> Column:
    return (
        F.when(d == 0, F.lit(0.0))
        .when(s == 0, F.lit(255.0))
        .otherwise(F.least(F.lit(255.0), real(d) / real(s) * 255))
    )


def _pin(s: Column, d: Column) -> Column:
    return F.when(s < 128, F.least(s * 2, d)).otherwise(F.greatest((s - 128) * 2, d))


_SEPARABLE: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda s, d: s,
    "darken": lambda s, d: F.least(s, d),
    "multiply": mul255,
    "color-burn": _burn,
    "linear-burn": lambda s, d: F.greatest(num(0), d + s - 255),
    "lighten": lambda s, d: F.greatest(s, d),
    "screen": lambda s, d: s + d - mul255(s, d),
    "color-dodge": _dodge,
    "linear-dodge": lambda s, d: s + d,
    "overlay": _overlay,
    "soft-light": _soft,
    "hard-light": _hard,
    "vivid-light": _vivid,
    "linear-light": lambda s, d: F.when(s < 128, d + s * 2 - 255).otherwise(d + (s - 128) * 2),
    "pin-light": _pin,
    "hard-mix": _hard_mix,
    "difference": lambda s, d: F.abs(d - s),
    "exclusion": lambda s, d: d + s - shr(d * s * RECIP, 22),
    "subtract": lambda s, d: F.greatest(num(0), d - s),
    "divide": _divide,
}


_WHOLE: dict[str, Callable[[RGB, RGB], Column]] = {
    "darker-color": lambda s, d: F.when(lum(*s) < lum(*d), _rgb(*s)).otherwise(_rgb(*d)),
    "lighter-color": lambda s, d: F.when(lum(*s) > lum(*d), _rgb(*s)).otherwise(_rgb(*d)),
    "hue": lambda s, d: _relit(_saturated(s, sat(*d)), lum(*d)),
    "saturation": lambda s, d: _relit(_saturated(d, sat(*s)), lum(*d)),
    "color": lambda s, d: _relit(_rgb(*s), lum(*d)),
    "luminosity": lambda s, d: _relit(_rgb(*d), lum(*s)),
}


def _mix_color(mode: str, s: RGB, d: RGB, finish: Callable[[RGB], Column]) -> Column:
    """``finish`` applied to the blended colour B of one mode, before alpha weighting.

    Whole-colour modes are bound once; per-channel modes stay plain expressions.
    """
    if mode in _WHOLE:
        return let(_WHOLE[mode](s, d), lambda v: finish(_triple(v)))
    rule = _SEPARABLE["normal" if mode == "source-over" else mode]
    return finish(tuple(rule(a, b) for a, b in zip(s, d)))


def blend_supported(mode: Column) -> Column:
    return mode.isin(*BLEND_MODES, "source-over")


def _pixel(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def weights(sa: Column, da: Column, alpha: Column) -> tuple[Column, Column, Column]:
    """Shares of the blend, the bare source and the bare backdrop."""
    t = to_int(real(sa) * alpha * RECIP)
    return shr(t * da, 23), shr(t * (255 - da), 23), shr((num(ONE) - t) * da, 23)


def blend(mode: str, src: Column, dst: Column, alpha: Column) -> Column:
    """Blend pixel struct ``src`` over ``dst`` with one fixed mode; plain, codegen-able."""
    s = (src["r"], src["g"], src["b"])
    d = (dst["r"], dst["g"], dst["b"])
    if mode == "copy-alpha":
        return _pixel(*d, store(real(src["a"]) * alpha))
    if mode == "copy-opaque":
        return _pixel(*s, store(alpha * 255))
    a1, a2, a3 = weights(src["a"], dst["a"], alpha)
    a = a1 + a2 + a3

    def mixed(color: RGB) -> Column:
        out = [
            F.when(a > 0, store(real(m * a1 + x * a2 + y * a3) / real(a))).otherwise(y)
            for m, x, y in zip(color, s, d)
        ]
        return _pixel(*out, a)

    return _mix_color(mode, s, d, mixed)


Rule = Callable[[RGB, RGB], RGB]

#: Modes that draw the source as it is.
PLAIN_MODES = ("normal", "source-over", "pass-through")


def blend_any(
    mode: Column,
    src: Column,
    dst: Column,
    alpha: Column,
    modes: Iterable[str] = tuple(SEPARABLE_MODES + WHOLE_COLOR_MODES),
    rules: dict[str, Rule] | None = None,
) -> Column:
    """Blend with the mode named per row, for folds inside lambdas.

    ``rules`` adds user modes: a function of two colour triples giving a third.
    A mode that isn't named is an error, so that nothing is drawn as normal by mistake.
    """
    rules = rules or {}
    share = F.struct(*[w.alias(n) for w, n in zip(weights(src["a"], dst["a"], alpha), "xyz")])

    def shade(w: Column) -> Column:
        a = w["x"] + w["y"] + w["z"]
        s = (src["r"], src["g"], src["b"])
        d = (dst["r"], dst["g"], dst["b"])

        def mixed(b: Sequence[Column]) -> Column:
            out = [
                store(real(m * w["x"] + p * w["y"] + q * w["z"]) / real(a))
                for m, p, q in zip(b, s, d)
            ]
            return _pixel(*out, a)

        chain = None
        for name in [*rules, *(m for m in modes if m != "normal")]:
            body = mixed(rules[name](s, d)) if name in rules else _mix_color(name, s, d, mixed)
            chain = F.when(mode == name, body) if chain is None else chain.when(mode == name, body)
        unknown = F.raise_error(F.concat(F.lit("blend mode not listed: "), F.coalesce(mode, F.lit("null"))))
        plain = F.when(F.coalesce(mode, F.lit("")).isin(*PLAIN_MODES), mixed(s)).otherwise(unknown)
        shaded = plain if chain is None else chain.otherwise(plain)
        return F.when(a > 0, shaded).otherwise(_pixel(*d, a))

    return let(share, shade)


# Share of source and backdrop kept by each compositing operator, as a constant
# plus a multiple of the other side's alpha: (source, source slope, backdrop, backdrop slope).
COVERAGE = {
    "clear": (0, 0, 0, 0),
    "copy": (1, 0, 0, 0),
    "destination": (0, 0, 1, 0),
    "source-over": (1, 0, 1, -1),
    "destination-over": (1, -1, 1, 0),
    "source-in": (0, 1, 0, 0),
    "destination-in": (0, 0, 0, 1),
    "source-out": (1, -1, 0, 0),
    "destination-out": (0, 0, 1, -1),
    "source-atop": (0, 1, 1, -1),
    "destination-atop": (1, -1, 0, 1),
    "xor": (1, -1, 1, -1),
}


def coverage(op: str) -> Column:
    """The operator's four coefficients as a struct of doubles."""
    return F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("s0", "s1", "d0", "d1"), COVERAGE[op])])


def composite(cover: Column, src: Column, dst: Column, alpha: Column) -> Column:
    """Compositing on unpremultiplied pixels with given coefficients, stored back as bytes."""
    sa, da = real(src["a"]) * alpha / 255, real(dst["a"]) / 255
    ws, wd = sa * (cover["s0"] + cover["s1"] * da), da * (cover["d0"] + cover["d1"] * sa)
    out = ws + wd

    def channel(n: str) -> Column:
        mixed = store((ws * real(src[n]) + wd * real(dst[n])) / out)
        return F.when(out > 0, mixed).otherwise(num(0))

    return _pixel(channel("r"), channel("g"), channel("b"), store(out * 255))


def porter_duff(op: str, src: Column, dst: Column, alpha: Column) -> Column:
    return composite(coverage(op), src, dst, alpha)


# -- whole tables -----------------------------------------------------------------------------


def _named(prefix: str) -> RGB:
    return tuple(F.col(prefix + n) for n in "rgb")


def _staged_lum(df: DataFrame, prefix: str, target: Column) -> DataFrame:
    """Adds b_r, b_g, b_b: colour ``prefix`` brought to luminosity ``target``, step by step."""
    color = _named(prefix)
    df = df.withColumn("__shift", target - lum(*color))
    df = df.withColumns({"__x" + n: c + F.col("__shift") for n, c in zip("rgb", color)})
    x = _named("__x")
    # whole numbers below 2^53 are exact as doubles, and double steps carry no overflow checks
    facts = {"__base": lum(*x), "__low": F.least(*x), "__high": F.greatest(*x)}
    df = df.withColumns({k: real(v) for k, v in facts.items()} | {"__x" + n: real(c) for n, c in zip("rgb", x)})
    base, low, high = F.col("__base"), F.col("__low"), F.col("__high")
    df = df.withColumns({"__drop": base - low, "__rise": high - base, "__room": 255 - base})
    drop, rise, room = F.col("__drop"), F.col("__rise"), F.col("__room")
    lift = lambda c: F.when(low < 0, base + (c - base) * base / drop).otherwise(c)
    df = df.withColumns({"__y" + n: lift(c) for n, c in zip("rgb", x)})
    cap = lambda c: base + (c - base) * room / rise
    return df.withColumns(
        {"__b" + n: to_int(F.when(high > 255, cap(c)).otherwise(c)) for n, c in zip("rgb", _named("__y"))}
    )


def _staged_color(df: DataFrame, mode: str) -> DataFrame:
    """Adds the blended colour B of one mode as columns __br, __bg, __bb."""
    s, d = _named("s"), _named("d")
    if mode in ("hue", "saturation"):
        color, other = (s, d) if mode == "hue" else (d, s)
        facts = {"__min": F.least(*color), "__span": sat(*color), "__to": sat(*other)}
        df = df.withColumns({k: real(v) for k, v in facts.items()})
        low, span, to = F.col("__min"), F.col("__span"), F.col("__to")
        spread = lambda c: F.when(span == 0, num(0)).otherwise(to_int((real(c) - low) * to / span))
        df = df.withColumns({"__z" + n: spread(c) for n, c in zip("rgb", color)})
        return _staged_lum(df, "__z", lum(*d))
    if mode in ("color", "luminosity"):
        prefix, target = ("s", lum(*d)) if mode == "color" else ("d", lum(*s))
        return _staged_lum(df, prefix, target)
    if mode in ("darker-color", "lighter-color"):
        df = df.withColumn("__gap", lum(*s) - lum(*d))
        wins = F.col("__gap") < 0 if mode == "darker-color" else F.col("__gap") > 0
        return df.withColumns({"__b" + n: F.when(wins, a).otherwise(b) for n, a, b in zip("rgb", s, d)})
    rule = _SEPARABLE["normal" if mode == "source-over" else mode]
    return df.withColumns({"__b" + n: rule(a, b) for n, a, b in zip("rgb", s, d)})


def blend_rows(df: DataFrame, mode: str) -> DataFrame:
    """Blend a table of pixel pairs with one mode: adds r, g, b, a.

    ``df`` has sr, sg, sb, sa over dr, dg, db, da, and ``alpha``. Shared values become columns
    of their own step, so each step compiles to a small method that the JVM optimises, and
    nothing runs in an interpreted lambda. A missing channel counts as 0.
    """
    keep = [c for c in df.columns if c not in ("r", "g", "b", "a")]
    channels = [p + n for p in "sd" for n in "rgba"]
    rows = df.withColumns({c: F.coalesce(F.col(c).cast("bigint"), num(0)) for c in channels})
    if mode == "copy-alpha":
        out = {"r": F.col("dr"), "g": F.col("dg"), "b": F.col("db"), "a": store(real(F.col("sa")) * F.col("alpha"))}
        return rows.select(*keep, *[v.alias(k) for k, v in out.items()])
    if mode == "copy-opaque":
        out = {"r": F.col("sr"), "g": F.col("sg"), "b": F.col("sb"), "a": store(F.col("alpha") * 255)}
        return rows.select(*keep, *[v.alias(k) for k, v in out.items()])
    rows = rows.withColumn("__t", to_int(real(F.col("sa")) * F.col("alpha") * RECIP))
    t, da = F.col("__t"), F.col("da")
    rows = rows.withColumns(
        {"__w1": shr(t * da, 23), "__w2": shr(t * (255 - da), 23), "__w3": shr((num(ONE) - t) * da, 23)}
    )
    rows = _staged_color(rows.withColumn("__a", F.col("__w1") + F.col("__w2") + F.col("__w3")), mode)
    w1, w2, w3, a = (F.col(c) for c in ("__w1", "__w2", "__w3", "__a"))
    mixed = [
        F.when(a > 0, store(real(F.col("__b" + n) * w1 + F.col("s" + n) * w2 + F.col("d" + n) * w3) / real(a)))
        .otherwise(F.col("d" + n))
        .alias(n)
        for n in "rgb"
    ]
    return rows.select(*keep, *mixed, a.alias("a"))

"""One query per blend mode, over pixel pairs read off the line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.registry import register, table
from lamina.catalog.scalars import sql_clip, sql_set_sat
from lamina.functions import blending as B

SQL_PAIRS = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_partkey % 256 AS sr, (l_suppkey * 7) % 256 AS sg, l_quantity::BIGINT * 5 AS sb,
    least(255, l_linenumber::BIGINT * 40) AS sa,
    l_orderkey % 256 AS dr, round(l_discount * 100)::BIGINT * 25 AS dg, floor(l_extendedprice)::BIGINT % 256 AS db,
    CASE l_returnflag WHEN 'A' THEN 255 WHEN 'N' THEN 128 ELSE 0 END::BIGINT AS da,
    (255 - round(l_tax * 100)::BIGINT * 20)::DOUBLE / 255 AS alpha FROM lineitem"""


def pairs(spark, sf):
    c = F.col
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (c("l_partkey") % 256).alias("sr"),
        (c("l_suppkey") * 7 % 256).alias("sg"),
        (c("l_quantity").cast("bigint") * 5).alias("sb"),
        F.least(F.lit(255), c("l_linenumber").cast("bigint") * 40).cast("bigint").alias("sa"),
        (c("l_orderkey") % 256).alias("dr"),
        (F.round(c("l_discount") * 100).cast("bigint") * 25).alias("dg"),
        (F.floor("l_extendedprice").cast("bigint") % 256).alias("db"),
        F.when(c("l_returnflag") == "A", 255).when(c("l_returnflag") == "N", 128).otherwise(0)
        .cast("bigint").alias("da"),
        ((255 - F.round(c("l_tax") * 100).cast("bigint") * 20).cast("double") / 255).alias("alpha"),
    )


# Formula of each mode in SQL; {s} and {d} are channel names.
_M = "(({0}) * 32897 >> 23)"
_VIVID = """CASE WHEN {s} = 0 THEN 0.0 WHEN {s} < 128 THEN greatest(0.0, 255 - ((255 - {d}) * 255)::DOUBLE / ({s} * 2)::DOUBLE)
    WHEN {s} = 255 THEN 255.0 ELSE least(255.0, ({d} * 255)::DOUBLE / (254 - ({s} - 128) * 2)::DOUBLE) END"""
SQL_SEPARABLE = {
    "normal": "{s}",
    "darken": "least({s}, {d})",
    "multiply": "{s} * {d} * 32897 >> 23",
    "color-burn": "CASE WHEN {d} = 255 THEN 255.0 WHEN {s} = 0 THEN 0.0 ELSE 255 - least(255.0, (255 - {d})::DOUBLE / {s}::DOUBLE * 255) END",
    "linear-burn": "greatest(0, {d} + {s} - 255)",
    "lighten": "greatest({s}, {d})",
    "screen": "{s} + {d} - ({s} * {d} * 32897 >> 23)",
    "color-dodge": "CASE WHEN {d} = 0 THEN 0.0 WHEN {s} = 255 THEN 255.0 ELSE least(255.0, ({d} * 255)::DOUBLE / (255 - {s})::DOUBLE) END",
    "linear-dodge": "{s} + {d}",
    "overlay": "CASE WHEN {d} < 128 THEN ({s} * {d} * 32897) >> 22 ELSE 255 - (((255 - ({d} - 128) * 2) * (255 - {s}) * 32897) >> 23) END",
    "soft-light": """CASE WHEN {s} < 128 THEN {d} - (((((255 - {s} * 2) * {d} * 32897) >> 23) * (255 - {d}) * 32897) >> 23)
        ELSE {d} + floor(trunc((({s} * 2 - 255)::DOUBLE * (CASE WHEN {d} < 64 THEN
        ((((((({d} * 16 - 3060) * 32897)::DOUBLE / 8388608).floor()::BIGINT) * {d} + 1020) * {d} * 32897) >> 23)::DOUBLE
        ELSE sqrt({d}::DOUBLE / 255) * 255 END - {d}::DOUBLE) * 32897)) / 8388608) END""",
    "hard-light": "CASE WHEN {s} < 128 THEN ({d} * {s} * 32897) >> 22 ELSE {d} + ({s} * 2 - 255) - (({d} * ({s} * 2 - 255) * 32897) >> 23) END",
    "vivid-light": _VIVID,
    "linear-light": "CASE WHEN {s} < 128 THEN {d} + {s} * 2 - 255 ELSE {d} + ({s} - 128) * 2 END",
    "pin-light": "CASE WHEN {s} < 128 THEN least({s} * 2, {d}) ELSE greatest(({s} - 128) * 2, {d}) END",
    "hard-mix": "CASE WHEN (CASE WHEN {s} >= 128 AND {d} = 0 THEN 0.0 ELSE " + _VIVID + " END) < 128 THEN 0 ELSE 255 END",
    "difference": "abs({d} - {s})",
    "exclusion": "{d} + {s} - (({d} * {s} * 32897) >> 22)",
    "subtract": "greatest(0, {d} - {s})",
    "divide": "CASE WHEN {d} = 0 THEN 0.0 WHEN {s} = 0 THEN 255.0 ELSE least(255.0, {d}::DOUBLE / {s}::DOUBLE * 255) END",
}
SQL_WEIGHTS = f"""SELECT *, (t * da) >> 23 AS a1, (t * (255 - da)) >> 23 AS a2, ((8388735 - t) * da) >> 23 AS a3
    FROM (SELECT *, trunc(sa::DOUBLE * alpha * 32897)::BIGINT AS t FROM ({SQL_PAIRS}))"""


def sql_store(x: str) -> str:
    return f"least(255.0, greatest(0.0, round_even({x}, 0)))::BIGINT"


def sql_mix(source: str) -> str:
    """Final pixel from a source that has br, bg, bb beside the weights."""
    mixed = ", ".join(
        f"CASE WHEN a1 + a2 + a3 > 0 THEN "
        + sql_store(f"((b{c} * a1 + s{c} * a2 + d{c} * a3)::DOUBLE / (a1 + a2 + a3)::DOUBLE)")
        + f" ELSE d{c} END AS {c}"
        for c in "rgb"
    )
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {mixed}, a1 + a2 + a3 AS a FROM ({source})"""


def _sql_separable(mode: str) -> str:
    f = SQL_SEPARABLE[mode]
    terms = ", ".join(f"({f.format(s='s' + c, d='d' + c)}) AS b{c}" for c in "rgb")
    return sql_mix(f"SELECT *, {terms} FROM ({SQL_WEIGHTS})")


_LUM = "((77 * {0}r + 151 * {0}g + 28 * {0}b) // 256)"
_SAT = "(greatest({0}r, {0}g, {0}b) - least({0}r, {0}g, {0}b))"


def _sql_set_lum(source: str, p: str, target: str) -> str:
    """Adds cr, cg, cb: colour ``p`` shifted to luminosity ``target``."""
    own = _LUM.format(p)
    shifted = ", ".join(f"{p}{c} + {target} - {own} AS x{c}" for c in "rgb")
    return sql_clip(f"SELECT *, {shifted} FROM ({source})", "xr", "xg", "xb")


def _sql_whole(mode: str) -> str:
    if mode in ("darker-color", "lighter-color"):
        op = "<" if mode == "darker-color" else ">"
        terms = ", ".join(
            f"CASE WHEN {_LUM.format('s')} {op} {_LUM.format('d')} THEN s{c} ELSE d{c} END AS b{c}" for c in "rgb"
        )
        return sql_mix(f"SELECT *, {terms} FROM ({SQL_WEIGHTS})")
    source, p, target = SQL_WEIGHTS, "s", _LUM.format("d")
    if mode in ("hue", "saturation"):
        p, q = ("s", "d") if mode == "hue" else ("d", "s")
        terms = ", ".join(
            f"{sql_set_sat(p + c, p + 'r', p + 'g', p + 'b', _SAT.format(q))} AS y{c}" for c in "rgb"
        )
        source, p = f"SELECT *, {terms} FROM ({SQL_WEIGHTS})", "y"
    elif mode == "luminosity":
        p, target = "d", _LUM.format("s")
    lumed = _sql_set_lum(source, p, target)
    return sql_mix(f"SELECT *, cr AS br, cg AS bg, cb AS bb FROM ({lumed})")


def _sql_copy(mode: str) -> str:
    if mode == "copy-alpha":
        return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dr AS r, dg AS g, db AS b,
            {sql_store('sa::DOUBLE * alpha')} AS a FROM ({SQL_PAIRS})"""
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sr AS r, sg AS g, sb AS b,
        {sql_store('alpha * 255')} AS a FROM ({SQL_PAIRS})"""


def _sql_for(mode: str) -> str:
    if mode in SQL_SEPARABLE:
        return _sql_separable(mode)
    if mode in B.COPY_MODES:
        return _sql_copy(mode)
    return _sql_whole(mode)


def _blend_query(mode: str):
    def run(spark, sf):
        rows = B.blend_rows(pairs(spark, sf), mode)
        return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r", "g", "b", "a")

    return run


for _mode in B.BLEND_MODES:
    register("blend_" + _mode.replace("-", "_"), _sql_for(_mode))(_blend_query(_mode))


_SQL_COVER = {
    "clear": ("0.0", "0.0"), "copy": ("1.0", "0.0"), "destination": ("0.0", "1.0"),
    "source-over": ("1.0", "1 - pa"), "destination-over": ("1 - qa", "1.0"), "source-in": ("qa", "0.0"),
    "destination-in": ("0.0", "pa"), "source-out": ("1 - qa", "0.0"), "destination-out": ("0.0", "1 - pa"),
    "source-atop": ("qa", "1 - pa"), "destination-atop": ("1 - qa", "pa"), "xor": ("1 - qa", "1 - pa"),
}


def _sql_porter_duff() -> str:
    arms = []
    for op in B.PORTER_DUFF_MODES:
        fs, fd = _SQL_COVER[op]
        chans = ", ".join(
            f"CASE WHEN ws + wd > 0 THEN {sql_store(f'(ws * s{c}::DOUBLE + wd * d{c}::DOUBLE) / (ws + wd)')} ELSE 0 END AS {c}"
            for c in "rgb"
        )
        arms.append(
            f"""SELECT '{op}' AS op, l_orderkey, l_linenumber, l_partkey, l_suppkey, {chans},
                {sql_store('(ws + wd) * 255')} AS a FROM (SELECT *, pa * ({fs}) AS ws, qa * ({fd}) AS wd
                FROM (SELECT *, sa::DOUBLE * alpha / 255 AS pa, da::DOUBLE / 255 AS qa FROM ({SQL_PAIRS})))"""
        )
    return " UNION ALL ".join(arms)


@register("porter_duff", _sql_porter_duff())
def _porter_duff(spark, sf):
    """All twelve operators at once: one scan, one row per pair and operator."""
    ops = F.array(
        *[F.struct(F.lit(op).alias("op"), B.coverage(op).alias("cover")) for op in B.PORTER_DUFF_MODES]
    )
    keys = ["op", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pixel = lambda side: F.struct(*[F.col(side + n).alias(n) for n in "rgba"])
    return (
        pairs(spark, sf)
        .select("*", F.inline(ops))
        .select(*keys, B.composite(F.col("cover"), pixel("s"), pixel("d"), F.col("alpha")).alias("p"))
        .select(*keys, "p.r", "p.g", "p.b", "p.a")
    )

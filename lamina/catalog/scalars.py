"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.registry import register, table
from lamina.functions import blending as B
from lamina.functions import hashing as H
from lamina.functions import names as N

SQL_ESCAPE = (
    "array_to_string(list_transform(string_split({s}, ''), lambda c: CASE WHEN regexp_matches(c, "
    "'[\\x00-\\x1f\"%''/\\\\~\\x7f]') THEN '%' || lpad(lower(to_hex(unicode(c))), 2, '0') ELSE c END), '')"
)


def sql_escape(s: str) -> str:
    return SQL_ESCAPE.format(s=s)


@register(
    "encode_name",
    f"""SELECT doc_id, {sql_escape('text')} || CASE WHEN doc_id % 4 > 0
        THEN '\\' || (doc_id % 4)::VARCHAR ELSE '' END AS encoded FROM documents""",
)
def _encode(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", N.encode_name("text", F.col("doc_id") % 4).alias("encoded")
    )


@register(
    "decode_name",
    f"SELECT page_id, url_decode({sql_escape('html')}) AS decoded FROM pages",
)
def _decode(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", N.decode_name(N.encode_name("html")).alias("decoded")
    )


@register(
    "safe_filename",
    """SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f"*/:<>?|\\x7f]+', '_', 'g') AS file_name
       FROM documents""",
)
def _safe(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", N.safe_filename("text").alias("file_name")
    )


@register(
    "ascii_digits",
    """SELECT o_orderkey, translate(translate(o_orderkey::VARCHAR || o_orderpriority,
         '0123456789', '０１２３４５６７８９'), '０１２３４５６７８９', '0123456789') AS digits FROM orders""",
)
def _digits(spark, sf):
    wide = F.translate(
        F.concat(F.col("o_orderkey").cast("string"), "o_orderpriority"),
        "0123456789",
        "０１２３４５６７８９",
    )
    return table(spark, sf, "orders").select("o_orderkey", N.ascii_digits(wide).alias("digits"))


@register(
    "url_prefix",
    """SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url,
         '#[^#]*$', ''), '\\?[^?]*$', ''), '^.*?([^/]+)$', '\\1'), '\\..*$', '') || '_' AS prefix
       FROM pages""",
)
def _url(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.url_prefix("url").alias("prefix"))


def flagged_name():
    """Order priorities dressed with prefixes and mirror tokens by order attributes."""
    return F.concat(
        F.when(F.col("o_orderstatus") == "P", "*").when(F.col("o_orderstatus") == "F", "!").otherwise(""),
        "o_orderpriority",
        F.when(F.col("o_totalprice") < 150000, ":flipx").otherwise(""),
        F.when(F.col("o_orderpriority").startswith("1"), ":flipxy").otherwise(""),
    )


SQL_FLAGGED = """CASE o_orderstatus WHEN 'P' THEN '*' WHEN 'F' THEN '!' ELSE '' END || o_orderpriority
    || CASE WHEN o_totalprice < 150000 THEN ':flipx' ELSE '' END
    || CASE WHEN o_orderpriority LIKE '1%' THEN ':flipxy' ELSE '' END"""


@register(
    "layer_flags",
    f"""SELECT o_orderkey,
          CASE WHEN o_orderstatus = 'P' THEN 'radio' WHEN o_orderstatus = 'F' THEN 'force' ELSE 'plain' END AS kind,
          o_orderpriority AS display,
          CASE o_orderstatus WHEN 'P' THEN '*' WHEN 'F' THEN '!' ELSE '' END || o_orderpriority AS base,
          CASE WHEN o_orderpriority LIKE '1%' THEN CASE WHEN o_totalprice < 150000 THEN 'flipxy,flipx' ELSE 'flipxy' END
               WHEN o_totalprice < 150000 THEN 'flipx' ELSE '' END AS tokens
        FROM (SELECT *, {SQL_FLAGGED} AS name FROM orders)""",
)
def _flags(spark, sf):
    rows = table(spark, sf, "orders").withColumn("f", N.layer_flags(flagged_name()))
    return rows.select(
        "o_orderkey", "f.kind", "f.display", "f.base", F.array_join("f.tokens", ",").alias("tokens")
    )


@register(
    "display_caption",
    f"SELECT o_orderkey, regexp_replace({SQL_FLAGGED}, '^\\*', '') AS caption FROM orders",
)
def _caption(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", N.display_caption(flagged_name()).alias("caption")
    )


@register(
    "dos_timestamp",
    """SELECT event_id, ((((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts)) * 65536)
         + hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2)::BIGINT AS packed FROM events""",
)
def _dos(spark, sf):
    return table(spark, sf, "events").select("event_id", N.dos_timestamp("ts").alias("packed"))


@register(
    "format_ts",
    "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown FROM events",
)
def _format(spark, sf):
    return table(spark, sf, "events").select("event_id", N.format_ts("ts").alias("shown"))


SQL_HASH32 = """list_reduce(list_transform(string_split({s}, ''), lambda c: unicode(c)::BIGINT),
    lambda h, c: ((h * 31 + c + 2147483648) & 4294967295) - 2147483648)"""


@register(
    "string_hash32",
    f"""SELECT doc_id, {SQL_HASH32.format(s="'a' || text")} AS hash,
          CASE WHEN {SQL_HASH32.format(s="'a' || text")} < 0 THEN '-' ELSE '' END
          || lower(to_hex(abs({SQL_HASH32.format(s="'a' || text")}))) AS hash_hex FROM documents""",
)
def _hash(spark, sf):
    text = F.concat(F.lit("a"), "text")
    return table(spark, sf, "documents").select(
        "doc_id", H.string_hash32(text).alias("hash"), H.string_hash_hex(text).alias("hash_hex")
    )


@register("crc32_of")
def _crc(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", H.crc32_of("text").alias("crc"), H.version_id("text").alias("version_id")
    )


@register(
    "sequence_name",
    """SELECT o_orderkey, o_orderstatus || CASE WHEN greatest(o_orderkey - 5, 0) < 1000 THEN right('0000' || greatest(o_orderkey - 5, 0)::VARCHAR, 4)
         ELSE greatest(o_orderkey - 5, 0)::VARCHAR END AS file_name FROM orders""",
)
def _sequence(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        N.sequence_name("o_orderstatus", F.col("o_orderkey") - 5).alias("file_name"),
    )


@register(
    "hamming32",
    """SELECT o_orderkey, o_custkey, bit_count(xor(o_orderkey * 2654435761, -o_custkey * 40503) & 4294967295)::INTEGER
         AS bits FROM orders""",
)
def _hamming(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        H.hamming32(F.col("o_orderkey") * 2654435761, -F.col("o_custkey") * 40503).alias("bits"),
    )


@register(
    "premultiply",
    """SELECT l_orderkey, l_linenumber, l_partkey % 256 AS c, l_suppkey % 256 AS a,
         ((l_partkey % 256) * (l_suppkey % 256)) // 255 AS p FROM lineitem""",
)
def _premultiply(spark, sf):
    c, a = F.col("l_partkey") % 256, F.col("l_suppkey") % 256
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", c.alias("c"), a.alias("a"), B.premultiply(c, a).alias("p")
    )


SQL_RGB = """SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, (l_suppkey * 7) % 256 AS g,
    l_quantity::BIGINT * 5 AS b, l_orderkey % 256 AS t FROM lineitem"""


def rgb_rows(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_partkey") % 256).alias("r"),
        (F.col("l_suppkey") * 7 % 256).alias("g"),
        (F.col("l_quantity").cast("bigint") * 5).alias("b"),
        (F.col("l_orderkey") % 256).alias("t"),
    )


@register(
    "lum",
    f"SELECT l_orderkey, l_linenumber, r, g, b, (77 * r + 151 * g + 28 * b) // 256 AS luminosity FROM ({SQL_RGB})",
)
def _lum(spark, sf):
    return rgb_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "r", "g", "b", B.lum(F.col("r"), F.col("g"), F.col("b")).alias("luminosity")
    )


@register(
    "sat",
    f"""SELECT l_orderkey, l_linenumber, r, g, b, greatest(r, g, b) - least(r, g, b) AS saturation
        FROM ({SQL_RGB})""",
)
def _sat(spark, sf):
    return rgb_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "r", "g", "b", B.sat(F.col("r"), F.col("g"), F.col("b")).alias("saturation")
    )


def sql_clip(source: str, r: str, g: str, b: str) -> str:
    """SELECT adding cr, cg, cb: the named channels of ``source`` pulled back into range."""

    def lift(c):
        return f"CASE WHEN lo < 0 THEN lm::DOUBLE + (({c} - lm) * lm)::DOUBLE / (lm - lo)::DOUBLE ELSE {c}::DOUBLE END"

    def cap(c):
        return f"trunc(CASE WHEN hi > 255 THEN lm::DOUBLE + (({c} - lm::DOUBLE) * (255 - lm)::DOUBLE) / (hi - lm)::DOUBLE ELSE {c} END)::BIGINT"

    return f"""SELECT *, {cap('l1')} AS cr, {cap('l2')} AS cg, {cap('l3')} AS cb FROM (
        SELECT *, {lift(r)} AS l1, {lift(g)} AS l2, {lift(b)} AS l3 FROM (
        SELECT *, greatest(0, least(255, (77 * {r} + 151 * {g} + 28 * {b}) >> 8)) AS lm, least({r}, {g}, {b}) AS lo,
               greatest({r}, {g}, {b}) AS hi FROM ({source})))"""


SQL_SHIFTED = f"""SELECT *, r + t - ((77 * r + 151 * g + 28 * b) >> 8) AS xr,
    g + t - ((77 * r + 151 * g + 28 * b) >> 8) AS xg, b + t - ((77 * r + 151 * g + 28 * b) >> 8) AS xb
    FROM ({SQL_RGB})"""


@register(
    "set_lum",
    f"""SELECT l_orderkey, l_linenumber, r, g, b, t, cr, cg, cb FROM
        ({sql_clip(SQL_SHIFTED.replace('>> 8', '// 256'), 'xr', 'xg', 'xb').replace('>> 8', '>> 8')})""",
)
def _set_lum(spark, sf):
    c = B.set_lum(F.col("r"), F.col("g"), F.col("b"), F.col("t"))
    return rgb_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "r", "g", "b", "t",
        c[0].alias("cr"), c[1].alias("cg"), c[2].alias("cb"),
    )


@register(
    "clip_color",
    f"""SELECT l_orderkey, l_linenumber, r, g, b, t, cr, cg, cb FROM
        ({sql_clip(f'SELECT *, r + t - 128 AS xr, g + t - 128 AS xg, b + t - 128 AS xb FROM ({SQL_RGB})', 'xr', 'xg', 'xb')})""",
)
def _clip(spark, sf):
    r, g, b = (F.col(n) + F.col("t") - 128 for n in "rgb")
    c = B.clip_color(r, g, b)
    return rgb_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "r", "g", "b", "t",
        c[0].alias("cr"), c[1].alias("cg"), c[2].alias("cb"),
    )


def sql_set_sat(c: str, r: str, g: str, b: str, target: str) -> str:
    return f"""CASE WHEN greatest({r}, {g}, {b}) = least({r}, {g}, {b}) THEN 0 ELSE
        trunc((({c} - least({r}, {g}, {b})) * {target})::DOUBLE
        / (greatest({r}, {g}, {b}) - least({r}, {g}, {b}))::DOUBLE)::BIGINT END"""


@register(
    "set_sat",
    "SELECT l_orderkey, l_linenumber, r, g, b, t, "
    + ", ".join(f"{sql_set_sat(c, 'r', 'g', 'b', 't')} AS c{c}" for c in "rgb")
    + f" FROM ({SQL_RGB})",
)
def _set_sat(spark, sf):
    c = B.set_sat(F.col("r"), F.col("g"), F.col("b"), F.col("t"))
    return rgb_rows(spark, sf).select(
        "l_orderkey", "l_linenumber", "r", "g", "b", "t",
        c[0].alias("cr"), c[1].alias("cg"), c[2].alias("cb"),
    )


SQL_BOX = "SELECT p_partkey, p_size * 37 AS w, (p_partkey * 13) % 901 + 1 AS h FROM part"


def boxes(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 37).alias("w"), (F.col("p_partkey") * 13 % 901 + 1).alias("h")
    )


def _sql_scale(side: str) -> str:
    return f"CASE WHEN {side} > 300 THEN 300.0::DOUBLE / {side} ELSE 1.0::DOUBLE END"


@register(
    "fit_scale",
    f"""SELECT p_partkey, CASE WHEN w * sw < 1 OR h * sw < 1 THEN small ELSE sw END AS by_width,
          CASE WHEN w * sh < 1 OR h * sh < 1 THEN small ELSE sh END AS by_height FROM (
        SELECT *, {_sql_scale('w')} AS sw, {_sql_scale('h')} AS sh,
               CASE WHEN w > h THEN 1.0::DOUBLE / h ELSE 1.0::DOUBLE / w END AS small FROM ({SQL_BOX}))""",
)
def _fit(spark, sf):
    return boxes(spark, sf).select(
        "p_partkey",
        N.fit_scale("w", "h", "w", 300).alias("by_width"),
        N.fit_scale("w", "h", "h", 300).alias("by_height"),
    )


@register(
    "thumbnail_box",
    f"""SELECT p_partkey, (96 - tw) / 2 AS x, (96 - th) / 2 AS y, tw, th FROM (
        SELECT p_partkey, CASE WHEN w > h THEN 96.0::DOUBLE ELSE 96.0::DOUBLE / h * w END AS tw,
               CASE WHEN w > h THEN 96.0::DOUBLE / w * h ELSE 96.0::DOUBLE END AS th FROM ({SQL_BOX}))""",
)
def _thumb(spark, sf):
    rows = boxes(spark, sf).withColumn("b", N.thumbnail_box("w", "h"))
    return rows.select(
        "p_partkey", "b.x", "b.y", F.col("b.w").alias("tw"), F.col("b.h").alias("th")
    )


SQL_MODE = """CASE WHEN o_orderpriority LIKE '1%' THEN 'pass-through' WHEN o_orderpriority LIKE '2%' THEN 'multiply'
    WHEN o_orderpriority LIKE '3%' THEN 'dissolve' WHEN o_orderpriority LIKE '4%' THEN 'hue' ELSE 'normal' END"""


def order_mode():
    p = F.col("o_orderpriority")
    return (
        F.when(p.startswith("1"), "pass-through")
        .when(p.startswith("2"), "multiply")
        .when(p.startswith("3"), "dissolve")
        .when(p.startswith("4"), "hue")
        .otherwise("normal")
    )


@register(
    "effective_blend",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'screen'
          WHEN {SQL_MODE} = 'pass-through' THEN 'normal' ELSE {SQL_MODE} END AS blend_mode FROM orders""",
)
def _effective(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        N.effective_blend(order_mode(), F.col("o_orderstatus") == "O", F.lit("screen")).alias("blend_mode"),
    )


@register(
    "blend_supported",
    f"""SELECT o_orderkey, {SQL_MODE} AS blend_mode, {SQL_MODE} NOT IN ('pass-through', 'dissolve') AS supported
        FROM orders""",
)
def _supported(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", order_mode().alias("blend_mode"), B.blend_supported(order_mode()).alias("supported")
    )


def _sql_view_name() -> str:
    clean = lambda s: f"""regexp_replace({s}, '[\\x00-\\x1f"*/:<>?|\\x7f]+', '_', 'g')"""
    return f"""SELECT p_partkey,
        {clean('p_name')} || '_' || {clean("p_type || '-' || p_brand || ':?'")} AS standard_flat,
        {clean('p_name')} || '\\' || {clean("p_brand || ':?'")} AS compact_nested,
        p_size::VARCHAR || '_' || (p_size * 2)::VARCHAR AS index_flat FROM part"""


@register("view_name", _sql_view_name())
def _view_name(spark, sf):
    parts = F.array(
        F.struct(F.lit("root").alias("caption"), F.col("p_name").alias("name"), F.col("p_size").alias("index")),
        F.struct(
            F.col("p_type").alias("caption"),
            F.concat("p_brand", F.lit(":?")).alias("name"),
            (F.col("p_size") * 2).alias("index"),
        ),
    )
    return table(spark, sf, "part").select(
        "p_partkey",
        N.view_name(parts, "standard", True).alias("standard_flat"),
        N.view_name(parts, "compact", False).alias("compact_nested"),
        N.view_name(parts, "index", True).alias("index_flat"),
    )

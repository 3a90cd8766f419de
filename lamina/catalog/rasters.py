"""Queries over pixel rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.blends import SQL_SEPARABLE, sql_store
from lamina.catalog.registry import register, table
from lamina.functions import blending as B
from lamina.operators import groups, pixels as P
from lamina.session import stage

C = F.col

# layer pixels off the line items: documents of about 1024 orders on a 16 x 16 canvas
STACK_SQL = """stack AS (
  SELECT l_orderkey // 1024 AS doc_id, l_orderkey * 8 + l_linenumber AS z, l_partkey % 16 AS x, l_suppkey % 16 AS y,
    max(l_quantity)::BIGINT * 5 AS r, max(round(l_discount * 100))::BIGINT * 25 AS g, max(round(l_tax * 100))::BIGINT * 30 AS b,
    (100 + max(l_linenumber) * 16)::BIGINT AS a, CASE max(l_orderkey % 3) WHEN 0 THEN 'normal' WHEN 1 THEN 'multiply' ELSE 'screen' END AS mode,
    (255 - max(round(l_discount * 100)) * 10)::BIGINT AS opacity, max(l_linenumber)::BIGINT AS ln, max(l_returnflag) AS flag
  FROM lineitem GROUP BY l_orderkey // 1024, l_orderkey * 8 + l_linenumber, l_partkey % 16, l_suppkey % 16)"""


def stack(spark, sf):
    key = C("l_orderkey")
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.shiftright(key, 10).alias("doc_id"),
            (key * 8 + C("l_linenumber")).alias("z"),
            (C("l_partkey") % 16).alias("x"),
            (C("l_suppkey") % 16).alias("y"),
        )
        .agg(
            (F.max("l_quantity").cast("bigint") * 5).alias("r"),
            (F.max(F.round(C("l_discount") * 100)).cast("bigint") * 25).alias("g"),
            (F.max(F.round(C("l_tax") * 100)).cast("bigint") * 30).alias("b"),
            (F.max("l_linenumber").cast("bigint") * 16 + 100).alias("a"),
            F.when(F.max(key % 3) == 0, "normal").when(F.max(key % 3) == 1, "multiply").otherwise("screen").alias("mode"),
            (255 - F.max(F.round(C("l_discount") * 100)).cast("bigint") * 10).alias("opacity"),
            F.max("l_linenumber").cast("bigint").alias("ln"),
            F.max("l_returnflag").alias("flag"),
        )
    )


MODES = ("normal", "multiply", "screen")


def _sql_b(c: str) -> str:
    pick = {m: SQL_SEPARABLE[m].format(s="s" + c, d="d" + c) for m in MODES}
    return f"CASE mode WHEN 'multiply' THEN ({pick['multiply']}) WHEN 'screen' THEN ({pick['screen']}) ELSE s{c} END"


def sql_step(source: str, keep: str) -> str:
    """One blend of s* over d* with per-row mode and opacity; gives keep columns and r, g, b, a."""
    out = ", ".join(
        "CASE WHEN a1 + a2 + a3 > 0 THEN "
        + sql_store(f"((({_sql_b(c)}) * a1 + s{c} * a2 + d{c} * a3)::DOUBLE / (a1 + a2 + a3)::DOUBLE)")
        + f" ELSE d{c} END AS {c}"
        for c in "rgb"
    )
    return f"""SELECT {keep}, {out}, a1 + a2 + a3 AS a FROM (
        SELECT *, (t * da) >> 23 AS a1, (t * (255 - da)) >> 23 AS a2, ((8388735 - t) * da) >> 23 AS a3 FROM (
        SELECT *, trunc(sa::DOUBLE * (opacity::DOUBLE / 255) * 32897)::BIGINT AS t FROM ({source})))"""


def sql_fold(ops: str, base: str | None = None) -> str:
    """Recursive fold of table ``ops`` (doc_id, x, y, z, ...) over a base table or transparent."""
    first = (
        f"SELECT DISTINCT doc_id, x, y, 0::BIGINT AS n, 0::BIGINT AS r, 0::BIGINT AS g, 0::BIGINT AS b, 0::BIGINT AS a FROM {ops}"
        if base is None
        else f"SELECT doc_id, x, y, 0::BIGINT AS n, r, g, b, a FROM {base}"
    )
    step = sql_step(
        """SELECT f.doc_id, f.x, f.y, f.n + 1 AS n, o.mode, o.opacity, o.r AS sr, o.g AS sg, o.b AS sb, o.a AS sa,
             f.r AS dr, f.g AS dg, f.b AS db, f.a AS da FROM fold f JOIN ranked o
             ON o.doc_id = f.doc_id AND o.x = f.x AND o.y = f.y AND o.n = f.n + 1""",
        "doc_id, x, y, n",
    )
    return f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, x, y ORDER BY z) AS n FROM {ops}),
  fold AS ({first} UNION ALL {step}),
  folded AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, x, y ORDER BY n DESC) = 1)"""


@register(
    "compose_pixels",
    "WITH RECURSIVE " + STACK_SQL + sql_fold("stack") + " SELECT doc_id, x, y, r, g, b, a FROM folded",
)
def _compose(spark, sf):
    return P.compose_pixels(stack(spark, sf), modes=MODES)


_CLIP = ", bases AS (SELECT doc_id, x, y, min(z) AS z0 FROM stack GROUP BY ALL), base AS (SELECT s.* FROM stack s JOIN bases b ON b.doc_id = s.doc_id AND b.x = s.x AND b.y = s.y AND b.z0 = s.z), solid AS (SELECT * REPLACE (255::BIGINT AS a) FROM base), upper AS (SELECT s.* FROM stack s JOIN bases b ON b.doc_id = s.doc_id AND b.x = s.x AND b.y = s.y AND s.z > b.z0)"


def _base_and_upper(spark, sf):
    rows = stage(stack(spark, sf), "stack")
    lowest = rows.groupBy("doc_id", "x", "y").agg(F.min("z").alias("z0"))
    tagged = rows.join(lowest, ["doc_id", "x", "y"]).withColumn("group_id", F.lit(0))
    return tagged.filter("z = z0").drop("z0"), tagged.filter("z > z0").drop("z0")


@register(
    "clip_group",
    "WITH RECURSIVE "
    + STACK_SQL
    + _CLIP
    + sql_fold("upper", "solid")
    + " SELECT doc_id, x, y, f.r, f.g, f.b, b.a FROM folded f JOIN base b USING (doc_id, x, y)",
)
def _clip_group(spark, sf):
    base, upper = _base_and_upper(spark, sf)
    return P.clip_group(base, upper, MODES).drop("group_id")


@register(
    "clip_separately",
    "WITH " + STACK_SQL + _CLIP + f" SELECT u.doc_id, u.x, u.y, u.z, u.r, u.g, u.b, {sql_store('u.a::DOUBLE * b.a::DOUBLE / 255')} AS a FROM upper u JOIN base b USING (doc_id, x, y)",
)
def _clip_separately(spark, sf):
    base, upper = _base_and_upper(spark, sf)
    return P.clip_separately(base, upper).select("doc_id", "x", "y", "z", "r", "g", "b", "a")


def _masked_layers(spark, sf):
    """Layers are line numbers; odd ones have a mask that covers discounted spots."""
    rows = stage(stack(spark, sf), "stack").withColumn("seq_id", C("ln"))
    px = rows.groupBy("doc_id", "seq_id", "x", "y").agg(*[F.max(n).alias(n) for n in P.CHANNELS])
    masks = rows.filter("opacity < 200 and ln % 2 = 1").groupBy("doc_id", "seq_id", "x", "y").agg(F.max("opacity").alias("m"))
    layers = px.select("doc_id", "seq_id").distinct().withColumn(
        "mask_default", F.when(C("seq_id") % 4 == 1, 0).when(C("seq_id") % 4 == 3, 255)
    )
    return px, masks, layers


_SQL_MASKED = """, px AS (SELECT doc_id, ln AS seq_id, x, y, max(r) AS r, max(g) AS g, max(b) AS b, max(a) AS a FROM stack GROUP BY ALL),
  masks AS (SELECT doc_id, ln AS seq_id, x, y, max(opacity) AS m FROM stack WHERE opacity < 200 AND ln % 2 = 1 GROUP BY ALL)"""


@register(
    "mask_pixels",
    "WITH "
    + STACK_SQL
    + _SQL_MASKED
    + """SELECT doc_id, seq_id, x, y, r, g, b, (a * CASE seq_id % 4 WHEN 1 THEN coalesce(m, 0) WHEN 3 THEN coalesce(m, 255) ELSE 255 END) // 255 AS a
      FROM px LEFT JOIN masks USING (doc_id, seq_id, x, y)""",
)
def _mask(spark, sf):
    return P.mask_pixels(*_masked_layers(spark, sf))


def _two(spark, sf):
    """Every layer with the next one of its document: all layers but the last, all but the first, masks of the former."""
    px, masks, _ = _masked_layers(spark, sf)
    pair = F.concat_ws("/", "doc_id", C("seq_id").cast("string")).alias("doc_id")
    before = F.concat_ws("/", "doc_id", (C("seq_id") - 1).cast("string")).alias("doc_id")
    held = lambda df, key: df.select(key, *[c for c in df.columns if c not in ("doc_id", "seq_id")])
    return held(px, pair), held(px.filter("seq_id > 1"), before), held(masks, pair)


@register(
    "mask_pass_through",
    "WITH "
    + STACK_SQL
    + _SQL_MASKED
    + ", g AS (SELECT * REPLACE (doc_id || '/' || seq_id AS doc_id) FROM px), d AS (SELECT * REPLACE (doc_id || '/' || (seq_id - 1) AS doc_id) FROM px WHERE seq_id > 1), k AS (SELECT * REPLACE (doc_id || '/' || seq_id AS doc_id) FROM masks) SELECT doc_id, x, y, "
    + ", ".join(
        f"(coalesce(g.{c}, 0) * coalesce(m, 0)) // 255 + (coalesce(d.{c}, 0) * (255 - coalesce(m, 0))) // 255 AS {c}" for c in "rgba"
    )
    + " FROM g FULL JOIN d USING (doc_id, x, y) LEFT JOIN k USING (doc_id, x, y)",
)
def _pass_through(spark, sf):
    return P.mask_pass_through(*_two(spark, sf))


@register(
    "image_diff",
    "WITH "
    + STACK_SQL
    + _SQL_MASKED
    + ", g AS (SELECT * REPLACE (doc_id || '/' || seq_id AS doc_id) FROM px), d AS (SELECT * REPLACE (doc_id || '/' || (seq_id - 1) AS doc_id) FROM px WHERE seq_id > 1), gaps AS (SELECT doc_id, greatest("
    + ", ".join(f"abs(coalesce((g.{c} * g.a) // 255, 0) - coalesce((d.{c} * d.a) // 255, 0))" for c in "rgb")
    + ", abs(coalesce(g.a, 0) - coalesce(d.a, 0))) AS gap FROM g FULL JOIN d USING (doc_id, x, y)) SELECT doc_id, max(gap) AS max_delta, count(*) FILTER (WHERE gap > 2) AS over FROM gaps GROUP BY doc_id",
)
def _diff(spark, sf):
    a, b, _ = _two(spark, sf)
    return P.image_diff(a, b)


def canvases(spark, sf):
    return stack(spark, sf).select("doc_id").distinct().select(
        "doc_id",
        (10 + C("doc_id") % 7).alias("canvas_w"),
        (16 - C("doc_id") % 5).alias("canvas_h"),
        (C("doc_id") % 3 - 1).alias("x"),
        (2 - C("doc_id") % 4).alias("y"),
        (9 + C("doc_id") % 3).alias("width"),
        (8 + C("doc_id") % 4).alias("height"),
    )


_SQL_W, _SQL_H = "(10 + doc_id % 7)", "(16 - doc_id % 5)"


@register(
    "clip_to_canvas",
    "WITH " + STACK_SQL + f"SELECT doc_id, z, x, y, r, g, b, a FROM stack WHERE x < {_SQL_W} AND y < {_SQL_H}",
)
def _canvas(spark, sf):
    return P.clip_to_canvas(stack(spark, sf), canvases(spark, sf)).select("doc_id", "z", "x", "y", "r", "g", "b", "a")


@register("place", "WITH " + STACK_SQL + "SELECT doc_id, z, x + doc_id % 3 - 1 AS x, y + 2 - doc_id % 4 AS y, a FROM stack")
def _place(spark, sf):
    return P.place(stack(spark, sf), canvases(spark, sf)).select("doc_id", "z", "x", "y", "a")


@register(
    "auto_trim",
    "WITH "
    + STACK_SQL
    + """SELECT * FROM (SELECT doc_id, z, x - (doc_id % 3 - 1) AS x, y - (2 - doc_id % 4) AS y, a FROM stack)
      WHERE x >= 0 AND y >= 0 AND x < 9 + doc_id % 3 AND y < 8 + doc_id % 4""",
)
def _trim(spark, sf):
    return P.auto_trim(stack(spark, sf), canvases(spark, sf)).select("doc_id", "z", "x", "y", "a")


@register("flip_pixels", "WITH " + STACK_SQL + f"SELECT doc_id, z, {_SQL_W} - 1 - x AS x, {_SQL_H} - 1 - y AS y, a FROM stack")
def _flip(spark, sf):
    return P.flip_pixels(stack(spark, sf), canvases(spark, sf), "flipxy").select("doc_id", "z", "x", "y", "a")


@register(
    "channels_to_pixels",
    """SELECT label::BIGINT AS doc_id, vec_id AS seq_id, (i - 1) % 10 AS x, (i - 1) // 10 AS y, v AS r, 255 - v AS g, (v * 7) % 256 AS b,
        CASE WHEN label % 2 = 0 THEN 255 ELSE v END AS a FROM (
        SELECT *, greatest(0, least(255, floor((embedding[i]::DOUBLE + 1) * 127.5)::BIGINT)) AS v FROM (
          SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))""",
)
def _channels(spark, sf):
    v = F.transform(
        "embedding",
        lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 1) * 127.5))).cast("bigint"),
    )
    planes = table(spark, sf, "embeddings").withColumn("v", v).select(
        C("label").cast("bigint").alias("doc_id"),
        C("vec_id").alias("seq_id"),
        F.lit(10).alias("width"),
        C("v").alias("r"),
        F.transform("v", lambda e: 255 - e).alias("g"),
        F.transform("v", lambda e: e * 7 % 256).alias("b"),
        F.when(C("label") % 2 == 1, C("v")).alias("a"),
    )
    return P.channels_to_pixels(planes)


def grouped_document(spark, sf):
    """A layer tree over the stack: folders by return flag, layers by line number."""
    rows = stage(stack(spark, sf), "stack").withColumn(
        "folder_seq", F.when(C("flag") == "A", 1).when(C("flag") == "N", 2).otherwise(3).cast("bigint")
    ).withColumn("seq_id", C("folder_seq") * 10 + C("ln"))
    px = rows.groupBy("doc_id", "seq_id", "x", "y").agg(*[F.max(n).alias(n) for n in P.CHANNELS])
    leaves = rows.groupBy("doc_id", "seq_id", C("folder_seq").alias("parent_seq_id"), C("ln").alias("ordinal")).agg(
        F.min("opacity").alias("opacity")
    ).select(
        "doc_id", "seq_id", "parent_seq_id", "ordinal", F.lit(False).alias("folder"), F.lit(True).alias("visible"),
        F.when(C("ordinal") % 3 == 0, "multiply").when(C("ordinal") % 3 == 1, "screen").otherwise("normal").alias("blend_mode"),
        "opacity", C("ordinal").isin(3, 5).alias("clipping"), (C("ordinal") != 4).alias("blend_clipped"),
        F.when(C("ordinal") == 6, 255).alias("mask_default"),
    )
    folders = leaves.select("doc_id", C("parent_seq_id").alias("seq_id")).distinct().select(
        "doc_id", "seq_id", F.lit(-1).cast("bigint").alias("parent_seq_id"), C("seq_id").alias("ordinal"),
        F.lit(True).alias("folder"), F.lit(True).alias("visible"),
        F.when(C("seq_id") == 1, "multiply").otherwise("pass-through").alias("blend_mode"),
        (255 - C("seq_id") * 30).alias("opacity"), F.lit(False).alias("clipping"), F.lit(True).alias("blend_clipped"),
        F.when(C("seq_id") == 2, 0).alias("mask_default"),
    )
    masks = rows.filter("flag = 'N'").groupBy("doc_id", C("folder_seq").alias("seq_id"), "x", "y").agg(F.max("opacity").alias("m")).union(
        rows.filter("ln = 6").groupBy("doc_id", "seq_id", "x", "y").agg(F.min("opacity").alias("m"))
    )
    return stage(leaves.unionByName(folders), "layers"), stage(px, "pixels"), stage(masks, "masks")


@register("compose_groups")
def _groups(spark, sf):
    layers, px, masks = grouped_document(spark, sf)
    return groups.compose_groups(layers, px, masks, MODES)


# sides of 16 become floor(16 * 0.4) = 6: each source cell covers 0.375 of a target cell or two
_SQL_LIGHT = ", ".join(f"sum(w * a * pow({c} / 255, {P.GAMMA}::DOUBLE)) AS l{c}" for c in "rgb")
_SQL_BACK = ", ".join(
    f"CASE WHEN wa > 0 THEN {sql_store(f'(pow(l{c} / wa, 1::DOUBLE / {P.GAMMA}::DOUBLE) * 255)')} ELSE 0 END AS {c}" for c in "rgb"
)


@register(
    "downscale",
    "WITH RECURSIVE "
    + STACK_SQL
    + sql_fold("stack")
    + f""", cells AS (SELECT i, unnest(range(floor(i * 0.375)::INTEGER, least(6, greatest(floor(i * 0.375)::INTEGER + 1,
      ceil((i + 1) * 0.375 - 1e-9)::INTEGER)))) AS t FROM range(16) q(i)),
  spans AS (SELECT i, t, (least((i + 1) * 0.375, t + 1) - greatest(i * 0.375, t))::DOUBLE AS w FROM cells),
  sums AS (SELECT doc_id, tx, ty, sum(w * a) AS wa, {_SQL_LIGHT}
    FROM (SELECT f.*, sx.t AS tx, sy.t AS ty, sx.w * sy.w AS w FROM folded f JOIN spans sx ON sx.i = f.x JOIN spans sy ON sy.i = f.y)
    GROUP BY ALL)
  SELECT doc_id, tx::BIGINT AS x, ty::BIGINT AS y, {_SQL_BACK}, {sql_store("wa")} AS a FROM sums""",
)
def _downscale(spark, sf):
    docs = stack(spark, sf).select("doc_id").distinct().withColumns({"canvas_w": F.lit(16), "canvas_h": F.lit(16)})
    flat = P.compose_pixels(stack(spark, sf), modes=MODES)
    return P.downscale(flat, docs, 0.4)

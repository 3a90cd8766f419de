"""Queries for the layer-tree operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.registry import register, table
from lamina.fixtures import DEEP_PATHS_SQL, DEEP_SQL, SHALLOW_SQL, deep_layers, shallow_layers
from lamina.operators import states, tree

_DEEP = "WITH " + DEEP_SQL
_SHALLOW = "WITH " + SHALLOW_SQL


@register(
    "compact_state",
    DEEP_PATHS_SQL
    + """, shown AS (
  SELECT c.doc_id, c.seq_id, bool_and(d.visible) AS effective FROM closure c
  JOIN deep d ON d.doc_id = c.doc_id AND d.seq_id = c.ancestor_seq_id GROUP BY ALL)
SELECT p.doc_id, p.seq_id, p.path FROM paths p JOIN shown s USING (doc_id, seq_id) WHERE s.effective
  AND NOT EXISTS (SELECT 1 FROM shown k JOIN deep d USING (doc_id, seq_id)
                  WHERE k.effective AND d.doc_id = p.doc_id AND d.parent_seq_id = p.seq_id)""",
)
def _compact(spark, sf):
    """For every document, the minimal list of layers that are really on."""
    paths = tree.tree_paths(deep_layers(spark, sf))
    return states.compact_state(paths, "visible").select("doc_id", "seq_id", "path")


@register(
    "full_state",
    DEEP_PATHS_SQL + "SELECT doc_id, seq_id, '/' || path AS line FROM paths WHERE visible",
)
def _full(spark, sf):
    return states.full_state(tree.tree_paths(deep_layers(spark, sf)), "visible")


@register(
    "compact_state_text",
    _SHALLOW
    + """, lit AS (SELECT a.* FROM shallow a LEFT JOIN shallow f ON f.doc_id = a.doc_id AND f.seq_id = a.parent_seq_id
      WHERE a.visible AND (a.lvl = 1 OR f.visible))
    SELECT doc_id, string_agg(path, chr(10) ORDER BY seq_id DESC) AS text FROM lit x
    WHERE NOT EXISTS (SELECT 1 FROM lit y WHERE y.doc_id = x.doc_id AND y.parent_seq_id = x.seq_id) GROUP BY doc_id""",
)
def _compact_text(spark, sf):
    rows = states.compact_state(tree.tree_paths(shallow_layers(spark, sf)), "visible")
    return states.state_text(rows.withColumnRenamed("path", "line"), newest_first=True)


@register("tree_closure", DEEP_PATHS_SQL + "SELECT doc_id, seq_id, ancestor_seq_id, distance FROM closure")
def _closure(spark, sf):
    return tree.tree_closure(deep_layers(spark, sf)).select("doc_id", "seq_id", "ancestor_seq_id", "distance")


@register(
    "tree_paths",
    DEEP_PATHS_SQL + "SELECT doc_id, seq_id, lvl AS depth, internal_name, path, parent_path FROM paths",
)
def _paths(spark, sf):
    return tree.tree_paths(deep_layers(spark, sf)).select(
        "doc_id", "seq_id", "depth", "internal_name", "path", "parent_path"
    )


@register(
    "sibling_ordinal",
    _DEEP
    + """SELECT doc_id, seq_id, row_number() OVER (PARTITION BY doc_id, parent_seq_id, name ORDER BY ordinal) - 1 AS dup
    FROM deep""",
)
def _sibling(spark, sf):
    return tree.sibling_ordinal(deep_layers(spark, sf)).select("doc_id", "seq_id", "dup")


@register(
    "clip_groups",
    _DEEP
    + """SELECT doc_id, seq_id, sum((NOT clipping)::INT) OVER (PARTITION BY doc_id, parent_seq_id ORDER BY ordinal)::BIGINT
    AS clip_group FROM deep""",
)
def _clip_groups(spark, sf):
    return tree.clip_groups(deep_layers(spark, sf)).select("doc_id", "seq_id", "clip_group")


_SQL_BASE = """, based AS (SELECT *, CASE WHEN clipping THEN last_value(CASE WHEN NOT clipping THEN seq_id END IGNORE NULLS)
    OVER (PARTITION BY doc_id, parent_seq_id ORDER BY ordinal) END AS base_seq_id FROM deep)"""


@register("clip_base", _DEEP + _SQL_BASE + "SELECT doc_id, seq_id, base_seq_id FROM based WHERE clipping")
def _clip_base(spark, sf):
    return tree.clip_base(deep_layers(spark, sf)).filter("clipping").select("doc_id", "seq_id", "base_seq_id")


@register(
    "effective_visibility",
    DEEP_PATHS_SQL
    + _SQL_BASE
    + """, own AS (SELECT a.doc_id, a.seq_id, a.visible AND (NOT a.clipping OR coalesce(b.visible, false)) AS ok
      FROM based a LEFT JOIN deep b ON b.doc_id = a.doc_id AND b.seq_id = a.base_seq_id)
    SELECT c.doc_id, c.seq_id, bool_and(o.ok) AS effective FROM closure c
    JOIN own o ON o.doc_id = c.doc_id AND o.seq_id = c.ancestor_seq_id GROUP BY ALL""",
)
def _visibility(spark, sf):
    return tree.effective_visibility(deep_layers(spark, sf)).select("doc_id", "seq_id", "effective")


@register(
    "normalize_radios",
    _DEEP
    + """, kinds AS (SELECT *, CASE WHEN name LIKE '!%' THEN 'force' WHEN name LIKE '*%' THEN 'radio' ELSE 'plain' END AS kind
      FROM deep), picks AS (SELECT doc_id, parent_seq_id, coalesce(min(ordinal) FILTER (WHERE visible), max(ordinal)) AS pick
      FROM kinds WHERE kind = 'radio' GROUP BY ALL)
    SELECT k.doc_id, k.seq_id, k.kind, CASE k.kind WHEN 'force' THEN true WHEN 'radio' THEN k.ordinal = p.pick
      ELSE k.visible END AS checked FROM kinds k LEFT JOIN picks p USING (doc_id, parent_seq_id)""",
)
def _radios(spark, sf):
    return tree.normalize_radios(deep_layers(spark, sf)).select("doc_id", "seq_id", "kind", "checked")


@register(
    "flip_pairs",
    _DEEP
    + """SELECT v.doc_id, v.parent_seq_id, 'flipx' AS axis, o.normal, v.seq_id AS flipped FROM deep v
    JOIN (SELECT doc_id, parent_seq_id, name, arg_max(seq_id, ordinal) AS normal FROM deep GROUP BY ALL) o
      ON o.doc_id = v.doc_id AND o.parent_seq_id = v.parent_seq_id AND o.name || ':flipx' = v.name""",
)
def _flip_pairs(spark, sf):
    return tree.flip_pairs(deep_layers(spark, sf)).drop("flipped_ordinal")


_SQL_ORDER = """, keyed AS (SELECT *, lpad((9223372036854775807 - ordinal)::VARCHAR, 19, '0') AS k FROM deep),
  ordered AS (
    SELECT *, k AS sort_path FROM keyed WHERE lvl = 1
    UNION ALL SELECT b.*, a.k || '/' || b.k FROM keyed b JOIN keyed a
      ON b.lvl = 2 AND a.doc_id = b.doc_id AND a.seq_id = b.parent_seq_id
    UNION ALL SELECT c.*, a.k || '/' || b.k || '/' || c.k FROM keyed c
      JOIN keyed b ON c.lvl = 3 AND b.doc_id = c.doc_id AND b.seq_id = c.parent_seq_id
      JOIN keyed a ON a.doc_id = b.doc_id AND a.seq_id = b.parent_seq_id)"""


@register("tree_order", _DEEP + _SQL_ORDER + "SELECT doc_id, seq_id, sort_path FROM ordered")
def _order(spark, sf):
    return tree.tree_order(deep_layers(spark, sf)).select("doc_id", "seq_id", "sort_path")


@register(
    "write_outline",
    _DEEP + _SQL_ORDER + "SELECT doc_id, sort_path, repeat(chr(9), lvl - 1) || name AS line FROM ordered",
)
def _outline(spark, sf):
    return tree.outline_lines(deep_layers(spark, sf))


@register(
    "bbox_rollup",
    DEEP_PATHS_SQL
    + """SELECT c.doc_id, c.ancestor_seq_id AS seq_id, min(d.x) AS x, min(d.y) AS y,
      max(d.x + d.width) - min(d.x) AS width, max(d.y + d.height) - min(d.y) AS height
    FROM closure c JOIN deep d USING (doc_id, seq_id) GROUP BY ALL""",
)
def _bbox(spark, sf):
    return tree.bbox_rollup(deep_layers(spark, sf))


def region_docs(spark, sf):
    return table(spark, sf, "region").select(
        F.col("r_regionkey").cast("bigint").alias("doc_id"),
        (40 + F.col("r_regionkey") * 20).alias("canvas_w"),
        (120 - F.col("r_regionkey") * 20).alias("canvas_h"),
        F.when(F.col("r_name") == "ASIA", "CMYK").otherwise("RGB").alias("color_mode"),
    )


_SQL_DOCS = """(SELECT r_regionkey::BIGINT AS doc_id, (40 + r_regionkey * 20)::INTEGER AS canvas_w,
    (120 - r_regionkey * 20)::INTEGER AS canvas_h, r_name FROM region)"""


@register(
    "doc_extent",
    _DEEP
    + f"""SELECT doc_id, greatest(min(x), 0) AS x, greatest(min(y), 0) AS y,
      least(max(x + width), any_value(canvas_w)) - greatest(min(x), 0) AS width,
      least(max(y + height), any_value(canvas_h)) - greatest(min(y), 0) AS height
    FROM deep JOIN {_SQL_DOCS} USING (doc_id) GROUP BY doc_id""",
)
def _extent(spark, sf):
    return tree.doc_extent(deep_layers(spark, sf), region_docs(spark, sf))


def with_content(layers):
    """Folders hold children when a customer has orders on file; leaves with wide boxes hold an image."""
    parents = layers.select("doc_id", F.col("parent_seq_id").alias("seq_id")).distinct()
    return layers.join(parents.withColumn("has_children", F.lit(True)), ["doc_id", "seq_id"], "left").select(
        *layers.columns,
        F.coalesce("has_children", F.lit(False)).alias("has_children"),
        ((F.col("width") > 8) & ~F.col("folder")).alias("has_image"),
    )


_SQL_CONTENT = """, content AS (SELECT d.*, EXISTS (SELECT 1 FROM deep k WHERE k.doc_id = d.doc_id
    AND k.parent_seq_id = d.seq_id) AS has_children, width > 8 AND NOT folder AS has_image FROM deep d)"""


@register(
    "drawable",
    _DEEP
    + _SQL_CONTENT
    + """SELECT doc_id, seq_id FROM content WHERE visible AND opacity <> 0 AND NOT clipping
      AND (has_children OR has_image)""",
)
def _drawable(spark, sf):
    return tree.drawable(with_content(deep_layers(spark, sf))).select("doc_id", "seq_id")


@register("non_empty", _DEEP + _SQL_CONTENT + "SELECT doc_id, seq_id FROM content WHERE has_image AND width * height > 0")
def _non_empty(spark, sf):
    return tree.non_empty(with_content(deep_layers(spark, sf))).select("doc_id", "seq_id")


@register(
    "supported_color",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 'unsupported color mode' END AS reason FROM orders""",
)
def _color(spark, sf):
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "O", "CMYK").otherwise("RGB").alias("color_mode"),
    )
    accepted, refused = tree.supported_color(docs)
    return accepted.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("doc_id", "reason")
    )


@register(
    "default_layers",
    """SELECT c_custkey AS doc_id, o_orderkey + 1 AS seq_id, o_orderpriority AS name, 200 AS opacity, 10 AS width, 20 AS height
      FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT c_custkey, 1, 'Layer Not Found', 255, 100 + c_nationkey, 200 + c_nationkey FROM customer
      WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""",
)
def _default(spark, sf):
    docs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("doc_id"),
        (F.col("c_nationkey") + 100).alias("canvas_w"),
        (F.col("c_nationkey") + 200).alias("canvas_h"),
    )
    layers = table(spark, sf, "orders").join(docs, F.col("o_custkey") == F.col("doc_id"), "left_semi").select(
        F.col("o_custkey").alias("doc_id"),
        (F.col("o_orderkey") + 1).alias("seq_id"),
        F.lit(-1).cast("bigint").alias("parent_seq_id"),
        F.col("o_orderkey").alias("ordinal"),
        F.col("o_orderpriority").alias("name"),
        F.lit("normal").alias("blend_mode"),
        F.lit(200).alias("opacity"),
        F.lit(0).alias("x"),
        F.lit(0).alias("y"),
        F.lit(10).alias("width"),
        F.lit(20).alias("height"),
    )
    return tree.default_layers(docs, layers).select("doc_id", "seq_id", "name", "opacity", "width", "height")

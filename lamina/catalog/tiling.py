"""Queries for tile maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.registry import register, table
from lamina.operators import tiles as T
from lamina.session import large
from lamina.session import stage_large as stage
from lamina.sources import tile_maps as M

C = F.col
W, H = 100, 70

# one picture per supplier, banded by nation so that many tiles repeat; edges are partial
IMAGES_SQL = f"""images AS (
  SELECT s_suppkey AS image_id, x, y, ((x // 16) * (s_nationkey % 5) + (y // 16)) % 7 * 36 AS r, (s_suppkey % 3) * 40 AS g,
    10::BIGINT AS b, 255::BIGINT AS a
  FROM supplier, (SELECT unnest(range({W})) AS x), (SELECT unnest(range({H})) AS y))"""


# suppliers to a task: 7 million pixels
SPREAD = 1000


def _spread(suppliers):
    """Suppliers over tasks by their number: a small file would be one task, however many pixels come from it."""
    return suppliers.repartition(-(-max(suppliers.count(), 1) // SPREAD), "s_suppkey")


def images(spark, sf):
    y = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(H - 1).cast("bigint"))).alias("y")
    x = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(W - 1).cast("bigint"))).alias("x")
    rows = _spread(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")).select("*", y).select("*", x)
    band = F.floor(C("x") / 16) * (C("s_nationkey") % 5) + F.floor(C("y") / 16)
    return rows.select(
        C("s_suppkey").alias("image_id"), "x", "y", (band % 7 * 36).alias("r"), (C("s_suppkey") % 3 * 40).alias("g"),
        F.lit(10).cast("bigint").alias("b"), F.lit(255).cast("bigint").alias("a"),
    )


def sizes(spark, sf):
    return large(table(spark, sf, "supplier")).select(
        C("s_suppkey").alias("image_id"), F.lit(W).cast("bigint").alias("width"), F.lit(H).cast("bigint").alias("height")
    )


CELLS_SQL = IMAGES_SQL + """, slots AS (
  SELECT image_id, x // 16 AS tx, y // 16 AS ty, (y % 16) * 16 + x % 16 AS s,
    lower(lpad(to_hex(((r * 256 + g) * 256 + b) * 256 + a), 8, '0')) AS v FROM images),
grid AS (SELECT DISTINCT image_id, tx, ty, unnest(range(256)) AS s FROM (SELECT DISTINCT image_id, tx, ty FROM slots)),
cells AS (SELECT image_id, tx, ty, ty * 1000000 + tx AS p, md5(unhex(px)) AS hash, px FROM (
  SELECT g.image_id, g.tx, g.ty, string_agg(coalesce(v, '00000000'), '' ORDER BY g.s) AS px
  FROM grid g LEFT JOIN slots USING (image_id, tx, ty, s) GROUP BY ALL))"""
DICT_SQL = CELLS_SQL + """, dict AS (SELECT hash, min(p) AS p, any_value(px) AS px, count(*) AS uses FROM cells GROUP BY hash),
gids AS (SELECT *, row_number() OVER (ORDER BY p, hash) AS gid FROM dict),
total AS (SELECT max(gid) AS n FROM gids),
packed AS (SELECT g.*, (gid - 1) // 4096 AS sheet, columns, (gid - 1) // 4096 * 4096 + 1 AS first_gid,
    ((gid - 1) % 4096) % columns AS cell_x, ((gid - 1) % 4096) // columns AS cell_y
  FROM (SELECT *, CASE WHEN (gid - 1) // 4096 < (n - 1) // 4096 THEN 64 ELSE (SELECT min(c) FROM (VALUES (4), (8), (16), (32), (64)) q(c)
      WHERE n - (n - 1) // 4096 * 4096 <= c * c) END::BIGINT AS columns FROM gids, total) g),
sheets AS (SELECT DISTINCT sheet, columns * 16 AS size, columns, columns * columns AS tile_count, first_gid FROM packed),
mapped AS (SELECT image_id, tx, ty, gid FROM cells JOIN gids USING (hash))"""

_W = "WITH "


@register("chop", _W + CELLS_SQL + "SELECT image_id, tx, ty, p, hash, px FROM cells")
def _chop(spark, sf):
    return T.chop(images(spark, sf)).withColumn("px", F.lower(F.hex("px")))


def raster_columns():
    """The same pictures from the supplier columns, one row of bytes each."""
    band = lambda i: F.floor(i % W / 16) * (C("s_nationkey") % 5) + F.floor(F.floor(i / W) / 16)
    value = lambda i: ((band(i) % 7 * 36 * 256 + C("s_suppkey") % 3 * 40) * 256 + 10) * 256 + 255
    text = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(W * H - 1).cast("bigint")),
        lambda i: F.lpad(F.hex(value(i).cast("bigint")), 8, "0"),
    )
    side = lambda n, name: F.lit(n).cast("bigint").alias(name)
    return [
        C("s_suppkey").alias("image_id"), side(W, "width"), side(H, "height"),
        F.unhex(F.array_join(text, "")).alias("raster"),
    ]


def rasters(spark, sf):
    return _spread(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")).select(*raster_columns())


@register("chop_rasters", _W + CELLS_SQL + "SELECT image_id, tx, ty, p, hash, px FROM cells")
def _chop_rasters(spark, sf):
    return T.chop_rasters(rasters(spark, sf)).withColumn("px", F.lower(F.hex("px")))


def _cells(spark, sf):
    return stage(T.chop(images(spark, sf), sizes(spark, sf)), "cells")


def _build(spark, sf):
    """cells, dictionary, packed numbers."""
    cells = _cells(spark, sf)
    dictionary = stage(T.tile_dictionary(cells), "tiles")
    packed = T.pack_sheets(stage(T.assign_gids(dictionary), "numbered"))
    return cells, dictionary, packed


@register("tile_dictionary", _W + DICT_SQL + "SELECT hash, p, px, uses FROM dict")
def _dictionary(spark, sf):
    return T.tile_dictionary(T.chop(images(spark, sf))).withColumn("px", F.lower(F.hex("px")))


@register("tile_dictionary_crc32")
def _dictionary_crc(spark, sf):
    return T.tile_dictionary(T.chop(images(spark, sf), key="crc32")).select("hash", "p", "uses")


@register(
    "merge_dictionaries",
    _W + DICT_SQL + "SELECT hash, p, uses FROM dict",
)
def _merge(spark, sf):
    cells = _cells(spark, sf)
    half = lambda n: T.tile_dictionary(cells.filter(C("image_id") % 2 == n))
    return T.merge_dictionaries(half(0), half(1)).select("hash", "p", "uses")


@register("assign_gids", _W + DICT_SQL + "SELECT hash, p, gid FROM gids")
def _gids(spark, sf):
    return T.assign_gids(T.tile_dictionary(_cells(spark, sf))).select("hash", "p", "gid")


@register(
    "pack_sheets", _W + DICT_SQL + "SELECT hash, gid, sheet, columns, first_gid, cell_x, cell_y FROM packed"
)
def _pack(spark, sf):
    return _build(spark, sf)[2].select("hash", "gid", "sheet", "columns", "first_gid", "cell_x", "cell_y")


@register("tile_sheets", _W + DICT_SQL + "SELECT sheet, size, columns, tile_count, first_gid FROM sheets")
def _sheets(spark, sf):
    return T.tile_sheets(_build(spark, sf)[2])


@register("map_cells", _W + DICT_SQL + "SELECT image_id, tx, ty, gid FROM mapped")
def _map(spark, sf):
    cells, _, packed = _build(spark, sf)
    return T.map_cells(cells, packed)


@register(
    "sheet_pixels",
    _W
    + DICT_SQL
    + """SELECT sheet, cell_x * 16 + s % 16 AS x, cell_y * 16 + s // 16 AS y, ('0x' || substr(px, s * 8 + 1, 2))::BIGINT AS r,
      ('0x' || substr(px, s * 8 + 3, 2))::BIGINT AS g, ('0x' || substr(px, s * 8 + 5, 2))::BIGINT AS b,
      ('0x' || substr(px, s * 8 + 7, 2))::BIGINT AS a FROM packed, (SELECT unnest(range(256)) AS s)""",
)
def _sheet_pixels(spark, sf):
    _, dictionary, packed = _build(spark, sf)
    return T.sheet_pixels(dictionary, packed)


@register("rebuild_images", _W + IMAGES_SQL + "SELECT image_id, x, y, r, g, b, a FROM images")
def _rebuild(spark, sf):
    cells, dictionary, packed = _build(spark, sf)
    return T.rebuild_images(T.map_cells(cells, packed), T.tile_sheets(packed), packed, dictionary, sizes(spark, sf))


@register(
    "rebuild_lines",
    _W
    + IMAGES_SQL
    + """SELECT image_id, y, lower(string_agg(lpad(to_hex(((r * 256 + g) * 256 + b) * 256 + a), 8, '0'), '' ORDER BY x)) AS line
      FROM images GROUP BY image_id, y""",
)
def _rebuild_lines(spark, sf):
    cells, dictionary, packed = _build(spark, sf)
    found = T.rebuild_cells(T.map_cells(cells, packed), T.tile_sheets(packed), packed, dictionary, sizes(spark, sf))
    return T.rebuild_lines(found).withColumn("line", F.lower(F.hex("line")))


_SQL_PRINTS = CELLS_SQL + """, shape AS (SELECT image_id, max(tx) + 1 AS w, count(*) AS n FROM cells GROUP BY image_id),
sums AS (SELECT image_id, (ty * w + tx) // (n // 32) AS segment, sum(('0x' || substr(hash, 1, 8))::BIGINT)::BIGINT AS total
  FROM cells JOIN shape USING (image_id) WHERE n >= 32 AND (ty * w + tx) // (n // 32) < 32 GROUP BY ALL),
prints AS (SELECT s.image_id, coalesce(f, 0)::BIGINT AS fingerprint FROM shape s LEFT JOIN (
  SELECT image_id, sum(CASE WHEN total > before THEN 1::BIGINT << (31 - segment) ELSE 0 END) AS f FROM (
    SELECT *, lag(total, 1, 0) OVER (PARTITION BY image_id ORDER BY segment) AS before FROM sums) GROUP BY image_id) USING (image_id))"""


@register("image_fingerprint", _W + _SQL_PRINTS + "SELECT image_id, fingerprint FROM prints")
def _print(spark, sf):
    return T.image_fingerprint(T.chop(images(spark, sf)))


@register(
    "similarity_order",
    _W
    + _SQL_PRINTS
    + """, ranged AS (SELECT *, bit_count(xor(fingerprint, (SELECT arg_min(fingerprint, image_id) FROM prints)) & 4294967295)::INTEGER AS distance FROM prints)
    SELECT image_id, fingerprint, distance, row_number() OVER (ORDER BY distance DESC, fingerprint, image_id) AS position FROM ranged""",
)
def _similar(spark, sf):
    return T.similarity_order(stage(T.image_fingerprint(_cells(spark, sf)), "prints"))


def _mapped(spark, sf):
    cells, _, packed = _build(spark, sf)
    return stage(T.map_cells(cells, packed), "mapped"), T.tile_sheets(packed)


@register(
    "write_tile_maps_csv",
    _W
    + DICT_SQL
    + """SELECT image_id, string_agg(line, chr(10) ORDER BY ty) AS csv FROM (
      SELECT image_id, ty, string_agg(gid::VARCHAR, ',' ORDER BY tx) AS line FROM mapped GROUP BY ALL) GROUP BY image_id""",
)
def _csv(spark, sf):
    return M.tile_map_csv(_mapped(spark, sf)[0])


_SQL_JSON = """SELECT image_id, '{"width":7,"height":5,"tilewidth":16,"tileheight":16,"nextobjectid":1,"orientation":"orthogonal","renderorder":"right-down","version":1,"propertytypes":{"originalwidth":"int","originalheight":"int"},"properties":{"originalwidth":100,"originalheight":70},"tilesets":['
  || sets || '],"layers":[{"height":5,"name":"' || s_name || '","opacity":1,"type":"tilelayer","visible":true,"width":7,"x":0,"y":0,"data":['
  || string_agg(gid::VARCHAR, ',' ORDER BY ty, tx) || ']}]}' AS json
FROM mapped JOIN supplier ON s_suppkey = image_id JOIN (
  SELECT image_id, string_agg('{"firstgid":' || first_gid || ',"source":"' || sheet || '.tsx"}', ',' ORDER BY first_gid) AS sets
  FROM (SELECT DISTINCT image_id, sheet, first_gid FROM mapped JOIN packed USING (gid)) GROUP BY image_id) USING (image_id)
GROUP BY image_id, s_name, sets"""


def _named(spark, sf):
    names = table(spark, sf, "supplier").select(C("s_suppkey").alias("image_id"), C("s_name").alias("name"))
    return large(sizes(spark, sf).join(names, "image_id"))


def _documents(spark, sf, encoding="csv"):
    mapped, sheets = _mapped(spark, sf)
    return M.tile_map_json(mapped, _named(spark, sf), sheets, encoding)


@register("write_tile_maps_json", _W + DICT_SQL + _SQL_JSON)
def _json(spark, sf):
    return _documents(spark, sf)


_SQL_TURNED = "substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2)"


@register(
    "write_tile_maps_base64",
    _W
    + DICT_SQL
    + f"""SELECT image_id, 7 AS width, 5 AS height, to_base64(unhex(string_agg({_SQL_TURNED}, '' ORDER BY ty, tx))) AS payload
      FROM (SELECT *, printf('%08X', gid) AS h FROM mapped) GROUP BY image_id""",
)
def _base64(spark, sf):
    return M.tile_map_base64(_mapped(spark, sf)[0])


@register("scan_tile_maps", _W + DICT_SQL + "SELECT image_id, tx, ty, gid FROM mapped")
def _scan(spark, sf):
    return M.scan_tile_maps(_documents(spark, sf))


@register("scan_tile_maps_base64", _W + DICT_SQL + "SELECT image_id, tx, ty, gid FROM mapped")
def _scan64(spark, sf):
    return M.scan_tile_maps(_documents(spark, sf, "base64"))


_XML_CELLS = {
    "csv": """'<data encoding="csv">' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY ty) || chr(10)""",
    "xml": """'<data>' || chr(10) || string_agg(tags, '' ORDER BY ty)""",
}


def _sql_xml(encoding):
    return f"""SELECT image_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10)
      || '<map version="1.0" orientation="orthogonal" renderorder="right-down" width="7" height="5" tilewidth="16" tileheight="16" nextobjectid="1">' || chr(10)
      || chr(9) || '<properties>' || chr(10)
      || repeat(chr(9), 2) || '<property name="originalWidth" type="int" value="{W}"/>' || chr(10)
      || repeat(chr(9), 2) || '<property name="originalHeight" type="int" value="{H}"/>' || chr(10) || chr(9) || '</properties>' || chr(10)
      || sets || chr(9) || '<layer name="' || s_name || '" width="7" height="5">' || chr(10) || repeat(chr(9), 2)
      || {_XML_CELLS[encoding]} || repeat(chr(9), 2) || '</data>' || chr(10) || chr(9) || '</layer>' || chr(10) || '</map>' AS xml
    FROM (SELECT image_id, ty, string_agg(gid::VARCHAR, ',' ORDER BY tx) AS line,
        string_agg(repeat(chr(9), 3) || '<tile gid="' || gid || '"/>' || chr(10), '' ORDER BY tx) AS tags FROM mapped GROUP BY ALL)
    JOIN supplier ON s_suppkey = image_id JOIN (
      SELECT image_id, string_agg(chr(9) || '<tileset firstgid="' || first_gid || '" source="' || sheet || '.tsx"/>' || chr(10), '' ORDER BY first_gid) AS sets
      FROM (SELECT DISTINCT image_id, sheet, first_gid FROM mapped JOIN packed USING (gid)) GROUP BY image_id) USING (image_id)
    GROUP BY image_id, s_name, sets"""


def _xml_documents(spark, sf, encoding):
    mapped, sheets = _mapped(spark, sf)
    return M.tile_map_xml(mapped, _named(spark, sf), sheets, encoding)


@register("write_tile_maps_xml", _W + DICT_SQL + _sql_xml("csv"))
def _xml(spark, sf):
    return _xml_documents(spark, sf, "csv")


@register("write_tile_maps_xml_cells", _W + DICT_SQL + _sql_xml("xml"))
def _xml_cells(spark, sf):
    return _xml_documents(spark, sf, "xml")


@register("scan_tile_maps_xml", _W + DICT_SQL + "SELECT image_id, tx, ty, gid FROM mapped")
def _scan_xml(spark, sf):
    return M.scan_tile_maps_xml(_xml_documents(spark, sf, "base64"))


@register(
    "write_tile_maps_script",
    _W
    + DICT_SQL
    + """SELECT image_id, '((name, map) => { if (typeof onTileMapLoaded === "function") onTileMapLoaded(name, map); else (globalThis.TileMaps ??= {})[name] = map; })("'
      || s_name || '", ' || json || ');' AS script FROM ("""
    + _SQL_JSON
    + ") JOIN supplier ON s_suppkey = image_id",
)
def _script(spark, sf):
    return M.tile_map_script(_documents(spark, sf), _named(spark, sf))


@register(
    "tile_set_documents",
    _W
    + DICT_SQL
    + """SELECT sheet, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<tileset name="' || sheet || '" tilewidth="16" tileheight="16" tilecount="'
      || tile_count || '" columns="' || columns || '">' || chr(10) || '   <image source="' || sheet || '.png" width="' || size || '" height="' || size
      || '"/>' || chr(10) || '</tileset>' AS xml FROM sheets""",
)
def _set_documents(spark, sf):
    return M.tile_set_documents(T.tile_sheets(_build(spark, sf)[2]))


@register(
    "tile_set_catalog",
    _W
    + DICT_SQL
    + """SELECT sheet, '{"columns":' || columns || ',"firstgid":' || first_gid || ',"image":"' || sheet || '.png","imageheight":' || size
      || ',"imagewidth":' || size || ',"margin":0,"name":"' || sheet || '","spacing":0,"tilecount":' || tile_count
      || ',"tileheight":16,"tilewidth":16}' AS json FROM sheets""",
)
def _catalog(spark, sf):
    return M.tile_set_catalog(T.tile_sheets(_build(spark, sf)[2]), inline=True)

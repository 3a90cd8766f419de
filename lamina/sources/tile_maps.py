"""Tile maps as CSV, JSON, XML, script or base64 text, and sheet catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.tiles import SHEET_TILES, TILE

C = F.col


def _numbers(mapped: DataFrame) -> DataFrame:
    """(image_id, width, height, gids): an image's numbers in reading order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ty", "tx", "gid"))), lambda e: e["gid"])
    return mapped.groupBy("image_id").agg(
        (F.max("tx") + 1).alias("width"), (F.max("ty") + 1).alias("height"), ordered.alias("gids")
    )


def _little_endian(gids: Column) -> Column:
    word = lambda g: F.lpad(F.hex(g), 8, "0")
    turned = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    return F.unhex(F.array_join(F.transform(gids, lambda g: turned(word(g))), ""))


def tile_map_csv(mapped: DataFrame, between: str = "\n") -> DataFrame:
    """(image_id, csv): one line per tile row, with ``between`` after each but the last."""
    rows = mapped.groupBy("image_id", "ty").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tx", "gid"))), lambda e: e["gid"].cast("string")), ",").alias("line")
    )
    return rows.groupBy("image_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ty", "line"))), lambda e: e["line"]), between).alias("csv")
    )


def tile_map_base64(mapped: DataFrame) -> DataFrame:
    """(image_id, width, height, payload): little-endian 32-bit numbers."""
    payload = F.replace(F.base64(_little_endian(C("gids"))), F.lit("\r\n"), F.lit(""))
    return _numbers(mapped).select("image_id", "width", "height", payload.alias("payload"))


def tile_set_entry(inline: bool = False, folder: str = "") -> Column:
    """One sheet as a reference or spelled out, from the columns of ``tile_sheets``."""
    name = C("sheet").cast("string")
    if not inline:
        return F.struct(
            C("first_gid").alias("firstgid"), F.concat(F.lit(folder), name, F.lit(".tsx")).alias("source")
        )
    return F.struct(
        C("columns"),
        C("first_gid").alias("firstgid"),
        F.concat(F.lit(folder), name, F.lit(".png")).alias("image"),
        C("size").alias("imageheight"),
        C("size").alias("imagewidth"),
        F.lit(0).alias("margin"),
        name.alias("name"),
        F.lit(0).alias("spacing"),
        C("tile_count").alias("tilecount"),
        F.lit(TILE).alias("tileheight"),
        F.lit(TILE).alias("tilewidth"),
    )


def tile_set_catalog(sheets: DataFrame, inline: bool = False) -> DataFrame:
    """(sheet, json) for every sheet."""
    return sheets.select("sheet", F.to_json(tile_set_entry(inline)).alias("json"))


def tile_map_json(mapped: DataFrame, images: DataFrame, sheets: DataFrame, encoding: str = "csv", inline: bool = False) -> DataFrame:
    """(image_id, json): map documents. ``images``: image_id, name, width and height in pixels.

    A document lists the sheets its own numbers fall on, with their first numbers.
    """
    used = mapped.select("image_id", F.floor((C("gid") - 1) / SHEET_TILES).alias("sheet")).distinct()
    sets = used.join(sheets, "sheet").groupBy("image_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first_gid", tile_set_entry(inline).alias("e")))), lambda v: v["e"]).alias("sets")
    )
    rows = _numbers(mapped).join(sets, "image_id").join(
        images.select("image_id", "name", C("width").alias("pw"), C("height").alias("ph")), "image_id"
    )
    common = [
        C("height"), C("name"), F.lit(1).alias("opacity"), F.lit("tilelayer").alias("type"),
        F.lit(True).alias("visible"), C("width"), F.lit(0).alias("x"), F.lit(0).alias("y"),
    ]
    if encoding == "csv":
        body = [C("gids").alias("data")]
    elif encoding == "base64":
        payload = F.replace(F.base64(_little_endian(C("gids"))), F.lit("\r\n"), F.lit(""))
        body = [F.lit("base64").alias("encoding"), payload.alias("data")]
    else:
        raise ValueError(f"unknown tile format: {encoding}")
    document = F.struct(
        C("width"),
        C("height"),
        F.lit(TILE).alias("tilewidth"),
        F.lit(TILE).alias("tileheight"),
        F.lit(1).alias("nextobjectid"),
        F.lit("orthogonal").alias("orientation"),
        F.lit("right-down").alias("renderorder"),
        F.lit(1).alias("version"),
        F.struct(F.lit("int").alias("originalwidth"), F.lit("int").alias("originalheight")).alias("propertytypes"),
        F.struct(C("pw").alias("originalwidth"), C("ph").alias("originalheight")).alias("properties"),
        C("sets").alias("tilesets"),
        F.array(F.struct(*common, *body)).alias("layers"),
    )
    return rows.select("image_id", F.to_json(document).alias("json"))


def _xml_text(value: Column) -> Column:
    """Text as it may stand in an attribute."""
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def _tag(element: str, body: Column | None = None, /, **attributes: Column) -> Column:
    """An element with its attributes in the order given; closed at once without a body."""
    parts = [F.lit(f"<{element}")]
    for key, value in attributes.items():
        parts += [F.lit(f' {key}="'), _xml_text(value.cast("string")), F.lit('"')]
    return F.concat(*parts, *([F.lit("/>")] if body is None else [F.lit(">"), body, F.lit(f"</{element}>")]))


def tile_set_tag(inline: bool = False, folder: Column | None = None) -> Column:
    """One sheet as an element, from the columns of ``tile_sheets``: a reference or spelled out."""
    folder = F.lit("") if folder is None else folder
    name = C("sheet").cast("string")
    if not inline:
        return _tag("tileset", firstgid=C("first_gid"), source=F.concat(folder, name, F.lit(".tsx")))
    image = _tag("image", source=F.concat(folder, name, F.lit(".png")), width=C("size"), height=C("size"))
    side = F.lit(TILE)
    return _tag(
        "tileset", image, firstgid=C("first_gid"), name=name, tilewidth=side, tileheight=side,
        tilecount=C("tile_count"), columns=C("columns"),
    )


def tile_set_documents(sheets: DataFrame) -> DataFrame:
    """(sheet, xml): the files that references point to."""
    name, side = C("sheet").cast("string"), F.lit(TILE)
    image = _tag("image", source=F.concat(name, F.lit(".png")), width=C("size"), height=C("size"))
    body = F.concat(F.lit("\n   "), image, F.lit("\n"))
    whole = _tag("tileset", body, name=name, tilewidth=side, tileheight=side, tilecount=C("tile_count"), columns=C("columns"))
    return sheets.select("sheet", F.concat(F.lit(_XML_HEAD), whole).alias("xml"))


# Fixed value: first line of XML documents.
_XML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n'


def tile_map_xml(mapped: DataFrame, images: DataFrame, sheets: DataFrame, encoding: str = "csv", inline: bool = False) -> DataFrame:
    """(image_id, xml): map documents. ``images``: image_id, name, width and height in pixels.

    ``encoding`` is csv, base64 or xml (one element a cell). A name with backslashes lies that many
    folders below the sheets. A document lists the sheets its own numbers fall on.
    """
    named = images.select("image_id", "name", C("width").alias("pw"), C("height").alias("ph"))
    depth = F.length("name") - F.length(F.replace("name", F.lit("\\"), F.lit("")))
    used = mapped.select("image_id", F.floor((C("gid") - 1) / SHEET_TILES).alias("sheet")).distinct()
    tags = used.join(sheets, "sheet").join(named, "image_id").select(
        "image_id", "first_gid", tile_set_tag(inline, F.repeat(F.lit("..\\"), depth)).alias("tag")
    )
    line = lambda depth, *parts: F.concat(F.lit("\t" * depth), *parts, F.lit("\n"))
    sets = tags.groupBy("image_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_gid", "tag"))), lambda v: line(1, v["tag"])), "").alias("sets")
    )
    rows = _numbers(mapped).join(sets, "image_id").join(named, "image_id")
    if encoding == "csv":
        rows = rows.join(tile_map_csv(mapped, ",\n"), "image_id")
        opening, data = '<data encoding="csv">', F.concat("csv", F.lit("\n"))
    elif encoding == "base64":
        payload = F.replace(F.base64(_little_endian(C("gids"))), F.lit("\r\n"), F.lit(""))
        opening, data = '<data encoding="base64">', line(3, payload)
    elif encoding == "xml":
        cells = F.transform("gids", lambda g: line(3, _tag("tile", gid=g)))
        opening, data = "<data>", F.array_join(cells, "")
    else:
        raise ValueError(f"unknown tile format: {encoding}")
    side = F.lit(TILE)
    fact = lambda key, value: line(2, _tag("property", name=F.lit(key), type=F.lit("int"), value=value))
    layer = F.concat(line(0), line(2, F.lit(opening)), data, line(2, F.lit("</data>")), F.lit("\t"))
    body = F.concat(
        line(0), line(1, F.lit("<properties>")), fact("originalWidth", C("pw")), fact("originalHeight", C("ph")),
        line(1, F.lit("</properties>")), "sets", line(1, _tag("layer", layer, name=C("name"), width=C("width"), height=C("height"))),
    )
    document = _tag(
        "map", body, version=F.lit("1.0"), orientation=F.lit("orthogonal"), renderorder=F.lit("right-down"),
        width=C("width"), height=C("height"), tilewidth=side, tileheight=side, nextobjectid=F.lit(1),
    )
    return rows.select("image_id", F.concat(F.lit(_XML_HEAD), document).alias("xml"))


# Pages define onTileMapLoaded to be called with each map; without it maps gather in TileMaps (fixed names).
_SCRIPT = (
    '((name, map) => { if (typeof onTileMapLoaded === "function") onTileMapLoaded(name, map);'
    " else (globalThis.TileMaps ??= {})[name] = map; })("
)


def tile_map_script(documents: DataFrame, images: DataFrame) -> DataFrame:
    """(image_id, script): JSON documents of ``tile_map_json`` as scripts that pages load."""
    # a one-element array gives the name as a JSON text
    quoted = F.regexp_replace(F.to_json(F.array("name")), r"^\[|\]$", "")
    rows = documents.join(images.select("image_id", "name"), "image_id")
    return rows.select("image_id", F.concat(F.lit(_SCRIPT), quoted, F.lit(", "), "json", F.lit(");")).alias("script"))


def write_tile_maps(documents: DataFrame, path: str) -> None:
    """Write (image_id, csv or json) as JSON lines, so that every map stays with its image."""
    documents.write.json(path)


def read_tile_maps(spark: SparkSession, path: str, column: str = "json") -> DataFrame:
    """(image_id, text) as ``write_tile_maps`` wrote it."""
    return spark.read.schema(f"image_id long, {column} string").json(path)


_MAP = "struct<width:bigint,height:bigint,layers:array<struct<data:string,encoding:string,width:bigint,name:string>>>"


def scan_tile_maps(documents: DataFrame) -> DataFrame:
    """(image_id, tx, ty, gid) of (image_id, json) map documents, plain or base64.

    Other encodings give no cells; compressed payloads are not read.
    """
    layer = F.from_json("json", _MAP)["layers"][0]
    rows = documents.select("image_id", layer.alias("l"))
    plain = F.from_json("l.data", "array<bigint>")
    words = F.regexp_extract_all(F.hex(F.unbase64("l.data")), F.lit("[0-9A-F]{8}"), F.lit(0))
    turned = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    coded = F.transform(words, lambda h: F.conv(turned(h), 16, 10).cast("bigint"))
    data = F.when(C("l.encoding").isNull(), plain).when(C("l.encoding") == "base64", coded)
    cells = rows.select("image_id", C("l.width").alias("w"), F.posexplode(data).alias("at", "gid"))
    return cells.select("image_id", (C("at") % C("w")).alias("tx"), F.floor(C("at") / C("w")).alias("ty"), "gid")


def scan_tile_maps_xml(documents: DataFrame) -> DataFrame:
    """(image_id, tx, ty, gid) of (image_id, xml) map documents: csv, base64 or one element a cell.

    The first layer is read. Other encodings and compressed payloads give no cells.
    """
    at = lambda path: F.xpath_string("xml", F.lit(f"/map/layer[1]/{path}"))
    rows = documents.select(
        "image_id", at("@width").cast("bigint").alias("w"), at("data/@encoding").alias("encoding"),
        at("data/@compression").alias("packed"), F.regexp_replace(at("data"), r"\s", "").alias("text"),
        F.xpath("xml", F.lit("/map/layer[1]/data/tile/@gid")).alias("tiles"),
    )
    words = F.regexp_extract_all(F.hex(F.unbase64("text")), F.lit("[0-9A-F]{8}"), F.lit(0))
    turned = lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))
    data = (
        F.when(C("packed") != "", F.lit(None))
        .when(C("encoding") == "csv", F.transform(F.split("text", ","), lambda v: v.cast("bigint")))
        .when(C("encoding") == "base64", F.transform(words, lambda h: F.conv(turned(h), 16, 10).cast("bigint")))
        .when(C("encoding") == "", F.transform("tiles", lambda v: v.cast("bigint")))
    )
    cells = rows.select("image_id", "w", F.posexplode(data).alias("at", "gid"))
    return cells.select("image_id", (C("at") % C("w")).alias("tx"), F.floor(C("at") / C("w")).alias("ty"), "gid")

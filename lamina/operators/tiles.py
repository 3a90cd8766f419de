"""Images as tile maps: chopping, the tile dictionary, global numbers, sheets, rebuilding.

A tile is its 1024 bytes, row-major RGBA. Tiles are keyed by md5 of those bytes by default;
crc32 keys are there for exchange with 32-bit maps, where different tiles may share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.hashing import hamming32
from lamina.operators.scans import number_rows
from lamina.session import large

C = F.col

# Tile side, position stride of a tile row, largest sheet in tiles.
TILE = 16
ROW_STRIDE = 1_000_000
SHEET_TILES = 4096
SLOTS = TILE * TILE
BLANK = "00000000"

CELL = ["image_id", "tx", "ty"]


def tile_key(px: Column, key: str = "md5") -> Column:
    if key == "md5":
        return F.md5(px)
    if key == "crc32":
        return F.crc32(px)
    raise ValueError(f"unknown tile key: {key}")


def chop(images: DataFrame, sizes: DataFrame | None = None, key: str = "md5") -> DataFrame:
    """(image_id, tx, ty, p, hash, px): 16 x 16 cells, edges padded with clear pixels.

    Pixels of a tile's line meet first, two to a 64-bit word, in buffers of fixed width that combine
    map-side; then the at most 16 lines of a tile. A pixel occurs once, with channels 0..255. With
    ``sizes`` (image_id, width, height) cells without any pixel row come out as blank tiles too.
    """
    at = C("x") % TILE
    packed = ((C("r").cast("bigint") * 256 + C("g")) * 256 + C("b")) * 256 + C("a")
    rows = images.select(
        "image_id",
        F.floor(C("x") / TILE).alias("tx"),
        F.floor(C("y") / TILE).alias("ty"),
        (C("y") % TILE).cast("int").alias("dy"),
        F.floor(at / 2).alias("w"),
        F.when(at % 2 == 0, F.shiftleft(packed, 32)).otherwise(packed).alias("v"),
    )
    words = [F.coalesce(F.bit_or(F.when(C("w") == k, C("v"))), F.lit(0).cast("bigint")).alias(f"w{k}") for k in range(TILE // 2)]
    lines = rows.groupBy(*CELL, "dy").agg(*words)
    line = F.unhex(F.concat(*[F.lpad(F.hex(f"w{k}"), 16, "0") for k in range(TILE // 2)]))
    cells = lines.select(*CELL, "dy", line.alias("line")).groupBy(*CELL).agg(
        F.map_from_entries(F.collect_list(F.struct("dy", "line"))).alias("lines")
    )
    clear = F.unhex(F.lit(BLANK * TILE))
    px = F.concat(*[F.coalesce(F.try_element_at("lines", F.lit(dy)), clear) for dy in range(TILE)])
    out = cells.select(*CELL, px.alias("px"))
    if sizes is not None:
        up = lambda side: F.ceil(C(side) / TILE) - 1
        grid = (
            sizes.select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), up("height"))).alias("ty"), "width")
            .select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), up("width"))).alias("tx"), "ty")
        )
        blank = F.unhex(F.lit(BLANK * SLOTS))
        out = grid.join(large(out), CELL, "left").withColumn("px", F.coalesce("px", blank))
    place = C("ty") * ROW_STRIDE + C("tx")
    return out.select(*CELL, place.alias("p"), tile_key(C("px"), key).alias("hash"), "px")


def chop_rasters(rasters: DataFrame, key: str = "md5") -> DataFrame:
    """``chop`` for whole pictures (image_id, width, height, raster): row-local, no shuffle.

    ``raster`` is row-major RGBA bytes; a tile is sixteen slices of it.
    """
    cells = rasters.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(C("height") / TILE) - 1)).alias("ty")
    ).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(C("width") / TILE) - 1)).alias("tx"))
    span = F.least(F.lit(TILE), C("width") - C("tx") * TILE) * 4
    clear = F.unhex(F.lit(BLANK * TILE))

    def line(dy: int) -> Column:
        y = C("ty") * TILE + dy
        start = (y * C("width") + C("tx") * TILE) * 4 + 1
        piece = F.substring("raster", start.cast("int"), span.cast("int"))
        return F.when(y < C("height"), F.substring(F.concat(piece, clear), 1, TILE * 4)).otherwise(clear)

    px = F.concat(*[line(dy) for dy in range(TILE)])
    place = C("ty") * ROW_STRIDE + C("tx")
    return cells.select("image_id", "tx", "ty", place.alias("p"), px.alias("px")).select(
        *CELL, "p", tile_key(C("px"), key).alias("hash"), "px"
    )


def tile_dictionary(cells: DataFrame) -> DataFrame:
    """(hash, p, px, uses): distinct tiles with their smallest position.

    Grouping by key and bytes keeps the buffer to two numbers, so map-side hash aggregation
    absorbs a tile that fills a third of all cells. Tiles that share a crc32 key merge after it.
    """
    return _one_per_key(cells.groupBy("hash", "px").agg(F.min("p").alias("p"), F.count("*").alias("uses")))


def _one_per_key(exact: DataFrame) -> DataFrame:
    if dict(exact.dtypes)["hash"] != "string":
        exact = exact.groupBy("hash").agg(
            F.min_by("px", F.struct("p", "px")).alias("px"), F.min("p").alias("p"), F.sum("uses").alias("uses")
        )
    return exact.select("hash", "p", "px", "uses")


def merge_dictionaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two dictionaries, smallest position and total uses per tile."""
    both = a.unionByName(b).groupBy("hash", "px").agg(F.min("p").alias("p"), F.sum("uses").alias("uses"))
    return _one_per_key(both)


def assign_gids(dictionary: DataFrame) -> DataFrame:
    """(hash, p, uses, gid): dense numbers from 1 by position, then key."""
    return number_rows(dictionary.select("hash", "p", "uses"), ["p", "hash"], "gid", "gids")


def pack_sheets(gids: DataFrame) -> DataFrame:
    """Adds sheet, columns, first_gid and the tile's cell on its sheet.

    All sheets but the last hold 64 x 64 tiles; the last is the smallest square that fits.
    """
    total = gids.agg(F.max("gid")).first()[0] or 0
    last = (total - 1) // SHEET_TILES if total else 0
    rest = total - last * SHEET_TILES
    small = next(c for c in (4, 8, 16, 32, 64) if rest <= c * c)
    at = C("gid") - 1
    sheet = F.floor(at / SHEET_TILES)
    columns = F.when(sheet == last, small).otherwise(64).cast("bigint")
    index = at % SHEET_TILES
    return gids.withColumns(
        {
            "sheet": sheet,
            "columns": columns,
            "first_gid": sheet * SHEET_TILES + 1,
            "cell_x": index % columns,
            "cell_y": F.floor(index / columns),
        }
    )


def tile_sheets(packed: DataFrame) -> DataFrame:
    """(sheet, size, columns, tile_count, first_gid); broadcast in joins, as there is one row for 4096 tiles."""
    rows = packed.groupBy("sheet", "columns", "first_gid").agg(F.count("*").alias("used"))
    return F.broadcast(rows).select(
        "sheet",
        (C("columns") * TILE).alias("size"),
        "columns",
        (C("columns") * C("columns")).alias("tile_count"),
        "first_gid",
    )


HOT_SHARE = 1000


def _lookup(cells: DataFrame, small: DataFrame, key: str, salt: list[str]) -> DataFrame:
    """Join cells to a table unique by ``key`` that knows its ``uses``.

    A key used by more than 1/1000 of all cells is hot, and there are fewer than 1000 such
    keys, so those rows may be broadcast. Hot cells are spread over tasks by a salt that
    matches nothing; all others meet the table in a plain shuffle join.
    """
    total = small.agg(F.sum("uses")).first()[0] or 0
    hot = C("uses") * HOT_SHARE > total
    values = [c for c in small.columns if c not in (key, "uses")]
    packed = small.select(key, hot.alias("__hot"), F.struct(*values).alias("__v"))
    few = packed.filter("__hot").select(key, C("__v").alias("__h"))
    rest = packed.filter(~C("__hot")).select(C(key).cast("string").alias("__k"), C("__v").alias("__c"))
    spread = F.concat(F.lit("#"), F.pmod(F.xxhash64(*salt), F.lit(1 << 20)).cast("string"))
    tagged = cells.join(F.broadcast(few), key, "left").withColumn(
        "__k", F.when(C("__h").isNull(), C(key).cast("string")).otherwise(spread)
    )
    joined = tagged.join(rest, "__k", "left").withColumn("__v", F.coalesce("__h", "__c"))
    missing = F.raise_error(F.concat(F.lit(f"no {key} in the dictionary: "), C(key).cast("string")))
    found = joined.withColumn("__v", F.when(C("__v").isNull(), missing).otherwise(C("__v")))
    return found.select(*cells.columns, *[C(f"__v.{v}").alias(v) for v in values])


def map_cells(cells: DataFrame, gids: DataFrame) -> DataFrame:
    """(image_id, tx, ty, gid). A cell without a dictionary entry is an error; ``unmapped_cells`` lists them."""
    slim = cells.select(*CELL, "hash")
    return _lookup(slim, gids.select("hash", "uses", "gid"), "hash", CELL).select(*CELL, "gid")


def unmapped_cells(cells: DataFrame, gids: DataFrame) -> DataFrame:
    """Cells whose tile is missing from the dictionary; none in a consistent build."""
    return cells.select(*CELL, "hash").join(gids.select("hash"), "hash", "left_anti")


def _channels(raster: Column, at: Column) -> list[Column]:
    """r, g, b, a of pixel number ``at`` of RGBA bytes."""
    value = F.conv(F.hex(F.substring(raster, (at * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("bigint")
    return [F.shiftright(value, 24 - 8 * k).bitwiseAND(F.lit(255).cast("bigint")).alias(n) for k, n in enumerate("rgba")]


def _numbers(below: Column) -> Column:
    """0, 1, ... up to ``below``; none for 0 and less."""
    return F.slice(F.sequence(F.lit(0).cast("bigint"), F.greatest(below, F.lit(1)) - 1), F.lit(1), F.greatest(below, F.lit(0)).cast("int"))


def _tile_lines(df: DataFrame, keep: list[Column], height: Column) -> DataFrame:
    """The first ``height`` lines of each tile: keep, dy, line."""
    rows = df.select(*keep, "px", F.explode(_numbers(height)).alias("dy"))
    line = F.substring("px", (C("dy") * (TILE * 4) + 1).cast("int"), F.lit(TILE * 4))
    return rows.withColumn("line", line).drop("px")


def sheet_pixels(dictionary: DataFrame, packed: DataFrame) -> DataFrame:
    """(sheet, x, y, r, g, b, a): tile bytes at their place on the sheets."""
    rows = packed.select("hash", "sheet", "cell_x", "cell_y").join(dictionary.select("hash", "px"), "hash")
    lines = _tile_lines(rows, [C("sheet"), C("cell_x"), C("cell_y")], F.lit(TILE).cast("bigint"))
    px = lines.select("*", F.explode(_numbers(F.lit(TILE).cast("bigint"))).alias("dx"))
    return px.select(
        "sheet", (C("cell_x") * TILE + C("dx")).alias("x"), (C("cell_y") * TILE + C("dy")).alias("y"),
        *_channels(C("line"), C("dx")),
    )


def sheet_rasters(dictionary: DataFrame, packed: DataFrame) -> DataFrame:
    """(sheet, size, raster): whole sheets as RGBA bytes, unused cells clear; at most 4 MiB each."""
    rows = packed.select("hash", "sheet", "columns", "cell_x", "cell_y").join(dictionary.select("hash", "px"), "hash")
    lines = rows.select(
        "sheet", "columns", "cell_x", "cell_y",
        F.posexplode(F.regexp_extract_all(F.hex("px"), F.lit("[0-9A-F]{128}"), F.lit(0))).alias("dy", "v"),
    )
    blank = F.lit("0" * 128)
    strip = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("cell_x", "v"))), lambda e: e["v"]), "")
    # tiles fill a sheet row from the left, so only the right end needs padding
    strips = lines.groupBy("sheet", "columns", (C("cell_y") * TILE + C("dy")).alias("y")).agg(
        F.concat(strip, F.repeat(blank, (F.any_value("columns") - F.count("*")).cast("int"))).alias("row")
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "row"))), lambda e: e["row"]), "")
    size = (C("columns") * TILE).alias("size")
    joined = strips.groupBy("sheet", "columns").agg(whole.alias("body"), F.count("*").alias("n"))
    missing = F.repeat(F.repeat(blank, C("columns").cast("int")), (C("columns") * TILE - C("n")).cast("int"))
    return joined.select("sheet", size, F.unhex(F.concat("body", missing)).alias("raster"))


def rebuild_cells(mapped: DataFrame, sheets: DataFrame, packed: DataFrame, dictionary: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, tx, ty, width, height, px): every cell of the maps with its tile's bytes from the sheets.

    A gid belongs to the sheet whose range holds it. Sheets start at multiples of 4096, so the
    range join is an equi-join on that block with the range as a check.
    """
    block = lambda g: F.floor((g - 1) / SHEET_TILES)
    ranges = sheets.select(block(C("first_gid")).alias("__b"), "sheet", "columns", "first_gid", "tile_count")
    tiles = (
        packed.select("hash", "sheet", "cell_x", "cell_y", "uses")
        .join(dictionary.select("hash", "px"), "hash")
        .join(ranges.select("sheet", "first_gid", "columns"), "sheet")
    )
    # a tile's number follows from its place, as a reader of the sheets would see it
    by_gid = tiles.select((C("first_gid") + C("cell_y") * C("columns") + C("cell_x")).alias("gid"), "uses", "px")
    known = mapped.withColumn("__b", block(C("gid"))).join(ranges, "__b").filter(
        (C("gid") >= C("first_gid")) & (C("gid") < C("first_gid") + C("tile_count"))
    )
    sized = known.join(sizes.select("image_id", "width", "height"), "image_id").select(*CELL, "gid", "width", "height")
    return _lookup(sized, by_gid, "gid", CELL).select(*CELL, "width", "height", "px")


def rebuild_lines(cells: DataFrame) -> DataFrame:
    """(image_id, y, line): pictures as RGBA bytes of whole lines, cut to original size, from ``rebuild_cells``.

    The cells of one tile row meet as bytes, one row a cell, and are sliced into its picture lines there.
    Cells that a map lacks are clear; a tile row without any cell gives no lines.
    """
    strips = cells.groupBy("image_id", "ty").agg(
        F.sort_array(F.collect_list(F.struct("tx", F.hex("px").alias("v")))).alias("es"),
        F.any_value("width").alias("width"), F.any_value("height").alias("height"),
    )
    row = TILE * 8
    gap = lambda n: F.repeat(F.lit(BLANK * TILE), F.greatest(n, F.lit(0)).cast("int"))
    before = lambda i: F.when(i > 0, F.get("es", i - 1)["tx"]).otherwise(F.lit(-1))
    y = C("ty") * TILE + C("dy")
    rows = strips.select("*", F.explode(_numbers(F.least(F.lit(TILE), C("height") - C("ty") * TILE))).alias("dy"))
    pieces = F.transform("es", lambda e, i: F.concat(gap(e["tx"] - before(i) - 1), F.substring(e["v"], (C("dy") * row + 1).cast("int"), F.lit(row))))
    tail = gap(F.ceil(C("width") / TILE) - 1 - F.try_element_at("es", F.lit(-1))["tx"])
    whole = F.unhex(F.concat(F.array_join(pieces, ""), tail))
    return rows.select("image_id", y.alias("y"), F.substring(whole, F.lit(1), (C("width") * 4).cast("int")).alias("line"))


def rebuild_images(mapped: DataFrame, sheets: DataFrame, packed: DataFrame, dictionary: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, x, y, r, g, b, a): maps and sheets back to pictures, cut to original size.

    Cells are cut to the picture before they are spread into lines, and those into pixels, in place:
    nothing is shuffled after the tiles are found.
    """
    cells = rebuild_cells(mapped, sheets, packed, dictionary, sizes)
    inside = lambda side, at: F.least(F.lit(TILE).cast("bigint"), C(side) - C(at) * TILE)
    lines = _tile_lines(cells, [*(C(c) for c in CELL), inside("width", "tx").alias("span"), C("height")], inside("height", "ty"))
    px = lines.select("*", F.explode(_numbers(C("span"))).alias("dx"))
    return px.select(
        "image_id", (C("tx") * TILE + C("dx")).alias("x"), (C("ty") * TILE + C("dy")).alias("y"),
        *_channels(C("line"), C("dx")),
    )


SEGMENTS = 32


def image_fingerprint(cells: DataFrame) -> DataFrame:
    """(image_id, fingerprint): 32 bits, each telling whether a segment's hash sum grew.

    Cells in reading order are cut into 32 equal segments, a remainder is left out, and images
    of fewer than 32 cells give 0. md5 keys count with their first 32 bits.
    """
    word = C("hash") if dict(cells.dtypes)["hash"] != "string" else F.conv(F.substring("hash", 1, 8), 16, 10).cast("bigint")
    shape = cells.groupBy("image_id").agg((F.max("tx") + 1).alias("w"), F.count("*").alias("n"))
    per = F.floor(C("n") / SEGMENTS)
    rows = (
        cells.select("image_id", "tx", "ty", word.alias("word"))
        .join(shape, "image_id")
        .filter(C("n") >= SEGMENTS)
        .select("image_id", F.floor((C("ty") * C("w") + C("tx")) / per).alias("segment"), "word")
        .filter(C("segment") < SEGMENTS)
    )
    sums = rows.groupBy("image_id", "segment").agg(F.sum("word").alias("total"))
    bits = sums.groupBy("image_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("segment", "total"))), lambda e: e["total"]).alias("t")
    )
    earlier = lambda i: F.when(i > 0, F.get("t", i - 1)).otherwise(F.lit(0))
    grew = F.transform("t", lambda v, i: F.when(v > earlier(i), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))
    value = F.aggregate(grew, F.lit(0).cast("bigint"), lambda h, b: h * 2 + b)
    marked = bits.select("image_id", value.alias("__f"))
    return shape.select("image_id").join(marked, "image_id", "left").select(
        "image_id", F.coalesce("__f", F.lit(0)).cast("bigint").alias("fingerprint")
    )


def similarity_order(fingerprints: DataFrame) -> DataFrame:
    """Adds ``distance`` to the first image and ``position``, far images first."""
    first = fingerprints.agg(F.min_by("fingerprint", "image_id")).first()[0]
    rows = fingerprints.withColumn("distance", hamming32(C("fingerprint"), F.lit(first or 0).cast("bigint")))
    return number_rows(rows, [C("distance").desc(), "fingerprint", "image_id"], "position", "similar")

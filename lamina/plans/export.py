"""Every distinct picture of every saved view, drawn once and exported as tile maps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import tiles as T
from lamina.operators import views as V
from lamina.operators.groups import compose_groups
from lamina.operators.pixels import ALL_MODES
from lamina.operators.scans import number_rows
from lamina.session import stage_large as stage
from lamina.session import tables_by_document

C = F.col


@dataclass
class TileExport:
    """Tables of one export: which view shows which image, and the images as tile maps."""

    views: DataFrame
    images: DataFrame
    cells: DataFrame
    dictionary: DataFrame
    packed: DataFrame
    mapped: DataFrame
    order: DataFrame


def draw_flags(layers: DataFrame, pixels: DataFrame, masks: DataFrame, flags: DataFrame, modes: Sequence[str] = ALL_MODES) -> DataFrame:
    """(image_id, x, y, r, g, b, a): one picture per ``image_id`` of ``flags``.

    ``flags``: image_id, doc_id, seq_id, checked for every layer. Hidden layers meet no pixels.
    """
    each = flags.select("image_id", "doc_id", "seq_id", "checked")
    tree = each.join(layers.drop("checked", "visible"), ["doc_id", "seq_id"]).select(
        C("image_id").alias("doc_id"), "seq_id", C("checked").alias("visible"),
        *[c for c in layers.columns if c not in ("doc_id", "seq_id", "checked", "visible")],
    )
    lit = each.filter("checked").select("image_id", "doc_id", "seq_id")
    spread = lambda rows: rows.join(lit, ["doc_id", "seq_id"]).drop("doc_id").withColumnRenamed("image_id", "doc_id")
    drawn = tables_by_document([tree, spread(pixels), spread(masks)], lambda *part: [compose_groups(*part, modes)])[0]
    return drawn.withColumnRenamed("doc_id", "image_id")


def _pictures(nodes: DataFrame, layers: DataFrame) -> list[DataFrame]:
    """Views by picture, one view to draw for each picture, and its flags: (doc_id, render_key, seq_id, checked).

    Nothing here looks across documents.
    """
    picture = ["doc_id", "render_key"]
    selects = stage(V.view_selects(V.favorites_walk(nodes)), "selects")
    views = stage(V.enumerate_views(selects), "views")
    deltas = stage(V.item_deltas(layers, selects), "deltas")
    keys = stage(V.view_keys(layers, selects, views, deltas), "keys")
    pictures = stage(V.distinct_pictures(keys), "firstviews")
    shown_first = pictures.select("doc_id", "root_id", "view_index", "render_key")
    of_pictures = stage(views.join(shown_first, ["doc_id", "root_id", "view_index"]), "pictureviews")
    resolved = V.resolve_views(layers, selects, of_pictures.drop("render_key"), deltas)
    chosen = resolved.join(shown_first, ["doc_id", "root_id", "view_index"])
    flags = (
        pictures.select(*picture)
        .join(layers.select("doc_id", "seq_id", "checked"), "doc_id")
        .join(chosen.select(*picture, "seq_id", C("checked").alias("__set")), [*picture, "seq_id"], "left")
        .select(*picture, "seq_id", F.coalesce("__set", "checked").alias("checked"))
    )
    return [keys, pictures, flags]


def export_views(nodes: DataFrame, layers: DataFrame, pixels: DataFrame, masks: DataFrame, sizes: DataFrame, modes: Sequence[str] = ALL_MODES) -> TileExport:
    """Enumerate views, drop repeated pictures, draw, chop, number and map.

    ``layers`` carries paths, kinds, ``checked``, ``ancestors`` and ``has_mask`` besides drawing
    attributes; ``sizes`` has doc_id, width and height.
    """
    keys, firsts, flags = tables_by_document([nodes, layers], _pictures)
    picture = ["doc_id", "render_key"]
    pictures = stage(number_rows(firsts, picture, "image_id", "pictures"), "pictures")
    numbers = pictures.select(*picture, "image_id")
    shown = keys.join(numbers, picture).drop("render_key")
    flags = flags.join(numbers, picture).select("image_id", "doc_id", "seq_id", "checked")
    images = pictures.select("image_id", "doc_id").join(sizes, "doc_id")
    flat = draw_flags(layers, pixels, masks, stage(flags, "flags"), modes)
    cells = stage(T.chop(flat, images.select("image_id", "width", "height")), "cells")
    dictionary = stage(T.tile_dictionary(cells), "tiles")
    packed = T.pack_sheets(stage(T.assign_gids(dictionary), "gids"))
    order = T.similarity_order(stage(T.image_fingerprint(cells), "prints"))
    return TileExport(shown, images, cells, dictionary, packed, T.map_cells(cells, packed), order)

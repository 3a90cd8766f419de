"""From layer tables to what a document shows when it is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import tree
from lamina.operators.views import pick_version
from lamina.session import stage


def open_documents(layers: DataFrame) -> DataFrame:
    """Layer table ready for states: paths, kinds, normalised flags and clip bases."""
    paths = stage(tree.tree_paths(layers), "open")
    kinds = tree.normalize_radios(paths)
    return tree.clip_base(kinds.withColumn("visible", F.col("checked")))


def opening_favorites(docs: DataFrame, versions: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """The favorites text each document opens with; documents without one are left out."""
    return pick_version(docs, versions, dropped).filter("data is not null")

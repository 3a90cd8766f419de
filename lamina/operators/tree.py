"""Layer trees kept as adjacency lists: paths, ancestry, visibility, clipping, radios, mirrors.

Rows are ``(doc_id, seq_id, parent_seq_id, ordinal, ...)`` with parent -1 at the top and
ordinal ascending from bottom to top. ``ordinal`` is unique among siblings.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions.names import encode_name, layer_flags
from lamina.operators.scans import last_before, rank_in_group, running_sum
from lamina.session import large
from lamina.session import stage_large as stage

TOP = -1
SIBLINGS = ["doc_id", "parent_seq_id"]
NODE = ["doc_id", "seq_id"]

Carried = Mapping[str, tuple[Column, Callable[[Callable[[str], Column]], Column]]]


def tree_walk(
    nodes: DataFrame,
    carry: Carried,
    inner: Column | None = None,
    node_id: str = "seq_id",
    parent_id: str = "parent_seq_id",
    top=TOP,
    label: str = "walk",
) -> DataFrame:
    """Hand values down the tree, one equi-join per level.

    ``carry`` maps a name to its value on top rows and a function giving the value on a child;
    that function receives ``up(name)`` for the parent's value. ``inner`` marks rows that may
    have children, so the last level costs no join. Orphans and cycles are never reached.
    Each level is staged, so its lineage is one join.
    """
    nodes = nodes.drop("depth", *carry)
    is_top = F.col(parent_id) == F.lit(top)
    kids = nodes.filter(~is_top)
    level = stage(
        nodes.filter(is_top).select(
            "*", F.lit(1).alias("depth"), *[root.alias(n) for n, (root, _) in carry.items()]
        ),
        label,
    )
    levels = [level]
    while True:
        front = level if inner is None else level.filter(inner)
        if front.isEmpty():
            break
        up = front.select(
            F.col("doc_id").alias("__doc"),
            F.col(node_id).alias("__node"),
            F.col("depth").alias("__depth"),
            *[F.col(n).alias("__up_" + n) for n in carry],
        )
        on = (F.col("doc_id") == F.col("__doc")) & (F.col(parent_id) == F.col("__node"))
        level = stage(
            kids.join(up, on).select(
                *nodes.columns,
                (F.col("__depth") + 1).alias("depth"),
                *[f(lambda n: F.col("__up_" + n)).alias(n) for n, (_, f) in carry.items()],
            ),
            label,
        )
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


Folds = Mapping[str, tuple[Column, Callable[[Column, Column], Column]]]


def tree_fold(
    nodes: DataFrame,
    folds: Folds,
    inner: Column | None = None,
    node_id: str = "seq_id",
    parent_id: str = "parent_seq_id",
    top=TOP,
    label: str = "fold",
    staged: bool = False,
) -> DataFrame:
    """Adds ``depth`` and, for each name, the fold of own values from the top down to the node.

    ``folds`` maps a name to a row's own value and an associative function of an upper and a lower part. Every
    row points some way up and holds the fold of the rows that it has passed; a round takes over what its target holds and where
    that points, which doubles the way. So rounds follow the logarithm of the depth; each is one equi-join,
    written to the staging folder. ``inner`` marks rows that may have children: only those take part in rounds, and
    all others meet their parents once, at the end. ``staged``: ``nodes`` are read from files as they are, so they aren't written once more.

    Orphans and cycles are never reached: a round after which no fewer rows are under way leaves only those.
    """
    names = list(folds)
    nodes = nodes.drop("depth", *names)
    state = nodes.select(
        "*", F.col(parent_id).alias("__to"), F.lit(1).alias("depth"), *[own.alias(n) for n, (own, _) in folds.items()]
    )
    there = F.col("__to") == F.lit(top)
    if inner is not None:
        holds = F.coalesce(inner, F.lit(False))
        folded = tree_fold(nodes.filter(holds), folds, None, node_id, parent_id, top, label, staged)
        leaves = state.filter(~holds)
        up = folded.select(
            F.col("doc_id").alias("__doc"), F.col(node_id).alias("__node"), F.col("depth").alias("__depth"),
            *[F.col(n).alias("__up_" + n) for n in names],
        )
        met = leaves.filter(~there).join(large(up), (F.col("doc_id") == F.col("__doc")) & (F.col("__to") == F.col("__node")))
        below = met.select(
            *nodes.columns,
            (F.col("__depth") + F.col("depth")).alias("depth"),
            *[f(F.col("__up_" + n), F.col(n)).alias(n) for n, (_, f) in folds.items()],
        )
        return large(folded.unionByName(leaves.filter(there).drop("__to")).unionByName(below))
    state = state if staged else stage(state, label)
    done, way = [state.filter(there)], state.filter(~there)
    left = way.count()
    while left:
        up = reduce(DataFrame.unionByName, [*done, way]).select(
            F.col("doc_id").alias("__doc"),
            F.col(node_id).alias("__node"),
            F.col("__to").alias("__next"),
            F.col("depth").alias("__depth"),
            *[F.col(n).alias("__up_" + n) for n in names],
        )
        moved = way.join(up, (F.col("doc_id") == F.col("__doc")) & (F.col("__to") == F.col("__node"))).select(
            *nodes.columns,
            F.col("__next").alias("__to"),
            (F.col("__depth") + F.col("depth")).alias("depth"),
            *[f(F.col("__up_" + n), F.col(n)).alias(n) for n, (_, f) in folds.items()],
        )
        moved = stage(moved, label)
        done, way = [*done, moved.filter(there)], moved.filter(~there)
        before, left = left, way.count()
        if left >= before:
            break
    return large(reduce(DataFrame.unionByName, done).drop("__to"))


def both(up: Column, own: Column) -> Column:
    """Fold: on where both are."""
    return up & own


def joined(mark: str) -> Callable[[Column, Column], Column]:
    """Fold: texts with a mark in between."""
    return lambda up, own: F.concat(up, F.lit(mark), own)


def appended(up: Column, own: Column) -> Column:
    """Fold: arrays from the top down."""
    return F.concat(up, own)


def prepended(up: Column, own: Column) -> Column:
    """Fold: arrays from the node up."""
    return F.concat(own, up)


def sibling_ordinal(layers: DataFrame) -> DataFrame:
    """Adds ``dup``: 0, 1, 2... among equal names of one parent in storage order."""
    return rank_in_group(layers, [*SIBLINGS, "name"], "ordinal", "dup")


def named_layers(layers: DataFrame) -> DataFrame:
    """Adds ``internal_name``, unique among siblings."""
    return sibling_ordinal(layers).withColumn("internal_name", encode_name("name", F.col("dup")))


def tree_paths(layers: DataFrame) -> DataFrame:
    """Adds ``path``, ``parent_path`` and ``ancestors`` (nearest first, without the node itself)."""
    name = F.col("internal_name")
    rows = tree_fold(
        named_layers(layers),
        {"path": (name, joined("/")), "ancestors": (F.array("seq_id"), prepended)},
        label="paths",
    )
    above = F.expr("substring(path, 1, length(path) - length(internal_name) - 1)")
    return rows.withColumns(
        {"parent_path": F.when(F.col("depth") > 1, above), "ancestors": F.slice("ancestors", 2, 1 << 30)}
    )


def ancestor_lists(nodes: DataFrame) -> DataFrame:
    """Adds ``ancestors`` (nearest first) without building names."""
    rows = tree_fold(nodes, {"ancestors": (F.array("seq_id"), prepended)}, label="ancestors")
    return rows.withColumn("ancestors", F.slice("ancestors", 2, 1 << 30))


def tree_closure(nodes: DataFrame) -> DataFrame:
    """(doc_id, seq_id, ancestor_seq_id, distance), each node at distance 0 from itself."""
    rows = nodes if "ancestors" in nodes.columns else ancestor_lists(nodes)
    chain = F.concat(F.array(F.col("seq_id")), F.col("ancestors"))
    return rows.select(*NODE, F.posexplode(chain).alias("distance", "ancestor_seq_id"))


def unreachable_nodes(layers: DataFrame, reached: DataFrame) -> DataFrame:
    """Orphans and cycle members: rows that no walk from the top arrives at."""
    return layers.join(reached.select(*NODE), NODE, "left_anti")


def lost_nodes(layers: DataFrame, reached: DataFrame) -> DataFrame:
    """(doc_id, seq_id, parent_seq_id, reason) of rows that no walk arrives at: "orphan" without a parent row, else "below a lost row"."""
    lost = unreachable_nodes(layers, reached).select(*NODE, "parent_seq_id")
    parents = layers.select("doc_id", F.col("seq_id").alias("parent_seq_id"), F.lit(True).alias("__known")).distinct()
    reason = F.when(F.col("__known"), F.lit("below a lost row")).otherwise(F.lit("orphan"))
    return lost.join(parents, SIBLINGS, "left").select(*NODE, "parent_seq_id", reason.alias("reason"))


def clip_base(layers: DataFrame) -> DataFrame:
    """Adds ``base_seq_id`` and ``base_visible`` to clipping layers.

    The base is the nearest non-clipping sibling below; without one the layer never draws.
    """
    base = F.when(~F.col("clipping"), F.struct("seq_id", "visible"))
    found = last_before(layers, SIBLINGS, "ordinal", base, "__base")
    return found.select(
        *layers.columns,
        F.when(F.col("clipping"), F.col("__base.seq_id")).alias("base_seq_id"),
        F.when(F.col("clipping"), F.col("__base.visible")).alias("base_visible"),
    )


def clip_groups(layers: DataFrame) -> DataFrame:
    """Adds ``clip_group``: how many bases lie at or below the row; orphans are in group 0."""
    is_base = (~F.col("clipping")).cast("bigint")
    return running_sum(layers, SIBLINGS, "ordinal", is_base, "clip_group")


def effective_visibility(layers: DataFrame) -> DataFrame:
    """Adds ``effective``: on, with every ancestor on, and drawn bases under clipping layers."""
    based = clip_base(layers)
    own = F.col("visible") & (~F.col("clipping") | F.coalesce("base_visible", F.lit(False)))
    return tree_fold(based, {"effective": (own, both)}, label="visible")


def normalize_radios(layers: DataFrame, flag: str = "visible") -> DataFrame:
    """Adds ``checked``: forced nodes on; exactly one radio on per parent.

    With none on the topmost is taken, with several the lowest stays, the one set last.
    """
    kind = layer_flags("name")["kind"]
    rows = layers.withColumn("kind", kind)
    picked = (
        rows.filter(F.col("kind") == "radio")
        .groupBy(*SIBLINGS)
        .agg(
            F.coalesce(F.min(F.when(F.col(flag), F.col("ordinal"))), F.max("ordinal")).alias("__pick")
        )
    )
    return rows.join(picked, SIBLINGS, "left").select(
        *layers.columns,
        "kind",
        F.when(F.col("kind") == "force", True)
        .when(F.col("kind") == "radio", F.col("ordinal") == F.col("__pick"))
        .otherwise(F.col(flag))
        .alias("checked"),
    )


def flip_pairs(layers: DataFrame) -> DataFrame:
    """(doc_id, parent_seq_id, axis, normal, flipped): mirror variants and what they replace."""
    flags = layer_flags("name")
    variants = layers.select(
        *SIBLINGS,
        F.col("seq_id").alias("flipped"),
        F.col("ordinal").alias("flipped_ordinal"),
        flags["base"].alias("name"),
        F.explode(flags["tokens"]).alias("token"),
    )
    originals = layers.groupBy(*SIBLINGS, "name").agg(F.max_by("seq_id", "ordinal").alias("normal"))
    return variants.join(originals, [*SIBLINGS, "name"]).select(
        *SIBLINGS, F.col("token").alias("axis"), "normal", "flipped", "flipped_ordinal"
    )


def _padded(position: Column) -> Column:
    return F.lpad(position.cast("string"), 19, "0")


def tree_order(nodes: DataFrame, top_first: bool = True) -> DataFrame:
    """Adds ``sort_path``: a string that orders the tree depth first.

    Layers are listed top to bottom (``top_first``), favorites first to last.
    """
    turn = F.lit((1 << 63) - 1) - F.col("ordinal") if top_first else F.col("ordinal")
    key = _padded(turn)
    return tree_fold(nodes, {"sort_path": (key, joined("/"))}, inner=F.col("folder"), label="order")


def outline_lines(layers: DataFrame) -> DataFrame:
    """(doc_id, sort_path, line): names indented by one tab per level, top to bottom."""
    return tree_order(layers).select(
        "doc_id",
        "sort_path",
        F.concat(F.repeat(F.lit("\t"), F.col("depth") - 1), "name").alias("line"),
    )


def bbox_rollup(layers: DataFrame) -> DataFrame:
    """Folder boxes as the union of own and descendant boxes; empty rectangles do not count."""
    rows = ancestor_lists(layers)
    keep = (F.col("width") > 0) & (F.col("height") > 0)
    box = rows.filter(keep).select(
        "doc_id",
        F.explode(F.concat(F.array("seq_id"), "ancestors")).alias("seq_id"),
        F.col("x").alias("x0"),
        F.col("y").alias("y0"),
        (F.col("x") + F.col("width")).alias("x1"),
        (F.col("y") + F.col("height")).alias("y1"),
    )
    union = box.groupBy(*NODE).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return layers.select(*NODE, "x", "y", "width", "height").join(union, NODE, "left").select(
        *NODE,
        F.coalesce("x0", "x").alias("x"),
        F.coalesce("y0", "y").alias("y"),
        F.coalesce(F.col("x1") - F.col("x0"), "width").alias("width"),
        F.coalesce(F.col("y1") - F.col("y0"), "height").alias("height"),
    )


def doc_extent(layers: DataFrame, docs: DataFrame) -> DataFrame:
    """Union of a document's layer boxes cut by its canvas; all zero when nothing is left."""
    keep = (F.col("width") > 0) & (F.col("height") > 0)
    union = (
        layers.filter(keep)
        .groupBy("doc_id")
        .agg(
            F.min("x").alias("x0"),
            F.min("y").alias("y0"),
            F.max(F.col("x") + F.col("width")).alias("x1"),
            F.max(F.col("y") + F.col("height")).alias("y1"),
        )
    )
    cut = docs.select("doc_id", "canvas_w", "canvas_h").join(union, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("x0").isNotNull(), F.greatest("x0", F.lit(0))).alias("x0"),
        F.when(F.col("y0").isNotNull(), F.greatest("y0", F.lit(0))).alias("y0"),
        F.least("x1", "canvas_w").alias("x1"),
        F.least("y1", "canvas_h").alias("y1"),
    )
    alive = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    pick = lambda v: F.when(alive, v).otherwise(0)
    return cut.select(
        "doc_id",
        pick(F.col("x0")).alias("x"),
        pick(F.col("y0")).alias("y"),
        pick(F.col("x1") - F.col("x0")).alias("width"),
        pick(F.col("y1") - F.col("y0")).alias("height"),
    )


def drawable(layers: DataFrame) -> DataFrame:
    """Rows the renderer would visit: on, not fully transparent, not clipping, with content."""
    return layers.filter(
        F.col("visible")
        & (F.col("opacity") != 0)
        & ~F.col("clipping")
        & (F.col("has_children") | F.col("has_image"))
    )


def non_empty(layers: DataFrame) -> DataFrame:
    """Rows that own a picture of positive size."""
    return layers.filter(
        F.col("has_image") & (F.col("width").cast("bigint") * F.col("height").cast("bigint") > 0)
    )


def supported_color(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) documents by colour mode."""
    ok = F.coalesce(F.col("color_mode") == "RGB", F.lit(False))
    return docs.filter(ok), docs.filter(~ok).withColumn("reason", F.lit("unsupported color mode"))


def default_layers(docs: DataFrame, layers: DataFrame) -> DataFrame:
    """Layers plus one full-canvas layer for every document that has none."""
    bare = docs.join(layers.select("doc_id").distinct(), "doc_id", "left_anti")
    made = bare.select(
        "doc_id",
        F.lit(1).cast("bigint").alias("seq_id"),
        F.lit(TOP).cast("bigint").alias("parent_seq_id"),
        F.lit(0).cast("bigint").alias("ordinal"),
        F.lit("Layer Not Found").alias("name"),
        F.lit("normal").alias("blend_mode"),
        F.lit(255).alias("opacity"),
        F.lit(0).alias("x"),
        F.lit(0).alias("y"),
        F.col("canvas_w").alias("width"),
        F.col("canvas_h").alias("height"),
    )
    return layers.select(*made.columns).unionByName(made)

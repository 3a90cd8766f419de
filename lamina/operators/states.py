"""Visibility states: reading, applying, overlaying and writing sets of checked layers.

A state is a set of slash paths per document. Flags travel as rows; text forms exist for
small documents only. Operators that set flags return only the rows they touch where that
is enough, so the work grows with the state and not with layers times states.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.bitsets import latest_above, latest_below, number_layers
from lamina.operators.tree import NODE, SIBLINGS, both, clip_base, tree_closure, tree_fold
from lamina.session import large
from lamina.session import stage_large as stage

C = F.col


# -- writing ----------------------------------------------------------------------------------


def compact_state(paths: DataFrame, flag: str) -> DataFrame:
    """Checked rows whose ancestors are all checked, without those that have such a descendant."""
    lit = stage(
        tree_fold(
            paths.filter(flag).select(*NODE, "parent_seq_id", "folder", "path", flag),
            {"lit": (F.lit(True), both)},
            inner=C("folder"),
            label="lit",
        ),
        "litrows",
    )
    parents = lit.select("doc_id", C("parent_seq_id").alias("seq_id")).distinct()
    return lit.join(parents, NODE, "left_anti").drop("lit", "depth")


def full_state(paths: DataFrame, flag: str) -> DataFrame:
    """Every checked node as an absolute line."""
    return paths.filter(C(flag)).select(*NODE, F.concat(F.lit("/"), "path").alias("line"))


def state_text(lines: DataFrame, newest_first: bool, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One text per document from (doc_id, seq_id, line); for documents that fit in a cell."""
    pairs = F.sort_array(F.collect_list(F.struct("seq_id", "line")), asc=not newest_first)
    return lines.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("text"))


# -- reading ----------------------------------------------------------------------------------


def _prefixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def parse_state(states: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, path, all_layers, checked): every prefix of every line, once.

    A text that starts with "/" is in all-layers mode: prefixes count as checked only when
    they are listed themselves. Otherwise every prefix is checked.
    """
    flagged = states.withColumn("all_layers", C("text").startswith("/"))
    lines = flagged.select(
        *keys,
        "all_layers",
        F.explode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("line"),
    )
    # the first element of an absolute line is skipped whatever it holds
    body = F.when(C("all_layers"), F.regexp_replace("line", r"\A[^/]*/?", "")).otherwise(C("line"))
    usable = lines.select(*keys, "all_layers", "line", body.alias("body")).filter(
        ~C("all_layers") | C("line").contains("/")
    )
    rows = usable.select(*keys, "all_layers", "body", F.explode(_prefixes(C("body"))).alias("path"))
    return rows.groupBy(*keys, "path", "all_layers").agg(
        F.bool_or(~C("all_layers") | (C("path") == C("body"))).alias("checked")
    )


def merge_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two path sets."""
    return a.select("doc_id", "path").union(b.select("doc_id", "path")).distinct()


def filter_intersection(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Paths of the inner filter that the outer one allows."""
    return inner.select("doc_id", "path").join(outer.select("doc_id", "path"), ["doc_id", "path"], "left_semi")


def hidden_by_filter(paths: DataFrame, filters: DataFrame) -> DataFrame:
    """Layers outside every filter."""
    return paths.join(filters.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_anti")


# -- applying ---------------------------------------------------------------------------------


def settle_radios(rows: DataFrame, touched: str = "touched", flag: str = "checked") -> DataFrame:
    """Restore exclusivity: a radio just set on turns off the rest; of several the lowest stays."""
    on = (C("kind") == "radio") & C(touched) & C(flag)
    winners = large(rows.filter(on).groupBy(*SIBLINGS).agg(F.min("ordinal").alias("__won")))
    joined = rows.join(winners, SIBLINGS, "left")
    fixed = F.when((C("kind") == "radio") & C("__won").isNotNull(), C("ordinal") == C("__won")).otherwise(C(flag))
    return joined.withColumn(flag, fixed).drop("__won")


def apply_state(layers: DataFrame, state: DataFrame) -> DataFrame:
    """Flags after loading one state per document.

    ``layers``: paths with ``kind`` and current ``checked``. ``state``: output of
    ``parse_state``. Documents without a state keep their flags.

    In compact form the children of the top and of listed folders are set to in-state or
    not, and flags below an unlisted folder stay. In all-layers form everything is reset to
    forced and radio defaults, listed paths are on, and unlisted ones are off.
    """
    marks = state.select("doc_id", "path", C("checked").alias("__listed"))
    modes = state.groupBy("doc_id").agg(F.first("all_layers").alias("__all"))
    held = marks.select("doc_id", C("path").alias("parent_path")).withColumn("__held", F.lit(True))
    tops = (
        layers.filter(C("kind") == "radio")
        .groupBy(*SIBLINGS)
        .agg(F.max("ordinal").alias("__top"))
    )
    rows = (
        layers.join(marks, ["doc_id", "path"], "left")
        .join(held, ["doc_id", "parent_path"], "left")
        .join(modes, "doc_id", "left")
        .join(tops, SIBLINGS, "left")
    )
    present = C("__listed").isNotNull()
    reset = (C("kind") == "force") | F.coalesce(
        (C("kind") == "radio") & (C("ordinal") == C("__top")), F.lit(False)
    )
    exact = F.when(~present, False).when(C("__listed"), True).otherwise(reset)
    reached = (C("parent_seq_id") == -1) | C("__held").isNotNull()
    after = (
        F.when(C("__all").isNull(), C("checked"))
        .when(C("__all"), exact)
        .when(reached, present)
        .otherwise(C("checked"))
    )
    touched = F.when(C("__all").isNull(), False).when(C("__all"), F.coalesce(C("__listed"), F.lit(False))).otherwise(reached)
    out = rows.withColumn("touched", touched).withColumn("checked", after)
    return settle_radios(out).select(*layers.columns)


def state_delta(
    layers: DataFrame,
    overlay: DataFrame,
    filters: DataFrame,
    keys: tuple[str, ...] = (),
    filter_keys: tuple[str, ...] | None = None,
    owners: DataFrame | None = None,
) -> DataFrame:
    """(keys, doc_id, seq_id, checked) for the layers an overlay touches, radios settled.

    ``overlay`` (per ``keys``) and ``filters`` (per ``filter_keys``) are path sets closed under
    prefixes; ``owners`` says which filter an overlay uses when the two are keyed differently.
    Only layers in the filter change; one is off unless listed; nothing below an unlisted one
    changes. Overlays meet the filter through the parents they list, so only touched layers
    are ever paired with them.
    """
    filter_keys = keys if filter_keys is None else filter_keys
    if owners is None:
        owners = filters.select(*keys, "doc_id").distinct()
    slim = layers.select(
        *NODE, "parent_seq_id", "ordinal", "kind", "path",
        F.when(C("parent_seq_id") == -1, "").otherwise(F.concat(F.lit("/"), "parent_path")).alias("__at"),
    )
    inside = filters.select(*filter_keys, "doc_id", "path").join(slim, ["doc_id", "path"])
    listed = overlay.select(*keys, "doc_id", "path").withColumn("__listed", F.lit(True))
    below = overlay.select(*keys, "doc_id", F.concat(F.lit("/"), "path").alias("__at")).join(owners, [*keys, "doc_id"])
    extra = [k for k in filter_keys if k not in keys]
    columns = [*keys, "doc_id", *extra, "__at"]
    held = below.select(*columns).union(owners.withColumn("__at", F.lit("")).select(*columns))
    rows = stage(
        held.join(inside, [*filter_keys, "doc_id", "__at"])
        .join(listed, [*keys, "doc_id", "path"], "left")
        .select(*keys, *NODE, "parent_seq_id", "ordinal", "kind", C("__listed").isNotNull().alias("checked")),
        "touched",
    )
    group = [*keys, *SIBLINGS]
    won = rows.filter((C("kind") == "radio") & C("checked")).groupBy(*group).agg(F.min("ordinal").alias("__won"))
    direct = rows.join(won, group, "left").select(
        *keys,
        *NODE,
        F.when((C("kind") == "radio") & C("__won").isNotNull(), C("ordinal") == C("__won"))
        .otherwise(C("checked"))
        .alias("checked"),
    )
    # radios of the same parent that the filter leaves out are switched off by the winner
    rivals = won.join(slim.filter(C("kind") == "radio").select(*NODE, "parent_seq_id", "ordinal"), SIBLINGS)
    pushed = rivals.filter(C("ordinal") != C("__won")).select(*keys, *NODE, F.lit(False).alias("checked"))
    return direct.union(pushed).groupBy(*keys, *NODE).agg(F.bool_or("checked").alias("checked"))


def apply_overlay(
    layers: DataFrame, overlay: DataFrame, filters: DataFrame, base: DataFrame | str | None = None
) -> DataFrame:
    """Flags after a partial state. ``base``: None keeps the flags, "" turns all off, a
    parsed state is applied first. All-layers overlays are refused."""
    if isinstance(base, str):
        if base != "":
            raise ValueError("pass a parsed state, an empty string or None as base")
        rows = layers.withColumn("checked", F.lit(False))
    else:
        rows = layers if base is None else apply_state(layers, base)
    if "all_layers" in overlay.columns:
        overlay = overlay.withColumn(
            "path",
            F.when(C("all_layers"), F.raise_error(F.lit("all-layers overlay is not allowed"))).otherwise(C("path")),
        )
    delta = state_delta(layers, overlay, filters).withColumnRenamed("checked", "__new")
    return rows.join(delta, NODE, "left").withColumn("checked", F.coalesce("__new", "checked")).drop("__new")


# -- filters ----------------------------------------------------------------------------------


def filter_effective(paths: DataFrame, ancestor_filters: DataFrame, inner: DataFrame) -> DataFrame:
    """Adds ``enabled`` and ``selected`` under nested filters.

    ``ancestor_filters`` holds (doc_id, level, path) sets; a layer is enabled when it lies in
    all of them. ``inner`` is the filter's own set; documents without one select all enabled. A path may come
    several times in a set: all sets meet in one row a path and one a document.
    """
    none = F.lit(None).cast(ancestor_filters.schema["level"].dataType)
    marks = ancestor_filters.select("doc_id", "path", "level", F.lit(False).alias("__own")).unionAll(
        inner.select("doc_id", "path", none.alias("level"), F.lit(True).alias("__own"))
    )
    outer = F.when(~C("__own"), F.struct("level"))
    by_path = large(marks.groupBy("doc_id", "path").agg(F.size(F.collect_set(outer)).alias("__hits"), F.max("__own").alias("__own")))
    by_doc = large(marks.groupBy("doc_id").agg(F.size(F.collect_set("level")).alias("__levels"), F.max("__own").alias("__has")))
    rows = paths.join(by_path, ["doc_id", "path"], "left").join(by_doc, "doc_id", "left")
    off = F.lit(False)
    enabled = F.coalesce(C("__hits"), F.lit(0)) == F.coalesce(C("__levels"), F.lit(0))
    selected = C("enabled") & (~F.coalesce(C("__has"), off) | F.coalesce(C("__own"), off))
    return rows.withColumn("enabled", enabled).withColumn("selected", selected).drop("__levels", "__hits", "__own", "__has")


def filter_lines(effective: DataFrame) -> DataFrame:
    """Minimal lines of the selected set; none when everything enabled is selected."""
    effective = stage(effective.select(*NODE, "parent_seq_id", "folder", "path", "enabled", "selected"), "effective")
    partial = effective.groupBy("doc_id").agg(F.count_if(C("enabled") & ~C("selected")).alias("__left")).filter("__left > 0")
    kept = effective.filter("selected").join(partial, "doc_id", "left_semi")
    return compact_state(kept.select(*NODE, "parent_seq_id", "folder", "path", "selected"), "selected").select(*NODE, "path")


def _clicked(clicks: DataFrame) -> DataFrame:
    """One row per clicked node: its last click, last switch-on and last solo click.

    Earlier clicks of the same node reach the same rows and lose, so they need not travel.
    """
    solo = F.coalesce(C("solo"), F.lit(False)) if "solo" in clicks.columns else F.lit(False)
    return clicks.groupBy(*NODE).agg(
        F.max("click_seq").alias("last_at"),
        F.max_by("on", "click_seq").alias("last_on"),
        F.max(F.when(C("on"), C("click_seq"))).alias("on_at"),
        F.max(F.when(solo, C("click_seq"))).alias("solo_at"),
    )


def apply_filter_toggles(layers: DataFrame, clicks: DataFrame) -> DataFrame:
    """Filter boxes after (doc_id, seq_id, click_seq, on) clicks.

    A click sets the node and all descendants, and a tick all ancestors too; later clicks win. In walking order a
    click covers an interval, and each layer takes the latest one above it; a folder takes the latest tick below it. Layers that
    ``number_layers`` has numbered already are not numbered again.
    """
    rows = layers if "last" in layers.columns else number_layers(layers)
    hit = stage(rows.select(*NODE, "pos", "last").join(_clicked(clicks).drop("solo_at"), NODE).drop("seq_id"), "clicked")
    own = F.struct(C("last_at").alias("at"), C("last_on").alias("on"))
    tick = F.struct(C("on_at").alias("at"), F.lit(True).alias("on"))
    down = latest_above(rows, hit.withColumn("__down", own), "__down")
    up = latest_below(rows, hit.filter("on_at is not null").withColumn("__up", tick), "__up")
    marked = rows.join(down, ["doc_id", "pos"], "left").join(up, ["doc_id", "pos"], "left")
    return marked.select(
        *[c for c in layers.columns if c != "checked"],
        F.coalesce(F.greatest("__down", "__up")["on"], C("checked")).alias("checked"),
    )


def apply_toggles(layers: DataFrame, clicks: DataFrame) -> DataFrame:
    """Layer flags after clicks (doc_id, seq_id, click_seq, on, solo).

    A click also turns on all ancestors and the node's clip base. A solo click on a node that
    is not a radio turns off its plain siblings. Radios stay exclusive. Later clicks win.
    A folder's last click from below is the latest one in its interval of walking order.
    """
    rows = layers if "last" in layers.columns else number_layers(layers)
    based = stage(clip_base(rows.withColumn("visible", C("checked"))), "clipbase")
    facts = based.select(*NODE, "parent_seq_id", "kind", "base_seq_id", "pos")
    hit = stage(_clicked(clicks).join(facts, NODE), "clicked")

    def event(rows: DataFrame, seq, at: str, step: int, on) -> DataFrame:
        return rows.select("doc_id", seq.alias("seq_id"), C(at).alias("at"), F.lit(step).alias("step"), on.alias("on"))

    yes, no = F.lit(True), F.lit(False)
    own = event(hit, C("seq_id"), "last_at", 1, C("last_on"))
    own_on = event(hit.filter("on_at is not null"), C("seq_id"), "on_at", 1, yes)
    above = latest_below(based, hit, "last_at").join(based.select(*NODE, "pos"), ["doc_id", "pos"])
    up = event(above, C("seq_id"), "last_at", 2, yes)
    base = event(hit.filter("base_seq_id is not null"), C("base_seq_id"), "last_at", 2, yes)
    # only the latest solo click of a sibling group can matter: each sibling meets one row
    solo = hit.filter((C("kind") != "radio") & C("solo_at").isNotNull()).groupBy(*SIBLINGS).agg(
        F.max(F.struct("solo_at", "seq_id")).alias("by")
    )
    plain = based.filter(C("kind") == "plain").select(*NODE, "parent_seq_id").join(solo, SIBLINGS)
    swept = plain.filter(C("seq_id") != C("by.seq_id")).withColumn("at", C("by.solo_at"))
    events = reduce(DataFrame.union, [own, own_on, up, base, event(swept, C("seq_id"), "at", 0, no)])
    last = events.groupBy(*NODE).agg(
        F.max_by("on", F.struct("at", "step")).alias("__on"),
        F.max(F.when(C("on"), F.struct("at", "step"))).alias("__when"),
    )
    rows = layers.join(large(last), NODE, "left").withColumn("checked", F.coalesce("__on", "checked"))
    lit = rows.filter((C("kind") == "radio") & C("__when").isNotNull())
    won = large(lit.groupBy(*SIBLINGS).agg(F.max_by("seq_id", "__when").alias("__won")))
    settled = F.when((C("kind") == "radio") & C("__won").isNotNull(), C("checked") & (C("seq_id") == C("__won")))
    return rows.join(won, SIBLINGS, "left").select(
        *[c for c in layers.columns if c != "checked"], settled.otherwise(C("checked")).alias("checked")
    )


def filter_kind(toggled: DataFrame) -> DataFrame:
    """(doc_id, type): filter while the selection is partial and not empty, otherwise folder."""
    counts = toggled.groupBy("doc_id").agg(F.count_if("checked").alias("n"), F.count("*").alias("m"))
    return counts.select(
        "doc_id", F.when((C("n") == 0) | (C("n") == C("m")), "folder").otherwise("filter").alias("type")
    )


# -- mirrors and siblings ---------------------------------------------------------------------


def _copy_subtree(layers: DataFrame, moves: DataFrame) -> DataFrame:
    """Copy flags from one subtree to another by relative path and swap the two roots.

    ``moves``: (doc_id, source, target). Subtrees of different moves must not overlap.
    """
    inside = lambda root: layers.withColumn("anc", F.explode(F.concat(F.array("seq_id"), "ancestors"))).join(
        moves.select("doc_id", C(root).alias("anc"), "source", "target"), ["doc_id", "anc"]
    )
    roots = layers.select("doc_id", C("seq_id").alias("root"), C("path").alias("root_path"))
    def relative(root: str) -> DataFrame:
        rows = inside(root).join(roots.withColumnRenamed("root", "anc"), ["doc_id", "anc"])
        return rows.select(
            "doc_id", "source", "target", "seq_id", "checked",
            F.substring("path", F.length("root_path") + 1, F.length("path")).alias("rel"),
        )
    flags = relative("source").select("doc_id", "source", "target", "rel", C("checked").alias("__from"))
    copied = relative("target").join(flags, ["doc_id", "source", "target", "rel"]).select(
        *NODE, F.when(C("rel") == "", True).otherwise(C("__from")).alias("__new")
    )
    off = moves.select("doc_id", C("source").alias("seq_id"), F.lit(False).alias("__new"))
    last = copied.union(off)
    return layers.join(last, NODE, "left").withColumn("checked", F.coalesce("__new", "checked")).drop("__new")


def apply_flip(layers: DataFrame, pairs: DataFrame, axis: str | None) -> DataFrame:
    """Flags after choosing a mirror axis (flipx, flipy, flipxy or None).

    ``layers`` carries path, ancestors and checked; ``pairs`` comes from ``flip_pairs``. Pairs of
    the other axes are switched back first, then those of the axis whose normal root is on.
    """
    rows = stage(layers, "flip")
    order = {"flipx": ["flipy", "flipxy"], "flipy": ["flipxy", "flipx"], "flipxy": ["flipx", "flipy"]}
    steps = [(a, False) for a in order.get(axis, ["flipx", "flipy", "flipxy"])] + ([(axis, True)] if axis else [])
    for name, forward in steps:
        source, target = ("normal", "flipped") if forward else ("flipped", "normal")
        live = rows.filter("checked").select("doc_id", C("seq_id").alias(source))
        mine = pairs.filter(C("axis") == name).join(live, ["doc_id", source], "left_semi")
        # a normal layer with several variants goes to the topmost, and comes back from the lowest
        pick = F.max_by("flipped", "flipped_ordinal") if forward else F.min_by("flipped", "flipped_ordinal")
        moves = mine.groupBy("doc_id", "normal").agg(pick.alias("flipped")).select(
            "doc_id", C(source).alias("source"), C(target).alias("target")
        )
        moves = stage(moves, "moves")
        if not moves.isEmpty():
            rows = stage(_copy_subtree(rows, moves), "flip")
    return rows


def _sibling_groups(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, parent_seq_id, radio) of the targets; targets of one group share all results."""
    return (
        layers.join(targets.select(*NODE), NODE, "left_semi")
        .select(*SIBLINGS, (C("kind") == "radio").alias("radio"))
        .distinct()
    )


def _peers(layers: DataFrame, targets: DataFrame) -> DataFrame:
    rows = layers.withColumn("radio", C("kind") == "radio")
    return rows.join(_sibling_groups(layers, targets), [*SIBLINGS, "radio"], "left_semi")


def expand_siblings(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, parent_seq_id, radio, chosen, view): one view per sibling of the targets' kind.

    In each view the group's other members are off, see ``siblings_base``; mirror variants get
    no view. Targets of the same group give the same views, which are listed once.
    """
    return _peers(layers, targets).filter(~C("is_flip_variant")).select(
        *SIBLINGS, "radio", C("seq_id").alias("chosen"), C("display").alias("view"), "ordinal"
    )


def siblings_base(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, parent_seq_id, radio, seq_id): siblings that every view of the group starts without."""
    return _peers(layers, targets).select(*SIBLINGS, "radio", "seq_id")


def siblings_filter(layers: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, parent_seq_id, radio, seq_id): the matching filter, ancestors plus sibling subtrees."""
    groups = _sibling_groups(layers, targets)
    closure = stage(tree_closure(layers), "closure")
    above = groups.withColumn("node", C("parent_seq_id")).join(
        closure.select("doc_id", C("seq_id").alias("node"), C("ancestor_seq_id").alias("anc")), ["doc_id", "node"]
    ).select(*SIBLINGS, "radio", C("anc").alias("seq_id"))
    below = (
        siblings_base(layers, targets)
        .withColumnRenamed("seq_id", "ancestor_seq_id")
        .join(closure, ["doc_id", "ancestor_seq_id"])
        .select(*SIBLINGS, "radio", "seq_id")
    )
    return above.union(below).distinct()

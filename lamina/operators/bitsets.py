"""Many states, overlays and filters per document: sets of layers as bitmaps over walking order.

A document's layers are numbered once in walking order (``number_layers``), so a subtree is an interval of
places. A set is rows (keys, block, bits) with 64 places to a block; ``keys`` are doc_id and the columns that name
the state, overlay or filter. Union, intersection, hiding, applying and overlaying are bit operations
of one row per (set, block); paths are looked up once, when a text is read, by a hash of the path.

What links layers to one another (children of a listed folder, radios of a parent, covered intervals) is
kept as masks per document and meets only the places that a set lists. A document or set that holds a third of all
layers is many blocks, so its rows spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.scans import rank_sorted
from lamina.operators.tree import NODE, TOP, joined, prepended, tree_fold
from lamina.session import large
from lamina.session import stage_large as stage

C = F.col
WORD = 64
STATE = ("doc_id", "state_id")


# -- numbering and masks ------------------------------------------------------------------------


def number_layers(layers: DataFrame, staged: bool = False) -> DataFrame:
    """Adds ``pos`` (place in walking order), ``last`` (place of the last descendant) and ``parent_pos`` (-1 at the top).

    Staged: one numbering serves all sets of a document. ``staged``: ``layers`` are so already.
    """
    key = F.lpad(C("ordinal").cast("string"), 19, "0")
    walked = tree_fold(layers, {"__sort": (key, joined("/")), "__chain": (F.array("seq_id"), prepended)}, label="numbering", staged=staged)
    below = walked.select("doc_id", F.explode("__chain").alias("seq_id")).groupBy(*NODE).agg((F.count("*") - 1).alias("__below"))
    placed = stage(rank_sorted(walked.drop("__chain"), ["doc_id"], ["__sort"], "pos", "places").drop("__sort", "depth"), "placed")
    parents = placed.select("doc_id", C("seq_id").alias("parent_seq_id"), C("pos").alias("parent_pos"))
    rows = placed.join(below, NODE).join(parents, ["doc_id", "parent_seq_id"], "left")
    return stage(
        rows.withColumns(
            {"last": C("pos") + C("__below"), "parent_pos": F.coalesce("parent_pos", F.lit(TOP).cast("bigint"))}
        ).drop("__below"),
        "numbered",
    )


def _block(pos: Column) -> Column:
    return F.shiftright(pos, 6).alias("block")


def _bit(pos: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), pos.bitwiseAND(F.lit(WORD - 1).cast("bigint")).cast("int"))


def _without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def to_bits(rows: DataFrame, keys: Sequence[str], name: str = "bits", pos: str = "pos") -> DataFrame:
    """(keys, block, name) of rows (keys, pos)."""
    return rows.groupBy(*keys, _block(C(pos))).agg(F.bit_or(_bit(C(pos))).alias(name))


def to_places(bits: DataFrame, keys: Sequence[str], name: str = "bits") -> DataFrame:
    """(keys, pos) of the places in a set."""
    places = F.filter(
        F.sequence(F.lit(0), F.lit(WORD - 1)),
        lambda i: F.call_function("shiftrightunsigned", C(name), i).bitwiseAND(F.lit(1).cast("bigint")) == 1,
    )
    return bits.select(*keys, F.explode(F.transform(places, lambda i: C("block") * WORD + i)).alias("pos"))


def flags(numbered: DataFrame, bits: DataFrame, keys: Sequence[str], **named: str) -> DataFrame:
    """(keys, seq_id, flags...) of every layer in every set; ``named`` maps a flag to its column of bits."""
    rows = numbered.select("doc_id", "seq_id", "pos", _block(C("pos"))).join(bits, ["doc_id", "block"])
    at = C("pos").bitwiseAND(F.lit(WORD - 1).cast("bigint")).cast("int")
    on = lambda c: F.call_function("shiftrightunsigned", C(c), at).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return rows.select(*keys, "seq_id", *[on(c).alias(n) for n, c in named.items()])


def document_masks(numbered: DataFrame) -> DataFrame:
    """(doc_id, block, every, base, reset, folders): all layers, those on, defaults of the all-layers form, folders."""
    top = numbered.filter("kind = 'radio'").groupBy("doc_id", "parent_pos").agg(F.max("ordinal").alias("__top"))
    rows = numbered.join(top, ["doc_id", "parent_pos"], "left")
    default = (C("kind") == "force") | ((C("kind") == "radio") & (C("ordinal") == C("__top")))
    some = lambda when: F.coalesce(F.bit_or(F.when(when, _bit(C("pos")))), F.lit(0).cast("bigint"))
    return rows.groupBy("doc_id", _block(C("pos"))).agg(
        F.bit_or(_bit(C("pos"))).alias("every"), some(C("checked")).alias("base"), some(default).alias("reset"),
        some(C("last") > C("pos")).alias("folders"),
    )


def _children(numbered: DataFrame) -> DataFrame:
    return to_bits(numbered, ["doc_id", "parent_pos"], "kids")


def _radios(numbered: DataFrame) -> DataFrame:
    return to_bits(numbered.filter("kind = 'radio'"), ["doc_id", "parent_pos"], "rivals")


def find_layers(paths: DataFrame, numbered: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (doc_id, path, ...) with the layer of that path: pos, parent_pos, ordinal and kind in place of path.

    ``how``: "left" keeps rows of other paths, with nulls.
    """
    by_hash = numbered.select(
        C("doc_id").alias("__doc"), F.xxhash64("path").alias("__h"), C("path").alias("__path"), "pos", "parent_pos", "ordinal", "kind"
    )
    same = (C("doc_id") == C("__doc")) & (F.xxhash64("path") == C("__h")) & (C("path") == C("__path"))
    return paths.join(by_hash, same, how).drop("__doc", "__h", "__path", "path")


# -- set operations -----------------------------------------------------------------------------


def combined(parts: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """(keys, block, a column of bits per part) for every block that a part has; what a part lacks is empty."""
    zero = F.lit(0).cast("bigint")
    rows = [
        df.select(*keys, "block", *[(C(n) if n == name else zero).alias(n) for n in parts]) for name, df in parts.items()
    ]
    return reduce(DataFrame.unionAll, rows).groupBy(*keys, "block").agg(*[F.bit_or(n).alias(n) for n in parts])


def union(a: DataFrame, b: DataFrame, keys: Sequence[str] = STATE) -> DataFrame:
    return a.unionByName(b).groupBy(*keys, "block").agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame, keys: Sequence[str] = STATE) -> DataFrame:
    met = a.withColumnRenamed("bits", "__a").join(large(b.withColumnRenamed("bits", "__b")), [*keys, "block"])
    return met.select(*keys, "block", C("__a").bitwiseAND(C("__b")).alias("bits")).filter("bits <> 0")


def hidden(sets: DataFrame, numbered: DataFrame, keys: Sequence[str] = STATE) -> DataFrame:
    """Layers outside each set of a document."""
    grid = _grid(sets.select(*keys).distinct(), document_masks(numbered))
    rows = grid.join(large(sets), [*keys, "block"], "left")
    bits = _without(C("every"), F.coalesce("bits", F.lit(0).cast("bigint")))
    return rows.select(*keys, "block", bits.alias("bits")).filter("bits <> 0")


def _grid(owners: DataFrame, masks: DataFrame) -> DataFrame:
    """Every block of its document for each set."""
    return owners.join(large(masks), "doc_id")


# -- states and overlays ------------------------------------------------------------------------


def _reached(listed: DataFrame, owners: DataFrame, numbered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, block, reach): children of the top and of listed layers."""
    at = listed.select(*keys, C("pos").alias("parent_pos"))
    at = at.unionAll(owners.select(*keys, F.lit(TOP).cast("bigint").alias("parent_pos")))
    return at.join(_children(numbered), ["doc_id", "parent_pos"]).groupBy(*keys, "block").agg(F.bit_or("kids").alias("reach"))


def _settled(switched: DataFrame, numbered: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Radios just switched on: of several in a group the lowest stays and the rest of the group goes off."""
    won = switched.filter("kind = 'radio'").groupBy(*keys, "parent_pos").agg(F.min(F.struct("ordinal", "pos"))["pos"].alias("pos"))
    cleared = won.drop("pos").join(_radios(numbered), ["doc_id", "parent_pos"]).groupBy(*keys, "block").agg(F.bit_or("rivals").alias("clear"))
    return {"clear": cleared, "win": to_bits(won, keys, "win")}


def _after(grid: DataFrame, parts: dict[str, DataFrame], value: Column, keys: Sequence[str]) -> DataFrame:
    rows = grid.join(large(combined(parts, keys)), [*keys, "block"], "left").fillna(0, list(parts))
    return rows.select(*keys, "block", _without(value, C("clear")).bitwiseOR(C("win")).alias("bits"))


def apply_states(numbered: DataFrame, states: DataFrame, keys: Sequence[str] = STATE) -> DataFrame:
    """Bits of the layers that are on after loading each state on its own.

    ``states``: (keys, path, all_layers, checked) of ``parse_state``. The rules are those of ``states.apply_state``.
    """
    listed = stage(find_layers(states, numbered), "listed")
    owners = states.groupBy(*keys).agg(F.first("all_layers").alias("all_layers"))
    grid = _grid(owners, document_masks(numbered))
    parts = {
        "reach": _reached(listed, owners, numbered, keys),
        "listed": to_bits(listed, keys, "listed"),
        "exact": to_bits(listed.filter("checked"), keys, "exact"),
        **_settled(listed.filter("not all_layers or checked"), numbered, keys),
    }
    compact = _without(C("base"), C("reach")).bitwiseOR(C("listed").bitwiseAND(C("reach")))
    whole = C("exact").bitwiseOR(_without(C("listed"), C("exact")).bitwiseAND(C("reset")))
    return _after(grid, parts, F.when(C("all_layers"), whole).otherwise(compact), keys)


def apply_overlays(
    numbered: DataFrame, overlays: DataFrame, filters: DataFrame, base: DataFrame | str | None = None, keys: Sequence[str] = STATE
) -> DataFrame:
    """Bits of the layers that are on after each overlay under its filter, both closed path sets (keys, path).

    ``base``: None starts from the current flags, "" from nothing, bits (keys, block, bits) from those. The rules are those of
    ``states.apply_overlay``; sets without a filter change nothing and are left out.
    """
    if isinstance(base, str) and base:
        raise ValueError("pass bits, an empty string or None as base")
    owners = stage(filters.select(*keys).distinct(), "owners")
    allowed = stage(find_layers(filters.select(*keys, "path"), numbered), "allowed")
    inside = find_layers(overlays.select(*keys, "path"), numbered).join(owners, list(keys), "left_semi")
    inside = stage(inside, "overlaid")
    switched = inside.join(allowed.select(*keys, "pos"), [*keys, "pos"], "left_semi")
    grid = _grid(owners, document_masks(numbered))
    if isinstance(base, DataFrame):
        grid = grid.drop("base").join(base.withColumnRenamed("bits", "base"), [*keys, "block"])
    elif base == "":
        grid = grid.withColumn("base", F.lit(0).cast("bigint"))
    parts = {
        "reach": _reached(inside, owners, numbered, keys),
        "listed": to_bits(inside, keys, "listed"),
        "allowed": to_bits(allowed, keys, "allowed"),
        **_settled(switched, numbered, keys),
    }
    touched = C("reach").bitwiseAND(C("allowed"))
    return _after(grid, parts, _without(C("base"), touched).bitwiseOR(touched.bitwiseAND(C("listed"))), keys)


# -- filters ------------------------------------------------------------------------------------


def filters_effective(
    numbered: DataFrame, owners: DataFrame, outer: DataFrame, own: DataFrame, keys: Sequence[str] = STATE
) -> DataFrame:
    """(keys, block, enabled, selected) under nested filters.

    ``owners`` names the filters (keys); ``outer`` holds (keys, level, path) of their ancestors and ``own``
    (keys, path) of themselves. Layers in all ancestors are enabled; a filter without a set selects all of those.
    """
    none = F.lit(None).cast(outer.schema["level"].dataType)
    marks = outer.select(*keys, "level", "path", F.lit(False).alias("__mine")).unionAll(
        own.select(*keys, none.alias("level"), "path", F.lit(True).alias("__mine"))
    )
    mine = C("__mine")
    # one row for each set and block, and one without a block where paths are no layer's: such a set counts too
    of_level = stage(to_bits(find_layers(marks, numbered, "left"), [*keys, "level", "__mine"]), "levels")
    facts = large(of_level.groupBy(*keys).agg(F.count_distinct("level").alias("__levels"), F.min(mine).alias("__bare"), F.max(mine).alias("__has")))
    sets = large(
        of_level.filter("block is not null").groupBy(*keys, "block").agg(
            F.bit_and(F.when(~mine, C("bits"))).alias("__common"), F.count_if(~mine).alias("__in"), F.bit_or(F.when(mine, C("bits"))).alias("__own")
        )
    )
    rows = _grid(owners.select(*keys).distinct(), document_masks(numbered)).join(facts, list(keys), "left")
    rows = rows.join(sets, [*keys, "block"], "left")
    zero = F.lit(0).cast("bigint")
    every = F.coalesce(C("__bare"), F.lit(True))
    enabled = F.when(every, C("every")).when((C("__in") > 0) & (C("__in") == C("__levels")), C("__common")).otherwise(zero)
    whole = ~F.coalesce(C("__has"), F.lit(False))
    selected = F.when(whole, C("enabled")).otherwise(C("enabled").bitwiseAND(F.coalesce("__own", zero)))
    rows = rows.withColumn("enabled", enabled).withColumn("selected", selected)
    return rows.select(*keys, "block", "enabled", "selected")


def covered(rows: DataFrame, keys: Sequence[str], name: str = "bits") -> DataFrame:
    """(keys, block, name): the union of intervals (keys, pos, last); a block is touched once by each interval on it."""
    blocks = rows.withColumn("block", F.explode(F.sequence(F.shiftright("pos", 6), F.shiftright("last", 6))))
    start = F.greatest(C("pos") - C("block") * WORD, F.lit(0).cast("bigint")).cast("int")
    stop = F.least(C("last") - C("block") * WORD, F.lit(WORD - 1).cast("bigint")).cast("int")
    ones = F.lit(-1).cast("bigint")
    mask = F.call_function("shiftleft", ones, start).bitwiseAND(F.call_function("shiftrightunsigned", ones, WORD - 1 - stop))
    return blocks.groupBy(*keys, "block").agg(F.bit_or(mask).alias(name))


def compact_bits(numbered: DataFrame, selected: DataFrame, keys: Sequence[str] = STATE) -> DataFrame:
    """Bits of the minimal lines of each set: layers on with all ancestors, less those with such a child.

    Folders that are off darken their interval; no walk is needed.
    """
    masks = large(document_masks(numbered).select("doc_id", "block", "folders"))
    off = selected.join(masks, ["doc_id", "block"]).select(*keys, "block", _without(C("folders"), C("bits")).alias("bits"))
    spans = numbered.filter("last > pos").select("doc_id", "pos", "last")
    dark = covered(to_places(off.filter("bits <> 0"), keys).join(spans, ["doc_id", "pos"]), keys, "dark")
    lit = selected.join(large(dark), [*keys, "block"], "left").fillna(0, ["dark"])
    lit = stage(lit.select(*keys, "block", _without(C("bits"), C("dark")).alias("bits")), "lit")
    up = to_places(lit.filter("bits <> 0"), keys).join(numbered.select("doc_id", "pos", "parent_pos"), ["doc_id", "pos"])
    parents = to_bits(up.filter(C("parent_pos") >= 0).select(*keys, C("parent_pos").alias("pos")).distinct(), keys, "parents")
    rows = lit.join(large(parents), [*keys, "block"], "left").fillna(0, ["parents"])
    return rows.select(*keys, "block", _without(C("bits"), C("parents")).alias("bits")).filter("bits <> 0")


def filters_lines(numbered: DataFrame, effective: DataFrame, keys: Sequence[str] = STATE) -> DataFrame:
    """(keys, seq_id, path): minimal lines of each filter; none when everything enabled is selected."""
    partial = large(effective.filter(_without(C("enabled"), C("selected")) != 0).select(*keys).distinct())
    kept = effective.join(partial, list(keys), "left_semi").select(*keys, "block", C("selected").alias("bits"))
    lines = to_places(compact_bits(numbered, kept, keys), keys)
    return lines.join(numbered.select("doc_id", "pos", "seq_id", "path"), ["doc_id", "pos"]).drop("pos")


# -- values over intervals ------------------------------------------------------------------------


def latest_above(numbered: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """(doc_id, pos, value): the greatest value of the marks (doc_id, pos, last, value) whose interval holds a layer.

    An interval is one row for each block that it fills and one for each place on the blocks at its ends, so
    work follows its length over 64, not the depth of the tree.
    """
    first, last = F.shiftright("pos", 6), F.shiftright("last", 6)
    full = marks.withColumn("__b", F.explode(F.sequence(first, last))).filter((C("__b") * WORD >= C("pos")) & (C("__b") * WORD + WORD - 1 <= C("last")))
    by_block = full.groupBy("doc_id", C("__b").alias("block")).agg(F.max(value).alias("__far"))
    ends = F.concat(
        F.sequence(C("pos"), F.least(C("last"), first * WORD + WORD - 1)),
        F.when(last > first, F.sequence(F.greatest(C("pos"), last * WORD), C("last"))).otherwise(F.array().cast("array<bigint>")),
    )
    by_place = marks.select("doc_id", C(value), F.explode(ends).alias("pos")).groupBy("doc_id", "pos").agg(F.max(value).alias("__near"))
    rows = numbered.select("doc_id", "pos", _block(C("pos"))).join(by_block, ["doc_id", "block"], "left").join(by_place, ["doc_id", "pos"], "left")
    return rows.select("doc_id", "pos", F.greatest("__far", "__near").alias(value)).filter(C(value).isNotNull())


def latest_below(numbered: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """(doc_id, pos, value): the greatest value of the marks (doc_id, pos, value) among each folder's descendants.

    Marks are read twice: pass a staged table.
    """
    by_block = marks.groupBy("doc_id", _block(C("pos"))).agg(F.max(value).alias("__v"))
    folders = numbered.filter("last > pos").select("doc_id", "pos", "last")
    cut = folders.withColumn("block", F.explode(F.sequence(F.shiftright(C("pos") + 1, 6), F.shiftright("last", 6))))
    start, stop = C("block") * WORD, C("block") * WORD + WORD - 1
    full = (start > C("pos")) & (stop <= C("last"))
    far = cut.filter(full).join(by_block, ["doc_id", "block"]).select("doc_id", "pos", C("__v").alias(value))
    near = cut.filter(~full).join(marks.select("doc_id", C("pos").alias("__at"), C(value), _block(C("pos"))), ["doc_id", "block"])
    near = near.filter((C("__at") > C("pos")) & (C("__at") <= C("last"))).select("doc_id", "pos", value)
    return far.unionAll(near).groupBy("doc_id", "pos").agg(F.max(value).alias(value))

"""Saved views: favorites trees, selectable parts, view enumeration, versions and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.hashing import digest_of_sums, digest_words, set_digest
from lamina.functions.names import display_caption, format_ts, padded, safe_filename, view_name
from lamina.operators.scans import number_rows, rank_in_group, rank_sorted, running_sum
from lamina.operators.states import state_delta
from lamina.operators.tree import NODE, appended, tree_fold
from lamina.session import bucketed
from lamina.session import stage_large as stage
from lamina.sources.favorites import FAV_TOP, count_entries

C = F.col
ITEM = ["doc_id", "node_id"]


# -- favorites tree ---------------------------------------------------------------------------


def is_view_root(text: Column) -> Column:
    return text.rlike(r"\A\*.")


def view_roots(nodes: DataFrame) -> DataFrame:
    """Nodes of any depth whose text is a star and more."""
    return nodes.filter(is_view_root(C("text")))


def favorites_walk(nodes: DataFrame) -> DataFrame:
    """Adds sort_path, filters (nearest first), roots (view-root ancestors), the parent's text
    and sort path, and the cleaned export path."""
    key = F.lpad(C("ordinal").cast("string"), 19, "0")
    own = F.struct(
        "node_id",
        "text",
        key.alias("key"),
        F.when(C("type") == "filter", F.coalesce("value", F.lit(""))).alias("filter"),
        F.when(is_view_root(C("text")), C("node_id")).alias("root"),
        safe_filename(display_caption(C("text"))).alias("file"),
    )
    walked = tree_fold(
        nodes,
        {"__chain": (F.array(own), appended)},
        inner=C("type") != "item",
        node_id="node_id",
        parent_id="parent_id",
        top=FAV_TOP,
        label="favwalk",
    )
    above = F.slice("__chain", F.lit(1), C("depth") - 1)
    nearest = lambda name: F.reverse(F.filter(F.transform(above, lambda c: c[name]), lambda v: v.isNotNull()))
    joined_of = lambda chain, name, mark: F.array_join(F.transform(chain, lambda c: c[name]), mark)
    parent = C("depth") > 1
    return walked.withColumns(
        {
            "sort_path": joined_of("__chain", "key", "/"),
            "filters": nearest("filter"),
            "roots": nearest("root"),
            "parent_text": F.when(parent, F.get("__chain", C("depth") - 2)["text"]),
            "parent_sort": F.when(parent, joined_of(above, "key", "/")),
            "file_path": joined_of(F.slice("__chain", F.lit(2), C("depth")), "file", "\\"),
        }
    ).drop("__chain")


def nearest_filter(walked: DataFrame) -> DataFrame:
    """Adds ``filter``: the value of the closest filter ancestor, empty without one."""
    return walked.withColumn("filter", F.coalesce(F.get("filters", F.lit(0)), F.lit("")))


def ancestor_filters(walked: DataFrame) -> DataFrame:
    """(doc_id, node_id, level, value) of all filter ancestors, nearest at level 0."""
    return walked.select(*ITEM, F.posexplode("filters").alias("level", "value"))


def resolve_favorites(walked: DataFrame, solo: bool = False) -> DataFrame:
    """One row per saved item: export name, state, filter and the state it starts from.

    ``base`` is "current" or "empty" for filtered items; unfiltered ones load their state alone.
    """
    items = nearest_filter(walked.filter("type = 'item'"))
    return items.select(
        *ITEM,
        F.concat("file_path", F.lit(".png")).alias("file_name"),
        F.coalesce("value", F.lit("")).alias("state"),
        "filter",
        F.when(C("filter") == "", "none").otherwise("empty" if solo else "current").alias("base"),
    )


def view_selects(walked: DataFrame) -> DataFrame:
    """The selectable parts under every view root, one row per item.

    A folder or filter below a root becomes a select when it has items and its items have a
    non-empty nearest filter. Selects are numbered in tree order, items in sibling order.
    """
    items = nearest_filter(walked.filter("type = 'item'")).filter("filter <> ''").select(
        "doc_id", "parent_id", "ordinal", "roots", "parent_text", "parent_sort", "node_id", "text", "value", "filter"
    )
    items = stage(items, "selectitems")
    ranked = rank_in_group(items, ["doc_id", "parent_id"], "ordinal", "item_ord")
    rows = ranked.select(
        "doc_id",
        F.explode("roots").alias("root_id"),
        C("parent_id").alias("select_id"),
        display_caption(C("parent_text")).alias("caption"),
        C("parent_sort").alias("select_sort"),
        "item_ord",
        C("node_id").alias("item_id"),
        C("text").alias("item_name"),
        C("value").alias("item_value"),
        "filter",
    ).filter(C("root_id") != C("select_id"))
    rows = stage(rows, "selects")
    heads = rows.groupBy("doc_id", "root_id", "select_id").agg(
        F.min("select_sort").alias("select_sort"), F.count("*").alias("size")
    )
    numbered = stage(
        rank_sorted(heads, ["doc_id", "root_id"], ["select_sort"], "select_ord", "selectord"), "selectord"
    )
    totals = numbered.groupBy("doc_id", "root_id").agg(F.count("*").alias("__n"))
    numbered = numbered.join(totals, ["doc_id", "root_id"]).withColumn("last_mod", C("__n") - C("select_ord"))
    return rows.drop("select_sort").join(
        numbered.drop("select_sort", "__n"), ["doc_id", "root_id", "select_id"]
    )


def select_sizes(selects: DataFrame) -> DataFrame:
    return selects.filter("item_ord = 0").select("doc_id", "root_id", "select_ord", "size")


def active_order(selects: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(doc_id, root_id, step, select_id, item_id): chosen items in the order they are applied.

    Older changes come first; untouched selects count down, so the first select is last.
    """
    rows = selects.filter("item_ord = 0").select("doc_id", "root_id", "select_id", "select_ord", "item_id", "last_mod")
    if chosen is not None:
        new = chosen.select("doc_id", "root_id", "select_id", C("item_id").alias("__i"), C("last_mod").alias("__m"))
        rows = rows.join(new, ["doc_id", "root_id", "select_id"], "left").select(
            "doc_id", "root_id", "select_id", "select_ord",
            F.coalesce("__i", "item_id").alias("item_id"),
            F.coalesce("__m", "last_mod").alias("last_mod"),
        )
    return rank_sorted(rows, ["doc_id", "root_id"], ["last_mod", "select_ord"], "step", "active").select(
        "doc_id", "root_id", "step", "select_id", "item_id"
    )


def count_views(selects: DataFrame) -> DataFrame:
    """(doc_id, root_id, views): the product of select sizes; roots without selects do not count.

    Exact up to 38 digits, null beyond.
    """
    sizes = F.collect_list(F.when(C("size") != 1, C("size")))
    return select_sizes(selects).groupBy("doc_id", "root_id").agg(_exact_product(sizes).alias("views"))


def _exact_product(sizes: Column) -> Column:
    """Product of an array of whole numbers as DECIMAL(38,0); null on overflow."""
    return F.aggregate(
        sizes, F.lit(1).cast("decimal(38,0)"), lambda a, n: F.try_multiply(a, n.cast("decimal(20,0)")).cast("decimal(38,0)")
    )


MOST_VIEWS = 2**63 - 1


def too_many_views(selects: DataFrame) -> DataFrame:
    """(doc_id, root_id, views, reason) of roots whose views a 64-bit index can't number."""
    rows = count_views(selects).filter(C("views").isNull() | (C("views") > F.lit(str(MOST_VIEWS)).cast("decimal(38,0)")))
    return rows.withColumn("reason", F.lit("more views than a 64-bit index holds"))


VIEW_BLOCK = 1 << 16


def enumerate_views(selects: DataFrame) -> DataFrame:
    """(doc_id, root_id, view_index, select_ord, item_ord) of every combination, last select fastest.

    The combinations are index numbers, decoded per select with a stride; no cross join. A
    root is cut into index blocks, blocks meet the selects, and only then are they spread over
    tasks and unrolled in place, so no unrolled row is shuffled. Selects of one item take no
    part in the strides, and at most 63 larger ones fit a 64-bit index, which bounds the
    stride window. Roots with more views than that are left to ``too_many_views``. Where documents lie in
    buckets and no root has more than a block of views, they are unrolled where they lie.
    """
    counted = stage(count_views(selects), "viewcounts")
    counts = counted.filter(C("views") <= F.lit(str(MOST_VIEWS)).cast("decimal(38,0)")).withColumn("views", C("views").cast("bigint"))
    sizes = stage(select_sizes(selects).join(counts.select("doc_id", "root_id"), ["doc_id", "root_id"]), "sizes")
    many = sizes.filter("size > 1")
    later = Window.partitionBy("doc_id", "root_id").orderBy(C("select_ord").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    strides = many.withColumn("stride", _exact_product(F.collect_list("size").over(later)).cast("bigint"))
    coded = strides.select("doc_id", "root_id", "select_ord", "size", "stride").unionByName(
        sizes.filter("size = 1").withColumn("stride", F.lit(1).cast("bigint"))
    )
    blocks = counts.join(coded, ["doc_id", "root_id"]).select(
        "doc_id",
        "root_id",
        "select_ord",
        "size",
        "stride",
        "views",
        F.explode(F.sequence(F.lit(0), F.expr(f"(views - 1) div {VIEW_BLOCK}"))).alias("block"),
    )
    start = C("block") * VIEW_BLOCK
    stop = F.least(start + VIEW_BLOCK, C("views")) - 1
    if not bucketed() or not counts.filter(C("views") > VIEW_BLOCK).isEmpty():
        blocks = blocks.repartition("doc_id", "root_id", "block", "select_ord")
    return blocks.select("*", F.explode(F.sequence(start, stop)).alias("view_index")).select(
        "doc_id", "root_id", "view_index", "select_ord", F.expr("(view_index div stride) % size").alias("item_ord")
    )


def name_views(
    roots: DataFrame, selects: DataFrame, views: DataFrame, style: str = "standard", flat: bool = True
) -> DataFrame:
    """(doc_id, root_id, view_index, name): exported name of each view.

    ``roots``: doc_id, node_id, text and ``root_ord`` for the index style. A view has one part
    per select.
    """
    items = selects.select("doc_id", "root_id", "select_ord", "item_ord", "caption", "item_name")
    part = F.struct(
        "select_ord", F.struct(C("caption"), C("item_name").alias("name"), C("item_ord").alias("index")).alias("p")
    )
    parts = (
        views.join(items, ["doc_id", "root_id", "select_ord", "item_ord"])
        .groupBy("doc_id", "root_id", "view_index")
        .agg(F.sort_array(F.collect_list(part)).alias("parts"))
    )
    heads = roots.select(
        "doc_id",
        C("node_id").alias("root_id"),
        F.struct(
            F.lit("root").alias("caption"), F.substring("text", 2, 1 << 30).alias("name"), C("root_ord").cast("bigint").alias("index")
        ).alias("head"),
    )
    rows = parts.join(heads, ["doc_id", "root_id"])
    whole = F.concat(F.array("head"), F.transform("parts", lambda v: v["p"]))
    return rows.select("doc_id", "root_id", "view_index", view_name(whole, style, flat).alias("name"))


def _lines(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(doc_id, key, path) closed under prefixes."""
    line = F.explode(F.split(F.replace(column, F.lit("\r"), F.lit("")), "\n"))
    parts = F.split("line", "/")
    prefix = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    return (
        rows.select("doc_id", key, line.alias("line"))
        .select("doc_id", key, F.explode(prefix).alias("path"))
        .distinct()
    )


def item_deltas(layers: DataFrame, selects: DataFrame) -> DataFrame:
    """(item_id, doc_id, seq_id, checked): what choosing an item does, independent of the view.

    Items of a select share its filter, which is read once per distinct text.
    """
    # an item under nested view roots is listed once per root, with the same content
    chosen = selects.groupBy("doc_id", "item_id").agg(
        F.any_value("filter").alias("filter"), F.any_value(F.coalesce("item_value", F.lit(""))).alias("state")
    )
    items = stage(chosen.withColumn("filter_id", F.md5("filter")), "items")
    filters = items.select("doc_id", "filter_id", "filter").distinct()
    return state_delta(
        layers,
        _lines(items, "item_id", "state"),
        _lines(filters, "filter_id", "filter"),
        keys=("item_id",),
        filter_keys=("filter_id",),
        owners=items.select("item_id", "doc_id", "filter_id"),
    )


def resolve_views(layers: DataFrame, selects: DataFrame, views: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """(doc_id, root_id, view_index, seq_id, checked) for the layers each view sets.

    Overlays do not read flags, so the last select that touches a layer decides; every view
    starts from the same flags and layers not listed keep them. ``deltas`` may be passed where they are known.
    """
    deltas = stage(item_deltas(layers, selects), "deltas") if deltas is None else deltas
    items = selects.select("doc_id", "root_id", "select_ord", "item_ord", "item_id")
    chosen = views.join(items, ["doc_id", "root_id", "select_ord", "item_ord"])
    return (
        chosen.join(deltas, ["doc_id", "item_id"])
        .groupBy("doc_id", "root_id", "view_index", "seq_id")
        .agg(F.max_by("checked", "select_ord").alias("checked"))
    )


def _decisions(layers: DataFrame, selects: DataFrame, deltas: DataFrame) -> DataFrame:
    """(doc_id, root_id, anc, by, fixed): how the choices of a root set a layer that some of its items touch.

    ``by`` lists (select_ord, size, flags by item) of the selects that touch it, the last one first: the first that holds the
    chosen item decides. Selects before one that touches the layer with each of its items have no say.
    ``fixed`` is the flag where all choices give the same one.
    """
    items = selects.select("doc_id", "root_id", "select_ord", "item_ord", "size", "item_id")
    touches = items.join(deltas, ["doc_id", "item_id"])
    per_select = touches.groupBy("doc_id", "root_id", "seq_id", "select_ord").agg(
        F.first("size").alias("size"), F.collect_list(F.struct("item_ord", C("checked").alias("flag"))).alias("set")
    )  # at most one a item
    stacked = per_select.groupBy("doc_id", "root_id", "seq_id").agg(
        F.sort_array(F.collect_list(F.struct("select_ord", "size", "set")), asc=False).alias("by")
    )
    flags = layers.select("doc_id", "seq_id", C("checked").alias("__base"))
    always = F.transform("by", lambda s: F.size(s["set"]) == s["size"])
    rows = stacked.join(flags, ["doc_id", "seq_id"]).withColumn("__full", F.array_position(always, True))
    rows = rows.withColumn("by", F.when(C("__full") > 0, F.slice("by", F.lit(1), C("__full").cast("int"))).otherwise(C("by")))
    values = F.flatten(F.transform("by", lambda s: F.transform(s["set"], lambda i: i["flag"])))
    values = F.array_distinct(F.when(C("__full") > 0, values).otherwise(F.concat(values, F.array("__base"))))
    return rows.select(
        "doc_id", "root_id", C("seq_id").alias("anc"), C("__base").alias("base"),
        F.when(F.size(values) == 1, F.get(values, F.lit(0))).alias("fixed"),
        F.transform("by", lambda s: F.struct(s["select_ord"].alias("select_ord"), s["size"].alias("size"), F.map_from_entries(s["set"]).alias("set"))).alias("by"),
    )


def _lit_leaves(layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with the flags of their chain: (doc_id, seq_id, anc, checked), and (doc_id, seq_id, off, has_mask) of each."""
    leaves = layers.filter(~C("folder")).select("doc_id", "seq_id", "has_mask", F.concat(F.array("seq_id"), "ancestors").alias("chain"))
    flags = layers.select("doc_id", C("seq_id").alias("anc"), "checked")
    chains = stage(leaves.select("doc_id", "seq_id", "has_mask", F.explode("chain").alias("anc")).join(flags, ["doc_id", "anc"]), "chains")
    own = chains.groupBy("doc_id", "seq_id").agg(F.count_if(~C("checked")).alias("off"), F.first("has_mask").alias("has_mask"))
    return chains.select("doc_id", "seq_id", "anc", "checked"), stage(own, "lit")


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the digests' counts and words of rows that come (1), go (-1) or stay as they are (0)."""
    total = lambda v: F.sum(C("sign") * v)
    w1, w2 = digest_words("seq_id", "has_mask")
    return rows.filter("sign <> 0").withColumns({"w1": w1, "w2": w2}).groupBy(*keys).agg(
        total(F.lit(1).cast("bigint")).alias("n"), total(C("w1")).alias("w1"), total(C("w2")).alias("w2")
    )


COMBOS = 1 << 16


def key_changes(
    layers: DataFrame, selects: DataFrame, deltas: DataFrame, leaves: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(doc_id, root_id, about, sizes, code, n, w1, w2): what choices add to the digest of a document's current picture.

    Leaves whose drawing depends on the same selects (``about``, ascending) change together: for each combination of their items,
    numbered by ``code`` with the last select fastest, one row sums up which of them come and go. Leaves that no choice touches, or
    that are off in every view and now, give no rows. So the table follows the touched layers and the
    choices that reach each of them, not the views. ``leaves`` (of ``_lit_leaves``) may be passed where they are known.
    """
    chains, lit = _lit_leaves(layers) if leaves is None else leaves
    touched = chains.join(_decisions(layers, selects, deltas), ["doc_id", "anc"])
    open_ = F.when(C("fixed").isNull(), F.struct("base", "by"))
    leaves = touched.groupBy("doc_id", "root_id", "seq_id").agg(
        F.collect_list(open_).alias("chain"),
        F.count_if(~C("checked")).alias("__off"),
        F.coalesce(F.bool_or(~C("fixed")), F.lit(False)).alias("__dead"),
    ).join(lit, ["doc_id", "seq_id"])
    never = C("__dead") | (C("off") > C("__off"))
    leaves = leaves.withColumns(
        {"__now": C("off") == 0, "__never": never, "chain": F.when(never, F.array().cast(leaves.schema["chain"].dataType)).otherwise(C("chain"))}
    ).filter(~never | C("__now"))
    reach = F.array_sort(F.array_distinct(F.flatten(F.transform("chain", lambda d: F.transform(d["by"], lambda s: F.struct(s["select_ord"].alias("o"), s["size"].alias("s")))))))
    combos = leaves.withColumn("__r", reach).withColumns(
        {"about": F.transform("__r", lambda r: r["o"]), "sizes": F.transform("__r", lambda r: r["s"])}
    ).withColumn("__m", F.aggregate("sizes", F.lit(1).cast("bigint"), lambda a, s: a * s))
    blocks = combos.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((C("__m") - 1) / COMBOS))))
    coded = blocks.withColumn("code", F.explode(F.sequence(C("__b") * COMBOS, F.least((C("__b") + 1) * COMBOS, C("__m")) - 1)))
    picked = F.aggregate(
        F.reverse("sizes"),
        F.struct(C("code").alias("left"), F.array().cast("array<bigint>").alias("p")),
        lambda a, s: F.struct(F.call_function("div", a["left"], s).alias("left"), F.concat(F.array(a["left"] % s), a["p"]).alias("p")),
    )["p"]
    coded = coded.withColumn("__p", F.map_from_arrays("about", picked))
    flag = lambda d: F.coalesce(
        F.get(F.filter(F.transform(d["by"], lambda s: F.try_element_at(s["set"], F.try_element_at(C("__p"), s["select_ord"]))), lambda v: v.isNotNull()), F.lit(0)),
        d["base"],
    )
    drawn = ~C("__never") & F.forall("chain", flag)
    changed = coded.withColumn("sign", drawn.cast("int") - C("__now").cast("int"))
    return _sums(changed, ["doc_id", "root_id", "about", "sizes", "code"])


def view_keys(layers: DataFrame, selects: DataFrame, views: DataFrame, deltas: DataFrame) -> DataFrame:
    """(doc_id, root_id, view_index, render_key): the digest of what each view draws.

    ``layers`` has parents, ``checked``, and the marks that tell pictures apart (mask, clipping).
    A layer counts when it and all ancestors are on; leaves only, as folders add no pixels. Digests are sums, so a view's is that
    of the current picture plus one row of ``key_changes`` for each set of selects: views never meet layers.
    """
    view = ["doc_id", "root_id", "view_index"]
    chains, lit = _lit_leaves(layers)
    now = _sums(lit.withColumn("sign", (C("off") == 0).cast("int")), ["doc_id"])
    changes = stage(key_changes(layers, selects, deltas, (chains, lit)), "keychanges")
    chosen = stage(
        views.groupBy(*view).agg(F.map_from_entries(F.collect_list(F.struct("select_ord", "item_ord"))).alias("choice")), "choices"
    )
    kinds = changes.select("doc_id", "root_id", "about", "sizes").distinct()
    code = F.aggregate(
        F.arrays_zip("about", "sizes"), F.lit(0).cast("bigint"),
        lambda a, r: a * r["sizes"] + F.element_at(C("choice"), r["about"]),
    )
    met = chosen.join(kinds, ["doc_id", "root_id"]).withColumn("code", code).select(*view, "about", "code")
    met = met.join(changes.drop("sizes"), ["doc_id", "root_id", "about", "code"]).select(*view, "n", "w1", "w2")
    zero = [F.lit(0).cast(met.schema[c].dataType).alias(c) for c in ("n", "w1", "w2")]
    moved = chosen.select(*view, *zero).unionAll(met).groupBy(*view).agg(*[F.sum(c).alias(c) for c in ("n", "w1", "w2")])
    whole = moved.join(now.toDF("doc_id", "__n", "__w1", "__w2"), "doc_id", "left")
    total = lambda c: C(c) + F.coalesce("__" + c, F.lit(0))
    key = F.when(total("n") == 0, "empty").otherwise(digest_of_sums(total("n"), total("w1"), total("w2")))
    return whole.select(*view, key.alias("render_key"))


def render_key(drawn: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, render_key) of drawn layers: equal keys draw the same picture.

    Layer order is fixed within a document, so the set of ids and marks decides.
    """
    return drawn.groupBy(*keys).agg(set_digest("seq_id", "has_mask").alias("render_key"))


def distinct_pictures(keys: DataFrame) -> DataFrame:
    """(doc_id, render_key, view_index, root_id, views): one view to render per picture."""
    return keys.groupBy("doc_id", "render_key").agg(
        F.min(F.struct("root_id", "view_index")).alias("__v"), F.count("*").alias("views")
    ).select("doc_id", "render_key", "__v.root_id", "__v.view_index", "views")


def carry_selections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chosen item and its time per select after a refresh.

    ``old``: (doc_id, root_id, select_id, item_id, last_mod). A choice survives when its root,
    select and item still exist; otherwise the first item and the initial time are taken.
    """
    keys = ["doc_id", "root_id", "select_id"]
    first = new.filter("item_ord = 0").select(*keys, C("item_id").alias("__first"), C("last_mod").alias("__init"))
    kept = old.join(new.select(*keys, "item_id").distinct(), [*keys, "item_id"], "left_semi")
    return first.join(kept.select(*keys, "item_id", "last_mod"), keys, "left").select(
        *keys,
        F.coalesce("item_id", "__first").alias("item_id"),
        F.coalesce("last_mod", "__init").alias("last_mod"),
    )


def view_catalog(
    roots: DataFrame, selects: DataFrame, fmt: str = "json", flatten: bool = True, style: str = "standard"
) -> DataFrame:
    """(doc_id, json): roots with captions and item names; a catalog is one small document."""
    items = selects.groupBy("doc_id", "root_id", "select_ord", "caption").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("item_ord", safe_filename("item_name").alias("name")))),
            lambda p: p["name"],
        ).alias("names")
    )
    per_root = items.groupBy("doc_id", "root_id").agg(
        F.sort_array(
            F.collect_list(F.struct("select_ord", safe_filename("caption").alias("caption"), "names"))
        ).alias("s")
    )
    listed = roots.select("doc_id", C("node_id").alias("root_id"), C("text"), "sort_path").join(
        per_root, ["doc_id", "root_id"], "left"
    )
    entry = F.struct(
        F.substring("text", 2, 1 << 30).alias("name"),
        F.coalesce(F.transform("s", lambda v: v["caption"]), F.array().cast("array<string>")).alias("captions"),
        F.coalesce(F.transform("s", lambda v: v["names"]), F.array().cast("array<array<string>>")).alias("selects"),
    )
    packed = listed.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("sort_path", entry.alias("e")))).alias("r")
    )
    return packed.select(
        "doc_id",
        F.to_json(
            F.struct(
                F.lit(fmt).alias("format"),
                F.lit(flatten).alias("flatten"),
                F.lit(style).alias("namingStyle"),
                F.transform("r", lambda v: v["e"]).alias("roots"),
            )
        ).alias("json"),
    )


# -- versions ---------------------------------------------------------------------------------


def pick_version(docs: DataFrame, versions: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, data): the favorites a document opens with.

    The oldest stored version of the same content wins when newer than the bundled file;
    else the bundled text, else nothing. A dropped file beats both.
    """
    oldest = versions.groupBy(C("doc_hash").alias("hash")).agg(
        F.min(F.struct("ts", "id", "data")).alias("v")
    )
    rows = docs.join(oldest, "hash", "left")
    newer = F.coalesce(F.unix_millis(C("v.ts").cast("timestamp")) / 1000 > F.coalesce("pfv_mtime", F.lit(0)), F.lit(False))
    bundled = F.coalesce("pfv", F.lit("")) != ""
    source = F.when(newer, "stored").when(bundled, "bundled").otherwise("none")
    data = F.when(newer, C("v.data")).when(bundled, C("pfv"))
    if dropped is not None:
        rows = rows.join(dropped.select("doc_id", C("data").alias("__drop")), "doc_id", "left")
        source = F.when(C("__drop").isNotNull(), "dropped").otherwise(source)
        data = F.coalesce("__drop", data)
    return rows.select("doc_id", source.alias("source"), data.alias("data"))


def recent_versions(saves: DataFrame, keep: int = 8) -> DataFrame:
    """Stored versions after a batch of saves (session, ts, doc_hash, id, data, entries).

    Saves count in order of (ts, id, session). A save stores its version anew, and takes away the
    version that its session saved before for the document, whoever saved that last. Saves before a
    session's first non-empty one are not stored. Whenever ``keep`` newer versions are stored, a
    version is pushed out and doesn't come back.
    """
    started = saves.filter("entries > 0").groupBy("session", "doc_hash").agg(F.min("ts").alias("__from"))
    live = saves.join(started, ["session", "doc_hash"]).filter(C("ts") >= C("__from")).drop("__from")
    placed = number_rows(live, ["ts", "id", "session"], "__at", "saves")
    before = F.lag("id").over(Window.partitionBy("doc_hash", "session").orderBy("__at"))
    events = stage(placed.withColumn("__before", before), "saveorder")
    # the life of a stored version ends with the next event on it: saved again, or taken away
    taken = events.filter(C("__before") != C("id")).select("doc_hash", C("__before").alias("id"), "__at", F.lit(False).alias("__saved"))
    line = events.select("doc_hash", "id", "__at", F.lit(True).alias("__saved")).unionByName(taken)
    end = F.lead("__at").over(Window.partitionBy("doc_hash", "id").orderBy("__at"))
    lives = stage(line.withColumn("__end", end).filter("__saved"), "lives")
    newest = lives.filter("__end is null").orderBy(C("__at").desc()).limit(keep).select("__at").collect()
    places = [r[0] for r in newest]  # at most ``keep`` numbers
    later = F.filter(F.array(*[F.lit(p) for p in places]).cast("array<bigint>"), lambda p: p < C("__at"))
    steps = lives.select(F.explode(later).alias("__of"), "__at", "__end")
    change = (
        steps.select("__of", "__at", F.lit(1).alias("__d"))
        .unionAll(steps.filter("__end is not null").select("__of", "__end", F.lit(-1)))
        .groupBy("__of", "__at")
        .agg(F.sum("__d").alias("__d"))
    )
    crowd = running_sum(change, ["__of"], "__at", C("__d"), "__newer")
    gone = crowd.groupBy("__of").agg(F.max("__newer").alias("__most")).filter(C("__most") >= keep)
    stay = events.filter(C("__at").isin(places) if places else F.lit(False))
    return (
        stay.join(gone.select(C("__of").alias("__at")), "__at", "left_anti")
        .select("doc_hash", "id", "ts", "session", "data", "entries")
        .orderBy(C("ts").desc(), "id")
        .limit(keep)
    )


def recent_list(versions: DataFrame, doc_hash: str | Column, limit: int = 8) -> DataFrame:
    """Newest versions first with entry counts and a mark for the open document."""
    mine = C("doc_hash") == (F.lit(doc_hash) if isinstance(doc_hash, str) else doc_hash)
    rows = versions.select(
        "id", "ts", count_entries(C("data")).alias("entries"), mine.alias("this_document")
    )
    return rows.withColumn("saved", format_ts("ts")).orderBy(C("ts").desc(), "id").limit(limit)


# -- names ------------------------------------------------------------------------------------


# What counts as white space at the ends of a typed line.
SPACE = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def trim_line(text) -> Column:
    text = C(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(text, r"\A" + SPACE, ""), SPACE + r"\z", "")


def bulk_folders(texts: DataFrame) -> DataFrame:
    """(doc_id, line_no, text): trimmed non-empty lines, one folder each."""
    lines = texts.select(
        "doc_id", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("line_no", "line")
    )
    return lines.select("doc_id", "line_no", trim_line("line").alias("text")).filter("text <> ''")


def auto_number(renames: DataFrame, start: int = 0, digits: int = 3) -> DataFrame:
    """Fill blank new names with consecutive padded numbers in tree order per document."""
    blank = renames.filter("new_text = ''")
    numbered = rank_sorted(blank, ["doc_id"], ["sort_path"], "__at", "autonum")
    filled = numbered.withColumn("new_text", padded(C("__at") + start, digits)).drop("__at")
    return renames.filter("new_text <> ''").unionByName(filled.select(*renames.columns))


def bulk_rename(nodes: DataFrame, renames: DataFrame) -> DataFrame:
    """Node texts after all renames at once, so swaps need no intermediate names; clashes are settled.

    Siblings that keep their text hold it; of renamed ones the first in sibling order gets a text, the others a number.
    """
    new = renames.select(*ITEM, C("new_text").alias("__new"))
    rows = nodes.join(new, ITEM, "left").withColumns(
        {"__moved": F.coalesce(C("__new") != C("text"), F.lit(False)), "text": F.coalesce("__new", "text")}
    )
    return unique_names(rows.drop("__new"), late="__moved").drop("__moved")


def add_folders(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """Folders (doc_id, parent_id, ordinal, text, line_no) for the lines of ``bulk_folders``, above the present siblings.

    ``lines`` has doc_id, parent_id, line_no and text. Names that siblings or earlier lines have get a number.
    """
    last = nodes.groupBy("doc_id", "parent_id").agg(F.max("ordinal").alias("__last"))
    new = lines.join(last, ["doc_id", "parent_id"], "left").select(
        "doc_id", "parent_id", (F.coalesce("__last", F.lit(-1)) + 1 + C("line_no")).alias("ordinal"), "text",
        C("line_no").cast("int").alias("line_no"),
    )
    held = nodes.select("doc_id", "parent_id", "ordinal", "text", F.lit(None).cast("int").alias("line_no"))
    return unique_names(held.unionByName(new)).filter("line_no is not null")


LATE = 1 << 62


def unique_names(nodes: DataFrame, late: str | None = None) -> DataFrame:
    """Sibling names made unique: "name", "name 2", "name 3"...

    All texts that siblings have are taken from the start, and the first holder of a text keeps it, in ``ordinal``
    order with rows marked ``late`` after the others. The k-th repeat gets the k-th number from 2 on that no sibling's text has
    taken. That number follows from how many taken ones lie below it, a count over sorted blocks, so a family of any
    size spreads over tasks. A made name is never another's: its last number tells its text.
    """
    keys = ["doc_id", "parent_id"]
    order = C("ordinal") if late is None else C("ordinal") + F.when(C(late), F.lit(LATE)).otherwise(F.lit(0))
    rows = rank_in_group(nodes.withColumn("__order", order), [*keys, "text"], "__order", "__at").drop("__order")
    rows = stage(rows, "named")
    again = rows.filter("__at > 0").select(*keys, "text", "__at")
    number = r"(?s)\A(.*) ([1-9][0-9]{0,17})\z"
    taken = (
        rows.filter(C("__at") == 0)
        .filter(C("text").rlike(number))
        .select(*keys, F.regexp_extract("text", number, 1).alias("__of"), F.regexp_extract("text", number, 2).cast("bigint").alias("__m"))
        .filter(C("__m") > 1)
        .withColumnRenamed("__of", "text")
    )
    families = again.select(*keys, "text").distinct()
    taken = rank_in_group(taken.join(families, [*keys, "text"], "left_semi"), [*keys, "text"], "__m", "__i")
    # free numbers below the i-th taken one, from 0: m - 2 - i; the k-th repeat passes those with fewer than k
    marks = taken.select(*keys, "text", ((C("__m") - 2 - C("__i")) * 2 + 1).alias("__o"), F.lit(1).alias("__t"))
    marks = marks.unionAll(again.select(*keys, "text", (C("__at") * 2).alias("__o"), F.lit(0).alias("__t")))
    passed = running_sum(marks, [*keys, "text"], "__o", C("__t"), "__passed").filter(C("__t") == 0)
    passed = passed.select(*keys, "text", F.expr("__o div 2").alias("__at"), "__passed")
    named = rows.join(passed, [*keys, "text", "__at"], "left")
    suffix = F.concat(F.lit(" "), (C("__at") + 1 + C("__passed")).cast("string"))
    return named.withColumn("text", F.when(C("__at") == 0, C("text")).otherwise(F.concat("text", suffix))).select(*nodes.columns)

"""Queries for favorites files, saved views, versions and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.registry import register, table
from lamina.fixtures import LINES_SQL, SHALLOW_SQL, flag_no, line_name, order_lines, shallow_paths
from lamina.functions.names import format_ts
from lamina.operators import views as V
from lamina.session import by_document
from lamina.session import stage_large as stage
from lamina.sources import favorites as FS

C = F.col

_FLAG_NO = "CASE flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
_LINE_NAME = "CASE WHEN flag = 'A' THEN '*' WHEN ln = 7 THEN '!' ELSE '' END || 'l' || ln"

# one favorites tree per order: root, one view root, a filter or folder per flag, an item per line
FAV_SQL = f"""fav AS (
  SELECT DISTINCT doc_id, 'root' AS node_id, '#' AS parent_id, 0::BIGINT AS ordinal, 'Fav' AS text, 'root' AS type, NULL::VARCHAR AS value
  FROM lines
  UNION ALL SELECT DISTINCT doc_id, 'v', 'root', 0, '*' || o_orderpriority, 'folder', NULL FROM lines JOIN orders ON o_orderkey = doc_id
  UNION ALL SELECT doc_id, flag, 'v', ({_FLAG_NO})::BIGINT, CASE flag WHEN 'N' THEN '*N' ELSE flag END,
    CASE flag WHEN 'R' THEN 'folder' ELSE 'filter' END,
    CASE WHEN flag <> 'R' THEN coalesce(string_agg(flag || '/' || {_LINE_NAME}, chr(10) ORDER BY ln) FILTER (WHERE qty > 5), '') END
  FROM lines GROUP BY doc_id, flag
  UNION ALL SELECT doc_id, flag || '/' || ln, flag, ln, 'l' || ln, 'item',
    CASE WHEN disc >= 0.02 THEN flag || '/' || {_LINE_NAME} ELSE flag END FROM lines)"""

_F = "WITH " + LINES_SQL + ", " + FAV_SQL


def fav_nodes(spark, sf, lines=None):
    lines = stage(order_lines(spark, sf), "lines") if lines is None else lines
    orders = table(spark, sf, "orders")
    docs = lines.select("doc_id").distinct()
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    root = docs.select(
        "doc_id", F.lit("root").alias("node_id"), F.lit("#").alias("parent_id"), zero.alias("ordinal"),
        F.lit("Fav").alias("text"), F.lit("root").alias("type"), none.alias("value"),
    )
    view = orders.join(docs, C("o_orderkey") == C("doc_id"), "left_semi").select(
        "o_orderkey", F.lit("v"), F.lit("root"), zero, F.concat(F.lit("*"), "o_orderpriority"), F.lit("folder"), none
    )
    path = F.concat("flag", F.lit("/"), line_name())
    kept = F.sort_array(F.collect_list(F.when(C("qty") > 5, F.struct("ln", path.alias("p")))))
    flags = lines.groupBy("doc_id", "flag").agg(F.array_join(F.transform(kept, lambda v: v["p"]), "\n").alias("t")).select(
        "doc_id", "flag", F.lit("v"), flag_no(), F.when(C("flag") == "N", "*N").otherwise(C("flag")),
        F.when(C("flag") == "R", "folder").otherwise("filter"), F.when(C("flag") != "R", C("t")),
    )
    items = lines.select(
        "doc_id", F.concat("flag", F.lit("/"), C("ln").cast("string")), "flag", "ln",
        F.concat(F.lit("l"), C("ln").cast("string")), F.lit("item"), F.when(C("disc") >= 0.02, path).otherwise(C("flag")),
    )
    return stage(root.union(view).union(flags).union(items), "favnodes")


# the written form, built on its own from the rows
_SQL_CHUNKS = f""", tops AS (SELECT doc_id, text AS top FROM fav WHERE node_id = 'v'),
  pad AS (SELECT *, lpad(ordinal::VARCHAR, 19, '0') AS k FROM fav),
  chunks AS (
  SELECT doc_id, k AS sort_path, '[Favorites-v1]' || chr(10) || 'root-name/Fav' || chr(10) || 'faview-mode/1' || chr(10) AS chunk
    FROM pad WHERE type = 'root'
  UNION ALL SELECT doc_id, repeat('0', 19) || '/' || repeat('0', 19) || '/' || k,
    '//' || top || '/' || text || '~filter' || CASE WHEN value <> '' THEN chr(10) || value ELSE '' END || chr(10)
    FROM pad JOIN tops USING (doc_id) WHERE type = 'filter'
  UNION ALL SELECT i.doc_id, repeat('0', 19) || '/' || repeat('0', 19) || '/' || p.k || '/' || i.k,
    '//' || top || '/' || p.text || '/' || i.text || chr(10) || i.value || chr(10)
    FROM pad i JOIN pad p ON p.doc_id = i.doc_id AND p.node_id = i.parent_id JOIN tops t ON t.doc_id = i.doc_id WHERE i.type = 'item')"""


@register("write_favorites", _F + _SQL_CHUNKS + "SELECT doc_id, sort_path, chunk FROM chunks")
def _write(spark, sf):
    return FS.favorites_chunks(fav_nodes(spark, sf))


def fav_files(spark, sf):
    return FS.favorites_text(FS.favorites_chunks(fav_nodes(spark, sf)))


@register(
    "scan_favorites",
    _F
    + """, tops AS (SELECT doc_id, text AS top FROM fav WHERE node_id = 'v')
  SELECT doc_id, top AS path, NULL AS parent_path, top AS text, 'folder' AS type, NULL AS value FROM tops
  UNION ALL SELECT f.doc_id, top || '/' || text, top, text, type, value FROM fav f JOIN tops USING (doc_id) WHERE parent_id = 'v'
  UNION ALL SELECT i.doc_id, top || '/' || p.text || '/' || i.text, top || '/' || p.text, i.text, i.type, i.value
    FROM fav i JOIN fav p ON p.doc_id = i.doc_id AND p.node_id = i.parent_id JOIN tops t ON t.doc_id = i.doc_id WHERE i.type = 'item'""",
)
def _scan(spark, sf):
    return FS.scan_favorites(fav_files(spark, sf)).drop("ordinal")


_SQL_SETTINGS = """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'P' THEN 'My Favorites' ELSE o_orderpriority || '%/' END AS root_name,
  CASE WHEN o_custkey % 5 < 3 THEN o_custkey % 5 ELSE 2 END::INTEGER AS view_mode FROM orders"""


@register("favorites_settings", _SQL_SETTINGS)
def _settings(spark, sf):
    name = F.when(C("o_orderstatus") == "P", "").otherwise(F.concat("o_orderpriority", F.lit("%25%2f")))
    text = F.concat(
        F.lit("[AnyFavorites-v1]\r\nroot-name/"), name, F.lit("\r\n\r\nfaview-mode/"),
        (C("o_custkey") % 5).cast("string"), F.lit("\r\n\r\n//a/b\r\nx\r\nroot-name/no\r\n"),
    )
    return FS.favorites_settings(
        table(spark, sf, "orders").select(C("o_orderkey").alias("doc_id"), text.alias("text"))
    )


@register(
    "count_entries",
    _F + """SELECT doc_id, count(*) FILTER (WHERE type IN ('filter', 'item')) AS entries FROM fav GROUP BY doc_id""",
)
def _entries(spark, sf):
    return fav_files(spark, sf).select("doc_id", FS.count_entries(C("text")).cast("bigint").alias("entries"))


@register("view_roots", _F + "SELECT doc_id, node_id, text FROM fav WHERE length(text) > 1 AND text LIKE '*%'")
def _roots(spark, sf):
    return V.view_roots(fav_nodes(spark, sf)).select("doc_id", "node_id", "text")


@register(
    "nearest_filter",
    _F
    + """SELECT i.doc_id, i.node_id, CASE WHEN p.type = 'filter' THEN p.value ELSE '' END AS filter
      FROM fav i LEFT JOIN fav p ON p.doc_id = i.doc_id AND p.node_id = i.parent_id""",
)
def _nearest(spark, sf):
    return V.nearest_filter(V.favorites_walk(fav_nodes(spark, sf))).select("doc_id", "node_id", "filter")


@register(
    "ancestor_filters",
    _F
    + """SELECT i.doc_id, i.node_id, 0 AS level, p.value FROM fav i JOIN fav p ON p.doc_id = i.doc_id AND p.node_id = i.parent_id
      WHERE p.type = 'filter'""",
)
def _ancestors(spark, sf):
    return V.ancestor_filters(V.favorites_walk(fav_nodes(spark, sf)))


@register(
    "resolve_favorites",
    _F
    + """SELECT i.doc_id, i.node_id, substr(t.text, 2) || '\\' || ltrim(p.text, '*') || '\\' || i.text || '.png' AS file_name, i.value AS state,
        CASE WHEN p.type = 'filter' THEN p.value ELSE '' END AS filter,
        CASE WHEN p.type = 'filter' AND p.value <> '' THEN 'current' ELSE 'none' END AS base
      FROM fav i JOIN fav p ON p.doc_id = i.doc_id AND p.node_id = i.parent_id JOIN fav t ON t.doc_id = i.doc_id AND t.node_id = 'v'
      WHERE i.type = 'item'""",
)
def _resolve(spark, sf):
    return V.resolve_favorites(V.favorites_walk(fav_nodes(spark, sf)))


_SQL_SELECTS = _F + """, items AS (
    SELECT i.doc_id, p.node_id AS select_id, ltrim(p.text, '*') AS caption, p.ordinal AS po, i.ordinal AS io, i.node_id AS item_id,
           i.text AS item_name, i.value AS item_value, p.value AS filter
    FROM fav i JOIN fav p ON p.doc_id = i.doc_id AND p.node_id = i.parent_id
    WHERE i.type = 'item' AND p.type = 'filter' AND p.value <> ''),
  selects AS (SELECT doc_id, 'v' AS root_id, select_id, caption, dense_rank() OVER (PARTITION BY doc_id ORDER BY po) - 1 AS select_ord,
      row_number() OVER (PARTITION BY doc_id, select_id ORDER BY io) - 1 AS item_ord, item_id, item_name, item_value, filter,
      count(*) OVER (PARTITION BY doc_id, select_id) AS size FROM items)"""


@register(
    "view_selects",
    _SQL_SELECTS
    + """SELECT s.*, n - select_ord AS last_mod FROM selects s
      JOIN (SELECT doc_id, count(DISTINCT select_id) AS n FROM selects GROUP BY doc_id) USING (doc_id)""",
)
def _selects(spark, sf, lines=None):
    return V.view_selects(V.favorites_walk(fav_nodes(spark, sf, lines)))


def selects_of(spark, sf, lines=None):
    return stage(_selects(spark, sf, lines), "viewselects")


_SQL_COUNTS = ", counts AS (SELECT doc_id, root_id, max(size) FILTER (WHERE select_id = 'A') AS na, max(size) FILTER (WHERE select_id = 'N') AS nn FROM selects GROUP BY ALL)"


@register(
    "count_views",
    _SQL_SELECTS + _SQL_COUNTS + "SELECT doc_id, root_id, coalesce(na, 1) * coalesce(nn, 1) AS views FROM counts",
)
def _count(spark, sf):
    return V.count_views(selects_of(spark, sf)).withColumn("views", C("views").cast("bigint"))


_SQL_VIEWS = _SQL_SELECTS + _SQL_COUNTS + """, idx AS (SELECT *, unnest(range(coalesce(na, 1) * coalesce(nn, 1))) AS view_index FROM counts),
  views AS (SELECT doc_id, root_id, view_index, 0::BIGINT AS select_ord, 'A' AS select_id, view_index // coalesce(nn, 1) AS item_ord FROM idx WHERE na > 0
    UNION ALL SELECT doc_id, root_id, view_index, CASE WHEN na > 0 THEN 1 ELSE 0 END, 'N', view_index % nn FROM idx WHERE nn > 0)"""


@register("enumerate_views", _SQL_VIEWS + "SELECT doc_id, root_id, view_index, select_ord, item_ord FROM views")
def _enumerate(spark, sf):
    return V.enumerate_views(selects_of(spark, sf))


_SQL_RESOLVED = _SQL_VIEWS + f""", chosen AS (
    SELECT v.doc_id, v.root_id, v.view_index, l.flag, l.ln, l.qty, l.disc FROM views v JOIN selects s USING (doc_id, root_id, select_id, item_ord)
    JOIN lines l ON l.doc_id = v.doc_id AND l.flag || '/' || l.ln = s.item_id),
  resolved AS (
    SELECT doc_id, root_id, view_index, ({_FLAG_NO})::BIGINT AS seq_id, true AS checked FROM chosen
    UNION ALL
    SELECT c.doc_id, c.root_id, c.view_index, ({_FLAG_NO.replace('flag', 'c.flag')} * 10 + l.ln)::BIGINT,
      c.disc >= 0.02 AND l.ln = c.ln FROM chosen c JOIN lines l ON l.doc_id = c.doc_id AND l.flag = c.flag AND l.qty > 5
    UNION ALL
    SELECT c.doc_id, c.root_id, c.view_index, 10 + l.ln, false FROM chosen c JOIN lines l ON l.doc_id = c.doc_id AND l.flag = c.flag
      WHERE c.flag = 'A' AND l.qty <= 5 AND c.qty > 5 AND c.disc >= 0.02)"""


def _resolved(spark, sf, lines):
    selects = selects_of(spark, sf, lines)
    return V.enumerate_views(selects), selects


@register("resolve_views", _SQL_RESOLVED + "SELECT * FROM resolved")
def _resolve_views(spark, sf):
    def resolve(lines):
        views, selects = _resolved(spark, sf, lines)
        return V.resolve_views(shallow_paths(spark, sf, lines), selects, views)

    return by_document(order_lines(spark, sf), resolve)


def sql_digest(seq: str, mark: str) -> str:
    row = f"md5({seq}::VARCHAR || chr(31) || ({mark})::VARCHAR)"
    word = lambda at: f"sum(('0x' || substr({row}, {at}, 15))::BIGINT)::VARCHAR"
    return f"md5(count(*)::VARCHAR || ':' || {word(1)} || ':' || {word(17)})"


_SQL_KEYS = _SQL_RESOLVED + ", " + SHALLOW_SQL.replace(LINES_SQL + ", ", "") + f""", full_flags AS (
    SELECT i.doc_id, i.root_id, i.view_index, s.seq_id, s.parent_seq_id, s.folder, coalesce(s.disc, 0) > 0.05 AS has_mask,
      coalesce(r.checked, s.visible) AS checked
    FROM idx i JOIN shallow s USING (doc_id) LEFT JOIN resolved r USING (doc_id, root_id, view_index, seq_id)),
  drawn AS (SELECT a.* FROM full_flags a JOIN full_flags f ON f.doc_id = a.doc_id AND f.root_id = a.root_id AND f.view_index = a.view_index
      AND f.seq_id = a.parent_seq_id WHERE a.checked AND f.checked),
  keys AS (SELECT i.doc_id, i.root_id, i.view_index, coalesce(k.render_key, 'empty') AS render_key FROM idx i LEFT JOIN
      (SELECT doc_id, root_id, view_index, {sql_digest('seq_id', 'has_mask')} AS render_key FROM drawn GROUP BY ALL) k USING (doc_id, root_id, view_index))"""


def _view_keys(spark, sf):
    return by_document(order_lines(spark, sf), lambda lines: _keys_of(spark, sf, lines))


def _keys_of(spark, sf, lines):
    views, selects = _resolved(spark, sf, lines)
    layers = shallow_paths(spark, sf, lines)
    deltas = stage(V.item_deltas(layers, selects), "deltas")
    marked = layers.select(
        "doc_id", "seq_id", "folder", "checked",
        (F.coalesce("disc", F.lit(0.0)) > 0.05).alias("has_mask"),
        F.when(C("parent_seq_id") == -1, F.array().cast("array<bigint>")).otherwise(F.array("parent_seq_id")).alias("ancestors"),
    )
    return V.view_keys(marked, selects, views, deltas)


@register("render_key", _SQL_KEYS + "SELECT doc_id, root_id, view_index, render_key FROM keys")
def _render_key(spark, sf):
    return _view_keys(spark, sf)


@register(
    "distinct_pictures",
    _SQL_KEYS + "SELECT doc_id, render_key, 'v' AS root_id, min(view_index) AS view_index, count(*) AS views FROM keys GROUP BY doc_id, render_key",
)
def _pictures(spark, sf):
    return V.distinct_pictures(_view_keys(spark, sf))


_SQL_OLD = """, old AS (SELECT l.doc_id, CASE WHEN o_orderstatus = 'P' THEN 'gone' ELSE 'v' END AS root_id, flag AS select_id,
    flag || '/' || max(ln) AS item_id, 1000 + max(ln) AS last_mod FROM lines l JOIN orders ON o_orderkey = l.doc_id
    GROUP BY l.doc_id, flag, o_orderstatus),
  carried AS (SELECT s.doc_id, s.root_id, s.select_id, s.select_ord, coalesce(o.item_id, s.item_id) AS item_id,
      coalesce(o.last_mod, n - select_ord) AS last_mod
    FROM selects s JOIN (SELECT doc_id, count(DISTINCT select_id) AS n FROM selects GROUP BY doc_id) USING (doc_id)
    LEFT JOIN old o ON o.doc_id = s.doc_id AND o.root_id = s.root_id AND o.select_id = s.select_id WHERE s.item_ord = 0)"""


def _carried(spark, sf):
    selects = selects_of(spark, sf)
    old = (
        order_lines(spark, sf)
        .groupBy("doc_id", C("flag").alias("select_id"))
        .agg(F.max("ln").alias("ln"))
        .join(table(spark, sf, "orders"), C("o_orderkey") == C("doc_id"))
        .select(
            "doc_id",
            F.when(C("o_orderstatus") == "P", "gone").otherwise("v").alias("root_id"),
            "select_id",
            F.concat("select_id", F.lit("/"), C("ln").cast("string")).alias("item_id"),
            (C("ln") + 1000).alias("last_mod"),
        )
    )
    return selects, V.carry_selections(old, selects)


@register("carry_selections", _SQL_SELECTS + _SQL_OLD + "SELECT doc_id, root_id, select_id, item_id, last_mod FROM carried")
def _carry(spark, sf):
    return _carried(spark, sf)[1]


@register(
    "active_order",
    _SQL_SELECTS
    + _SQL_OLD
    + """SELECT doc_id, root_id, row_number() OVER (PARTITION BY doc_id, root_id ORDER BY last_mod, select_ord) - 1 AS step,
      select_id, item_id FROM carried""",
)
def _active(spark, sf):
    selects, chosen = _carried(spark, sf)
    return V.active_order(selects, chosen)


@register(
    "write_view_catalog",
    _SQL_SELECTS
    + """, per AS (SELECT doc_id, select_ord, any_value(caption) AS caption, list(item_name ORDER BY item_ord) AS names FROM selects GROUP BY doc_id, select_ord),
  packed AS (SELECT doc_id, list(caption ORDER BY select_ord) AS captions, list(names ORDER BY select_ord) AS selects FROM per GROUP BY doc_id),
  roots AS (SELECT f.doc_id, f.node_id, f.text, CASE WHEN node_id = 'v' THEN p.captions END AS captions, CASE WHEN node_id = 'v' THEN p.selects END AS selects
    FROM fav f LEFT JOIN packed p USING (doc_id) WHERE text LIKE '*_%')
  SELECT doc_id, '{"format":"json","flatten":true,"namingStyle":"standard","roots":[' || string_agg('{"name":"' || substr(text, 2)
    || '","captions":' || CASE WHEN captions IS NULL THEN '[]' ELSE to_json(captions)::VARCHAR END
    || ',"selects":' || CASE WHEN selects IS NULL THEN '[]' ELSE to_json(selects)::VARCHAR END || '}', ',' ORDER BY node_id = 'N') || ']}' AS json
  FROM roots GROUP BY doc_id""",
)
def _catalog(spark, sf):
    walked = stage(V.favorites_walk(fav_nodes(spark, sf)), "walked")
    return V.view_catalog(V.view_roots(walked), V.view_selects(walked))


_SQL_SAVED = """saved AS (SELECT md5(user_id::VARCHAR) AS doc_hash, ts, event_id::VARCHAR AS id, props AS data FROM events)"""


@register(
    "pick_version",
    "WITH "
    + _SQL_SAVED
    + """, oldest AS (SELECT doc_hash, arg_min(struct_pack(ts, id, data), (ts, id, data)) AS v FROM saved GROUP BY doc_hash),
  rows AS (SELECT o_orderkey AS doc_id, o_orderpriority LIKE '1%' AS dropped,
      coalesce(epoch_ms(v.ts) / 1000.0 > epoch(o_orderdate) + 820000000, false) AS newer, o_orderstatus = 'O' AS bundled, v
    FROM orders LEFT JOIN oldest ON doc_hash = md5(o_custkey::VARCHAR))
  SELECT doc_id, CASE WHEN dropped THEN 'dropped' WHEN newer THEN 'stored' WHEN bundled THEN 'bundled' ELSE 'none' END AS source,
    CASE WHEN dropped THEN 'dropped text' WHEN newer THEN v.data WHEN bundled THEN 'bundled text' END AS data FROM rows""",
)
def _pick(spark, sf):
    versions = table(spark, sf, "events").select(
        F.md5(C("user_id").cast("string")).alias("doc_hash"), "ts",
        C("event_id").cast("string").alias("id"), C("props").alias("data"),
    )
    orders = table(spark, sf, "orders")
    docs = orders.select(
        C("o_orderkey").alias("doc_id"),
        F.md5(C("o_custkey").cast("string")).alias("hash"),
        F.when(C("o_orderstatus") == "O", "bundled text").otherwise("").alias("pfv"),
        (F.unix_seconds(C("o_orderdate").cast("timestamp")) + 820000000).alias("pfv_mtime"),
    )
    dropped = orders.filter(C("o_orderpriority").startswith("1")).select(
        C("o_orderkey").alias("doc_id"), F.lit("dropped text").alias("data")
    )
    return V.pick_version(docs, versions, dropped)


_SQL_SAVES = """saves AS (SELECT user_id AS session, ts, md5(event_type) AS doc_hash, md5(props) AS id, props AS data,
    CASE WHEN value < 20 THEN 0 ELSE 1 END AS entries FROM events)"""


def _saves(spark, sf):
    return table(spark, sf, "events").select(
        C("user_id").alias("session"), "ts", F.md5("event_type").alias("doc_hash"), F.md5("props").alias("id"),
        C("props").alias("data"), F.when(C("value") < 20, 0).otherwise(1).alias("entries"),
    )


@register(
    "recent_versions",
    "WITH "
    + _SQL_SAVES
    + """, begun AS (SELECT session, doc_hash, min(ts) AS t0 FROM saves WHERE entries > 0 GROUP BY ALL),
  stored AS (SELECT saves.*, row_number() OVER (ORDER BY ts, id, session) AS n FROM saves JOIN begun USING (session, doc_hash) WHERE ts >= t0),
  known AS (SELECT *, lag(id) OVER (PARTITION BY doc_hash, session ORDER BY n) AS was FROM stored),
  again AS (SELECT a.n, min(b.n) AS m FROM known a JOIN known b ON a.doc_hash = b.doc_hash AND a.id = b.id AND b.n > a.n GROUP BY a.n),
  taken AS (SELECT a.n, min(b.n) AS m FROM known a JOIN known b ON a.doc_hash = b.doc_hash AND a.id = b.was AND b.id <> b.was AND b.n > a.n GROUP BY a.n),
  lives AS (SELECT known.*, least(again.m, taken.m) AS gone FROM known LEFT JOIN again USING (n) LEFT JOIN taken USING (n)),
  newest AS (SELECT * FROM lives WHERE gone IS NULL ORDER BY n DESC LIMIT 8),
  steps AS (SELECT newest.n AS mine, e.n AS place, 1 AS d FROM newest JOIN lives e ON e.n > newest.n
    UNION ALL SELECT newest.n, e.gone, -1 FROM newest JOIN lives e ON e.n > newest.n WHERE e.gone IS NOT NULL),
  crowd AS (SELECT mine, place, sum(d) AS d FROM steps GROUP BY ALL),
  most AS (SELECT mine, max(c) AS c FROM (SELECT mine, sum(d) OVER (PARTITION BY mine ORDER BY place) AS c FROM crowd) GROUP BY mine)
  SELECT doc_hash, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved, session, data, entries
  FROM newest LEFT JOIN most ON mine = n WHERE coalesce(c, 0) < 8 ORDER BY ts DESC, id""",
)
def _recent(spark, sf):
    return V.recent_versions(_saves(spark, sf)).select(
        "doc_hash", "id", format_ts("ts").alias("saved"), "session", "data", "entries"
    )


@register(
    "recent_list",
    """SELECT event_id::VARCHAR AS id, (user_id % 3)::INTEGER AS entries, event_type = 'click' AS this_document,
        strftime(ts, '%Y-%m-%d %H:%M:%S') AS saved
      FROM events ORDER BY ts DESC, id LIMIT 8""",
)
def _recent_list(spark, sf):
    data = F.concat(F.lit("[AnyFavorites-v1]\n"), F.repeat(F.lit("//a\nx\n"), (C("user_id") % 3).cast("int")))
    versions = table(spark, sf, "events").select(
        C("event_id").cast("string").alias("id"), "ts", C("event_type").alias("doc_hash"), data.alias("data")
    )
    return V.recent_list(versions, "click").select("id", "entries", "this_document", "saved")


_SQL_SPACE = r"[\x09-\x0d \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


@register(
    "bulk_folders",
    rf"""SELECT doc_id, line_no::INTEGER AS line_no, name AS text FROM (SELECT doc_id, line_no - 1 AS line_no,
        regexp_replace(regexp_replace(line, '^{_SQL_SPACE}', ''), '{_SQL_SPACE}$', '') AS name FROM (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM (
          SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents))) WHERE name <> ''""",
)
def _bulk_folders(spark, sf):
    return V.bulk_folders(table(spark, sf, "documents"))


def _renames(lines):
    """Items of the favorites trees; those of discounted lines get a blank new name."""
    return lines.select(
        "doc_id",
        F.concat("flag", F.lit("/"), C("ln").cast("string")).alias("node_id"),
        F.concat("flag", C("ln").cast("string")).alias("sort_path"),
        F.when(C("disc") > 0.05, "").otherwise(F.concat(F.lit("n"), C("qty").cast("string"))).alias("new_text"),
    )


_SQL_RENAMES = """, renames AS (SELECT doc_id, flag || '/' || ln AS node_id, flag || ln AS sort_path,
    CASE WHEN disc > 0.05 THEN '' ELSE 'n' || qty END AS new_text FROM lines),
  numbered AS (SELECT doc_id, node_id, CASE WHEN new_text <> '' THEN new_text WHEN n < 100 THEN right('000' || n, 3) ELSE n::VARCHAR END AS new_text
    FROM (SELECT *, 6 + row_number() OVER (PARTITION BY doc_id, new_text = '' ORDER BY sort_path) AS n FROM renames))"""


@register("auto_number", "WITH " + LINES_SQL + _SQL_RENAMES + "SELECT * FROM numbered")
def _auto(spark, sf):
    return V.auto_number(_renames(order_lines(spark, sf)), start=7, digits=3).drop("sort_path")


def sql_unique(rows: str, columns: str, late: str = "false") -> str:
    """Names made unique among ``rows`` (doc_id, parent_id, ordinal, text, ...): repeats pass the taken numbers below theirs."""
    number = r"(?s)^(.*) ([1-9][0-9]{0,17})$"
    return f""", placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_id, text ORDER BY {late}, ordinal) - 1 AS k FROM {rows}),
  taken AS (SELECT doc_id, parent_id, base AS text, m - row_number() OVER (PARTITION BY doc_id, parent_id, base ORDER BY m) - 1 AS g FROM (
    SELECT DISTINCT doc_id, parent_id, regexp_extract(text, '{number}', 1) AS base, regexp_extract(text, '{number}', 2)::BIGINT AS m
    FROM {rows} WHERE regexp_matches(text, '{number}')) WHERE m > 1),
  passed AS (SELECT p.doc_id, p.parent_id, p.text, k, count(*) AS c FROM placed p JOIN taken t
    ON t.doc_id = p.doc_id AND t.parent_id = p.parent_id AND t.text = p.text AND g < k WHERE k > 0 GROUP BY ALL)
  SELECT {columns}, CASE WHEN k = 0 THEN text ELSE text || ' ' || (k + 1 + coalesce(c, 0)) END AS text
  FROM placed LEFT JOIN passed USING (doc_id, parent_id, text, k)"""


_SQL_RENAMED = """, renamed AS (SELECT f.* REPLACE (coalesce(n.new_text, f.text) AS text), coalesce(n.new_text <> f.text, false) AS moved
    FROM fav f LEFT JOIN numbered n USING (doc_id, node_id))"""


@register("bulk_rename", _F + _SQL_RENAMES + _SQL_RENAMED + sql_unique("renamed", "doc_id, node_id", "moved"))
def _bulk_rename(spark, sf):
    def renamed(lines):
        renames = V.auto_number(_renames(lines), start=7, digits=3)
        return V.bulk_rename(fav_nodes(spark, sf, lines), renames).select("doc_id", "node_id", "text")

    return by_document(order_lines(spark, sf), renamed)


_SQL_SIBLINGS = """WITH siblings AS (SELECT 0::BIGINT AS doc_id, c_nationkey::VARCHAR AS parent_id, c_custkey AS ordinal,
    CASE WHEN c_acctbal < 0 THEN c_mktsegment || ' ' || (2 + c_custkey % 40) ELSE c_mktsegment END AS text FROM customer)"""


def _siblings(spark, sf):
    """Customers of a nation as sibling folders; segments repeat and some carry a number already."""
    numbered = F.concat("c_mktsegment", F.lit(" "), (C("c_custkey") % 40 + 2).cast("string"))
    return table(spark, sf, "customer").select(
        F.lit(0).cast("bigint").alias("doc_id"),
        C("c_nationkey").cast("string").alias("parent_id"),
        C("c_custkey").alias("ordinal"),
        F.when(C("c_acctbal") < 0, numbered).otherwise(C("c_mktsegment")).alias("text"),
    )


@register("unique_names", _SQL_SIBLINGS + sql_unique("siblings", "doc_id, parent_id, ordinal"))
def _unique(spark, sf):
    return V.unique_names(_siblings(spark, sf))


@register(
    "add_folders",
    _SQL_SIBLINGS
    + """, typed AS (SELECT 0::BIGINT AS doc_id, s_nationkey::VARCHAR AS parent_id, s_suppkey::INTEGER AS line_no,
      CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'BUILDING 2' ELSE 'new' END AS text FROM supplier),
  every AS (SELECT *, NULL::INTEGER AS line_no FROM siblings UNION ALL
    SELECT doc_id, parent_id, coalesce(last, -1) + 1 + line_no, text, line_no FROM typed
    LEFT JOIN (SELECT doc_id, parent_id, max(ordinal) AS last FROM siblings GROUP BY ALL) USING (doc_id, parent_id))
  SELECT * FROM ("""
    + "WITH x AS (SELECT 1)"
    + sql_unique("every", "doc_id, parent_id, ordinal, line_no")
    + ") WHERE line_no IS NOT NULL",
)
def _add_folders(spark, sf):
    """Folders typed for a nation, one line a supplier, beside its customers' folders."""
    name = F.when(C("s_suppkey") % 3 == 0, "BUILDING").when(C("s_suppkey") % 3 == 1, "BUILDING 2").otherwise("new")
    lines = table(spark, sf, "supplier").select(
        F.lit(0).cast("bigint").alias("doc_id"), C("s_nationkey").cast("string").alias("parent_id"), C("s_suppkey").alias("line_no"), name.alias("text")
    )
    return V.add_folders(_siblings(spark, sf), lines)


@register(
    "name_views",
    _SQL_VIEWS
    + """SELECT v.doc_id, v.root_id, v.view_index, substr(any_value(t.text), 2) || '_' || string_agg(s.caption || '-' || s.item_name, '_' ORDER BY v.select_ord) AS name
      FROM views v JOIN selects s USING (doc_id, root_id, select_id, item_ord) JOIN fav t ON t.doc_id = v.doc_id AND t.node_id = 'v'
      GROUP BY v.doc_id, v.root_id, v.view_index""",
)
def _name_views(spark, sf):
    def named(lines):
        walked = stage(V.favorites_walk(fav_nodes(spark, sf, lines)).drop("sort_path", "file_path"), "walked")
        selects = stage(V.view_selects(walked), "viewselects")
        roots = V.view_roots(walked).withColumn("root_ord", F.lit(0))
        return V.name_views(roots, selects, V.enumerate_views(selects))

    return by_document(order_lines(spark, sf), named)


@register("export_views")
def _export_views(spark, sf):
    """All views of all orders, drawn once per distinct picture, as numbered tile maps."""
    from lamina.plans.export import export_views

    lines = stage(order_lines(spark, sf), "lines")
    rows = shallow_paths(spark, sf)
    layers = rows.select(
        "doc_id", "seq_id", "parent_seq_id", "ordinal", "folder", "checked", "kind", "path", "parent_path",
        F.when(C("parent_seq_id") == -1, F.array().cast("array<bigint>")).otherwise(F.array("parent_seq_id")).alias("ancestors"),
        F.lit(False).alias("has_mask"),
        F.when(C("folder"), "pass-through").when(C("qty") > 25, "multiply").otherwise("normal").alias("blend_mode"),
        F.lit(255).alias("opacity"), F.lit(False).alias("clipping"), F.lit(True).alias("blend_clipped"),
        F.lit(None).cast("int").alias("mask_default"),
    )
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("x")
    pixels = lines.select("doc_id", (flag_no() * 10 + C("ln")).alias("seq_id"), "ln", "qty", at).select(
        "doc_id", "seq_id", (C("x") + C("ln") * 2).alias("x"), (C("ln") % 3).alias("y"),
        (C("qty") * 5).alias("r"), (C("ln") * 30).alias("g"), F.lit(60).cast("bigint").alias("b"), F.lit(255).cast("bigint").alias("a"),
    )
    masks = pixels.filter("false").select("doc_id", "seq_id", "x", "y", F.lit(0).cast("bigint").alias("m"))
    sizes = lines.select("doc_id").distinct().select(
        "doc_id", F.lit(18).cast("bigint").alias("width"), F.lit(10).cast("bigint").alias("height")
    )
    out = export_views(fav_nodes(spark, sf), layers, stage(pixels, "pixels"), masks, sizes, ("normal", "multiply"))
    return out.mapped

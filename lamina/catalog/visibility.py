"""Queries for states, overlays, filters, clicks and mirrors."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.catalog.registry import register
from lamina.fixtures import DEEP_PATHS_SQL, DEEP_SQL, SHALLOW_SQL, deep_layers, lines_of, order_lines, order_rows, shallow_layers, shallow_paths
from lamina.functions.names import layer_flags
from lamina.operators import bitsets, states, tree
from lamina.session import by_document
from lamina.session import stage_large as stage

C = F.col
_S = "WITH " + SHALLOW_SQL

# one wire text per order: its lines above a quantity, absolute when there are several
_SQL_TEXTS = """, texts AS (
  SELECT doc_id, string_agg(CASE WHEN n > 2 THEN '/' ELSE '' END || path, chr(13) || chr(10) ORDER BY seq_id) AS text
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM shallow WHERE qty > 25) GROUP BY doc_id),
parsed AS (
  SELECT doc_id, path, all_layers, bool_or(NOT all_layers OR path = body) AS checked FROM (
    SELECT doc_id, all_layers, body, unnest([split_part(body, '/', 1), body]) AS path FROM (
      SELECT doc_id, all_layers, CASE WHEN all_layers THEN substr(line, 2) ELSE line END AS body FROM (
        SELECT doc_id, text LIKE '/%' AS all_layers, unnest(string_split(replace(text, chr(13), ''), chr(10))) AS line
        FROM texts))) GROUP BY ALL)"""


def state_texts(spark, sf):
    rows = shallow_paths(spark, sf).filter("qty > 25")
    pairs = F.sort_array(F.collect_list(F.struct("seq_id", "path")))
    mark = F.when(F.size("p") > 2, "/").otherwise("")
    return rows.groupBy("doc_id").agg(pairs.alias("p")).select(
        "doc_id",
        F.array_join(F.transform("p", lambda v: F.concat(mark, v["path"])), "\r\n").alias("text"),
    )


@register("parse_state", _S + _SQL_TEXTS + "SELECT doc_id, path, all_layers, checked FROM parsed")
def _parse(spark, sf):
    return states.parse_state(state_texts(spark, sf)).select("doc_id", "path", "all_layers", "checked")


@register(
    "apply_state",
    _S
    + _SQL_TEXTS
    + """, modes AS (SELECT DISTINCT doc_id, all_layers FROM parsed),
tops AS (SELECT doc_id, parent_seq_id, max(ordinal) AS top FROM shallow WHERE kind = 'radio' GROUP BY ALL),
mixed AS (
  SELECT s.*, m.all_layers, p.checked AS listed, h.path IS NOT NULL AS held, t.top
  FROM shallow s LEFT JOIN parsed p ON p.doc_id = s.doc_id AND p.path = s.path
  LEFT JOIN parsed h ON h.doc_id = s.doc_id AND h.path = s.parent_path
  LEFT JOIN modes m ON m.doc_id = s.doc_id
  LEFT JOIN tops t ON t.doc_id = s.doc_id AND t.parent_seq_id = s.parent_seq_id),
after AS (
  SELECT *, CASE WHEN all_layers IS NULL THEN visible
      WHEN all_layers THEN CASE WHEN listed IS NULL THEN false WHEN listed THEN true
        ELSE kind = 'force' OR (kind = 'radio' AND ordinal = top) END
      WHEN lvl = 1 OR held THEN listed IS NOT NULL ELSE visible END AS on_now,
    CASE WHEN all_layers IS NULL THEN false WHEN all_layers THEN coalesce(listed, false) ELSE lvl = 1 OR held END AS touched
  FROM mixed),
won AS (SELECT doc_id, parent_seq_id, min(ordinal) AS won FROM after WHERE kind = 'radio' AND touched AND on_now GROUP BY ALL)
SELECT a.doc_id, a.seq_id, CASE WHEN a.kind = 'radio' AND w.won IS NOT NULL THEN a.ordinal = w.won ELSE a.on_now END AS checked
FROM after a LEFT JOIN won w USING (doc_id, parent_seq_id)""",
)
def _apply(spark, sf):
    parsed = states.parse_state(state_texts(spark, sf))
    return states.apply_state(shallow_paths(spark, sf), parsed).select("doc_id", "seq_id", "checked")


def listed_paths(rows, condition):
    """Paths of the matching layers with their folders, a folder once for each layer."""
    return rows.filter(condition).select("doc_id", F.explode(F.array("path", "parent_path")).alias("path"))


def closed_paths(rows, condition):
    """Paths of the matching leaves with their folders."""
    return listed_paths(rows, condition).distinct()


def _sql_closed(condition: str) -> str:
    return f"""(SELECT doc_id, path FROM shallow WHERE lvl = 2 AND {condition}
        UNION SELECT doc_id, parent_path FROM shallow WHERE lvl = 2 AND {condition})"""


_SQL_DELTA = f""", inside AS (
  SELECT s.*, o.path IS NOT NULL AS listed FROM shallow s JOIN {_sql_closed("flag <> 'R' AND ln <= 5")} f
    ON f.doc_id = s.doc_id AND f.path = s.path
  LEFT JOIN {_sql_closed('disc >= 0.05')} o ON o.doc_id = s.doc_id AND o.path = s.path
  LEFT JOIN {_sql_closed('disc >= 0.05')} h ON h.doc_id = s.doc_id AND h.path = s.parent_path
  WHERE s.lvl = 1 OR h.path IS NOT NULL),
won AS (SELECT doc_id, parent_seq_id, min(ordinal) AS won FROM inside WHERE kind = 'radio' AND listed GROUP BY ALL)"""


def _sql_overlay(base: str) -> str:
    return (
        _S
        + _SQL_DELTA
        + f"""SELECT s.doc_id, s.seq_id, CASE WHEN s.kind = 'radio' AND w.won IS NOT NULL THEN s.ordinal = w.won
          WHEN i.seq_id IS NOT NULL THEN i.listed ELSE {base} END AS checked
        FROM shallow s LEFT JOIN inside i USING (doc_id, seq_id)
        LEFT JOIN won w ON w.doc_id = s.doc_id AND w.parent_seq_id = s.parent_seq_id"""
    )


def _overlay_inputs(spark, sf):
    rows = shallow_paths(spark, sf)
    overlay = closed_paths(rows, C("disc") >= 0.05)
    allowed = closed_paths(rows, (C("flag") != "R") & (C("ln") <= 5))
    return rows, overlay, allowed


@register("apply_overlay", _sql_overlay("s.visible"))
def _overlay(spark, sf):
    rows, overlay, allowed = _overlay_inputs(spark, sf)
    return states.apply_overlay(rows, overlay, allowed).select("doc_id", "seq_id", "checked")


@register("apply_overlay_solo", _sql_overlay("false"))
def _overlay_solo(spark, sf):
    rows, overlay, allowed = _overlay_inputs(spark, sf)
    return states.apply_overlay(rows, overlay, allowed, base="").select("doc_id", "seq_id", "checked")


_SQL_FILTERS = f""", l1 AS {_sql_closed("flag <> 'R' OR ln <> 2")}, l2 AS {_sql_closed('qty > 10')},
  own AS {_sql_closed('disc >= 0.03')},
  eff AS (SELECT s.*, (a.path IS NOT NULL OR s.doc_id NOT IN (SELECT doc_id FROM l1))
      AND (b.path IS NOT NULL OR s.doc_id NOT IN (SELECT doc_id FROM l2)) AS enabled,
      (o.path IS NOT NULL OR s.doc_id NOT IN (SELECT doc_id FROM own)) AS chosen
    FROM shallow s LEFT JOIN l1 a ON a.doc_id = s.doc_id AND a.path = s.path
    LEFT JOIN l2 b ON b.doc_id = s.doc_id AND b.path = s.path LEFT JOIN own o ON o.doc_id = s.doc_id AND o.path = s.path)"""


def _effective(spark, sf, lines=None):
    rows = shallow_paths(spark, sf, lines)
    outer = listed_paths(rows, (C("flag") != "R") | (C("ln") != 2)).withColumn("level", F.lit(1))
    nested = listed_paths(rows, C("qty") > 10).withColumn("level", F.lit(2))
    return states.filter_effective(rows, outer.unionByName(nested), listed_paths(rows, C("disc") >= 0.03))


@register(
    "filter_effective",
    _S + _SQL_FILTERS + "SELECT doc_id, seq_id, enabled, enabled AND chosen AS selected FROM eff",
)
def _filter_effective(spark, sf):
    return _effective(spark, sf).select("doc_id", "seq_id", "enabled", "selected")


@register(
    "filter_lines",
    _S
    + _SQL_FILTERS
    + """, part AS (SELECT doc_id FROM eff WHERE enabled AND NOT chosen),
  sel AS (SELECT e.* FROM eff e LEFT JOIN eff f ON f.doc_id = e.doc_id AND f.seq_id = e.parent_seq_id
    WHERE e.enabled AND e.chosen AND (e.lvl = 1 OR (f.enabled AND f.chosen)) AND e.doc_id IN (SELECT doc_id FROM part))
SELECT doc_id, seq_id, path FROM sel x WHERE NOT EXISTS
  (SELECT 1 FROM sel y WHERE y.doc_id = x.doc_id AND y.parent_seq_id = x.seq_id)""",
)
def _filter_lines(spark, sf):
    return by_document(order_lines(spark, sf), lambda lines: states.filter_lines(_effective(spark, sf, lines)))


@register(
    "merge_states",
    _S + f"SELECT * FROM {_sql_closed('qty > 25')} UNION SELECT * FROM {_sql_closed('disc >= 0.05')}",
)
def _merge(spark, sf):
    rows = shallow_paths(spark, sf)
    return states.merge_states(closed_paths(rows, C("qty") > 25), closed_paths(rows, C("disc") >= 0.05))


@register(
    "filter_intersection",
    _S + f"SELECT * FROM {_sql_closed('qty > 25')} INTERSECT SELECT * FROM {_sql_closed('disc >= 0.05')}",
)
def _intersect(spark, sf):
    rows = shallow_paths(spark, sf)
    return states.filter_intersection(closed_paths(rows, C("qty") > 25), closed_paths(rows, C("disc") >= 0.05))


@register(
    "hidden_by_filter",
    _S
    + f"SELECT doc_id, seq_id, path FROM shallow WHERE (doc_id, path) NOT IN (SELECT (doc_id, path) FROM {_sql_closed('qty > 25')})",
)
def _hidden(spark, sf):
    rows = shallow_paths(spark, sf)
    return states.hidden_by_filter(rows, closed_paths(rows, C("qty") > 25)).select("doc_id", "seq_id", "path")


# -- three states, overlays and filters a document -------------------------------------------------


def _pick(one: str, two: str, three: str) -> str:
    return f"CASE state_id WHEN 1 THEN {one} WHEN 2 THEN {two} ELSE {three} END"


_LISTED = _pick("qty > 25", "disc >= 0.05", "ln % 2 = 1 AND qty > 10")
_ALLOWED = _pick("flag <> 'R' AND ln <= 5", "qty > 10", "ln >= 2")
_OUTER = _pick("flag <> 'R' OR ln <> 2", "ln < 6", "qty > 2")
_THREE = "shallow JOIN (SELECT unnest([1, 2, 3]) AS state_id) ON lvl = 2"


def _numbered(spark, sf, lines=None):
    return bitsets.number_layers(shallow_paths(spark, sf, lines).drop("name", "folder"), staged=True)


def _each_document(spark, sf, run):
    """``run`` over the numbered layers of documents in buckets."""
    return by_document(order_lines(spark, sf), lambda lines: run(_numbered(spark, sf, lines)))


def _leaves(numbered, condition: str):
    """Leaves that a condition on the state picks, for three states."""
    return numbered.filter("ln is not null").withColumn("state_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)]))).filter(condition)


def _closed_sets(numbered, condition: str):
    rows = _leaves(numbered, condition)
    return rows.select("doc_id", "state_id", "path").union(rows.select("doc_id", "state_id", "parent_path").distinct())


def _listed_sets(numbered, condition: str):
    """The same, a folder once for each layer."""
    return _leaves(numbered, condition).select("doc_id", "state_id", F.explode(F.array("path", "parent_path")).alias("path"))


def _sql_sets(condition: str) -> str:
    return f"""(SELECT doc_id, state_id, path FROM {_THREE} WHERE {condition}
        UNION SELECT doc_id, state_id, parent_path FROM {_THREE} WHERE {condition})"""


def _state_sets(numbered, condition: str):
    """Bits of the closed path sets."""
    return bitsets.to_bits(bitsets.find_layers(_closed_sets(numbered, condition), numbered), bitsets.STATE)


def _listed_layers(numbered, bits):
    places = bitsets.to_places(bits, bitsets.STATE)
    return places.join(numbered.select("doc_id", "pos", "seq_id"), ["doc_id", "pos"]).drop("pos")


def _parsed_states(numbered):
    pairs = F.sort_array(F.collect_list(F.struct("seq_id", "path")))
    mark = F.when(F.size("p") > 2, "/").otherwise("")
    texts = _leaves(numbered, _LISTED).groupBy("doc_id", "state_id").agg(pairs.alias("p")).select(
        "doc_id", "state_id", F.array_join(F.transform("p", lambda v: F.concat(mark, v["path"])), "\r\n").alias("text")
    )
    return states.parse_state(texts, keys=bitsets.STATE)


@register(
    "apply_states",
    _S
    + f""", picked AS (SELECT *, count(*) OVER (PARTITION BY doc_id, state_id) AS n FROM {_THREE} WHERE {_LISTED}),
parsed AS (
  SELECT doc_id, state_id, path, true AS checked, n > 2 AS all_layers FROM picked
  UNION SELECT doc_id, state_id, parent_path, n <= 2, n > 2 FROM picked),
modes AS (SELECT DISTINCT doc_id, state_id, all_layers FROM parsed),
tops AS (SELECT doc_id, parent_seq_id, max(ordinal) AS top FROM shallow WHERE kind = 'radio' GROUP BY ALL),
mixed AS (
  SELECT s.*, m.state_id, m.all_layers, p.checked AS listed, h.path IS NOT NULL AS held, t.top
  FROM shallow s JOIN modes m USING (doc_id)
  LEFT JOIN parsed p ON p.doc_id = s.doc_id AND p.state_id = m.state_id AND p.path = s.path
  LEFT JOIN parsed h ON h.doc_id = s.doc_id AND h.state_id = m.state_id AND h.path = s.parent_path
  LEFT JOIN tops t ON t.doc_id = s.doc_id AND t.parent_seq_id = s.parent_seq_id),
after AS (
  SELECT *, CASE WHEN all_layers THEN CASE WHEN listed IS NULL THEN false WHEN listed THEN true
        ELSE kind = 'force' OR (kind = 'radio' AND ordinal = top) END
      WHEN lvl = 1 OR held THEN listed IS NOT NULL ELSE visible END AS on_now,
    CASE WHEN all_layers THEN coalesce(listed, false) ELSE lvl = 1 OR held END AS touched
  FROM mixed),
won AS (SELECT doc_id, state_id, parent_seq_id, min(ordinal) AS won FROM after WHERE kind = 'radio' AND touched AND on_now GROUP BY ALL)
SELECT a.doc_id, a.state_id, a.seq_id, CASE WHEN a.kind = 'radio' AND w.won IS NOT NULL THEN a.ordinal = w.won ELSE a.on_now END AS checked
FROM after a LEFT JOIN won w USING (doc_id, state_id, parent_seq_id)""",
)
def _apply_states(spark, sf):
    def applied(numbered):
        bits = bitsets.apply_states(numbered, _parsed_states(numbered))
        return bitsets.flags(numbered, bits, bitsets.STATE, checked="bits")

    return _each_document(spark, sf, applied)


def _sql_overlays(base: str) -> str:
    return (
        _S
        + f""", allowed AS {_sql_sets(_ALLOWED)}, listed AS {_sql_sets(_LISTED)},
  inside AS (
  SELECT s.*, f.state_id, o.path IS NOT NULL AS listed FROM shallow s JOIN allowed f ON f.doc_id = s.doc_id AND f.path = s.path
  LEFT JOIN listed o ON o.doc_id = s.doc_id AND o.state_id = f.state_id AND o.path = s.path
  LEFT JOIN listed h ON h.doc_id = s.doc_id AND h.state_id = f.state_id AND h.path = s.parent_path
  WHERE s.lvl = 1 OR h.path IS NOT NULL),
won AS (SELECT doc_id, state_id, parent_seq_id, min(ordinal) AS won FROM inside WHERE kind = 'radio' AND listed GROUP BY ALL)
SELECT s.doc_id, m.state_id, s.seq_id, CASE WHEN s.kind = 'radio' AND w.won IS NOT NULL THEN s.ordinal = w.won
    WHEN i.seq_id IS NOT NULL THEN i.listed ELSE {base} END AS checked
  FROM shallow s JOIN (SELECT DISTINCT doc_id, state_id FROM allowed) m USING (doc_id)
  LEFT JOIN inside i ON i.doc_id = s.doc_id AND i.state_id = m.state_id AND i.seq_id = s.seq_id
  LEFT JOIN won w ON w.doc_id = s.doc_id AND w.state_id = m.state_id AND w.parent_seq_id = s.parent_seq_id"""
    )


def _overlays(spark, sf, base):
    def overlaid(numbered):
        listed, allowed = _closed_sets(numbered, _LISTED), _closed_sets(numbered, _ALLOWED)
        return bitsets.flags(numbered, bitsets.apply_overlays(numbered, listed, allowed, base), bitsets.STATE, checked="bits")

    return _each_document(spark, sf, overlaid)


@register("apply_overlays", _sql_overlays("s.visible"))
def _apply_overlays(spark, sf):
    return _overlays(spark, sf, None)


@register("apply_overlays_solo", _sql_overlays("false"))
def _apply_overlays_solo(spark, sf):
    return _overlays(spark, sf, "")


# the second filter has one ancestor, the others two; the third has no set of its own
_SQL_EFFECTIVE = (
    _S
    + f""", l1 AS {_sql_sets(_OUTER)}, l2 AS {_sql_sets(f"state_id <> 2 AND {_ALLOWED}")}, own AS {_sql_sets(f"state_id <> 3 AND {_LISTED}")},
  eff AS (SELECT s.doc_id, k.state_id, s.seq_id, s.parent_seq_id, s.path, s.lvl,
      (a.path IS NOT NULL OR (s.doc_id, k.state_id) NOT IN (SELECT (doc_id, state_id) FROM l1))
        AND (b.path IS NOT NULL OR (s.doc_id, k.state_id) NOT IN (SELECT (doc_id, state_id) FROM l2)) AS enabled,
      (o.path IS NOT NULL OR (s.doc_id, k.state_id) NOT IN (SELECT (doc_id, state_id) FROM own)) AS chosen
    FROM shallow s, (SELECT unnest([1, 2, 3]) AS state_id) k
    LEFT JOIN l1 a ON a.doc_id = s.doc_id AND a.state_id = k.state_id AND a.path = s.path
    LEFT JOIN l2 b ON b.doc_id = s.doc_id AND b.state_id = k.state_id AND b.path = s.path
    LEFT JOIN own o ON o.doc_id = s.doc_id AND o.state_id = k.state_id AND o.path = s.path)"""
)


def _effective_many(numbered):
    owners = numbered.select("doc_id").distinct().withColumn("state_id", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    outer = _listed_sets(numbered, _OUTER).withColumn("level", F.lit(1)).unionByName(
        _listed_sets(numbered, f"state_id <> 2 AND {_ALLOWED}").withColumn("level", F.lit(2))
    )
    return bitsets.filters_effective(numbered, owners, outer, _listed_sets(numbered, f"state_id <> 3 AND {_LISTED}"))


@register("filters_effective", _SQL_EFFECTIVE + "SELECT doc_id, state_id, seq_id, enabled, enabled AND chosen AS selected FROM eff")
def _filters_effective(spark, sf):
    def effective(numbered):
        return bitsets.flags(numbered, _effective_many(numbered), bitsets.STATE, enabled="enabled", selected="selected")

    return _each_document(spark, sf, effective)


@register(
    "filters_lines",
    _SQL_EFFECTIVE
    + """, part AS (SELECT DISTINCT doc_id, state_id FROM eff WHERE enabled AND NOT chosen),
  sel AS (SELECT e.* FROM eff e JOIN part USING (doc_id, state_id)
    LEFT JOIN eff f ON f.doc_id = e.doc_id AND f.state_id = e.state_id AND f.seq_id = e.parent_seq_id
    WHERE e.enabled AND e.chosen AND (e.lvl = 1 OR (f.enabled AND f.chosen)))
SELECT x.doc_id, x.state_id, x.seq_id, x.path FROM sel x ANTI JOIN sel y
  ON y.doc_id = x.doc_id AND y.state_id = x.state_id AND y.parent_seq_id = x.seq_id""",
)
def _filters_lines(spark, sf):
    return _each_document(spark, sf, lambda numbered: bitsets.filters_lines(numbered, stage(_effective_many(numbered), "effective")))


_SQL_LAYER = "SELECT doc_id, state_id, seq_id FROM ({}) JOIN shallow USING (doc_id, path)"


@register("merge_state_sets", _S + _SQL_LAYER.format(f"SELECT * FROM {_sql_sets(_LISTED)} UNION SELECT * FROM {_sql_sets(_ALLOWED)}"))
def _merge_sets(spark, sf):
    def merged(numbered):
        return _listed_layers(numbered, bitsets.union(_state_sets(numbered, _LISTED), _state_sets(numbered, _ALLOWED)))

    return _each_document(spark, sf, merged)


@register("intersect_filter_sets", _S + _SQL_LAYER.format(f"SELECT * FROM {_sql_sets(_LISTED)} INTERSECT SELECT * FROM {_sql_sets(_ALLOWED)}"))
def _intersect_sets(spark, sf):
    def common(numbered):
        return _listed_layers(numbered, bitsets.intersection(_state_sets(numbered, _LISTED), _state_sets(numbered, _ALLOWED)))

    return _each_document(spark, sf, common)


@register(
    "hidden_by_filter_sets",
    _S
    + f""", sets AS {_sql_sets(_ALLOWED)}
  SELECT s.doc_id, m.state_id, s.seq_id FROM shallow s JOIN (SELECT DISTINCT doc_id, state_id FROM sets) m USING (doc_id)
  ANTI JOIN sets x ON x.doc_id = s.doc_id AND x.state_id = m.state_id AND x.path = s.path""",
)
def _hidden_sets(spark, sf):
    numbered = _numbered(spark, sf)
    return _listed_layers(numbered, bitsets.hidden(_state_sets(numbered, _ALLOWED), numbered))


def _clicks(rows):
    """Clicks of ``order_rows``."""
    flag = F.when(C("l_returnflag") == "A", 1).when(C("l_returnflag") == "N", 2).otherwise(3).cast("bigint")
    return rows.select(
        "doc_id",
        (flag * 10 + C("l_linenumber")).alias("seq_id"),
        flag.alias("folder_seq"),
        (C("l_partkey") * 100000000 + C("l_suppkey") * 10000 + C("l_extendedprice").cast("bigint") % 10000).alias("click_seq"),
        ((C("l_returnflag") == "A") | (C("l_linestatus") == "F")).alias("on"),
        ((C("l_returnflag") == "N") & (C("l_quantity") > 25)).alias("solo"),
        C("l_linenumber").alias("ln"),
    )


_SQL_CLICKS = """, clicks AS (SELECT l_orderkey AS doc_id,
    (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END * 10 + l_linenumber)::BIGINT AS seq_id,
    (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)::BIGINT AS folder_seq,
    l_partkey * 100000000 + l_suppkey * 10000 + trunc(l_extendedprice)::BIGINT % 10000 AS click_seq,
    l_returnflag = 'A' OR l_linestatus = 'F' AS is_on, l_returnflag = 'N' AND l_quantity > 25 AS solo, l_linenumber AS ln
  FROM lineitem)"""


@register(
    "apply_toggles",
    _S
    + _SQL_CLICKS
    + """, sets AS (
  SELECT doc_id, seq_id, click_seq, 1 AS step, is_on FROM clicks
  UNION ALL SELECT doc_id, folder_seq, click_seq, 2, true FROM clicks
  UNION ALL SELECT c.doc_id, s.seq_id, c.click_seq, 0, false FROM clicks c JOIN shallow me USING (doc_id, seq_id)
    JOIN shallow s ON s.doc_id = c.doc_id AND s.parent_seq_id = me.parent_seq_id AND s.seq_id <> c.seq_id AND s.kind = 'plain'
    WHERE c.solo AND me.kind <> 'radio'),
last AS (SELECT doc_id, seq_id, arg_max(is_on, click_seq * 10 + step) AS is_on FROM sets GROUP BY ALL),
won AS (SELECT doc_id, s.parent_seq_id, arg_max(seq_id, click_seq * 10 + step) AS won FROM sets JOIN shallow s USING (doc_id, seq_id)
  WHERE kind = 'radio' AND is_on GROUP BY ALL)
SELECT s.doc_id, s.seq_id, CASE WHEN s.kind = 'radio' AND w.won IS NOT NULL THEN coalesce(l.is_on, s.visible) AND s.seq_id = w.won
  ELSE coalesce(l.is_on, s.visible) END AS checked
FROM shallow s LEFT JOIN last l USING (doc_id, seq_id) LEFT JOIN won w ON w.doc_id = s.doc_id AND w.parent_seq_id = s.parent_seq_id""",
)
def _toggles(spark, sf):
    def toggled(rows):
        layers = shallow_paths(spark, sf, lines_of(rows)).withColumn("clipping", F.lit(False))
        return states.apply_toggles(layers, _clicks(rows).drop("folder_seq", "ln")).select("doc_id", "seq_id", "checked")

    return by_document(order_rows(spark, sf), toggled)


_SQL_FILTER_CLICKS = _SQL_CLICKS + """, fclicks AS (SELECT doc_id, CASE WHEN ln = 1 THEN folder_seq ELSE seq_id END AS seq_id, click_seq,
    is_on FROM clicks),
  fsets AS (SELECT * FROM fclicks
    UNION ALL SELECT c.doc_id, s.seq_id, click_seq, is_on FROM fclicks c JOIN shallow s ON s.doc_id = c.doc_id AND s.parent_seq_id = c.seq_id
    UNION ALL SELECT c.doc_id, s.parent_seq_id, click_seq, true FROM fclicks c JOIN shallow s USING (doc_id, seq_id)
      WHERE c.is_on AND s.parent_seq_id <> -1),
  flast AS (SELECT doc_id, seq_id, arg_max(is_on, click_seq) AS is_on FROM fsets GROUP BY ALL),
  fnow AS (SELECT s.doc_id, s.seq_id, coalesce(l.is_on, true) AS checked FROM shallow s LEFT JOIN flast l USING (doc_id, seq_id))"""


def _filter_toggled(spark, sf):
    layers = shallow_layers(spark, sf).select("doc_id", "seq_id", "parent_seq_id", "ordinal", F.lit(True).alias("checked"))
    clicks = _clicks(order_rows(spark, sf)).withColumn("seq_id", F.when(C("ln") == 1, C("folder_seq")).otherwise(C("seq_id")))
    return states.apply_filter_toggles(layers, clicks)


@register("apply_filter_toggles", _S + _SQL_FILTER_CLICKS + "SELECT doc_id, seq_id, checked FROM fnow")
def _filter_toggles(spark, sf):
    return _filter_toggled(spark, sf).select("doc_id", "seq_id", "checked")


@register(
    "filter_kind",
    _S
    + _SQL_FILTER_CLICKS
    + """SELECT doc_id, CASE WHEN bool_and(checked) OR NOT bool_or(checked) THEN 'folder' ELSE 'filter' END AS type
      FROM fnow GROUP BY doc_id""",
)
def _filter_kind(spark, sf):
    return states.filter_kind(_filter_toggled(spark, sf))


def _kinded(spark, sf):
    layers = deep_layers(spark, sf)
    variants = tree.flip_pairs(layers).select("doc_id", F.col("flipped").alias("seq_id")).distinct()
    flags = layer_flags("name")
    return (
        layers.withColumn("kind", flags["kind"])
        .withColumn("display", flags["display"])
        .join(variants.withColumn("__v", F.lit(True)), ["doc_id", "seq_id"], "left")
        .withColumn("is_flip_variant", F.coalesce("__v", F.lit(False)))
        .drop("__v")
    )


def _targets(spark, sf):
    """The newest customer of every nation."""
    return deep_layers(spark, sf).filter(F.col("folder") & (F.col("parent_seq_id") != -1)).groupBy(
        "doc_id", "parent_seq_id"
    ).agg(F.max("seq_id").alias("seq_id")).select("doc_id", "seq_id")


_SQL_TARGETS = """, kinded AS (SELECT *, name LIKE '*%' AS radio,
    regexp_replace(regexp_replace(name, '^[*!]', ''), ':flipx$', '') AS display FROM deep),
  variants AS (SELECT v.doc_id, v.seq_id FROM deep v WHERE name LIKE '%:flipx' AND EXISTS (SELECT 1 FROM deep o
    WHERE o.doc_id = v.doc_id AND o.parent_seq_id = v.parent_seq_id AND o.name || ':flipx' = v.name)),
  targets AS (SELECT doc_id, max(seq_id) AS target, parent_seq_id FROM deep WHERE lvl = 2 GROUP BY doc_id, parent_seq_id),
  peers AS (SELECT t.doc_id, t.target, t.parent_seq_id, p.radio, p.seq_id, p.display, p.ordinal FROM targets t
    JOIN kinded me ON me.doc_id = t.doc_id AND me.seq_id = t.target
    JOIN kinded p ON p.doc_id = t.doc_id AND p.parent_seq_id = t.parent_seq_id AND p.radio = me.radio)"""


@register(
    "expand_siblings",
    "WITH "
    + DEEP_SQL
    + _SQL_TARGETS
    + """SELECT doc_id, parent_seq_id, radio, seq_id AS chosen, display AS "view" FROM peers
      WHERE (doc_id, seq_id) NOT IN (SELECT (doc_id, seq_id) FROM variants)""",
)
def _expand(spark, sf):
    return states.expand_siblings(_kinded(spark, sf), _targets(spark, sf)).drop("ordinal")


@register(
    "siblings_filter",
    DEEP_PATHS_SQL
    + _SQL_TARGETS
    + """SELECT t.doc_id, t.parent_seq_id, k.radio, c.ancestor_seq_id AS seq_id FROM targets t
        JOIN kinded k ON k.doc_id = t.doc_id AND k.seq_id = t.target JOIN closure c ON c.doc_id = t.doc_id AND c.seq_id = t.target
      UNION SELECT p.doc_id, p.parent_seq_id, p.radio, c.seq_id FROM peers p JOIN closure c
        ON c.doc_id = p.doc_id AND c.ancestor_seq_id = p.seq_id""",
)
def _siblings_filter(spark, sf):
    return states.siblings_filter(_kinded(spark, sf), _targets(spark, sf))


@register("apply_flip")
def _flip(spark, sf):
    paths = tree.tree_paths(deep_layers(spark, sf)).withColumn("checked", F.col("visible"))
    return states.apply_flip(paths, tree.flip_pairs(deep_layers(spark, sf)), "flipx").select(
        "doc_id", "seq_id", "checked"
    )

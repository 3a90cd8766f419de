"""Queries whose documents go through buckets: right rows, no shuffle after the tables lie there."""

import duckdb
import pytest
from parity import compare
from test_buckets import plan

from lamina import session
from lamina.catalog import ORACLES, QUERIES

LINES = """l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_quantity double, l_discount double,
    l_partkey long, l_suppkey long, l_extendedprice double"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rows = [
        (doc, ln, "ANR"[(doc * 7 + ln * ln) % 3], "FO"[(doc + ln) % 2], float((doc * 13 + ln * 17) % 50 + 1), (doc + ln * 3) % 11 / 100,
         doc * 10 + ln, ln % 4, 100.0 * ln + doc)
        for doc in range(1, 60) for ln in range(1, doc % 7 + 2)
    ]
    spark.createDataFrame(rows, LINES).write.parquet(f"{out}/lineitem.parquet")
    orders = [(doc, f"{doc % 5 + 1}-PRIORITY", "PFO"[doc % 3]) for doc in range(1, 62)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{out}/orders.parquet")
    return str(out)


@pytest.fixture
def staged(monkeypatch):
    """(label, plan) of each table that is written in buckets; the first ones are shuffled into them after that."""
    seen, write = [], session._stage_buckets

    def record(df, path, *rest):
        seen.append((path.rsplit("/", 1)[1].rsplit("-", 1)[0], plan(df)))
        return write(df, path, *rest)

    monkeypatch.setattr(session, "_stage_buckets", record)
    monkeypatch.setattr(session, "SLIM_BUCKET", 32)
    return seen


def shuffled(staged):
    return [label for label, p in staged if "Exchange hashpartitioning" in p]


NAMES = """apply_toggles filters_effective filters_lines apply_overlays apply_overlays_solo apply_states merge_state_sets
    intersect_filter_sets filter_lines bulk_rename name_views distinct_pictures render_key""".split()


@pytest.mark.parametrize("name", NAMES)
def test_documents_stay_in_buckets(spark, tables, staged, name):
    con = duckdb.connect()
    for table in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet/*.parquet'")
    assert compare(spark, con, tables, name, QUERIES[name], ORACLES[name]) is None
    # favorites meet orders, which lie elsewhere
    assert len(staged) > 3 and [label for label in shuffled(staged) if label != "favnodes"] == []
    assert [label for label, p in staged if "ShuffledHashJoin" in p]


def test_pictures_are_told_apart_and_drawn_in_buckets(spark, tables, staged):
    out = QUERIES["export_views"](spark, tables)
    assert out.count() == out.select("image_id", "tx", "ty").distinct().count() > 0
    assert {"pictureviews", "raster", "lifted"} <= {label for label, _ in staged}
    assert shuffled(staged) == []


def test_several_tables_by_document(spark):
    one = spark.createDataFrame([(d, k) for d in (1, 2, 3, None) for k in range(4)] + [(9, k) for k in range(30)], "doc_id long, k long")
    two = spark.createDataFrame([(d, k % 3) for d in (1, 2, 9) for k in range(6)], "doc_id long, k long")
    seen = []

    def run(a, b):
        seen.append((session.bucketed() > 0, {r.doc_id for r in a.select("doc_id").distinct().collect()}))
        return [a.join(b, ["doc_id", "k"], "left_semi"), a.groupBy("doc_id").count()]

    met, counts = session.tables_by_document([one, two], run, most=20)
    assert seen == [(True, {1, 2, 3, None}), (False, {9})]
    assert sorted(map(tuple, met.collect())) == [(d, k) for d in (1, 2, 9) for k in range(3)]
    assert {tuple(r) for r in counts.collect()} == {(1, 4), (2, 4), (3, 4), (None, 4), (9, 30)}

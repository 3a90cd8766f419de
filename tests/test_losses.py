"""Rows that were once lost or altered without a word: each case is kept, counted or refused."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import names as N
from lamina.operators import pixels as P
from lamina.operators import tiles as T
from lamina.operators import tree
from lamina.operators import views as V
from lamina.sources import favorites as S
from lamina.sources import tile_maps as M
from lamina.streaming import rings

SELECTS = "doc_id long, root_id string, select_id string, select_ord long, item_ord long, size long"


def test_numbers_longer_than_the_padding_stay_whole(spark):
    rows = [(1, f"n{k}", f"{k:02d}", "") for k in range(12)] + [(1, "kept", "99", "own")]
    got = V.auto_number(spark.createDataFrame(rows, "doc_id long, node_id string, sort_path string, new_text string"), 995, 3)
    assert sorted(r.new_text for r in got.collect()) == sorted([*(str(995 + k) for k in range(12)), "own"])
    assert spark.range(1).select(N.sequence_name(F.lit("a"), F.lit(123456)).alias("n")).first().n == "a123456"


def _selects(spark, sizes):
    rows = [(1, "r", f"s{k}", k, 0, n) for k, n in enumerate(sizes)]
    return spark.createDataFrame(rows, SELECTS)


@pytest.mark.parametrize("sizes, views", [([3] * 35, 3**35), ([100] * 12, 10**24), ([10] * 40, None)])
def test_view_counts_are_exact(spark, sizes, views):
    selects = _selects(spark, sizes)
    assert [r.views for r in V.count_views(selects).collect()] == [views]
    assert V.too_many_views(selects).count() == (views is None or views >= 2**63)


def test_roots_beyond_the_index_are_reported_not_numbered(spark):
    assert V.enumerate_views(_selects(spark, [100] * 12)).count() == 0
    assert V.enumerate_views(_selects(spark, [3, 1, 2])).count() == 18


def test_missing_tiles_are_an_error(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 1, "b")], "image_id long, tx long, ty long, hash string")
    gids = spark.createDataFrame([("a", 2, 7)], "hash string, uses long, gid long")
    assert [r.hash for r in T.unmapped_cells(cells, gids).collect()] == ["b"]
    with pytest.raises(Exception, match="no hash in the dictionary: b"):
        T.map_cells(cells, gids).collect()


def test_children_of_any_row_are_walked_and_lost_rows_named(spark):
    rows = [(1, 0, -1, 0, "top", False), (1, 1, 0, 0, "child", False), (1, 2, 9, 0, "orphan", False), (1, 3, 2, 0, "below", False),
            (1, 4, 5, 0, "loop", True), (1, 5, 4, 0, "loop", True)]
    layers = spark.createDataFrame(rows, "doc_id long, seq_id long, parent_seq_id long, ordinal long, name string, folder boolean")
    reached = tree.ancestor_lists(layers)
    assert {r.seq_id for r in reached.collect()} == {0, 1}
    lost = {r.seq_id: r.reason for r in tree.lost_nodes(layers, reached).collect()}
    assert lost == {2: "orphan", 3: "below a lost row", 4: "below a lost row", 5: "below a lost row"}


def test_malformed_and_unknown_sections_are_rejected(spark):
    text = "[AnyFavorites-v1]\n//a/%zz/b\nx\n//c~weird\ny\n//d/e\nz\n"
    files = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert {(r.path, r.type) for r in S.scan_favorites(files).collect()} == {("d", "folder"), ("d/e", "item")}
    assert {(r.name, r.reason) for r in S.rejected_sections(files).collect()} == {
        ("a/%zz/b", "malformed name"),
        ("c", "unknown type"),
    }


def test_unlisted_modes_are_refused(spark):
    rows = [(1, 0, 0, k, mode, 255, 10, 20, 30, 255) for k, mode in enumerate(["normal", "screen"])]
    px = spark.createDataFrame(rows, "doc_id long, x long, y long, z long, mode string, opacity long, r long, g long, b long, a long")
    assert P.compose_pixels(px, modes=("normal", "screen")).count() == 1
    with pytest.raises(Exception, match="blend mode not listed: screen"):
        P.compose_pixels(px, modes=("normal", "multiply")).collect()


def test_maps_stay_with_their_images(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"a":\n1}'), (2, "{}")], "image_id long, json string")
    M.write_tile_maps(docs, str(tmp_path / "maps"))
    back = M.read_tile_maps(spark, str(tmp_path / "maps"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))


def _plain_ring(saves, keep):
    return sorted(rings.replay([], {}, [(ts, s, d, i, e) for s, ts, d, i, e in sorted(saves, key=lambda v: (v[1], v[3], v[0]))], keep))


@pytest.mark.parametrize("seed", range(4))
def test_versions_follow_the_saves(spark, seed):
    rng = random.Random(seed)
    n = [3, 40, 120, 200][seed]
    saves = [(rng.choice("AB" if seed < 2 else "ABCDEFGHIJKLMNOP"), t, rng.choice("de"), rng.choice("uvwxyz"), int(rng.random() < 0.8)) for t in range(n)]
    if seed == 0:
        saves = [("A", 1, "d", "X", 1), ("B", 2, "d", "X", 1), ("B", 3, "d", "Y", 1)]
    df = spark.createDataFrame(saves, "session string, ts long, doc_hash string, id string, entries int").withColumn("data", F.col("id"))
    got = sorted((r.ts, r.session, r.doc_hash, r.id) for r in V.recent_versions(df, keep=4).collect())
    assert got == _plain_ring(saves, 4)
    if seed == 0:
        assert [v[3] for v in got] == ["Y"]


def test_the_ring_does_not_depend_on_batches():
    rng = random.Random(3)
    saves = [(t, rng.randrange(6), "d", rng.choice("uvwxyz"), 1) for t in range(60)]
    whole = rings.replay([], {}, saves, 4)
    for cut in (1, 7, 59):
        last, ring = {}, []
        for part in itertools.batched(saves, cut):
            ring = rings.replay(ring, last, part, 4)
        assert ring == whole

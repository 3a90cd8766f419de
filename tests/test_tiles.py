"""Tiles: round trip, blanks, sheet limits, hot tiles; and the streams."""

import datetime as dt
import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lamina.operators import tiles as T
from lamina.sources import assets as A
from lamina.sources import tile_maps as M
from lamina.streaming import changes, rings

PX = "image_id long, x long, y long, r long, g long, b long, a long"


def test_round_trip_with_hot_blank_tile(spark):
    rng = random.Random(2)
    data, sizes = [], []
    for image in range(12):
        w, h = rng.randint(1, 60), rng.randint(1, 60)
        sizes.append((image, w, h))
        data += [(image, x, y, rng.randint(0, 255), 1, 2, 255) for x in range(w) for y in range(h) if rng.random() < 0.02]
    px = spark.createDataFrame(data, PX)
    size = spark.createDataFrame(sizes, "image_id long, width long, height long")
    cells = T.chop(px, size).cache()
    assert cells.count() == sum(-(-w // 16) * -(-h // 16) for _, w, h in sizes)
    tiles = T.tile_dictionary(cells).cache()
    packed = T.pack_sheets(T.assign_gids(tiles))
    mapped = T.map_cells(cells, packed)
    assert mapped.count() == cells.count() and T.unmapped_cells(cells, packed).count() == 0
    back = T.rebuild_images(mapped, T.tile_sheets(packed), packed, tiles, size)
    assert back.count() == sum(w * h for _, w, h in sizes)
    key = lambda df: sorted(map(tuple, df.filter("a > 0").select("image_id", "x", "y", "r", "g", "b", "a").collect()))
    assert key(back) == key(px)
    lines = T.rebuild_lines(T.rebuild_cells(mapped, T.tile_sheets(packed), packed, tiles, size)).collect()
    assert sorted((r.image_id, r.y) for r in lines) == [(i, y) for i, _, h in sizes for y in range(h)]
    drawn = {(r[0], r[1], r[2]): r[3:] for r in data}
    for r in lines:
        width = sizes[r.image_id][1]
        assert bytes(r.line) == b"".join(bytes(drawn.get((r.image_id, x, r.y), (0, 0, 0, 0))) for x in range(width))


def test_lines_of_sparse_and_cut_pictures(spark):
    tile = bytes(range(256)) * 4
    cells = spark.createDataFrame(
        [(0, 1, 0, 40, 3, tile), (1, 0, 0, 40, 40, tile), (1, 2, 0, 40, 40, tile), (1, 2, 2, 40, 40, tile), (2, 1, 1, 16, 16, tile)],
        "image_id long, tx long, ty long, width long, height long, px binary",
    )
    lines = {(r.image_id, r.y): bytes(r.line) for r in T.rebuild_lines(cells).collect()}
    clear = bytes(64)
    assert sorted(lines) == [(0, y) for y in range(3)] + [(1, y) for y in (*range(16), *range(32, 40))]
    assert lines[0, 2] == clear + tile[128:192] + bytes(32)
    assert lines[1, 4] == tile[256:320] + clear + tile[256:288]
    assert lines[1, 39] == clear * 2 + tile[448:480]


def test_lookup_spreads_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(T, "HOT_SHARE", 4)
    cells = spark.range(400).select(F.col("id").alias("image_id"), F.lit(0).alias("tx"), F.lit(0).alias("ty"),
                                    F.when(F.col("id") < 200, "hot").otherwise((F.col("id") % 9).cast("string")).alias("hash"))
    uses = cells.groupBy("hash").agg(F.count("*").alias("uses"), F.max("image_id").alias("gid"))
    got = {(r.image_id, r.gid) for r in T.map_cells(cells, uses).collect()}
    want = {(r.image_id, r.gid) for r in cells.join(uses, "hash").collect()}
    assert got == want and len(got) == 400


@pytest.mark.parametrize("n, columns", [(1, 4), (16, 4), (17, 8), (1025, 64), (4096, 64), (4097, 4)])
def test_last_sheet_is_smallest_that_fits(spark, n, columns):
    gids = spark.range(n).select((F.col("id") + 1).alias("gid"))
    last = T.pack_sheets(gids).orderBy(F.col("gid").desc()).first()
    assert (last["columns"], last.sheet) == (columns, (n - 1) // 4096)
    assert last.first_gid + last.cell_y * columns + last.cell_x == n


def test_sheet_raster_size(spark):
    px = spark.createDataFrame([(0, x, 0, x, 0, 0, 255) for x in range(80)], PX)
    tiles = T.tile_dictionary(T.chop(px)).cache()
    packed = T.pack_sheets(T.assign_gids(tiles))
    row = T.sheet_rasters(tiles, packed).first()
    assert row.size == 64 and len(row.raster) == 64 * 64 * 4
    assert bytes(row.raster[:4]) == b"\x00\x00\x00\xff" and bytes(row.raster[-4:]) == b"\x00" * 4


@pytest.mark.parametrize("encoding", ["csv", "base64", "xml"])
@pytest.mark.parametrize("inline", [False, True])
def test_xml_maps_are_read_back(spark, encoding, inline):
    cells = [(0, x, y, 4090 + 3 * y + x) for x in range(3) for y in range(4)] + [(1, 0, 0, 1)]
    mapped = spark.createDataFrame(cells, "image_id long, tx long, ty long, gid long")
    names = {0: 'up\\dir\\a<b&"c"', 1: "plain"}
    images = spark.createDataFrame([(0, names[0], 41, 64), (1, names[1], 9, 1)], "image_id long, name string, width long, height long")
    sheets = spark.createDataFrame(
        [(0, 1024, 64, 4096, 1), (1, 64, 4, 16, 4097)], "sheet long, size long, columns long, tile_count long, first_gid long"
    )
    written = M.tile_map_xml(mapped, images, sheets, encoding, inline)
    assert sorted(map(tuple, M.scan_tile_maps_xml(written).collect())) == sorted(cells)
    docs = {r.image_id: ElementTree.fromstring(r.xml.encode()) for r in written.collect()}
    for image, doc in docs.items():
        assert doc.find("layer").get("name") == names[image]
        assert [t.get("firstgid") for t in doc.findall("tileset")] == (["1", "4097"] if image == 0 else ["1"])
    source = (docs[0].find("tileset/image") if inline else docs[0].find("tileset")).get("source")
    assert source == ("..\\..\\0.png" if inline else "..\\..\\0.tsx")
    sets = {r.sheet: ElementTree.fromstring(r.xml.encode()) for r in M.tile_set_documents(sheets).collect()}
    assert sets[1].get("tilecount") == "16" and sets[1].find("image").get("width") == "64"


def test_scripts_hold_name_and_document(spark):
    docs = spark.createDataFrame([(0, '{"a":1}')], "image_id long, json string")
    images = spark.createDataFrame([(0, 'say "[hi]"')], "image_id long, name string")
    script = M.tile_map_script(docs, images).first().script
    assert script.endswith('})("say \\"[hi]\\"", {"a":1});')


def test_crc_keys_and_fingerprint_of_small_images(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 2, 3, 4)], PX)
    cells = T.chop(px, key="crc32")
    assert dict(cells.dtypes)["hash"] == "bigint"
    assert T.image_fingerprint(cells).first().fingerprint == 0


def test_plan_bundles_switches_to_wide_layout(spark):
    rows = [("a", 0, "é.png", 10), ("a", 1, "bb", 5), ("b", 0, "x", 1 << 32)]
    plan = {(r.bundle_id, r.idx): r for r in A.plan_bundles(spark.createDataFrame(rows, "bundle_id string, idx long, name string, csize long")).collect()}
    a1 = plan["a", 1]
    assert plan["a", 0].data_offset == 39 + 2 * 6 and a1.header_offset == 51 + 10 and not a1.wide
    assert a1.total_size == 51 + 10 + 43 + 5 + (55 + 12) + (55 + 4) + 22
    assert plan["b", 0].wide and plan["b", 0].data_offset == 39 + 2 + 32


def events(spark, path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, start + dt.timedelta(milliseconds=ms), i, float(i)) for i, (k, ms) in enumerate(
        [(1, 0), (1, 10), (1, 41), (1, 200), (2, 5), (1, 3_600_000), (2, 3_600_000)])]
    spark.createDataFrame(rows, "key long, ts timestamp, event_id long, value double").coalesce(1).write.parquet(path)
    return spark.readStream.schema("key long, ts timestamp, event_id long, value double").parquet(path)


def drain(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_debounce_stream_and_twin(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    twin = {(r.key, r.changes, r.value) for r in changes.bursts(batch, 32).collect()}
    assert twin == {(1, 3, 2.0), (1, 1, 3.0), (2, 1, 4.0), (1, 1, 5.0), (2, 1, 6.0)}
    got = {(r.key, r.changes, r.value) for r in drain(changes.debounce_changes(stream, 32), "saves").collect()}
    # the last bursts stay open until the watermark passes them
    assert {(1, 3, 2.0), (1, 1, 3.0), (2, 1, 4.0)} <= got <= twin


def test_expire_stream(spark, tmp_path):
    stream = events(spark, str(tmp_path / "in"))
    got = {(r.key, r.writes) for r in drain(changes.expire_idle(stream), "gone").collect()}
    assert {(1, 4), (2, 1)} <= got


def test_progress_stream_once_per_step(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("f", n * 100_000, start + dt.timedelta(seconds=n)) for n in range(1, 12)]
    spark.createDataFrame(rows, "file string, pos long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, pos long, ts timestamp").parquet(str(tmp_path / "in"))
    got = sorted(r.step for r in drain(changes.progress_stream(stream), "steps").collect())
    assert got == [1, 2, 3, 4]


def test_ring_keeps_newest_and_replaces(spark, tmp_path):
    saves = [(1, 7, n, "doc", f"v{n}", 1) for n in range(3)] + [(1, s, 100 + s, "doc", f"s{s}", 1) for s in range(20, 30)]
    saves += [(2, 1, 1, "doc", "empty", 0), (2, 1, 2, "doc", "x", 1), (2, 2, 3, "doc", "x", 1)]
    schema = "user long, session long, ts_us long, doc_hash string, id string, entries int"
    spark.createDataFrame(saves, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    rows = drain(rings.stream_recent_versions(stream), "ring", "update").collect()
    ring = lambda u: [r.id for r in sorted(rows, key=lambda r: r.slot) if r.user == u]
    assert ring(1) == [f"s{s}" for s in range(22, 30)]
    assert ring(2) == ["x"]

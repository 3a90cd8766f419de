"""Favorites files, views, names and charsets."""

import itertools
import random

from pyspark.sql import functions as F

from lamina.operators import views as V
from lamina.sources import charset as CS
from lamina.sources import favorites as FS

SAMPLE = """[AnyFavorites-v1]
root-name/Demo
faview-mode/1

//*Girl/eyes~filter
eyes

//*Girl/eyes/open
eyes/open

//*Girl/eyes/open
ignored

//*Girl/empty~folder

"""


def files(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_scan_sample(spark):
    rows = FS.scan_favorites(files(spark, SAMPLE.replace("\n", "\r\n"))).orderBy("ordinal", "path").collect()
    got = [(r.path, r.type, r.value) for r in rows]
    assert got == [
        ("*Girl", "folder", None),
        ("*Girl/eyes", "filter", "eyes"),
        ("*Girl/eyes/open", "item", "eyes/open"),
        ("*Girl/empty", "folder", None),
    ]
    settings = FS.favorites_settings(files(spark, SAMPLE)).first()
    assert (settings.root_name, settings.view_mode) == ("Demo", 1)
    assert files(spark, SAMPLE).select(FS.count_entries(F.col("text")).alias("n")).first().n == 4


def test_bad_header_is_set_aside(spark):
    good, bad = FS.split_files(files(spark, SAMPLE, "nothing"))
    assert [r.doc_id for r in good.collect()] == [0]
    assert [r.reason for r in bad.collect()] == ["invalid header"]


def test_settings_defaults(spark):
    rows = FS.favorites_settings(files(spark, "[Favorites-v1]", "[Favorites-v1]\nfaview-mode/9\nroot-name/\n")).collect()
    assert {(r.root_name, r.view_mode) for r in rows} == {("My Favorites", 2)}


def test_write_read_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame(
        [
            (0, "root", "#", 0, "My/Root", "root", None),
            (0, "a", "root", 0, "*Girl", "folder", None),
            (0, "b", "a", 0, "e~y/es", "filter", "eyes\neyes/x"),
            (0, "c", "b", 0, "100%", "item", "eyes/open"),
            (0, "d", "b", 1, "none", "item", ""),
            (0, "e", "a", 1, "empty", "folder", None),
        ],
        "doc_id long, node_id string, parent_id string, ordinal long, text string, type string, value string",
    )
    chunks = FS.favorites_chunks(nodes)
    text = FS.favorites_text(chunks)
    scanned = FS.scan_favorites(text).collect()
    assert {(r.text, r.type, r.value) for r in scanned} == {
        ("*Girl", "folder", None), ("e~y/es", "filter", "eyes\neyes/x"), ("100%", "item", "eyes/open"),
        ("none", "item", ""), ("empty", "folder", None),
    }
    assert FS.favorites_settings(text).first().root_name == "My/Root"
    FS.write_favorites(chunks, str(tmp_path / "out"))
    back = FS.read_favorites_files(spark, str(tmp_path / "out" / "doc_id=0")).select(F.lit(0).alias("doc_id"), "text")
    assert back.count() >= 1


def test_enumerate_views_matches_product(spark):
    rng = random.Random(5)
    data, want = [], set()
    for root in range(4):
        sizes = [rng.randint(1, 4) for _ in range(rng.randint(1, 4))]
        for o, n in enumerate(sizes):
            data += [(0, f"r{root}", o, i, n) for i in range(n)]
        for at, combo in enumerate(itertools.product(*map(range, sizes))):
            want |= {(f"r{root}", at, o, i) for o, i in enumerate(combo)}
    selects = spark.createDataFrame(data, "doc_id long, root_id string, select_ord long, item_ord long, size long")
    got = {(r.root_id, r.view_index, r.select_ord, r.item_ord) for r in V.enumerate_views(selects).collect()}
    assert got == want


def test_enumerate_views_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "VIEW_BLOCK", 5)
    data = [(0, "r", o, i, 3) for o in range(4) for i in range(3)]
    selects = spark.createDataFrame(data, "doc_id long, root_id string, select_ord long, item_ord long, size long")
    got = {(r.view_index, r.select_ord, r.item_ord) for r in V.enumerate_views(selects).collect()}
    assert got == {(at, o, i) for at, c in enumerate(itertools.product(range(3), repeat=4)) for o, i in enumerate(c)}


def numbered_names(texts):
    """Every text is taken; its first holder keeps it, the others get the least free numbers in order."""
    taken, seen, out = set(texts), set(), []
    for text in texts:
        name, n = text, 2
        while text in seen and name in taken:
            name, n = f"{text} {n}", n + 1
        seen.add(text)
        taken.add(name)
        out.append(name)
    return out


NODE_SCHEMA = "doc_id long, node_id string, parent_id string, ordinal long, text string"


def test_unique_names_against_one_by_one(spark, monkeypatch):
    from lamina.operators import scans

    rng = random.Random(11)
    data, want = [], {}
    for parent in range(12):
        texts = [rng.choice(["a", "a", "a 2", "a 3", "a 4", "a 2 2", "b", "c 1", "", " 2", "7", "a\nb", "a\nb 2"]) for _ in range(rng.randint(1, 40))]
        want |= {(f"p{parent}", i): n for i, n in enumerate(numbered_names(texts))}
        assert len(set(numbered_names(texts))) == len(texts)
        data += [(0, f"n{parent}-{i}", f"p{parent}", i, t) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(data, NODE_SCHEMA)
    assert {(r.parent_id, r.ordinal): r.text for r in V.unique_names(nodes).collect()} == want


def test_unique_names_of_one_large_family(spark):
    """A family of 300,000 rows, a third of them with numbers, is spread over blocks and tasks."""
    n = 300_000
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("a "), (F.col("id") / 2 + 2).cast("long").cast("string"))).otherwise("a")
    nodes = spark.range(n).select(F.lit(0).cast("long").alias("doc_id"), F.lit("p").alias("parent_id"), F.col("id").alias("ordinal"), text.alias("text"))
    named = V.unique_names(nodes)
    assert "PythonUDF" not in named._jdf.queryExecution().toString() and "FlatMapGroups" not in named._jdf.queryExecution().toString()
    got = dict(named.select("ordinal", "text").collect())
    want = numbered_names([f"a {int(k / 2 + 2)}" if k % 3 == 0 else "a" for k in range(600)])
    assert len(set(got.values())) == n and got[1] == "a" and got[0] == "a 2"
    taken = {f"a {int(k / 2 + 2)}" for k in range(0, n, 3)}
    free = (f"a {k}" for k in range(2, 2 * n) if f"a {k}" not in taken)
    assert [got[k] for k in range(2, n) if k % 3] == [next(free) for k in range(2, n) if k % 3]
    assert len(want) == 600


def test_bulk_rename_swaps_and_settles_clashes(spark):
    rows = [(0, "n1", "p", 0, "a"), (0, "n2", "p", 1, "b"), (0, "n3", "p", 2, "c"), (0, "n4", "p", 3, "keep"), (0, "n5", "p", 4, "d"), (0, "n6", "q", 5, "a")]
    new = [(0, "n1", "b"), (0, "n2", "a"), (0, "n3", "keep"), (0, "n5", "keep"), (0, "n6", "keep"), (0, "n4", "keep")]
    got = V.bulk_rename(spark.createDataFrame(rows, NODE_SCHEMA), spark.createDataFrame(new, "doc_id long, node_id string, new_text string"))
    assert {r.node_id: r.text for r in got.collect()} == {"n1": "b", "n2": "a", "n3": "keep 2", "n4": "keep", "n5": "keep 3", "n6": "keep"}


def test_added_folders_avoid_their_siblings(spark):
    nodes = spark.createDataFrame([(0, "n1", "p", 4, "x"), (0, "n2", "p", 7, "x 2")], NODE_SCHEMA)
    lines = V.bulk_folders(spark.createDataFrame([(0, " x \r\n\ny\nx\ny 2")], "doc_id long, text string")).withColumn("parent_id", F.lit("p"))
    got = V.add_folders(nodes, lines).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text, r.line_no) for r in got] == [(8, "x 3", 0), (10, "y", 2), (11, "x 4", 3), (12, "y 2", 4)]


def test_charset_samples(spark):
    ja = "日本語のテキスト、漢字とかな。"
    samples = {
        "UTF-8": [ja.encode(), b"\xef\xbb\xbfabc"],
        "UTF-16": [b"\xff\xfe" + ja.encode("utf-16-le"), b"\xfe\xff" + ja.encode("utf-16-be")],
        "EUC-JP": [ja.encode("euc_jp")],
        "Shift_JIS": [("カタカナ" + ja).encode("cp932")],
        "ISO-2022-JP": [ja.encode("iso2022_jp")],
        "ASCII": [b"plain text", b""],
        "Binary": [b"%PDF-1.4", b"a\x00b", b"\x01\x02\x03\x04"],
    }
    data = [(label, bytes(b)) for label, group in samples.items() for b in group]
    rows = CS.decode_texts(spark.createDataFrame(data, "want string, content binary")).collect()
    assert [(r.want, r.charset) for r in rows] == [(r.want, r.want) for r in rows]
    texts = {r.want: r.text for r in rows if ja[-5:] in r.text}
    assert {"UTF-8", "UTF-16", "EUC-JP", "Shift_JIS", "ISO-2022-JP"} <= set(texts)


def test_charset_probes_keep_consumed_bytes():
    # a UTF-8 lead whose tail is wrong hands the tail, not the lead, to the later probes
    assert CS.charset_of(b"\xc3\xb1\xb1" + b"a" * 4) == "UTF-8"
    assert CS.charset_of(b"\xc3\xe5\xb1" + b"a" * 4) == "EUC-JP"
    assert CS.charset_of(b"\x82") == "Binary"
    assert CS.charset_of(b"abcdef\x82") == "ASCII"

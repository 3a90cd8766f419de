"""States on random trees against a plain simulation of one document at a time."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.functions.names import layer_flags
from lamina.operators import states, tree

SCHEMA = "doc_id long, seq_id long, parent_seq_id long, ordinal long, name string, folder boolean, visible boolean, clipping boolean"


def random_rows(seed, docs=6):
    rng = random.Random(seed)
    rows = []
    for doc in range(docs):
        nodes = [-1]
        depth = {-1: 0}
        for seq in range(1, rng.randint(6, 18)):
            parent = rng.choice([n for n in nodes if depth[n] < 3])
            depth[seq] = depth[parent] + 1
            name = rng.choice(["*", "*", "!", "", ""]) + rng.choice("abc") + rng.choice(["", "", ":flipx"])
            rows.append([doc, seq, parent, seq, name, True, rng.random() < 0.6, False])
            nodes.append(seq)
    return [tuple(r) for r in rows]


class Model:
    """One document: flags with exclusive radios, as a browser keeps them."""

    def __init__(self, rows):
        self.rows = {r.seq_id: r for r in rows}
        self.flag = {r.seq_id: r.checked for r in rows}

    def kids(self, parent):
        return sorted((r for r in self.rows.values() if r.parent_seq_id == parent), key=lambda r: -r.ordinal)

    def put(self, seq, on):
        row = self.rows[seq]
        if on and row.kind == "radio":
            for other in self.kids(row.parent_seq_id):
                if other.kind == "radio":
                    self.flag[other.seq_id] = False
        self.flag[seq] = on

    def reset(self):
        for seq in self.flag:
            self.flag[seq] = False
        parents = {r.parent_seq_id for r in self.rows.values()}
        for r in self.rows.values():
            if r.kind == "force":
                self.flag[r.seq_id] = True
        for parent in parents:
            radios = [r for r in self.kids(parent) if r.kind == "radio"]
            if radios:
                self.flag[radios[0].seq_id] = True

    def load(self, text, only=None):
        absolute = text.startswith("/")
        listed, exact = set(), set()
        for line in text.replace("\r", "").split("\n"):
            parts = line.split("/")[1:] if absolute else line.split("/")
            listed |= {"/".join(parts[: i + 1]) for i in range(len(parts))}
            exact.add("/".join(parts))
        if absolute:
            self.reset()

        def visit(parent, alive):
            for r in self.kids(parent):
                if only is not None and r.path not in only:
                    continue
                if alive and r.path in listed:
                    if not absolute or r.path in exact:
                        self.put(r.seq_id, True)
                    visit(r.seq_id, True)
                else:
                    self.put(r.seq_id, False)
                    if absolute:
                        visit(r.seq_id, False)

        visit(-1, True)


def closed(paths):
    return {"/".join(p.split("/")[: i + 1]) for p in paths for i in range(len(p.split("/")))}


@pytest.fixture(scope="module", params=[1, 2])
def world(spark, request):
    layers = spark.createDataFrame(random_rows(request.param), SCHEMA)
    rows = tree.normalize_radios(tree.tree_paths(layers)).cache()
    return rows, rows.collect(), random.Random(request.param)


def flags(df):
    return {(r.doc_id, r.seq_id): r.checked for r in df.collect()}


def by_doc(collected):
    docs = {}
    for r in collected:
        docs.setdefault(r.doc_id, []).append(r)
    return docs


@pytest.mark.parametrize("absolute", [False, True])
def test_apply_state(spark, world, absolute):
    rows, collected, rng = world
    texts, want = [], {}
    for doc, members in by_doc(collected).items():
        lines = [r.path for r in members if rng.random() < 0.4] or [members[0].path]
        text = "\r\n".join(("/" if absolute else "") + p for p in lines)
        texts.append((doc, text))
        model = Model(members)
        model.load(text)
        want |= {(doc, s): v for s, v in model.flag.items()}
    parsed = states.parse_state(spark.createDataFrame(texts, "doc_id long, text string"))
    assert flags(states.apply_state(rows, parsed)) == want


@pytest.mark.parametrize("base", [None, ""])
def test_apply_overlay(spark, world, base):
    rows, collected, rng = world
    overlay, allowed, want = [], [], {}
    for doc, members in by_doc(collected).items():
        lines = [r.path for r in members if rng.random() < 0.4] or [members[0].path]
        only = closed([r.path for r in members if rng.random() < 0.5])
        overlay += [(doc, p) for p in closed(lines)]
        allowed += [(doc, p) for p in only]
        model = Model(members)
        if base == "":
            model.flag = dict.fromkeys(model.flag, False)
        model.load("\n".join(lines), only)
        want |= {(doc, s): v for s, v in model.flag.items()}
    frame = lambda data: spark.createDataFrame(data, "doc_id long, path string")
    assert flags(states.apply_overlay(rows, frame(overlay), frame(allowed), base)) == want


def test_compact_state_round_trip(spark, world):
    rows, collected, _ = world
    kept = states.compact_state(rows, "checked")
    texts = states.state_text(kept.withColumnRenamed("path", "line"), newest_first=True)
    again = states.apply_state(rows.withColumn("checked", F.lit(False)), states.parse_state(texts))
    lit = lambda df: {(r.doc_id, r.seq_id) for r in tree.tree_walk(
        df.select("doc_id", "seq_id", "parent_seq_id", "checked"),
        {"lit": (F.col("checked"), lambda up: up("lit") & F.col("checked"))}).filter("lit").collect()}
    assert lit(again) == lit(rows)


def test_apply_toggles(spark, world):
    rows, collected, rng = world
    clicks, want = [], {}
    for doc, members in by_doc(collected).items():
        model = Model(members)
        for n in range(6):
            r = rng.choice([m for m in members if m.kind != "force"])
            on = True if r.kind == "radio" else rng.random() < 0.6
            solo = rng.random() < 0.4
            clicks.append((doc, r.seq_id, n, on, solo))
            model.put(r.seq_id, on)
            if solo and r.kind != "radio":
                for other in model.kids(r.parent_seq_id):
                    if other.kind == "plain" and other.seq_id != r.seq_id:
                        model.put(other.seq_id, False)
            up = r.parent_seq_id
            while up != -1:
                model.put(up, True)
                up = model.rows[up].parent_seq_id
        want |= {(doc, s): v for s, v in model.flag.items()}
    frame = spark.createDataFrame(clicks, "doc_id long, seq_id long, click_seq long, on boolean, solo boolean")
    got = flags(states.apply_toggles(rows, frame))
    assert got == want


def test_apply_flip_swaps_and_returns(spark):
    data = [
        (0, 1, -1, 1, "pose", True, True, False), (0, 2, 1, 1, "arm", True, True, False), (0, 3, 1, 2, "leg", True, False, False),
        (0, 4, -1, 2, "pose:flipx", True, False, False), (0, 5, 4, 1, "arm", True, False, False), (0, 6, 4, 2, "leg", True, True, False),
    ]
    layers = spark.createDataFrame(data, SCHEMA)
    rows = tree.normalize_radios(tree.tree_paths(layers))
    pairs = tree.flip_pairs(layers)
    flipped = states.apply_flip(rows, pairs, "flipx")
    assert {s for (_, s), v in flags(flipped).items() if v} == {2, 4, 5}
    assert {s for (_, s), v in flags(states.apply_flip(flipped, pairs, None)).items() if v} == {1, 2, 5}


def test_layer_flags_edges(spark):
    names = ["!", "!?", "*", "*a", "!b:flipx", "flipx", "a:flipx:flipy", "x:flip", "*c:flipxy"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", layer_flags("n").alias("f")).collect()
    got = {r.n: (r.f.kind, r.f.display, r.f.base, r.f.tokens) for r in rows}
    assert got["!"] == ("plain", "!", "!", [])
    assert got["!?"] == ("plain", "!?", "!?", [])
    assert got["*a"] == ("radio", "a", "*a", [])
    assert got["!b:flipx"] == ("force", "b", "!b", ["flipx"])
    assert got["flipx"] == ("plain", "", "", ["flipx"])
    assert got["a:flipx:flipy"] == ("plain", "a", "a", ["flipy", "flipx"])
    assert got["x:flip"] == ("plain", "x:flip", "x:flip", [])


def test_unreachable_nodes(spark):
    data = [(0, 1, -1, 1, "a", True, True, False), (0, 2, 9, 1, "orphan", True, True, False),
            (0, 3, 4, 1, "loop", True, True, False), (0, 4, 3, 1, "loop", True, True, False)]
    layers = spark.createDataFrame(data, SCHEMA)
    lost = tree.unreachable_nodes(layers, tree.tree_paths(layers))
    assert sorted(r.seq_id for r in lost.collect()) == [2, 3, 4]

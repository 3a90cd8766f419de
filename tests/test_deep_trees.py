"""Walks by pointer doubling: deep chains, cycles, and folds against a plain walk."""

import math
import random

from pyspark.sql import functions as F

from lamina.operators import tree

SCHEMA = "doc_id long, seq_id long, parent_seq_id long, ordinal long, name string"


def counted(monkeypatch):
    rounds, plain = [], tree.stage
    monkeypatch.setattr(tree, "stage", lambda df, label: rounds.append(label) or plain(df, label))
    return rounds


def test_a_chain_of_2000_takes_rounds_by_its_logarithm(spark, monkeypatch):
    n = 2000
    rows = [(0, k, k - 1 if k else -1, k, f"f{k}") for k in range(n)]
    rounds = counted(monkeypatch)
    found = tree.tree_fold(
        spark.createDataFrame(rows, SCHEMA), {"total": (F.col("seq_id"), lambda up, own: up + own), "deep": (F.lit(True), tree.both)}
    )
    got = {r.seq_id: (r.depth, r.total, r.deep) for r in found.collect()}
    assert got == {k: (k + 1, k * (k + 1) // 2, True) for k in range(n)}
    assert len(rounds) <= math.ceil(math.log2(n)) + 1
    closure = tree.tree_closure(spark.createDataFrame(rows, SCHEMA))
    assert closure.agg(F.count("*"), F.max("distance")).first() == (n * (n + 1) // 2, n - 1)


def test_cycles_and_orphans_end_and_are_reported(spark, monkeypatch):
    rows = [(0, 1, -1, 1, "a"), (0, 2, 1, 1, "b"), (0, 3, 99, 1, "orphan"), (0, 4, 3, 1, "below")]
    rows += [(0, 10 + k, 10 + (k + 1) % 7, k, "loop") for k in range(7)] + [(0, 20, 12, 1, "at the loop"), (0, 21, 21, 1, "self")]
    rows += [(1, k, k - 1 if k > 1 else -1, 1, "c") for k in range(1, 40)]
    layers = spark.createDataFrame(rows, SCHEMA)
    rounds = counted(monkeypatch)
    reached = tree.tree_paths(layers)
    assert {(r.doc_id, r.seq_id) for r in reached.collect()} == {(0, 1), (0, 2), *((1, k) for k in range(1, 40))}
    assert len(rounds) <= 9
    lost = {r.seq_id: r.reason for r in tree.lost_nodes(layers, reached).collect()}
    assert set(lost) == {3, 4, *range(10, 17), 20, 21} and lost[3] == "orphan"


def test_folds_match_a_plain_walk(spark):
    rng = random.Random(7)
    rows, parent = [], {}
    for doc in range(4):
        for k in range(120):
            parent[doc, k] = rng.choice([-1, *range(max(0, k - 4), k)]) if k else -1
            rows.append((doc, k, parent[doc, k], k, rng.choice("ab*")))
    name = {(d, k): n for d, k, _, _, n in rows}
    chain = lambda d, k: [] if k == -1 else [*chain(d, parent[d, k]), k]
    folds = {
        "names": (F.col("name"), tree.joined("/")),
        "down": (F.array("seq_id"), tree.appended),
        "up": (F.array("seq_id"), tree.prepended),
        "most": (F.col("seq_id"), F.greatest),
    }
    got = tree.tree_fold(spark.createDataFrame(rows, SCHEMA).repartition(5), folds).collect()
    assert len(got) == len(rows)
    for r in got:
        way = chain(r.doc_id, r.seq_id)
        assert (r.depth, r.down, r.up, r.most) == (len(way), way, way[::-1], max(way))
        assert r.names == "/".join(name[r.doc_id, k] for k in way)


def test_fold_of_nothing(spark):
    assert tree.tree_fold(spark.createDataFrame([], SCHEMA), {"up": (F.array("seq_id"), tree.prepended)}).count() == 0


def test_leaves_take_no_part_in_rounds(spark, monkeypatch):
    rows = [(0, k, k - 1 if k else -1, k, "f") for k in range(20)]
    rows += [(0, 100 + k, k % 20, k, "leaf") for k in range(200)] + [(0, 900, -1, 1, "leaf"), (0, 901, 100, 1, "leaf"), (0, 902, 5, 1, None)]
    staged, plain = [], tree.stage
    monkeypatch.setattr(tree, "stage", lambda df, label: staged.append(plain(df, label)) or staged[-1])
    up = {"up": (F.array("seq_id"), tree.prepended)}
    got = {r.seq_id: (r.depth, r.up) for r in tree.tree_fold(spark.createDataFrame(rows, SCHEMA), up, inner=F.col("name") == "f").collect()}
    assert len(got) == 20 + 200 + 1 + 1 and got[900] == (1, [900]) and 901 not in got
    assert got[107] == (9, [107, *range(7, -1, -1)]) and got[902] == (7, [902, 5, 4, 3, 2, 1, 0])
    assert all(df.filter("seq_id >= 100").isEmpty() for df in staged)

"""Many states, overlays, filters and clicks per document on trees of several blocks, against plain simulations."""

import random

import pytest
from pyspark.sql import functions as F
from test_states import SCHEMA, Model, by_doc, closed, flags

from lamina.operators import bitsets, states, tree

STATES = (1, 2, 3)


def wide_rows(seed, docs=3, size=150):
    rng = random.Random(seed)
    rows = []
    for doc in range(docs):
        for seq in range(1, size + 1):
            parent = -1 if seq < 4 or rng.random() < 0.1 else rng.choice(range(max(1, seq - 30), seq))
            name = rng.choice(["*", "*", "!", "", ""]) + rng.choice("abcdef")
            rows.append((doc, seq, parent, rng.randint(1, 10**6) * 1000 + seq, name, True, rng.random() < 0.6, False))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    layers = spark.createDataFrame(wide_rows(5), SCHEMA)
    rows = tree.normalize_radios(tree.tree_paths(layers)).cache()
    return bitsets.number_layers(rows).cache(), rows.collect(), random.Random(9)


def many_flags(df, name="checked"):
    return {(r.doc_id, r.state_id, r.seq_id): r[name] for r in df.collect()}


def below(rows):
    """Descendants of each layer, and its chain."""
    kids = {}
    for r in rows:
        kids.setdefault(r.parent_seq_id, []).append(r.seq_id)

    def all_of(seq):
        return [x for k in kids.get(seq, []) for x in [k, *all_of(k)]]

    return {r.seq_id: all_of(r.seq_id) for r in rows}


def test_numbers_are_walking_order(world):
    numbered, collected, _ = world
    got = {(r.doc_id, r.seq_id): r for r in numbered.collect()}
    for doc, members in by_doc(collected).items():
        assert sorted(got[doc, r.seq_id].pos for r in members) == list(range(len(members)))
        for seq, inside in below(members).items():
            own = got[doc, seq]
            assert sorted(got[doc, k].pos for k in inside) == list(range(own.pos + 1, own.last + 1))
            up = got[doc, own.parent_seq_id].pos if own.parent_seq_id != -1 else -1
            assert own.parent_pos == up


@pytest.mark.parametrize("absolute", [False, True])
def test_states_of_one_document(spark, world, absolute):
    numbered, collected, rng = world
    texts, want = [], {}
    for doc, members in by_doc(collected).items():
        for state in STATES:
            lines = rng.sample([r.path for r in members], 3 + 20 * state)
            text = "\n".join(("/" if absolute else "") + p for p in lines)
            texts.append((doc, state, text))
            model = Model(members)
            model.load(text)
            want |= {(doc, state, s): v for s, v in model.flag.items()}
    parsed = states.parse_state(spark.createDataFrame(texts, "doc_id long, state_id long, text string"), keys=bitsets.STATE)
    got = many_flags(bitsets.flags(numbered, bitsets.apply_states(numbered, parsed), bitsets.STATE, checked="bits"))
    assert got == want


@pytest.mark.parametrize("base", [None, "", "bits"])
def test_overlays_of_one_document(spark, world, base):
    numbered, collected, rng = world
    overlay, allowed, start, want = [], [], [], {}
    places = {(r.doc_id, r.seq_id): r.pos for r in numbered.collect()}
    for doc, members in by_doc(collected).items():
        for state in STATES:
            lines = rng.sample([r.path for r in members], 10 * state)
            only = closed(rng.sample([r.path for r in members], 60))
            overlay += [(doc, state, p) for p in closed(lines)]
            allowed += [(doc, state, p) for p in only]
            model = Model(members)
            if base == "":
                model.flag = dict.fromkeys(model.flag, False)
            elif base:
                model.flag = {s: rng.random() < 0.5 for s in model.flag}
                start += [(doc, state, places[doc, s]) for s, v in model.flag.items() if v]
            model.load("\n".join(lines), only)
            want |= {(doc, state, s): v for s, v in model.flag.items()}
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, state_id long, path string")
    if base == "bits":
        base = bitsets.to_bits(spark.createDataFrame(start, "doc_id long, state_id long, pos long"), bitsets.STATE)
    got = bitsets.apply_overlays(numbered, frame(overlay), frame(allowed), base)
    assert many_flags(bitsets.flags(numbered, got, bitsets.STATE, checked="bits")) == want


def test_set_operations_and_filters(spark, world):
    numbered, collected, rng = world
    sets, levels, own, owners = {}, [], [], []
    docs = by_doc(collected)
    for doc, members in docs.items():
        for state in STATES:
            owners.append((doc, state))
            for name in ("outer", "inner", "own"):
                sets[doc, state, name] = closed(rng.sample([r.path for r in members], 70))
            levels += [(doc, state, k, p) for k, name in enumerate(("outer", "inner")[: state - 1]) for p in sets[doc, state, name]]
            own += [(doc, state, p) for p in sets[doc, state, "own"] if state != 3]
    key = "doc_id long, state_id long"
    outer = spark.createDataFrame(levels, key + ", level int, path string")
    mine = spark.createDataFrame(own, key + ", path string")
    bits = bitsets.filters_effective(numbered, spark.createDataFrame(owners, key), outer, mine).cache()
    enabled, selected, lines = {}, {}, set()
    for (doc, state), members in ((k, docs[k[0]]) for k in owners):
        on, chosen = {}, {}
        for r in members:
            on[r.seq_id] = all(r.path in sets[doc, state, n] for n in ("outer", "inner")[: state - 1])
            chosen[r.seq_id] = on[r.seq_id] and (state == 3 or r.path in sets[doc, state, "own"])
        enabled |= {(doc, state, s): v for s, v in on.items()}
        selected |= {(doc, state, s): v for s, v in chosen.items()}
        if any(on[s] and not chosen[s] for s in on):
            up = {r.seq_id: r.parent_seq_id for r in members}
            lit = {-1}
            for _ in members:
                lit |= {s for s in on if chosen[s] and up[s] in lit}
            lines |= {(doc, state, s) for s in lit - {-1} if not any(k in lit for k in up if up[k] == s)}
    shown = bitsets.flags(numbered, bits, bitsets.STATE, enabled="enabled", selected="selected").cache()
    assert many_flags(shown, "enabled") == enabled and many_flags(shown, "selected") == selected
    assert {(r.doc_id, r.state_id, r.seq_id) for r in bitsets.filters_lines(numbered, bits).collect()} == lines
    a = bitsets.to_bits(bitsets.find_layers(mine, numbered), bitsets.STATE)
    b = bitsets.to_bits(bitsets.find_layers(outer.filter("level = 0").drop("level"), numbered), bitsets.STATE)
    path = {(r.doc_id, r.pos): r.path for r in numbered.collect()}
    of = lambda df: {(r.doc_id, r.state_id, path[r.doc_id, r.pos]) for r in bitsets.to_places(df, bitsets.STATE).collect()}
    x, y = set(own), {(d, s, p) for d, s, k, p in levels if k == 0}
    assert of(bitsets.union(a, b)) == x | y and of(bitsets.intersection(a, b)) == x & y
    every = {(r.doc_id, s, r.path) for r in collected for s in (1, 2)}
    assert of(bitsets.hidden(a, numbered)) == every - x


def test_filter_clicks_in_walking_order(spark, world):
    numbered, collected, rng = world
    clicks, want = [], {}
    for doc, members in by_doc(collected).items():
        inside = below(members)
        up = {r.seq_id: r.parent_seq_id for r in members}
        flag = {r.seq_id: r.checked for r in members}
        for at in range(60):
            seq, on = rng.choice(members).seq_id, rng.random() < 0.5
            clicks.append((doc, seq, at, on))
            for k in [seq, *inside[seq]]:
                flag[k] = on
            while on and up[seq] != -1:
                seq = up[seq]
                flag[seq] = True
        want |= {(doc, s): v for s, v in flag.items()}
    frame = spark.createDataFrame(clicks, "doc_id long, seq_id long, click_seq long, on boolean")
    assert flags(states.apply_filter_toggles(numbered, frame)) == want
    assert flags(states.apply_filter_toggles(numbered.drop("pos", "last", "parent_pos"), frame)) == want


def test_interval_masks_of_every_length(spark):
    rows = [(0, a, b) for a in (0, 1, 62, 63, 64, 100) for b in (a, a + 1, a + 63, a + 64, a + 130)]
    for k, (_, a, b) in enumerate(rows):
        rows[k] = (k, a, b)
    got = bitsets.to_places(bitsets.covered(spark.createDataFrame(rows, "doc_id long, pos long, last long"), ["doc_id"]), ["doc_id"])
    assert sorted((r.doc_id, r.pos) for r in got.collect()) == sorted((k, p) for k, a, b in rows for p in range(a, b + 1))

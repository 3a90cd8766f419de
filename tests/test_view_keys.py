"""View keys from changes per choice against drawing every view: selects that touch the same layers and each other's folders."""

import itertools
import random

import pytest

from lamina.operators import views as V


@pytest.mark.parametrize("seed, combos", [(1, 1 << 16), (2, 4)])
def test_keys_tell_pictures_apart(spark, monkeypatch, seed, combos):
    monkeypatch.setattr(V, "COMBOS", combos)
    rng = random.Random(seed)
    layers, selects, deltas, views, pictures = [], [], [], [], {}
    for doc in range(4):
        up = {k: rng.choice([-1, *range(k)]) if k else -1 for k in range(14)}
        chain = lambda k, up=up: [] if k == -1 else [k, *chain(up[k])]  # noqa: E731, B023
        folder = {k: k in up.values() for k in up}
        base = {k: rng.random() < 0.7 for k in up}
        mask = {k: rng.random() < 0.3 for k in up}
        layers += [(doc, k, folder[k], base[k], mask[k], chain(k)[1:]) for k in up]
        sizes = [rng.randint(1, 3) for _ in range(4)]
        sets = {}
        for o, size in enumerate(sizes):
            reach = rng.sample(range(14), rng.randint(1, 6))
            for i in range(size):
                selects.append((doc, "r", o, i, f"{doc}-{o}-{i}", size))
                sets[o, i] = {k: rng.random() < 0.5 for k in reach if rng.random() < 0.8}
                deltas += [(f"{doc}-{o}-{i}", doc, k, v) for k, v in sets[o, i].items()]
        for n, choice in enumerate(itertools.product(*[range(s) for s in sizes])):
            views += [(doc, "r", n, o, i) for o, i in enumerate(choice)]
            now = dict(base)
            for o, i in enumerate(choice):
                now |= sets[o, i]
            pictures[doc, n] = frozenset((k, mask[k]) for k in up if not folder[k] and all(now[c] for c in chain(k)))
    make = spark.createDataFrame
    got = V.view_keys(
        make(layers, "doc_id long, seq_id long, folder boolean, checked boolean, has_mask boolean, ancestors array<long>"),
        make(selects, "doc_id long, root_id string, select_ord long, item_ord long, item_id string, size long"),
        make(views, "doc_id long, root_id string, view_index long, select_ord long, item_ord long"),
        make(deltas, "item_id string, doc_id long, seq_id long, checked boolean"),
    )
    keys = {(r.doc_id, r.view_index): r.render_key for r in got.collect()}
    assert keys.keys() == pictures.keys()
    named = {}
    for at, picture in pictures.items():
        assert named.setdefault((at[0], keys[at]), picture) == picture
        assert (keys[at] == "empty") == (not picture)
    assert len(named) == len({(at[0], p) for at, p in pictures.items()}) > 8

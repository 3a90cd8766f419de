"""Operators that compare documents: near-dedup, repeats, benchmark, mix; and the pipeline."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import awkward, frame, prose

from lamina.llm import components, decontaminate, lpf_dedup, mixing, order_minhash


def plain_classes(rows, t=0.8):
    kmers = {}
    for i, text in rows:
        words, seen, out = (text or "").split(), Counter(), []
        for k in range(max(1, len(words) - 4) if words else 0):
            g = tuple(words[k : k + 5])
            seen[g] += 1
            out.append((g, seen[g]))
        kmers[i] = out
    parent = {i: i for i in kmers}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(kmers)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            need = t / (1 + t) * (len(kmers[a]) + len(kmers[b]))
            if not kmers[a] or not kmers[b] or len(set(kmers[a]) & set(kmers[b])) < need - 1e-9:
                continue
            place = {x: k for k, x in enumerate(kmers[b])}
            tails = []
            for x in kmers[a]:
                if x in place:
                    at = bisect_left(tails, place[x])
                    tails[at : at + 1] = [place[x]]
            if len(tails) >= need - 1e-9:
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


def edited(text, n, rng):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "w" + str(rng.randrange(10**6))
    return " ".join(words)


def family():
    """Copies of one text with few and with many edits, a shared passage in other texts, exact copies."""
    rng = random.Random(4)
    first, passage = prose(11, 200), prose(12, 80)
    texts = [first, first, first + "  "]
    texts += [edited(first, rng.choice([1, 2, 6, 8, 10]), rng) for _ in range(60)]
    texts += [edited(texts[5], 1, rng) for _ in range(5)] + [edited(texts[20], 2, rng) for _ in range(5)]
    texts += [passage + " " + prose(100 + k, 60) for k in range(40)]
    return list(enumerate(texts))


def test_classes_match_all_pairs(spark):
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert got == plain_classes(rows)
    assert len(set(got.values())) > 40


def test_classes_of_a_combinatorial_family(spark, monkeypatch):
    """Texts of 11 paragraphs in two variants each are linked where one paragraph differs; sketches part none of them."""
    rng, n = random.Random(13), 11
    made = [[" ".join(f"p{k}v{v}w{rng.randrange(10**6)}" for _ in range(40)) for v in range(2)] for k in range(n)]
    codes = rng.sample(range(2**n), 150)
    rows = [(i, " ".join(made[k][code >> k & 1] for k in range(n))) for i, code in enumerate(codes)]
    links = [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() == 1]
    want = {i: i for i in range(len(codes))}
    while (now := _least(want, links)) != want:
        want = now
    plain, equal = order_minhash.sketched, F.array_repeat(F.lit(1).cast("long"), order_minhash.SKETCHES)
    monkeypatch.setattr(order_minhash, "sketched", lambda *a: plain(*a).withColumn("_s", equal))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert got == want
    assert 20 < len(set(got.values())) < 130


def _least(named, links):
    """The least name among each node's own and its neighbours'."""
    out = dict(named)
    for a, b in links:
        out[a] = out[b] = min(out[a], out[b])
    return out


def test_classes_of_awkward_rows(spark):
    got = Counter((r.doc_id, r.class_id) for r in order_minhash.classes(frame(spark)).collect())
    want = Counter((i, i) for i, *_ in awkward() if i not in (1, 2, 3))
    assert got == want + Counter({(1, 1): 1, (2, 1): 1, (3, 1): 2})
    assert order_minhash.classes(frame(spark, [])).count() == 0
    docs = frame(spark)
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, *_ in awkward() if i not in (2, 3))


def test_chain_needs_the_order():
    a = np.arange(1, 101, dtype=np.uint64)
    assert order_minhash.chain(a, a[5:])
    assert not order_minhash.chain(a, np.concatenate([a[50:], a[:50]]))


def test_components_of_a_path_a_star_and_a_loop(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}


def plain_repeats(rows, size=100):
    """By (id, start): a row of a repeated id and text is the same place."""
    first, out = {}, {}
    for i, text in sorted({(float("inf") if i is None else i, t or "") for i, t in rows}):
        raw = text.encode()
        covered = np.zeros(len(raw), bool)
        for s in range(len(raw) - size + 1):
            if first.setdefault(raw[s : s + size], (i, s)) != (i, s):
                covered[s : s + size] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~covered])
        spans = int((covered & ~np.concatenate([[False], covered[:-1]])).sum()) if len(raw) else 0
        out[i] = (len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
def test_repeats_match_a_plain_search(spark, monkeypatch, small):
    if small:  # groups divided, chunks and segments cut everywhere
        for name, value in (("GROUP", 3), ("CHUNK", 5), ("PIECE_BYTES", 3000), ("SEGMENT", 700), ("SUFFIXES", 50)):
            monkeypatch.setattr(lpf_dedup, name, value)
    rng = random.Random(8)
    shared = [prose(30 + k, 25) for k in range(4)]
    rows = [(i, t) for i, t, *_ in awkward()]
    for i in range(100, 160):
        parts = [rng.choice([*shared, prose(rng.randrange(500), 12)]) for _ in range(rng.randint(1, 6))]
        rows.append((i, rng.choice(["", "é"]) + rng.choice([" ", "\n"]).join(parts)))
    rows += [(200, "ab" * 500), (201, "a" * 99), (202, "a" * 100), (203, "a" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = plain_repeats(rows)
    got = lpf_dedup.remove(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want[float("inf") if r.doc_id is None else r.doc_id], r.doc_id


def test_repeats_of_nothing(spark):
    assert lpf_dedup.remove(frame(spark, [])).count() == 0


def test_longest_previous_factor_of_a_text():
    text = b"abaababaabbabababaaabbaab"
    order = np.array(sorted(range(len(text)), key=lambda k: text[k:]))
    common = lambda a, b: next((n for n in range(len(text)) if text[a + n : a + n + 1] != text[b + n : b + n + 1] or max(a, b) + n >= len(text)), 0)
    lcp = np.array([0, *(common(a, b) for a, b in zip(order[1:], order[:-1], strict=True))])
    got = lpf_dedup.longest_previous(order, lcp)
    want = [max([common(j, k) for j in range(k)], default=0) for k in order]
    assert got.tolist() == want


def test_benchmark_items_are_found_with_substitutions(spark):
    rng = random.Random(6)
    items = [(k, prose(900 + k, n)) for k, n in enumerate([40, 60, 15, 8, 3, 200])] + [(50, None), (0, prose(900, 40))]
    texts = [t for _, t in items]
    tail = prose(77, 50)
    docs = [
        (1, tail + " " + texts[0].upper() + ", " + tail),
        (2, tail + " " + edited(texts[1], 6, rng) + " " + tail),
        (3, texts[2]),
        (4, "x " + texts[3] + " y"),
        (5, texts[4]),
        (6, tail),
        (7, " ".join(texts[5].split()[:90])),
        (8, " ".join(texts[5].split()[:20])),
        (9, None),
        (10, ""),
        (None, texts[2] + " " + texts[2]),
        (1, tail + " " + texts[0].upper() + ", " + tail),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, _row string, _seed int").repartition(3)
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table, bench).collect()}
    assert got == {(1, 0), (2, 1), (3, 2), (4, 3), (7, 5), (None, 2)}
    assert decontaminate.overlaps(table, bench).count() == len(got)
    kept = decontaminate.keep_clean(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 8, 9, 10]
    assert decontaminate.overlaps(table, bench.limit(0)).count() == 0
    assert decontaminate.overlaps(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("n, differ, ends", [(13, 2, 1), (14, 2, 1), (15, 3, 0), (20, 4, 0), (25, 5, 0)])
def test_masks_leave_a_seed_in_every_stretch(n, differ, ends):
    """Longer stretches hold a piece of 15 to 29 words, and so one of 15, 20 or 25, with no greater share that differs."""
    placed = [int(m, 2) << k for m in decontaminate.MASKS for k in range(n - len(m) + 1)]
    for some in combinations(range(ends, n - ends), differ):
        differing = sum(1 << k for k in some)
        assert any(not p & differing for p in placed), some


@pytest.mark.parametrize("n", range(5, 13))
def test_masks_of_short_items_spare_the_words_that_differ(n):
    masks = [int(m, 2) for m in decontaminate.masks_for(n)]
    for some in combinations(range(1, n - 1), n // 5):
        assert any(not m & sum(1 << k for k in some) for m in masks), some


@pytest.mark.parametrize("n, most", [(0, 28), (1, 28), (3000, 28), (3000, 17)])
def test_bitmap_holds_every_seed_and_little_else(spark, monkeypatch, n, most):
    """Room for 2 ** 18 cells at 3000 seeds; with half of that or less it still holds all of them."""
    monkeypatch.setattr(decontaminate, "MOST_BITS", most)
    rng = np.random.default_rng(n)
    seeds = rng.integers(-(2**63), 2**63, n)
    bitmap = decontaminate._bitmap(spark.createDataFrame([(int(s),) for s in [*seeds, *seeds[:9]]], "_seed long"))
    assert len(bitmap) * 64 == 1 << min(most, 18 if n > 1 else 16)
    assert len(decontaminate.may_hold(bitmap, seeds.view(np.uint64))) == n
    others = rng.integers(0, 2**64, 1 << 20, np.uint64)
    assert len(decontaminate.may_hold(bitmap, others)) <= (8 if most == 28 else 100)


def test_short_items_are_found_with_substitutions(spark):
    items = {0: "ab1 ab2 ab3 ab4 ab5", 1: " ".join(f"cd{k}" for k in range(11)), 2: " ".join(f"ef{k}" for k in range(15))}
    swaps = {0: [2], 1: [3, 7], 2: [3, 7, 11]}
    held = {i: " ".join("other" if k in swaps[i] else w for k, w in enumerate(t.split())) for i, t in items.items()}
    docs = spark.createDataFrame([(i, prose(60 + i, 40) + " " + t + " " + prose(70 + i, 40)) for i, t in held.items()], "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(i, i) for i in items}


def test_longest_stretch_matches_all_stretches():
    rng = np.random.default_rng(2)
    for _ in range(200):
        equal = rng.random(rng.integers(0, 25)) < 0.7
        best = max(
            (b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1)
             if equal[a] and equal[b - 1] and equal[a:b].mean() >= 0.8 - 1e-9), default=0)
        assert decontaminate.longest(equal)[0] == best


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


def test_mix_meets_targets(spark):
    docs = frame(spark)
    of = defaultdict(set)
    sizes, taken, target = Counter(), Counter(), {}
    for i, t, _, s, *_ in awkward():
        of[i].add(s)
        sizes[s] += len((t or "").split())
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(awkward())
    for r in rows:
        (source,) = of[r.doc_id]
        assert r.source_size == sizes[source] and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
        target[source] = r.target
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 1
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.taken(docs).collect()))
    assert mixing.taken(frame(spark, [])).count() == 0


def mixed_pieces(spark, monkeypatch):
    monkeypatch.setattr(mixing, "HALVINGS", 2)
    monkeypatch.setattr(mixing, "SPREAD_LEVEL", 2)
    docs = spark.createDataFrame([(k, prose(k, 20 + k % 50), "ab"[k % 3 > 0]) for k in range(300)], "doc_id long, text string, source string")
    return docs


def test_mix_slots_are_each_used_once(spark, monkeypatch):
    docs = mixed_pieces(spark, monkeypatch)
    sizes = mixing.document_sizes(docs, "text", "source", "doc_id")
    plan = mixing.source_plan(sizes)
    owed = {r._src: r._slots for r in plan.collect()}
    used, where = defaultdict(list), {}
    for r in mixing.slots(plan, shard_slots=16).collect():
        used[r._src].append(r.slot)
        where[r._src, r.slot] = r
    assert {s: sorted(v) for s, v in used.items()} == {s: list(range(n)) for s, n in owed.items()}
    shards = {r.shard for r in where.values()}
    assert shards == set(range(2 ** mixing.shards_for(sum(owed.values()), 16))) and len(shards) >= 16
    assert len({r.position for r in where.values()}) == len(where)
    _, pieces = mixing.mix(docs)
    words = Counter()
    for r in pieces.collect():
        assert 0 <= r.first_word and r.first_word + r.words <= r._size
        words[r._src, r.slot] += r.words
    assert words == {k: r._words for k, r in where.items()} and max(words.values()) <= mixing.BLOCK


def test_shard_counts_are_multinomial(spark):
    """Counts of each source over shards: exact totals, spread and fit of a multinomial draw, small and large counts."""
    plan = spark.createDataFrame([(1, 600), (2, 64_000), (3, 10_000_000), (4, 1), (5, 0)], "_src int, _slots long")
    rows = mixing.shard_counts(plan, seed=3, shard_slots=40_000).collect()
    shards = 2 ** mixing.shards_for(10_064_601, 40_000)
    assert shards == 256
    for source, total in ((1, 600), (2, 64_000), (3, 10_000_000), (4, 1)):
        counts = np.zeros(shards)
        runs = []
        for r in rows:
            if r._src == source:
                counts[r.shard] += r._count
                runs.append((r._begin, r._begin + r._count))
        runs.sort()
        assert runs[0][0] == 0 and runs[-1][1] == total and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
        if total >= 600:
            mean = total / shards
            chi = ((counts - mean) ** 2 / mean).sum()  # chi-squared with 255 degrees of freedom
            assert 255 - 5 * np.sqrt(510) < chi < 255 + 5 * np.sqrt(510), (source, chi)
    assert rows != mixing.shard_counts(plan, seed=4, shard_slots=40_000).collect()


@pytest.mark.parametrize("n", [1, 5, 62, 63, 64, 200, 4096, 4097, 10**6])
def test_binomial_halves(spark, n):
    got = spark.range(2000).select(mixing.binomial(F.lit(n).cast("long"), F.lit(7), F.col("id")).alias("k")).toPandas()["k"].to_numpy()
    assert got.min() >= 0 and got.max() <= n
    assert abs(got.mean() - n / 2) < 5 * np.sqrt(n / 4 / 2000)
    assert abs(got.var() / (n / 4) - 1) < 5 * np.sqrt(2 / 2000)


def test_mix_of_a_hot_source_goes_through_its_shards(spark, monkeypatch):
    """Buckets, shards and tasks all smaller than the one source that holds nearly all rows."""
    for name, value in (("BUCKET_ROWS", 7), ("SHARD_SLOTS", 8), ("SLOTS_A_TASK", 64), ("HALVINGS", 2), ("SPREAD_LEVEL", 4)):
        monkeypatch.setattr(mixing, name, value)
    monkeypatch.setattr(mixing.slots, "__defaults__", (0, 8))
    rows = [(k, prose(k, 30 + k % 90), "hot") for k in range(400)] + [(1000 + k, prose(k, 500), "cold") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    out = mixing.taken(docs)
    assert "shard" in out._jdf.queryExecution().optimizedPlan().toString()
    sizes = Counter({s: sum(len(t.split()) for _, t, o in rows if o == s) for s in ("hot", "cold")})
    want, taken = plain_targets(sizes), Counter()
    source = {i: s for i, _, s in rows}
    for r in out.collect():
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_permutation_is_a_bijection(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 7, 100, 1023, 5000):
        rows = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_pipeline_stages_take_effect(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from lamina.session import stage

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first, held = docs, {}
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, sf_dir), "test")
        held[name] = out
        if name != "mixing":
            assert out.columns == first.columns
        assert set(r.doc_id for r in out.select("doc_id").collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())
        docs = out
    deduped = plain_classes([(r.doc_id, r.text) for r in held["quality_classifier"].collect()])
    assert {r.doc_id for r in held["near_dedup"].collect()} == set(deduped.values())
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.overlaps(held["decontamination"], bench).count() == 0
    from lamina.llm import secret_scan

    assert secret_scan.scan(held["secret_scan"]).where("spans <> ''").count() == 0
    assert held["secret_scan"].where("n_chars <> length(text)").count() == 0
    assert held["mixing"].count() == held["secret_scan"].count()
    got = Counter(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert got == Counter(map(tuple, held["mixing"].collect()))


def test_pipeline_on_awkward_rows(spark, sf_dir):
    import corpus_pipeline

    for rows in (None, []):
        docs = frame(spark, rows)
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, sf_dir)
            if name != "mixing":
                assert out.columns == docs.columns
                docs = out
        assert out.count() <= len(awkward() if rows is None else rows)

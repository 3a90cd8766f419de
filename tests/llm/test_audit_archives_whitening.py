"""Source divergence, record archives and whitening against plain versions."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import awkward, frame, prose

from lamina.llm import divergence, warc, whitening

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, most=200):
    """All rows of the audit, densely, with Python's integers."""
    docs = [(g or "", s or "", Counter(TERM.findall((t or "").translate(LOWER)))) for t, g, s in rows]
    out = []
    for lang in {g for g, _, _ in docs}:
        own = [(s, v) for g, s, v in docs if g == lang]
        df = Counter(t for _, v in own for t in v)
        kept = sorted(t for t in df if df[t] >= 3)
        sums = defaultdict(Counter)
        for s, v in own:
            sums[s].update({t: c for t, c in v.items() if df[t] >= 3})
        total = sum(sums.values(), Counter())

        def share(c, kept=kept):
            n = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in sums.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sums:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sums if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if sums[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked) if part == "pair" or k < most]
    return Counter(out)


def corpus():
    rows = [(t, g, s) for _, t, g, s, _ in [r[:5] for r in awkward()]]
    for k in range(60):
        rows.append((prose(k, 30) + " É" + "xyz"[k % 3] + " ÜnderK", ["en", "fr", None][k % 3], f"s{k * k % 5}"))
    return rows + [(" ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)), "many", "a")] * 3 + [("q", "many", "b")]


@pytest.mark.parametrize("small", [False, True])
def test_audit_matches_a_dense_sum(spark, monkeypatch, small):
    if small:  # sums handed on early, pairs cut everywhere
        monkeypatch.setattr(divergence, "HELD", 20)
        monkeypatch.setattr(divergence, "PAIRS", 7)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, value int, term string")
    got = Counter(map(tuple, divergence.audit(docs.repartition(4)).collect()))
    assert got == plain_audit(rows)


def test_audit_without_kept_terms_and_of_nothing(spark):
    docs = spark.createDataFrame([("a b", "x", "s"), ("c", "x", "t"), (None, None, None)], "text string, lang string, source string")
    assert sorted(map(tuple, divergence.audit(docs).collect())) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]
    assert divergence.audit(frame(spark, [])).count() == 0


def test_vectors_equal_those_of_count_vectorizer(spark):
    from pyspark.ml.feature import CountVectorizer

    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(corpus())], "doc_id long, text string, lang string, source string")
    held = divergence.vectors(docs).where("lang = 'fr'").cache()
    words = held.select("doc_id", F.flatten(F.transform(F.arrays_zip("terms", "counts"), lambda x: F.array_repeat(x["terms"], x["counts"].cast("int")))).alias("w"))
    model = CountVectorizer(inputCol="w", outputCol="v", minDF=3, vocabSize=2**31 - 1).fit(words)
    vocabulary = {r.term for r in divergence.vocabulary(docs).where("lang = 'fr'").collect()}
    assert vocabulary == set(model.vocabulary)
    ours = {r.doc_id: {t: c for t, c in zip(r.terms, r.counts) if t in vocabulary} for r in held.collect()}
    for r in model.transform(words).collect():
        assert {model.vocabulary[i]: c for i, c in zip(r.v.indices, r.v.values)} == ours[r.doc_id]


def test_share_needs_no_more_than_64_bits(spark):
    rows = [(0, 1), (5, 7), (10**12, 10**12 + 1), (3 * 10**14, 9 * 10**14)]
    got = spark.createDataFrame(rows, "c long, n long").select(divergence.share(F.col("c"), F.col("n")).alias("p"))
    assert [r.p for r in got.collect()] == [1 + 10**9 * (c + 1) // n for c, n in rows]


def pages():
    """Copies, empty and null payloads and ids, repeated rows, a payload of many chunks, odd uris."""
    rng = np.random.default_rng(3)
    large = rng.integers(0, 250, 700_000).astype(np.uint8).tobytes().decode("latin-1")
    rows = [(k, f"http://h/{k}", prose(k % 40, 30)) for k in range(200)]
    rows += [(500, None, None), (501, "u\r\nWARC-Type: x é", ""), (None, "n", "only"), (None, "n", prose(1, 30))]
    return rows + [(-7, "a", "same"), (-7, "b", "same"), (-6, "c", "same"), (900, "big", large), (899, "big", large), (901, "crlf", "\r\n\r\nWARC/1.1\r\n")]


def plain_records(rows, least):
    first = {}
    for i, _, t in rows:
        key, raw = float("inf") if i is None else i, (t or "").encode()
        first[raw] = min(first.get(raw, key), key)
    out = []
    for i, _, t in rows:
        raw = (t or "").encode()
        revisit = len(raw) >= least and (float("inf") if i is None else i) != first[raw]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "revisit" if revisit else "response", first[raw] if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("least, file_bytes", [(0, 1 << 30), (6, 3000)])
def test_archives_round_trip(spark, least, file_bytes):
    rows = pages()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, _data int, _id string").repartition(3)
    files = warc.write(docs, warc.new_folder(spark), least_bytes=least, file_bytes=file_bytes, chunk_bytes=1000)
    chunks = warc.read(files, chunk_bytes=700).cache()
    found = warc.records(chunks)
    got = Counter(tuple(r) for r in found.select("id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = plain_records(rows, least)
    assert got == want and found.where("not intact").count() == 0
    light = warc.records(warc.read(files, payload=False))
    assert Counter(map(tuple, light.collect())) == Counter(map(tuple, found.collect()))
    # Chunks in order make up the payloads, each with the length and digest so far.
    held = defaultdict(list)
    for r in chunks.where("record_type = 'response'").collect():
        held[r.file, r.record].append((r.chunk, bytes(r.data), r.bytes_so_far, r.digest_so_far))
    bodies = Counter()
    for parts in held.values():
        whole = b""
        for _, data, size, digest in sorted(parts):
            whole += data
            assert len(data) <= 700 and size == len(whole) and digest == base64.b32encode(hashlib.sha1(whole).digest()).decode()
        bodies[whole] += 1
    responses = sum(n for r, n in want.items() if r[3] == "response")
    assert sum(bodies.values()) == responses and set(bodies) == {(t or "").encode() for _, _, t in rows}
    assert files.count() > (20 if file_bytes == 3000 else 0)
    assert files.agg(F.sum("records")).first()[0] == len(rows)


def test_archives_of_nothing(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write(none, warc.new_folder(spark))
    assert warc.records(warc.read(files)).count() == 0


def test_damaged_and_foreign_archives(spark, tmp_path):
    head = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:uuid:1>\r\n%sContent-Length: %d\r\n\r\n"
    right = base64.b32encode(hashlib.sha1(b"hello").digest())
    plain = head % (b"request", b"", 3) + b"GET\r\n\r\n"
    plain += head % (b"response", b"WARC-Payload-Digest: sha1:" + right + b"\r\nX-Folded: a\r\n b\r\n", 5) + b"hello\r\n\r\n"
    plain += head % (b"response", b"WARC-Payload-Digest: sha1:" + right + b"\r\n", 5) + b"hallo\r\n\r\n"
    plain += head % (b"response", b"", 50) + b"ends early"
    (tmp_path / "a.warc").write_bytes(plain)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain))
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.warc", "b.warc.gz")], "file string")
    rows = warc.read(files, chunk_bytes=4).where("last").orderBy("file", "record").collect()
    assert [(r.record_type, r.bytes_so_far, r.intact) for r in rows[:4]] == [
        ("request", 3, True), ("response", 5, True), ("response", 5, False), ("response", 10, False)]
    assert [tuple(r)[1:] for r in rows[:4]] == [tuple(r)[1:] for r in rows[4:]]
    assert warc.records(warc.read(files)).where("id is null and refers_to is null").count() == 6


def plain_whitening(rows):
    x = np.floor(1024 * np.array(rows, np.float64)).astype(np.int64) + 100000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, s, x, c, e[::-1], v[:, ::-1]


def vectors_frame(spark, rows, kind="float"):
    return spark.createDataFrame([(k, r, "x") for k, r in rows], f"vec_id long, embedding array<{kind}>, _v string").repartition(4)


@pytest.mark.parametrize("width, n, step", [(64, 700, 0.0), (12, 300, 0.3), (9, 40, 0.0), (5, 50, 0.0)])
def test_whitening_matches_a_dense_decomposition(spark, width, n, step):
    rng = np.random.default_rng(width)
    rows = (rng.standard_normal((n, width)) * np.exp(-step * np.arange(width)) + rng.standard_normal(width) * 50).astype(np.float32)
    odd = [(1000, None), (1001, []), (1002, [None] * width), (1003, [float("nan")] * width), (1004, [float("inf")] * width), (None, rows[0].tolist()), (3, rows[3].tolist()), (1005, [1.0] * (width + 1)), (1006, [1e30] * width)]
    docs = vectors_frame(spark, [(k, r.tolist()) for k, r in enumerate(rows)] + odd)
    n, s, x, c, e, v = plain_whitening(np.vstack([rows, rows[:1], rows[3:4]]))
    model = whitening.fit(docs)
    many = min(8, width)
    assert model.n == n and model.sums == s.tolist() and len(model.variances) == many
    assert np.allclose(model.variances, e[:many], rtol=1e-11) and np.allclose(model.explained, e[:many] / e.sum(), rtol=1e-11)
    assert model.identity_error < 1e-9
    got = defaultdict(list)
    for r in whitening.whiten(docs, model).collect():
        got[r.vec_id].append(r)
    assert set(got) == {*range(len(rows)), None} and len(got[3]) == 2 * many
    turned = c @ v[:, :many] / np.sqrt(e[:many])
    for k in (0, 1, 17):
        own = sorted(got[k], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, many + 1)) and {r.n for r in own} == {n}
        assert {r.deviation for r in own} == {int(((n * x[k].astype(object) - s) ** 2).sum())}
        assert np.allclose(np.abs([r.whitened for r in own]), np.abs(turned[k]), atol=1e-7)
    signs = np.sign([[r.whitened for r in sorted(got[k], key=lambda r: r.component)] for k in range(4, 20)] * np.sign(turned[4:20]))
    assert (signs == signs[0]).all()


def test_whitening_of_repeated_eigenvalues_and_low_rank(spark):
    corners = [[a * (k == j) for j in range(12)] for k in range(12) for a in (1.0, -1.0)]
    model = whitening.fit(vectors_frame(spark, list(enumerate(corners))))
    assert np.allclose(model.variances, 1024**2 / 12) and model.identity_error < 1e-9
    flat = [[float(k), 2.0 * k, 1.0, float(k % 3)] for k in range(30)]
    docs = vectors_frame(spark, list(enumerate(flat)), "double")
    model = whitening.fit(docs)
    assert len(model.variances) == 2 and model.identity_error < 1e-9 and whitening.whiten(docs, model).count() == 60


def test_whitening_of_rows_without_components(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(k, [3.0, 4.0]) for k in range(5)], [(1, None), (2, [])]):
        docs = vectors_frame(spark, rows)
        assert whitening.whiten(docs, whitening.fit(docs)).count() == 0


def test_deviation_beyond_64_bits_is_null():
    n, sums = 10**9, [10**14, 10**14]
    x = np.array([[100000, 100001], [100000, 10**9]])
    assert whitening.deviations(x, n, sums) == [10**18, None]
    assert whitening.deviations(np.array([[3], [4]]), 2, [7]) == [1, 1]

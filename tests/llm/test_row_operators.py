"""Operators that judge rows one by one: rules, urls, tokens, secrets, language, quality."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from samples import awkward, frame, prose

from lamina.llm import language_id, quality_classifier, quality_rules, secret_scan, token_counts, url_filter

SPACES = " \t\n\x0b\x0c\r"


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_rules_match_a_plain_count(spark):
    got = quality_rules.judge(frame(spark)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter((i, *plain_rules(t)) for i, t, *_ in awkward())
    assert Counter(tuple(r) for r in got.collect()) == want


def test_rules_on_an_empty_table_and_a_junk_row(spark):
    assert quality_rules.judge(frame(spark, [])).count() == 0
    rows = {r.doc_id: r for r in quality_rules.judge(frame(spark)).where("doc_id in (1, 13)").collect()}
    assert rows[1].kept and rows[1].failed_rule is None
    assert not rows[13].kept and rows[13].failed_rule is not None


def test_urls_without_host_and_ties_of_rules(spark):
    urls = [
        (1, "HTTP://WWW.Example.NET/en/x?y"),
        (2, "https://example.net/de/x"),
        (3, "http://net"),
        (4, "nothing"),
        (5, None),
        (6, "a://b.ORG/fr/"),
        (6, "a://b.ORG/fr/"),
        (None, "x://notexample.com/de/q#z"),
        (8, "x://a.example.com/de/"),
        (9, "x://host?a=/b"),
    ]
    pages = spark.createDataFrame([(*u, "extra", "h") for u in urls], "page_id long, url string, _host string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got == {
        (1, "www.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "example.net", "/de/x", "net/", "block"),
        (3, "net", "", None, "allow"),
        (4, "", "", None, "allow"),
        (5, "", "", None, "allow"),
        (6, "b.org", "/fr/", "org/fr/", "allow"),
        (None, "notexample.com", "/de/q", None, "allow"),
        (8, "a.example.com", "/de/", "example.com/de/", "block"),
        (9, "host", "", None, "allow"),
    }
    assert url_filter.judge(pages).count() == len(urls)
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_pure_templates_are_blocked_and_merged_branches_share_a_fate(spark):
    rules = (("block", "h.org", "/a/bad"), ("block", "h.org", "/b/bad"))
    rows = [(i, f"x://h.org/{'ab'[i % 2]}/bad{i}") for i in range(60)] + [(100, "x://h.org/a/new"), (101, "x://h.org/c/new")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, rules).collect()}
    assert got[100].verdict == "block" and got[100].rule is None
    assert got[0].template == got[1].template == "/*a+/*-" and got[100].template == "/*a+/*a"


def test_clean_branches_are_kept_apart_from_blocked_ones(spark):
    """One blocked branch, one large clean one, and clean single sections; many sections, each below the share."""
    rules = (("block", "a.org", "/de/"), ("block", "b.org", "/s0/"))
    urls = [f"x://a.org/de/{i}" for i in range(50)] + [f"x://a.org/en/{i}" for i in range(500)]
    urls += [f"x://a.org/s{i}/0" for i in range(10)] + [f"x://b.org/s{k}/{i}" for k in range(30) for i in range(25)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[r.page_id]: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert got == {u: "block" if u.startswith(("x://a.org/de/", "x://b.org/s0/")) else "allow" for u in urls}


def branching_urls():
    """Hosts on which undecided urls are rejected, borrow from the node above, or merge by what lies below."""
    urls = [f"x://a.org/{'ab'[k % 2]}/bad{k}/x" for k in range(80)] + [f"x://a.org/a/new{k}" for k in range(6)]
    urls += [f"x://b.org/{s}/{k}" for s in ("en", "fr", "it") for k in range(30)] + [f"x://b.org/shop/{k}/cart" for k in range(30)]
    urls += [f"x://b.org/blog/post{k}" for k in range(30)] + [f"x://b.org/{k}" for k in range(40)]
    urls += [f"x://c.org/p/{k}/bad" for k in range(9)] + [f"x://c.org/p/{k}/good" for k in range(50)] + ["x://c.org/p/1/bad/2/3/4/5"]
    urls += [f"x://d.org/{'s' * 5000}/{k}" for k in range(5)] + ["x://d.org/" + "/".join(map(str, range(3000)))]
    return [(k, u) for k, u in enumerate(urls)]


BRANCH_RULES = (("block", "a.org", "/a/bad"), ("block", "a.org", "/b/bad"), ("block", "c.org", "/p/1"), ("allow", "c.org", "/p/2"))


def test_urls_rejected_and_merged_by_their_children(spark):
    rows = branching_urls()
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), BRANCH_RULES).collect()
    assert len(found) == len(rows)
    of = {dict(rows)[r.page_id]: r for r in found}
    assert {of[f"x://a.org/a/new{k}"].verdict for k in range(6)} == {"block"}  # the node above is nearly all blocked
    assert {of[f"x://b.org/{s}/1"].template for s in ("en", "fr", "it")} == {"/*a9/*9"}
    assert of["x://b.org/shop/1/cart"].template == "/*a9/*9/cart" and of["x://b.org/blog/post1"].template == "/blog/*-"
    assert of["x://b.org/7"].template == "/*9"
    assert of["x://c.org/p/30/good"].verdict == "allow"
    assert {r.verdict for r in found if r.host == "d.org"} == {"allow"}


def test_url_sql_agrees_where_branches_merge(spark, tmp_path, monkeypatch):
    import duckdb
    from parity import compare

    from lamina.llm import queries

    monkeypatch.setattr(url_filter, "RULES", BRANCH_RULES)
    monkeypatch.setattr(url_filter.judge, "__defaults__", (BRANCH_RULES, *url_filter.judge.__defaults__[1:]))
    spark.createDataFrame(branching_urls(), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    run = queries.QUERIES["op2_url_filter"]
    assert compare(spark, con, str(tmp_path), "op2_url_filter", run, queries._urls_sql()) is None
    assert run(spark, str(tmp_path)).where("rule is null and verdict = 'block'").count() > 0


def library_counts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts_match_the_library(spark):
    import public_tokenizers

    got = token_counts.token_counts(frame(spark), public_tokenizers.path("byte_bpe_50k.json"), 1024, piece_bytes=5000)
    rows = awkward()
    want = Counter(
        (r[0], len((r[1] or "").encode()), n, n > 1024) for r, n in zip(rows, library_counts([r[1] for r in rows]), strict=True)
    )
    assert Counter(tuple(r) for r in got.collect()) == want


def test_token_counts_of_random_texts():
    import public_tokenizers

    merges = token_counts._merges(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    parts = [*"aabst'' \n\t\r é1２!.,<|>", "<|endoftext|>", "'ll", " '", "'re", "\U0001f600", "aaaaaaa", "　", "the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    got = token_counts.count_piece(np.frombuffer(b"".join(raw), np.uint8), offsets, merges)
    assert got.tolist() == library_counts(texts)


def test_tokenizer_files_that_are_refused(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        held = json.load(f)
    assert token_counts.refusal(held) is None
    changes = [
        {"normalizer": {"type": "NFC"}},
        {"pre_tokenizer": {"type": "Whitespace"}},
        {"pre_tokenizer": {**held["pre_tokenizer"], "add_prefix_space": True}},
        {"model": {**held["model"], "byte_fallback": True}},
        {"model": {**held["model"], "type": "Unigram"}},
        {"added_tokens": [{"content": "<x>", "lstrip": True}]},
        {"model": {**held["model"], "vocab": {"a": 0}}},
    ]
    for k, change in enumerate(changes):
        file = tmp_path / f"{k}.json"
        file.write_text(json.dumps({**held, **change}))
        with pytest.raises(ValueError):
            token_counts.Merges(str(file))


def test_tables_of_merges_grow_with_them(tmp_path):
    """More merges than a fixed table would hold: every pair of two-letter symbols."""
    import json

    letters = token_counts._byte_letters()
    vocab = {c: k for k, c in enumerate(letters)}
    merges = []
    for a in letters:
        for b in letters[:40]:
            merges.append([a, b])
            vocab[a + b] = len(vocab)
    for left, right in [(m, n) for m in merges[:600] for n in merges[:600]]:
        merges.append(["".join(left), "".join(right)])
        vocab.setdefault("".join(left + right), len(vocab))
    file = tmp_path / "large.json"
    base = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    file.write_text(json.dumps({**base, "model": {"type": "BPE", "vocab": vocab, "merges": merges}}))
    made = token_counts.Merges(str(file))
    assert len(merges) > 2**18 and len(made.keys) >= 2 * len(merges)
    pair = np.array([vocab["".join(merges[-1][0])]]), np.array([vocab["".join(merges[-1][1])]])
    assert made.rank(*pair)[0] == len(merges) - 1


BASE = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def plain_spans(text):
    found = [
        (m.start(), k, m.end(), name)
        for k, (name, pattern, group, least) in enumerate(BASE)
        for m in pattern.finditer(text or "")
        if len(m.group(group)) >= least
    ]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def secret_texts():
    rng = random.Random(9)
    parts = ["token", "secret=", "API_KEY: ", "password", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH1234567890", "deadbeef" * 3, "\U0001f600", "é", "zz", "0123456789", "x.y-z_" * 3, "\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]


def test_base_spans_match_plain_patterns(spark):
    texts = [t for _, t, *_ in awkward()] + secret_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(docs).collect()}
    for i, text in enumerate(texts):
        spans = plain_spans(text)
        written = ",".join(f"{n}:{a}:{b}" for n, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("random")] == [s for s in written.split(",") if s]


def test_random_tokens_are_found_and_ordinary_ones_left(spark):
    rng = random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(rng.choice(letters) for _ in range(44)) for _ in range(200)]
    plain = [f"chapter_{i:03d}_of_the_long_report_file" for i in range(200)]
    rows = [(i, f"use {k} here and {p} there") for i, (k, p) in enumerate(zip(keys, plain, strict=True))]
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum("random:4:48" in r.spans for r in got) >= 170
    assert sum(r.n_random for r in got) <= sum("random:4:48" in r.spans for r in got) + 10
    assert len({k for k in keys}) == 200


ALPHABETS = {
    "digits": "0123456789",
    "hex upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}


def long_words(rng, n, least):
    parts = "tion ing heit keit lich ung ment er en the re ver ein bar schaft able ness ist".split()
    out = []
    while len(out) < n:
        word = ""
        while len(word) < least:
            word += rng.choice(parts)
        out.append(word)
    return out


@pytest.mark.parametrize("size", [16, 19, 24, 32, 48, 64, 128])
def test_random_tokens_of_every_encoding_and_length(spark, size):
    """Recall by encoding among as many long words; the false share stays near its bound."""
    rng = random.Random(size)
    rows, words = [], long_words(rng, 300, size)
    for name, letters in ALPHABETS.items():
        rows += [(name, "".join(rng.choice(letters) for _ in range(size))) for _ in range(60)]
    texts = [(k, f"see {t} and") for k, (_, t) in enumerate(rows)] + [(10_000 + k, f"see {w} and") for k, w in enumerate(words)]
    found = {r.doc_id for r in secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string")).where("spans <> ''").collect()}
    hits = Counter(rows[k][0] for k in found if k < 10_000)
    mixed = [n for n in ALPHABETS if n not in ("digits", "letters")]
    assert sum(hits[n] for n in mixed) >= 0.85 * 60 * len(mixed), hits
    if size >= 24:
        assert hits["digits"] + hits["letters"] >= 60, hits
    wrong = sum(k >= 10_000 for k in found)
    assert wrong <= 0.15 * len(found), (wrong, len(found))


def test_long_words_alone_have_no_cut(spark):
    words = [w for n in (16, 20, 30, 50) for w in long_words(random.Random(n), 500, n)]
    docs = spark.createDataFrame([(k, f"a {w} b") for k, w in enumerate(words)], "doc_id long, text string")
    assert secret_scan.scan(docs).where("spans <> ''").count() == 0
    lone = spark.createDataFrame([(1, "key is Zx81kPq0LmV7tRw3Yb5N here")], "doc_id long, text string")
    assert secret_scan.scan(lone).first().n_random == 1


def plain_battery(token):
    """p-value by chi-squared, runs and lag-1 tests, with exact normal tails."""
    from math import erfc, sqrt

    letters = next(a for p, a in secret_scan.ENCODINGS if re.search(p, token))
    n, size = len(token), len(letters)
    tail = lambda z: erfc(z / sqrt(2)) / 2
    chi = sum((token.count(c) - n / size) ** 2 for c in letters) / (n / size)
    k = size - 1
    uniform = tail(((chi / k) ** (1 / 3) - (1 - 2 / (9 * k))) / sqrt(2 / (9 * k)))
    x = np.array([letters.index(c) + 1 for c in token], float)
    gap = x - x.mean()
    serial = (gap[1:] * gap[:-1]).sum() / max((gap**2).sum(), 1e-9)
    high = int((x > size / 2).sum())
    runs = 1 + int(((x[1:] > size / 2) != (x[:-1] > size / 2)).sum())
    expected = 2 * high * (n - high) / n + 1
    deviation = sqrt(max((expected - 1) * (expected - 2) / (n - 1), 1e-9))
    by_runs, by_lag = 2 * tail(abs((runs - expected) / deviation)), 2 * tail(abs((serial + 1 / n) * sqrt(n)))
    return min(1.0, 3 * min(uniform, by_runs, by_lag))


def test_battery_matches_plain_tests(spark):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    tokens = ["".join(rng.choice(a) for _ in range(rng.randint(16, 130))) for a in ALPHABETS.values() for _ in range(30)]
    tokens += long_words(rng, 60, 20) + ["a" * 20, "0" * 16, "ab" * 30, "A1" * 9, "+/" * 10, "-_-_" * 6, "0123456789abcdefghij"]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", secret_scan.battery(F.col("t")).alias("p")).collect()
    for r in got:
        assert abs(r.p - plain_battery(r.t)) < 0.004, (r.t, r.p, plain_battery(r.t))


def test_redaction_keeps_rows_columns_and_other_text(spark):
    docs = frame(spark)
    clean = secret_scan.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    by_id = {r.doc_id: r.text for r in clean.collect()}
    assert by_id[11] == '[secret][secret]"'.replace('[secret][secret]"', '[secret]" [secret] [secret] \U0001f600 api_key: short')
    assert by_id[4] is None and by_id[1] == awkward()[0][1]
    assert secret_scan.redact(frame(spark, [])).count() == 0


def test_language_is_learned_from_text_alone(spark):
    say = {"aa": "kolo mira tuna pelo ", "bb": "strunz grabt kwelch "}
    rng = random.Random(2)
    rows = [
        (i, "".join(rng.choice(say[g].split()) + " " for _ in range(rng.randint(3, 200))), g, None, None, "", "", 0, 0.0)
        for i, g in enumerate(["aa", "bb"] * 100)
    ]
    net = language_id.fit(frame(spark, rows[:120]))
    got = {r.doc_id: r for r in language_id.predict(frame(spark, rows), net).collect()}
    assert sum(got[i].lang_pred == g for i, _, g, *_ in rows[120:]) >= 78
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "kolo"), (None, "strunz " * 5000), (4, "kolo")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    seen = Counter((r.doc_id, r.lang_pred) for r in language_id.predict(docs, net, piece_bytes=100).collect())
    assert seen == Counter({(1, "und"): 1, (2, "und"): 1, (3, "und"): 1, (4, "aa"): 2, (None, "bb"): 1})
    assert all(0 <= r.score <= 1 for r in language_id.predict(docs, net).collect())
    assert language_id.fit(frame(spark, [])) is None
    assert {r.lang_pred for r in language_id.predict(docs, None).collect()} == {"und"}


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    net = language_id.Network.fresh(["a", "b", "c"], rng)
    windows = rng.integers(1, 255, (6, 40)).astype(np.uint8)
    wanted = np.array([0, 1, 2, 0, 1, 2])

    def loss():
        return -net.log_shares(net.features(windows, net.pair_tables())[0].astype(np.float64))[np.arange(6), wanted].mean()

    grads = net.gradients(windows, wanted)
    for weight, grad in zip(net.weights(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        held, step = weight[at], 1e-3
        weight[at] = held + step
        up = loss()
        weight[at] = held - step
        down = loss()
        weight[at] = held
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.1, abs=1e-3)


def test_quality_is_learned_and_rejected_rows_go(spark):
    rows, labels = [], []
    for i in range(200):
        good = i % 4 > 0
        words = prose(i, 80).split()
        text = " ".join(words if good else [w.upper() + "!!" for w in words])
        rows.append((i, text, None, None, len(text), "", "", 0, 0.0))
        labels.append((i, int(good), 0))
    docs = frame(spark, rows)
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(docs, marked.where("doc_id < 150"))
    got = {r.doc_id: r.predicted for r in quality_classifier.score(docs, model).collect()}
    assert all(got[i] == int(i % 4 > 0) for i in range(150, 200))
    kept = quality_classifier.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, p in got.items() if p}
    odd = quality_classifier.score(frame(spark), model, piece_bytes=1000).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 for r in odd)
    assert len({r.score for r in odd if r.doc_id in (4, 5)}) == 1


@pytest.mark.parametrize("rows", [[], [(1, 1, 0)], [(None, 0, 0), (2, None, 0)]])
def test_quality_without_two_labels(spark, rows):
    marked = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(frame(spark), marked)
    scores = {round(r.score, 6) for r in quality_classifier.score(frame(spark), model).collect()}
    assert len(scores) == 1 and (not rows or rows[0][0] is None) == (scores == {0.5})

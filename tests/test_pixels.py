"""Folder composition against a plain renderer, tall stacks, geometry."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.operators import groups
from lamina.operators import pixels as P

MODES = ("normal", "multiply", "screen", "difference")


def store(v):
    return min(255, max(0, round(v)))


def over(mode, s, d, alpha):
    t = int(s[3] * alpha * 32897)
    w = [(t * d[3]) >> 23, (t * (255 - d[3])) >> 23, ((8388735 - t) * d[3]) >> 23]
    a = sum(w)
    if not a:
        return (*d[:3], a)
    rule = {
        "normal": lambda x, y: x, "multiply": lambda x, y: x * y // 255,
        "screen": lambda x, y: x + y - x * y // 255, "difference": lambda x, y: abs(x - y),
    }[mode]
    return (*[store((rule(x, y) * w[0] + x * w[1] + y * w[2]) / a) for x, y in zip(s[:3], d[:3])], a)


class Renderer:
    """One pixel of one document, drawn layer by layer."""

    def __init__(self, layers, pixels, masks):
        self.layers, self.pixels, self.masks = layers, pixels, masks

    def kids(self, parent):
        return sorted((r for r in self.layers if r["parent_seq_id"] == parent), key=lambda r: r["ordinal"])

    def mask(self, n, spot):
        return self.masks.get((n["seq_id"], *spot), n["mask_default"])

    def paint(self, parent, canvas, spot, factor=None):
        base = None
        kids = self.kids(parent)
        for n in kids:
            if n["clipping"]:
                continue
            clips = []
            for k in kids[kids.index(n) + 1:]:
                if not k["clipping"]:
                    break
                clips.append(k)
            canvas = self.draw(n, clips, canvas, spot, factor)
        return canvas

    def draw(self, n, clips, canvas, spot, factor):
        if not n["visible"] or not n["opacity"]:
            return canvas
        alpha = n["opacity"] / 255 if factor is None else n["opacity"] * factor / 255
        if n["folder"] and n["blend_mode"] == "pass-through":
            out = self.paint(n["seq_id"], canvas, spot, alpha)
            if n["mask_default"] is not None:
                m = self.mask(n, spot)
                out = tuple(g * m // 255 + b * (255 - m) // 255 for g, b in zip(out, canvas))
            return out
        px = self.flat(n, spot)
        if px is None:
            return canvas
        if clips and n["blend_clipped"]:
            inner = (*px[:3], 255)
            for c in clips:
                inner = self.draw(dict(c, clipping=False), [], inner, spot, None)
            px = (*inner[:3], px[3])
            clips = []
        canvas = over(n["blend_mode"], px, canvas, alpha)
        for c in clips:
            top = self.flat(c, spot) if c["visible"] and c["opacity"] else None
            if top is not None:
                cut = (*top[:3], store(top[3] * px[3] / 255))
                canvas = over(c["blend_mode"], cut, canvas, self.alpha(c, factor))
        return canvas

    def alpha(self, n, factor):
        return n["opacity"] / 255 if factor is None else n["opacity"] * factor / 255

    def flat(self, n, spot):
        px = self.paint(n["seq_id"], (0, 0, 0, 0), spot) if n["folder"] else self.pixels.get((n["seq_id"], *spot))
        if px is None or n["mask_default"] is None:
            return px
        return (*px[:3], px[3] * self.mask(n, spot) // 255)


def document(seed):
    rng = random.Random(seed)
    layers, pixels, masks = [], {}, {}
    folders = [(-1, 0)]
    for seq in range(1, 16):
        parent, depth = rng.choice(folders)
        folder = depth < 2 and rng.random() < 0.35
        clipping = rng.random() < 0.25
        mode = rng.choice(["pass-through", "normal", "multiply"]) if folder else rng.choice(MODES)
        if clipping and mode == "pass-through":
            mode = "normal"
        layers.append(dict(
            doc_id=seed, seq_id=seq, parent_seq_id=parent, ordinal=seq, folder=folder, visible=rng.random() < 0.85,
            opacity=rng.choice([0, 127, 191, 255, 255]), blend_mode=mode, clipping=clipping, blend_clipped=rng.random() < 0.6,
            mask_default=rng.choice([None, None, 0, 255])))
        if folder:
            folders.append((seq, depth + 1))
        for x in range(2):
            for y in range(2):
                if not folder and rng.random() < 0.8:
                    pixels[seq, x, y] = tuple(rng.randint(0, 255) for _ in range(4))
                if layers[-1]["mask_default"] is not None and rng.random() < 0.6:
                    masks[seq, x, y] = rng.randint(0, 255)
    return layers, pixels, masks


def test_groups_match_plain_renderer(spark):
    layers, pixels, masks, want = [], [], [], {}
    for seed in range(24):
        own, px, mk = document(seed)
        layers += own
        pixels += [(seed, *k, *v) for k, v in px.items()]
        masks += [(seed, *k, v) for k, v in mk.items()]
        r = Renderer(own, px, mk)
        for x in range(2):
            for y in range(2):
                want[seed, x, y] = r.paint(-1, (0, 0, 0, 0), (x, y))
    schema = "doc_id long, seq_id long, parent_seq_id long, ordinal long, folder boolean, visible boolean, opacity int, blend_mode string, clipping boolean, blend_clipped boolean, mask_default int"
    rows = spark.createDataFrame([tuple(l[c.split()[0]] for c in schema.split(", ")) for l in layers], schema)
    px = spark.createDataFrame(pixels, "doc_id long, seq_id long, x long, y long, r long, g long, b long, a long")
    mk = spark.createDataFrame(masks, "doc_id long, seq_id long, x long, y long, m long")
    got = {(r.doc_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in groups.compose_groups(rows, px, mk, MODES).collect()}
    wrong = {k: (got.get(k), v) for k, v in want.items() if got.get(k, (0, 0, 0, 0)) != v and (v[3] or got.get(k, v)[3])}
    assert not wrong


@pytest.mark.parametrize("limit", [3, 1000])
def test_tall_stacks_fold_in_rounds(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "MAX_STACK", limit)
    rng = random.Random(1)
    data = [
        (0, 0 if rng.random() < 0.7 else rng.randint(1, 3), 0, z * 5000, rng.choice(MODES), rng.randint(0, 255), *[rng.randint(0, 255) for _ in range(4)])
        for z in range(60)
    ]
    px = spark.createDataFrame(data, "doc_id long, x long, y long, z long, mode string, opacity int, r long, g long, b long, a long")
    want = {}
    for row in data:
        key = row[:3]
        want[key] = over(row[4], row[6:], want.get(key, (0, 0, 0, 0)), row[5] / 255)
    got = {(r.doc_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in P.compose_pixels(px, modes=MODES).collect()}
    assert got == want


def test_downscale_averages_light(spark):
    px = spark.createDataFrame(
        [(0, x, y, 200, 100, 50, 255) for x in range(4) for y in range(4)] + [(1, x, y, 255, 0, 0, 255 if x < 2 else 0) for x in range(4) for y in range(4)],
        "doc_id long, x long, y long, r long, g long, b long, a long",
    )
    docs = spark.createDataFrame([(0, 4, 4), (1, 4, 4)], "doc_id long, canvas_w int, canvas_h int")
    half = {(r.doc_id, r.x, r.y): (r.r, r.g, r.b, r.a) for r in P.downscale(px, docs, 0.5).collect()}
    assert len(half) == 8
    assert half[0, 1, 1] == (200, 100, 50, 255)
    assert half[1, 0, 0] == (255, 0, 0, 255) and half[1, 1, 0][3] == 0
    one = {(r.doc_id): (r.r, r.a) for r in P.downscale(px, docs, 0.3).collect()}
    assert one[1] == (255, 128)


def test_image_diff_counts_over_tolerance(spark):
    schema = "doc_id long, x long, y long, r long, g long, b long, a long"
    a = spark.createDataFrame([(0, 0, 0, 10, 10, 10, 255), (0, 1, 0, 9, 9, 9, 255)], schema)
    b = spark.createDataFrame([(0, 0, 0, 12, 10, 10, 255), (0, 2, 0, 0, 0, 0, 3)], schema)
    row = P.image_diff(a, b).first()
    assert (row.max_delta, row.over) == (255, 2)

import random

import numpy as np
from image_fixtures import image_rows

from rastermill.operators import pixels, stats
from rastermill.sources.images import image_sizes


def quad(n=160):
    a = np.zeros((n, n, 3), np.uint8)
    h = n // 2
    a[:h, :h], a[:h, h:], a[h:, :h], a[h:, h:] = (255, 0, 0), (0, 255, 0), (255, 255, 0), (0, 0, 255)
    return a


def test_cells_and_colours(spark):
    cells = pixels.sample_cells(image_rows(spark, {"q": quad(), "w": np.full((20, 64), 255)}), 16)
    assert {r.image_id: r["count"] for r in cells.groupBy("image_id").count().collect()} == {"q": 256, "w": 16 * 5}
    shares = {(r.image_id, r.colour): r.share for r in stats.colour_shares(cells).collect()}
    assert shares == {("q", c): 25.0 for c in ("red", "green", "yellow", "blue")} | {("w", "white"): 100.0}
    grid = stats.ascii_grid(cells).where("image_id = 'w'").first().grid
    assert grid == "\n".join(["@" * 16] * 5)
    top = stats.top_colours(cells, 1).where("image_id = 'q'").first()
    assert top.bucket == 1  # ties: the lowest


def test_histogram_statistics(spark):
    rng = np.random.default_rng(1)
    images = {f"i{k}": rng.integers(0, 256, (30, 40)) for k in range(3)} | {"flat": np.full((10, 10), 7)}
    h = pixels.tile_histograms(image_rows(spark, images))
    st = {r.image_id: r for r in stats.luma_stats(h).collect()}
    bounds = {r.image_id: r for r in stats.percentile_bounds(h).collect()}
    otsu = {r.image_id: r.threshold for r in stats.otsu_threshold(h).collect()}
    for k, a in images.items():
        v = np.sort(a.ravel())
        assert abs(st[k].mean - v.mean()) < 1e-9 and abs(st[k].std - v.std()) < 1e-6 and abs(st[k].bright_share - (v > 200).mean()) < 1e-12
        assert bounds[k].low == v[int(0.01 * (len(v) - 1))] and bounds[k].high == v[int(0.99 * (len(v) - 1))]
        c = np.bincount(v, minlength=256)
        best, at = -1.0, 127
        if (c > 0).sum() >= 3:
            for t in range(256):
                wb, wf = int(c[: t + 1].sum()), int(c[t + 1 :].sum())
                if wb and wf:
                    sb, sf = int((c[: t + 1] * np.arange(t + 1)).sum()), int((c[t + 1 :] * np.arange(t + 1, 256)).sum())
                    var = (sb * wf - sf * wb) ** 2 / (wb * wf)
                    if var > best:
                        best, at = var, t
            at = min(235, max(20, at))
        assert otsu[k] == at, k


def test_tiles_crops_rotation(spark):
    a = np.arange(200 * 100 * 3).reshape(100, 200, 3) % 251
    im = image_rows(spark, {"a": a})
    t = spark.createDataFrame([("a", 0, 150, 80, 50, 20)], "image_id string, tile_id int, x int, y int, w int, h int")
    r = pixels.extract_tiles(t, im).first()
    got = np.frombuffer(r.data, np.uint8).reshape(20, 50, 3)[:, :, ::-1]
    assert (got == a[80:100, 150:200]).all()
    reg = spark.createDataFrame([("a", 0, 0, 0, 200, 100)], "image_id string, region_idx int, x0 int, y0 int, w int, h int")
    r = pixels.crop_regions(reg, im, 50).first()
    assert (r.out_w, r.out_h, len(r.data)) == (50, 25, 50 * 25 * 3)
    r = pixels.rotate_images(im, 90).first()
    assert (r.width, r.height) == (100, 200)
    assert (np.frombuffer(r.data, np.uint8).reshape(200, 100, 3)[:, :, ::-1] == np.rot90(a, -1)).all()
    assert pixels.explode_pixels(im).count() == 20000


def test_preprocess(spark):
    dark = np.full((200, 300), 30)
    dark[50:60, 20:280] = 250
    images = image_rows(spark, {"dark": dark, "plain": np.full((64, 64), 255), "tiny": np.full((20, 20), 9)})
    plan = stats.preprocess_plan(images, pixels.tile_histograms(images))
    got = {r.image_id: r for r in plan.collect()}
    assert got["dark"].applied == ["invert", "otsu", "enlarge"] and got["dark"].is_dark
    assert got["plain"].applied == [] and got["tiny"].applied == []
    out = {r.image_id: r for r in pixels.preprocess_images(images, plan).collect()}
    assert (out["dark"].width, out["dark"].height) == (600, 400) and set(out["dark"].data) == {0, 255}


def test_components_over_blocks(spark):
    rng = random.Random(5)
    points = {(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(700)}
    df = spark.createDataFrame([("p", y, x) for y, x in points], "image_id string, row int, col int")
    got = {(r.row, r.col): (r.label_row, r.label_col) for r in pixels.connected_components(df, span=8).collect()}
    assert got == pixels.label_components(points)


def test_ink(spark):
    a = np.full((300, 400), 255)
    for k in range(10):
        a[10 + 25 * k : 14 + 25 * k, 20:380] = 0
    im = image_rows(spark, {"ruled": a})
    f = pixels.ink_features(im, stats.otsu_threshold(pixels.tile_histograms(im))).first()
    assert abs(f.dark_share - (a == 0).mean()) < 1e-9 and f.mean_height == 4.0
    assert stats.handwriting_score(spark.createDataFrame([("x", None, None, None, None)], "image_id string, row_std double, mean_height double, n_components double, dark_share double")).first().score == 0.5


def test_flat_images_are_left_alone(spark):
    images = spark.createDataFrame([("dark", 100, 100)], "image_id string, width int, height int")
    grey = spark.createDataFrame([("dark", 40, 9_900), ("dark", 230, 100)], "image_id string, bin int, cnt long")
    assert stats.luma_stats(grey).first().std > 12 and stats.preprocess_plan(images, grey).first().is_dark
    deviation = stats.luma_stats(spark.createDataFrame([("dark", 40, 9_960), ("dark", 150, 40)], "image_id string, bin int, cnt long")).first().std
    assert deviation < 12
    flat = stats.preprocess_plan(images, spark.createDataFrame([("dark", 40, 9_960), ("dark", 150, 40)], "image_id string, bin int, cnt long"), force_invert=True).first()
    assert not flat.is_dark and flat.applied == []


def test_components_of_runs():
    """Numbers and heights of 8-connected sets against flood filling."""
    rng = np.random.default_rng(6)
    for share in (0.05, 0.3, 0.5, 0.8):
        for shape in ((1, 1), (1, 9), (9, 1), (17, 23), (60, 41)):
            ink = rng.random(shape) < share
            label = pixels.label_components(set(zip(*(v.tolist() for v in np.nonzero(ink)), strict=True)))
            rows = {}
            for (y, _), root in label.items():
                rows.setdefault(root, []).append(y)
            assert sorted(pixels.run_heights(ink).tolist()) == sorted(max(v) - min(v) + 1 for v in rows.values())


def test_ink_features_are_counts(spark):
    """Twelve strokes, three samples wide and ten high: the count itself, whatever the size of the picture."""
    a = np.full((200, 300), 255)
    for k in range(12):
        a[20:40, 10 + 20 * k : 16 + 20 * k] = 0
    rows = image_rows(spark, {"a": a, "dot": np.zeros((1, 1))})
    got = {r.image_id: r for r in pixels.ink_features(rows, spark.createDataFrame([("a", 128), ("dot", 128)], "image_id string, threshold int")).collect()}
    assert got["a"].n_components == 12 and got["a"].mean_height == 20 and abs(got["a"].per_area - 12 * 10_000 / 15_000) < 1e-9
    assert abs(got["a"].dark_share - 12 * 120 / 60_000) < 1e-9 and got["dot"].n_components == 1
    scored = stats.handwriting_score(spark.createDataFrame([(0.0, 60.0, 300, 0.1)], "row_std double, mean_height double, n_components long, dark_share double")).first()
    assert abs(scored.score - (0.35 + 0.3 + 0.2 + 0.12)) < 1e-9


def test_a_winding_line_is_contracted_in_few_rounds(spark, monkeypatch):
    """A spiral through very many blocks, dense blots, two pictures and negative places: the labels of flood filling, by few steps."""
    n, points, y, x, dy, dx = 64, set(), 0, 0, 0, 1
    seen = np.zeros((n, n), bool)
    free = lambda a, b: 0 <= a < n and 0 <= b < n and not seen[max(0, a - 1) : a + 2, max(0, b - 1) : b + 2].sum() > 2
    for _ in range(n * n):
        seen[y, x] = True
        points.add((y, x))
        if not free(y + dy, x + dx):
            dy, dx = dx, -dy
            if not free(y + dy, x + dx):
                break
        y, x = y + dy, x + dx
    assert len(points) > 900
    rng = random.Random(2)
    blots = {(rng.randint(-30, 30), rng.randint(-30, 30)) for _ in range(900)}
    df = spark.createDataFrame([("s", *p) for p in points] + [("b", *p) for p in blots] * 2 + [("s", None, 3)], "image_id string, row int, col int")
    cuts, cut = [], pixels.cut_lineage
    monkeypatch.setattr(pixels, "cut_lineage", lambda d: cuts.append(1) or cut(d))
    got = {(r.image_id, r.row, r.col): (r.label_row, r.label_col) for r in pixels.connected_components(df, span=4).collect()}
    want = {("s", *p): q for p, q in pixels.label_components(points).items()} | {("b", *p): q for p, q in pixels.label_components(blots).items()}
    assert got == want
    assert len(cuts) < 60  # one step a block would be some 250
    assert pixels.connected_components(df.limit(0)).count() == 0


def test_smooth_reduction_keeps_the_mean(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (37, 53, 3)).astype(np.uint8)
    for h, w in ((9, 13), (36, 52), (1, 1), (5, 53)):
        out = pixels.shrink(a, h, w)
        fine = np.repeat(np.repeat(a.astype(float), h, 0), w, 1)  # every pixel as h x w: the new ones cover whole blocks
        want = fine.reshape(h, 37, w, 53, 3).mean((1, 3))
        assert np.abs(out - want).max() <= 0.5 + 1e-6 and abs(out.mean() - a.mean()) < 1
    thin = np.full((100, 100), 255)
    thin[:, 49] = 0
    im = image_rows(spark, {"t": thin})
    reg = spark.createDataFrame([("t", 0, 0, 0, 100, 100)], "image_id string, region_idx int, x0 int, y0 int, w int, h int")
    dark = lambda **k: min(pixels.crop_regions(reg, im, 20, **k).first().data)
    assert dark() == 255 and dark(smooth=True) == 204  # a stroke of one pixel is missed or kept


def _segment(mark, body):
    return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body


def test_jpeg_sizes(spark):
    frame = lambda m, h, w: _segment(m, bytes([8]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes(7))
    exif = _segment(0xE1, b"Exif\0\0" + b"\xff\xd8" + frame(0xC0, 16, 32) + b"\xff\xd9")
    start, table = b"\xff\xd8", _segment(0xDB, bytes(65))
    cases = {
        "baseline": (start + table + frame(0xC0, 300, 400) + b"\xff\xda", (400, 300)), "progressive": (start + frame(0xC2, 70, 65535), (65535, 70)), "thumbnail": (start + exif + table + frame(0xC1, 7, 9), (9, 7)),
        "huffman": (start + _segment(0xC4, bytes(30)) + _segment(0xCC, b"x") + frame(0xC0, 5, 6), (6, 5)), "filled": (start + b"\xff\xff\xff" + frame(0xC0, 5, 6)[1:], (6, 5)), "bare": (start + b"\xff\xd0\xff\x01" + frame(0xC0, 5, 6), (6, 5)),
        "scan first": (start + b"\xff\xda" + frame(0xC0, 5, 6), None), "cut": (start + frame(0xC0, 5, 6)[:6], None), "noise": (start + b"\x00\x01", None), "only": (start, None), "short": (start + b"\xff\xe0\x00\x01" + frame(0xC0, 5, 6), None),
        "many": (start + _segment(0xFE, b"c") * 350 + frame(0xC0, 5, 6), (6, 5)), "none": (None, None),
    }
    rows = spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, (c, _) in cases.items()], "k string, content binary")
    got = {r.k: (r.width, r.height) if r.width else None for r in image_sizes(rows).collect()}
    assert got == {k: s for k, (_, s) in cases.items()}


def test_small_blocks_are_labelled_together(spark):
    rng = random.Random(9)
    points = {(k, rng.randint(0, 7), rng.randint(0, 7)) for k in range(40) for _ in range(30)}
    df = spark.createDataFrame([(f"p{k}", y, x) for k, y, x in points], "image_id string, row int, col int")
    out = pixels.connected_components(df.unionByName(df), span=4)
    got = {(r.image_id, r.row, r.col): (r.label_row, r.label_col) for r in out.collect()}
    assert got == {(f"p{k}", *c): l for k in range(40) for c, l in pixels.label_components({(y, x) for i, y, x in points if i == k}).items()}
    first = np.array([[1, 1, 0, 1], [0, 0, 1, 0], [1, 0, 0, 0]], bool)
    assert pixels.first_runs(np.array([0, 3, 8, 12]), np.array([2, 4, 9, 13]), 6).tolist() == pixels.label_runs(first)[3].tolist() == [0, 0, 0, 3]

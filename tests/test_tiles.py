import random

import pytest
from pyspark.sql import functions as F

from rastermill.operators import tiles


def _images(spark, sizes):
    return spark.createDataFrame([(i, w, h) for i, (w, h) in enumerate(sizes)], "image_id int, width int, height int")


def _grid(spark, w, h, **kw):
    return [tuple(r) for r in tiles.tile_grid(_images(spark, [(w, h)]), **kw).orderBy("tile_id").select("row", "col", "x", "y", "w", "h").collect()]


def test_grid_sizes(spark):
    g = _grid(spark, 4000, 3000)
    assert len(g) == 20 and g[-1] == (3, 4, 3200, 2400, 800, 600)
    g = _grid(spark, 1000, 1000)
    assert len(g) == 4 and g[1] == (0, 1, 800, 0, 200, 800)
    g = _grid(spark, 2000, 2000, overlap=64)
    assert len(g) == 9 and g[1][2] == 736
    assert _grid(spark, 800, 800) == [(0, 0, 0, 0, 800, 800)]
    assert _grid(spark, 500, 90) == [(0, 0, 0, 0, 500, 90)]


def test_overlap_sliver(spark):
    row = [t for t in _grid(spark, 1536, 100, overlap=64) if t[0] == 0]
    assert len(row) == 3 and row[-1][4] == 64


def test_closed_form_equals_loop(spark):
    rng = random.Random(3)
    sizes = [(rng.randint(1, 6000), rng.randint(1, 6000)) for _ in range(60)]
    for block, overlap in ((64, 0), (64, 31), (800, 64), (512, 255)):
        step = block - overlap

        def along(n):
            out, at = [], 0
            while True:
                out.append((at, min(block, n - at)))
                if n - at < block or at + step >= n:
                    return out
                at += step

        want = {}
        for i, (w, h) in enumerate(sizes):
            one = max(w, h) <= 800
            want[i] = [(0, 0, w, h)] if one else [(x, y, tw, th) for y, th in along(h) for x, tw in along(w)]
        got = {}
        for r in tiles.tile_grid(_images(spark, sizes), block, overlap).orderBy("image_id", "tile_id").collect():
            got.setdefault(r.image_id, []).append((r.x, r.y, r.w, r.h))
        assert got == want


@pytest.mark.parametrize("kw", [{"block": 32}, {"block": 63}, {"overlap": -1}, {"overlap": 400}])
def test_grid_arguments(spark, kw):
    with pytest.raises(ValueError):
        tiles.tile_grid(_images(spark, [(10, 10)]), **kw)


def test_bad_sizes_give_no_tiles(spark):
    assert tiles.tile_grid(_images(spark, [(0, 10), (-5, 3), (None, 4)])).count() == 0


def test_needs_split(spark):
    got = [r.needs_split for r in tiles.needs_split(_images(spark, [(800, 800), (801, 800), (800, 801)])).orderBy("image_id").collect()]
    assert got == [False, True, True]


def test_tile_name(spark):
    row = spark.createDataFrame([(1, 2, 800, 1600, 800, 600)], "row int, col int, x int, y int, w int, h int")
    assert row.select(tiles.tile_name(F.lit("photo"))).first()[0] == "photo_r1_c2_x800_y1600_800x600.png"


def test_payloads(spark):
    mb = 1 << 20
    rows = [(1, i, 0, 10 * mb) for i in range(6)] + [(2, i, 0, mb) for i in range(3)]
    g = spark.createDataFrame(rows, "image_id int, tile_id int, group_idx int, bytes long")
    got = {(r.image_id, r.tile_id): r.batch_idx for r in tiles.batch_payloads(g).collect()}
    assert [got[1, i] for i in range(6)] == [0, 0, 1, 1, 2, 2] and {got[2, i] for i in range(3)} == {0}
    check = {r.image_id: r for r in tiles.payload_check(g).collect()}
    assert check[1].too_heavy and check[1].max_batch == 2 and check[2].max_batch is None
    big = tiles.payload_check(spark.createDataFrame([(3, 40 * mb)], "image_id int, bytes long")).first()
    assert big.too_large and big.max_batch is None
    mode = {r.image_id: r for r in tiles.choose_mode(g).collect()}
    assert mode[1].error and mode[1].mode == "single" and not mode[2].error
    assert tiles.choose_mode(g, fallback=True).where("image_id = 1").first().mode == "layered"


def test_stitch(spark):
    rows = [(1, 0, 100, 5, "hello wor"), (1, 80, 160, 6, "world"), (1, 300, 340, 4, "far"), (1, 345, 380, 4, "off"), (1, 0, 40, 50, "below")]
    df = spark.createDataFrame(rows, "image_id int, x0 int, x1 int, y0 int, text string")
    got = [r.text for r in tiles.stitch_rows(df).orderBy("band_no", "line_no").collect()]
    assert got == ["hello world", "far off", "below"]


def test_empty(spark):
    e = _images(spark, []).where("false")
    g = tiles.tile_grid(e)
    assert g.count() == 0 and tiles.tile_neighbours(g).count() == 0 and tiles.tile_list_text(g, e).count() == 0

import itertools
import re

import pytest

from rastermill.operators import regions, responses


def _px(spark, cases):
    r = spark.createDataFrame([(i, 0, *map(lambda v: None if v is None else float(v), rect)) for i, (rect, _, _) in enumerate(cases)], "image_id int, region_idx int, rx0 double, ry0 double, rx1 double, ry1 double")
    im = spark.createDataFrame([(i, w, h) for i, (_, w, h) in enumerate(cases)], "image_id int, width int, height int")
    return [tuple(x)[:5] for x in regions.regions_to_pixels(r, im).orderBy("image_id").select("x0", "y0", "x1", "y1", "error").collect()]


def test_pixels(spark):
    cases = [((0.25, 0.5, 0.75, 1), 4000, 3000), ((2400, 1200, 800, 1800), 4000, 3000), ((-50, -50, 200, 200), 100, 100), ((0, 0, 9999, 9999), 200, 100), ((0.1, 0.2, 0.5, 0.6), 400, 300)]
    assert [x[:4] for x in _px(spark, cases)] == [(1000, 1500, 3000, 3000), (800, 1200, 2400, 1800), (0, 0, 100, 100), (0, 0, 200, 100), (40, 60, 200, 180)]
    tiny = _px(spark, [((-10, -10, -5, -5), 100, 100)])[0]
    assert tiny[2] - tiny[0] == 1 and tiny[3] - tiny[1] == 1


def test_bad_rectangles_are_error_rows(spark):
    got = _px(spark, [((None, 0, 1, 1), 10, 10), ((float("nan"), 0, 1, 1), 10, 10), ((0, 0, float("inf"), 1), 10, 10), ((0, 0, 1, 1), 0, 0)])
    assert all(x[0] is None and x[4] for x in got)


def test_crop_size(spark):
    df = spark.createDataFrame([(2000, 1500), (400, 300), (800, 1600)], "w int, h int")
    w, h = regions.crop_size(df.w, df.h, 800)
    assert [tuple(r) for r in df.select(w, h).collect()] == [(800, 600), (400, 300), (400, 800)]


@pytest.mark.parametrize("mode", ["visual", "local", "smart", "off"])
def test_routing_truth_table(spark, mode):
    values = list(itertools.product([None, True, False], repeat=2))
    df = spark.createDataFrame(values, "is_handwrite boolean, local_hand boolean")
    for r in regions.route_handwriting(df, mode).collect():
        first, second = (r.local_hand, r.is_handwrite) if mode == "local" else (r.is_handwrite, r.local_hand)
        want = first if first is not None else bool(second)
        assert r.is_hand == want and r.to_model == (want and mode != "off")
        differ = r.is_handwrite is not None and r.local_hand is not None and r.is_handwrite != r.local_hand
        assert r.conflict == (differ and mode in ("smart", "off"))
        if r.is_handwrite is None and r.local_hand is None:
            assert r.route_source == "none"


def test_upgrade(spark):
    rows = [(True, False, False, "rapid", 0.88, 3), (False, False, False, "rapid", 0.88, 3), (False, True, False, "rapid", 1.0, 0), (False, False, True, "rapid", 0.1, 3), (False, False, False, "handwrite-api", 0.1, 3)]
    df = spark.createDataFrame(rows, "is_hand boolean, is_dark boolean, degraded boolean, engine string, confidence double, n_lines int")
    up = lambda mode, **k: [r.upgrade for r in regions.needs_upgrade(df, mode, **k).collect()]
    assert up("full") == [True, False, True, False, False]
    assert up("low") == [False] * 5 and up("off") == [False] * 5 and up("full", has_model=False) == [False] * 5


def test_region_text_and_confidence(spark):
    rows = [(1, 0, 2, "b", 0.5), (1, 0, 1, "a", None), (2, 0, 1, " ", None)]
    df = spark.createDataFrame(rows, "image_id int, region_idx int, line_no int, text string, score double")
    assert {r.image_id: r.text for r in regions.region_text(df).collect()} == {1: "a\nb", 2: "(no text found)"}
    assert {r.image_id: r.confidence for r in regions.region_confidence(df).collect()} == {1: 0.5, 2: 1.0}


def test_polygon_boxes(spark):
    df = spark.sql("SELECT 1 AS image_id, 0 AS region_idx, array(named_struct('text', 'x', 'points', array(named_struct('x', 1.5D, 'y', 2D), named_struct('x', 9.2D, 'y', 4D)), 'score', 0.5D)) AS lines")
    r = regions.explode_lines(df).first()
    assert (r.x, r.y, r.width, r.height) == (1, 2, 9, 2)


def test_prechecks(spark):
    raws = ['x {"hasText": true, "textRegions": [[0.1, 0.2, 0.3, 0.4], {"x0": -1, "y0": 0, "x1": 2, "y1": null, "isHandwrite": true}, {"x0": 1}], "interestRegions": [{"x0": 0, "y0": 0, "x1": 1, "y1": 1, "label": "cat"}], "summary": "s"} y', "prose", None, '{"hasText": 0}', '{"hasText": "no"}']
    df = spark.createDataFrame(list(enumerate(raws)), "image_id int, raw string")
    got = responses.parse_prechecks(df).orderBy("image_id").collect()
    assert got[0].has_text and [tuple(r)[:5] for r in got[0].text_regions] == [(0.1, 0.2, 0.3, 0.4, None), (0.0, 0.0, 1.0, 0.0, True)]
    assert got[0].interest_regions[0].label == "cat" and got[0].summary == "s"
    assert got[1].parse_error and got[1].summary == "prose" and not got[1].has_text and got[1].text_regions == []
    assert got[2].parse_error and not got[3].has_text and got[4].has_text
    ex = regions.explode_regions(responses.parse_prechecks(df)).collect()
    assert len(ex) == 3 and {r.kind for r in ex} == {"text", "interest"}


def test_odd_answers_are_read_as_plain_ones(spark):
    rect = '{"x0": 0.1, "y0": 0.2, "x1": 2, "y1": null}'
    raws = ['{"textRegions": [%s, [0, 0, true, 1], [0, 0, "0.5", 1], [0, 0, "no", 1]], "summary": "a: b"}' % rect, '{"textRegions": [%s]} and {}' % rect, '{"hasText": 1, "hasText": 0}', '{"textRegions": [%s], "summary": 3}' % rect, '{"summary": "\\ud83d"}']
    got = responses.parse_prechecks(spark.createDataFrame(list(enumerate(raws)), "image_id int, raw string")).orderBy("image_id").collect()
    assert [tuple(r)[:4] for r in got[0].text_regions] == [(0.1, 0.2, 1.0, 0.0), (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 0.5, 1.0)] and got[0].summary == "a: b"
    assert got[2].parse_error and got[2].summary == raws[2] and not got[2].has_text
    assert len(got[3].text_regions) == 1 and got[3].summary == "3"


def test_answers_are_parsed_once(spark):
    df = spark.createDataFrame([(1, '{"textRegions": [[0, 0, 1, 1]]}')], "image_id int, raw string")
    plan = regions.explode_regions(responses.parse_prechecks(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan  # one branch for each kind parsed all answers again


def test_pixels_are_compiled(spark, capsys):
    r = spark.range(9).selectExpr("id AS image_id", "id / 9D AS rx0", "id / 8D AS ry0", "id / 7D AS rx1", "id / 6D AS ry1")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        regions.regions_to_pixels(r, spark.range(9).selectExpr("id AS image_id", "cast(id AS int) AS width", "cast(id AS int) AS height")).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM leaves longer methods to its interpreter

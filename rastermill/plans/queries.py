"""The registered queries of the library's own operators, each with its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions import scalars as S
from rastermill.functions.lineage import scratch_dir
from rastermill.operators import batch, cache, regions, responses, stats, tiles
from rastermill.plans import standins as T
from rastermill.plans.standins import with_tables
from rastermill.sources import logs

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(names: str | None = None, sql: str | None = None):
    """Registers a query under its function's name; names and sql give its SQL over the stand-in tables."""

    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_tables(names, sql)
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _plan(spark, d, resume=True, limit=None):
    return batch.plan_batch(T.files(spark, d), T.index_log(spark, d), resume, limit)


@query("files last_log", """, n AS (SELECT f.rel, f.size, l.status AS previous, coalesce(l.status = 'failed', false) AS had_failed, coalesce(l.status <> 'done', true) AS needs FROM files f LEFT JOIN last_log l USING (rel)),
r AS (SELECT *, row_number() OVER (PARTITION BY needs ORDER BY rel) AS k FROM n)
SELECT rel, size, previous, had_failed, CASE WHEN NOT needs THEN 'done' WHEN k <= 100 THEN 'todo' ELSE 'skipped' END AS label FROM r""")
def plan_batch(spark, d):
    return _plan(spark, d, limit=100).select("rel", "size", "previous", "had_failed", "label")


@query("files last_log", " SELECT rel FROM files WHERE rel NOT IN (SELECT rel FROM last_log WHERE status = 'done')")
def pending(spark, d):
    return batch.pending(T.files(spark, d), T.index_log(spark, d)).select("rel")


@query("files last_log", """, v AS (SELECT f.rel, l.status FROM files f LEFT JOIN last_log l USING (rel))
SELECT 'done' AS view, count(*) AS n FROM v WHERE status = 'done' UNION ALL SELECT 'failed', count(*) FROM v WHERE status = 'failed'
UNION ALL SELECT 'todo', count(*) FROM v WHERE status IS NULL OR status <> 'done'""")
def split_plan(spark, d):
    out = None
    for name, view in batch.split_plan(_plan(spark, d)).items():
        part = view.groupBy(F.lit(name).alias("view")).agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("files", """ SELECT rel, sha, CASE WHEN rel <> min(rel) OVER (PARTITION BY sha) THEN min(rel) OVER (PARTITION BY sha) END AS duplicate_of FROM files""")
def dedupe_content(spark, d):
    return batch.dedupe_content(T.files(spark, d)).select("rel", "sha", "duplicate_of")


@query("files run_results", """, u AS (SELECT rel, CASE WHEN rel <> min(rel) OVER (PARTITION BY sha) THEN min(rel) OVER (PARTITION BY sha) END AS duplicate_of FROM files)
SELECT u.rel, r.status, CASE WHEN u.duplicate_of IS NOT NULL THEN 0 ELSE r.ms END AS ms, u.duplicate_of IS NOT NULL AS cached, u.duplicate_of, r.error FROM u LEFT JOIN run_results r ON r.rel = coalesce(u.duplicate_of, u.rel)""")
def fan_out_duplicates(spark, d):
    return batch.fan_out_duplicates(batch.dedupe_content(T.files(spark, d)), T.run_results(spark, d))


@query("files labelled", """, known AS (SELECT sha, min(rel) AS first_rel FROM labelled WHERE quality = 1 GROUP BY sha)
SELECT rel, sha, CASE WHEN first_rel IS NULL THEN 'new' ELSE 'done' END AS status, CASE WHEN first_rel <> rel THEN first_rel END AS duplicate_of FROM files LEFT JOIN known USING (sha)""")
def known_copies(spark, d):
    """What a micro-batch of all files finds done by the log: the batch twin of stream_recognise."""
    known = T.index_log(spark, d).where("status = 'done'").groupBy("sha").agg(F.min("rel").alias("first_rel"))
    old, new = batch.known_copies(T.files(spark, d).select("rel", "sha"), known)
    return old.select("rel", "sha", "status", "duplicate_of").unionByName(new.select("rel", "sha", F.lit("new").alias("status"), F.lit(None).cast("string").alias("duplicate_of")))


_STATUS = """, st AS (SELECT f.rel, coalesce(r.status, l.status, 'pending') AS status, CASE WHEN r.rel IS NOT NULL THEN r.ms ELSE l.ms END AS ms, CASE WHEN r.rel IS NOT NULL THEN r.error ELSE l.error END AS error
FROM files f LEFT JOIN run_results r USING (rel) LEFT JOIN last_log l ON l.rel = f.rel)"""


def _status(spark, d):
    return batch.merge_status(T.files(spark, d), T.run_results(spark, d), T.index_log(spark, d))


@query("files run_results last_log", _STATUS + " SELECT * FROM st")
def merge_status(spark, d):
    return _status(spark, d)


@query("index_log run_results", """ SELECT rel, status, ms, seq FROM (SELECT rel, status, ms, seq FROM index_log UNION ALL SELECT rel, status, ms, 2 FROM run_results) QUALIFY row_number() OVER (PARTITION BY rel ORDER BY seq DESC) = 1""")
def status_union(spark, d):
    columns = ["rel", "status", "ms", "seq"]
    return batch.status_union(T.index_log(spark, d).select(columns), T.run_results(spark, d).withColumn("seq", F.lit(2)).select(columns))


_LAST = """ SELECT rel, status, ms, seq FROM (SELECT rel, status, ms, seq, error FROM index_log UNION ALL SELECT rel, status, ms, 2, error FROM run_results) QUALIFY row_number() OVER (PARTITION BY rel ORDER BY seq DESC) = 1"""


def _logged(spark, d, compacted):
    """All records of the log and of a run, written as lines and read back."""
    log = logs.ProgressLog(spark, f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    log.append(T.index_log(spark, d))
    if compacted:
        log.compact()
    log.append(T.run_results(spark, d).withColumn("seq", F.lit(2)))
    return (log.read() if compacted else logs.read_index(spark, log.path)).select("rel", "status", "ms", "seq")


@query("index_log run_results", _LAST)
def read_index(spark, d):
    return _logged(spark, d, False)


@query("index_log run_results", _LAST)
def compacted_index(spark, d):
    return _logged(spark, d, True)


def _with_answers(spark, d):
    return batch.attach_answers(_status(spark, d).withColumn("answer", F.lit(None).cast("string")), T.answers(spark, d))


@query("files run_results last_log answers", _STATUS + " SELECT st.rel, st.status, CASE WHEN st.status = 'done' THEN a.answer END AS answer FROM st LEFT JOIN answers a USING (rel)")
def attach_answers(spark, d):
    return _with_answers(spark, d).select("rel", "status", "answer")


@query("files run_results last_log", _STATUS + """ SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending,
(SELECT count(*) FROM run_results) AS run_count, (SELECT coalesce(sum(ms), 0)::BIGINT FROM run_results) AS run_ms, (SELECT count(*) FROM run_results WHERE cached) AS cache_hits, (SELECT count(*) FROM run_results WHERE duplicate_of IS NOT NULL) AS duplicates FROM st""")
def batch_stats(spark, d):
    return batch.batch_stats(_status(spark, d), T.run_results(spark, d))


@query("files run_results last_log", _STATUS + " SELECT rel, substr(coalesce(error, 'unknown'), 1, 120) AS error FROM st WHERE status = 'failed' ORDER BY rel LIMIT 10")
def failure_digest(spark, d):
    return batch.failure_digest(_status(spark, d))


@query("files run_results last_log answers", _STATUS + " SELECT st.rel, substr(a.answer, 1, 800) AS answer FROM st JOIN answers a USING (rel) WHERE st.status = 'done' AND length(a.answer) > 0 ORDER BY st.rel LIMIT 3")
def answer_preview(spark, d):
    return batch.answer_preview(_with_answers(spark, d))


@query("files run_results last_log answers", _STATUS + r""" SELECT row_number() OVER (ORDER BY st.rel) AS n, st.rel, '## ' || row_number() OVER (ORDER BY st.rel) || '. ' || st.rel || chr(10) || chr(10) || trim(a.answer) || chr(10) || chr(10) || '---' || chr(10) AS block
FROM st JOIN answers a USING (rel) WHERE st.status = 'done' AND length(a.answer) > 0""")
def full_report(spark, d):
    return batch.full_report(_with_answers(spark, d))


@query("files run_results last_log", _STATUS + """ SELECT rel, '{"rel":"' || rel || '","status":"' || status || '","ms":' || coalesce(ms::VARCHAR, 'null') || ',"error":' || coalesce('"' || error || '"', 'null') || '}' AS item FROM st""")
def report_json(spark, d):
    return batch.report_json(_status(spark, d))


@query()
def report_lines(spark, d):
    status = _with_answers(spark, d).join(T.files(spark, d).select("rel", "sha"), "rel").join(T.run_results(spark, d).select("rel", "cached", "duplicate_of"), "rel", "left")
    return batch.report_lines(status, T.run_results(spark, d))


@query("files", " SELECT rel, row_number() OVER (ORDER BY rel) AS ord FROM files")
def order_files(spark, d):
    return batch.with_rank(T.files(spark, d).select("rel"), "rel")


@query("files", " SELECT rel FROM files ORDER BY rel LIMIT 500")
def take_limit(spark, d):
    return batch.in_first(T.files(spark, d).select("rel"), 500, [F.col("rel")])


@query("index_log", " SELECT rel, status, ms, seq FROM index_log QUALIFY row_number() OVER (PARTITION BY rel ORDER BY seq DESC) = 1")
def latest_per_key(spark, d):
    return batch.latest_per_key(T.index_log(spark, d)).select("rel", "status", "ms", "seq")


@query("images", " SELECT image_id, width, height, greatest(width, height) > 800 AS needs_split FROM images")
def needs_split(spark, d):
    return tiles.needs_split(T.images(spark, d))


@query("tiles", " SELECT * FROM tiles")
def tile_grid(spark, d):
    return tiles.tile_grid(T.images(spark, d))


@query("images", """, o AS (SELECT *, greatest(width, height) > 800 AS split FROM images),
c AS (SELECT image_id, i AS col, i * 736 AS x, CASE WHEN split THEN least(800, width - i * 736) ELSE width END AS w FROM o, range(13) r(i) WHERE i = 0 OR (split AND i * 736 < width AND width - (i - 1) * 736 >= 800)),
r AS (SELECT image_id, i AS row, i * 736 AS y, CASE WHEN split THEN least(800, height - i * 736) ELSE height END AS h FROM o, range(13) r(i) WHERE i = 0 OR (split AND i * 736 < height AND height - (i - 1) * 736 >= 800))
SELECT image_id, row::INTEGER AS row, col::INTEGER AS col, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h FROM c JOIN r USING (image_id)""")
def tile_grid_overlap(spark, d):
    return tiles.tile_grid(T.images(spark, d), overlap=64).select("image_id", "row", "col", "x", "y", "w", "h")


@query("tiles", " SELECT image_id, tile_id, 'photo_r' || row || '_c' || col || '_x' || x || '_y' || y || '_' || w || 'x' || h || '.png' AS tile_name FROM tiles")
def with_tile_name(spark, d):
    return tiles.tile_grid(T.images(spark, d)).select("image_id", "tile_id", tiles.tile_name(F.lit("photo")).alias("tile_name"))


@query("tiles", " SELECT image_id, max(row) + 1 AS n_rows, max(col) + 1 AS n_cols FROM tiles GROUP BY 1")
def grid_shape(spark, d):
    return tiles.grid_shape(tiles.tile_grid(T.images(spark, d)))


@query("tiles", " SELECT image_id, row, col, tile_id FROM tiles")
def tile_ids(spark, d):
    return tiles.tile_ids(tiles.tile_grid(T.images(spark, d)).drop("tile_id", "n_rows", "n_cols")).select("image_id", "row", "col", "tile_id")


@query("tiles", " SELECT image_id, tile_id, (tile_id // 40)::INTEGER AS group_idx FROM tiles")
def group_tiles(spark, d):
    return tiles.group_tiles(tiles.tile_grid(T.images(spark, d))).select("image_id", "tile_id", "group_idx")


@query("sized_tiles", """, g AS (SELECT image_id, tile_id, tile_id // 40 AS group_idx, bytes FROM sized_tiles),
s AS (SELECT *, count(*) OVER w AS n, ceil((sum(bytes) OVER w) * 4 / 3) AS est, row_number() OVER (w ORDER BY tile_id) - 1 AS k FROM g WINDOW w AS (PARTITION BY image_id, group_idx))
SELECT image_id, group_idx::INTEGER AS group_idx, tile_id, (CASE WHEN est <= 37748736 THEN 0 ELSE k // greatest(1, floor(37748736 / (est / n * 1.2)))::BIGINT END)::INTEGER AS batch_idx FROM s""")
def batch_payloads(spark, d):
    return tiles.batch_payloads(tiles.group_tiles(T.sized_tiles(spark, d))).select("image_id", "group_idx", "tile_id", "batch_idx")


_PAYLOAD = """, p AS (SELECT image_id, count(*) AS n, sum(bytes)::BIGINT AS total_bytes, ceil(sum(bytes) * 4 / 3)::BIGINT AS base64_bytes, max(bytes) > 33554432 AS too_large, count(*) > 240 AS too_many, ceil(sum(bytes) * 4 / 3) > 37748736 AS too_heavy FROM sized_tiles GROUP BY 1)"""


@query("sized_tiles", _PAYLOAD + """ SELECT *, CASE WHEN NOT too_large AND (too_many OR too_heavy) THEN least(CASE WHEN too_many THEN 240 ELSE 1000000 END, CASE WHEN too_heavy THEN greatest(1, floor(37748736 / (base64_bytes / n * 1.2))) ELSE 1000000 END)::BIGINT END AS max_batch FROM p""")
def payload_check(spark, d):
    return tiles.payload_check(T.sized_tiles(spark, d))


@query("sized_tiles", _PAYLOAD + """ SELECT image_id, n AS n_tiles, CASE WHEN n <= 60 THEN 'single' ELSE 'layered' END AS mode, CASE WHEN n <= 60 AND (too_large OR too_many OR too_heavy) THEN 'payload too large for one request' END AS error FROM p""")
def choose_mode(spark, d):
    return tiles.choose_mode(T.sized_tiles(spark, d))


@query("tiles images", """, l AS (SELECT image_id, max(n_rows) AS r, max(n_cols) AS c, string_agg(format('| {} | r{}c{} | {},{} → {},{} | {}×{} |', tile_id, row, col, x, y, x + w, y + h, w, h), chr(10) ORDER BY tile_id) AS ls FROM tiles GROUP BY 1)
SELECT image_id, format('Source {}×{} px, grid {}×{}', width, height, r, c) || chr(10) || '| # | tile | x0,y0 → x1,y1 | size |' || chr(10) || '|---|---|---|---|' || chr(10) || ls AS text FROM l JOIN images USING (image_id)""")
def tile_list_text(spark, d):
    images = T.images(spark, d)
    return tiles.tile_list_text(tiles.tile_grid(images), images)


@query("tiles images", """, s AS (SELECT t.*, least(1.0::DOUBLE, 800.0::DOUBLE / greatest(width, height)) AS k FROM tiles t JOIN images USING (image_id))
SELECT image_id, tile_id, floor(x * k + 0.5)::INTEGER AS ox, floor(y * k + 0.5)::INTEGER AS oy, greatest(2, floor(w * k + 0.5))::INTEGER AS ow, greatest(2, floor(h * k + 0.5))::INTEGER AS oh FROM s""")
def overview_layout(spark, d):
    images = T.images(spark, d)
    return tiles.overview_layout(tiles.tile_grid(images), images)


@query("tiles", """ SELECT a.image_id, a.tile_id AS a, b.tile_id AS b, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x + a.w, b.x + b.w) AS x1, least(a.y + a.h, b.y + b.h) AS y1
FROM tiles a JOIN tiles b ON a.image_id = b.image_id AND a.tile_id < b.tile_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1""")
def tile_neighbours(spark, d):
    return tiles.tile_neighbours(tiles.tile_grid(T.images(spark, d)))


def _objects(spark, d):
    """A mark in every tile, sighted also by the tile to its right."""
    t = tiles.tile_grid(T.images(spark, d), overlap=64)
    own = t.select("image_id", F.col("tile_id").alias("object_key"), "tile_id", (F.col("w") - 40).alias("x0"), F.lit(5).alias("y0"), (F.col("w") - 30).alias("x1"), F.lit(15).alias("y1"))
    return own, t


@query("tiles", " SELECT image_id, tile_id, x + w - 40 AS x0, y + 5 AS y0, x + w - 30 AS x1, y + 15 AS y1 FROM tiles")
def tile_objects_to_source(spark, d):
    t = tiles.tile_grid(T.images(spark, d))
    marks = t.select("image_id", "tile_id", (F.col("w") - 40).alias("x0"), F.lit(5).alias("y0"), (F.col("w") - 30).alias("x1"), F.lit(15).alias("y1"))
    return tiles.tile_objects_to_source(marks, t).select("image_id", "tile_id", "x0", "y0", "x1", "y1")


@query("tiles", """, o AS (SELECT a.image_id, a.tile_id AS object_key, b.tile_id, b.x * 2 + b.w AS mx, b.y * 2 + b.h AS my, a.x + a.w - 40 AS x0, a.y + 5 AS y0, a.x + a.w - 30 AS x1, a.y + 15 AS y1
  FROM tiles a JOIN tiles b ON a.image_id = b.image_id AND a.row = b.row AND b.col IN (a.col, a.col + 1))
SELECT image_id, object_key, tile_id, x0, y0, x1, y1 FROM o QUALIFY row_number() OVER (PARTITION BY image_id, object_key ORDER BY greatest(abs(x0 + x1 - mx), abs(y0 + y1 - my)), tile_id) = 1""")
def own_overlap(spark, d):
    t = tiles.tile_grid(T.images(spark, d))
    marks = t.select("image_id", F.col("tile_id").alias("object_key"), (F.col("x") + F.col("w") - 40).alias("x0"), (F.col("y") + 5).alias("y0"), (F.col("x") + F.col("w") - 30).alias("x1"), (F.col("y") + 15).alias("y1"), F.explode(F.array("col", F.col("col") + 1)).alias("col"), "row")
    seen = marks.join(t.select("image_id", "row", "col", "tile_id"), ["image_id", "row", "col"]).drop("row", "col")
    return tiles.own_overlap(seen, t)


@query("ocr_lines", """, b AS (SELECT image_id, x, x + width AS x1, y, text || (x % 10) AS text, y // 12 AS band_no FROM ocr_lines),
l AS (SELECT *, lag(x1) OVER w AS before, lag(text) OVER w AS bt FROM b WINDOW w AS (PARTITION BY image_id, band_no ORDER BY x, x1, text)),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR x - before > 24 THEN 1 ELSE 0 END) OVER (PARTITION BY image_id, band_no ORDER BY x, x1, text ROWS UNBOUNDED PRECEDING) AS line_no FROM l),
p AS (SELECT *, CASE WHEN before IS NULL OR x - before > 24 THEN text WHEN x >= before THEN ' ' || text WHEN bt = text THEN '' WHEN right(bt, 1) = left(text, 1) THEN substr(text, 2) ELSE text END AS piece FROM n)
SELECT image_id, band_no, line_no::BIGINT AS line_no, min(x)::INTEGER AS x0, max(x1)::INTEGER AS x1, min(y)::INTEGER AS y0, string_agg(piece, '' ORDER BY x, x1, text, piece) AS text FROM p GROUP BY ALL""")
def stitch_rows(spark, d):
    rows = T.ocr_lines(spark, d).select("image_id", F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1"), F.col("y").alias("y0"), F.concat("text", (F.col("x") % 10).cast("string")).alias("text"))
    return tiles.stitch_rows(rows)


@query("regions images", """, s AS (SELECT r.*, width, height FROM regions r LEFT JOIN images i USING (image_id)),
p AS (SELECT image_id, order_id, region_idx, width, height, floor(least(rx0, rx1) * width + 0.5) AS a, floor(greatest(rx0, rx1) * width + 0.5) AS b, floor(least(ry0, ry1) * height + 0.5) AS c, floor(greatest(ry0, ry1) * height + 0.5) AS e FROM s),
q AS (SELECT *, greatest(0, least(a, width - 1)) AS x0, greatest(0, least(c, height - 1)) AS y0 FROM p),
z AS (SELECT *, greatest(x0 + 1, least(b, width)) AS x1, greatest(y0 + 1, least(e, height)) AS y1 FROM q)
SELECT image_id, order_id, region_idx, x0::INTEGER AS x0, y0::INTEGER AS y0, x1::INTEGER AS x1, y1::INTEGER AS y1, (x1 - x0)::INTEGER AS w, (y1 - y0)::INTEGER AS h, CASE WHEN width IS NULL THEN 'rectangle needs four finite numbers and a known image size' END AS error
FROM (SELECT image_id, order_id, region_idx, width, CASE WHEN width IS NOT NULL THEN x0 END AS x0, CASE WHEN width IS NOT NULL THEN y0 END AS y0, CASE WHEN width IS NOT NULL THEN x1 END AS x1, CASE WHEN width IS NOT NULL THEN y1 END AS y1 FROM z)""")
def regions_to_pixels(spark, d):
    return regions.regions_to_pixels(T.regions(spark, d), T.images(spark, d)).select("image_id", "order_id", "region_idx", "x0", "y0", "x1", "y1", "w", "h", "error")


@query("ocr_lines", " SELECT image_id, region_idx, string_agg(text, chr(10) ORDER BY line_no, text) AS text FROM ocr_lines GROUP BY ALL")
def region_text(spark, d):
    return regions.region_text(T.ocr_lines(spark, d))


@query("ocr_lines", " SELECT image_id, region_idx, round(avg(score), 9) AS confidence, count(*) AS n_lines FROM ocr_lines GROUP BY ALL")
def region_confidence(spark, d):
    return regions.region_confidence(T.ocr_lines(spark, d)).withColumn("confidence", F.round("confidence", 9))


@query("ocr_lines images", """ SELECT o.image_id, o.region_idx, o.line_no, (floor(o.x / 2.0 + 0.5) + i.width // 10)::INTEGER AS x, (floor(o.y / 2.0 + 0.5) + i.height // 10)::INTEGER AS y, floor(o.width / 2.0 + 0.5)::INTEGER AS width, floor(o.height / 2.0 + 0.5)::INTEGER AS height
FROM ocr_lines o JOIN images i USING (image_id)""")
def lines_to_source(spark, d):
    """Lines of crops that were enlarged twice, whose origin is a tenth of the image's sides."""
    lines = T.ocr_lines(spark, d)
    at = T.images(spark, d).select("image_id", F.floor(F.col("width") / 10).alias("x0"), F.floor(F.col("height") / 10).alias("y0"))
    origins = lines.select("image_id", "region_idx").distinct().join(at, "image_id")
    out = regions.lines_to_source(lines, origins, 2.0)
    return out.select("image_id", "region_idx", "line_no", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "width", "height")))


def _routed(spark, d, mode="smart"):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    third = lambda k: F.when(k % 3 == 0, F.lit(None)).otherwise(k % 3 == 1).cast("boolean")
    rows = line.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("region_idx"), third(F.col("l_partkey")).alias("is_handwrite"), third(F.col("l_suppkey")).alias("local_hand"))
    return regions.route_handwriting(rows, mode)


_ROUTE = """ WITH r AS (SELECT l_orderkey AS order_id, l_linenumber AS region_idx, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_partkey % 3 = 1 END AS is_handwrite, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE l_suppkey % 3 = 1 END AS local_hand FROM lineitem)
SELECT *, coalesce(is_handwrite, local_hand, false) AS is_hand, CASE WHEN is_handwrite = local_hand THEN 'visual+local' WHEN is_handwrite IS NOT NULL THEN 'visual' WHEN local_hand IS NOT NULL THEN 'local-fallback' ELSE 'none' END AS route_source,
coalesce(is_handwrite <> local_hand, false) AS conflict, coalesce(is_handwrite, local_hand, false) AS to_model FROM r"""


@query()
def route_handwriting(spark, d):
    return _routed(spark, d)


_SQL["route_handwriting"] = _ROUTE


def _confidence(spark, d):
    rows = regions.region_confidence(T.ocr_lines(spark, d)).withColumn("confidence", F.round("confidence", 6))
    k = F.col("region_idx")
    return rows.select("image_id", "region_idx", "confidence", F.when(k % 17 == 0, 0).otherwise(F.col("n_lines")).alias("n_lines"), (k % 2 == 0).alias("is_hand"), (k % 5 == 0).alias("is_dark"), (k % 13 == 0).alias("degraded"), F.when(k % 11 == 0, "handwrite-api").otherwise("rapid").alias("engine"))


@query("ocr_lines", """, c AS (SELECT region_idx, round(avg(score), 6) AS confidence, CASE WHEN region_idx % 17 = 0 THEN 0 ELSE count(*) END AS n_lines FROM ocr_lines GROUP BY region_idx),
f AS (SELECT *, region_idx % 2 = 0 AS hand, region_idx % 5 = 0 AND n_lines = 0 AS dark FROM c)
SELECT region_idx, confidence, region_idx % 13 <> 0 AND region_idx % 11 <> 0 AND (confidence < CASE WHEN hand THEN 0.9 ELSE 0.85 END OR dark) AS upgrade FROM f""")
def needs_upgrade(spark, d):
    return regions.needs_upgrade(_confidence(spark, d)).select("region_idx", "confidence", "upgrade")


@query("ocr_lines", """, r AS (SELECT DISTINCT image_id, region_idx, region_idx % 2 = 0 AS hand, region_idx % 3 <> 0 AS o, region_idx % 5 <> 0 AS m, region_idx % 7 = 0 AS u FROM ocr_lines)
SELECT image_id, region_idx, CASE WHEN hand AND m THEN 'handwrite-api' WHEN NOT hand AND o AND u THEN 'upgrade-api' WHEN o THEN 'ocr' WHEN NOT hand AND m THEN 'vision-fallback' ELSE 'unavailable' END AS engine,
CASE WHEN hand AND m THEN 'model' WHEN NOT hand AND o AND u THEN 'better' WHEN o THEN 'plain' WHEN NOT hand AND m THEN 'model' ELSE '' END AS text, (hand AND NOT m) OR (NOT hand AND NOT o) AS degraded FROM r""")
def resolve_region_text(spark, d):
    base = T.ocr_lines(spark, d).select("image_id", "region_idx").distinct()
    k = F.col("region_idx")
    tried = lambda ok, text: base.select("image_id", "region_idx", F.when(ok, F.lit(text)).alias("text"), F.when(~ok, F.lit("failed")).alias("error"))
    out = regions.resolve_region_text(base.withColumn("to_model", k % 2 == 0), tried(k % 3 != 0, "plain"), tried(k % 5 != 0, "model"), tried(k % 7 == 0, "better"))
    return out.select("image_id", "region_idx", "engine", "text", "degraded")


_SHARES = """, s AS (SELECT image_id, CASE WHEN r >= 128 THEN 4 ELSE 0 END + CASE WHEN g >= 128 THEN 2 ELSE 0 END + CASE WHEN b >= 128 THEN 1 ELSE 0 END AS bucket, count(*) AS cnt, avg(row) AS ar, avg(col) AS ac FROM cells WHERE a >= 128 GROUP BY ALL),
t AS (SELECT *, ['black', 'blue', 'green', 'cyan', 'red', 'magenta', 'yellow', 'white'][bucket + 1] AS colour, round(cnt * 100.0::DOUBLE / sum(cnt) OVER (PARTITION BY image_id), 6) AS share, row_number() OVER (PARTITION BY image_id ORDER BY cnt DESC, bucket) AS rank FROM s)"""


@query("cells", _SHARES + " SELECT image_id, bucket, colour, cnt, share FROM t")
def colour_shares(spark, d):
    return stats.colour_shares(T.cells(spark, d)).withColumn("share", F.round("share", 6))


@query("cells", _SHARES + " SELECT image_id, bucket, colour, cnt, share, rank FROM t WHERE rank <= 3")
def top_colours(spark, d):
    return stats.top_colours(T.cells(spark, d), 3).withColumn("share", F.round("share", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("cells", _SHARES + " SELECT image_id, rank, bucket, colour, cnt, share, floor(ar + 0.5)::INTEGER AS centre_row, floor(ac + 0.5)::INTEGER AS centre_col FROM t WHERE rank <= 6")
def colour_blocks(spark, d):
    return stats.colour_blocks(T.cells(spark, d)).withColumn("share", F.round("share", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("cells", """, c AS (SELECT image_id, row, string_agg(CASE WHEN a < 128 THEN ' ' ELSE substr('.:-=+*#%@', least(8, floor((r * 299 + g * 587 + b * 114) / 1000.0::DOUBLE / 256 * 9))::INTEGER + 1, 1) END, '' ORDER BY col) AS line FROM cells GROUP BY ALL)
SELECT image_id, string_agg(line, chr(10) ORDER BY row) AS grid FROM c GROUP BY ALL""")
def ascii_grid(spark, d):
    return stats.ascii_grid(T.cells(spark, d))


_LUMA = """, m AS (SELECT image_id, sum(cnt)::DOUBLE AS n, sum(bin * cnt)::DOUBLE AS s, sum(bin * bin * cnt)::DOUBLE AS s2, sum(CASE WHEN bin > 200 THEN cnt ELSE 0 END)::DOUBLE AS br FROM histograms GROUP BY 1),
lu AS (SELECT image_id, s / n AS mean, sqrt(greatest(0, s2 / n - (s / n) * (s / n))) AS std, br / n AS bright_share FROM m)"""


@query("histograms", _LUMA + " SELECT image_id, round(mean, 6) AS mean, round(std, 6) AS std, round(bright_share, 6) AS bright_share FROM lu")
def luma_stats(spark, d):
    return stats.luma_stats(T.histograms(spark, d)).select("image_id", *(F.round(c, 6).alias(c) for c in ("mean", "std", "bright_share")))


def _otsu(name: str, source: str) -> str:
    return f""", {name}_h AS (SELECT image_id, bin, sum(cnt) AS cnt FROM {source} GROUP BY ALL),
{name}_w AS (SELECT image_id, bin, sum(cnt) OVER u AS wb, sum(bin * cnt) OVER u AS sb, sum(cnt) OVER p AS n, sum(bin * cnt) OVER p AS s, count(*) OVER p AS bins FROM {name}_h WINDOW p AS (PARTITION BY image_id), u AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
{name}_v AS (SELECT *, CASE WHEN n > wb THEN (sb * n - s * wb)::DOUBLE * (sb * n - s * wb)::DOUBLE / (wb::DOUBLE * (n - wb)::DOUBLE) ELSE 0 END AS v FROM {name}_w),
{name} AS (SELECT image_id, (CASE WHEN bins < 3 THEN 127 ELSE least(greatest(bin, 20), 235) END)::INTEGER AS threshold FROM {name}_v QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY v DESC, bin) = 1)"""


@query("histograms", _otsu("ot", "histograms") + " SELECT * FROM ot")
def otsu_threshold(spark, d):
    return stats.otsu_threshold(T.histograms(spark, d))


_BOUNDS = """, pw AS (SELECT image_id, bin, sum(cnt) OVER (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto, sum(cnt) OVER (PARTITION BY image_id) AS n FROM histograms),
pb AS (SELECT image_id, min(bin) FILTER (upto > floor(0.01::DOUBLE * (n - 1))) AS low, min(bin) FILTER (upto > floor(0.99::DOUBLE * (n - 1))) AS high FROM pw GROUP BY 1)"""


@query("histograms", _BOUNDS + " SELECT * FROM pb")
def percentile_bounds(spark, d):
    return stats.percentile_bounds(T.histograms(spark, d))


@query("histograms", _LUMA + _BOUNDS + _otsu("ot", "histograms") + _otsu("dk", "(SELECT image_id, 255 - bin AS bin, cnt FROM histograms)") + """,
k AS (SELECT image_id, mean, std, bright_share, low, high, ot.threshold AS t0, dk.threshold AS t1, mean < 110 AND bright_share > 0.005 AS dark FROM lu JOIN pb USING (image_id) JOIN ot USING (image_id) JOIN dk USING (image_id)),
z AS (SELECT *, std < 45 OR dark OR (std < 90 AND mean < 175) AS weak, mean > 165 AND std BETWEEN 30 AND 135 AND 1 - bright_share BETWEEN 0.03 AND 0.6 AS cand FROM k)
SELECT image_id, std >= 12 AND dark AS is_dark, concat_ws('+', CASE WHEN std >= 12 AND dark THEN 'invert' END, CASE WHEN std >= 12 AND weak THEN 'otsu' WHEN std >= 12 AND high - low > 20 AND high - low < 220 THEN 'contrast' END, CASE WHEN std >= 12 AND (dark OR weak OR cand) THEN 'enlarge' END) AS applied,
(CASE WHEN dark THEN t1 ELSE t0 END) AS threshold, (CASE WHEN dark THEN 255 - high ELSE low END)::INTEGER AS low, (CASE WHEN dark THEN 255 - low ELSE high END)::INTEGER AS high FROM z""")
def preprocess_plan(spark, d):
    images = T.cells(spark, d).select("image_id").distinct().select("image_id", F.lit(640).alias("width"), F.lit(480).alias("height"))
    return stats.preprocess_plan(images, T.histograms(spark, d)).withColumn("applied", F.array_join("applied", "+"))


@query("cells", """, f AS (SELECT image_id, stddev_pop(r) / 255 AS row_std, avg(g) AS mean_height, count(*) AS n_components, avg(CASE WHEN b < 100 THEN 1.0::DOUBLE ELSE 0 END) AS dark_share FROM cells GROUP BY 1),
s AS (SELECT image_id, 0.35 * (1 - least(1, row_std / 0.13)) + 0.3 * least(1, mean_height / 60) + 0.2 * least(1, n_components / 300.0::DOUBLE) + 0.15 * CASE WHEN dark_share BETWEEN 0.03 AND 0.3 THEN 0.8 ELSE 0.4 END AS v FROM f)
SELECT image_id, round(v, 6) AS score, v >= 0.55 AS is_hand FROM s""")
def handwriting_score(spark, d):
    f = T.cells(spark, d).groupBy("image_id").agg((F.stddev_pop("r") / 255).alias("row_std"), F.avg("g").alias("mean_height"), F.count(F.lit(1)).alias("n_components"), F.avg(F.when(F.col("b") < 100, 1.0).otherwise(0.0)).alias("dark_share"))
    return stats.handwriting_score(f).select("image_id", F.round("score", 6).alias("score"), "is_hand")


def _asked(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    key = F.concat_ws("-", (F.col("user_id") + 1).cast("string"), F.lit("click"))
    return e.select("event_id", F.substring(key, 1, 2).alias("shard"), key.alias("key"))


@query("cache_entries clock", """, q AS (SELECT event_id, (user_id + 1) || '-click' AS key FROM events),
live AS (SELECT key, value FROM cache_entries, clock WHERE value IS NOT NULL AND epoch_ms(now) - epoch_ms(ts) <= 172800000)
SELECT event_id, key, value AS cached_value, value IS NOT NULL AS hit FROM q LEFT JOIN live USING (key)""")
def cache_lookup(spark, d):
    return cache.cache_lookup(_asked(spark, d), T.cache_entries(spark, d), 172_800_000, T.now(spark, d)).select("event_id", "key", "cached_value", "hit")


@query("cache_entries clock", """, q AS (SELECT event_id, (user_id + 1) || '-click' AS key FROM events),
live AS (SELECT key, '{"lines":[' || value || ']}' AS value FROM cache_entries, clock WHERE value IS NOT NULL AND length(key) % 2 = 0 AND epoch_ms(now) - epoch_ms(ts) <= 172800000)
SELECT event_id, value IS NOT NULL AS hit FROM q LEFT JOIN live USING (key)""")
def ocr_cache_lookup(spark, d):
    lines = F.when(F.length("key") % 2 == 0, F.concat(F.lit('{"lines":['), "value", F.lit("]}"))).otherwise(F.col("value"))
    return cache.ocr_cache_lookup(_asked(spark, d), T.cache_entries(spark, d).withColumn("value", lines), T.now(spark, d)).select("event_id", "hit")


@query("cache_entries", """, n AS (SELECT substr(user_id || '-' || event_type, 1, 2) AS shard, user_id || '-' || event_type AS key, ts + INTERVAL 1 DAY AS ts, props AS value, event_id AS bytes, event_id FROM events)
SELECT shard, key, ts, value, bytes FROM (SELECT *, -1 AS event_id FROM cache_entries UNION ALL SELECT * FROM n WHERE event_id IN (SELECT max(event_id) FROM n GROUP BY key)) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC) = 1""")
def cache_put(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    last = e.groupBy(key.alias("key")).agg(F.max_by(F.struct("ts", "props", "event_id"), "event_id").alias("r"))
    new = last.select(F.substring("key", 1, 2).alias("shard"), "key", (F.col("r.ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("r.props").alias("value"), F.col("r.event_id").alias("bytes"), F.lit(True).alias("ok"))
    return cache.cache_put(T.cache_entries(spark, d), new)


@query("cache_entries", " SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, min(ts) AS oldest, max(ts) AS newest FROM cache_entries")
def cache_stats(spark, d):
    return cache.cache_stats(T.cache_entries(spark, d))


@query("cache_entries clock", """, x AS (SELECT key, ts, bytes, epoch_ms(now) - epoch_ms(ts) > 864000000 AS expired FROM cache_entries, clock),
l AS (SELECT key, bytes, sum(bytes) OVER () AS total, sum(bytes) OVER (ORDER BY ts DESC, key DESC ROWS UNBOUNDED PRECEDING) AS lef FROM x WHERE NOT expired)
SELECT x.key, x.expired, x.expired OR (l.total > 6000000 AND l.lef > 5400000) AS "drop" FROM x LEFT JOIN l USING (key)""")
def cache_prune(spark, d):
    return cache.cache_prune(T.cache_entries(spark, d), 864_000_000, 6_000_000, T.now(spark, d)).select("key", "expired", "drop")


@query("clock", """ SELECT '/tmp/' || event_type || '-' || event_id AS path, ts AS mtime FROM events, clock WHERE epoch_ms(now) - epoch_ms(ts) > 86400000 AND event_type IN ('click', 'view') AND NOT (event_type = 'view' AND event_id % 10 = 0)""")
def expired_paths(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    folder = F.when((F.col("event_type") == "view") & (F.col("event_id") % 10 == 0), F.lit("/tmp/kept/")).otherwise(F.lit("/tmp/"))
    listing = e.select(F.concat(folder, "event_type", F.lit("-"), F.col("event_id").cast("string")).alias("path"), F.col("ts").alias("mtime"))
    return cache.expired_paths(listing, T.now(spark, d), ["click-", "view-"], ["/tmp/kept/"])


@query("files", """ SELECT rel, sha || '-' || substr(sha256('baseURL=u' || chr(1) || 'blockSize=' || size || chr(1) || 'model=m' || chr(1) || 'promptVersion=1'), 1, 16) AS key, substr(sha, 1, 2) AS shard FROM files""")
def with_cache_key(spark, d):
    params = F.create_map(F.lit("model"), F.lit("m"), F.lit("blockSize"), F.col("size").cast("string"), F.lit("baseURL"), F.lit("u"))
    return cache.with_cache_key(T.files(spark, d).withColumn("params", params)).select("rel", "key", "shard")


@query("responses", """ SELECT event_id, CASE status WHEN 404 THEN 'path' WHEN 429 THEN 'rate-limit' WHEN 503 THEN 'server' WHEN 400 THEN ['token-field', 'field', 'token-field', 'field', 'client', 'field'][event_id % 6 + 1] ELSE 'unknown' END AS kind,
status IN (429, 503) AS retryable, CASE WHEN status = 400 THEN [NULL, 'detail', NULL, 'reasoning_effort', NULL, 'thinking'][event_id % 6 + 1] END AS field FROM responses""")
def classify_responses(spark, d):
    return responses.classify_responses(T.responses(spark, d)).select("event_id", "kind", "retryable", "field")


@query("responses", """, a AS (SELECT request_id, event_id, status, body, count(*) FILTER (status IN (429, 503)) OVER p AS n_wait, count(*) FILTER (status = 404) OVER p AS n_path,
  count(*) FILTER (status = 400 AND event_id % 6 IN (0, 2)) OVER p AS n_token, count(*) FILTER (status = 400 AND event_id % 6 IN (1, 3, 5)) OVER p AS n_field, row_number() OVER (PARTITION BY request_id ORDER BY event_id DESC) AS back FROM (SELECT *, user_id || '-' || event_id // 1000 AS request_id FROM responses) WINDOW p AS (PARTITION BY request_id))
SELECT request_id, CASE WHEN status = 200 THEN 'done' WHEN status IN (429, 503) AND n_wait <= 3 THEN 'wait' WHEN status = 404 AND n_path = 1 THEN 'other-path' WHEN status = 400 AND event_id % 6 IN (0, 2) AND n_token = 1 THEN 'switch-token-field'
  WHEN status = 400 AND event_id % 6 IN (1, 3, 5) AND n_field <= 3 THEN 'drop-field' ELSE 'fail' END AS action, CASE WHEN status IN (429, 503) AND n_wait <= 3 THEN pow(3.0, n_wait - 1) END AS wait_s FROM a WHERE back = 1""")
def retry_plan(spark, d):
    request = F.concat_ws("-", F.col("user_id").cast("string"), F.floor(F.col("event_id") / 1000).cast("string"))
    attempts = T.responses(spark, d).select(request.alias("request_id"), F.col("event_id").alias("attempt"), "status", "body", F.lit(None).cast("double").alias("retry_after"), F.lit(False).alias("empty"))
    return responses.retry_plan(attempts).select("request_id", "action", "wait_s")


@query("responses", """ SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM responses""")
def json_slice(spark, d):
    """The JSON object inside prose."""
    raw = F.concat(F.lit("note "), "props", F.lit(" tail"))
    return T.responses(spark, d).select("event_id", F.try_variant_get(F.try_parse_json(responses.json_slice(raw)), "$.k", "long").alias("k"))


@query("responses", """ SELECT event_id, CASE event_id % 6 WHEN 0 THEN props ELSE '' END AS content, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'business' WHEN 2 THEN 'length' WHEN 3 THEN 'reasoning' WHEN 4 THEN 'array' ELSE 'unknown' END AS empty_reason FROM responses""")
def assistant_text(spark, d):
    text = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("props").alias("content")).alias("message"))).alias("choices")))
    bodies = [text, F.lit('{"base_resp":{"status_code":1004}}'), F.lit('{"choices":[{"finish_reason":"length","message":{"content":" "}}]}'), F.lit('{"choices":[{"message":{"content":"","reasoning_content":"so"}}]}'), F.lit('{"choices":[{"message":{"content":[{"type":"text"}]}}]}'), F.lit("not json")]
    rows = T.responses(spark, d).withColumn("body", F.element_at(F.array(*bodies), (F.col("event_id") % 6 + 1).cast("int")))
    return responses.assistant_text(rows).select("event_id", "content", "empty_reason")


def _prechecks(spark, d):
    """Model answers put together from line items: a text region, a broken one and an interest region."""
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    # A file of one row group is one task: parsing costs more than dealing rows of four numbers out.
    line = line.repartition(spark.sparkContext.defaultParallelism)
    n = lambda c: F.col(c).cast("string")
    good = F.concat(F.lit('Here: {"hasText": '), F.when(F.col("l_orderkey") % 2 == 0, "1").otherwise('""'), F.lit(', "textRegions": [['), n("l_discount"), F.lit(", null, 1.5, "), n("l_tax"), F.lit('], [1, 2], {"x0": 0.1, "y0": 0.2, "x1": 0.3, "y1": "no"}], "interestRegions": [{"x0": 0, "y0": 0, "x1": '), n("l_discount"), F.lit(', "y1": 1, "label": "a b"}], "summary": "s"} end'))
    raw = F.when(F.col("l_orderkey") % 5 == 0, F.lit("plain prose")).otherwise(good)
    return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("image_id"), raw.alias("raw"))


@query()
def parse_prechecks(spark, d):
    out = responses.parse_prechecks(_prechecks(spark, d))
    return out.select("image_id", "has_text", F.size("text_regions").alias("n_text"), F.size("interest_regions").alias("n_interest"), "summary", "parse_error")


_SQL["parse_prechecks"] = """SELECT l_orderkey * 10 + l_linenumber AS image_id, l_orderkey % 5 <> 0 AND l_orderkey % 2 = 0 AS has_text, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n_text, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE 1 END AS n_interest,
CASE WHEN l_orderkey % 5 = 0 THEN 'plain prose' ELSE 's' END AS summary, l_orderkey % 5 = 0 AS parse_error FROM lineitem"""


@query()
def explode_regions(spark, d):
    out = regions.explode_regions(responses.parse_prechecks(_prechecks(spark, d)))
    return regions.clean_label(out).select("image_id", "kind", "region_idx", "label", "label_name", "rx0", "ry0", "rx1", "ry1")


_SQL["explode_regions"] = """SELECT l_orderkey * 10 + l_linenumber AS image_id, 'text' AS kind, 0 AS region_idx, '' AS label, 'region' AS label_name, l_discount AS rx0, 0.0::DOUBLE AS ry0, 1.0::DOUBLE AS rx1, l_tax AS ry1 FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'interest', 0, 'a b', 'a_b', 0, 0, l_discount, 1 FROM lineitem WHERE l_orderkey % 5 <> 0"""


@query()
def parse_tile_results(spark, d):
    line = spark.read.parquet(f"{d}/lineitem.parquet")
    one = F.concat(F.lit('[{"id": "'), F.col("l_linenumber").cast("string"), F.lit('", "rect": ['), F.col("l_partkey").cast("string"), F.lit(", 0, 5, 5], \"content\": \"x\", \"type\": \"text\"}]"))
    raw = F.when(F.col("l_linenumber") == 2, F.lit("sorry")).otherwise(one)
    out = responses.parse_tile_results(line.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("request_id"), raw.alias("raw")))
    return out.select("request_id", "id", F.try_element_at("rect", F.lit(1)).cast("long").alias("x"), "content", "error")


_SQL["parse_tile_results"] = """SELECT l_orderkey || '-' || l_linenumber AS request_id, CASE WHEN l_linenumber <> 2 THEN l_linenumber::VARCHAR END AS id, CASE WHEN l_linenumber <> 2 THEN l_partkey END AS x, CASE WHEN l_linenumber <> 2 THEN 'x' END AS content,
CASE WHEN l_linenumber = 2 THEN 'not a JSON array' END AS error FROM lineitem"""


@query("ocr_lines", """, g AS (SELECT image_id, region_idx % 4 AS group_idx, string_agg(text, chr(10) || chr(10) ORDER BY region_idx * 10 + line_no, text) AS t FROM ocr_lines GROUP BY ALL)
SELECT image_id, string_agg('## Group ' || (group_idx + 1) || chr(10) || t, chr(10) || chr(10) ORDER BY group_idx) AS text FROM g GROUP BY 1""")
def group_text(spark, d):
    rows = T.ocr_lines(spark, d).select("image_id", (F.col("region_idx") % 4).alias("group_idx"), (F.col("region_idx") * 10 + F.col("line_no")).alias("batch_idx"), "text")
    return responses.group_text(rows)


@query("sized_tiles", """ SELECT 'tiles/' || image_id || '/' || tile_id // 40 || '/0' AS request_id, image_id, count(*)::INTEGER AS n_refs, min(tile_id)::INTEGER AS first_ref FROM sized_tiles GROUP BY image_id, tile_id // 40""")
def build_requests(spark, d):
    parts = tiles.group_tiles(T.sized_tiles(spark, d)).withColumn("batch_idx", F.lit(0)).withColumn("ref", F.col("tile_id"))
    out = responses.build_requests(parts, "tiles", {"model": "m"})
    return out.select("request_id", "image_id", F.size("image_refs").alias("n_refs"), F.element_at("image_refs", 1).alias("first_ref"))


@query("files run_results", """ SELECT rel, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms % 500 = 250 THEN format('{:.1f}s', (ms // 100 + 1) / 10.0::DOUBLE) ELSE format('{:.1f}s', ms / 1000.0::DOUBLE) END AS short, CASE WHEN m < 60 THEN m || 'm' || lpad(floor(sec - m * 60 + 0.5)::BIGINT::VARCHAR, 2, '0') || 's' ELSE (m // 60) || 'h' || lpad((m % 60)::VARCHAR, 2, '0') || 'm' END AS long
FROM (SELECT rel, ms, (ms + 60) * 2 AS sec, (((ms + 60) * 2) // 60) AS m FROM run_results)""")
def human_ms(spark, d):
    ms = F.col("ms")
    return T.run_results(spark, d).select("rel", S.human_ms(ms).alias("short"), S.human_ms((ms + 60) * 2000).alias("long"))


@query("files", " SELECT rel, doc_id::VARCHAR AS item_name, 'image/png' AS media FROM files")
def with_item_name(spark, d):
    return T.files(spark, d).select("rel", S.item_name(F.col("rel")).alias("item_name"), S.media_type(S.extension(F.col("rel"))).alias("media"))


@query("files", " SELECT rel, size FROM files WHERE size <= 5000")
def drop_oversize(spark, d):
    from rastermill.sources.images import drop_oversize as cut

    return cut(T.files(spark, d).withColumnRenamed("size", "length"), 5000).where("error IS NULL").select("rel", F.col("length").alias("size"))


@query("clock", " SELECT event_id, 'batch-' || strftime(ts, '%Y%m%d-%H%M%S') AS batch_id FROM events")
def batch_id(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", S.batch_id(F.col("ts")).alias("batch_id"))


@query("cells", " SELECT * FROM cells")
def sample_cells(spark, d):
    from rastermill.operators import pixels

    return pixels.sample_cells(T.pictures(spark, d), 8)


@query("cells", " SELECT image_id, row AS y, col AS x, r, g, b, a FROM cells")
def explode_pixels(spark, d):
    from rastermill.operators import pixels

    return pixels.explode_pixels(T.pictures(spark, d))


_QUARTERS = """, q AS (SELECT *, (row // 4) * 2 + col // 4 AS tile_id, floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5)::INTEGER AS bin FROM cells)"""


def _quarters(spark, d):
    pictures = T.pictures(spark, d)
    corners = F.array(*(F.struct(F.lit(2 * r + c).alias("tile_id"), F.lit(4 * c).alias("x"), F.lit(4 * r).alias("y")) for r in (0, 1) for c in (0, 1)))
    return pictures, pictures.select("image_id", F.explode(corners).alias("t")).select("image_id", "t.*", F.lit(4).alias("w"), F.lit(4).alias("h"))


@query("cells", _QUARTERS + " SELECT image_id, tile_id::INTEGER AS tile_id, bin, count(*) AS cnt FROM q GROUP BY ALL")
def tile_histograms(spark, d):
    from rastermill.operators import pixels

    pictures, quarters = _quarters(spark, d)
    return pixels.tile_histograms(pictures, quarters)


@query("cells", _QUARTERS + """ SELECT image_id, tile_id::INTEGER AS tile_id, string_agg(printf('%02X%02X%02X%02X', b, g, r, a), '' ORDER BY row, col) AS bytes FROM q GROUP BY ALL""")
def extract_tiles(spark, d):
    from rastermill.operators import pixels

    pictures, quarters = _quarters(spark, d)
    return pixels.extract_tiles(quarters, pictures).select("image_id", "tile_id", F.hex("data").alias("bytes"))


@query("cells", """ SELECT image_id, string_agg(printf('%02X%02X%02X%02X', b, g, r, a), '' ORDER BY row, col) AS bytes FROM cells WHERE row % 2 = 1 AND col % 2 = 1 GROUP BY 1""")
def crop_regions(spark, d):
    """Each picture at half its size."""
    from rastermill.operators import pixels

    pictures = T.pictures(spark, d)
    whole = pictures.select("image_id", F.lit(0).alias("region_idx"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    return pixels.crop_regions(whole, pictures, 4).select("image_id", F.hex("data").alias("bytes"))


_MEAN = "((sum({c}) * 2 + 4) // 8)::INTEGER AS {c}"


@query("cells", f""", m AS (SELECT image_id, row // 2 AS y, col // 2 AS x, {", ".join(_MEAN.format(c=c) for c in "rgba")} FROM cells GROUP BY ALL)
SELECT image_id, string_agg(printf('%02X%02X%02X%02X', b, g, r, a), '' ORDER BY y, x) AS bytes FROM m GROUP BY 1""")
def crop_regions_smooth(spark, d):
    """Each picture at half its size, by the means of its pixels."""
    from rastermill.operators import pixels

    pictures = T.pictures(spark, d)
    whole = pictures.select("image_id", F.lit(0).alias("region_idx"), F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    return pixels.crop_regions(whole, pictures, 4, smooth=True).select("image_id", F.hex("data").alias("bytes"))


@query("images", " SELECT image_id, width, height FROM images")
def jpeg_sizes(spark, d):
    """Sizes from JPEG headers with a thumbnail in front, put together from the images' own sizes."""
    from rastermill.sources.images import image_sizes

    two = lambda c: F.lpad(F.hex(c), 4, "0")
    frame = F.concat(F.when(F.col("image_id") % 2 == 0, "FFC0").otherwise("FFC2"), F.lit("001108"), two(F.col("height")), two(F.col("width")), F.lit("03012200021101031101"))
    thumbnail = "FFE10018457869660000FFD8FFC0001108001000200301220002"
    content = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000" + thumbnail + "FF"), frame, F.lit("FFDA")))
    return image_sizes(T.images(spark, d).select("image_id", content.alias("content"), F.col("width").alias("_w"), F.col("height").alias("_h"))).select("image_id", "width", "height")


@query("ocr_lines", """ SELECT image_id, region_idx, (row_number() OVER (PARTITION BY region_idx ORDER BY line_no, text, x, y, width, score) - 1)::INTEGER AS pos, text, x, y, width, height FROM ocr_lines""")
def explode_lines(spark, d):
    """Lines of each region with slanted boxes: corners within the box by fractions of a pixel."""
    lines = T.ocr_lines(spark, d)
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1, y1 = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    polygon = F.array(point(F.col("x") + 0.25, F.col("y") + 0.5), point(x1 - 0.5, F.col("y") + 0.25), point(x1 - 0.75, y1 - 0.5), point(F.col("x") + 0.5, y1 - 0.25))
    # A line of no width has all its corners in one place.
    polygon = F.when(F.col("width") > 0, polygon).otherwise(F.array(point(F.col("x"), F.col("y")), point(F.col("x"), y1)))
    line = F.struct("line_no", "text", "x", "y", "width", "score", polygon.alias("points"))
    ocr = lines.groupBy("image_id", "region_idx").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    ocr = ocr.select("image_id", "region_idx", F.transform("ls", lambda x: F.struct(x["text"].alias("text"), x["points"].alias("points"), x["score"].alias("score"))).alias("lines"))
    return regions.explode_lines(ocr).select("image_id", "region_idx", F.col("line_no").alias("pos"), "text", "x", "y", "width", "height")


@query("cells", """ SELECT image_id, string_agg(printf('%02X%02X%02X%02X', b, g, r, a), '' ORDER BY col, 7 - row) AS bytes FROM cells GROUP BY 1""")
def rotate_images(spark, d):
    from rastermill.operators import pixels

    return pixels.rotate_images(T.pictures(spark, d), 90).select("image_id", F.hex("data").alias("bytes"))



@query("cells", """, l AS (SELECT image_id, row, col, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE < 128 AS ink FROM cells),
small AS (SELECT image_id, row // 2 AS y, col // 2 AS x, ink FROM l WHERE row % 2 = 0 AND col % 2 = 0),
reach(image_id, y, x, l) AS (SELECT image_id, y, x, y * 4 + x FROM small WHERE ink
UNION SELECT i.image_id, i.y, i.x, r.l FROM reach r JOIN small i ON i.ink AND i.image_id = r.image_id AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1),
lab AS (SELECT image_id, y, x, min(l) AS l FROM reach GROUP BY ALL), comp AS (SELECT image_id, l, (max(y) - min(y) + 1) * 2 AS h FROM lab GROUP BY ALL),
cs AS (SELECT image_id, count(*) AS n, avg(h) AS h FROM comp GROUP BY 1),
band AS (SELECT image_id, y, avg(CASE WHEN ink THEN 1.0::DOUBLE ELSE 0 END) AS v FROM small WHERE x % 2 = 0 GROUP BY ALL), bs AS (SELECT image_id, stddev_pop(v) AS row_std FROM band GROUP BY 1),
ds AS (SELECT image_id, avg(CASE WHEN ink THEN 1.0::DOUBLE ELSE 0 END) AS dark_share FROM l GROUP BY 1)
SELECT image_id, round(dark_share, 6) AS dark_share, coalesce(n, 0)::BIGINT AS n_components, round(coalesce(n, 0) * 625.0::DOUBLE, 6) AS per_area, round(coalesce(h, 0.0::DOUBLE), 6) AS mean_height, round(row_std, 6) AS row_std
FROM ds JOIN bs USING (image_id) LEFT JOIN cs USING (image_id)""")
def ink_features(spark, d):
    from rastermill.operators import pixels

    pictures = T.pictures(spark, d)
    out = pixels.ink_features(pictures, pictures.select("image_id", F.lit(128).alias("threshold")))
    return out.select("image_id", "n_components", *(F.round(c, 6).alias(c) for c in ("dark_share", "per_area", "mean_height", "row_std")))


_SQL["ink_features"] = _SQL["ink_features"].replace("WITH ", "WITH RECURSIVE ", 1)


@query()
def preprocess_images(spark, d):
    from rastermill.operators import pixels

    pictures = T.pictures(spark, d)
    plan = stats.preprocess_plan(pictures.select("image_id", F.lit(640).alias("width"), F.lit(480).alias("height")), T.histograms(spark, d))
    return pixels.preprocess_images(pictures, plan).select("image_id", "width", "height", F.hex("data").alias("bytes"), F.array_join("applied", "+").alias("applied"))


@query("cells", """, ink AS (SELECT image_id, row, col FROM cells WHERE b < 100), RECUR
SELECT image_id, row, col, (min(l) // 8)::INTEGER AS label_row, (min(l) % 8)::INTEGER AS label_col FROM reach GROUP BY ALL""".replace("RECUR", """reach(image_id, row, col, l) AS (SELECT image_id, row, col, row * 8 + col FROM ink
UNION SELECT i.image_id, i.row, i.col, r.l FROM reach r JOIN ink i ON i.image_id = r.image_id AND abs(i.row - r.row) <= 1 AND abs(i.col - r.col) <= 1)"""))
def connected_components(spark, d):
    from rastermill.operators import pixels

    return pixels.connected_components(T.cells(spark, d).where("b < 100").select("image_id", "row", "col"), span=4)


_SQL["connected_components"] = _SQL["connected_components"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("answers", r""", w AS (SELECT rel, trim(coalesce(answer, '')) AS whole FROM answers),
p AS (SELECT rel, whole, list_filter(list_transform(regexp_split_to_array(whole, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts FROM w),
b AS (SELECT rel, regexp_replace(coalesce(parts[2], parts[1], whole), '(?m)^#+\s*', '', 'g') AS body FROM p)
SELECT rel, CASE WHEN length(body) > 600 THEN substr(body, 1, 600) || '…' ELSE body END AS preview FROM b""")
def preview_text(spark, d):
    return T.answers(spark, d).select("rel", S.preview_text(F.col("answer")).alias("preview"))


@query("images", """ SELECT image_id, '## Summary' || chr(10) || width || ' wide' || chr(10) || '## Text' || chr(10) || '### Text 0' || chr(10) || 'h ' || height || chr(10) || '## Details' || chr(10) || '(none)' AS answer FROM images""")
def image_answer(spark, d):
    from rastermill.plans.recognise import image_answer as compose

    im = T.images(spark, d)
    pre = im.select("image_id", F.concat(F.col("width").cast("string"), F.lit(" wide")).alias("summary"), F.lit(True).alias("has_text"))
    texts = im.select("image_id", F.lit(0).alias("region_idx"), F.concat(F.lit("h "), F.col("height").cast("string")).alias("text"))
    return compose(pre, texts, texts.where("false").withColumn("label", F.lit("")))

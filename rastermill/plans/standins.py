"""Stand-in tables: what the operators take, derived from the given tables, in Spark and in SQL.

SQL holds a text for a WITH clause for each table; with_tables() puts those that a query names,
and what they build on, in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.functions.scalars import content_hash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return docs.select("doc_id", rel.alias("rel"), F.col("n_chars").alias("size"), content_hash(F.col("text")).alias("sha"))


def index_log(spark: SparkSession, d: str) -> DataFrame:
    """Two generations: an older failure of toxic rows, and the last record by quality."""
    rows = _table(spark, d, "labels").join(files(spark, d), "doc_id")
    ms = (F.col("doc_id") * 37 % 5000).alias("ms")
    new = rows.select("rel", F.when(F.col("quality") == 1, "done").otherwise("failed").alias("status"), ms, "sha", F.when(F.col("quality") != 1, F.concat(F.lit("bad|input "), "rel")).alias("error"), F.lit(1).alias("seq"))
    old = rows.where("toxic = 1").select("rel", F.lit("failed").alias("status"), ms, "sha", F.lit("timeout").alias("error"), F.lit(0).alias("seq"))
    return new.unionByName(old)


def run_results(spark: SparkSession, d: str) -> DataFrame:
    """Results of a run over the labelled documents; toxic ones failed."""
    rows = _table(spark, d, "labels").join(files(spark, d), "doc_id")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return rows.select("rel", F.when(bad, "failed").otherwise("done").alias("status"), (F.col("doc_id") * 11 % 3000).alias("ms"), F.when(bad, F.lit("no answer")).alias("error"), (F.col("doc_id") % 2 == 0).alias("cached"), F.when(F.col("doc_id") % 5 == 0, F.lit("src0/0.png")).alias("duplicate_of"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".png"))
    return docs.select(rel.alias("rel"), F.col("text").alias("answer"))


def images(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("image_id"), (200 + F.col("n_chars") * 37 % 9000).cast("int").alias("width"), (200 + F.col("n_chars") * 53 % 8000).cast("int").alias("height"))


def sized_tiles(spark: SparkSession, d: str) -> DataFrame:
    from rastermill.operators.tiles import tile_grid

    return tile_grid(images(spark, d)).withColumn("bytes", (F.col("w") * F.col("h") * 2).cast("long"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    line = _table(spark, d, "lineitem")
    n = F.lit(1000)
    return line.select((F.col("l_orderkey") % n).alias("image_id"), (F.col("l_linenumber") - 1).alias("region_idx"), F.col("l_orderkey").alias("order_id"), (F.col("l_discount") * 5).alias("rx0"), (F.col("l_tax") * 5).alias("ry0"), (F.col("l_quantity") / 50).alias("rx1"), ((F.col("l_linenumber") * 13 % 100) / 100.0).cast("double").alias("ry1"))


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    line = _table(spark, d, "lineitem")
    return line.select((F.col("l_orderkey") % 1000).alias("image_id"), F.col("l_orderkey").alias("region_idx"), F.col("l_linenumber").alias("line_no"), F.col("l_returnflag").alias("text"), (F.lit(1.0) - F.col("l_discount") - F.col("l_tax")).alias("score"), (F.col("l_partkey") % 700).cast("int").alias("x"), (F.col("l_suppkey") % 500).cast("int").alias("y"), (F.col("l_quantity") * 3).cast("int").alias("width"), F.lit(20).alias("height"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Each vector as a picture of 8 x 8 cells."""
    e = _table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    v = lambda k: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + F.element_at("embedding", ((F.col("i") + k) % 64 + 1).cast("int")).cast("double") * 500))).cast("int")
    return e.select(F.col("vec_id").alias("image_id"), F.floor(F.col("i") / 8).cast("int").alias("row"), (F.col("i") % 8).cast("int").alias("col"), v(0).alias("r"), v(21).alias("g"), v(42).alias("b"), F.when((F.col("vec_id") + F.col("i")) % 11 == 0, 0).otherwise(255).alias("a"))


def histograms(spark: SparkSession, d: str) -> DataFrame:
    grey = F.floor((299 * F.col("r") + 587 * F.col("g") + 114 * F.col("b")) / 1000).cast("int")
    return cells(spark, d).groupBy("image_id", grey.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))


def cache_entries(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("-", F.col("user_id").cast("string"), "event_type")
    rows = _table(spark, d, "events").select(F.substring(key, 1, 2).alias("shard"), key.alias("key"), "ts", F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("value"), F.floor(F.col("value") * 1000).cast("long").alias("bytes"), "event_id")
    # The newest record of each key, the larger event where times are equal.
    best = rows.groupBy("shard", "key").agg(F.max_by(F.struct("ts", "value", "bytes"), F.struct("ts", "event_id")).alias("r"))
    return best.select("shard", "key", "r.*")


def now(spark: SparkSession, d: str):
    """The largest event time: fixed for given data."""
    return F.lit(_table(spark, d, "events").agg(F.max("ts")).first()[0])


def responses(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    status = F.create_map(*[F.lit(x) for kv in {"click": 200, "view": 429, "error": 503, "signup": 404, "purchase": 400}.items() for x in kv])
    fields = F.element_at(F.array(*map(F.lit, ["max_tokens is not supported", "unknown detail", "use max_completion_tokens", "bad reasoning_effort", "no such thing", "Thinking is off"])), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", "user_id", F.element_at(status, F.col("event_type")).alias("status"), F.when(F.col("event_type") == "purchase", fields).otherwise(F.col("props")).alias("body"), F.col("props"))


SQL = {
    "files": "SELECT doc_id, source || '/' || doc_id || '.png' AS rel, n_chars AS size, substr(sha256(text), 1, 32) AS sha FROM documents",
    "labelled": "SELECT f.*, l.quality, l.toxic FROM files f JOIN labels l USING (doc_id)",
    "index_log": """SELECT rel, CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS status, doc_id * 37 % 5000 AS ms, sha, CASE WHEN quality <> 1 THEN 'bad|input ' || rel END AS error, 1 AS seq FROM labelled
      UNION ALL SELECT rel, 'failed', doc_id * 37 % 5000, sha, 'timeout', 0 FROM labelled WHERE toxic = 1""",
    "last_log": "SELECT * FROM index_log QUALIFY row_number() OVER (PARTITION BY rel ORDER BY seq DESC) = 1",
    "run_results": """SELECT rel, CASE WHEN toxic = 1 THEN 'failed' ELSE 'done' END AS status, doc_id * 11 % 3000 AS ms, CASE WHEN toxic = 1 THEN 'no answer' END AS error,
      doc_id % 2 = 0 AS cached, CASE WHEN doc_id % 5 = 0 THEN 'src0/0.png' END AS duplicate_of FROM labelled""",
    "answers": "SELECT source || '/' || doc_id || '.png' AS rel, text AS answer FROM documents",
    "images": "SELECT doc_id AS image_id, (200 + n_chars * 37 % 9000)::INTEGER AS width, (200 + n_chars * 53 % 8000)::INTEGER AS height FROM documents",
    "axis_c": """SELECT image_id, c.i AS col, c.i * 800 AS x, CASE WHEN split THEN least(800, width - c.i * 800) ELSE width END AS w, n_cols
      FROM (SELECT *, greatest(width, height) > 800 AS split, CASE WHEN greatest(width, height) > 800 THEN ceil(width / 800.0)::INTEGER ELSE 1 END AS n_cols FROM images) g, range(g.n_cols) c(i)""",
    "axis_r": """SELECT image_id, r.i AS row, r.i * 800 AS y, CASE WHEN split THEN least(800, height - r.i * 800) ELSE height END AS h, n_rows
      FROM (SELECT *, greatest(width, height) > 800 AS split, CASE WHEN greatest(width, height) > 800 THEN ceil(height / 800.0)::INTEGER ELSE 1 END AS n_rows FROM images) g, range(g.n_rows) r(i)""",
    "tiles": "SELECT image_id, (row * n_cols + col)::INTEGER AS tile_id, row::INTEGER AS row, col::INTEGER AS col, x::INTEGER AS x, y::INTEGER AS y, w::INTEGER AS w, h::INTEGER AS h, n_rows, n_cols FROM axis_c JOIN axis_r USING (image_id)",
    "sized_tiles": "SELECT *, (w * h * 2)::BIGINT AS bytes FROM tiles",
    "regions": """SELECT l_orderkey % 1000 AS image_id, l_linenumber - 1 AS region_idx, l_orderkey AS order_id, l_discount * 5 AS rx0, l_tax * 5 AS ry0, l_quantity / 50 AS rx1, (l_linenumber * 13 % 100) / 100.0::DOUBLE AS ry1 FROM lineitem""",
    "ocr_lines": """SELECT l_orderkey % 1000 AS image_id, l_orderkey AS region_idx, l_linenumber AS line_no, l_returnflag AS text, 1.0::DOUBLE - l_discount - l_tax AS score,
      (l_partkey % 700)::INTEGER AS x, (l_suppkey % 500)::INTEGER AS y, floor(l_quantity * 3)::INTEGER AS width, 20 AS height FROM lineitem""",
    "cells": """SELECT vec_id AS image_id, (i // 8)::INTEGER AS row, (i % 8)::INTEGER AS col,
      greatest(0, least(255, floor(128 + embedding[i % 64 + 1]::DOUBLE * 500)))::INTEGER AS r, greatest(0, least(255, floor(128 + embedding[(i + 21) % 64 + 1]::DOUBLE * 500)))::INTEGER AS g,
      greatest(0, least(255, floor(128 + embedding[(i + 42) % 64 + 1]::DOUBLE * 500)))::INTEGER AS b, CASE WHEN (vec_id + i) % 11 = 0 THEN 0 ELSE 255 END AS a FROM embeddings, range(64) t(i)""",
    "histograms": "SELECT image_id, ((299 * r + 587 * g + 114 * b) // 1000)::INTEGER AS bin, count(*) AS cnt FROM cells GROUP BY ALL",
    "cache_entries": """SELECT substr(user_id || '-' || event_type, 1, 2) AS shard, user_id || '-' || event_type AS key, ts, CASE WHEN event_id % 4 <> 0 THEN props END AS value, floor(value * 1000)::BIGINT AS bytes
      FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
    "clock": "SELECT max(ts) AS now FROM events",
    "responses": """SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 429 WHEN 'error' THEN 503 WHEN 'signup' THEN 404 WHEN 'purchase' THEN 400 END AS status,
      CASE WHEN event_type = 'purchase' THEN ['max_tokens is not supported', 'unknown detail', 'use max_completion_tokens', 'bad reasoning_effort', 'no such thing', 'Thinking is off'][event_id % 6 + 1] ELSE props END AS body, props FROM events""",
}
_USES = {"labelled": ["files"], "index_log": ["labelled"], "last_log": ["index_log"], "run_results": ["labelled"], "axis_c": ["images"], "axis_r": ["images"], "tiles": ["axis_c", "axis_r"], "sized_tiles": ["tiles"], "histograms": ["cells"]}


def with_tables(names: str, body: str) -> str:
    """body with the named stand-in tables in front; body may begin with further ones, after a comma."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in _USES.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in names.split():
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + body


def pictures(spark: SparkSession, d: str) -> DataFrame:
    """The cells of each vector as a decoded image of 8 x 8 pixels (rows of BGRA bytes)."""
    two = lambda c: F.lpad(F.hex(F.col(c)), 2, "0")
    pixel = F.struct("row", "col", F.concat(two("b"), two("g"), two("r"), two("a")).alias("p"))
    rows = cells(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(pixel)).alias("ps"))
    return rows.select("image_id", F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit(4).alias("n_channels"), F.unhex(F.array_join(F.col("ps.p"), "")).alias("data"))

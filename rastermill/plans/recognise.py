"""Whole recognition runs: composition of the operators around model and OCR functions of the user.

Every round of calls is written to `work` before it is used, so a failed step repeats no calls; what
responses.retry_plan wants tried again is tried again.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.operators import batch, cache, pixels, regions, responses, stats, tiles
from rastermill.sources import images as sources
from rastermill.sources import logs


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def image_answer(prechecks: DataFrame, texts: DataFrame, details: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """One text per image: summary, transcribed regions, layout grids, regions of interest.

    texts: image_id, region_idx, text; details: image_id, region_idx, label, text; grids: image_id, grid.
    """
    joined = lambda df, head: df.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("region_idx", F.concat(head, F.lit("\n"), "text").alias("t")))).alias("x")).select("image_id", F.array_join(F.col("x.t"), "\n\n").alias("t"))
    t = joined(texts, F.concat(F.lit("### Text "), F.col("region_idx").cast("string"))).withColumnRenamed("t", "texts")
    named = F.when(F.length("label") > 0, F.col("label")).otherwise(F.concat(F.lit("region "), F.col("region_idx").cast("string")))
    d = joined(details, F.concat(F.lit("### "), named)).withColumnRenamed("t", "details")
    rows = prechecks.join(t, "image_id", "left").join(d, "image_id", "left")
    rows = rows.join(grids, "image_id", "left") if grids is not None else rows.withColumn("grid", F.lit(None).cast("string"))
    summary = F.when(F.length("summary") > 0, F.col("summary")).otherwise("(no summary)")
    text = F.coalesce("texts", F.when(F.col("has_text"), "(no region could be transcribed)").otherwise("(no text)"))
    return rows.select(
        "image_id",
        F.concat_ws("\n", F.lit("## Summary"), summary, F.lit("## Text"), text, F.when(F.col("grid").isNotNull(), F.concat(F.lit("## Layout\n"), "grid")), F.lit("## Details"), F.coalesce("details", F.lit("(none)"))).alias("answer"),
    )


def ocr_parts(ocr: DataFrame) -> DataFrame:
    """OCR answers with the text alone: text becomes plain; adds confidence and n_lines.

    An answer may be plain lines (confidence 1) or a JSON object {"lines": [{"text": .., "score": ..}]}.
    ocr: image_id, region_idx, text, error.
    """
    lines = F.try_variant_get(F.try_parse_json("text"), "$.lines", "array<struct<text:string,score:double>>")
    rows = ocr.withColumn("lines", F.when(F.col("text").startswith("{"), lines))
    kept = rows.where("lines IS NOT NULL").select("image_id", "region_idx", F.posexplode("lines").alias("line_no", "l")).select("image_id", "region_idx", "line_no", F.col("l.score").alias("score"))
    rows = rows.join(regions.region_confidence(kept).select("image_id", "region_idx", "confidence"), ["image_id", "region_idx"], "left")
    said = F.array_join(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    text = F.when(F.col("lines").isNotNull(), F.when(F.length(F.trim(said)) > 0, said).otherwise("")).otherwise(F.col("text"))
    full = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    n = F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")).otherwise(F.size(full)), F.lit(0))
    return rows.select("image_id", "region_idx", text.alias("text"), "error", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), n.alias("n_lines"))


#: Images that are decoded and recognised together: their paths pass through the driver.
WAVE = 10_000


def _spent(parts: list[DataFrame]) -> DataFrame:
    """image_id, ms: what the calls for each image took."""
    out = None
    for p in parts:
        p = p.select("image_id", "ms")
        out = p if out is None else out.unionByName(p)
    return out.groupBy("image_id").agg(F.sum("ms").alias("ms"))


def recognise_images(images: DataFrame, precheck_fn: Callable[[dict], str], ocr_fn: Callable[[dict], str], model_fn: Callable[[dict], str], work: str, mode: str = "smart") -> DataFrame:
    """image_id, answer, error, ms: pre-check, regions, crops, preparation, OCR or model by handwriting, upgrade, details, answer.

    The functions get a dict with image_id, kind, width, height and pixels in base64 (grey, BGR or BGRA
    rows), and how the request is to be asked this time (see responses.call_with_retries). They return a
    text: precheck_fn JSON, ocr_fn plain lines or JSON lines with scores (see ocr_parts), model_fn a
    transcription or description; an empty OCR answer is taken as it is. OCR gets the crop after
    preprocess_images (enlarged only where handwriting is to be read), the model the crop itself; what
    OCR read with low confidence is transcribed by the model too (kind `upgrade`). An image whose
    pre-check failed for good has no answer but that error. ms is the time of all its calls.
    """
    work = work.rstrip("/")
    ask = lambda df, kind: df.select("image_id", *(c for c in ("region_idx", "label") if c in df.columns), F.lit(kind).alias("kind"), "width", "height", "n_channels", F.base64("data").alias("pixels"))
    spent = []

    def call(rows: DataFrame, kind: str, fn: Callable[[dict], str], name: str) -> DataFrame:
        keys = ["image_id", "region_idx"] if "region_idx" in rows.columns else ["image_id"]
        if kind == "ocr":  # runs beside the data: nothing found is an answer, and asking again finds no more
            said = _written(responses.call_model(ask(rows, kind), fn).withColumnRenamed("body", "text"), f"{work}/{name}").withColumnRenamed("text", "body")
        else:
            said = responses.call_with_retries(ask(rows, kind), fn, f"{work}/{name}", keys)
        spent.append(said)
        return said.select(*keys, F.col("body").alias("text"), "error")

    checks = call(images, "precheck", precheck_fn, "prechecks")
    raw = checks.where("error IS NULL").select("image_id", F.coalesce("text", F.lit("")).alias("raw"))
    pre = responses.parse_prechecks(raw)
    px = regions.regions_to_pixels(regions.explode_regions(pre), images)
    crops = {}
    for kind in ("text", "interest"):
        cut = pixels.crop_regions(px.where(F.col("kind") == kind), images, smooth=True)
        crops[kind] = cut.select("image_id", "region_idx", F.col("out_w").alias("width"), F.col("out_h").alias("height"), "n_channels", "data")
    text_crops = _written(crops["text"], f"{work}/crops")
    crop = F.concat_ws("#", F.col("image_id").cast("string"), F.col("region_idx").cast("string"))
    keyed = text_crops.select(crop.alias("image_id"), "width", "height", "n_channels", "data")
    hist = pixels.tile_histograms(keyed)
    ink = pixels.ink_features(keyed, stats.otsu_threshold(hist))
    local = stats.handwriting_score(ink).select(F.col("image_id").alias("crop"), F.col("is_hand").alias("local_hand"))
    flags = px.where("kind = 'text'").withColumn("crop", crop).join(local, "crop", "left").drop("crop")
    routed = regions.route_handwriting(flags, mode)
    todo = text_crops.join(routed.select("image_id", "region_idx", "to_model"), ["image_id", "region_idx"])
    hand = call(todo.where("to_model"), "handwriting", model_fn, "hand")
    plan = stats.preprocess_plan(keyed, hist).join(todo.select(crop.alias("image_id"), "to_model"), "image_id")
    plan = plan.withColumn("applied", F.when(F.col("to_model"), F.col("applied")).otherwise(F.array_remove("applied", "enlarge")))
    steps = pixels.preprocess_images(keyed, plan.where(F.size("applied") > 0).drop("to_model", "is_dark"))
    steps = steps.select(F.col("image_id").alias("crop"), F.col("width").alias("w"), F.col("height").alias("h"), F.lit(1).alias("c"), F.col("data").alias("d"))
    prepared = todo.withColumn("crop", crop).join(steps, "crop", "left")
    prepared = prepared.select("image_id", "region_idx", *(F.coalesce(new, old).alias(old) for new, old in (("w", "width"), ("h", "height"), ("c", "n_channels"), ("d", "data"))))
    ocr_out = ocr_parts(call(prepared, "ocr", ocr_fn, "ocr"))
    failed = todo.where("NOT to_model").join(ocr_out.where("error IS NOT NULL OR length(text) = 0").select("image_id", "region_idx"), ["image_id", "region_idx"], "left_semi")
    calls = hand.unionByName(call(failed, "fallback", model_fn, "fallback"))
    dark = plan.select(F.col("image_id").alias("crop"), "is_dark")
    read = routed.withColumn("crop", crop).join(dark, "crop", "left").join(ocr_out.where("error IS NULL AND length(text) > 0").drop("text", "error"), ["image_id", "region_idx"])
    read = read.withColumn("degraded", F.lit(False)).withColumn("engine", F.when(F.col("to_model"), "handwrite-api").otherwise("ocr"))
    weak = regions.needs_upgrade(read).where("upgrade").select("image_id", "region_idx")
    better = call(text_crops.join(weak, ["image_id", "region_idx"], "left_semi"), "upgrade", model_fn, "upgrade")
    texts = regions.resolve_region_text(routed, ocr_out, calls, better).select("image_id", "region_idx", "text")
    labels = px.where("kind = 'interest'").select("image_id", "region_idx", "label")
    details = call(crops["interest"], "detail", model_fn, "details").where("error IS NULL").join(labels, ["image_id", "region_idx"])
    grids = stats.ascii_grid(pixels.sample_cells(images))
    answers = image_answer(pre, texts, details, grids)
    out = checks.select("image_id", "error").join(answers, "image_id", "left").join(_spent(spent), "image_id", "left")
    return out.select("image_id", "answer", "error", F.coalesce("ms", F.lit(0).cast("long")).alias("ms"))


def recognise_tiles(images: DataFrame, model_fn: Callable[[dict], str], work: str, block: int = 800, overlap: int = 0) -> DataFrame:
    """image_id, answer, error, ms: every tile of every image in groups and payload batches, then one request over the group texts.

    An image one of whose requests failed for good has no answer but the error of the first of them.
    """
    work = work.rstrip("/")
    grid = tiles.tile_grid(images, block, overlap, block)
    cut = _written(pixels.extract_tiles(grid, images), f"{work}/tiles")
    sized = cut.select("image_id", "tile_id", F.length("data").cast("long").alias("bytes"), F.struct("x", "y", "w", "h", F.base64("data").alias("pixels")).alias("ref"))
    batched = tiles.batch_payloads(tiles.group_tiles(sized))
    requests = responses.build_requests(batched, "tiles").drop("request_id")
    lists = tiles.tile_list_text(grid, images).withColumnRenamed("text", "tile_list")
    said = responses.call_with_retries(requests.join(lists, "image_id"), model_fn, f"{work}/batches", ["image_id", "group_idx", "batch_idx"])
    said = _written(said.select("image_id", "group_idx", "batch_idx", F.coalesce("body", F.lit("")).alias("text"), "error", "ms"), f"{work}/said")
    wrong = said.where("error IS NOT NULL").groupBy("image_id").agg(F.min_by("error", F.struct("group_idx", "batch_idx")).alias("error"))
    mode = tiles.choose_mode(sized.select("image_id", "bytes"), fallback=True).select("image_id", "mode")
    whole = _written(responses.group_text(said.select("image_id", "group_idx", "batch_idx", "text")).join(mode, "image_id").join(wrong, "image_id", "left"), f"{work}/whole")
    layered = whole.where("mode = 'layered' AND error IS NULL").select("image_id", F.lit("aggregate").alias("kind"), "text")
    final = responses.call_with_retries(layered, model_fn, f"{work}/aggregates", ["image_id"])
    final = final.select("image_id", F.when(F.col("error").isNull(), F.col("body")).alias("answer"), "error", "ms")
    single = whole.where("mode = 'single' OR error IS NOT NULL").select("image_id", F.when(F.col("error").isNull(), F.col("text")).alias("answer"), "error", F.lit(0).cast("long").alias("ms"))
    every = single.unionByName(final)
    out = every.drop("ms").join(_spent([said, every]), "image_id", "left")
    return _written(out.select("image_id", "answer", "error", "ms"), f"{work}/answers")


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "rel string, answer string, error string, ms long")


def _recognised(spark: SparkSession, missed: DataFrame, n: int, folder: str, recursive: bool, strategy: str, fns: dict[str, Callable[[dict], str]], work: str) -> DataFrame:
    """rel, answer, error, ms of n files, about WAVE at a time: exactly these are opened, and a wave's answers are written before the next begins."""
    out, waves = _none(spark), -(-n // WAVE)
    for wave in range(waves):
        rows = missed.where(F.pmod(F.xxhash64("path"), F.lit(waves)) == wave)
        paths = [r.path for r in rows.select("path").collect()]
        loaded = sources.load_images(spark, folder, recursive, paths).withColumnRenamed("rel", "image_id")
        own = f"{work}/wave={wave}"
        images = loaded.where("error IS NULL").drop("error")
        if strategy == "pipeline":
            answers = recognise_images(images, fns["precheck"], fns["ocr"], fns["model"], own)
        else:
            answers = recognise_tiles(images, fns["model"], own)
        broken = loaded.where("error IS NOT NULL").select("image_id", F.lit(None).cast("string").alias("answer"), "error", F.lit(0).cast("long").alias("ms"))
        out = out.unionByName(_written(answers.unionByName(broken).withColumnRenamed("image_id", "rel"), f"{own}/run_answers"))
    return out


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that earlier runs wrote, or an empty one."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: What a run has of each of its files.
ENTRIES = "rel string, status string, ms long, cached boolean, duplicate_of string, error string, sha string, answer string, seq long, at string"


def run_batch(spark: SparkSession, folder: str, out: str, strategy: str, fns: dict[str, Callable[[dict], str]], pattern: str | None = None, recursive: bool = False, resume: bool = True, limit: int | None = None, params: dict[str, str] | None = None) -> DataFrame:
    """A resumable run over a folder: scan, plan, dedupe, cache, recognise, log, reports. Returns the state of every file.

    fns: precheck, ocr and model for strategy `pipeline`, model for `full`. Called again it does only
    what is new or failed: files that are done are not opened, cached ones not decoded, and where
    nothing is left to do only the reports are written anew. A failed file keeps the message of what failed;
    ms is the time of its calls. An empty folder still gives reports.
    """
    if strategy not in ("pipeline", "full"):
        raise ValueError("strategy must be pipeline or full")
    out = out.rstrip("/")
    work = f"{out}/work"
    files = _written(sources.scan_images(spark, folder, pattern, recursive), f"{work}/files")
    index = logs.ProgressLog(spark, f"{out}/index")
    log = _written(index.read(), f"{work}/log")
    plan = batch.plan_batch(files, log, resume, limit).where("label = 'todo'").select("rel", "path", "size")
    plan = _written(plan, f"{work}/plan")
    if plan.isEmpty():
        entries = spark.createDataFrame([], ENTRIES)
    else:
        entries = _run(spark, plan, folder, out, strategy, fns, recursive, params)
        index.append(entries.drop("answer"))
        index.compact_if_long()
        entries.where("status = 'done'").select("rel", "answer", "seq").write.mode("append").parquet(f"{out}/answers")
    kept = batch.latest_per_key(_stored(spark, f"{out}/answers", "rel string, answer string, seq long")).select("rel", "answer")
    status = batch.merge_status(files, entries, log).join(entries.select("rel", "sha", "cached", "duplicate_of", "answer"), "rel", "left")
    status = _written(batch.attach_answers(status, kept), f"{out}/status")
    logs.write_reports(status, entries, f"{out}/reports")
    return status


def _run(spark: SparkSession, plan: DataFrame, folder: str, out: str, strategy: str, fns: dict[str, Callable[[dict], str]], recursive: bool, params: dict[str, str] | None) -> DataFrame:
    """The entries of the planned files: copies, cached answers and new ones."""
    work = f"{out}/work"
    content = sources.with_content(plan).select("rel", "path", "sha", "read_error")
    todo = _written(batch.dedupe_content(content), f"{work}/todo")
    own = F.create_map(*[F.lit(x) for kv in ({"strategy": strategy} | (params or {})).items() for x in kv])
    keyed = cache.with_cache_key(todo.where("duplicate_of IS NULL AND sha IS NOT NULL").withColumn("params", own)).drop("params", "read_error")
    stored = _stored(spark, f"{out}/cache", "key string, ts timestamp, value string, bytes long, shard string")
    looked = _written(cache.cache_lookup(keyed, stored, None, F.current_timestamp()), f"{work}/looked")
    missed = looked.where("NOT hit")
    n = missed.count()
    answers = _recognised(spark, missed, n, folder, recursive, strategy, fns, work)
    got = looked.join(answers, "rel", "left").withColumn("answer", F.coalesce("cached_value", "answer"))
    good = F.coalesce(F.length(F.trim("answer")) > 0, F.lit(False))
    error = F.when(~good, F.coalesce("error", F.lit("no answer")))
    unread = todo.where("sha IS NULL").select("rel", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("ms"), F.coalesce("read_error", F.lit("can't be read")).alias("error"), *(F.lit(None).cast(k).alias(c) for c, k in (("answer", "string"), ("hit", "boolean"), ("sha", "string"), ("key", "string"), ("shard", "string"))))
    results = got.select("rel", F.when(good, "done").otherwise("failed").alias("status"), F.coalesce("ms", F.lit(0).cast("long")).alias("ms"), error.alias("error"), "answer", "hit", "sha", "key", "shard")
    results = _written(results.unionByName(unread), f"{work}/results")
    if n:
        cache.write_cache(results.where("NOT hit").select("shard", "key", F.current_timestamp().alias("ts"), F.col("answer").alias("value"), F.length("answer").cast("long").alias("bytes"), (F.col("status") == "done").alias("ok")), f"{out}/cache")
    spread = batch.fan_out_duplicates(todo, results).withColumn("status", F.coalesce("status", F.lit("failed")))
    texts = todo.select("rel", "sha", F.coalesce("duplicate_of", "rel").alias("source")).join(results.select(F.col("rel").alias("source"), "answer", "hit"), "source", "left").drop("source")
    entries = spread.join(texts, "rel", "left").withColumn("cached", F.coalesce(F.col("cached") | F.col("hit"), F.lit(False)))
    seq = int(spark.range(1).select(F.unix_millis(F.current_timestamp())).first()[0])
    entries = entries.withColumn("seq", F.lit(seq).cast("long")).withColumn("at", F.lit(f"{seq:020d}"))
    return _written(entries.select(*(f.split()[0] for f in ENTRIES.split(", "))), f"{work}/entries")


def pixels_of(request: dict) -> bytes:
    """The bytes that a request of recognise_images holds."""
    return base64.b64decode(request["pixels"])

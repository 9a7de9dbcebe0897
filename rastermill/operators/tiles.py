"""Tile grids: exact source coordinates, numbering, grouping and payload limits.

images: image_id, width, height; tiles: image_id, row, col, x, y, w, h.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.scalars import round_half_up

# Limits of one request.
MAX_IMAGES, MAX_IMAGE_BYTES, MAX_BASE64_BYTES = 240, 32 << 20, 36 << 20


def needs_split(images: DataFrame, threshold: int = 800) -> DataFrame:
    """Adds needs_split: whether the longer side is above the threshold."""
    return images.withColumn("needs_split", F.greatest("width", "height") > threshold)


def _tiles_along(side: Column, block: int, step: int) -> Column:
    """How many tiles a side takes: a row ends at the first tile that is narrower than the block."""
    whole = F.greatest(F.floor((side - block) / step) + 1, F.lit(0))
    return (F.least(whole, F.ceil(side / step) - 1) + 1).cast("int")


def tile_grid(images: DataFrame, block: int = 800, overlap: int = 0, threshold: int = 800) -> DataFrame:
    """All tiles of every image, by row and column; an image that needs no split is one tile.

    Tiles at the edge keep what is left. If a tile ends on the edge and tiles overlap, one more
    sliver as wide as the overlap follows. Sizes must be positive.
    """
    if block != int(block) or block < 64:
        raise ValueError("block must be an integer of 64 or more")
    if overlap != int(overlap) or not 0 <= overlap < block / 2:
        raise ValueError("overlap must be an integer from 0 to below half of block")
    step = block - overlap
    split = F.greatest("width", "height") > threshold
    rows = images.where("width > 0 AND height > 0").select("image_id", "width", "height", split.alias("_split"))
    along = lambda side: F.when(F.col("_split"), _tiles_along(F.col(side), block, step)).otherwise(1)
    rows = rows.withColumn("n_rows", along("height")).withColumn("n_cols", along("width"))
    rows = rows.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)))
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)))
    rows = rows.withColumn("x", F.col("col") * step).withColumn("y", F.col("row") * step)
    size = lambda side, at: F.when(F.col("_split"), F.least(F.lit(block), F.col(side) - F.col(at))).otherwise(F.col(side)).cast("int")
    rows = rows.withColumn("w", size("width", "x")).withColumn("h", size("height", "y"))
    return rows.select("image_id", (F.col("row") * F.col("n_cols") + F.col("col")).alias("tile_id"), "row", "col", "x", "y", "w", "h", "n_rows", "n_cols")


def tile_name(base: Column, ext: str = "png") -> Column:
    return F.format_string(f"%s_r%d_c%d_x%d_y%d_%dx%d.{ext}", base, "row", "col", "x", "y", "w", "h")


def grid_shape(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("image_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))


def tile_ids(tiles: DataFrame) -> DataFrame:
    """Adds tile_id = row * columns + column for tiles that come without their grid."""
    shape = grid_shape(tiles).select("image_id", F.col("n_cols").alias("_cols"))
    return tiles.join(shape, "image_id").withColumn("tile_id", F.col("row") * F.col("_cols") + F.col("col")).drop("_cols")


def group_tiles(tiles: DataFrame, group_size: int = 40) -> DataFrame:
    """Adds group_idx: runs of group_size tiles in order of tile_id (which counts from 0 without gaps)."""
    return tiles.withColumn("group_idx", F.floor(F.col("tile_id") / group_size).cast("int"))


def batch_payloads(grouped: DataFrame, max_bytes: int = MAX_BASE64_BYTES) -> DataFrame:
    """Adds batch_idx within each group: one batch if the base64 estimate fits, else equal runs of tiles.

    grouped: image_id, group_idx, tile_id, bytes. Groups are bounded by their size in tiles.
    """
    w = Window.partitionBy("image_id", "group_idx")
    n, est = F.count(F.lit(1)).over(w), F.ceil(F.sum("bytes").over(w) * 4 / 3)
    per = F.greatest(F.lit(1), F.floor(F.lit(max_bytes) / (F.col("_est") / F.col("_n") * 1.2)))
    rows = grouped.withColumn("_n", n).withColumn("_est", est).withColumn("_rn", F.row_number().over(w.orderBy("tile_id")) - 1)
    return rows.withColumn("batch_idx", F.when(F.col("_est") <= max_bytes, 0).otherwise(F.floor(F.col("_rn") / per)).cast("int")).drop("_n", "_est", "_rn")


def payload_check(tiles: DataFrame, max_images: int = MAX_IMAGES, max_image: int = MAX_IMAGE_BYTES, max_total: int = MAX_BASE64_BYTES) -> DataFrame:
    """Per image: n, total_bytes, base64_bytes, too_large (a single image), too_many, too_heavy, max_batch.

    max_batch is null where nothing is exceeded or where batching does not help (too_large).
    """
    rows = tiles.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("_most"))
    rows = rows.withColumn("base64_bytes", F.ceil(F.col("total_bytes") * 4 / 3).cast("long"))
    rows = rows.withColumn("too_large", F.col("_most") > max_image).withColumn("too_many", F.col("n") > max_images).withColumn("too_heavy", F.col("base64_bytes") > max_total)
    by_bytes = F.greatest(F.lit(1), F.floor(F.lit(max_total) / (F.col("base64_bytes") / F.col("n") * 1.2)))
    batch = F.least(F.when(F.col("too_many"), F.lit(max_images)), F.when(F.col("too_heavy"), by_bytes))
    return rows.withColumn("max_batch", F.when(~F.col("too_large"), batch).cast("long")).drop("_most")


def choose_mode(tiles: DataFrame, mode: str = "auto", single_max: int = 60, fallback: bool = False) -> DataFrame:
    """Per image: n_tiles, mode (single or layered) and error where single exceeds the limits of a request.

    fallback: `auto` takes layered instead of failing. tiles: image_id, bytes.
    """
    if mode not in ("auto", "single", "layered"):
        raise ValueError("mode must be auto, single or layered")
    rows = payload_check(tiles).withColumnRenamed("n", "n_tiles")
    want = F.when(F.col("n_tiles") <= single_max, "single").otherwise("layered") if mode == "auto" else F.lit(mode)
    over = F.col("too_large") | F.col("too_many") | F.col("too_heavy")
    if mode == "auto" and fallback:
        want = F.when(over, "layered").otherwise(want)
    rows = rows.withColumn("mode", want)
    return rows.select("image_id", "n_tiles", "mode", F.when((F.col("mode") == "single") & over, F.lit("payload too large for one request")).alias("error"))


def tile_list_text(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """Per image a table of its tiles: number, row and column, source rectangle, size."""
    line = F.format_string("| %d | r%dc%d | %d,%d → %d,%d | %d×%d |", "tile_id", "row", "col", "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"), "w", "h")
    lists = tiles.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("tile_id", line.alias("line")))).alias("ls"), F.max("n_rows").alias("r"), F.max("n_cols").alias("c"))
    head = F.format_string("Source %d×%d px, grid %d×%d\n| # | tile | x0,y0 → x1,y1 | size |\n|---|---|---|---|\n", "width", "height", "r", "c")
    return lists.join(images.select("image_id", "width", "height"), "image_id").select("image_id", F.concat(head, F.array_join(F.col("ls.line"), "\n")).alias("text"))


def overview_layout(tiles: DataFrame, images: DataFrame, edge: int = 800) -> DataFrame:
    """Where each numbered tile lies in an overview of at most `edge` pixels: ox, oy, ow, oh."""
    rows = tiles.join(images.select("image_id", "width", "height"), "image_id")
    scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest("width", "height"))
    at = lambda c: round_half_up(F.col(c) * scale)
    return rows.select("image_id", "tile_id", at("x").alias("ox"), at("y").alias("oy"), F.greatest(F.lit(2), at("w")).alias("ow"), F.greatest(F.lit(2), at("h")).alias("oh"))


def tile_neighbours(tiles: DataFrame) -> DataFrame:
    """Pairs of tiles (a < b) of an image that touch or overlap, with the shared rectangle (may be thin).

    Each tile meets its neighbours by an equi-join on (image, row, column); only four offsets are needed.
    """
    offsets = F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))))
    a = tiles.select("image_id", F.col("tile_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in "xywh"), "row", "col", F.explode(offsets).alias("o"))
    a = a.withColumn("row", F.col("row") + F.col("o.dr")).withColumn("col", F.col("col") + F.col("o.dc")).drop("o")
    b = tiles.select("image_id", "row", "col", F.col("tile_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in "xywh"))
    x0, y0 = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    x1, y1 = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")), F.least(F.col("a_y") + F.col("a_h"), F.col("b_y") + F.col("b_h"))
    pairs = a.join(b, ["image_id", "row", "col"]).select("image_id", "a", "b", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return pairs.where("x1 >= x0 AND y1 >= y0")


def tile_objects_to_source(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """Objects with rectangles relative to their tile (x0, y0, x1, y1) in source coordinates."""
    at = tiles.select("image_id", "tile_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    rows = objects.join(at, ["image_id", "tile_id"])
    return rows.withColumns({c: F.col(c) + F.col("tx" if c[0] == "x" else "ty") for c in ("x0", "y0", "x1", "y1")}).drop("tx", "ty")


def own_overlap(objects: DataFrame, tiles: DataFrame) -> DataFrame:
    """Keeps one sighting of each object: that of the tile whose middle is nearest to the object's centre (ties: lowest tile).

    objects: image_id, object_key, tile_id, x0, y0, x1, y1 in source coordinates.
    """
    at = tiles.select("image_id", "tile_id", (F.col("x") * 2 + F.col("w")).alias("mx"), (F.col("y") * 2 + F.col("h")).alias("my"))
    rows = objects.join(at, ["image_id", "tile_id"])
    far = F.greatest(F.abs(F.col("x0") + F.col("x1") - F.col("mx")), F.abs(F.col("y0") + F.col("y1") - F.col("my")))
    keep = [c for c in objects.columns if c not in ("image_id", "object_key")]
    best = rows.groupBy("image_id", "object_key").agg(F.min_by(F.struct(*keep), F.struct(far, "tile_id")).alias("r"))
    return best.select("image_id", "object_key", *(F.col(f"r.{c}").alias(c) for c in keep))


def stitch_rows(objects: DataFrame, band: int = 12, gap: int = 24) -> DataFrame:
    """Text pieces on one visual row (same band of y) joined from left to right where gaps are small.

    objects: image_id, x0, x1, y0, text. A piece that starts before its predecessor's end (in the
    overlap of two tiles) loses the characters that the predecessor already ends with.
    """
    rows = objects.withColumn("band_no", F.floor(F.col("y0") / band).cast("long"))
    w = Window.partitionBy("image_id", "band_no").orderBy("x0", "x1", "text")
    rows = rows.withColumn("before", F.lag("x1").over(w)).withColumn("before_text", F.lag("text").over(w))
    rows = rows.withColumn("new", F.when(F.col("before").isNull() | (F.col("x0") - F.col("before") > gap), 1).otherwise(0))
    rows = rows.withColumn("line_no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # The longest end of the piece before that this piece starts with.
    shared = F.expr("""CASE WHEN new = 0 AND x0 < before THEN array_max(transform(sequence(0, least(length(before_text), length(text))),
        n -> CASE WHEN substring(before_text, length(before_text) - n + 1, n) = substring(text, 1, n) THEN n ELSE 0 END)) ELSE 0 END""")
    rows = rows.withColumn("shared", shared).withColumn("piece", F.expr("concat(CASE WHEN new = 0 AND x0 >= before THEN ' ' ELSE '' END, substring(text, shared + 1))"))
    lines = rows.groupBy("image_id", "band_no", "line_no").agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.sort_array(F.collect_list(F.struct("x0", "x1", "text", "piece"))).alias("ps")
    )
    return lines.select("image_id", "band_no", "line_no", "x0", "x1", "y0", F.array_join(F.col("ps.piece"), "").alias("text"))

"""Pixel statistics from partial histograms and sampled cells.

histograms: image_id, bin (0..255), cnt; cells: image_id, row, col, r, g, b, a.
Every operator groups by image; an image has at most 256 bins and 4096 cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastermill.functions.scalars import round_half_up

# The eight colour buckets in order, and the characters from dark to light.
COLOURS = ("black", "blue", "green", "cyan", "red", "magenta", "yellow", "white")
LEVELS = ".:-=+*#%@"


def merged(histograms: DataFrame, by: str = "image_id") -> DataFrame:
    return histograms.groupBy(by, "bin").agg(F.sum("cnt").alias("cnt"))


def luma_stats(histograms: DataFrame, by: str = "image_id") -> DataFrame:
    """Mean, population standard deviation and share above 200, from counts per grey value."""
    n, s = F.sum("cnt"), F.sum(F.col("bin") * F.col("cnt"))
    s2, bright = F.sum(F.col("bin") * F.col("bin") * F.col("cnt")), F.sum(F.when(F.col("bin") > 200, F.col("cnt")).otherwise(0))
    rows = histograms.groupBy(by).agg(n.alias("n"), s.alias("s"), s2.alias("s2"), bright.alias("bright"))
    mean = F.col("s") / F.col("n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean))
    return rows.select(by, mean.alias("mean"), std.alias("std"), (F.col("bright") / F.col("n")).alias("bright_share"))


def otsu_threshold(histograms: DataFrame, by: str = "image_id", invert: bool = False) -> DataFrame:
    """Otsu's threshold per group: 127 below three non-empty bins, else the lowest bin of largest
    between-class variance, cut to [20, 235]. invert mirrors the greys first.

    The variance is compared as an exact ratio of integers, so equal ones are ties on every engine.
    """
    rows = merged(histograms, by).where("cnt > 0")
    if invert:
        rows = rows.withColumn("bin", 255 - F.col("bin"))
    w = Window.partitionBy(by)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(by, "bin", *(F.sum(x).over(v).alias(n) for n, x, v in (("wb", F.col("cnt"), upto), ("sb", F.col("bin") * F.col("cnt"), upto), ("n", F.col("cnt"), w), ("s", F.col("bin") * F.col("cnt"), w))), F.count(F.lit(1)).over(w).alias("bins"))
    wf = F.col("n") - F.col("wb")
    gap = (F.col("sb") * F.col("n") - F.col("s") * F.col("wb")).cast("decimal(38,0)")
    score = F.when(wf > 0, gap.cast("double") * gap.cast("double") / (F.col("wb").cast("double") * wf.cast("double"))).otherwise(F.lit(0.0))
    rows = rows.withColumn("score", score)
    best = rows.groupBy(by).agg(F.max_by("bin", F.struct("score", -F.col("bin"))).alias("t"), F.max("bins").alias("bins"))
    return best.select(by, F.when(F.col("bins") < 3, 127).otherwise(F.least(F.greatest("t", F.lit(20)), F.lit(235))).cast("int").alias("threshold"))


def percentile_bounds(histograms: DataFrame, low: float = 0.01, high: float = 0.99, by: str = "image_id") -> DataFrame:
    """The grey values at sorted positions floor(p (n - 1)), without interpolation."""
    w = Window.partitionBy(by)
    rows = merged(histograms, by).where("cnt > 0")
    rows = rows.withColumn("upto", F.sum("cnt").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("cnt").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("n") - 1)), F.col("bin")))
    return rows.groupBy(by).agg(at(low).alias("low"), at(high).alias("high"))


def bucket() -> Column:
    bit = lambda c, k: F.when(F.col(c) >= 128, k).otherwise(0)
    return (bit("r", 4) + bit("g", 2) + bit("b", 1)).cast("int")


def colour_name(b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COLOURS)), b + 1)


def colour_shares(cells: DataFrame) -> DataFrame:
    """Percentage of each colour bucket among cells of alpha 128 or more."""
    rows = cells.where("a >= 128").withColumn("bucket", bucket()).groupBy("image_id", "bucket").agg(F.count(F.lit(1)).alias("cnt"))
    share = F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy("image_id"))
    return rows.select("image_id", "bucket", colour_name(F.col("bucket")).alias("colour"), "cnt", share.alias("share"))


def top_colours(cells: DataFrame, k: int = 8) -> DataFrame:
    """The k largest buckets per image (ties: lowest bucket), ranked."""
    w = Window.partitionBy("image_id").orderBy(F.desc("cnt"), "bucket")
    return colour_shares(cells).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def colour_blocks(cells: DataFrame, k: int = 6) -> DataFrame:
    """The k largest buckets per image with share, count and centre (means rounded half up)."""
    rows = cells.where("a >= 128").withColumn("bucket", bucket()).groupBy("image_id", "bucket").agg(F.count(F.lit(1)).alias("cnt"), F.avg("row").alias("r"), F.avg("col").alias("c"))
    share = F.col("cnt") * 100.0 / F.sum("cnt").over(Window.partitionBy("image_id"))
    rows = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("cnt"), "bucket")))
    return rows.where(F.col("rank") <= k).select("image_id", "rank", "bucket", colour_name(F.col("bucket")).alias("colour"), "cnt", "share", round_half_up(F.col("r")).alias("centre_row"), round_half_up(F.col("c")).alias("centre_col"))


def ascii_grid(cells: DataFrame) -> DataFrame:
    """The cells of each image as lines of characters by lightness; transparent cells are spaces."""
    luma = (F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000.0
    level = F.least(F.lit(8), F.floor(luma / 256 * 9)).cast("int")
    char = F.when(F.col("a") < 128, " ").otherwise(F.substring(F.lit(LEVELS), level + 1, F.lit(1)))
    lines = cells.withColumn("chr", char).groupBy("image_id", "row").agg(F.array_join(F.sort_array(F.collect_list(F.struct("col", "chr")))["chr"], "").alias("line"))
    return lines.groupBy("image_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("row", "line")))["line"], "\n").alias("grid"))


def handwriting_score(features: DataFrame) -> DataFrame:
    """Adds score and is_hand (0.55 or more) from row_std, mean_height, n_components (a count), dark_share; unreadable: 0.5, no."""
    # The weights and limits of the four features, and the score that counts as handwriting.
    even = F.lit(1.0) - F.least(F.lit(1.0), F.col("row_std") / 0.13)
    ink = F.when(F.col("dark_share").between(0.03, 0.3), 0.8).otherwise(0.4)
    score = even * 0.35 + F.least(F.lit(1.0), F.col("mean_height") / 60) * 0.30 + F.least(F.lit(1.0), F.col("n_components") / 300) * 0.20 + ink * 0.15
    known = F.lit(True)
    for c in ("row_std", "mean_height", "n_components", "dark_share"):
        known = known & F.col(c).isNotNull()
    return features.withColumn("score", F.when(known, score).otherwise(F.lit(0.5))).withColumn("is_hand", F.col("score") >= 0.55)


def preprocess_plan(images: DataFrame, histograms: DataFrame, allow_enlarge: bool = True, force_invert: bool = False) -> DataFrame:
    """Which steps prepare an image for OCR: image_id, is_dark, applied (invert, otsu or contrast, enlarge), threshold, low, high.

    images: image_id, width, height. Sides below 40 are left alone, and so are images of a standard
    deviation below 12. The threshold of dark images is taken on inverted greys.
    """
    s, p = luma_stats(histograms), percentile_bounds(histograms)
    t = otsu_threshold(histograms).withColumnRenamed("threshold", "t_plain")
    ti = otsu_threshold(histograms, invert=True).withColumnRenamed("threshold", "t_dark")
    rows = images.select("image_id", "width", "height").join(s, "image_id").join(p, "image_id").join(t, "image_id").join(ti, "image_id")
    alone = (F.least("width", "height") < 40) | (F.col("std") < 12)
    dark = ((F.col("mean") < 110) & (F.col("bright_share") > 0.005)) | (F.lit(force_invert) & (F.col("mean") < 200))
    weak = (F.col("std") < 45) | dark | ((F.col("std") < 90) & (F.col("mean") < 175))
    spread = F.col("high") - F.col("low")
    candidate = (F.col("mean") > 165) & F.col("std").between(30, 135) & (1 - F.col("bright_share")).between(0.03, 0.6)
    bigger = F.lit(allow_enlarge) & (dark | weak | candidate) & (F.greatest("width", "height") <= 1200)
    steps = F.array_compact(F.array(F.when(dark, "invert"), F.when(weak, "otsu").when((spread > 20) & (spread < 220), "contrast"), F.when(bigger, "enlarge")))
    return rows.select(
        "image_id",
        (~alone & dark).alias("is_dark"),
        F.when(alone, F.array().cast("array<string>")).otherwise(steps).alias("applied"),
        F.when(dark, F.col("t_dark")).otherwise(F.col("t_plain")).alias("threshold"),
        F.when(dark, 255 - F.col("high")).otherwise(F.col("low")).cast("int").alias("low"),
        F.when(dark, 255 - F.col("low")).otherwise(F.col("high")).cast("int").alias("high"),
    )

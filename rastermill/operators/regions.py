"""Regions of images: rectangles from model answers, pixel coordinates, routing and text.

Rectangles are relative (0..1) doubles until regions_to_pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.functions.scalars import round_half_up, safe_label

RECT = ("x0", "y0", "x1", "y1")


#: What a valid rectangle becomes.
RECT_TYPE = "array<struct<x0:double,y0:double,x1:double,y1:double,is_handwrite:boolean,label:string>>"


def _numbers(texts: Column) -> Column:
    """An array that holds the texts as numbers in [0, 1]; an empty one if a text is no finite number. Null counts as 0."""
    read = F.transform(texts, lambda x: F.coalesce(x, F.lit("0")).try_cast("double"))
    # What is no number is null here, and NaN is larger than any number.
    finite = F.filter(F.array(read), lambda ns: F.forall(ns, lambda n: F.coalesce(F.abs(n) < float("inf"), F.lit(False))))
    return F.transform(finite, lambda ns: F.transform(ns, lambda n: F.least(F.greatest(n, F.lit(0.0)), F.lit(1.0))))


def _truth_rect(v: Column) -> Column:
    """The four values of a rectangle read one by one: a text `true` can't be told from the truth value otherwise."""
    at = lambda path: F.when(F.is_variant_null(F.try_variant_get(v, path, "variant")), F.lit("0")).otherwise(F.try_variant_get(v, path, "double").cast("string"))
    return F.array(*(F.coalesce(at(f"$.{c}"), at(f"$[{i}]"), F.lit("missing")) for i, c in enumerate(RECT)))


def valid_rects(values: Column, path: str = "$") -> Column:
    """The array at a path of a variant as rectangles: struct(x0, y0, x1, y1, is_handwrite, label), invalid ones dropped.

    A rectangle is an object with four numbers or an array of four; numbers are cut to [0, 1]. A JSON
    null counts as 0, anything missing or not a number drops the rectangle. Ends are not sorted here.
    The whole array is read as objects and as arrays of texts at once. Only what these can't tell
    apart is looked up: whether a null of an object stands in the JSON, and truth values.
    """
    fields = ",".join(f"{c}:string" for c in RECT)
    as_objects = F.try_variant_get(values, path, f"array<struct<{fields},isHandwrite:boolean,label:string>>")
    as_arrays = F.try_variant_get(values, path, "array<array<string>>")
    as_given = F.try_variant_get(values, path, "array<variant>")

    def rect(z: Column) -> Column:
        o, a, v = z["o"], z["a"], z["v"]
        given = lambda c: F.when(F.is_variant_null(F.try_variant_get(v, f"$.{c}", "variant")), F.lit("0")).otherwise(F.lit("missing"))
        texts = F.when(F.size(a) >= 4, F.slice(a, 1, 4)).when(o.isNull(), F.array(F.lit("missing"))).otherwise(F.array(*(F.coalesce(o[c], given(c)) for c in RECT)))
        # In an array of one, so that the texts are made once.
        texts = F.transform(F.array(texts), lambda t: F.when(F.exists(t, lambda x: x.isin("true", "false")), _truth_rect(v)).otherwise(t))
        whole = lambda n: F.struct(*(n[i].alias(c) for i, c in enumerate(RECT)), o["isHandwrite"].alias("is_handwrite"), F.coalesce(o["label"], F.lit("")).alias("label"))
        return F.transform(F.flatten(F.transform(texts, _numbers)), whole)

    rects = F.flatten(F.transform(F.arrays_zip(as_objects.alias("o"), as_arrays.alias("a"), as_given.alias("v")), rect))
    return F.coalesce(rects, F.array().cast(RECT_TYPE))


def explode_regions(prechecks: DataFrame, n_text: int = 3, n_interest: int = 6) -> DataFrame:
    """The first text and interest regions of each image, in the model's order, one row each. Prechecks are read once."""

    def part(column: str, kind: str, n: int) -> Column:
        hand = lambda r: r["is_handwrite"] if kind == "text" else F.lit(None).cast("boolean")
        label = lambda r: F.lit("") if kind == "text" else r["label"]
        row = lambda r, i: F.struct(F.lit(kind).alias("kind"), i.alias("region_idx"), label(r).alias("label"), hand(r).alias("is_handwrite"), *(r[c].alias(f"r{c}") for c in RECT))
        return F.coalesce(F.transform(F.slice(F.col(column), 1, n), row), F.array())

    # Outer, as else a filter is put in front that makes the regions a second time.
    rows = prechecks.select("image_id", F.explode_outer(F.concat(part("text_regions", "text", n_text), part("interest_regions", "interest", n_interest))).alias("r"))
    return rows.where("r IS NOT NULL").select("image_id", "r.*")


def clean_label(regions: DataFrame) -> DataFrame:
    """label cut to 40 characters, and label_name fit for names."""
    return regions.withColumn("label", F.substring(F.coalesce("label", F.lit("")), 1, 40)).withColumn("label_name", safe_label(F.col("label")))


def regions_to_pixels(regions: DataFrame, images: DataFrame) -> DataFrame:
    """Adds x0, y0, x1, y1, w, h in pixels and error.

    If all four values lie in [0, 1] they are relative, else already pixels. Ends are sorted, halves
    round up, and a rectangle keeps at least one pixel within the image. A value that is missing or
    not finite gives an error row. Only ids and sizes of the images take part in the join.
    """
    rows = regions.join(images.select("image_id", "width", "height"), "image_id", "left")
    v = {c: F.col(f"r{c}") for c in RECT}
    finite = F.lit(True)
    relative = F.lit(True)
    for c in v.values():
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
        relative = relative & c.between(0.0, 1.0)
    # Step by step, each value a column that the next step reads: as one expression, whose parts occur in
    # one another, the generated code is longer than what the JVM compiles.
    rows = rows.withColumns({"_fine": F.coalesce(finite & (F.col("width") > 0) & (F.col("height") > 0), F.lit(False)), "_relative": relative})
    axes = {"x": "width", "y": "height"}
    scale = lambda size: F.when(F.col("_relative"), F.col(size)).otherwise(F.lit(1))
    ends = lambda a, f: f(v[f"{a}0"], v[f"{a}1"])
    rows = rows.withColumns({f"_{a}{i}": F.when(F.col("_fine"), round_half_up(ends(a, f) * scale(size))) for a, size in axes.items() for i, f in enumerate((F.least, F.greatest))})
    rows = rows.withColumns({f"{a}0": F.when(F.col("_fine"), F.greatest(F.lit(0), F.least(F.col(f"_{a}0"), F.col(size) - 1))).cast("int") for a, size in axes.items()})
    rows = rows.withColumns({f"{a}1": F.when(F.col("_fine"), F.greatest(F.col(f"{a}0") + 1, F.least(F.col(f"_{a}1"), F.col(size)))).cast("int") for a, size in axes.items()})
    rows = rows.withColumns({"w": F.col("x1") - F.col("x0"), "h": F.col("y1") - F.col("y0")})
    rows = rows.withColumn("error", F.when(~F.col("_fine"), F.lit("rectangle needs four finite numbers and a known image size")))
    # In the order in which they have always been.
    out = ("x0", "y0", "x1", "y1", "w", "h", "error")
    return rows.select(*regions.columns, *out) if not set(out) & set(regions.columns) else rows.drop("width", "height", "_fine", "_relative", "_x0", "_x1", "_y0", "_y1")


def crop_size(width: Column, height: Column, max_edge: int) -> tuple[Column, Column]:
    """Output size of a crop: the longer side at most max_edge, never enlarged; 0 keeps it."""
    longer = F.greatest(width, height)
    shrink = (F.lit(max_edge) > 0) & (longer > max_edge)
    fit = lambda side: F.when(shrink, F.greatest(F.lit(1), round_half_up(side * max_edge / longer))).otherwise(side).cast("int")
    return fit(width), fit(height)


def region_text(ocr_lines: DataFrame, empty: str = "(no text found)") -> DataFrame:
    """Lines joined in order of line_no per region; blank text gives the marker."""
    rows = ocr_lines.groupBy("image_id", "region_idx").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("ls"))
    text = F.array_join(F.col("ls.text"), "\n")
    return rows.select("image_id", "region_idx", F.when(F.length(F.trim(text)) > 0, text).otherwise(F.lit(empty)).alias("text"))


def region_confidence(ocr_lines: DataFrame) -> DataFrame:
    """Mean of the finite scores (1 without any) and number of lines per region."""
    score = F.when(~F.isnan("score") & (F.abs("score") != float("inf")), F.col("score"))
    return ocr_lines.groupBy("image_id", "region_idx").agg(F.coalesce(F.avg(score), F.lit(1.0)).alias("confidence"), F.count("line_no").alias("n_lines"))


def explode_lines(ocr: DataFrame) -> DataFrame:
    """One row per OCR line: text, box of its polygon, score. ocr: image_id, region_idx, lines array<struct<text, points array<struct<x,y>>, score>>."""
    rows = ocr.select("image_id", "region_idx", F.posexplode("lines").alias("line_no", "l"))
    low = lambda c: F.floor(F.array_min(F.transform("l.points", lambda p: p[c]))).cast("int")
    high = lambda c: F.ceil(F.array_max(F.transform("l.points", lambda p: p[c]))).cast("int")
    rows = rows.select("image_id", "region_idx", "line_no", F.col("l.text").alias("text"), low("x").alias("x"), low("y").alias("y"), high("x").alias("_x1"), high("y").alias("_y1"), F.col("l.score").alias("score"))
    return rows.withColumn("width", F.col("_x1") - F.col("x")).withColumn("height", F.col("_y1") - F.col("y")).drop("_x1", "_y1")


def lines_to_source(ocr_lines: DataFrame, regions: DataFrame, scale: float = 1.0) -> DataFrame:
    """Line boxes, relative to their crop (enlarged by `scale`), in source coordinates."""
    at = regions.select("image_id", "region_idx", F.col("x0").alias("_x"), F.col("y0").alias("_y"))
    rows = ocr_lines.join(at, ["image_id", "region_idx"])
    back = lambda c: round_half_up(F.col(c) / F.lit(scale))
    return rows.withColumns({"x": back("x") + F.col("_x"), "y": back("y") + F.col("_y"), "width": back("width"), "height": back("height")}).drop("_x", "_y")


def route_handwriting(regions: DataFrame, mode: str = "smart") -> DataFrame:
    """Adds is_hand, source, conflict and to_model from the model's flag (is_handwrite) and the local detector (local_hand).

    visual: flag, else local, else no. local: local, else flag, else no. smart and off: both agree ->
    visual+local; they differ -> the flag wins, conflict; one alone counts. Nothing known: none. With
    mode off no region goes to the model.
    """
    flag, local = F.col("is_handwrite"), F.col("local_hand")
    if mode == "visual":
        value, source = F.coalesce(flag, local), F.when(flag.isNotNull(), "visual").when(local.isNotNull(), "local-fallback")
    elif mode == "local":
        value, source = F.coalesce(local, flag), F.when(local.isNotNull(), "local").when(flag.isNotNull(), "visual-fallback")
    elif mode in ("smart", "off"):
        value = F.coalesce(flag, local)
        source = F.when(flag.isNotNull() & local.isNotNull() & (flag == local), "visual+local").when(flag.isNotNull(), "visual").when(local.isNotNull(), "local-fallback")
    else:
        raise ValueError("mode must be visual, local, smart or off")
    clash = F.coalesce(flag != local, F.lit(False)) if mode in ("smart", "off") else F.lit(False)
    hand = F.coalesce(value, F.lit(False))
    return regions.select("*", hand.alias("is_hand"), F.coalesce(source, F.lit("none")).alias("route_source"), clash.alias("conflict"), (hand & F.lit(mode != "off")).alias("to_model"))


def needs_upgrade(regions: DataFrame, mode: str = "full", has_model: bool = True) -> DataFrame:
    """Adds upgrade and why. regions: is_hand, is_dark, degraded, engine, confidence, n_lines."""
    if mode not in ("off", "low", "full"):
        raise ValueError("mode must be off, low or full")
    dark = F.coalesce("is_dark", F.lit(False)) & (F.col("n_lines") == 0)
    able = F.lit(mode != "off" and has_model) & ~F.coalesce("degraded", F.lit(False)) & (F.coalesce("engine", F.lit("")) != "handwrite-api")
    # The confidence below which print, and handwriting, is read again.
    low = ~F.col("is_hand") & ~dark & (F.col("confidence") < 0.85)
    full = (F.col("confidence") < F.when(F.col("is_hand"), 0.9).otherwise(0.85)) | dark
    why = F.concat_ws("+", F.when(F.col("confidence") < 0.85, F.format_string("confidence %.2f<0.85", "confidence")), F.when(dark, "dark and empty"))
    up = able & (low if mode == "low" else full)
    return regions.select("*", up.alias("upgrade"), F.when(up, why).alias("why"))


def resolve_region_text(regions: DataFrame, ocr: DataFrame, model: DataFrame, upgrade: DataFrame) -> DataFrame:
    """The final text of each region: image_id, region_idx, text, engine, degraded, reason.

    Handwriting: the model, on error OCR (degraded), else unavailable. Print: OCR, on error the model
    (degraded), else unavailable. A successful upgrade replaces OCR text, a failed one leaves a note.
    ocr, model, upgrade: image_id, region_idx, text, error.
    """
    keys = ["image_id", "region_idx"]
    rows = regions.select(*keys, "to_model")
    for name, df in (("o", ocr), ("m", model), ("u", upgrade)):
        rows = rows.join(df.select(*keys, F.col("text").alias(f"{name}_text"), F.col("error").alias(f"{name}_error")), keys, "left")
    ok = lambda n: F.coalesce(F.col(f"{n}_error").isNull() & (F.length(F.col(f"{n}_text")) > 0), F.lit(False))
    o, m, u, hand = ok("o"), ok("m"), ok("u"), F.col("to_model")
    engine = F.when(hand & m, "handwrite-api").when(~hand & o & u, "upgrade-api").when(o, "ocr").when(~hand & m, "vision-fallback").otherwise("unavailable")
    rows = rows.withColumn("engine", engine)
    text = F.when(F.col("engine").isin("handwrite-api", "vision-fallback"), F.col("m_text")).when(F.col("engine") == "upgrade-api", F.col("u_text")).when(F.col("engine") == "ocr", F.col("o_text")).otherwise("")
    note = F.when(hand & ~m, F.substring("m_error", 1, 120)).when(~hand & ~o, F.substring("o_error", 1, 120)).when(~hand & o & F.col("u_error").isNotNull(), F.concat(F.lit("upgrade failed: "), F.substring("u_error", 1, 160)))
    degraded = F.col("engine").isin("vision-fallback", "unavailable") | (hand & (F.col("engine") == "ocr"))
    return rows.select(*keys, text.alias("text"), "engine", degraded.alias("degraded"), note.alias("reason"))

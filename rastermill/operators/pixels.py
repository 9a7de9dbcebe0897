"""Pixel kernels: numpy in mapInPandas for one image or tile at a time, small partials out.

images: image_id, width, height, n_channels, data (rows of grey, BGR or BGRA bytes). What leaves a
kernel is grouped and merged by ordinary aggregations (see stats); pixels stay out of shuffles
but for the joins of tiles and regions with their image, on its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.functions.lineage import cut_lineage
from rastermill.operators.regions import crop_size


def as_rgba(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """height x width x 4; grey is repeated, a missing alpha is 255."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        a = np.repeat(a, 3, axis=2)
    rgb = a[:, :, 2::-1]
    alpha = a[:, :, 3:4] if channels == 4 else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([rgb, alpha], axis=2)


def as_luma(rgba: np.ndarray) -> np.ndarray:
    return rgba[:, :, 0] * 0.299 + rgba[:, :, 1] * 0.587 + rgba[:, :, 2] * 0.114


def grid_size(width: int, height: int, size: int) -> tuple[int, int]:
    """Rows and columns of the sampling grid: the longer side has `size` cells (8 to 64)."""
    size = max(8, min(64, int(np.floor(size + 0.5))))
    short = max(1, -(-min(width, height) * size // max(width, height)))
    return (short, size) if width >= height else (size, short)


def _each(frames: Iterator[pd.DataFrame], kernel) -> Iterator[pd.DataFrame]:
    """Runs the kernel on every row that has pixels; what it returns are frames."""
    for frame in frames:
        parts = [kernel(row) for row in frame.itertuples(index=False) if row.data is not None and row.width > 0]
        if parts:
            yield pd.concat(parts, ignore_index=True)


def _id(df: DataFrame) -> str:
    return df.schema["image_id"].dataType.simpleString()


def sample_cells(images: DataFrame, size: int = 32) -> DataFrame:
    """image_id, row, col, r, g, b, a: the pixel in the middle of each cell of the grid."""

    def kernel(im) -> pd.DataFrame:
        rows, cols = grid_size(im.width, im.height, size)
        y = ((np.arange(rows) + 0.5) * im.height / rows).astype(int)
        x = ((np.arange(cols) + 0.5) * im.width / cols).astype(int)
        p = as_rgba(im.data, im.width, im.height, im.n_channels)[y[:, None], x[None, :]].reshape(-1, 4).astype(int)
        return pd.DataFrame({"image_id": im.image_id, "row": np.repeat(np.arange(rows), cols), "col": np.tile(np.arange(cols), rows), "r": p[:, 0], "g": p[:, 1], "b": p[:, 2], "a": p[:, 3]})

    schema = f"image_id {_id(images)}, row int, col int, r int, g int, b int, a int"
    return _columns(images).mapInPandas(lambda it: _each(it, kernel), schema)


def explode_pixels(images: DataFrame) -> DataFrame:
    """One row per pixel; for small images and tests."""

    def kernel(im) -> pd.DataFrame:
        p = as_rgba(im.data, im.width, im.height, im.n_channels).reshape(-1, 4).astype(int)
        n = np.arange(len(p))
        return pd.DataFrame({"image_id": im.image_id, "y": n // im.width, "x": n % im.width, "r": p[:, 0], "g": p[:, 1], "b": p[:, 2], "a": p[:, 3]})

    return _columns(images).mapInPandas(lambda it: _each(it, kernel), f"image_id {_id(images)}, y int, x int, r int, g int, b int, a int")


def _columns(images: DataFrame) -> DataFrame:
    return images.select("image_id", "width", "height", "n_channels", "data")


def tile_histograms(images: DataFrame, tiles: DataFrame | None = None) -> DataFrame:
    """image_id, tile_id, bin, cnt: non-empty bins of rounded luma, per tile (or of the image as tile 0)."""
    if tiles is None:
        tiles = images.select("image_id", F.lit(0).alias("tile_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("width").alias("w"), F.col("height").alias("h"))
    cut = extract_tiles(tiles, images).select("image_id", "tile_id", F.col("w").alias("width"), F.col("h").alias("height"), "n_channels", "data")

    def kernel(im) -> pd.DataFrame:
        grey = np.clip(np.floor(as_luma(as_rgba(im.data, im.width, im.height, im.n_channels)) + 0.5), 0, 255).astype(int)
        counts = np.bincount(grey.ravel(), minlength=256)
        bins = np.flatnonzero(counts)
        return pd.DataFrame({"image_id": im.image_id, "tile_id": im.tile_id, "bin": bins, "cnt": counts[bins]})

    return cut.mapInPandas(lambda it: _each(it, kernel), f"image_id {_id(images)}, tile_id int, bin int, cnt long")


def extract_tiles(tiles: DataFrame, images: DataFrame) -> DataFrame:
    """tiles with their own pixels (n_channels, data), 1:1.

    The rectangles of an image travel to it as one list, so every image is read and sent once.
    """
    lists = tiles.groupBy("image_id").agg(F.collect_list(F.struct("tile_id", "x", "y", "w", "h")).alias("rects"))
    rows = _columns(images).join(lists, "image_id")

    def kernel(im) -> pd.DataFrame:
        a = np.frombuffer(im.data, np.uint8).reshape(im.height, im.width, im.n_channels)
        out = [(im.image_id, *(r[k] for k in ("tile_id", "x", "y", "w", "h")), im.n_channels, a[r["y"] : r["y"] + r["h"], r["x"] : r["x"] + r["w"]].tobytes()) for r in im.rects]
        return pd.DataFrame(out, columns=["image_id", "tile_id", "x", "y", "w", "h", "n_channels", "data"])

    return rows.mapInPandas(lambda it: _each(it, kernel), f"image_id {_id(images)}, tile_id int, x int, y int, w int, h int, n_channels int, data binary")


def shrink(a: np.ndarray, out_h: int, out_w: int) -> np.ndarray:
    """Pixels averaged over the area that each new pixel covers, row by row: the mean of the picture is kept, thin strokes fade but stay.

    A new row is the weighted mean of the rows it covers; its sums from the left, at the (fractional)
    borders of the new pixels, give these by their differences.
    """
    h, w, channels = a.shape
    at = np.arange(out_w + 1) * w / out_w
    whole = np.minimum(at.astype(int), w - 1)
    part = (at - whole)[:, None]
    out = np.empty((out_h, out_w, channels), np.uint8)
    for r in range(out_h):
        low, high = r * h / out_h, (r + 1) * h / out_h
        rows = np.arange(int(low), min(h, int(np.ceil(high))))
        weights = np.minimum(rows + 1, high) - np.maximum(rows, low)
        row = np.tensordot(weights / weights.sum(), a[rows[0] : rows[-1] + 1].astype(float), 1)
        sums = np.concatenate([np.zeros((1, channels)), np.cumsum(row, axis=0)])
        # A sum that is a half but for the last bits of its digits counts as one.
        out[r] = np.floor(np.diff(sums[whole] + part * row[whole], axis=0) * out_w / w + 0.5 + 1e-9)
    return out


def crop_regions(regions: DataFrame, images: DataFrame, max_edge: int = 800, smooth: bool = False) -> DataFrame:
    """image_id, region_idx, source rectangle, out_w, out_h, n_channels, data; never enlarged.

    A region that is larger than max_edge is made smaller: by the pixel in the middle of each new one, or
    with smooth by the mean of all pixels that the new one covers.
    """
    out_w, out_h = crop_size(F.col("w"), F.col("h"), max_edge)
    sized = regions.where("w IS NOT NULL").withColumn("out_w", out_w).withColumn("out_h", out_h)
    lists = sized.groupBy("image_id").agg(F.collect_list(F.struct("region_idx", "x0", "y0", "w", "h", "out_w", "out_h")).alias("rects"))

    def kernel(im) -> pd.DataFrame:
        a = np.frombuffer(im.data, np.uint8).reshape(im.height, im.width, im.n_channels)
        out = []
        for r in im.rects:
            own = a[r["y0"] : r["y0"] + r["h"], r["x0"] : r["x0"] + r["w"]]
            if smooth and (r["h"], r["w"]) != (r["out_h"], r["out_w"]):
                out.append((im.image_id, *(r[k] for k in ("region_idx", "x0", "y0", "w", "h", "out_w", "out_h")), im.n_channels, shrink(own, r["out_h"], r["out_w"]).tobytes()))
                continue
            y = r["y0"] + ((np.arange(r["out_h"]) + 0.5) * r["h"] / r["out_h"]).astype(int)
            x = r["x0"] + ((np.arange(r["out_w"]) + 0.5) * r["w"] / r["out_w"]).astype(int)
            out.append((im.image_id, *(r[k] for k in ("region_idx", "x0", "y0", "w", "h", "out_w", "out_h")), im.n_channels, a[y[:, None], x[None, :]].tobytes()))
        return pd.DataFrame(out, columns=["image_id", "region_idx", "x0", "y0", "w", "h", "out_w", "out_h", "n_channels", "data"])

    kind = regions.schema["region_idx"].dataType.simpleString()
    schema = f"image_id {_id(images)}, region_idx {kind}, x0 int, y0 int, w int, h int, out_w int, out_h int, n_channels int, data binary"
    return _columns(images).join(lists, "image_id").mapInPandas(lambda it: _each(it, kernel), schema)


def rotate_images(images: DataFrame, angle: int) -> DataFrame:
    """Images turned clockwise by 0, 90, 180 or 270 degrees, before anything else is done with them."""
    if angle not in (0, 90, 180, 270):
        raise ValueError("angle must be 0, 90, 180 or 270")
    if not angle:
        return _columns(images)

    def kernel(im) -> pd.DataFrame:
        a = np.rot90(np.frombuffer(im.data, np.uint8).reshape(im.height, im.width, im.n_channels), -angle // 90)
        return pd.DataFrame([(im.image_id, a.shape[1], a.shape[0], im.n_channels, a.tobytes())], columns=["image_id", "width", "height", "n_channels", "data"])

    return _columns(images).mapInPandas(lambda it: _each(it, kernel), f"image_id {_id(images)}, width int, height int, n_channels int, data binary")


def preprocess_images(images: DataFrame, plan: DataFrame) -> DataFrame:
    """Grey images after the steps of stats.preprocess_plan: image_id, width, height, data, applied."""

    def kernel(im) -> pd.DataFrame:
        g = as_luma(as_rgba(im.data, im.width, im.height, im.n_channels))
        steps = list(im.applied)
        if "invert" in steps:
            g = 255 - g
        if "otsu" in steps:
            g = np.where(g >= im.threshold, 255.0, 0.0)
        elif "contrast" in steps:
            g = np.clip((g - im.low) / max(1, im.high - im.low) * 255, 0, 255)
        if "enlarge" in steps:
            g = g.repeat(2, axis=0).repeat(2, axis=1)
        out = np.clip(np.floor(g + 0.5), 0, 255).astype(np.uint8)
        return pd.DataFrame([(im.image_id, out.shape[1], out.shape[0], out.tobytes(), steps)], columns=["image_id", "width", "height", "data", "applied"])

    rows = _columns(images).join(plan, "image_id")
    return rows.mapInPandas(lambda it: _each(it, kernel), f"image_id {_id(images)}, width int, height int, data binary, applied array<string>")


def label_components(points: set[tuple[int, int]]) -> dict[tuple[int, int], tuple[int, int]]:
    """Every point with the smallest point of its 8-connected set, by flood filling: what the runs are tested against."""
    label: dict[tuple[int, int], tuple[int, int]] = {}
    for start in sorted(points):
        if start in label:
            continue
        label[start] = start
        stack = [start]
        while stack:
            y, x = stack.pop()
            for n in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if n in points and n not in label:
                    label[n] = start
                    stack.append(n)
    return label


def label_runs(ink: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, root) of the runs of a mask, in order of rows: root is the first run of each run's 8-connected set."""
    edge = np.diff(np.pad(ink.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    width = ink.shape[1] + 2
    return row, start, end, first_runs(row * width + start, row * width + end, width)


def first_runs(start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """For each run the first one of its 8-connected set. start, end: row * width + column, in order; rows are narrower than width - 1."""
    # Runs of the row above that end at or after the start and start at or before the end: a stretch of neighbours.
    first, last = np.searchsorted(end, start - width), np.searchsorted(start, end - width, side="right")
    n = last - first
    below = np.repeat(np.arange(len(n)), n)
    above = np.arange(len(below)) + (first - np.cumsum(n) + n)[below]
    root = np.arange(len(n))
    while True:
        x, y = root[above], root[below]
        apart = x != y
        if not apart.any():
            return root
        above, below, x, y = above[apart], below[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(farther := root[root], root):
            root = farther


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    one, other = column.slice(1), column.slice(0, len(column) - 1)
    return pc.coalesce(pc.not_equal(one, other), pc.xor(pc.is_null(one), pc.is_null(other))).to_numpy(zero_copy_only=False)


def _labelled_blocks(cells: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """key, row, col, lr, lc of the cells of whole blocks, each in order and once. cells: key, br, bc, row, col."""
    key, (br, bc, row, col) = cells.column(0), (cells.column(i).to_numpy() for i in range(1, 5))
    new = np.concatenate([[True], _changes(key) | (br[1:] != br[:-1]) | (bc[1:] != bc[:-1])])
    # Rows of blocks one below another, with an empty one between.
    line = (np.cumsum(new) - 1) * (span + 1) + row - br * span
    at = line * (span + 2) + col - bc * span
    begin = np.concatenate([[True], at[1:] != at[:-1] + 1])
    runs = np.flatnonzero(begin)
    root = first_runs(at[runs], at[np.append(runs[1:], len(at)) - 1] + 1, span + 2)
    head = runs[root[np.cumsum(begin) - 1]]
    return pa.RecordBatch.from_arrays([key, *(pa.array(x.astype(np.int32)) for x in (row, col, row[head], col[head]))], names=[cells.schema.names[0], "row", "col", "lr", "lc"])


def connected_components(cells: DataFrame, key: str = "image_id", span: int = 256) -> DataFrame:
    """key, row, col, label_row, label_col: the smallest cell of each cell's 8-connected set.

    Cells are labelled inside blocks of span x span by their runs; a block is bounded, however large the
    picture, and a batch labels all its blocks at once, however small they are. The labels of touching blocks are then contracted: each is hooked to its least neighbour,
    chains of hooks are halved until each label has its root, and links between roots go on to the next
    round. A long winding line over n blocks is a chain, so it takes about log2(n) steps and not n.
    Rows with a null row or column are left out; repeated cells give one row.
    """
    kind = cells.schema[key].dataType.simpleString()
    named = cells.where("row IS NOT NULL AND col IS NOT NULL")
    blocks = named.select(key, "row", "col", F.floor(F.col("row") / span).alias("br"), F.floor(F.col("col") / span).alias("bc"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.concat_batches([held, batch]) if held is not None else batch
            same = [~_changes(held.column(i)) for i in range(5)]
            held = held.filter(pa.array(np.concatenate([[True], ~np.logical_and.reduce(same)])))
            # The last block may go on in the next batch.
            ends = np.flatnonzero(np.logical_or.reduce([_changes(held.column(i)) for i in range(3)]))
            whole = int(ends[-1]) + 1 if len(ends) else 0
            if whole:
                yield _labelled_blocks(held.slice(0, whole), span)
                held = held.slice(whole)
        if held is not None:
            yield _labelled_blocks(held, span)

    place = [key, "br", "bc"]
    blocks = blocks.select(*place, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))
    labelled = blocks.repartition(*place).sortWithinPartitions(*place, "row", "col").mapInArrow(local, f"`{key}` {kind}, row int, col int, lr int, lc int")
    labelled = cut_lineage(labelled)
    # Links between labels of neighbouring blocks: half of the neighbours of the cells on the blocks' edges, and only those in other blocks.
    edge = labelled.where(f"pmod(row, {span}) IN (0, {span - 1}) OR pmod(col, {span}) IN (0, {span - 1})")
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (1, -1), (1, 0), (1, 1))))
    near = edge.select(key, F.explode(around).alias("o"), "row", "col", F.struct("lr", "lc").alias("p"))
    near = near.where(f"floor((row + o.a) / {span}) <> floor(row / {span}) OR floor((col + o.b) / {span}) <> floor(col / {span})")
    near = near.select(key, (F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "p")
    links = near.join(edge.select(key, "row", "col", F.struct("lr", "lc").alias("q")), [key, "row", "col"]).select(key, "p", "q")
    links = cut_lineage(links.unionByName(links.select(key, F.col("q").alias("p"), F.col("p").alias("q"))).distinct())
    roots = contracted(links, key)
    out = labelled.withColumn("p", F.struct("lr", "lc")).join(roots, [key, "p"], "left").withColumn("root", F.coalesce("root", "p"))
    return out.select(key, "row", "col", F.col("root.lr").alias("label_row"), F.col("root.lc").alias("label_col"))


def contracted(links: DataFrame, key: str) -> DataFrame:
    """key, p, root: the least label of the component of each label p that has a link. links: key, p, q, in both directions."""
    roots = links.select(key, "p").distinct().withColumn("root", F.col("p"))
    while not links.isEmpty():
        # Each root of this round and its least neighbour, if that is smaller.
        hooks = links.groupBy(key, "p").agg(F.min("q").alias("q")).select(key, F.col("p").alias("a"), F.least("p", "q").alias("b"))
        hooks = flattened(hooks, key)
        at = lambda c: hooks.withColumnsRenamed({"a": c, "b": f"{c}_new"})
        roots = cut_lineage(roots.join(at("root"), [key, "root"], "left").select(key, "p", F.coalesce("root_new", "root").alias("root")))
        links = links.join(at("p"), [key, "p"]).join(at("q"), [key, "q"]).select(key, F.col("p_new").alias("p"), F.col("q_new").alias("q")).where("p <> q").distinct()
        links = cut_lineage(links)
    return roots


def flattened(hooks: DataFrame, key: str) -> DataFrame:
    """Pointers a -> b to smaller ones, or to themselves, followed to their ends: each step doubles how far they reach."""
    while True:
        hooks = cut_lineage(hooks)
        on = hooks.select(key, F.col("a").alias("b"), F.col("b").alias("c"))
        farther = hooks.join(on, [key, "b"], "left").select(key, "a", "b", F.coalesce("c", "b").alias("c"))
        farther = cut_lineage(farther)
        hooks = farther.select(key, "a", F.col("c").alias("b"))
        if farther.where("c <> b").isEmpty():
            return hooks


def run_heights(ink: np.ndarray) -> np.ndarray:
    """The heights of the 8-connected sets of a mask, from its runs: one object per run and pair of touching runs."""
    row, _, _, of = label_runs(ink)
    roots, of = np.unique(of, return_inverse=True)
    low, high = np.full(len(roots), ink.shape[0]), np.zeros(len(roots), np.int64)
    np.minimum.at(low, of, row)
    np.maximum.at(high, of, row)
    return high - low + 1


def ink_features(images: DataFrame, thresholds: DataFrame) -> DataFrame:
    """image_id, dark_share, n_components, per_area, mean_height, row_std of the binarised ink.

    thresholds: image_id, threshold (stats.otsu_threshold). Components are counted on every second
    pixel of every second row; per_area counts them by 10,000 of these samples, mean_height is in
    pixels. row_std is the deviation of the ink's share between at most 48 bands of the sampled rows
    (every second column of them), which share a row where they meet within one.
    """

    def kernel(im) -> pd.DataFrame:
        ink = as_luma(as_rgba(im.data, im.width, im.height, im.n_channels)) < im.threshold
        # At least two rows and columns: the last ones stand in.
        rows, columns = (np.minimum(n - 1, 2 * np.arange(max(2, -(-n // 2)))) for n in ink.shape)
        small = ink[np.ix_(rows, columns)]
        heights, n = run_heights(small) * 2, min(48, len(rows))
        tall = len(rows) / n
        bands = [small[int(y * tall) : min(len(rows), int(np.ceil((y + 1) * tall))), ::2].mean() for y in range(n)]
        values = (im.image_id, float(ink.mean()), len(heights), len(heights) * 10000.0 / small.size, float(heights.mean()) if len(heights) else 0.0, float(np.std(bands)))
        return pd.DataFrame([values], columns=["image_id", "dark_share", "n_components", "per_area", "mean_height", "row_std"])

    rows = _columns(images).join(thresholds, "image_id")
    return rows.mapInPandas(lambda it: _each(it, kernel), f"image_id {_id(images)}, dark_share double, n_components long, per_area double, mean_height double, row_std double")
